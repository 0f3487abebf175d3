"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Base findings are the seeds. The two words before a finding, however long, are a lexical pattern, where a
finding just before counts as the word ``<id>``. Occurrences that look like an identifier (numbers of six
or more digits with at most three signs between two of them, ``name(at)host`` and the like, of any length)
are instances, tied to the patterns before them; the table of pattern-instance pairs is a graph, and its
scores are found in rounds: a pattern's confidence is the mean score of its instances, an instance's
score is what its patterns leave no doubt of. Instances of high score that no base pattern finds are
added to the spans.

All of this is DataFrame functions. Offsets come from the lengths of the text between matches, as
``split`` and ``regexp_extract_all`` cut the text at the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the base patterns: they match the same text, in linear time. A match can begin
# inside a run of its first characters only right after another match (\G).
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be an identifier: an address with a spelt @, or numbers in groups.
_LIKELY = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9.-]{2,}+|[+(]?[0-9](?:[\x20().\x2F-]{0,3}[0-9]){5,}+"
#: Rounds of scoring, instances a pattern must have, and the score from which an instance is reported.
ROUNDS, SUPPORT, SURE = 3, 3, 0.7
_SPAN = "array<struct<kind:string,start:bigint,stop:bigint,found:string,pattern:string>>"
#: Matches are placed in the text in groups of so many, so that a text of n matches does not take n * n steps.
_GROUP = 256


def _pattern(before: Column) -> Column:
    """The last two words of the text before a span, lower-cased; an empty string if there are not two."""
    return F.lower(F.regexp_extract(before, r"(?<!\S)(\S++\s++\S++)\s*+$", 1))


def spans(text: Column, pattern: str, kind: str, valid=None) -> Column:
    """Array of (kind, start, stop, found, pattern) of all matches, or of the valid ones."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(found, between, lambda m, b: F.struct(m.alias("m"), b.alias("b"))), lambda p: p["m"].isNotNull())  # the last between has no match

    def one(p: Column, i: Column) -> Column:
        before = F.concat(F.when(i > 0, "<id>").otherwise(""), p["b"])
        return F.struct(F.lit(kind).alias("kind"), F.length(p["b"]).cast("bigint").alias("start"), F.length(p["m"]).cast("bigint").alias("stop"), p["m"].alias("found"), _pattern(before).alias("pattern"))

    empty = F.expr(f"cast(array() as {_SPAN})")
    zero = F.lit(0).cast("bigint")

    def move(s: Column, at: Column) -> Column:
        return s.withField("start", s["start"] + at).withField("stop", s["stop"] + at)

    def add(acc: Column, s: Column) -> Column:  # of s, start and stop are yet the lengths between and in matches
        begin = acc["at"] + s["start"]
        end = begin + s["stop"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(s.withField("start", begin).withField("stop", end))).alias("out"))

    def append(acc: Column, g: Column) -> Column:
        return F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(g["out"], lambda s: move(s, acc["at"])))).alias("out"))

    lengths = F.transform(pairs, one)
    groups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(_GROUP)), lambda i: F.aggregate(F.slice(lengths, i, _GROUP), F.struct(zero.alias("at"), empty.alias("out")), add))
    out = F.aggregate(groups, F.struct(zero.alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("out")), append, lambda acc: F.flatten(acc["out"]))
    return F.filter(out, lambda s: valid(s["found"])) if valid else out


def _octets(m: Column) -> Column:
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.substring(F.lpad(p, 3, "0"), 1, 3).cast("int") <= 255))


def _luhn(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.length(digits).between(13, 19) & (F.aggregate(F.when(F.length(digits).between(13, 19), values).otherwise(F.array(F.lit(1))), F.lit(0), lambda a, x: a + x) % 10 == 0)


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> Column:
    none = F.expr(f"cast(array() as {_SPAN})")
    digits = text.rlike("[0-9]")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), spans(text, _EMAIL, "email")).otherwise(none),
        F.when(digits & F.contains(text, F.lit(".")), spans(text, _IP, "ip", _octets)).otherwise(none),
        F.when(digits, spans(text, _CARD, "card", _luhn)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), spans(text, _PHONE, "phone", _phone)).otherwise(none),
    )


def scores(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(instance, kind, score) of instances that are no seeds, from pairs(pattern, instance, seed),
    seed being the base kind or null. Every round is a few aggregations over the distinct pairs, and
    leaves a table of one row per instance reached."""
    seeds = stage(spark, pairs.groupBy("instance").agg(F.max("seed").alias("kind")).where("kind is not null").withColumn("score", F.lit(1.0)), "seeds")
    sizes = pairs.groupBy("pattern").agg(F.count_distinct("instance").alias("n")).where(F.col("n") >= SUPPORT)
    edges = stage(spark, pairs.select("pattern", "instance").distinct().join(sizes, "pattern"), "edges")
    known = seeds
    for _ in range(ROUNDS):
        confidence = edges.join(known, "instance").groupBy("pattern", "kind").agg((F.sum("score") / (F.first("n") + 0.5)).alias("confidence"), F.count("*").alias("held")).where("held > 1")
        reached = edges.join(confidence, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        best = reached.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score")
        found = stage(spark, best.join(seeds.select("instance"), "instance", "left_anti"), "scores")
        known = seeds.unionByName(found)
    return found


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per row of docs.

    A null text is empty; ids may be null or repeated; texts that repeat have the same spans; an empty
    table gives an empty one; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    likely = F.when(F.col("t").rlike("[0-9@]|[({\\[]at[)}\\]]"), spans(F.col("t"), _LIKELY, "")).otherwise(F.expr(f"cast(array() as {_SPAN})"))
    rows = rows.select("id", F.xxhash64("t").alias("h"), base_spans(F.col("t")).alias("base"), likely.alias("likely"))
    clear = F.filter("likely", lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    rows = stage(spark, rows.select("id", "h", "base", clear.alias("likely")), "pii")
    occurrences = rows.select("id", "h", F.explode(F.concat("base", "likely")).alias("s")).select(
        "id", "h", "s.start", "s.stop", F.lower(F.regexp_replace("s.found", r"[\s().-]", "")).alias("instance"), F.col("s.pattern").alias("pattern"), F.when(F.col("s.kind") != "", F.col("s.kind")).alias("seed")
    )
    pairs = stage(spark, occurrences.where("pattern <> ''").select("pattern", "instance", "seed").distinct(), "pairs")
    sure = scores(spark, pairs).where(F.col("score") >= SURE).select("instance", F.col("kind").alias("added"))
    added = occurrences.where("seed is null").join(sure, "instance").groupBy("id", "h").agg(F.collect_set(F.struct(F.col("added").alias("kind"), "start", "stop")).alias("more"))
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))
    rows = rows.join(added.withColumnsRenamed({"id": "id_", "h": "h_"}), same, "left")
    base = F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["stop"]))
    order = {k: i for i, k in enumerate(KINDS)}

    def joined(a: Column) -> Column:
        keyed = F.array_sort(F.transform(a, lambda s: F.struct(F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for k, i in order.items()], F.lit(9)).alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")

    more = F.coalesce("more", F.expr("cast(array() as array<struct<kind:string,start:bigint,stop:bigint>>)"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(F.col("id").alias(id_col), *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, more)).alias("spans"), F.size(more).cast("long").alias("n_added"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark, table(spark, sf_dir, "documents"))
