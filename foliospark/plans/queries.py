"""Named queries over the star-schema and text tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.operators import layout as lay
from foliospark.operators import validate as val

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_LINES = "SELECT doc_id, source, ord - 1 AS ord, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)"
_KEYED = f"SELECT *, regexp_replace(lower(trim(line, ' ')), '[0-9]', '#', 'g') AS key FROM ({_LINES})"
_FURNITURE = f"""SELECT source, key, count(*) AS n FROM (SELECT DISTINCT source, doc_id, key FROM ({_KEYED})
  WHERE key <> '' AND NOT regexp_matches(key, '^#+\\.?$|^question #+|^\\(?[a-j][).]?$')) GROUP BY source, key HAVING count(*) >= 3""".replace("\\\\", "\\")


def _lines(t):
    return lay.lines_of(t("documents"), ["doc_id", "source"])


@query(f"SELECT doc_id, source, ord::INT AS ord, line FROM ({_LINES})")
def lines_scan(t):
    return _lines(t)


@query(_FURNITURE)
def furniture_keys(t):
    return lay.furniture_keys(_lines(t), "source", "doc_id", share=0.0)


@query(f"SELECT doc_id, source, ord::INT AS ord, line FROM ({_KEYED}) k WHERE NOT EXISTS (SELECT 1 FROM ({_FURNITURE}) f WHERE f.source = k.source AND f.key = k.key)")
def content_lines(t):
    lines = _lines(t)
    return lay.content_lines(lines, lay.furniture_keys(lines, "source", "doc_id", share=0.0), "source")


@query(f"SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) AS text FROM ({_LINES}) GROUP BY doc_id")
def line_reassembly(t):
    return lay.joined_lines(_lines(t), ["doc_id"])


@query("""SELECT l_orderkey, list_reduce(list_prepend(0, list(l_linenumber ORDER BY l_partkey, l_suppkey, l_linenumber)), lambda a, x: CASE WHEN x = a + 1 THEN x ELSE a END)::INT AS run FROM lineitem GROUP BY l_orderkey""")
def anchor_runs(t):
    return lay.number_run(t("lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber"], "l_linenumber")


@query("SELECT l_orderkey, arg_max(l_suppkey, {'n': n, 'q': q, 's': -l_suppkey}) AS best FROM (SELECT l_orderkey, l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def best_column(t):
    by = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return lay.best_by(by, ["l_orderkey"], "l_suppkey", F.col("n"), F.col("q"), -F.col("l_suppkey"))


_EV = "SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events"


def _events(t):
    return t("events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


_ISLANDS = f"SELECT event_id, user_id, (sum(step) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 172800000000 THEN 1 ELSE 0 END AS step FROM ({_EV}))"


@query(_ISLANDS)
def gap_islands(t):
    return lay.islands(_events(t), ["user_id"], ["us", "event_id"], "us", 172_800_000_000).select("event_id", "user_id", "island")


@query(f"SELECT event_id, user_id FROM ({_ISLANDS}) WHERE island = 0")
def tail_cut(t):
    return lay.tail_cut(_events(t), ["user_id"], ["us", "event_id"], "us", 172_800_000_000).select("event_id", "user_id")


@query(f"SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS owner FROM ({_EV})")
def asof_owner(t):
    rows = lay.asof_owner(_events(t), ["user_id"], [F.col("us"), F.col("event_id")], F.col("event_type") == "error", F.col("event_id"))
    return rows.select("event_id", "owner")


_BOXES = "SELECT p_brand, p_size AS band, min(p_retailprice) AS y0, min(p_retailprice) + 300 AS y1, 5.0 AS x0, 25.0 AS x1 FROM part GROUP BY p_brand, p_size"


def _boxes(t):
    return t("part").groupBy("p_brand", F.col("p_size").alias("band")).agg(F.min("p_retailprice").alias("y0"), (F.min("p_retailprice") + 300).alias("y1")).withColumns({"x0": F.lit(5.0), "x1": F.lit(25.0)})


@query(f"SELECT p.p_partkey, b.band FROM part p JOIN ({_BOXES}) b ON p.p_brand = b.p_brand AND p.p_size BETWEEN b.x0 AND b.x1 AND p.p_retailprice BETWEEN b.y0 AND b.y1")
def point_in_box(t):
    return lay.points_in(t("part"), _boxes(t), ["p_brand"], "p_size", "p_retailprice").select("p_partkey", "band")


@query(f"SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM ({_BOXES}) b WHERE p.p_brand = b.p_brand AND p.p_size BETWEEN b.x0 AND b.x1 AND p.p_retailprice BETWEEN b.y0 AND b.y1)")
def anti_in_box(t):
    return lay.points_in(t("part"), _boxes(t), ["p_brand"], "p_size", "p_retailprice", "left_anti").select("p_partkey")


_BAND = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS y0, l_quantity + 10 AS y1 FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM ({_BAND}) a WHERE NOT EXISTS (SELECT 1 FROM ({_BAND}) b WHERE a.l_orderkey = b.l_orderkey AND b.l_partkey < a.l_partkey AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * least(a.y1 - a.y0, b.y1 - b.y0))")
def band_self_anti(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 10).alias("y1"))
    return lay.band_first(rows, ["l_orderkey"], "l_linenumber", "y0", "y1", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH c AS (SELECT DISTINCT c_nationkey, x, count(*) OVER (PARTITION BY c_nationkey ORDER BY x RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS n FROM (SELECT c_nationkey, c_acctbal::BIGINT AS x FROM (SELECT c_nationkey, floor(c_acctbal) AS c_acctbal FROM customer)))
  SELECT c_nationkey, arg_max(x, {'n': n, 'x': -x}) AS densest, max(n) AS n FROM c GROUP BY c_nationkey HAVING max(n) >= 2""")
def densest_column(t):
    return lay.densest(t("customer").select("c_nationkey", F.floor("c_acctbal").alias("x")), ["c_nationkey"], "x", 300)


@query("SELECT l_orderkey, arg_max(q, {'c': c, 'o': -o, 'v': -q}) AS best FROM (SELECT l_orderkey, q, count(*) AS c, min(l_linenumber) AS o FROM (SELECT l_orderkey, l_linenumber, floor(l_quantity / 5)::BIGINT AS q FROM lineitem) GROUP BY l_orderkey, q) GROUP BY l_orderkey")
def body_size_mode(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 5).alias("q"))
    return lay.mode_first_seen(rows, ["l_orderkey"], "q", "l_linenumber")


@query(f"SELECT user_id, median(d) AS step FROM (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS d FROM ({_EV})) WHERE d IS NOT NULL GROUP BY user_id")
def median_gap(t):
    return lay.median_step(_events(t), ["user_id"], ["us", "event_id"], "us")


_CHARS = "SELECT {k} AS id, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), '')) AS ch FROM {t}"


@query(f"""SELECT coalesce(a.id, b.id) AS id, coalesce(a.ch, b.ch) AS ch, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS extra
  FROM (SELECT id, ch, count(*) AS n FROM ({_CHARS.format(k='item_id', t='benchmark')}) WHERE ch <> '' GROUP BY ALL) a FULL JOIN (SELECT id, ch, count(*) AS n FROM ({_CHARS.format(k='doc_id', t='documents')}) WHERE ch <> '' GROUP BY ALL) b
  ON a.id = b.id AND a.ch = b.ch WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def bag_diff(t):
    chars = lambda df, k: df.select(F.col(k).alias("id"), F.explode(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z0-9]", "")), "")).alias("ch")).where("ch <> ''")
    return lay.bag_difference(chars(t("benchmark"), "item_id"), chars(t("documents"), "doc_id"), ["id"], "ch")


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))"


@query(f"""SELECT doc_id, item_id, count(*) AS common FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS w FROM documents) d JOIN (SELECT DISTINCT item_id, unnest({_WORDS}) AS w FROM benchmark) b USING (w) GROUP BY doc_id, item_id""")
def word_overlap(t):
    """Long words that documents and items share, all pairs that share any."""
    words = lambda name, key: t(name).select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).distinct()
    b = words("benchmark", "item_id")
    b = F.broadcast(b) if b.count() <= 1_000_000 else b
    return words("documents", "doc_id").join(b, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("common"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 60 + p_size WHEN 1 THEN p_size WHEN 2 THEN 90 ELSE 120 END::INT AS minutes, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 20 END::INT AS questions FROM part""")
def duration_parse(t):
    n = F.col("p_size").cast("string")
    k = F.col("p_size") % 4
    said = F.when(k == 0, F.concat(F.lit("Time: 1 hour and "), n, F.lit(" minutes"))).when(k == 1, F.concat(F.lit("Allowed: "), n, F.lit(" mins"))).when(k == 2, "1.5 hours").otherwise("Two hours")
    count = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("There are "), n, F.lit(" multiple-choice questions"))).otherwise("many questions, twenty questions")
    return t("part").select("p_partkey", tx.parse_duration(said).alias("minutes"), tx.parse_question_count(count).alias("questions"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '$' || p_size || '$' WHEN 1 THEN '$' || p_size || '!$' ELSE p_size || ' cm' END AS s FROM part""")
def numeric_as_maths(t):
    n, k = F.col("p_size").cast("string"), F.col("p_size") % 3
    return t("part").select("p_partkey", tx.numeric_as_maths(F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("!"))).otherwise(F.concat(n, F.lit(" cm")))).alias("s"))


def _issues(t):
    rows = t("documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 7 == 0, "\t").otherwise("")).alias("s"))
    return val.string_issues(rows, ["doc_id"], "s")


@query()
def issues_rules(t):
    """Every issue of every rule in whole texts, one row an occurrence; tested against brute force."""
    return _issues(t)


@query()
def report_summary(t):
    return val.summary(_issues(t), ["doc_id"])


@query()
def flag_join(t):
    """Documents with errors: the codes, and how many errors there are."""
    flags = _issues(t).where("level = 'error'").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ";").alias("reasons"), F.count("*").alias("n"))
    return t("documents").select("doc_id").join(flags, "doc_id")


@query("""SELECT page_id, list_reduce(list_prepend(0, list_transform(regexp_extract_all(html, '[{}]'), lambda x: CASE WHEN x = '{' THEN 1 ELSE -1 END)), lambda a, x: CASE WHEN a < 0 THEN a ELSE a + x END) <> 0 AS broken FROM pages""")
def brace_balance(t):
    return t("pages").select("page_id", tx.brace_problem(F.col("html")).alias("broken"))


@query()
def box_merge_closure(t):
    boxes = t("lineitem").select("l_orderkey", (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_quantity") * 10).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 40, "y1": F.col("y0") + 12})
    return lay.merge_boxes(boxes, ["l_orderkey"], 25.0)


@query("SELECT k AS paper_id, '$\\frac{' || k % 10 || '}{' || k % 7 + 1 || '}$' AS text FROM (SELECT DISTINCT n_nationkey AS k FROM nation)".replace("\\\\", "\\"))
def maths_rebuild(t):
    from foliospark.operators.mathbuild import rebuild

    k = t("nation").select(F.col("n_nationkey").alias("paper_id"))
    glyph = lambda gid, ch, base: F.struct(F.lit(gid).alias("gid"), ch.cast("string").alias("ch"), F.lit(base).alias("base"))
    both = k.select("paper_id", F.explode(F.array(glyph(0, F.col("paper_id") % 10, 100.0), glyph(1, F.col("paper_id") % 7 + 1, 114.0))).alias("g")).select("paper_id", F.lit(1).alias("question"), "g.*")
    glyphs = both.withColumns({"x0": F.lit(50.0), "x1": F.lit(56.0), "y0": F.col("base") - 7, "y1": F.col("base") + 2, "size": F.lit(10.0), "math_font": F.lit(False), "space_before": F.lit(False)})
    rules = k.select("paper_id", F.lit(1).alias("question"), F.lit(0).alias("rid"), F.lit(49.0).alias("x0"), F.lit(57.0).alias("x1"), F.lit(104.0).alias("y"))
    return rebuild(glyphs, rules).select("paper_id", "text")


@query("""WITH r AS (SELECT conv_id, turn, trim(text, ' ') <> '' AS has, regexp_matches(trim(text, ' '), '^\\(?A[).]?(\\s|$)') AS a FROM conversations),
  s AS (SELECT *, bool_or(a) OVER (PARTITION BY conv_id) AS some_, min(CASE WHEN has THEN turn END) OVER (PARTITION BY conv_id) AS first_ FROM r)
  SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS number, turn AS page FROM s WHERE (some_ AND a) OR (NOT some_ AND has AND turn > first_)""".replace("\\\\", "\\"))
def page_anchors(t):
    return lay.page_anchors(t("conversations").select("conv_id", F.col("turn").alias("page"), "text"), "conv_id")
