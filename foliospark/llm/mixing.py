"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated ``repeats`` times; long documents
are served in packets of ``PACKET`` words, so that none holds up its source for long. The virtual
finish time of a packet is the cumulative size of its source up to its end over the source's target.
The mix is all packets in order of finish time, cut where the total budget is spent; what a document
gives to the mix are its packets before the cut.

No source and no order needs one task. Within a source, cumulative sizes come from sums over hash
ranges and running sums within a range. For the global order, packets are dealt into ranges of virtual
time, in which all sources progress evenly, so that ranges hold about equally many words: sums by
range show the one in which the budget ends, and only that range is sorted packet by packet.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, stage, table

WEIGHTS, PERCENT, REPEATS = (3, 1, 2), 150, 2
#: Words of a packet.
PACKET = 512
#: About so many rows of a source are summed in order in one task, while 65,536 ranges a source suffice.
RANGE_ROWS = 2_000
#: About so many words are in a range of virtual time, while MOST_RANGES suffice.
RANGE_WORDS, MOST_RANGES, GROUP = 20_000, 1 << 20, 1024


class Cut(NamedTuple):
    """Where the budget ends: in the packet of source that ends at position, after fit of its words."""

    finish: float
    source: str | None
    position: int
    fit: int


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple, percent: int, repeats: int) -> DataFrame:
    """(source, source_size, target, n) from sizes(source, size): one row per source.

    Sources in code point order, null last, have the weights in turn. They share percent % of all
    sizes by weight; no target is above repeats times its source's size, and what is above is shared
    again by weight, in rounds, until none is. Ranks come from a range partitioning and its counts.
    """
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by = stage(spark, by.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r[0]: r[1] for r in by.groupBy("part").count().collect()}  # one number per partition
    ahead = {p: sum(n for q, n in counts.items() if q < p) for p in counts}
    first = F.create_map(*[F.lit(x).cast("long") for p in sorted(ahead) for x in (p, ahead[p])]) if ahead else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.element_at(first, F.col("part").cast("long"))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    by = stage(spark, by.withColumn("cap", (F.col("source_size") * repeats).cast("double")).drop("part"), "weights")
    total, all_weight = by.agg(F.sum("source_size") * (percent / 100), F.sum("weight")).first()
    total, all_weight, full_cap, full_weight = total or 0.0, all_weight or 0.0, 0.0, 0.0
    while True:  # each round adds sources at their cap; what is left per unit of weight only grows
        full = F.lit(total - full_cap) * F.col("weight") >= F.col("cap") * F.lit(all_weight - full_weight)
        found = tuple(x or 0.0 for x in by.where(full).agg(F.sum("cap"), F.sum("weight")).first())
        if found == (full_cap, full_weight):
            break
        full_cap, full_weight = found
    share = F.lit(total - full_cap) * F.col("weight") / F.lit(all_weight - full_weight)
    return by.select("source", "source_size", F.when(full, F.col("cap")).otherwise(share).alias("target"), "n")


def _slotted(docs: DataFrame, by: DataFrame) -> DataFrame:
    """docs with source_size, target, n, key and slot, the hash range of its source."""
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    ranges = F.least(F.lit(65536), F.ceil(F.col("n") / RANGE_ROWS))
    slot = F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * ranges / 65536)
    rows = docs.withColumn("key", key).join(by.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return rows.withColumn("slot", slot)


def _placed(docs: DataFrame, by: DataFrame, sums: DataFrame) -> DataFrame:
    """docs with source_size, target and before, the size of the source's documents ahead."""
    inside = Window.partitionBy("source", "slot").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = _slotted(docs, by).withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("t")))
    return rows.withColumn("before", F.col("inside") + F.col("ahead")).drop("key", "slot", "inside", "ahead", "s", "t", "n")


def _packets(placed: DataFrame, repeats: int) -> DataFrame:
    """(source, finish, position, amount) of every packet of every copy."""
    rows = placed.where("size > 0").withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    rows = rows.withColumn("end", F.explode(F.expr(f"sequence({PACKET}L, cast(ceil(size / {PACKET}) as bigint) * {PACKET}L, {PACKET}L)")))
    rows = rows.withColumn("position", F.col("before") + F.col("copy") * F.col("source_size") + F.least("end", "size"))
    amount = F.least("end", "size") - F.col("end") + PACKET
    return rows.select("source", (F.col("position") / F.col("target")).alias("finish"), "position", amount.alias("amount"))


def _first_over(sums: DataFrame, budget: int, before: int) -> tuple[int, int] | None:
    """Of sums(range, amount) the range in which the running sum from before on reaches the budget, and the sum ahead of it."""
    for at, amount in sorted((r[0], r[1]) for r in sums.collect()):
        if before + amount >= budget:
            return at, before
        before += amount
    return None


def _cut(placed: DataFrame, budget: int, repeats: int) -> Cut | None:
    """The cut of the packets of placed in order of finish time, source and position. Three steps:
    sums of groups of ranges, of the ranges in one group, and the packets in one range. At most 4,096
    and 1,024 sums and one row come to the driver, whatever the size."""
    ranges = max(1, min(MOST_RANGES, -(-budget // RANGE_WORDS)))
    slot = F.least(F.floor(F.col("finish") * ranges), F.lit(4 * ranges - 1)).cast("long")
    rows = _packets(placed, repeats).withColumn("range", slot)
    group = _first_over(rows.groupBy((F.col("range") / GROUP).cast("long")).agg(F.sum("amount")), budget, 0)
    if group is None:
        return None
    rows = rows.where((F.col("range") >= group[0] * GROUP) & (F.col("range") < (group[0] + 1) * GROUP))
    one = _first_over(rows.groupBy("range").agg(F.sum("amount")), budget, group[1])
    if one is None:
        return None
    order = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "position")
    rows = rows.where(F.col("range") == one[0]).withColumn("end", F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, 0)) + one[1])
    row = rows.where((F.col("end") >= budget) & (F.col("end") - F.col("amount") < budget)).first()
    return Cut(row.finish, row.source, row.position, budget - row.end + row.amount) if row else None


def _words_before(cut: Cut | None, copy: Column) -> Column:
    """The words of a placed document's copy that are before the cut."""
    if cut is None:  # nothing is to be had, or nothing is asked for
        return F.lit(0).cast("long")
    size, base = F.col("size"), F.col("before") + copy * F.col("source_size")
    same = F.col("source").eqNullSafe(F.lit(cut.source).cast("string"))
    ahead = F.col("source").isNotNull() if cut.source is None else F.coalesce(F.col("source") < cut.source, F.lit(False))

    def passed(end: Column) -> Column:
        finish = (base + end) / F.col("target")
        return (finish < cut.finish) | ((finish == cut.finish) & (ahead | (same & (base + end < cut.position))))

    ends = F.expr(f"sequence(1L, cast(ceil(size / {PACKET}) as bigint))")
    whole = F.when(passed(size), size).when(~passed(F.least(size, F.lit(PACKET))), F.lit(0)).otherwise(F.size(F.filter(ends, lambda j: passed(F.least(j * PACKET, size)))) * PACKET)
    part = F.when(same & (base < cut.position) & (base + size >= cut.position), cut.fit).otherwise(0)
    return F.when(size > 0, whole + part).otherwise(0).cast("long")


def _queued(docs: DataFrame, narrow: DataFrame, weights: tuple, percent: int, repeats: int) -> tuple[DataFrame, Cut | None]:
    """docs placed, and the cut, which is found on narrow(id, source, size), the same rows."""
    spark = docs.sparkSession
    by = stage(spark, targets(narrow, weights, percent, repeats), "targets")
    total, n = by.agg(F.sum("source_size"), F.count("*")).first()
    by = broadcast_if_small(by, n)
    sums = _slotted(narrow, by).groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    ahead = F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot")) - F.col("slot_size")
    sums = stage(spark, sums.select(F.col("source").alias("s"), F.col("slot").alias("t"), ahead.alias("ahead")), "ahead")
    sums = broadcast_if_small(sums, sums.count())
    budget = min((total or 0) * percent // 100, (total or 0) * repeats)
    places = stage(spark, _placed(narrow, by, sums), "places")
    return places if docs is narrow else _placed(docs, by, sums), _cut(places, budget, repeats) if budget else None


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS) -> DataFrame:
    """docs(id, source, size) with source_size, target, before and taken, the words that the mix takes.

    before is the size of the source's documents ahead in shuffled order. The order is that of the
    md5 of the id as text, then id and size, so that reruns agree. A null id counts as an empty text;
    a null source is a source; documents of size 0 take nothing; an empty table gives an empty one.
    The packets taken add up to percent % of all sizes, rounded down (to all copies, if those are
    less); each source's are within one packet of its target for each source there is.
    """
    docs = stage(docs.sparkSession, docs.select("id", F.col("source").cast("string").alias("source"), "size"), "sizes")
    placed, cut = _queued(docs, docs, weights, percent, repeats)
    parts = [_words_before(cut, F.lit(i)) for i in range(repeats)]
    return placed.withColumn("taken", sum(parts[1:], parts[0]))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: rows of docs in order of finish time, repeats as rows, documents in service at the
    cut without the words behind it; same columns, n_chars made to fit. Empty texts are not taken."""
    names = docs.columns
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    narrow = stage(docs.sparkSession, narrow, "sizes")
    whole = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    placed, cut = _queued(whole, narrow, weights, percent, repeats)
    takes = F.filter(F.array(*[F.struct(F.lit(i).alias("copy"), _words_before(cut, F.lit(i)).alias("take")) for i in range(repeats)]), lambda c: c["take"] > 0)
    copies = placed.withColumn("c", F.explode(takes)).withColumn("take", F.col("c.take"))
    copies = copies.withColumn("finish", (F.col("before") + F.col("c.copy") * F.col("source_size") + F.col("take")) / F.col("target"))
    words = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    start = F.array_join(F.slice(words, 1, F.col("take").cast("int")), "")
    text = F.when(F.col("take") < F.col("size"), start).otherwise(F.col(f"row.{text_col}"))
    copies = copies.repartitionByRange("finish", "source").sortWithinPartitions("finish", "source").withColumn("cut", text)
    return copies.select(*[F.col("cut").alias(c) if c == text_col else F.length("cut").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in names])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    return mixed(rows).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
        (source_size * 2)::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total FROM s),
o AS (SELECT *, sum(weight) OVER () AS all_weight,
        coalesce(sum(cap) OVER p, 0.0::DOUBLE) AS spent, coalesce(sum(weight) OVER p, 0.0::DOUBLE) AS used FROM w
      WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - spent) * weight >= cap * (all_weight - used) AS full_ FROM o),
g AS (SELECT *, coalesce(sum(cap) FILTER (full_) OVER (), 0.0::DOUBLE) AS full_cap, coalesce(sum(weight) FILTER (full_) OVER (), 0.0::DOUBLE) AS full_weight FROM f),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE (total - full_cap) * weight / (all_weight - full_weight) END AS target FROM g),
r AS (SELECT d.rn, d.doc_id, d.source, d.size, t.source_size, t.target,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT r.*, copy, unnest(range(512, (size + 511) // 512 * 512 + 1, 512)) AS stop FROM r, range(2) AS k(copy) WHERE size > 0),
p AS (SELECT rn, source, least(stop, size) - stop + 512 AS amount, ahead + copy * source_size + least(stop, size) AS position, position / target AS finish FROM c),
q AS (SELECT rn, amount, (sum(amount) OVER (ORDER BY finish, source NULLS LAST, position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - amount AS served FROM p),
x AS (SELECT rn, sum(greatest(0, least(amount, (SELECT least(sum(size) * 150 // 100, sum(size) * 2)::BIGINT FROM d) - served)))::BIGINT AS taken FROM q GROUP BY rn)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM r LEFT JOIN x USING (rn)
"""
