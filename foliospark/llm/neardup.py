"""MinHash near-dedup with tensored banding.

Two collections of ``GROUPS`` sub-keys, each of ``ROWS`` minhashes, are computed for a text. The
GROUPS**2 table keys are all pairs of one sub-key from either collection, so 2*GROUPS*ROWS minhashes
serve GROUPS**2 tables of 2*ROWS minhashes. Two texts with Jaccard similarity s share a table with
probability (1-(1-s**ROWS)**GROUPS)**2: 0.999 at s = 0.85, 0.995 at 0.8, 0.00005 at 0.1.

Texts with equal shingle sets form one class at the start and only its smallest id goes on. In each
table bucket every member is compared with one centre: the text whose sub-keys are the most common,
so in a group of copies as a rule the original. What then is not connected to its centre is compared
with the centre's other members exactly, in blocks of bounded size, by what each text lacks and adds
against the centre's shingle set. Members that are already connected are not compared with each
other, no pairs are emitted, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, stage, table
from .components import components
from .shingles import U, mix, shingle_sets

ROWS, GROUPS = 3, 8
_RNG = np.random.default_rng(77)
_MUL = _RNG.integers(1, 2**63, 2 * GROUPS * ROWS, dtype=np.uint64) * U(2) + U(1)
_ADD = _RNG.integers(1, 2**63, 2 * GROUPS * ROWS, dtype=np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function; long sets go in parts."""
    least = np.full(len(_MUL), U(2**64 - 1))
    for i in range(0, len(shingles), 8192):
        part = shingles[i : i + 8192]
        least = np.minimum(least, (part[None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return least


def sub_keys(shingles: np.ndarray) -> np.ndarray:
    """2*GROUPS sub-keys as signed numbers: the first half is one collection, the second the other."""
    rows = minhashes(shingles).reshape(2 * GROUPS, ROWS)
    total = np.arange(2 * GROUPS, dtype=np.uint64)
    for i in range(ROWS):
        total = mix(total * U(0x9E3779B97F4A7C15) + rows[:, i])
    return total.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, n_shingles, set_a, set_b, keys) of docs(id, text); set_* identify the set of shingles.

    A null or blank text has the empty set, null set_* and null keys.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                a.append(int(np.bitwise_xor.reduce(mix(s ^ U(1))).view(np.int64)) if len(s) else None)
                b.append(int(mix(s ^ U(2)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
                keys.append(sub_keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n_shingles", "set_a", "set_b", "keys"],
            )

    return docs.select("id", "text").mapInArrow(sign, "id long, n_shingles long, set_a long, set_b long, keys array<long>")


def buckets(spark: SparkSession, signed: DataFrame) -> DataFrame:
    """(key, id, weight) of the table buckets; weight is high for texts with common sub-keys.

    A sub-key that only one text has cannot be part of a shared table key, so those go first: most
    texts then form no table key at all.
    """
    subs = signed.select("id", F.posexplode("keys").alias("slot", "sub"))
    shared = subs.groupBy("slot", "sub").agg(F.count("*").alias("n")).where("n > 1")
    held = (
        subs.join(shared, ["slot", "sub"])
        .groupBy("id")
        .agg(
            F.collect_list(F.when(F.col("slot") < GROUPS, F.struct("slot", "sub"))).alias("first"),
            F.collect_list(F.when(F.col("slot") >= GROUPS, F.struct("slot", "sub"))).alias("second"),
            F.sum(F.log("n")).alias("weight"),
        )
        .where("size(first) > 0 and size(second) > 0")
    )
    noise = F.xxhash64("id").bitwiseAND(2**20 - 1) / float(2**30)  # parts equal weights
    keys = (
        held.select("id", (F.col("weight") + noise).alias("weight"), F.explode("first").alias("f"), "second")
        .select("id", "weight", "f", F.explode("second").alias("s"))
        .select(F.xxhash64("f.slot", "f.sub", "s.slot", "s.sub").alias("key"), "id", "weight")
    )
    return stage(spark, keys, "keys")


#: Members of a centre are compared in blocks of at most about so many rows a side.
BLOCK = 1024


def compared(spark: SparkSession, pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """For each (a, b, n) of pairs, by whole shingle sets: (a, b, linked, n_a, n_b, lacks, adds).

    n is the number of members of the centre b. linked: 100 * common >= percent * union. If n > 1:
    lacks holds a bit for each shingle of b that a has not, adds the shingles of a that b has not.
    Members are dealt into parts of about BLOCK; the text of a centre goes once to each part.
    """
    parts = F.ceil(F.col("n") / BLOCK)
    members = pairs.join(texts.select(F.col("id").alias("a"), "text").hint("merge"), "a").select("b", F.pmod(F.xxhash64("a"), parts).alias("part"), "a", (F.col("n") > 1).alias("many"), "text")
    centres = pairs.select("b", F.pmod(F.xxhash64("a"), parts).alias("part")).distinct()
    centres = centres.join(texts.select(F.col("id").alias("b"), "text").hint("merge"), "b")
    centres = centres.select("b", "part", F.lit(None).cast("long").alias("a"), F.lit(None).cast("boolean").alias("many"), "text")
    rows = members.unionByName(centres).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            ids, ids_b, many = batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(3).to_pylist()
            out: list[list] = [[], [], [], [], [], [], []]
            for i, mine in enumerate(shingle_sets(batch.column(4), k)):
                if ids[i] is None:  # the centre of the rows that follow
                    centre = mine
                    continue
                at = np.minimum(np.searchsorted(centre, mine), max(len(centre) - 1, 0))
                shared = centre[at] == mine if len(centre) else np.zeros(len(mine), bool)
                common = int(shared.sum())
                total = len(mine) + len(centre) - common
                lacks = adds = None
                if many[i]:
                    gone = np.ones(len(centre), bool)
                    gone[at[shared]] = False
                    lacks, adds = np.packbits(gone).tobytes(), mine[~shared].tobytes()
                for column, x in zip(out, (ids[i], ids_b[i], common > 0 and 100 * common >= percent * total, len(mine), len(centre), lacks, adds), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, out, kinds)], ["a", "b", "linked", "n_a", "n_b", "lacks", "adds"])

    return rows.mapInArrow(compare, "a long, b long, linked boolean, n_a long, n_b long, lacks binary, adds binary")


def joined(links: np.ndarray, comp_x: np.ndarray, comp_y: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (a boolean matrix) those (x, y) that connect components not yet connected here."""
    i, j = np.nonzero(links)
    if not len(i):
        return []
    _, first = np.unique(np.stack([comp_x[i], comp_y[j]]), axis=1, return_index=True)
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    found = []
    for n in first:
        p, q = root(int(comp_x[i[n]])), root(int(comp_y[j[n]]))
        if p != q:
            up[max(p, q)] = min(p, q)
            found.append((int(x[i[n]]), int(y[j[n]])))
    return found


def rest_links(spark: SparkSession, diffs: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a centre, one of which is not connected to the centre yet."""
    mine = comp.select(F.col("id").alias("a"), "comp")
    its = comp.select(F.col("id").alias("b"), F.col("comp").alias("comp_b"))
    rows = (
        diffs.where("lacks is not null")
        .join(mine, "a", "left")
        .join(its, "b", "left")
        .select("b", "a", "n_a", "n_b", "lacks", "adds", F.coalesce("comp", "a").alias("comp"), (F.coalesce("comp", "a") != F.coalesce("comp_b", "b")).alias("out"))
    )
    rows = stage(spark, rows, "rest")
    sizes = (
        rows.groupBy("b").agg(F.count("*").alias("n"), F.count_if("out").alias("n_out")).where("n_out > 0 and n > 1")
        .select("b", F.ceil(F.col("n") / BLOCK).alias("parts"), F.ceil(F.col("n_out") / BLOCK).alias("out_parts"))
    )
    sizes = stage(spark, sizes, "sizes")
    held = rows.join(broadcast_if_small(sizes, sizes.count()), "b")
    all_ = held.withColumns({"j": F.pmod(F.xxhash64("a"), "parts"), "i": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("out_parts") - 1)), "side": F.lit(False)})
    outs = held.where("out").withColumns({"i": F.pmod(F.xxhash64("a"), "out_parts"), "j": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)), "side": F.lit(True)})
    columns = ["b", "i", "j", "side", "a", "comp", "n_a", "n_b", "lacks", "adds"]

    def block(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        ids, comps, n = (t[c].to_numpy() for c in ("a", "comp", "n_a"))
        size = t["n_b"][0].as_py()
        lacks = np.stack([np.frombuffer(x, np.uint8) for x in t["lacks"].to_pylist()])
        adds = [np.frombuffer(x, np.uint64) for x in t["adds"].to_pylist()]
        x, y = np.flatnonzero(side), np.flatnonzero(~side)
        common = np.zeros((len(x), len(y)), np.float32)
        for s in range(0, lacks.shape[1], 512):  # some columns at a time, for long texts
            has = 1 - np.unpackbits(lacks[:, s : s + 512], axis=1, count=min(4096, size - 8 * s)).astype(np.float32)
            common += has[x] @ has[y].T
        owner = np.repeat(np.arange(len(adds)), [len(v) for v in adds])
        values, code, times = np.unique(np.concatenate(adds), return_inverse=True, return_counts=True)
        owner, code = owner[times[code] > 1], code[times[code] > 1]
        order = np.argsort(code, kind="stable")
        at = np.full(len(ids), -1)
        at[x], at[y] = np.arange(len(x)), np.arange(len(y))
        for who in np.split(owner[order], np.flatnonzero(np.diff(code[order])) + 1):
            common[np.ix_(at[who[side[who]]], at[who[~side[who]]])] += 1
        links = (100 * common >= percent * (n[x][:, None] + n[y][None, :] - common)) & (comps[x][:, None] != comps[y][None, :])
        found = joined(links, comps[x], comps[y], ids[x], ids[y])
        return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})

    # without it, a join by b leaves all blocks of a centre in one task, as rows are then clustered by b, i, j too
    dealt = outs.select(columns).unionByName(all_.select(columns)).repartition("b", "i", "j")
    return dealt.groupBy("b", "i", "j").applyInArrow(block, "a long, b long")


def classes(spark: SparkSession, docs: DataFrame, k: int, percent: int, more: DataFrame | None = None) -> DataFrame:
    """(id, n_shingles, comp) for each row of docs(id, text), ids neither null nor repeated.

    comp is the smallest id reachable over links and the links more(a, b), the id itself where there is
    none. An empty set is linked with nothing.
    """
    small_batches(spark)
    signed = stage(spark, signatures(docs, k), "signatures")
    sets = signed.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    sets = stage(spark, sets, "sets")
    same = signed.join(sets.where("n > 1"), ["set_a", "set_b", "n_shingles"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    same = stage(spark, same, "same")
    reps = signed.join(sets.select("set_a", "set_b", "n_shingles", F.col("rep").alias("id")), ["set_a", "set_b", "n_shingles", "id"], "left_semi")
    members = buckets(spark, reps)
    centres = members.groupBy("key").agg(F.max_by("id", "weight").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    pairs = members.join(centres, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    pairs = stage(spark, pairs, "pairs")
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    pairs = stage(spark, pairs.join(counts, "b"), "members")
    ids = stage(spark, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    texts = docs.select("id", "text").join(broadcast_if_small(ids, ids.count()), "id", "left_semi")
    diffs = stage(spark, compared(spark, pairs, texts, k, percent), "diffs")
    links = diffs.where("linked").select("a", "b")
    near = components(spark, links)
    rest = stage(spark, rest_links(spark, diffs, near, percent), "rest-links")
    whole = components(spark, near.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(rest).unionByName(same if more is None else same.unionByName(more)))
    return signed.select("id", "n_shingles").join(whole, "id", "left").select("id", "n_shingles", F.coalesce("comp", "id").alias("comp"))


def near_duplicates(
    spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of docs: id_col, n_shingles, component_id, kept.

    Defined results: a null or blank text has 0 shingles and is linked with nothing; a null id gives
    null component_id and kept true, and such rows take part in no link; a repeated id gives one row
    per input row, and its texts, if they differ, are one document with the links of all; an empty
    table gives an empty table; other columns are ignored, whatever their names. kept is true for the
    smallest id of each component.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = rows.where("id is not null")
    hash_ = F.xxhash64(F.coalesce("text", F.lit("")))
    seen = stage(spark, known.groupBy("id").agg(F.count("*").alias("n"), F.min(hash_).alias("least")).where("n > 1").select("id", "least"), "repeated")
    n_seen = seen.count()
    if not n_seen:
        found = classes(spark, known, k, percent)
    else:  # each text of an id is a node: the first has the id, others numbers above all ids, and links to it
        other = F.xxhash64("id", "text").bitwiseAND(2**62 - 1).bitwiseOR(2**62)
        tagged = known.join(broadcast_if_small(seen, n_seen), "id", "left")
        tagged = tagged.withColumn("node", F.when(F.col("least").isNull() | (hash_ == F.col("least")), F.col("id")).otherwise(other))
        twice = tagged.where("least is not null").groupBy("node").agg(F.min("text").alias("text"))
        nodes = stage(spark, tagged.where("least is null").select("node", "text").unionByName(twice), "nodes").withColumnRenamed("node", "id")
        own = stage(spark, tagged.select("id", "node"), "own")
        more = own.where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b")).distinct()
        found = own.join(classes(spark, nodes, k, percent, more).withColumnRenamed("id", "node"), "node").select("id", "n_shingles", "comp")
    lost = signatures(rows.where("id is null"), k).select("id", "n_shingles", F.lit(None).cast("long").alias("comp"))
    return found.unionByName(lost).select(
        F.col("id").alias(id_col), "n_shingles", F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept")
    )


def deduplicated(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one document of each group, the one with the smallest id, and one row of
    it; of rows with a null id, one for each text. All columns as they are."""
    gone = near_duplicates(spark, docs, k, percent, id_col, text_col).where("not kept").select(id_col).distinct()
    gone = stage(spark, gone, "gone")
    left = docs.join(broadcast_if_small(gone, gone.count()), id_col, "left_anti").select(*docs.columns)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = left.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), F.md5(text)).alias("own"), F.xxhash64(text).alias("h"))
    twice = stage(spark, keyed.groupBy("id", "own").count().where("count > 1").select(F.col("id").alias("id_"), F.col("own").alias("own_")), "repeated")
    n = twice.count()
    if not n:
        return left
    same = F.col("id").eqNullSafe(F.col("id_")) & F.col("own").eqNullSafe(F.col("own_"))
    twice = broadcast_if_small(twice, n)
    ones = keyed.join(twice, same, "left_semi").groupBy("id", "own").agg(F.min_by("row", "h").alias("row"))
    return keyed.join(twice, same, "left_anti").select("row").unionByName(ones.select("row")).select("row.*")


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), k=3, percent=85)
