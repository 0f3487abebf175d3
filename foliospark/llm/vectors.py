"""Embedding near-dedup by lattice hashing.

A table hashes a vector, scaled to length one, by random projections to blocks of eight dimensions,
each decoded to the nearest point of the E8 lattice; the points of all blocks are a cell. In each table
a vector lives in its own cell and visits the nearest other. Of vectors that meet in a cell, those whose
sketches (sides of random planes) are near are compared in double precision, in blocks of bounded size.

The number of lattice blocks of a cell, and of tables, grows with the number of vectors, so that a vector
meets about SKETCHED unrelated sketches at most and is compared to CANDIDATES at most, whatever the number: 3
blocks and 22 tables up to 24 million vectors, 4 and 45 up to 900 million (PLANS). At cosine 0.95, the hardest
case, a pair is met with probability 0.9995 or so; closer ones more surely. Sketches lose one such pair in ten
million.

Visits are narrow rows, shuffled once, some tables at a time so that they need little disk. The cells of a vector are computed once and come with it. Equal vectors are
one class with a weight, and are not compared. A pair that meets in several cells counts where it meets
first. No links are emitted: each block gives counts by vector, and the links of a spanning forest.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage, table
from .components import components

COSINE, SCALE = 0.95, 3.2
#: By lattice blocks of a cell: tables, the share of unrelated pairs that meet in any of them, and the share of these
#: whose sketches are near (measured on 64 dimensions). What follows the last has 1.9 times the tables and a 55th of
#: the share of the one before.
PLANS = {3: (22, 4.1e-4, 3e-4), 4: (45, 7.7e-6, 1.4e-3)}
#: Unrelated vectors to which a vector may be compared, and those whose sketches it may meet.
CANDIDATES, SKETCHED = 10, 10_000
#: Bits of a sketch.
BITS = 128
#: Cells of more rows than this are compared without a look at the sketches.
SKETCHED_CELL = 1 << 13
#: Visits that are shuffled at once, and tables at least.
VISITS, TABLES = 10_000_000, 4
#: Rows of visits that are looked at together.
ROWS = 1 << 18
#: Rows a side of a block of comparisons, as each row comes once for each block, and rows of it that are compared at once.
BLOCK, STRIP = 4096, 512
#: Rows of small cells that share a block.
SHARED = 512
#: The setting of the rows that go to Python at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


ROOTS = _roots()


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of D8 and their squared distances, by column of x (8 rows)."""
    point = np.rint(x)
    rest = x - point
    away = (rest**2).sum(axis=0)
    odd = np.flatnonzero(point.sum(axis=0) % 2 != 0)
    part = rest[:, odd]
    worst = np.abs(part).argmax(axis=0)
    at = part[worst, np.arange(len(odd))]
    point[worst, odd] += np.where(at >= 0, 1, -1).astype(x.dtype)
    away[odd] += 1 - 2 * np.abs(at)
    return point, away


def _nearest(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, by column of x (8 rows)."""
    (a, da), (b, db) = _d8(x), _d8(x - x.dtype.type(0.5))
    return np.where(da <= db, a, b + x.dtype.type(0.5))


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 for each row of eight numbers."""
    return _nearest(x.T).T


def _step(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The root nearest to each column of rest (8 rows), doubled, and its inner product with that column."""
    size, sign = np.abs(rest), np.where(rest < 0, -1, 1).astype(np.int64)
    every, n = np.arange(rest.shape[1]), rest.shape[1]
    first = size.argmax(axis=0)
    without = size.copy()
    without[first, every] = -1
    second, least = without.argmax(axis=0), size.argmin(axis=0)
    two = size[first, every] + size[second, every]  # two entries of +-1
    odd = sign.prod(axis=0) < 0
    eight = (size.sum(axis=0) - np.where(odd, 2 * size[least, every], 0)) / 2  # eight of +-1/2, an even number of them below 0
    halves = sign.copy()
    halves[least, every] *= np.where(odd, -1, 1)
    ones = np.zeros((8, n), np.int64)
    ones[first, every], ones[second, every] = 2 * sign[first, every], 2 * sign[second, every]
    return np.where(two >= eight, ones, halves), np.maximum(two, eight)


def plan(n: int) -> tuple[int, int]:
    """(lattice blocks, tables) for n vectors: the fewest blocks with few enough sketches and candidates."""
    blocks, last = min(PLANS), max(PLANS)
    while True:
        tables, share, near = PLANS[min(blocks, last)]
        over = max(0, blocks - last)
        met = n * share / 55**over
        if met <= SKETCHED and met * near <= CANDIDATES:
            return blocks, int(np.ceil(tables * 1.9**over))
        blocks += 1


@functools.lru_cache(maxsize=8)
def _projections(dim: int, blocks: int, tables: int) -> np.ndarray:
    """One projection for each table, parts of random rotations; of short vectors random numbers: a row for each
    coordinate of eight, table and block, in this order."""
    rng, width = np.random.default_rng(8), 8 * blocks
    if dim < width:
        found = rng.normal(size=(tables, dim, width)) / np.sqrt(dim)
    else:
        each = dim // width
        turns = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : each * width] for _ in range(-(-tables // each))]
        found = np.stack([turns[t // each][:, t % each * width :][:, :width] for t in range(tables)])
    return np.ascontiguousarray(found.reshape(tables, dim, blocks, 8).transpose(3, 0, 2, 1).reshape(-1, dim), np.float32)


def _mixed(code: np.ndarray) -> np.ndarray:
    """32 bits of 64-bit numbers."""
    code = (code ^ (code >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(32)).astype(np.uint32)


def cells(unit: np.ndarray, blocks: int, tables: int) -> np.ndarray:
    """For each unit vector and table the cell it lives in and the nearest other: uint32[n, tables, 2]."""
    n, dim = unit.shape
    take, width = _projections(dim, blocks, tables), tables * blocks
    x = (take * np.float32(SCALE * np.sqrt(dim / 64))) @ unit.astype(np.float32).T
    x = x.reshape(8, width * n)
    point = _nearest(x)
    root, toward = _step(x - point)
    key = np.random.default_rng(88).integers(1 << 63, size=(8, blocks), dtype=np.int64) * 2 + 1
    by_block = lambda p: (p.reshape(8, tables, blocks, n) * key[:, None, :, None]).sum(axis=0)
    own = by_block(np.rint(2 * point).astype(np.int64)).sum(axis=1)
    best = toward.reshape(tables, blocks, n).argmax(axis=1)[:, None]  # the block in which another point is least far
    near = own + np.take_along_axis(by_block(root), best, axis=1)[:, 0]
    out = _mixed(np.stack([own, near], axis=-1).view(np.uint64))
    out[..., 1] ^= out[..., 0] == out[..., 1]  # two cells, also where their numbers clash
    return out.transpose(1, 0, 2)


@functools.lru_cache(maxsize=8)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(64).normal(size=(dim, BITS))


def sketches(unit: np.ndarray) -> np.ndarray:
    """The sides of random planes on which each vector lies, as the bits of two numbers: uint64[n, 2]."""
    return np.packbits(unit @ _planes(unit.shape[1]) >= 0, axis=1).view(np.uint64)


def most_bits(cosine: float) -> int:
    """Bits in which two sketches of vectors with this cosine differ at most, but for one pair in ten million."""
    p, tail = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, 1.0
    for k in range(BITS):
        tail -= math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
        if tail < 1e-7:
            return k
    return BITS


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_in_cell(place: np.ndarray, mine: np.ndarray, sketch: np.ndarray, most: int) -> np.ndarray:
    """Of rows sorted by place (a cell) those that have a row beside them whose sketch differs in most bits at most;
    one of the two lives there. mine: twice the id, and 1 more for a vector that lives there."""
    keep, at, far = np.zeros(len(place), bool), np.arange(len(place)), 0
    while len(at):
        far += 1
        at = at[: np.searchsorted(at, len(place) - far)]
        at = at[place[at] == place[at + far]]
        a, b = at[(mine[at] | mine[at + far]) & 1 == 1], far
        near = np.bitwise_count(sketch[a] ^ sketch[a + b]).sum(axis=1, dtype=np.int64) <= most
        keep[a[near]] = keep[a[near] + b] = True
    return keep


def first_meetings(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, t: int, less: np.ndarray) -> np.ndarray:
    """Which of the linked pairs of guest i and host j of a cell of table t, with cells a[i] and b[j], meet nowhere
    before: in no earlier table, nor in this one by the visit of the vector with the smaller id (less: the guest
    has it) when it is the other that visits here."""
    at = np.arange(len(i))
    for s in range(t):
        x, y = a[i[at], s], b[j[at], s]
        at = at[(x[:, 0] != y[:, 0]) & (x[:, 0] != y[:, 1]) & (x[:, 1] != y[:, 0])]
    x, y = a[i[at], t], b[j[at], t]
    return at[less[at] | ((x[:, 0] != y[:, 0]) & (x[:, 0] != y[:, 1]))]


def _meeting(batches: Iterator[pa.RecordBatch], most: int, block: int) -> Iterator[pa.RecordBatch]:
    """From visits (place, mine, s0, s1) sorted by place the vectors that must be compared, with what deals them:
    small cells share a block, large ones are cut into parts."""

    def held(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        place, mine, *sketch = (np.concatenate(c) for c in zip(*rows, strict=True))
        sketch = np.stack(sketch, axis=1).view(np.uint64)

        def several() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
            n = np.diff(np.r_[start, len(place)])
            own = np.add.reduceat(mine & 1, start) if len(place) else n
            return (n > 1) & (own > 0), n, own

        use, n, _ = several()
        place, mine, sketch, n = (x[np.repeat(use, n)] for x in (place, mine, sketch, np.repeat(n, n)))
        small = n <= SKETCHED_CELL
        keep = ~small
        keep[small] = near_in_cell(place[small], mine[small], sketch[small], most)
        place, mine = place[keep], mine[keep]
        use, n, own = several()  # only the numbers: what is left has a pair in each cell
        parts, own_parts = (np.repeat(-(-x // block), n) for x in (n, own))
        cell, tiny = place.copy(), np.repeat(n <= min(SHARED, block // 4), n)
        if tiny.any():  # as many cells of a table as fill a part of a block
            few = n[n <= min(SHARED, block // 4)]
            first, share = np.repeat(np.cumsum(few) - few, few) // max(1, min(SHARED, block // 2)), place[tiny]
            new = np.r_[True, (first[1:] != first[:-1]) | (share[1:] >> 32 != share[:-1] >> 32)]
            cell[tiny] = share[new][np.cumsum(new) - 1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, place, mine, parts, own_parts)], ["shared", "place", "mine", "parts", "own_parts"])

    rows: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        new = [batch.column(c).to_numpy() for c in range(4)]
        if not len(new[0]):
            continue
        end = int(np.searchsorted(new[0], new[0][-1]))  # its last cell may go on
        if count >= ROWS and (end or rows[-1][0][-1] != new[0][0]):
            yield held([*rows, [x[:end] for x in new]])
            rows, count, new = [], 0, [x[end:] for x in new]
        rows.append(new)
        count += len(new[0])
    if rows:
        yield held(rows)


def links(spark: SparkSession, classes: DataFrame, n: int, cosine: float = COSINE) -> DataFrame:
    """(id, n, other) from the n rows of classes(id, v, weight): rows to be summed, n being links of id to
    vectors of other classes, and links (id, other) that connect all that is linked. Vectors of different
    lengths never meet."""
    (blocks, tables), most, side = plan(n), most_bits(cosine), BLOCK
    at_once = max(TABLES, VISITS // (2 * max(1, n)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                part = batch.filter(pa.array(size == dim))
                unit = _unit(_matrix(part.column(1), dim))
                got, sketch = cells(unit, blocks, tables), sketches(unit).view(np.int64)
                every = pa.ListArray.from_arrays(np.arange(len(unit) + 1, dtype=np.int32) * (2 * tables), got.reshape(-1).view(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(unit), dim, np.int32)), every, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["id", "dim", "cells", "s0", "s1"])

    codes = stage(spark, classes.select("id", "v").mapInArrow(hashed, "id long, dim int, cells array<int>, s0 long, s1 long"), "cells")

    def meeting(first: int) -> DataFrame:  # a place: dim from bit 40, t from bit 32, the cell's number below
        some = F.slice("cells", 2 * first + 1, 2 * min(at_once, tables - first))
        visits = codes.select("id", "dim", "s0", "s1", F.posexplode(some).alias("p", "c")).select(
            F.expr(f"shiftleft(cast(dim as bigint), 40) | shiftleft(cast(shiftright(p, 1) + {first} as bigint), 32) | (cast(c as bigint) & 4294967295)").alias("place"),
            F.expr("2 * id + 1 - (p & 1)").alias("mine"), "s0", "s1",
        )
        return visits.repartition("place").sortWithinPartitions("place").mapInArrow(
            lambda batches: _meeting(batches, most, side), "shared long, place long, mine long, parts long, own_parts long"
        )

    spark.conf.set(BATCH, 1 << 14)  # narrow rows
    passes = [stage(spark, meeting(first), "held") for first in range(0, tables, at_once)]
    spark.conf.set(BATCH, 1 << 10)
    ids = stage(spark, functools.reduce(DataFrame.unionByName, passes).select(F.expr("shiftright(mine, 1)").alias("id")).distinct(), "ids")
    few = broadcast_if_small(ids, ids.count())
    wanted = classes.select("id", "v", "weight").join(few, "id", "left_semi").join(codes.select("id", "cells").join(few, "id", "left_semi"), "id")
    wanted = stage(spark, wanted, "wanted")

    block_key = ["dim", "t", "cell", "i", "j"]
    one, one_block = F.lit(0).cast("bigint"), (F.col("parts") == 1) & (F.col("own_parts") == 1)

    def dealt(held: DataFrame) -> DataFrame:
        held = held.select(
            F.expr("cast(shiftright(place, 40) as int)").alias("dim"), F.expr("cast(shiftright(place, 32) & 255 as int)").alias("t"), F.expr("shared & 4294967295").alias("cell"),
            F.col("place").alias("sub"), F.expr("shiftright(mine, 1)").alias("id"), F.expr("mine & 1 = 1").alias("own"), "parts", "own_parts",
        )
        guests = held.withColumns({"i": F.pmod(F.xxhash64("id"), "parts"), "j": F.explode(F.sequence(one, F.col("own_parts") - 1)), "guest": F.lit(True), "host": F.col("own") & one_block})
        hosts = held.where(F.col("own") & ~one_block).withColumns({"j": F.pmod(F.xxhash64("id"), "own_parts"), "i": F.explode(F.sequence(one, F.col("parts") - 1)), "guest": F.lit(False), "host": F.lit(True)})
        both = guests.select(*block_key, "sub", "guest", "host", "id").unionByName(hosts.select(*block_key, "sub", "guest", "host", "id"))
        return both.join(wanted, "id").repartition(*block_key)

    def block(rows: pa.Table) -> pa.Table:
        guest, host, ids, sub, weight = (rows[c].to_numpy() for c in ("guest", "host", "id", "sub", "weight"))
        unit = _unit(_matrix(rows["v"].combine_chunks(), rows["dim"][0].as_py()))
        got = rows["cells"].combine_chunks().flatten().to_numpy().reshape(len(ids), tables, 2)
        guests, hosts, t = np.flatnonzero(guest), np.flatnonzero(host), rows["t"][0].as_py()
        counts, forest = np.zeros(len(ids), np.int64), []
        for k in range(0, len(guests), STRIP):
            x = guests[k : k + STRIP]
            i, j = np.nonzero((unit[x] @ unit[hosts].T >= cosine) & (sub[x][:, None] == sub[hosts]) & (ids[x][:, None] != ids[hosts]))
            x, y = x[i], hosts[j]
            first = first_meetings(x, y, got, got, t, ids[x] < ids[y])
            x, y = x[first], y[first]
            counts += np.bincount(x, weight[y], len(ids)).astype(np.int64) + np.bincount(y, weight[x], len(ids)).astype(np.int64)
            forest += _forest(ids[x], ids[y])
        if len(guests) > STRIP:
            forest = _forest(*np.array(forest, np.int64).reshape(-1, 2).T)
        has = np.flatnonzero(counts)
        return pa.table({
            "id": pa.array([*ids[has].tolist(), *(p for p, _ in forest)], pa.int64()),
            "n": pa.array([*counts[has].tolist(), *(0 for _ in forest)], pa.int64()),
            "other": pa.array([*([None] * len(has)), *(q for _, q in forest)], pa.int64()),
        })

    found = [dealt(held).groupBy(block_key).applyInArrow(block, "id long, n long, other long") for held in passes]
    return found[0] if len(found) == 1 else functools.reduce(DataFrame.unionByName, [stage(spark, one_pass, "links") for one_pass in found])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links a-b those of a spanning forest."""
    if not len(a):
        return []
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(ids[i]), int(ids[label[i]])) for i in range(len(ids)) if label[i] != i]


@contextlib.contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the table that needs them is written, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _number(column: str) -> Column:
    return F.xxhash64(column)


def near_vectors(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of rows.

    Vectors that are null, zero, empty or hold a null or non-finite component link with nothing; so do
    rows with a null id, which have a null component_id and are kept. Vectors of different lengths are
    not compared. Equal vectors link with each other. Rows that repeat an id count as vectors by
    themselves, each in the component of its own vector. An empty table gives an empty one; other columns are ignored.
    """
    with _dropping_shuffles(spark):
        return _near_vectors(spark, rows, id_col, vector_col, cosine)


def _near_vectors(spark: SparkSession, rows: DataFrame, id_col: str, vector_col: str, cosine: float) -> DataFrame:
    spark.conf.set(BATCH, 1 << 10)
    item = rows.schema[vector_col].dataType.elementType.simpleString()
    kind = item if item == "float" else "double"  # doubles stay what they are
    v = F.col(vector_col).cast(f"array<{kind}>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    plain = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast(kind))  # -0.0 is 0.0
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.when(good, plain).alias("v"))
    rows = stage(spark, rows.withColumn("h", F.when(F.col("v").isNotNull(), _number("v"))), "vectors")
    sets = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    sets = stage(spark, sets.withColumns({"key": F.monotonically_increasing_id(), "h": _number("v")}), "sets")  # written, so it stays
    n = sets.count()
    alone = sets.groupBy("h").count().where("count > 1").isEmpty()  # no two vectors have one number: it stands for the vector
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = links(spark, sets.select(F.col("key").alias("id"), "v", "weight"), n, cosine)
    found = stage(spark, found, "found")
    counts = found.groupBy(F.col("id").alias("key")).agg(F.sum("n").alias("n"))
    root = components(spark, found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    linked = sets.select("key", "rep").join(root.withColumnRenamed("id", "key"), "key")
    least = linked.groupBy("comp").agg(F.min("rep").alias("least"))
    comp = root.join(least, "comp").select(F.col("id").alias("key"), "least")
    by_set = sets.join(counts, "key", "left").join(comp, "key", "left")
    by_set = by_set.select("h", *([] if alone else ["v"]), F.coalesce("least", "rep").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = rows.select("id", "h", *([] if alone else ["v"])).join(by_set, "h" if alone else ["h", "v"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op9_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))
