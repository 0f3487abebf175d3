"""Lattice hashing: any number of vector lengths, doubles, recall by length, candidates at two sizes, blocks dealt."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import vectors


def near_pairs(rng, n, dim, cosine):
    a, z = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z -= (z * a).sum(axis=1)[:, None] * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1)[:, None]


@pytest.mark.parametrize("dim", [2, 7, 24, 64, 200, 768])
@pytest.mark.parametrize("n", [1_000, 50_000])
def test_recall_at_the_least_cosine(dim, n):
    a, b = (vectors.cells(x, *vectors.plan(n)) for x in near_pairs(np.random.default_rng(dim), 300, dim, 0.951))
    assert ((a == b[:, :, :1]) | (b == a[:, :, :1])).any(axis=(1, 2)).mean() > 0.99


def test_candidates_do_not_grow_with_the_number_of_vectors():
    rng, met = np.random.default_rng(9), []
    for n in (1_500, 15_000):
        x = rng.normal(size=(n, 64))
        got = vectors.cells(x / np.linalg.norm(x, axis=1)[:, None], *vectors.plan(n))
        pairs = 0
        for t in range(got.shape[1]):
            own, count = np.unique(got[:, t, 0], return_counts=True)
            at = np.minimum(np.searchsorted(own, got[:, t]), len(own) - 1)
            pairs += int(np.where(own[at] == got[:, t], count[at], 0).sum()) - n
        met.append(2 * pairs / n)
    assert max(met) < 2 * vectors.CANDIDATES and met[1] < 10 * met[0] + 1, met


def test_more_than_a_thousand_lengths(spark):
    rows = [(2 * d + k, [1.0] + [0.5] * (d - 1)) for d in range(1, 1_102) for k in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark, df).collect()}
    assert got == {i: (1, i - i % 2) for i, _ in rows}


def test_doubles_stay_doubles(spark):
    big, tiny = [1e300, 2e300, -1e299], [1e-300, 2e-300, -1e-301]
    rows = [(1, big), (2, [x * 1.01 for x in big]), (3, tiny), (4, [1.0, 2.0, -0.1]), (5, [1.0, 2.0, -0.1 + 1e-12]), (6, [-1.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark, df).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (0, 6)}


def test_blocks_of_one_cell_are_dealt_over_tasks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a) for a in rng.normal(size=16)], 1) for i in range(40)]
    plan = vectors.links(spark, spark.createDataFrame(rows, "id long, v array<float>, weight long"), 40)._jdf.queryExecution().executedPlan().toString()
    top = plan[plan.index("FlatMapGroupsInArrow") :]
    assert re.search(r"hashpartitioning\(dim#\d+, t#\d+, cell#\d+L, i#\d+L?, j#\d+L?", top[: top.index("Join")]), plan


def test_work_follows_the_number_of_vectors(spark, monkeypatch):
    """Rows written between steps, and groups of comparisons: not one row for each visit, nor one group for each cell."""
    rng, written, stage = np.random.default_rng(4), {}, vectors.stage

    def counted(spark, df, name):
        out = stage(spark, df, name)
        written[name] = written[name].unionByName(out) if name in written else out
        return out

    monkeypatch.setattr(vectors, "stage", counted)
    monkeypatch.setattr("foliospark.llm.components.stage", stage)
    monkeypatch.setattr(vectors, "VISITS", 50_000)  # some tables at a time
    a, b = near_pairs(rng, 700, 64, 0.97)
    x = np.concatenate([a, b, rng.normal(size=(2_600, 64))])
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark, df).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    assert got == {i: (int(linked[i].sum()) - 1, int(linked[i].argmax())) for i in range(len(x))}
    assert written["links"].agg(F.sum("n")).first()[0] == int(linked.sum()) - len(x)
    assert max(vectors.plan(10_000_000)) * vectors.cells(x[:1], *vectors.plan(10_000_000)).shape[2] < 60
    rows = {name: table.count() for name, table in written.items()}
    assert max(n for name, n in rows.items() if name not in ("held", "links", "found")) <= len(x) and rows["held"] < 22 * 1_400 * 1.2, rows
    assert written["held"].select("shared").distinct().count() < rows["held"] / 10


def meeting(rows, block, cut):
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + cut]) for c in rows], ["place", "mine", "s0", "s1"]) for i in range(0, len(rows[0]), cut)]
    found = pa.Table.from_batches([*vectors._meeting(iter(batches), 34, block)]).to_pydict()
    shared = {}
    for s, p, m in zip(found["shared"], found["place"], found["mine"], strict=True):
        shared.setdefault(s, []).append((p, m))
    return sorted(zip(found["place"], found["mine"], found["parts"], found["own_parts"], strict=True)), shared


@pytest.mark.parametrize("cut", [1, 7, 5_000])
def test_meetings_are_those_of_near_sketches(monkeypatch, cut):
    monkeypatch.setattr(vectors, "ROWS", 50)
    rng, block = np.random.default_rng(3), 16
    monkeypatch.setattr(vectors, "SKETCHED_CELL", 60)
    place = np.sort(np.concatenate([rng.integers(0, 400, 600), np.full(40, 77), np.full(300, 1 << 32)]))
    mine = np.arange(len(place)) * 2 + rng.integers(0, 2, len(place))
    sketch = rng.integers(-(1 << 63), 1 << 63, size=(len(place), 2), dtype=np.int64)
    sketch[::3] = sketch[0]
    want = []
    for p in np.unique(place):
        at = np.flatnonzero(place == p)
        bits = np.bitwise_count(sketch[at][:, None] ^ sketch[at]).sum(axis=2)
        near = (bits <= 34) & ((mine[at][:, None] | mine[at]) & 1 == 1) & ~np.eye(len(at), dtype=bool)
        at = at if len(at) > 60 else at[near.any(axis=1)]
        want += [(p, m, -(-len(at) // block), -(-int((mine[at] & 1).sum()) // block)) for m in mine[at]]
    got, shared = meeting((place, mine, *sketch.T), block, cut)
    assert got == sorted(want)
    for key, rows in shared.items():  # whole cells of one table; large ones alone
        assert len({p >> 32 for p, _ in rows}) == 1 and key in {p for p, _ in rows}
        assert len({p for p, _ in rows}) == 1 or len(rows) < block
    assert sum(len({p for p, _ in rows}) for rows in shared.values()) == len({p for p, *_ in got})
    assert meeting((place[:1], mine[:1], *sketch[:1].T), block, 1) == ([], {})


def test_a_pair_counts_where_it_meets_first():
    rng, n, tables = np.random.default_rng(6), 60, 4
    got = rng.integers(0, 12, size=(n, tables, 2)).astype(np.uint32)
    got[..., 1] += got[..., 0] == got[..., 1]
    counted = {}
    for t in range(tables):
        for cell in range(14):
            x, y = np.flatnonzero((got[:, t] == cell).any(axis=1)), np.flatnonzero(got[:, t, 0] == cell)
            i, j = (c.ravel() for c in np.meshgrid(x, y))
            i, j = i[i != j], j[i != j]
            for k in vectors.first_meetings(i, j, got, got, t, i < j):
                pair = tuple(sorted((int(i[k]), int(j[k]))))
                counted[pair] = counted.get(pair, 0) + 1
    met = {(a, b) for a in range(n) for b in range(a + 1, n) if ((got[a] == got[b, :, :1]) | (got[b] == got[a, :, :1])).any()}
    assert set(counted) == met and set(counted.values()) == {1}


@pytest.mark.parametrize("dim", [2, 24, 64, 768])
def test_sketches_of_near_vectors_are_near(dim):
    a, b = (vectors.sketches(x) for x in near_pairs(np.random.default_rng(dim), 5_000, dim, 0.9501))
    assert np.bitwise_count(a ^ b).sum(axis=1).max() <= vectors.most_bits(0.95) < 40 and vectors.most_bits(-1.0) == vectors.BITS


def test_vectors_whose_numbers_clash(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_number", lambda v: F.size(v).cast("long"))
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (4, [1.0, 1.0]), (5, None), (6, [1.0, 0.0, 0.0]), (7, [0.0, 0.0])]
    got = sorted(vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert [tuple(r) for r in got] == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True)]


def test_numbers_are_joined_rather_than_vectors(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(a) for a in rng.normal(size=16)]) for i in range(40)], "vec_id long, embedding array<float>")
    plan = vectors.near_vectors(spark, df)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any(re.search(r"\(h#\d+L = h#\d+L\)", line) for line in joins) and not any(re.search(r"\bv#\d+", line) for line in joins), plan
