"""The classifier by held-out accuracy, lattice hashing by brute force, the pipeline step by step."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from foliospark.llm import decontam, neardup, quality, registry, vectors

SF = "/root/testdata/sf0.01"


def test_features_and_model():
    x = quality.features(pa.array(["", None, "Abc def.\n", "A!! B!!", "x | y | z", "w " * 9000]))
    assert x.shape == (6, len(quality.FEATURES)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    rng = np.random.default_rng(0)
    f = rng.random((3000, 3))
    y = ((f[:, 0] > 0.5) ^ (f[:, 1] > 0.5)).astype(float)  # no single feature helps
    model = quality.Model(f[:2000], y[:2000])
    assert ((model.score(f[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert quality.Model(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def plain_score(model, x):
    """The sum of table entries, one row, feature and bin at a time."""
    out = []
    for row in x.tolist():
        bin_of = lambda edges, v: sum(1 for e in edges.tolist() if e <= v)
        total = model.base
        for f, v in enumerate(row):
            total += model.tables[f].tolist()[bin_of(model.edges[f], v)]
        for f, g, grid in model.pairs:
            total += grid.tolist()[bin_of(model.coarse[f], row[f])][bin_of(model.coarse[g], row[g])]
        out.append(1 / (1 + math.exp(-total)))
    return out


def plain_features(t):
    b = (t or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", b) if w]
    lines = re.findall(rb"[^\n]*\n|[^\n]+", b)
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    kinds = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" ", "line": b"\n", "stop": b".,;:?", "shout": b"!", "bar": b"|", "sign": b"#$%&*@^~<>{}[]\\/=+_`", "high": bytes(range(128, 256))}
    n = {k: sum(c in v for c in b) for k, v in kinds.items()}
    lower_lines = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in lines]
    return [
        math.log1p(len(b)), math.log1p(len(words)), sum(map(len, words)) / max(1, len(words)), *(x / max(1, len(b)) for x in n.values()),
        n["upper"] / max(1, n["upper"] + n["lower"]), len(set(low)) / max(1, len(words)), len(set(lower_lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
    ]


def test_scores_equal_a_plain_sum_of_table_entries(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(spark, docs, labels)
    assert model.pairs and any(t.any() for t in model.tables)
    odd = [(9001, None), (9002, ""), (9003, "\n\n"), (9004, "w " * 30_000), (None, "null id"), (9005, "é" * 5_000)]
    few = [(r.doc_id, r.text) for r in docs.limit(150).collect()] + odd
    df = spark.createDataFrame([(*r, 1.0, True, "x") for r in few], "doc_id long, text string, score double, held_out boolean, quality string")
    got = {r.doc_id: r.score for r in quality.scored(spark, df, model).collect()}
    want = dict(zip((i for i, _ in few), plain_score(model, np.array([plain_features(t) for _, t in few])), strict=True))
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    kept = quality.accepted(spark, df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, s in want.items() if s >= 0.3}


def test_learning_takes_each_labelled_document_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 7} {k}") for i in range(40) for k in range(30)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "Model", lambda x, y: seen.append((x, y)))
    quality.fit(spark, docs, labels)
    quality.fit(spark, docs, labels, max_labelled=10)
    fold = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    assert len(seen[0][1]) == len(fold) and len(seen[1][1]) == 10
    assert sorted(seen[0][0].tolist()) == sorted(quality.features(pa.array([None if i == 3 else min(f"text {i % 7} {k}" for k in range(30)) for i in fold])).tolist())


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = registry.QUERIES["op6_quality_gam"](spark, SF).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_rows_for_the_classifier(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(spark, df, labels)
    assert quality.scored(spark, df, model).count() == 4
    assert quality.accepted(spark, df.limit(0), model).collect() == []


def test_lattice_points_are_the_nearest():
    x = np.random.default_rng(3).normal(size=(200, 8))
    own = ((x - vectors.decode(x)) ** 2).sum(axis=1)
    near = vectors.decode(x)[:, None] + vectors.ROOTS[None]
    assert (own[:, None] <= ((x[:, None] - near) ** 2).sum(axis=2) + 1e-9).all() and len(vectors.ROOTS) == 240


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for n in (1, 2, 5, 90):
        centre = rng.normal(size=64)
        for _ in range(n):
            rows.append((i, (centre + rng.normal(size=64) * rng.choice([0.05, 0.17, 0.2])).astype(np.float32)))
            i += 2
    rows += [(1001, rows[10][1]), (1003, rows[10][1] * np.float32(2)), (1005, rng.normal(size=64).astype(np.float32))]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    comp = np.array([i for i, _ in rows])
    for _ in range(len(rows)):
        comp = np.array([comp[linked[k]].min() for k in range(len(rows))])
    want = {i: (int(linked[k].sum()) - 1, int(comp[k])) for k, (i, _) in enumerate(rows)}
    odd = [(2001, None), (2002, [0.0] * 64), (2003, [float("nan")] * 64), (2004, [1.0, None]), (2005, []), (2006, [1.0, 0.0]), (2007, [1.0, 0.0]), (None, [1.0, 0.0]), (2008, [float("inf")] * 64)]
    want |= {i: (0, i) for i, _ in odd if i} | {2006: (1, 2006), 2007: (1, 2006)}
    df = spark.createDataFrame([(i, [float(a) for a in v], 1, 2.0) for i, v in rows] + [(*r, 1, 2.0) for r in odd], "vec_id long, embedding array<float>, id int, v double")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark, df).collect()}
    assert got.pop(None) == (0, None)
    assert got == want
    assert vectors.near_vectors(spark, df.limit(0)).collect() == []


def test_pipeline_against_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = corpus_pipeline.quality_filter(spark, docs, SF)
    scores = {r.doc_id: r.predicted for r in registry.QUERIES["op6_quality_gam"](spark, SF).collect()}
    kept = {r.doc_id for r in first.collect()}
    assert kept == {i for i, p in scores.items() if p} and first.columns == docs.columns
    second = corpus_pipeline.near_dedup(spark, first, SF)
    from tests.llm.test_neardup import brute

    groups = brute([(i, texts[i]) for i in sorted(kept)], 5, 80)
    after = {r.doc_id for r in second.collect()}
    assert after == {i for i, (_, c) in groups.items() if i == c} and second.columns == docs.columns
    third = corpus_pipeline.decontaminate(spark, second, SF)
    found = {r.doc_id for r in decontam.matches(spark, second, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    clean = {r.doc_id for r in third.collect()}
    assert clean == after - found and found
    fourth = corpus_pipeline.mix_sources(spark, third, SF)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} <= clean
    fifth = corpus_pipeline.write_tokens(spark, fourth, SF)
    assert fifth.count() == fourth.count() and len(steps) == 5
    assert neardup.near_duplicates(spark, fourth.limit(0)).collect() == []
