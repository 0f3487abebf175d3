"""Pictures: decoding against plain arrays, blobs against a flood fill, rules of pictures in papers."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import pixels as px
from foliospark.operators import validate as val
from foliospark.plans import rule_queries  # noqa: F401
from foliospark.plans.queries import QUERIES


def png(rows: np.ndarray, colour: int, depth: int = 8, kinds=(0, 1, 2, 3, 4), extra: bytes = b"") -> bytes:
    """A PNG of rows of bytes, filtered by each kind of filter in turn."""
    unit = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    out, above = b"", np.zeros(rows.shape[1], int)
    for y, row in enumerate(rows.astype(int)):
        left, up_left = np.concatenate([np.zeros(unit, int), row[:-unit]]), np.concatenate([np.zeros(unit, int), above[:-unit]])
        p = left + above - up_left
        d = np.abs(np.stack([p - left, p - above, p - up_left]))
        paeth = np.choose(d.argmin(axis=0), [left, above, up_left])
        kind = kinds[y % len(kinds)]
        out += bytes([kind]) + ((row - [np.zeros(len(row), int), left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    width = rows.shape[1] * 8 // depth // {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    return px.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_decode():
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (23, 17), np.uint8)
    assert (px.decode(png(grey, 0)) == grey).all() and (px.decode(px.encode(grey)) == grey).all()
    rgb = rng.integers(0, 256, (9, 7, 3), np.uint8)
    want = (rgb @ np.array([299, 587, 114]) + 500) // 1000
    assert (px.decode(png(rgb.reshape(9, -1), 2)) == want).all()
    rgba = np.concatenate([rgb, rng.integers(0, 256, (9, 7, 1), np.uint8)], axis=2)
    assert (px.decode(png(rgba.reshape(9, -1), 6)) == want).all()
    bits = rng.integers(0, 2, (10, 16), np.uint8)
    assert (px.decode(png(np.packbits(bits, axis=1), 0, depth=1)) == bits * 255).all()
    for bad in (None, b"", b"abc", px.SIGNATURE, px.encode(grey)[:-30], px.encode(grey).replace(b"IDAT", b"IDAX")):
        assert px.decode(bad) is None


def flood(grid: np.ndarray) -> set:
    todo, boxes = {tuple(map(int, p)) for p in np.argwhere(grid)}, set()
    while todo:
        stack, seen = [todo.pop()], []
        while stack:
            y, x = stack.pop()
            seen.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & todo
            todo -= near
            stack += near
        ys, xs = zip(*seen, strict=True)
        boxes.add((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(boxes)))
    return sorted(b[:4] for b in boxes)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 14), st.integers(1, 14), st.integers(0, 2**32 - 1), st.floats(0.1, 0.7))
def test_blobs(h, w, seed, share):
    grid = np.random.default_rng(seed).random((h, w)) < share
    assert sorted(px.blobs(np.where(grid, 0, 255), cell=1)) == flood(grid)


def uri(grey) -> str:
    return "data:image/png;base64," + base64.b64encode(px.encode(grey)).decode()


def frame(h, w, ink=None):
    grey = np.full((h, w), 255, np.uint8)
    y0, x0, y1, x1 = ink or (0, 0, h, w)
    grey[y0:y1, x0:x1] = 0
    return grey


@pytest.mark.parametrize(
    "image,codes",
    [
        ({"src": uri(frame(60, 90)), "alt": "a drawing of a line"}, []),
        ({"src": uri(frame(60, 90)), "alt": " short  ", "more": 1}, ["image-keys", "image-alt"]),
        ({"src": uri(frame(30, 90)), "alt": "a drawing of a line"}, ["image-size"]),
        ({"src": uri(np.full((60, 60), 255, np.uint8)), "alt": "a drawing of a line"}, ["image-blank"]),
        ({"src": uri(frame(600, 600, (0, 0, 50, 50))), "alt": "a drawing of a line"}, ["image-whitespace"]),
        ({"src": uri(frame(1500, 60)), "alt": "a drawing of a line"}, ["image-tall"]),
        ({"src": "data:image/png;base64,AAAA", "alt": "a drawing of a line"}, ["image-decode"]),
        ({"src": "x.png"}, ["image-alt", "image-src"]),
        ("x", ["image-type"]),
    ],
)
def test_image_rules(spark, image, codes):
    q = {"number": 1, "stem": "What?", "options": [{"label": "A", "content": "1"}], "images": [image], "sourcePage": 2, "needsReview": False}
    paper = {"formatVersion": 1, "id": "set-1", "title": "Set", "paper": "Paper 1", "year": "2001", "durationMinutes": 75, "questions": [q]}
    found = val.paper_issues(spark.createDataFrame([("p", json.dumps(paper))], "paper_id string, json string"))
    assert [r.code for r in found.orderBy("ord").collect()] == codes


def test_question_rules(spark):
    q = {"number": 1, "stem": "See the graph. $frac{1}{2}$", "options": ["A", {"label": "C", "content": "Graph B", "x": 1}], "images": 3, "sourcePage": 2, "needsReview": None}
    paper = {"formatVersion": 1, "id": "set 1", "title": " ", "paper": 1, "year": "2001", "durationMinutes": 75, "questions": [q, "x"]}
    found = val.paper_issues(spark.createDataFrame([("p", json.dumps(paper))], "paper_id string, json string"), expected_questions=3, expected_duration=60)
    assert [(r.code, r.question, r.field) for r in found.orderBy("ord").collect()] == [
        ("id-format", None, None), ("duration-mismatch", None, None), ("question-count", None, None), ("empty", None, "title"), ("type", None, "paper"), ("bare-command", 1, "stem"),
        ("option-type", 1, None), ("option-keys", 1, None), ("option-label", 1, None), ("images", 1, None), ("figure-missing", 1, None), ("graph-options-missing", 1, None), ("needs-review", 1, None), ("question-type", None, None),
    ]


def test_source_pages_and_rendering(spark):
    questions = spark.createDataFrame([("p", 1, "alpha beta", 2), ("p", 2, "gamma delta", 1), ("p", 3, "gamma delta", 1), ("p", 4, "words here", 9), ("q", 1, "none", 5)], "paper_id string, number int, stem string, sourcePage int")
    pages = spark.createDataFrame([("p", 1, "gamma epsilon zeta words"), ("p", 2, "alpha beta")], "paper_id string, page int, text string")
    anchors = spark.createDataFrame([("p", 1, 1)], "paper_id string, number int, page int")
    found = val.source_page_issues(questions, pages, anchors)
    assert sorted((r.question, r.level) for r in found.collect()) == [(1, "error"), (4, "error")]
    assert [r.level for r in val.source_page_issues(questions.withColumn("stem", F.lit("nothing common")), pages, anchors).where("question = 2").collect()] == ["warning"]
    papers = spark.createDataFrame([("p",)], "paper_id string")
    errors = spark.createDataFrame([("p", 1, "stem", "b"), ("p", 1, "stem", "a")], "paper_id string, question int, field string, message string")
    assert [(r.code, r.message) for r in val.render_issues(papers, errors).collect()] == [("katex", "a; b")]
    assert [r.code for r in val.render_issues(papers, None).collect()] == ["katex-skipped"]


def test_pictures_are_drawn_once_over_all_cores(spark, tmp_path):
    spark.range(77).selectExpr("id as c_custkey", "id as p_partkey", "cast(id % 50 + 1 as int) as p_size").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{tmp_path}/customer.parquet").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("picture_papers", "picture_rules"):
        found = QUERIES[name](spark, str(tmp_path))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("framed(") == plan.count("measures(") == 1 and found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_questions_of_odd_texts(spark):
    q = {"number": 1, "images": ["x"]}
    odd = [[q], "x", 1, None, {}, {"questions": None}, {"questions": "[1]"}, {"questions": {"0": q}}, {"questions": 3}, {"questions": []}, {"questions": [None, 1, [q], q]}, {"questions": [q, q]}]
    texts = [(i, json.dumps(x)) for i, x in enumerate(odd)] + [(20, None), (21, ""), (22, '{"questions": [{"images": [1]}]'), (23, '{"questions": [{"images": [1]}]}')]
    found = val.image_issues(spark.createDataFrame(texts, "paper_id int, json string"))
    assert sorted((r.paper_id, r.pos, r.question, r.code) for r in found.collect()) == [(10, 3, 1, "image-type"), (11, 0, 1, "image-type"), (11, 1, 1, "image-type"), (23, 0, 1, "image-type")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 1, 1, 2, 2, 3, 4]), min_size=1, max_size=9), st.sampled_from([(0, 8), (2, 8), (6, 8), (4, 16)]), st.integers(1, 40), st.integers(1, 9), st.sampled_from([1, 50, 1 << 20]), st.integers(0, 2**32 - 1))
def test_runs_of_one_filter(kinds, sort, height, width, slab, seed):
    colour, depth = sort
    unit = {0: 1, 2: 3, 4: 2, 6: 4}[colour] * depth // 8
    rows = np.random.default_rng(seed).integers(0, 256, (height, width * unit), np.uint8)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(px, "_SLAB", slab)
        assert (px.decode(png(rows, colour, depth, kinds)) == px.decode(png(rows, colour, depth, [0]))).all()
