"""Queries over all rows and whole texts against brute force on tables of our own."""

import random
import re

from foliospark.plans.queries import QUERIES

DOCS = [(0, "Apple apple pears $x$ and plum"), (41, "pears cost $5, apples $6 today"), (7, ""), (80, None), (3, "apple " * 30 + "grape $")]
ITEMS = [(0, "pears today"), (1, "apple grape cost"), (199, "Apple APPLE"), (200, None)]


def run(spark, tmp_path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]


def test_word_overlap_of_all_pairs(spark, tmp_path):
    words = lambda s: set(re.findall("[a-z]{4,}", (s or "").lower()))
    want = [(d, i, len(words(x) & words(y))) for d, x in DOCS for i, y in ITEMS if words(x) & words(y)]
    got = run(spark, tmp_path, "word_overlap", documents=(DOCS, "doc_id long, text string"), benchmark=(ITEMS, "item_id long, text string"))
    assert sorted(got) == sorted(want) and (41, 0, 2) in want and (0, 199, 1) in want


def test_characters_of_whole_texts(spark, tmp_path):
    odd = {"\t": "control-char", "\r": "control-char", "\u200b": "invisible-char", "\ue000": "private-char", "\ufffd": "replacement-char"}
    rng = random.Random(5)
    texts = ["".join(rng.choice([*odd, "$", "\n", "a", "\U0001f600"] if rng.random() < 0.1 else "ab ") for _ in range(300)) for _ in range(9)]
    docs = ([*enumerate(texts), (9, None), (10, "")], "doc_id long, text string")
    whole = {i: s + "ab\t\u200b\ue000" * (i % 3) for i, s in [*enumerate(texts), (10, "")]}
    want = [(i, at, odd[c]) for i, s in whole.items() for at, c in enumerate(s) if c in odd]
    assert sorted(run(spark, tmp_path, "character_offsets", documents=docs)) == sorted(want)


def test_every_issue_of_every_rule(spark, tmp_path):
    e, w = "error", "warning"
    cases = [
        (1, "a\u200bb\ufffd", [(e, "invisible-char"), (e, "replacement-char")]), (2, "plain frac", [(e, "bare-command")]), (3, "$sin x + sin y$", [(w, "bare-function")] * 2),
        (4, "{a", [(w, "text-braces")]), (5, "  ", [(e, "empty")]), (6, None, [(e, "type")]), (7, "ok", [(e, "control-char")]), (14, "x\ty", [(e, "control-char")] * 2),
        (8, "$\\left( x$", [(e, "left-right")]), (9, "$x", [(e, "dollar-balance")]), (10, "clean", []), (11, "\u00c3\u00a9 x", [(w, "mojibake")]), (12, "$a{$ {b$", [(e, "dollar-balance"), (w, "text-braces")]),
    ]
    docs = ([c[:2] for c in cases], "doc_id long, text string")
    got = run(spark, tmp_path, "issues_rules", documents=docs)
    assert sorted((r[0], *r[2:4]) for r in got) == sorted((i, *x) for i, _, found in cases for x in found)
    count = lambda found, level: sum(x == level for x, _ in found)
    assert sorted(run(spark, tmp_path, "report_summary")) == sorted((i, count(f, e), count(f, w), count(f, e) == 0) for i, _, f in cases if f)
    assert sorted(run(spark, tmp_path, "flag_join")) == sorted((i, ";".join(sorted({c for x, c in f if x == e})), count(f, e)) for i, _, f in cases if count(f, e))


def test_boxes_of_all_parts(spark, tmp_path):
    rng = random.Random(6)
    parts = [(i, rng.choice("AB"), rng.randrange(1, 31), float(rng.randrange(900, 2000))) for i in range(150)]
    low = {(b, s): min(p for _, x, y, p in parts if (x, y) == (b, s)) for _, b, s, _ in parts}
    want = [(k, band) for k, b, s, p in parts for (brand, band), y in low.items() if brand == b and 5 <= s <= 25 and y <= p <= y + 300]
    part = (parts, "p_partkey long, p_brand string, p_size int, p_retailprice double")
    assert sorted(run(spark, tmp_path, "point_in_box", part=part)) == sorted(want) and any(band % 10 for _, band in want)
    assert sorted(run(spark, tmp_path, "anti_in_box")) == sorted((k,) for k, *_ in parts if k not in {x for x, _ in want})
