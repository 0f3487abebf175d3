"""The review of papers on small texts and tables of our own."""

import json

from pyspark.sql import functions as F

from foliospark.operators import review


def test_paragraphs_and_rich_text(spark):
    cases = {
        "a\n\nb\nc\n  \n\nd": ["a", "b\nc", "d"], "$$x\n\ny$$ z\n\nw": ["$$x\n\ny$$ z", "w"], "a $$open\n\nend": ["a $$open\n\nend"], "": [], "\n\n  \n": [], "\n\na": ["a"], "$x$\n\n$y$": ["$x$", "$y$"],
    }
    df = spark.createDataFrame([*((s,) for s in cases), ("w " * 100_000,), (None,)], "s string")
    got = {r.s: r.p for r in df.select("s", review.paragraphs(F.col("s")).alias("p")).collect()}
    assert {s: got[s] for s in cases} == cases and got[None] is None and len(got) == len(cases) + 2
    assert df.limit(1).select(review.rich_text(F.lit("a<b & c\nd\n\n$x>1$")).alias("r")).first().r == "<p>a&lt;b &amp; c<br>d</p><p>$x&gt;1$</p>"


def test_leftover(spark):
    df = spark.createDataFrame([(1, "fine $x$"), (2, "so \\frac here"), (3, "cost $5"), (4, None), (5, "$a{$")], "n int, s string")
    got = {r.n: r.near for r in review.leftover(df, ["n"], "s").collect()}
    assert got == {2: "so \\frac here", 3: "cost $5", 5: "$a{$"}


def test_filter_and_counts(spark):
    q = spark.createDataFrame([("p", 1, True, ["i"]), ("p", 2, False, []), ("p", 3, False, ["i"]), ("p", 4, None, []), ("q", 1, False, [])], "paper_id string, number int, needs_review boolean, images array<string>")
    issues = spark.createDataFrame([("p", 2, "info"), ("p", 3, "warning"), ("p", 3, "error"), ("q", 2, "error")], "paper_id string, number int, level string")
    assert sorted((r.paper_id, r.number) for r in review.to_review(q, issues, ["paper_id", "number"]).collect()) == [("p", 1), ("p", 3)]
    assert sorted(tuple(r) for r in review.counts(q).collect()) == [("p", 4, 1, [1, 3]), ("q", 1, 0, [])]


def test_gate(spark):
    question = {"number": 1, "stem": "What $x?", "options": [{"label": "A", "content": "1"}], "images": [], "sourcePage": 2, "needsReview": False}
    paper = {"formatVersion": 1, "id": "set-1", "title": "Set", "paper": "Paper 1", "year": "2001", "durationMinutes": 75, "questions": [question]}
    rows = [("good", json.dumps(paper)), ("key", json.dumps(paper | {"x": 1})), ("label", json.dumps(paper | {"questions": [question | {"options": [{"label": "B", "content": "1"}]}]})), ("none", "no JSON")]
    saved, refused = review.gate(spark.createDataFrame(rows, "paper_id string, json string"))
    assert [r.paper_id for r in saved.collect()] == ["good"]  # its dollar sign is an error, but not of form
    assert {r.paper_id: r.reasons for r in refused.collect()} == {"key": ["extra-keys"], "label": ["option-label"], "none": ["root"]}
