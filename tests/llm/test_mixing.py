"""Mixing: targets, whole results and reruns on small tables."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixing
from foliospark.llm.mixing import mix, mixed, targets, word_count

SCHEMA = "doc_id long, text string, source string, size long, target string, before long, n_chars long"


def rows(n=60):
    out = [(i, " ".join(f"w{j}" for j in range(i % 17)), ["a", "b", None, "é"][min(i % 7, 3)], 1, "x", 2, 0) for i in range(n)]
    return out + [(None, "null id", "a", 1, "x", 2, 0), (3, None, "b", 1, "x", 2, 0), (5, "w w", "a", 1, "x", 2, 0), (5, "w w", "a", 1, "x", 2, 0)]


def test_targets_are_shared_until_none_is_above(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in targets(sizes, (3, 1, 2), 150, 2).collect()}
    assert got == {"a": 20, None: 100, "b": 990, "c": 1980}


def test_sources_meet_their_targets_and_reruns_agree(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    narrow = df.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    one, two = (sorted(map(repr, mixed(d).collect())) for d in (narrow, narrow.repartition(3)))
    assert [r.split("before")[0] for r in one] == [r.split("before")[0] for r in two] and len(one) == df.count()
    for r in mixed(narrow).groupBy("source", "target").agg(F.sum("taken").alias("t"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r.t - r.target) <= 16 and r.over <= 0  # one document at most


def queue(df, weights=(3, 1, 2), percent=150, repeats=2):
    """Words taken of each (id, source, size) by a queue served packet by packet."""
    docs = [tuple(r) for r in df.select("id", "source", "size").collect()]
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(d[2] for d in docs if d[1] == s) for s in names}
    target = {r.source: r.target for r in targets(df.select("source", "size"), weights, percent, repeats).collect()}
    packets = []
    for s in names:
        at = 0
        own = sorted((d for d in docs if d[1] == s), key=lambda d: (hashlib.md5(("" if d[0] is None else str(d[0])).encode()).hexdigest(), d[0] is not None, d[0] or 0, d[2]))
        for _ in range(repeats):
            for d in own:
                for i in range(0, d[2], mixing.PACKET):
                    words = min(mixing.PACKET, d[2] - i)
                    at += words
                    packets.append((at / target[s], s is None, s or "", at, words, d))
    left, taken = min(sum(size.values()) * percent // 100, sum(size.values()) * repeats), Counter({d: 0 for d in docs})
    for *_, words, d in sorted(packets):
        taken[d] += min(words, left)
        left -= min(words, left)
    return sorted(map(repr, ((*d, n) for d, n in taken.items())))


@pytest.mark.parametrize(("packet", "words"), [(512, 20_000), (3, 7)])
def test_taken_words_are_those_of_a_queue(spark, monkeypatch, packet, words):
    monkeypatch.setattr(mixing, "PACKET", packet)
    monkeypatch.setattr(mixing, "RANGE_WORDS", words)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    rng = random.Random(packet)
    docs = [(i, rng.choice(["a", "a", "a", "b", None, "é", "tiny"][: 3 + i]), rng.choice([0, 1, 5, 40, 300, 2000])) for i in range(120)] + [(None, "a", 9), (500, "tiny", 1)]
    df = spark.createDataFrame(docs, "id long, source string, size long")
    for percent, repeats in ((150, 2), (60, 1), (400, 3)):
        got = sorted(map(repr, (tuple(r) for r in mixed(df, percent=percent, repeats=repeats).select("id", "source", "size", "taken").collect())))
        assert got == queue(df, percent=percent, repeats=repeats)


def test_the_mix_holds_the_taken_words(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = mix(df)
    assert out.columns == df.columns
    narrow = df.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    want = {r[0]: r[1] for r in mixed(narrow).groupBy("source").agg(F.sum("taken")).collect()}
    got = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(word_count(F.col("text")))).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert out.where("n_chars <> length(text)").count() == 0


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_text_is_cut(spark):
    df = spark.createDataFrame([(1, "long word " * 60_000, "a", 1, "x", 2, 0), (2, "b " * 9_000, "b", 1, "x", 2, 0)], SCHEMA)
    out = {(r.doc_id, r.n) for r in mix(df, percent=60, repeats=1).select("doc_id", word_count(F.col("text")).alias("n")).collect()}
    assert out == {(1, 69_000), (2, 8_400)} or sum(n for _, n in out) == 77_400
