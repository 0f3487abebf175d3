"""Token shards: exact round trip, lookups, and ids equal to plain encoding."""

import io
import struct
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliospark.llm.tokens import Encoder, ShardReader, ShardWriter, id_of, key_of, tokenized, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)
ODD = ["", None, " ", "  ", "\n", "\n\n", " \n ", "a  b", "a\n b", "a \nb", "x\nThe", "don't, can't.", "é, è.\nç", "×, ÷.", "a  b　 c", "<|endoftext|> a, b", "!!\n!!", "A.b,C\nD", "é\n\né", "1,2 3.4\t5", "\U0001f600, ok", "a" * 3000]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é×\n\t .,'!9  ß|<", max_size=30), min_size=1, max_size=6))
def test_ids_equal_plain_encoding(texts):
    for t, ids in zip(texts, ENCODER.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_odd_texts():
    for t, ids in zip(ODD, ENCODER.encode(pa.array(ODD, pa.string())), strict=True):
        assert ids.tolist() == PLAIN.encode(t or "", add_special_tokens=False).ids, t


class Bytes:
    def __init__(self, b):
        self.b = b

    def size(self):
        return len(self.b)

    def read_at(self, n, at):
        return self.b[at : at + n]


def test_strings_that_are_cut_otherwise_are_encoded_one_by_one(monkeypatch):
    encoder = Encoder(PATH)
    encoder.line = PLAIN.encode(" the").ids[0]  # now no newline is where it is looked for
    for t, ids in zip(ODD, encoder.encode(pa.array(ODD, pa.string())), strict=True):
        assert ids.tolist() == PLAIN.encode(t or "", add_special_tokens=False).ids, t


def test_a_hot_id_is_dealt_over_shards(spark):
    rows = [(7, f"text {i}") for i in range(4_000)] + [(None, f"null {i}") for i in range(4_000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(8)
    path = "file://" + tempfile.mkdtemp()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = write_shards(spark, df, path, PATH).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([r for r in shards if r.n_docs]) > 2 and max(r.n_docs for r in shards) < 4_000


def test_lookup_by_identifier():
    out = io.BytesIO()
    w = ShardWriter(out, 2)
    rng = np.random.default_rng(1)
    values = {}
    for i in sorted(rng.choice(10**6, 3000, replace=False).tolist()) + [2**62]:
        for again in range(1 + i % 2):
            v = rng.integers(0, 50000, rng.integers(1, 200)).astype("<u2")
            values.setdefault(i, []).append(v)
            w.add(key_of(i, again), v.tobytes())
    w.close()
    r = ShardReader(Bytes(out.getvalue()))
    assert len(r.index) > 3
    for i in list(values)[::97] + [2**62]:
        assert [x.tolist() for x in r.lookup(i)] == [x.tolist() for x in values[i]]
    assert sum(bool(r.lookup(i)) for i in range(10**7, 10**7 + 200)) == 0
    assert [id_of(key_of(i, 0)) for i in (None, -5, 0, 7)] == [None, -5, 0, 7] and key_of(None, 0) < key_of(-5, 0) < key_of(7, 0)
    damaged = bytearray(out.getvalue())
    damaged[10] ^= 1
    with pytest.raises(ValueError):
        list(ShardReader(Bytes(bytes(damaged))).scan())


def test_round_trip_over_a_table(spark):
    rows = [(i * 3 % 22 - 4, t) for i, t in enumerate(ODD)] + [(None, "null id"), (None, "null id"), (1, "again")]
    df = spark.createDataFrame([(i, t, 1, 2, "f") for i, t in rows], "doc_id long, text string, id long, start long, file string")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenized(spark, df).collect()]
    want, at = [], 0
    hash_ = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + 2**63) % 2**64  # noqa: E731  Spark's, in signed order
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hash_(x[1]), x[1] is not None)):
        ids = [*PLAIN.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokenized(spark, df.limit(0)).collect() == []
