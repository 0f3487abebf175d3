"""Token ids as sorted-string-table shards.

A shard holds documents in key order. Layout: data blocks (zstd), the index block, the Bloom filter,
the footer. A block is a run of entries ``shared, unshared, length`` (varints), the unshared end of
the key, the value; the key of a block's first entry is whole. The index has each block's last key,
offset, length and CRC, so that a lookup searches it by bisection and reads one block. A key is the
document id in an order-preserving form with a running number for repeated ids; a value is the ids as
little-endian numbers of the width named in the footer.

A task writes its shard under a name of its own and renames it when whole; the manifest that tasks
return is a table, and files it does not name (of lost attempts) count for nothing.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, small_batches, stage, table
from .shingles import CHECK_BYTE, RAW_BYTE, pieces, span_hashes

END_ID = 2
BLOCK_BYTES = 1 << 16
MAGIC = b"FOLSST01"
_FOOTER = struct.Struct("<QQQQQQB7x8s")
_CHUNK = 1 << 22
#: Distinct strings whose ids a task remembers.
CACHE = 1_500_000


def bloom_bits(keys: list[bytes], n_bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(n_bits) for i in range(7)])


def key_of(doc_id: int | None, again: int) -> bytes:
    return (b"\x00" + bytes(8) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + 2**63)) + struct.pack(">I", again)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        n |= (c & 127) << shift
        at += 1
        if c < 128:
            return n, at
        shift += 7


class ShardWriter:
    """Takes entries in ascending key order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.size, self.last, self.index, self.keys, self.pack = [], 0, b"", [], [], zstandard.ZstdCompressor(level=1)
        self.ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self.size += len(value) + len(key)
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            body = self.pack.compress(b"".join(self.block))
            self.index.append((self.last, self.at, len(body), zlib.crc32(body)))
            self.out.write(body)
            self.at += len(body)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<QQI", o, n, c) + _varint(len(k)) + k for k, o, n, c in self.index)
        n_bits = max(64, 10 * len(self.keys))
        bits = np.zeros(-(-n_bits // 8) * 8, bool)
        if self.keys:
            bits[bloom_bits([k[:9] for k in self.keys], n_bits).ravel()] = True
        bloom = np.packbits(bits).tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(_FOOTER.pack(self.at, len(index), len(self.index), len(bloom), n_bits, len(self.keys), self.width, MAGIC))


class ShardReader:
    def __init__(self, file):
        self.file = file
        end = file.size()
        self.at, n_index, n_blocks, n_bloom, self.n_bits, self.n_keys, self.width, magic = _FOOTER.unpack(self._read(end - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, i, self.index = self._read(self.at, n_index), 0, []
        for _ in range(n_blocks):
            o, n, c = struct.unpack_from("<QQI", index, i)
            size, i = _read_varint(index, i + 20)
            self.index.append((index[i : i + size], o, n, c))
            i += size
        self.bloom = np.unpackbits(np.frombuffer(self._read(self.at + n_index, n_bloom), np.uint8))

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _entries(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, o, n, crc = self.index[number]
        body = self._read(o, n)
        if zlib.crc32(body) != crc:
            raise ValueError("a block is damaged")
        block, i, key = zstandard.ZstdDecompressor().decompress(body), 0, b""
        while i < len(block):
            shared, i = _read_varint(block, i)
            rest, i = _read_varint(block, i)
            size, i = _read_varint(block, i)
            key = key[:shared] + block[i : i + rest]
            yield key, block[i + rest : i + rest + size]
            i += rest + size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for n in range(len(self.index)):
            for key, value in self._entries(n):
                yield id_of(key), np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this document id; at most the blocks that can hold it are read."""
        low = key_of(doc_id, 0)
        if not self.n_keys or not self.bloom[bloom_bits([low[:9]], self.n_bits).ravel()].all():
            return []
        found = []
        for n in range(bisect.bisect_left(self.index, (low,)), len(self.index)):
            for key, value in self._entries(n):
                if key[:9] > low[:9]:
                    return found
                if key[:9] == low[:9]:
                    found.append(np.frombuffer(value, f"<u{self.width}").astype("<u4"))
        return found


class Encoder:
    """Ids of whole texts by the tokenizers library, the same as ``encode`` gives for each text.

    A byte-level vocabulary cuts a text into strings that it encodes one by one. Where such a cut is
    certain (before a lone space, around a lone newline, between a letter and punctuation) the text
    is cut here, each distinct string of some megabytes is encoded once, and its ids are laid out by
    numpy. Texts that hold a special token, and other kinds of vocabulary, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        pre = said.get("pre_tokenizer") or {}
        self.fast = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not said.get("normalizer") and not said.get("truncation") and not said.get("padding")
        self.special = [t["content"].encode() for t in said.get("added_tokens") or []]
        line = self.one("\n")
        self.line = int(line[0]) if len(line) == 1 else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.forget()
        byte = np.arange(256)
        self.letter = ((byte | 32) >= 97) & ((byte | 32) <= 122)
        self.visible = (byte >= 33) & (byte <= 126)
        self.two = (byte >= 0xC3) & (byte <= 0xDF)  # first bytes of two-byte letters and signs, none of them white space
        self.edges, self.lead, self.opens = self.visible.tolist(), self.two.tolist(), (self.visible | self.two).tolist()
        self.mark = self.visible & ~self.letter & ~((byte >= 48) & (byte <= 57)) & (byte != 39)

    def one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def known(self, whole: bytes, keys: np.ndarray, check: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(ids, start, size): the place of each string's ids. keys ascend; what is new is encoded and
        remembered, until there are CACHE strings."""
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        hit = (self.keys[near] == keys) & (self.check[near] == check) if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~hit)
        found = self.each([whole[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        new_size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        start, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        start[hit], size[hit] = self.start[near[hit]], self.size[near[hit]]
        start[new], size[new] = len(self.ids) + np.cumsum(new_size) - new_size, new_size
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), f"<u{self.width}")])
        if len(self.keys) + len(new) > CACHE or len(ids) > 8 * CACHE:
            self.forget()
        else:
            self.keys, self.check = np.insert(self.keys, at[new], keys[new]), np.insert(self.check, at[new], check[new])
            self.start, self.size = np.insert(self.start, at[new], start[new]), np.insert(self.size, at[new], size[new])
            self.ids = ids
        return ids, start, size

    def forget(self) -> None:
        self.keys, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, f"<u{self.width}")

    def each(self, strings: list[bytes]) -> list[bytes]:
        """The packed ids of each string. Those between whose ends a lone newline is a string by
        itself are encoded at once, newlines between them."""
        out: list[bytes] = [b""] * len(strings)
        at_once = []
        for i, k in enumerate(strings):
            if self.line is not None and b"\n" not in k and (self.edges[k[-1]] or k[-1] > 127 and len(k) > 1 and self.lead[k[-2]]) and (self.opens[k[0]] or k[0] == 32 and len(k) > 1 and self.opens[k[1]]):
                at_once.append(i)
            else:
                out[i] = self.one(k.decode()).astype(f"<u{self.width}").tobytes()
        for a in range(0, len(at_once), 5000):
            part = at_once[a : a + 5000]
            ids = self.one(b"\n".join(strings[i] for i in part).decode())
            ends = np.flatnonzero(ids == self.line)
            if len(ends) != len(part) - 1:  # some string was cut in another way than expected: one by one
                for i in part:
                    out[i] = self.one(strings[i].decode()).astype(f"<u{self.width}").tobytes()
                continue
            packed = ids.astype(f"<u{self.width}").tobytes()
            for i, p, q in zip(part, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                out[i] = packed[p * self.width : q * self.width]
        return out

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(data)
        cut = np.zeros(n + 1, bool)
        solid = self.visible[data]
        solid[1:] |= (data[1:] >= 128) & self.two[data[:-1]]
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        letter = self.letter[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 128) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        after_letter = np.zeros(n, bool)
        after_letter[1:] = letter[:-1]
        opens = np.zeros(n, bool)
        opens[:-1] = (self.visible | self.two)[data[1:]]
        starts_text = np.zeros(n + 1, bool)
        starts_text[offsets] = True
        line = (data == 10) & before & opens & ~starts_text[1:] & ~starts_text[:-1]
        cut[:-1] = (data == 32) & before | self.mark[data] & after_letter | line
        cut[1:] |= line
        cut |= starts_text
        return np.flatnonzero(cut[:-1])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not self.fast:
            for t in texts.to_pylist():
                yield self.one(t or "")
            return
        for _, data, offsets in pieces(texts, _CHUNK):
            whole = data.tobytes()
            if not whole:
                yield from (np.zeros(0, np.uint32) for _ in range(len(offsets) - 1))
                continue
            if any(s in whole for s in self.special):
                for i, j in zip(offsets[:-1], offsets[1:], strict=True):
                    yield self.one(whole[i:j].decode())
                continue
            starts = self.cuts(data, offsets)
            ends = np.append(starts[1:], len(data))
            own, check = span_hashes(data, starts, ends, RAW_BYTE), span_hashes(data, starts, ends, CHECK_BYTE)
            keys, first, inverse = np.unique(own, return_index=True, return_inverse=True)
            check_keys = check[first]
            if (check_keys[inverse] != check).any():  # two strings have one hash
                for i, j in zip(offsets[:-1], offsets[1:], strict=True):
                    yield self.one(whole[i:j].decode())
                continue
            flat, start, size = self.known(whole, keys, check_keys, starts[first], ends[first])
            size = size[inverse]
            total = np.concatenate([[0], np.cumsum(size)])
            out = flat[np.repeat(start[inverse] - total[:-1], size) + np.arange(total[-1])]
            at = total[np.searchsorted(starts, offsets)]
            for i in range(len(offsets) - 1):
                yield out[at[i] : at[i + 1]]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each Python process, so that tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs(id, text) as shards under path; the manifest (shard, file, n_docs, n_ids).

    Rows go to shards by ranges of id, nulls first, repeated ids side by side in order of the text's hash,
    then the text, so that a hot id is split too. A null text is empty and has the end id alone. path must
    be in a store that all executors share.
    """
    small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer)
        fs, base = pafs.FileSystem.from_uri(path)
        number, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs.create_dir(base, recursive=True)
        file = f"{base}/{number:06d}-{own}.sst"
        n, last, again = 0, (), 0
        with fs.open_output_stream(f"{file}.part") as out:
            shard = ShardWriter(out, encoder.width)
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                    again = again + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    shard.add(key_of(doc_id, again), np.append(ids, end_id).astype(f"<u{encoder.width}").tobytes())
                    n += 1
            shard.close()
        fs.move(f"{file}.part", file)
        yield pa.RecordBatch.from_pydict({"shard": [number], "file": [file.rpartition("/")[2]], "n_docs": [n], "n_ids": [shard.ids]})

    order = [F.col("id").asc_nulls_first(), F.col("h")]
    rows = docs.select("id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text")
    return stage(spark, rows.mapInArrow(write, "shard long, file string, n_docs long, n_ids long"), "manifest")


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, in the shards' order, from the files."""
    ahead = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")  # one row per shard
    shards = manifest.where("n_docs > 0").select("file", ahead.alias("ahead"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(f"{base}/{file}") as f:
                    for doc_id, ids in ShardReader(f).scan():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return shards.repartition(max(1, manifest.count())).mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["id", "start", "n_tokens", "ids_crc32"])


def tokenized(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as shards in the shared folder and reads them back: id_col, start, n_tokens,
    ids_crc32, one row per row of docs."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = new_path(spark, "shards")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read_shards(write_shards(spark, rows, path, tokenizer), path).withColumnRenamed("id", id_col)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark, table(spark, sf_dir, "documents"))
