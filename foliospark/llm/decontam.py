"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case, so that case, spacing
and punctuation do not matter. A shingle is five words (the whole sequence in shorter items), and its
weight is the number of times it occurs.

Windows of a document as long as an item (the whole document if it is shorter) are fingerprinted from
prefix sums of shingle bits. A window most of whose shingles are in no item of its length cannot be
similar enough to any and is left out first; that bound is exact and names no item. Candidates come
from the multi-index alone: fingerprints are cut into BLOCKS blocks, and a window meets the items that
differ from it by at most ``near`` bits in one block. Two fingerprints at most BLOCKS * (near + 1) - 1
bits apart (the radius) have such a block, so none within the radius is missed. Candidates are confirmed
by exact weighted similarity: sum of least weights over sum of greatest weights, at least 0.8 unless
told otherwise.

At similarity 0.8 fingerprints differ by 10 of 64 bits on average, with a deviation of 3. ``near`` is
chosen for the least similarity such that the radius is two deviations above (15 bits at 0.8), which
reaches 97 % of the pairs there and more above. Measured recall is in the tests.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table
from .shingles import SEPARATORS, shingle_rows, text_words

WORDS, PERCENT = 5, 80
#: Blocks of a fingerprint, and their bits.
BLOCKS, WIDTH = 4, 16
#: Items are taken in blocks of so many bytes of text; each block is one pass over the documents.
ITEM_BYTES = 32 << 20
_BITS = np.arange(64, dtype=np.uint64)
#: Windows that are fingerprinted, and candidates that are looked up, at once.
_PART, _LOOKUP = 4096, 256


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each shingle."""
    return ((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=-1, dtype=np.uint64)


def block_values(prints: np.ndarray) -> np.ndarray:
    """The BLOCKS numbers of each fingerprint."""
    shifts = np.arange(BLOCKS, dtype=np.uint64) * np.uint64(WIDTH)
    return ((prints[:, None] >> shifts) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def near_bits(percent: int) -> int:
    """Bits by which a window and an item may differ in the block where they meet."""
    s = percent / 100
    p = math.acos(2 * s / (1 + s)) / math.pi  # for a bit to differ at this similarity
    return -(-(int(64 * p + 2 * math.sqrt(64 * p * (1 - p))) + 1) // BLOCKS) - 1


def _within(known: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which rows are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, rows), len(known) - 1)] == rows


class Items:
    """A block of benchmark items in flat arrays, ready for lookup."""

    def __init__(self, ids: list, texts: list, percent: int = PERCENT):
        self.percent, near = percent, near_bits(percent)
        self.radius = BLOCKS * (near + 1) - 1
        #: The differences of at most near bits in a block.
        self.masks = np.array([sum(1 << i for i in bits) for n in range(near + 1) for bits in itertools.combinations(range(WIDTH), n)], np.int64)
        values, weights, prints, kinds, own = [], [], [], [], []
        for i, words in zip(ids, text_words(pa.array(texts, pa.string()), SEPARATORS), strict=True):
            if len(words):
                k = min(WORDS, len(words))
                rows = shingle_rows(words, k)
                v, w = np.unique(rows, return_counts=True)
                values.append(v)
                weights.append(w.astype(np.int32))
                prints.append(fingerprint(signs(rows).sum(axis=0)))
                kinds.append((k, len(words), len(rows)))
                own.append(i)
        self.ids = own
        self.values, self.weights = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (values, weights))
        self.at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
        self.prints = np.array(prints, np.uint64)
        self.k, self.size, self.total = np.array(kinds, np.int64).reshape(-1, 3).T
        both = {(int(k), int(size)) for k, size in zip(self.k, self.size, strict=True)}
        self.known = {k: np.unique(np.concatenate([values[n] for n in np.flatnonzero(self.k == k)])) for k in sorted({k for k, _ in both})}
        self.known_of = {(k, size): np.unique(np.concatenate([values[n] for n in np.flatnonzero((self.k == k) & (self.size == size))])) for k, size in sorted(both)}
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.values.astype(np.uint64) & np.uint64((1 << 22) - 1)] = True
        # for each block its value and the item, in order: lookups are searches, whatever the number of items
        codes = block_values(self.prints) + (np.arange(BLOCKS) << WIDTH)
        order = np.argsort(codes.ravel(), kind="stable")
        self.owner = np.repeat(np.arange(len(own)), BLOCKS)[order]
        self.first = np.searchsorted(codes.ravel()[order], np.arange((BLOCKS << WIDTH) + 1))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the fingerprint, item) of all pairs that meet in a block and are within the radius."""
        found = []
        for p in range(0, len(prints), _LOOKUP):
            part = prints[p : p + _LOOKUP]
            codes = (block_values(part) + (np.arange(BLOCKS) << WIDTH))[:, :, None] ^ self.masks
            low = self.first[codes]
            count = self.first[codes + 1] - low
            window, block, mask = np.nonzero(count)
            low, count = low[window, block, mask], count[window, block, mask]
            window = np.repeat(window, count)
            item = self.owner[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
            near = np.bitwise_count(part[window] ^ self.prints[item]) <= self.radius
            found.append(np.unique((window[near] + p) * max(len(self.ids), 1) + item[near]))
        pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
        return np.divmod(pairs, max(len(self.ids), 1))

    def matches(self, words: np.ndarray) -> Iterator[tuple]:
        """(item id, first word, words, common, union) of the best window for each item found, the first of equal ones."""
        n_words = len(words)
        for k, known in self.known.items():
            if n_words < k:
                continue
            rows = shingle_rows(words, k)
            at = np.flatnonzero(self.maybe[rows & np.uint64((1 << 22) - 1)])
            if not len(at):
                continue
            at = at[_within(known, rows[at])]
            if not len(at):
                continue
            best: dict[int, tuple] = {}
            for size in np.unique(np.minimum(self.size[self.k == k], n_words)).tolist():
                of_size = (self.k == k) & (self.size == size if size < n_words else self.size >= n_words)
                width, least = size - k + 1, -(-self.percent * int(self.total[of_size].min()) // 100)
                held = at[_within(self.known_of[k, size], rows[at])] if size < n_words else at
                if len(held) < least:
                    continue
                shared = np.zeros(len(rows) + 1, np.int64)
                shared[held + 1] = 1
                shared = np.cumsum(shared)
                starts = np.flatnonzero(shared[width:] - shared[: len(shared) - width] >= least)
                for p in range(0, len(starts), _PART):
                    self._compare(rows, starts[p : p + _PART], width, of_size, size, best)
            yield from ((self.ids[n], *best[n]) for n in sorted(best))

    def _compare(self, rows: np.ndarray, starts: np.ndarray, width: int, of_size: np.ndarray, size: int, best: dict[int, tuple]) -> None:
        prints = np.empty(len(starts), np.uint64)
        # prefix sums over each run of windows that overlap
        for run in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > width) + 1):
            a, b = int(starts[run[0]]), int(starts[run[-1]]) + width
            for c in range(a, b - width + 1, 1 << 16):
                some = run[(starts[run] >= c) & (starts[run] < c + (1 << 16))]
                sums = self._sums(rows[c : min(b, c + (1 << 16) + width)], starts[some] - c, width)
                prints[some] = fingerprint(sums)
        window, item = self.candidates(prints)
        keep = of_size[item]
        for w, n in zip(window[keep].tolist(), item[keep].tolist(), strict=True):
            s = int(starts[w])
            values, weights = self.values[self.at[n] : self.at[n + 1]], self.weights[self.at[n] : self.at[n + 1]]
            found, times = np.unique(rows[s : s + width], return_counts=True)
            _, x, y = np.intersect1d(found, values, assume_unique=True, return_indices=True)
            common = int(np.minimum(times[x], weights[y]).sum())
            union = width + int(self.total[n]) - common
            old = best.get(n)
            if 100 * common >= self.percent * union and (old is None or common * old[3] > old[2] * union):
                best[n] = (s, size, common, union)

    @staticmethod
    def _sums(rows: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """Sums of the signs of rows[start:start + width], by prefix sums; very wide windows go one by one."""
        if len(rows) > 1 << 18:
            return np.array([sum(signs(rows[i : min(i + (1 << 16), s + width)]).sum(axis=0) for i in range(s, s + width, 1 << 16)) for s in starts.tolist()])
        sums = np.zeros((len(rows) + 1, 64), np.int32)
        np.cumsum(signs(rows), axis=0, dtype=np.int32, out=sums[1:])
        return sums[starts + width] - sums[starts]


def item_blocks(benchmark: DataFrame, percent: int) -> Iterator[Items]:
    """The benchmark in blocks of bounded size; each goes to the tasks whole."""
    ids, texts, size = [], [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        ids.append(item_id)
        texts.append(text)
        size += len(text or "")
        if size >= ITEM_BYTES:
            yield Items(ids, texts, percent)
            ids, texts, size = [], [], 0
    yield Items(ids, texts, percent)


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_common, n_union): the best window of each document for
    each item whose similarity n_common / n_union is high enough.

    Null or empty texts and items match nothing; ids may be null or repeated (a row for each); other
    columns are ignored; empty tables give an empty result.
    """
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in item_blocks(benchmark, percent):

        def find(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[i], *m) for i, words in enumerate(text_words(batch.column(1), SEPARATORS)) for m in items.matches(words)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "item_id", "first_word", "n_words", "n_common", "n_union"])

        part = rows.mapInArrow(find, "doc_id long, item_id long, first_word long, n_words long, n_common long, n_union long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs in which no benchmark item is found, all columns as they are."""
    small_batches(spark)
    at = docs.columns.index("text")
    schema = T.StructType(docs.schema.fields)
    for items in item_blocks(benchmark, percent):

        def keep(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = [next(items.matches(words), None) is None for words in text_words(batch.column(at).cast(pa.string()), SEPARATORS)]
                yield batch.filter(pa.array(mask, pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
