"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and so have some pairs of features. The
tables are the sums of shallow trees that are boosted in turn, feature by feature, on the logistic
loss; pairs are chosen by what they can still explain. A score is the sigmoid of a sum of table
entries, so scoring is bin searches and additions over whole Arrow batches.

Features are statistics of the bytes and words of the whole text. Labels, language, source and id are
no features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table
from .shingles import pieces, span_hashes, word_bounds

#: At most so many labelled rows are learnt from, those with the least hash of their id.
MAX_LABELLED = 20_000
THRESHOLD = 0.3
_B = np.arange(256)
_KINDS = {
    "upper": (_B >= 65) & (_B <= 90),
    "lower": (_B >= 97) & (_B <= 122),
    "digit": (_B >= 48) & (_B <= 57),
    "space": (_B == 32),
    "line": (_B == 10),
    "stop": np.isin(_B, [*b".,;:?"]),
    "shout": _B == 33,
    "bar": _B == 124,
    "sign": np.isin(_B, [*b"#$%&*@^~<>{}[]\\/=+_`"]),
    "high": _B >= 128,
}
FEATURES = ["log_bytes", "log_words", "word_bytes", *_KINDS, "upper_share", "distinct_words", "distinct_lines", "line_words"]


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; a null text is empty."""
    out = []
    for _, data, offsets in pieces(texts):
        n = len(offsets) - 1
        size = np.diff(offsets)
        kinds = []
        for member in _KINDS.values():
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(member[data], out=sums[1:])
            kinds.append(np.diff(sums[offsets]))
        starts, ends, at = word_bounds(data, offsets)
        words = np.diff(at)
        hashes = span_hashes(data, starts, ends)
        length = np.concatenate([[0], np.cumsum(ends - starts)])
        new_line = np.flatnonzero(data == 10)
        edges = np.union1d(offsets, new_line + 1)
        lines = span_hashes(data, edges[:-1], edges[1:])
        line_at = np.searchsorted(edges, offsets)
        distinct = np.array([[len(np.unique(hashes[at[i] : at[i + 1]])), len(np.unique(lines[line_at[i] : line_at[i + 1]]))] for i in range(n)])
        one = lambda x: np.maximum(x, 1)
        kind = dict(zip(_KINDS, kinds, strict=True))
        n_lines = np.diff(line_at)
        out.append(
            np.column_stack(
                [
                    np.log1p(size), np.log1p(words), np.diff(length[at]) / one(words), *[k / one(size) for k in kinds],
                    kind["upper"] / one(kind["upper"] + kind["lower"]), distinct[:, 0] / one(words), distinct[:, 1] / one(n_lines), words / one(n_lines),
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A value for each bin: a shallow tree on one feature, from sums by bin."""
    parts, value = [(0, len(gradient))], np.zeros(len(gradient))
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
    while len(parts) < leaves:
        best = (1e-9, None)
        for p, (a, b) in enumerate(parts):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = score(a, cut) + score(cut, b) - score(a, b)
                c = int(gain.argmax())
                if gain[c] > best[0]:
                    best = (float(gain[c]), (p, a, int(cut[c]), b))
        if best[1] is None:
            break
        p, a, c, b = best[1]
        parts[p : p + 1] = [(a, c), (c, b)]
    for a, b in parts:
        value[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return value


class Model:
    """Edges and tables; ``score`` gives a number from 0 to 1 for each row of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 32, cycles: int = 80, pairs: int = 8, rate: float = 0.15):
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
        self.coarse = [e[:: max(1, len(e) // 7)] for e in self.edges]
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1))) if n else 0.0
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not n:
            return
        codes = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        small = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]
        raw = np.full(n, self.base)
        for _ in range(cycles):
            for f in range(m):
                p = 1 / (1 + np.exp(-raw))
                step = rate * _tree(np.bincount(codes[f], y - p, len(self.tables[f])), np.bincount(codes[f], p * (1 - p), len(self.tables[f])), 3)
                self.tables[f] += step
                raw += step[codes[f]]
        p = 1 / (1 + np.exp(-raw))
        gains = []
        for f in range(m):
            for g in range(f + 1, m):
                cells = (len(self.coarse[f]) + 1) * (len(self.coarse[g]) + 1)
                code = small[f] * (len(self.coarse[g]) + 1) + small[g]
                gains.append((float((np.bincount(code, y - p, cells) ** 2 / (np.bincount(code, p * (1 - p), cells) + 1)).sum()), f, g))
        chosen = [(f, g, np.zeros((len(self.coarse[f]) + 1, len(self.coarse[g]) + 1))) for _, f, g in sorted(gains, reverse=True)[:pairs]]
        for _ in range(cycles // 2):
            for f, g, grid in chosen:
                p = 1 / (1 + np.exp(-raw))
                code = small[f] * grid.shape[1] + small[g]
                s, h = (np.bincount(code, v, grid.size).reshape(grid.shape) for v in (y - p, p * (1 - p)))
                rows = _tree(s.sum(axis=1), h.sum(axis=1), 2)  # a split on one feature, then on the other in each part
                step = np.zeros(grid.shape)
                for v in np.unique(rows):
                    step[rows == v] = _tree(s[rows == v].sum(axis=0), h[rows == v].sum(axis=0), 2)
                grid += rate * step
                raw += rate * step[small[f], small[g]]
        self.pairs = chosen

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for f, e in enumerate(self.edges):
            raw += self.tables[f][np.searchsorted(e, x[:, f], "right")]
        for f, g, grid in self.pairs:
            raw += grid[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-raw))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from at most max_labelled documents of docs(doc_id, text) with a label (doc_id, quality), none
    of them in fold 0: those with the least hash of their id. They come to the driver as features. Labels
    that are null, or that differ for one id, count for nothing; rows that repeat an id count once, with
    the least of their texts (a null text is empty)."""
    small_batches(spark)
    chosen = (
        labels.where((fold(F.col("doc_id")) != 0) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.min("quality").cast("long").alias("quality"), F.max("quality").cast("long").alias("most"))
        .where("quality = most")
        .select("label_id", "quality")
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "label_id").groupBy("label_id", "quality").agg(F.min("text").alias("text"))  # at most max_labelled

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    found = sorted((r.id, r.y, tuple(r.x)) for r in rows.mapInArrow(extract, "id long, y long, x array<double>").toLocalIterator())
    return Model(np.array([r[2] for r in found]).reshape(len(found), len(FEATURES)), np.array([float(r[1]) for r in found]))


def scored(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, whatever its ids; null texts are empty."""
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def accepted(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model accepts, all columns as they are."""
    small_batches(spark)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at).cast(pa.string()))) >= threshold))

    return docs.mapInArrow(keep, T.StructType(docs.schema.fields))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(spark, docs, fit(spark, docs, table(spark, sf_dir, "labels")))
