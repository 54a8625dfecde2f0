"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics are taken from the whole text in numpy. Trees are grown level by level on binned statistics: gradient and
hessian histograms per node and bin, the best cut by gain. They are flattened into arrays of equal shape, one row per
tree, so that a batch of documents walks all trees with a few indexing steps per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brightwell.llm.batches import map_batches, pieces, texts_of

STATISTICS = ("bytes_log", "words_log", "word_length", "upper", "lower", "digit", "blank", "punctuation", "symbol",
              "other_bytes", "distinct_words", "repeats_next", "longest_run", "lines_log", "line_length",
              "distinct_lines", "symbol_ends", "upper_starts", "sentence_ends")
#: Bound of the sample that the model is fitted on.
SAMPLE_ROWS = 20_000
_CLASS = np.zeros(256, dtype=np.int64)
for _chars, _kind in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b" \t\n\x0b\x0c\r", 4),
                      (b".,;:!?'\"()-", 5), (b"#$%&*+/<=>@[\\]^_`{|}~", 6), (range(128, 256), 7)):
    for _byte in _chars:
        _CLASS[_byte] = _kind


def statistics(text: str) -> list[float]:
    """One number for each of ``STATISTICS``; an empty text gives zeros."""
    data = text.encode("utf-8", "surrogatepass")
    words, lines = text.split(), text.split("\n")
    size, count = len(data), len(words)
    if not count:
        return [float(np.log1p(size))] + [0.0] * (len(STATISTICS) - 1)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256), minlength=8)
    same = list(map(eq, words, words[1:]))
    repeats = sum(same)
    longest = max(map(len, bytes(same).split(b"\0"))) + 1 if repeats else 1
    tail = [w[-1] for w in words]
    symbols = sum(map(tail.count, "#$%&*|!"))
    stops = tail.count(".") + tail.count("?")
    share = kinds / size
    return [float(np.log1p(size)), float(np.log1p(count)), size / count, *share[1:8].tolist(),
            len(set(words)) / count, repeats / count, float(np.log(longest)), float(np.log(len(lines))),
            float(np.log(size / len(lines))), len(set(lines)) / len(lines), symbols / count,
            sum(w[0].isupper() for w in words) / count, stops / count]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: ``feature`` and ``cut`` by tree and inner node, ``value`` by tree and leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def arrays(self) -> tuple:
        return self.feature, self.cut, self.value, self.base

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1. At node k a value above the cut goes to node 2k+2, else to 2k+1."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(rows), 1 / (1 + np.exp(-self.base)))
        node = np.zeros((len(rows), trees), dtype=np.int64)
        tree = np.arange(trees)
        at = np.arange(len(rows))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (rows[at, self.feature[tree, node]] > self.cut[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node - inner].sum(axis=1))))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 64,
         smoothing: float = 1.0, least: float = 2.0) -> Forest:
    """Boosts trees on the logistic loss. Equal rows or one label alone give trees without effect."""
    y = labels.astype(np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, inner, columns = float(np.log(share / (1 - share))), 2 ** depth - 1, rows.shape[1]
    feature = np.zeros((trees, inner), dtype=np.int64)
    cut = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    if not len(y) or y.min() == y.max():
        return Forest(feature[:0], cut[:0], value[:0], base)
    edges = [np.unique(np.quantile(rows[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(columns)]
    binned = np.stack([np.searchsorted(e, rows[:, c], side="left") for c, e in enumerate(edges)], axis=1)
    offset = np.arange(columns) * bins
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            slot = ((node - first)[:, None] * (columns * bins) + offset + binned).ravel()
            size = width * columns * bins
            g = np.bincount(slot, np.repeat(gradient, columns), size).reshape(width, columns, bins).cumsum(axis=2)
            h = np.bincount(slot, np.repeat(hessian, columns), size).reshape(width, columns, bins).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = (g ** 2 / (h + smoothing) + (g_all - g) ** 2 / (h_all - h + smoothing)
                    - g_all ** 2 / (h_all + smoothing))
            gain[(h < least) | (h_all - h < least)] = 0
            for c, e in enumerate(edges):
                gain[:, c, len(e):] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                c, b = divmod(int(best[k]), bins)
                if gain[k, c, b] > 1e-9:
                    feature[t, first + k], cut[t, first + k] = c, edges[c][b]
            node = 2 * node + 1 + (rows[np.arange(len(y)), feature[t, node]] > cut[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + smoothing)
        margin += value[t, leaf]
    return Forest(feature, cut, value, base)


def with_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, statistics) for every row."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = [statistics(x) for x in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, type=pa.list_(pa.float64()))],
                                             ["doc_id", "statistics"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, measure, "doc_id long, statistics array<double>")


def fit(df: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        rows: int = SAMPLE_ROWS, **options) -> Forest:
    """Grows trees on at most ``rows`` labelled documents, the first in order of a hash of their ids.

    ``learn`` is a condition on the column doc_id. The driver receives statistics, never texts.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen.select("doc_id").distinct()), "doc_id")  # at most ``rows`` numbers
    found = with_statistics(texts, "doc_id", "text").join(F.broadcast(chosen), "doc_id").toPandas()
    found = found.assign(key=found["statistics"].map(tuple)).sort_values(["doc_id", "key", "label"])
    data = np.array(found["statistics"].tolist(), dtype=np.float64).reshape(len(found), len(STATISTICS))
    return grow(data, found["label"].to_numpy(), **options)


def score(df: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row from its whole text; null counts as empty."""
    shipped = df.sparkSession.sparkContext.broadcast(forest.arrays())  # trees * 2 ** depth numbers

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(*shipped.value)
        for part in pieces(batches, "text"):
            rows = np.array([statistics(x) for x in texts_of(part, "text")])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.scores(rows))], ["doc_id", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, rate, "doc_id long, score double")


def keep_scored(df: DataFrame, forest: Forest, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns and in one pass without a shuffle."""
    shipped = df.sparkSession.sparkContext.broadcast(forest.arrays())
    schema = df.schema

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(*shipped.value)
        for part in pieces(batches, text_col):
            rows = np.array([statistics(x) for x in texts_of(part, text_col)])
            yield part.filter(pa.array(own.scores(rows) >= least))

    return map_batches(df, choose, schema)
