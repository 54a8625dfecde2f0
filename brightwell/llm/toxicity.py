"""Toxicity by subword bags: embeddings of words and their character n-grams, averaged into a linear softmax.

The unit that is averaged is a window of a few consecutive words; a document is as toxic as its most toxic window, so a
single insult is not thinned out by a long text. Embeddings and softmax are trained jointly in numpy. Labels belong to
documents, so training alternates: choose the most suspicious window of every document under the present model, then
take a gradient step on these windows. Words that share n-grams share vectors, hence unseen spellings of known words
still score. Averaging and the softmax are linear, so once trained each n-gram carries one number and a word's sum of
them is computed once per distinct word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brightwell.llm.batches import Numbered, map_batches, pieces, spread, texts_of

SHORTEST, LONGEST = 3, 6
#: Bounds of the sample that the model is fitted on.
SAMPLE_ROWS_PER_LABEL, SAMPLE_CHARS = 4_000, 6_000
WORDS_AT_ONCE = 1 << 14
SPLIT = re.compile(r"[\s.,;:!?\"()\[\]{}|<>/]+")


def hashed(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``<word>`` for all lengths and the word as a whole, as buckets: flat values, number per word."""
    data = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(len(data))  # characters to the end of the word, this one included
    code, found, owner = np.zeros(len(data), dtype=np.uint64), [], []
    position_owner = np.repeat(np.arange(len(words)), sizes)
    for n in range(1, LONGEST + 1):
        tail = data[n - 1:]
        code = (code[:len(tail)] * np.uint64(1_000_003) + tail + np.uint64(1)) & np.uint64(0xFFFFFFFFFFFF)
        if n >= SHORTEST:
            keep = left[:len(tail)] >= n
            found.append((code[keep] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40))
            owner.append(position_owner[:len(tail)][keep])
    whole = np.zeros(len(words), dtype=np.uint64)
    place = (np.arange(len(data)) - np.repeat(starts, sizes) + 7).astype(np.uint64)
    np.add.at(whole, position_owner, data * place ** np.uint64(3))
    found.append((whole * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40))
    owner.append(np.arange(len(words)))
    owner, found = np.concatenate(owner), np.concatenate(found).astype(np.int64) % buckets
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=len(words))


def grams_of(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``hashed`` for many words, in parts and with small numbers, so that little memory is taken at a time."""
    found, numbers = [], []
    for k in range(0, len(words), WORDS_AT_ONCE):
        grams, counts = hashed(words[k:k + WORDS_AT_ONCE], buckets)
        found.append(grams.astype(np.int32))
        numbers.append(counts)
    return np.concatenate(found), np.concatenate(numbers)


@dataclass(frozen=True)
class SubwordModel:
    """``weights`` holds for each bucket its embedding times the difference of the two softmax rows."""

    weights: np.ndarray
    bias: float
    window: int

    def word_sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buckets, counts = hashed(words, len(self.weights))
        ends = np.cumsum(counts)
        sums = np.add.reduceat(self.weights[buckets].astype(np.float64), ends - counts)
        return sums, counts

    def scores(self, table: Numbered, texts: list[str]) -> np.ndarray:
        """The probability of label 1 for the most toxic window of each text; without words the bias alone speaks."""
        split = [tokens(x) for x in texts]
        at = table.numbers([w for words in split for w in words])
        logits, start = np.full(len(texts), self.bias), 0
        for k, words in enumerate(split):
            if words:
                own = at[start:start + len(words)]
                logits[k] = self.bias + window_means(table.columns[0][own], table.columns[1][own], self.window).max()
                start += len(words)
        return 1 / (1 + np.exp(-logits))


def tokens(text: str) -> list[str]:
    return [w for w in SPLIT.split(text.lower()) if w]


def window_means(sums: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """The mean over all n-grams of each window of words; a shorter text is one window."""
    if len(sums) <= window:
        return np.array([sums.sum() / counts.sum()])
    total, number = np.concatenate(([0.0], np.cumsum(sums))), np.concatenate(([0], np.cumsum(counts)))
    return (total[window:] - total[:-window]) / (number[window:] - number[:-window])


def train(texts: list[str], labels: list[int], buckets: int = 1 << 18, dim: int = 16, window: int = 3,
          steps: int = 2_000, rate: float = 2.0, least_docs: int = 3, seed: int = 7) -> SubwordModel:
    """Fits embeddings and softmax jointly by gradient steps on one window per document and epoch.

    The first epochs take windows at random, the others the window with the highest score; clean documents always add a
    random one, which keeps common n-grams neutral. There are about ``steps`` steps of 64 windows. With no rows, or a
    single label, the score is a constant.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float64)
    numbers: dict[str, int] = {}
    split = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in tokens(x)), dtype=np.int32) for x in texts]
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    rate_of_label = (y.sum() + 0.5) / (len(y) + 1)
    constant = SubwordModel(np.zeros(buckets, dtype=np.float32), float(np.log(rate_of_label / (1 - rate_of_label))), window)
    if not sizes.any() or y.min() == y.max():
        return constant
    flat, y, sizes = np.concatenate(split), y[sizes > 0], sizes[sizes > 0]
    del split
    starts = np.cumsum(sizes) - sizes
    grams, counts = grams_of(list(numbers), buckets)
    del numbers
    gram_starts = np.cumsum(counts) - counts
    used = np.flatnonzero(np.bincount(grams, minlength=buckets))
    place = np.zeros(buckets, dtype=np.int32)
    place[used] = np.arange(len(used))
    grams = place[grams]
    # N-grams of fewer documents say too little to be learnt; their vectors stay zero.
    documents = np.zeros(len(used), dtype=np.int32)
    for s, n in zip(starts.tolist(), sizes.tolist()):
        words = np.unique(flat[s:s + n])
        documents += np.bincount(grams[spread(gram_starts[words], counts[words])], minlength=len(used)) > 0
    known = (documents >= least_docs).astype(np.float64)[:, None]
    embedding = rng.normal(0, 0.05, (len(used), dim)) * known
    softmax = rng.normal(0, 0.5, (dim, 2))
    bias = np.zeros(2)
    one_hot = np.stack([1 - y, y], axis=1)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)  # both labels count alike
    positions = np.maximum(sizes - window, 0) + 1
    firsts = range(0, len(counts), WORDS_AT_ONCE)
    edges = [int(gram_starts[w]) for w in firsts] + [len(grams)]
    parts = list(zip(firsts, edges, edges[1:]))
    batches = max(1, int(len(y) + (y == 0).sum()) // 64)
    epochs = max(6, -(-steps // batches))

    def hardest() -> np.ndarray:
        per_gram = embedding @ (softmax[:, 1] - softmax[:, 0])
        sums = np.concatenate([np.add.reduceat(per_gram[grams[a:b]], gram_starts[w:w + WORDS_AT_ONCE] - a)
                               for w, a, b in parts])
        return np.array([window_means(sums[flat[s:s + n]], counts[flat[s:s + n]], window).argmax()
                         for s, n in zip(starts, sizes)])

    for epoch in range(epochs):
        chance = (rng.random(len(sizes)) * positions).astype(np.int64)
        top = chance if epoch < 2 else hardest()
        docs = np.concatenate([np.arange(len(sizes)), np.flatnonzero(y == 0)])
        first = np.concatenate([top, (rng.random(len(sizes)) * positions).astype(np.int64)[y == 0]])
        order = rng.permutation(len(docs))
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(order, batches):
            d, f = docs[batch], first[batch]
            words_each = np.minimum(sizes[d], window)
            words = flat[spread(starts[d] + f, words_each)]
            each = counts[words]
            ids = grams[spread(gram_starts[words], each)]
            owner = np.repeat(np.repeat(np.arange(len(d)), words_each), each)
            number = np.bincount(owner, minlength=len(d)).astype(np.float64)
            bag_starts = np.cumsum(number.astype(np.int64)) - number.astype(np.int64)
            hidden = np.add.reduceat(embedding[ids], bag_starts) / number[:, None]
            z = hidden @ softmax + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = (z / z.sum(axis=1, keepdims=True) - one_hot[d]) * weight[d][:, None] / len(d)
            back = (error @ softmax.T) / number[:, None]
            softmax -= step * hidden.T @ error
            bias -= step * error.sum(axis=0)
            np.subtract.at(embedding, ids, step * len(d) * back[owner] * known[ids])
    weights = np.zeros(buckets, dtype=np.float32)
    weights[used] = embedding @ (softmax[:, 1] - softmax[:, 0])
    return SubwordModel(weights, float(bias[1] - bias[0]), window)


def labelled_sample(df: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str, text_col: str,
                    rows: int = SAMPLE_ROWS_PER_LABEL, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most ``rows`` documents of each label, the first in order of a hash of their ids; (doc_id, text, label).

    Documents without a text or with one longer than ``chars``, which bounds what the driver receives, are passed over
    before the choice, so that others fill their place. The choice moves ids alone; only the chosen texts move. Rows
    without an id or label never enter.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn).distinct()
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(
        F.char_length("text").between(1, chars))
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("label = 0").orderBy(*order).limit(rows).unionByName(
        known.filter("label = 1").orderBy(*order).limit(rows))
    return texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * rows pairs of numbers


def fit(df: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        rows: int = SAMPLE_ROWS_PER_LABEL, chars: int = SAMPLE_CHARS, **options) -> SubwordModel:
    """Trains on the bounded sample of ``labelled_sample``; ``learn`` is a condition on the column doc_id."""
    found = labelled_sample(df, labels, label_col, learn, id_col, text_col, rows, chars).toPandas()
    found = found.sort_values(["doc_id", "text", "label"])
    return train(found["text"].tolist(), found["label"].tolist(), **options)


def score(df: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row and its whole text; a null or empty text has the score of the bias.

    Rows that repeat or share an id are scored one by one; an empty table gives no rows. Other columns are not read.
    """
    # One float for each bucket, a fixed size; plain values, so that executors need no copy of this package.
    shipped = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.window))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SubwordModel(*shipped.value)
        table = Numbered(own.word_sums)
        for part in pieces(batches, "text"):
            found = own.scores(table, texts_of(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, rate, "doc_id long, score double")
