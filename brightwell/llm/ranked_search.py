"""Ranked lexical search over hashed max-sketches.

The index holds one row per document: its distinct terms with their counts, and a sketch in which every term is hashed to
one of 65,536 coordinates and a coordinate keeps the largest count of its terms. A term's impact grows with its count, so
the impact computed from a coordinate's maximum is at least that of any of its terms; the sketch needs no statistics of the
corpus and stays valid when documents are added. Search takes the queries in blocks: each task reads sketches in batches,
sums up a query's weighted coordinate impacts into upper bounds, and rescores documents exactly from their terms, by
descending bound, until no bound reaches the last place of the query's running top.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from brightwell.llm.batches import map_batches, pieces
from brightwell.llm.decontaminate import words
from brightwell.llm.shared import LOWER, UPPER, ascii_lower, written

COORDINATES = 1 << 16
#: Terms of the queries that are sent to the tasks at once; a block holds one query at least.
BLOCK_TERMS = 100_000
#: Documents whose bounds are in memory at a time.
DOCUMENTS_AT_ONCE = 1024
#: Stands for a missing id while rows are ranked, where it comes last.
NO_ID = (1 << 63) - 1
#: Letters and digits stay, A-Z in lower case; other ASCII characters part terms.
TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).translate(
    bytes.maketrans(UPPER.encode(), LOWER.encode()))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in order: maximal runs of ASCII letters, digits and all other characters beyond ASCII."""
    return text.translate(TABLE).split(b" ") if text else []


def coordinates(terms: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return np.fromiter((digest(t) & (COORDINATES - 1) for t in terms), dtype=np.int64, count=len(terms))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, places, maxima, terms, counts) for every row that has a term, written out.

    ``size`` counts terms with repeats; ``places`` are the sketch's occupied coordinates and ``maxima`` their values.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            ids, sizes, found, places, maxima = [], [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                counts = Counter(filter(None, terms_of(text or b"")))
                if not counts:
                    continue
                tf = np.fromiter(counts.values(), dtype=np.int32, count=len(counts))
                at, inverse = np.unique(coordinates(list(counts)), return_inverse=True)
                most = np.zeros(len(at), dtype=np.int32)
                np.maximum.at(most, inverse, tf)
                ids.append(doc_id)
                sizes.append(int(tf.sum()))
                found.append((list(counts), tf))
                places.append(at.astype(np.int32))
                maxima.append(most)
            if not ids:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.int64()), pa.array(sizes, type=pa.int64()), listed(places), listed(maxima),
                 listed_terms([t for t, _ in found]), listed([n for _, n in found])],
                ["doc_id", "size", "places", "maxima", "terms", "counts"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return written(map_batches(rows, run, "doc_id long, size long, places array<int>, maxima array<int>, "
                                          "terms array<string>, counts array<int>"), "search-index")


def offsets(lengths: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def listed(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(offsets([len(v) for v in values]), pa.array(np.concatenate(values), type=pa.int32()))


def listed_terms(values: list[list[bytes]]) -> pa.Array:
    flat = pa.array(list(chain.from_iterable(values)), type=pa.binary()).cast(pa.string())
    return pa.ListArray.from_arrays(offsets([len(v) for v in values]), flat)


def weight(total: int, holding: Column) -> Column:
    """A term's weight from the number of documents and of those that hold it."""
    return F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * holding + 1))).cast("long")


def weighted_queries(index: DataFrame, items: DataFrame, total: int, id_col: str, text_col: str) -> DataFrame:
    """(query, item_id, terms, weights), one row per item that has terms some document holds; ``query`` numbers the rows.

    Rows that share an id are one item. Document frequencies are counted over the whole index, in partial sums.
    """
    asked = items.select(F.col(id_col).alias("item_id"), F.explode(words(F.col(text_col))).alias("term")).select(
        "item_id", ascii_lower(F.col("term")).alias("term")).distinct()
    holding = index.select(F.explode("terms").alias("held")).groupBy("held").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(holding, F.col("term") == F.col("held"))
    entry = F.struct("term", weight(total, F.col("df")).alias("w"))
    lists = known.groupBy("item_id").agg(F.sort_array(F.collect_list(entry)).alias("e")).select(
        "item_id", F.col("e.term").alias("terms"), F.col("e.w").alias("weights"))
    return written(lists.withColumn("query", F.monotonically_increasing_id()), "queries")


def blocks(queries: DataFrame) -> Iterator[list]:
    """The queries in blocks of ``BLOCK_TERMS`` terms at most, or of one longer query."""
    block, size = [], 0
    for row in queries.select("query", "terms", "weights").toLocalIterator():
        if block and size + len(row.terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row.query, [t.encode() for t in row.terms], np.array(row.weights, dtype=np.int64)))
        size += len(row.terms)
    if block:
        yield block


class Top:
    """The ``k`` best (score, smallest id first) of one query seen so far."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def last(self) -> tuple[int, int]:
        """Score and id of the last place, which a document must beat."""
        return (self.heap[0][0], -self.heap[0][1]) if len(self.heap) == self.k else (0, -1)

    def offer(self, score: int, doc_id: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -doc_id))
        else:
            heapq.heappushpop(self.heap, (score, -doc_id))


def impacts(counts: np.ndarray, base: np.ndarray | int) -> np.ndarray:
    """The part of a term's score that its count and the document's length give; it grows with the count."""
    counts = counts.astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 20 * base)


def bounds_of(places: np.ndarray, maxima: np.ndarray, starts: np.ndarray, bases: np.ndarray, asked: np.ndarray,
              weights: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Upper bounds, one row per document and one column per query of the block."""
    out = np.zeros((len(bases), len(firsts)), dtype=np.int64)
    values = impacts(maxima, np.repeat(bases, np.diff(starts)))
    dense = np.zeros(COORDINATES, dtype=np.int64)
    for d in range(len(bases)):
        own = slice(starts[d], starts[d + 1])
        dense[places[own]] = values[own]
        out[d] = np.add.reduceat(dense[asked] * weights, firsts)
        dense[places[own]] = 0
    return out


def best_of_tasks(index: DataFrame, block: list, total: int, length: int, k: int) -> DataFrame:
    """(query, doc_id, score): the ``k`` best documents of every task for each query of the block."""
    spark = index.sparkSession
    shipped = spark.sparkContext.broadcast((block, total, length))  # BLOCK_TERMS at most, or one query

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, length = shipped.value
        lengths = np.array([len(t) for _, t, _ in block])
        firsts = np.cumsum(lengths) - lengths
        asked = coordinates([t for _, own, _ in block for t in own])
        weights = np.concatenate([w for _, _, w in block])
        pairs = [list(zip(t, w.tolist())) for _, t, w in block]
        tops = [Top(k) for _ in block]
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(at, DOCUMENTS_AT_ONCE)
                ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
                bases = 50 + 50 * batch.column("size").to_numpy().astype(object) * total // length  # beyond 64 bits at need
                bases = bases.astype(np.int64)
                starts = np.concatenate([[0], np.cumsum(batch.column("places").value_lengths().to_numpy())])
                bounds = bounds_of(batch.column("places").flatten().to_numpy(), batch.column("maxima").flatten().to_numpy(),
                                   starts, bases, asked, weights, firsts)
                rescore(batch, ids, bases.tolist(), bounds, pairs, tops)
        rows = [(block[q][0], -d, s) for q, top in enumerate(tops) for s, d in top.heap]
        query, doc_id, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (query, doc_id, score)],
                                         ["query", "doc_id", "score"])

    return map_batches(index.select("doc_id", "size", "places", "maxima", "terms", "counts"), run,
                       "query long, doc_id long, score long")


def rescore(batch: pa.RecordBatch, ids: np.ndarray, bases: list[int], bounds: np.ndarray, pairs: list, tops: list[Top]) -> None:
    """Offers exact scores to each query's top, by descending bound, until the bounds fall below its last place."""
    terms, counts, opened = batch.column("terms"), batch.column("counts"), {}
    for q, top in enumerate(tops):
        column = bounds[:, q]
        score, doc_id = top.last()
        able = np.flatnonzero((column > score) | ((column == score) & (ids < doc_id)))
        order = able[np.lexsort((ids[able], -column[able]))].tolist()
        for d in order:
            score, doc_id = top.last()
            if column[d] < score:
                break
            if column[d] == score and ids[d] >= doc_id:
                continue
            if d not in opened:
                spelled = terms[d].values.cast(pa.binary()).to_pylist()
                opened[d] = dict(zip(spelled, impacts(counts[d].values.to_numpy(), bases[d]).tolist()))
            known = opened[d]
            exact = sum(w * known[t] for t, w in pairs[q] if t in known)
            if exact > score or (exact == score > 0 and ids[d] < doc_id):
                top.offer(exact, int(ids[d]))


def search(index: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, scores above zero only.

    Equal scores come by ascending doc_id, a missing id last; rows that share an id are ranked one by one. Items that
    share an id are one item with the terms of all; null and empty texts have no terms and get no rows, as do all items
    over an empty index. Every task keeps ``k`` documents per query, so the last ranking meets at most ``k`` rows of a
    task and query.
    """
    totals = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("l")).first()
    queries = weighted_queries(index, items, totals.n, item_col, text_col)
    found = [best_of_tasks(index, block, totals.n, totals.l, k) for block in blocks(queries)]
    if not found:
        empty = queries.select("query", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
        found = [empty.limit(0)]
    tops = found[0]
    for more in found[1:]:
        tops = tops.unionByName(more)
    ranked = tops.withColumn("rank", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    return ranked.join(queries.select("query", "item_id"), "query").select(
        "item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
