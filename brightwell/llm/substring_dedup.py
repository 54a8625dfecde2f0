"""Substring deduplication: windows of words that earlier documents hold, found behind a count-min prefilter.

Every window has a key: the least hash among its runs of half the length. Equal windows have equal keys, so a key's number
of documents is never below that of any of its windows, and neighbouring windows mostly share their key, so there are about
a fourteenth as many keys as windows. Each part of the input folds its keys into a count-min sketch; the sketches of all
parts are merged by adding counters, one segment of the key space per task. The merged estimate is never too low: a window
whose key is estimated in one document only is not repeated and is seen no more, and no repeated window is lost.

The second pass is exact. Neighbouring windows with one key form a stretch. Stretches of suspect keys are grouped by a
128-bit cryptographic digest of their words: all but the earliest copy are lost as a whole, whatever the number of copies.
Only where a key has several different stretches are its windows, of the earliest copies alone, grouped one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from brightwell.llm.batches import lists, map_batches, pieces, spread
from brightwell.llm.shared import written

WINDOW = 50
#: Words hashed at once, keys of one part of the input, and keys of one segment of the key space.
STEP, PART_KEYS, SEGMENT_KEYS = 1 << 18, 1 << 20, 1 << 20
#: Hash rows of a sketch, and its counters in each row for every key it is sized for.
DEPTH, COUNTERS_PER_KEY = 2, 4
#: Rows and stretches that are broadcast at most; more are joined by a shuffle of the texts.
BROADCAST_ROWS, BROADCAST_STRETCHES = 1_000_000, 4_000_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(text: bytes | None) -> list[bytes]:
    """The words between [\\x20\\x09-\\x0D], which is what bytes are split at."""
    return text.split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` word hashes: differences of a prefix sum over powers of an odd base, modulo 2^64."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers(BASE, len(hashes)), dtype=np.uint64)])
    return mixed((sums[length:] - sums[:-length]) * powers(INVERSE, len(sums) - length))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[:len(values) - rest], values[rest:])


def window_keys(hashes: np.ndarray, window: int) -> np.ndarray:
    """The key of the window that starts at each word hash."""
    half = (window + 1) // 2
    out = []
    for at in range(0, len(hashes) - window + 1, STEP):
        out.append(least_of(run_hashes(hashes[at:at + STEP + window - 1], half), window - half + 1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def stretches_of(texts: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of stretches of each text, then key and length of all stretches in order.

    A stretch is a run of neighbouring windows with one key; those of a text cover its windows from the first on.
    """
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for words in texts for w in words), dtype=np.uint64, count=int(sizes.sum()))
    keys = window_keys(hashes, window)
    windows = np.maximum(sizes - window + 1, 0)
    keys = keys[spread(np.cumsum(sizes) - sizes, windows)]
    owner = np.repeat(np.arange(len(texts)), windows)
    if not len(keys):
        return np.zeros(len(texts), dtype=np.int64), keys, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]))
    return np.bincount(owner[first], minlength=len(texts)), keys[first], np.diff(np.append(first, len(keys)))


def texts_with_marks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text); the mark is a hash of the text, which tells rows with one id apart. Texts are bytes."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


def keyed_parts(rows: DataFrame, window: int) -> DataFrame:
    """(part, ids, marks, sizes, keys, lengths): the stretches of about ``PART_KEYS`` keys in each row, written out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            ids, marks, counts, keys, lengths = (np.concatenate(x) for x in zip(*held))
            one = lambda x, kind: lists(x, np.array([len(x)]), kind)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], type=pa.int64()), one(ids, pa.int64()), one(marks, pa.int64()),
                 one(counts.astype(np.int32), pa.int32()), one(keys.view(np.int64), pa.int64()),
                 one(lengths.astype(np.int32), pa.int32())], ["part", "ids", "marks", "sizes", "keys", "lengths"])

        for piece in pieces(batches, "text"):
            counts, keys, lengths = stretches_of([words_of(x) for x in piece.column("text").to_pylist()], window)
            own = np.flatnonzero(counts)
            if len(own):
                ids, marks = (piece.column(c).to_numpy(zero_copy_only=False)[own] for c in ("doc_id", "mark"))
                held.append((ids, marks, counts[own], keys, lengths))
                size += len(keys)
            if size >= PART_KEYS:
                yield packed()
                held, size, number = [], 0, number + 1
        if held:
            yield packed()

    return written(map_batches(rows.filter("doc_id IS NOT NULL"), run,
                               "part long, ids array<long>, marks array<long>, sizes array<int>, keys array<long>, "
                               "lengths array<int>"), "stretches")


def flat(column, kind=None) -> np.ndarray:
    """The values of a list column (or chunks of one) one after another."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values if kind is None else values.view(kind)


def document_keys(sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys of one part, each as often as documents of the part hold it, in ascending order."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    return keys[np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])] if len(keys) else keys


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> np.uint64(20)) % np.uint64(segments)


class Sketch:
    """A count-min sketch of one segment; counters stop at 2, which is all that "repeated" needs."""

    width = DEPTH * SEGMENT_KEYS * COUNTERS_PER_KEY

    def __init__(self):
        self.counts = np.zeros(self.width, dtype=np.uint8)

    @classmethod
    def cells(cls, keys: np.ndarray) -> np.ndarray:
        """The counters of each key, one row for each hash row."""
        row = cls.width // DEPTH
        return np.stack([mixed(keys ^ np.uint64(1 + r)) % np.uint64(row) + np.uint64(r * row) for r in range(DEPTH)])

    @classmethod
    def folded(cls, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counters above 0 of the sketch of ``keys`` (with repeats) and their values: a part's sketch as it is sent."""
        cells, counts = np.unique(cls.cells(keys), return_counts=True)
        return cells.astype(np.uint32), np.minimum(counts, 2).astype(np.uint8)

    def merge(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.counts[cells] = np.minimum(self.counts[cells] + counts, 2)

    def repeated(self) -> bytes:
        return np.packbits(self.counts > 1).tobytes()


def estimated_repeated(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether the least counter of each key is 2, in a merged sketch packed by ``Sketch.repeated``."""
    data, cells = np.frombuffer(bits, dtype=np.uint8), Sketch.cells(keys).astype(np.int64)
    return ((data[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=0)


def per_segment(keys: np.ndarray, segments: int) -> Iterator[tuple[int, np.ndarray]]:
    segment = segment_of(keys, segments)
    order = np.argsort(segment, kind="stable")
    found, starts = np.unique(segment[order], return_index=True)
    for s, own in zip(found.tolist(), np.split(order, starts[1:])):
        yield s, keys[own]


def suspect_keys(parts: DataFrame, segments: int) -> DataFrame:
    """(part, keys): the keys of each part that the merged sketches estimate in two documents or more, packed.

    A task of either step holds one segment: its counters and, from every part, the sketch or the distinct keys, about
    ``SEGMENT_KEYS`` in all. A frequent key comes once from each part.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sizes, keys in part_keys(batches):
            rows = [(s, *Sketch.folded(own)) for s, own in per_segment(document_keys(sizes, keys), segments)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in rows], type=pa.int32()),
                 pa.array([c.tobytes() for _, c, _ in rows], type=pa.binary()),
                 pa.array([n.tobytes() for _, _, n in rows], type=pa.binary())], ["segment", "cells", "counts"])

    def merge(group: pa.Table) -> pa.Table:
        sketch = Sketch()
        for cells, counts in zip(group.column("cells").to_pylist(), group.column("counts").to_pylist()):
            sketch.merge(np.frombuffer(cells, dtype=np.uint32), np.frombuffer(counts, dtype=np.uint8))
        return pa.table({"segment": pa.array([group.column("segment")[0].as_py()], type=pa.int32()),
                         "bits": pa.array([sketch.repeated()], type=pa.binary())})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                rows = list(per_segment(np.unique(flat(one.column("keys"), np.uint64)), segments))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in rows], type=pa.int32()),
                     pa.array([one.column("part")[0].as_py()] * len(rows), type=pa.int64()),
                     pa.array([own.tobytes() for _, own in rows], type=pa.binary())], ["segment", "part", "keys"])

    def answer(asked: pa.Table, sketch: pa.Table) -> pa.Table:
        bits = sketch.column("bits")[0].as_py()
        out = []
        for keys in asked.column("keys").to_pylist():
            keys = np.frombuffer(keys, dtype=np.uint64)
            out.append(keys[estimated_repeated(bits, keys)].tobytes())
        return pa.table({"part": asked.column("part"), "keys": pa.array(out, type=pa.binary())})

    def part_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield flat(batch.column("sizes").slice(k, 1)), flat(batch.column("keys").slice(k, 1), np.uint64)

    merged = map_batches(parts.select("sizes", "keys"), fold, "segment int, cells binary, counts binary").groupBy(
        "segment").applyInArrow(merge, "segment int, bits binary")
    asked = map_batches(parts.select("part", "keys"), ask, "segment int, part long, keys binary")
    return asked.groupBy("segment").cogroup(merged.groupBy("segment")).applyInArrow(answer, "part long, keys binary")


def suspect_stretches(parts: DataFrame, suspects: DataFrame) -> DataFrame:
    """(doc_id, mark, keys, starts, lengths): the stretches with a suspect key of every row that has one, written out."""
    def match(part: pa.Table, found: pa.Table) -> pa.Table:
        known = [np.frombuffer(k, dtype=np.uint64) for k in found.column("keys").to_pylist()]
        out: list[tuple] = []
        for k in range(part.num_rows):
            one = part.slice(k, 1)
            ids, marks, sizes, lengths = (flat(one.column(c)) for c in ("ids", "marks", "sizes", "lengths"))
            keys = flat(one.column("keys"), np.uint64)
            own = np.isin(keys, np.concatenate(known)) if known else np.zeros(len(keys), dtype=bool)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            before = np.cumsum(lengths) - lengths
            starts = before - np.repeat(before[np.cumsum(sizes) - sizes], sizes) if len(keys) else before
            counts = np.bincount(owner[own], minlength=len(sizes))
            some = counts > 0
            out.append((ids[some], marks[some], counts[some], keys[own], starts[own], lengths[own]))
        ids, marks, counts, keys, starts, lengths = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": pa.array(ids, type=pa.int64()), "mark": pa.array(marks, type=pa.int64()),
                         "keys": lists(keys.view(np.int64), counts, pa.int64()),
                         "starts": lists(starts.astype(np.int32), counts, pa.int32()),
                         "lengths": lists(lengths.astype(np.int32), counts, pa.int32())})

    found = parts.groupBy("part").cogroup(suspects.groupBy("part")).applyInArrow(
        match, "doc_id long, mark long, keys array<long>, starts array<int>, lengths array<int>")
    first = [F.first(c).alias(c) for c in ("keys", "starts", "lengths")]  # rows that repeat id and text are alike
    return written(found.groupBy("doc_id", "mark").agg(*first), "suspect-stretches")


def beside_texts(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Joins ``places`` (doc_id, mark, lists of starts and lengths, ...) to the texts; few enough of them are broadcast."""
    size = places.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("starts")).alias("m")).first()
    side = places.withColumnsRenamed({"doc_id": "own_id", "mark": "own_mark"})
    if size.n <= BROADCAST_ROWS and (size.m or 0) <= BROADCAST_STRETCHES:
        side = F.broadcast(side)
    return rows.join(side, (F.col("doc_id") == F.col("own_id")) & (F.col("mark") == F.col("own_mark")), how).drop(
        "own_id", "own_mark")


def digests(words: list[bytes], starts: list[int], sizes: list[int]) -> Iterator[bytes]:
    for start, size in zip(starts, sizes):
        yield hashlib.blake2b(b" ".join(words[start:start + size]), digest_size=16).digest()


def digest_columns(found: list[bytes]) -> list[pa.Array]:
    halves = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
    return [pa.array(halves[:, 0]), pa.array(halves[:, 1])]


def stretch_digests(rows: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """(doc_id, mark, key, start, length, high, low): every suspect stretch with a digest of its words, written out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found: list[bytes] = []
            for text, starts, lengths in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "lengths"))):
                found += digests(words_of(text), starts, [n + window - 1 for n in lengths])
            counts = part.column("starts").value_lengths().to_numpy()
            ids, marks = (np.repeat(part.column(c).to_numpy(), counts) for c in ("doc_id", "mark"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(marks), *(part.column(c).flatten() for c in ("keys", "starts", "lengths")),
                 *digest_columns(found)], ["doc_id", "mark", "key", "start", "length", "high", "low"])

    return written(map_batches(beside_texts(rows, places, "inner"), run, "doc_id long, mark long, key long, start int, "
                               "length int, high long, low long"), "stretch-digests")


def window_digests(rows: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """(doc_id, mark, start, high, low): every window of the given stretches with a digest of its words, written out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            columns = (part.column(c).to_pylist() for c in ("doc_id", "mark", "text", "starts", "lengths"))
            for doc_id, mark, text, starts, lengths in zip(*columns):
                at = spread(np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64))
                words = words_of(text)
                for k in range(0, len(at), STEP):
                    own = at[k:k + STEP].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(own), type=pa.int64()), pa.array([mark] * len(own), type=pa.int64()),
                         pa.array(own, type=pa.int32()), *digest_columns(list(digests(words, own, [window] * len(own))))],
                        ["doc_id", "mark", "start", "high", "low"])

    return written(map_batches(beside_texts(rows, places, "inner"), run,
                               "doc_id long, mark long, start int, high long, low long"), "window-digests")


def later_copies(rows: DataFrame, earliest: DataFrame, *keys: str) -> DataFrame:
    """Rows whose ``keys`` stand in ``earliest`` with a smaller document."""
    names = {k: f"same_{k}" for k in keys}
    side = earliest.select(*[F.col(k).alias(n) for k, n in names.items()], "first")
    equal = [F.col(k) == F.col(n) for k, n in names.items()]
    return rows.join(side, equal).filter("doc_id > first").select("doc_id", "mark", "start", "length")


def listed(places: DataFrame) -> DataFrame:
    """(doc_id, mark, starts, lengths): the places of each row in lists; no list is longer than the row's text."""
    at = places.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "length")).alias("at"))
    return at.select("doc_id", "mark", F.col("at.start").alias("starts"), F.col("at.length").alias("lengths"))


def lost_windows(rows: DataFrame, window: int, segments: int | None) -> DataFrame:
    """(doc_id, mark, starts, lengths): runs of windows that also start in a document with a smaller id."""
    parts = keyed_parts(rows, window)
    if segments is None:
        total = parts.agg(F.coalesce(F.sum(F.size("keys").cast("long")), F.lit(0)).alias("n")).first().n
        segments = total // SEGMENT_KEYS + 1
    places = suspect_stretches(parts, suspect_keys(parts, segments))
    found = stretch_digests(rows, places, window)
    stretches = written(found.groupBy("key", "high", "low").agg(F.min("doc_id").alias("first")), "distinct-stretches")
    whole = later_copies(found, stretches, "high", "low", "key")
    # A key with one stretch has nothing more to compare; otherwise a window may stand in several different stretches.
    several = stretches.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("several"))
    earliest = stretches.join(several, F.col("key") == F.col("several")).select(
        F.col("key").alias("same_key"), F.col("high").alias("same_high"), F.col("low").alias("same_low"), "first")
    open_ones = found.join(earliest, (F.col("key") == F.col("same_key")) & (F.col("high") == F.col("same_high"))
                           & (F.col("low") == F.col("same_low")) & (F.col("doc_id") == F.col("first")))
    windows = window_digests(rows, written(listed(open_ones), "open-stretches"), window).withColumn("length", F.lit(1))
    shared = windows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(
        "first < last")
    single = later_copies(windows, shared, "high", "low")
    return written(listed(whole.unionByName(single)), "lost-windows")


def without_repeated_windows(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                             segments: int | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_removed) for every row.

    A row loses each word covered by a window of ``window`` words that also starts in a document with a smaller id; what
    is left is joined by one space. Null, empty and shorter texts keep all their words. Rows that share an id are one
    document and take nothing from each other. Rows without an id keep all words and take none from others. Repeats
    within a document stay. An empty table gives no rows.
    """
    rows = texts_with_marks(df, id_col, text_col)
    lost = lost_windows(rows, window, segments)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            texts, sizes, removed = [], [], []
            for text, starts, lengths in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "lengths"))):
                words = words_of(text)
                size, gone = len(words), 0
                if starts:
                    edges = np.zeros(size + 1, dtype=np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, np.add(starts, lengths) + window - 1, -1)
                    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
                    gone = size - len(kept)
                    words = [words[k] for k in kept]
                texts.append(b" ".join(words))
                sizes.append(size)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(texts, type=pa.binary()).cast(pa.string()),
                 pa.array(sizes, type=pa.int64()), pa.array(removed, type=pa.int64())],
                ["doc_id", "text", "n_words", "n_removed"])

    joined = beside_texts(rows, lost, "left").select("doc_id", "text", "starts", "lengths")
    return map_batches(joined, rebuild, "doc_id long, text string, n_words long, n_removed long")
