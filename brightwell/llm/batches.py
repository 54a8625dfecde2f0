"""Arrow batches in bounded pieces, state kept per Python worker, and words numbered as they appear."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

PIECE_BYTES = 1 << 20
#: A batch on its way to or from a task; a single longer row makes a batch of its own.
BATCH_BYTES = 8 << 20


def worker_state(key: str, build: Callable[[], object]):
    """An object kept for the life of a Python worker process, so that its later tasks find it ready.

    Shipped functions are unpickled for every task; a module entry of this process is the one place that outlives them.
    """
    kept = sys.modules.setdefault("_brightwell_worker_state", types.ModuleType("_brightwell_worker_state")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows into parts whose text takes about ``limit`` bytes, or one longer row each."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        part = (np.cumsum(sizes, dtype=np.int64) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def map_batches(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, for rows that hold whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if text is None else text for text in batch.column(column).to_pylist()]


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start+1, ... of all ranges, one range after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return np.arange(ends[-1], dtype=np.int64) + shift


class Numbered:
    """Numbers distinct words and keeps one row of values for each, computed for many new words at once.

    ``compute`` maps a list of new words to arrays of equal length. The table starts afresh once it holds ``limit``
    words or ``chars`` characters, so its memory is bounded; a single call may exceed it by the words of that call.
    """

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, ...]], limit: int = 400_000, chars: int = 8 << 20):
        self.compute, self.limit, self.chars = compute, limit, chars
        self.index: dict[str, int] = {}
        self.held = 0
        self.columns: list[np.ndarray] = []

    def numbers(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.index)
        if new and self.index and (len(self.index) + len(new) > self.limit or self.held + sum(map(len, new)) > self.chars):
            self.index, self.held, self.columns, new = {}, 0, [], set(words)
        if new:
            new = list(new)
            start = len(self.index)
            self.held += sum(map(len, new))
            self.index.update(zip(new, range(start, start + len(new))))
            self._append(start, self.compute(new))
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))

    def _append(self, start: int, values: tuple[np.ndarray, ...]) -> None:
        if not self.columns:
            self.columns = [np.zeros((0, *v.shape[1:]), dtype=v.dtype) for v in values]
        size = start + len(values[0])
        for k, v in enumerate(values):
            if size > len(self.columns[k]):
                grown = np.zeros((max(size, 2 * len(self.columns[k])), *v.shape[1:]), dtype=v.dtype)
                grown[:start] = self.columns[k][:start]
                self.columns[k] = grown
            self.columns[k][start:size] = v


class Spelled:
    """The bytes that ``compute`` gives for each distinct word, asked for many new words at once.

    Two generations of at most about ``limit`` words each are kept, so words in use stay; words of more than ``longest``
    characters are spelt each time, so memory is bounded in bytes too.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]], limit: int = 150_000, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """For each list of words their bytes one after another."""
        if len(self.recent) > self.limit:
            self.recent, self.older = {}, self.recent
        recent = self.recent
        found = [list(map(recent.get, words)) for words in texts]
        gaps = [k for k, spelled in enumerate(found) if None in spelled]
        if gaps:
            new = {word for k in gaps for word, spelled in zip(texts[k], found[k]) if spelled is None}
            again = [word for word in new if word in self.older]
            recent.update((word, self.older[word]) for word in again)
            new.difference_update(again)
            new = list(new)
            own = dict(zip(new, self.compute(new)))
            recent.update((word, spelled) for word, spelled in own.items() if len(word) <= self.longest)
            for k in gaps:
                found[k] = [own[word] if word in own else recent[word] for word in texts[k]]
        return [b"".join(spelled) for spelled in found]
