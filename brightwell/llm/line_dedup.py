"""Line deduplication across documents with two Bloom filters.

First pass: every task hashes its lines and sends each hash once, with a mark if two documents of the task share it,
packed by segment of the hash space; there are as many segments as the counted lines need. A segment's task runs the hashes through a filter of hashes seen once; a hash that
is already there, or is marked, enters the filter of hashes seen twice, which alone leaves the task. Second pass: lines
that the second filter may hold are the suspects, and only they are shuffled: grouping their keys finds those in at
least two documents and the smallest id, where the line stays. A false positive of the filters costs a shuffled row and
never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from brightwell.llm.batches import map_batches, pieces
from brightwell.llm.shared import written

BLANKS = b" \t\n\x0b\x0c\r"
#: Code points a key needs.
LEAST = 10
PROBES = 5
#: Hashes per segment that filters are sized for, bits for each of them, and the most bits of all second filters.
SEGMENT_HASHES, BITS_PER_HASH, MOST_BITS = 1 << 20, 12, 1 << 29


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of ``bits`` (a power of two), one row for each probe."""
    step = (hashes >> np.uint64(17)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]).astype(np.int64)


class Bloom:
    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = probes(hashes, self.bits)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        at = probes(hashes, self.bits).ravel()
        np.bitwise_or.at(self.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def key_of(line: bytes) -> bytes:
    """The line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def is_long(key: bytes) -> bool:
    return len(key) >= 4 * LEAST or len(key) >= LEAST and len(key.decode("utf-8", "replace")) >= LEAST


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split(b"\n")


def keys_of(text: str | None) -> list[bytes]:
    """The keys of a text's lines in order; b'' for lines whose key is too short."""
    return [k if is_long(k) else b"" for k in map(key_of, lines_of(text))]


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)


@dataclass(frozen=True)
class Suspects:
    """The second filters, one for each segment of the hash space."""

    filters: dict[int, Bloom]
    segments: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=bool)
        segment = (hashes >> np.uint64(40)) % np.uint64(self.segments)
        for s in np.unique(segment).tolist():
            if s in self.filters:
                own = segment == s
                out[own] = self.filters[s].has(hashes[own])
        return out


def power_of_two(n: int) -> int:
    return 1 << max(10, int(n - 1).bit_length())


def suspects(df: DataFrame, text_col: str, segments: int, least_bits: int = 1 << 10) -> Suspects:
    """Two filters for each segment; the driver receives the second ones, ``MOST_BITS`` in all at most.

    A second filter has ``BITS_PER_HASH`` bits for each hash it holds until that bound is reached; beyond it more lines
    are suspects.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
            marked = np.isin(once, twice)
            segment = (once >> np.uint64(40)) % np.uint64(segments)
            order = np.argsort(segment, kind="stable")
            found, starts = np.unique(segment[order], return_index=True)
            cuts = np.append(starts, len(order))
            rows = [order[a:b] for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array([once[r].tobytes() for r in rows], type=pa.binary()),
                 pa.array([np.packbits(marked[r]).tobytes() for r in rows], type=pa.binary())],
                ["segment", "hashes", "marks"])

        held: list[np.ndarray] = []
        size = 0
        for part in pieces(batches, "text"):
            for text in part.column("text").to_pylist():
                keys = set(keys_of(text))
                keys.discard(b"")
                held.append(hashes_of(list(keys)))
                size += len(keys)
            if size > SEGMENT_HASHES:
                yield packed(*counted(held))
                held, size = [], 0
        if size:
            yield packed(*counted(held))

    def counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return values, values[counts > 1]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, Bloom] = {}
        twice: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for segment, data, marks in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = np.frombuffer(data, dtype=np.uint64)
                marked = np.unpackbits(np.frombuffer(marks, dtype=np.uint8), count=len(hashes)).astype(bool)
                if segment not in once:
                    once[segment] = Bloom(power_of_two(SEGMENT_HASHES * BITS_PER_HASH))
                    twice[segment] = []
                again = once[segment].has(hashes) | marked
                once[segment].add(hashes)
                twice[segment].append(np.unique(hashes[again]))
        most = power_of_two(max(least_bits, MOST_BITS // (2 * segments)))
        for segment, found in twice.items():
            hashes = np.unique(np.concatenate(found))
            bloom = Bloom(min(most, power_of_two(max(least_bits, len(hashes) * BITS_PER_HASH))))
            bloom.add(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], type=pa.int32()), pa.array([bloom.bits], type=pa.int64()),
                 pa.array([bloom.data.tobytes()], type=pa.binary())], ["segment", "bits", "data"])

    sent = map_batches(df.select(F.col(text_col).cast("string").alias("text")),
        local, "segment int, hashes binary, marks binary")
    merged = sent.repartition(segments, "segment").mapInArrow(merge, "segment int, bits long, data binary")
    return Suspects({r.segment: Bloom(r.bits, bytes(r.data)) for r in merged.toLocalIterator()}, segments)


def segments_for(df: DataFrame, text_col: str) -> int:
    """Segments of the hash space of about ``SEGMENT_HASHES`` lines each, from the counted line feeds of all texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    feeds = F.octet_length(text) - F.octet_length(F.translate(text, "\n", ""))
    lines = df.agg(F.coalesce(F.sum(feeds.cast("long") + 1), F.lit(0)).alias("n")).first().n
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines // SEGMENT_HASHES))


def marked_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text) for every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def repeated_lines(df: DataFrame, found: Suspects, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, lines): the places of the lines that a row loses; rows that lose none are left out.

    ``mark`` is a hash of the row's text, by which rows that share an id are told apart.
    """
    parts = {segment: (bloom.bits, bloom.data.tobytes()) for segment, bloom in found.filters.items()}
    shipped = df.sparkSession.sparkContext.broadcast((parts, found.segments))  # MOST_BITS at most

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Suspects({s: Bloom(*x) for s, x in shipped.value[0].items()}, shipped.value[1])
        for part in pieces(batches, "text"):
            ids, marks, keys, at = [], [], [], []
            for doc_id, mark, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
                places: dict[bytes, list[int]] = {}
                for k, key in enumerate(keys_of(text)):
                    if key:
                        places.setdefault(key, []).append(k)
                ids += [doc_id] * len(places)
                marks += [mark] * len(places)
                keys += places
                at += places.values()
            hits = np.flatnonzero(filters.has(hashes_of(keys))).tolist()
            ids, marks, keys, at = ([x[k] for k in hits] for x in (ids, marks, keys, at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.int64()), pa.array(marks, type=pa.int64()), pa.array(keys, type=pa.binary()),
                 pa.array(at, type=pa.list_(pa.int32()))], ["doc_id", "mark", "key", "places"])

    rows = marked_rows(df, id_col, text_col)
    lines = written(map_batches(rows, suspect, "doc_id long, mark long, key binary, places array<int>"), "suspects")
    # Written out, both sides of the join are plain shuffles, which adaptive execution splits at a common line.
    shared = written(lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                     .filter("first < last").select(F.col("key").alias("shared_key"), "first"), "shared-lines")
    lost = lines.join(shared, F.col("key") == F.col("shared_key")).filter("doc_id > first")
    return lost.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("places")).alias("lines"))


def without_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           segments: int | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row.

    Keys of at least 10 code points in at least two documents lose all their lines but those of the document with the
    smallest id, which keeps each of them. A null or empty text is one empty line. Rows that share an id are one
    document: each loses those of its lines that an earlier document holds. Rows without an id keep all lines and take
    no line from others.
    """
    segments = segments or segments_for(df, text_col)
    known = df.filter(F.col(id_col).isNotNull())
    found = suspects(known, text_col, segments)
    lost = repeated_lines(known, found, id_col, text_col).select(
        F.col("doc_id").alias("lost_id"), F.col("mark").alias("lost_mark"), "lines")
    rows = marked_rows(df, id_col, text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            texts, counts, dropped = [], [], []
            for text, lost in zip(part.column("text").to_pylist(), part.column("lines").to_pylist()):
                lines = (text or "").split("\n")
                counts.append(len(lines))
                gone = {k for k in lost or () if k < len(lines)}
                dropped.append(len(gone))
                texts.append("\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else text or "")
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(texts, type=pa.string()), pa.array(counts, type=pa.int64()),
                 pa.array(dropped, type=pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    joined = rows.join(lost, (F.col("doc_id") == F.col("lost_id")) & (F.col("mark") == F.col("lost_mark")), "left").select(
        "doc_id", "text", "lines")
    return map_batches(joined, rebuild, "doc_id long, text string, n_lines long, n_dropped long")
