"""Exact duplicates by composable polynomial fingerprints and a chunkwise comparison.

A text without its white space is cut into chunks of bytes. A chunk's hash is its polynomial in a base modulo a prime,
all chunks at once by one product of a matrix and a row of powers; hashes of neighbours combine as
``left * base ** length(right) + right``. Four such hashes and the length make the fingerprint. Texts of one fingerprint
are then compared chunk by chunk: least and greatest chunk of each place must agree, which partial aggregation settles
for most copies before anything is shuffled. Should they differ, the texts themselves are the key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brightwell.llm.batches import map_batches, pieces
from brightwell.llm.shared import written

CHUNK = 4096
PRIME = (1 << 31) - 1
BASES = (1_000_003, 16_807_001, 48_271_337, 69_621_113)
#: Fingerprints that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
SPACES = b" \t\n\x0b\x0c\r"


@lru_cache(maxsize=16)
def powers(base: int, prime: int, size: int) -> np.ndarray:
    """base ** (size - 1) down to base ** 0 modulo the prime."""
    out = [1]
    for _ in range(size - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], dtype=np.uint64)


def combine(left: int, right: int, right_length: int, base: int, prime: int = PRIME) -> int:
    """The hash of two neighbouring pieces from their hashes and the length of the right one."""
    return (left * pow(base, right_length, prime) + right) % prime


def polynomial(data: bytes, base: int, prime: int = PRIME, chunk: int = CHUNK) -> int:
    """The hash of all bytes, each counted one higher so that leading zeros matter."""
    values = np.frombuffer(data, dtype=np.uint8)
    whole = len(values) // chunk
    total = 0
    if whole:  # a byte times a power stays below 2**40, a sum over a chunk below 2**52
        rows = values[:whole * chunk].reshape(whole, chunk)
        row = powers(base, prime, chunk)
        for part in ((rows @ row.astype(np.float64)).astype(np.uint64) + row.sum() % np.uint64(prime)) % np.uint64(prime):
            total = combine(total, int(part), chunk, base, prime)
    rest = values[whole * chunk:]
    if len(rest):
        row = powers(base, prime, chunk)[chunk - len(rest):]
        last = int((rest.astype(np.uint64) + np.uint64(1)) @ row % np.uint64(prime))
        total = combine(total, last, len(rest), base, prime)
    return total


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(None, SPACES)


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bases: tuple[int, ...] = BASES,
                      prime: int = PRIME) -> DataFrame:
    """(doc_id, n_chars, n_bytes, high, low, text_sha256) for every row.

    ``n_chars`` counts the code points of the whole text, the others describe the text without white space. ``high``
    and ``low`` hold two polynomial hashes each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            texts = part.column("text").to_pylist()
            data = [normalised(x) for x in texts]
            hashes = np.array([[polynomial(x, b, prime) for b in bases] for x in data], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x or "") for x in texts], type=pa.int64()),
                 pa.array([len(x) for x in data], type=pa.int64()),
                 pa.array(hashes[:, 0] << 31 | hashes[:, 1]), pa.array(hashes[:, 2] << 31 | hashes[:, 3]),
                 pa.array([hashlib.sha256(x).hexdigest() for x in data])],
                ["doc_id", "n_chars", "n_bytes", "high", "low", "text_sha256"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_chars long, n_bytes long, high long, low long, text_sha256 string")


KEY = ["n_bytes", "high", "low"]


def chunks(df: DataFrame, text_col: str = "text", bases: tuple[int, ...] = BASES, prime: int = PRIME,
           size: int = 16 * CHUNK) -> DataFrame:
    """(n_bytes, high, low, place, chunk) for every chunk of every text without its white space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            data = [normalised(x) for x in part.column("text").to_pylist()]
            hashes = [[polynomial(x, b, prime) for b in bases] for x in data]
            keys = [(len(x), h[0] << 31 | h[1], h[2] << 31 | h[3]) for x, h in zip(data, hashes)]
            rows = [(*k, p, x[p:p + size]) for k, x in zip(keys, data) for p in range(0, max(1, len(x)), size)]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)],
                                             [*KEY, "place", "chunk"])

    rows = df.select(F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "n_bytes long, high long, low long, place long, chunk binary")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bases: tuple[int, ...] = BASES,
                     prime: int = PRIME) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty, and all texts
    without other characters are one group. Of a group the row with the most code points stays, then the one with the
    smallest id; null ids come last. Rows that repeat id and text cannot be told apart and are marked kept together.
    """
    prints = written(with_fingerprints(df, id_col, text_col, bases, prime), "exact")
    several = prints.groupBy(*KEY).count().filter("count > 1").drop("count")
    known = several.limit(BROADCAST_ROWS + 1).count()
    if known == 0:
        clashes = several
    else:
        side = F.broadcast(several) if known <= BROADCAST_ROWS else several
        compared = (chunks(df, text_col, bases, prime).join(side, KEY, "left_semi")
                    .groupBy(*KEY, "place").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")))
        clashes = written(compared.filter("least <> most").select(*KEY).distinct(), "clashes")
    prints = prints.withColumn("exact", F.lit(None).cast("binary"))
    if known and not clashes.isEmpty():  # different texts with one fingerprint: their texts are the key
        prints = _by_text(df, prints.drop("exact"), clashes, id_col, text_col, bases, prime)
    rank = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"g.{k}")) for k in [*KEY, "exact"]]
    groups = prints.groupBy(*KEY, "exact").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
    best = F.col("g.best")
    return prints.alias("p").join(groups.alias("g"), same).select(
        F.col("p.doc_id"), best["doc_id"].alias("keep_id"), F.col("g.group_size"),
        (F.col("p.doc_id").eqNullSafe(best["doc_id"]) & (F.col("p.n_chars") == -best["col1"])).alias("kept"),
        F.col("p.text_sha256"))


def _by_text(df: DataFrame, prints: DataFrame, clashes: DataFrame, id_col: str, text_col: str,
             bases: tuple[int, ...], prime: int) -> DataFrame:
    """Fingerprint rows with the text itself as a further key where the comparison found different texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            texts = part.column("text").to_pylist()
            data = [normalised(x) for x in texts]
            hashes = [[polynomial(x, b, prime) for b in bases] for x in data]
            rows = [(len(x or ""), len(y), h[0] << 31 | h[1], h[2] << 31 | h[3], hashlib.sha256(y).hexdigest(), y)
                    for x, y, h in zip(texts, data, hashes)]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, type=t) for c, t in zip(zip(*rows), kinds))],
                ["doc_id", "n_chars", *KEY, "text_sha256", "exact"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    full = map_batches(rows, run, "doc_id long, n_chars long, n_bytes long, high long, low long, text_sha256 string, "
                                "exact binary").join(clashes, KEY, "left_semi")
    rest = prints.join(clashes, KEY, "left_anti").withColumn("exact", F.lit(None).cast("binary"))
    return rest.unionByName(full)
