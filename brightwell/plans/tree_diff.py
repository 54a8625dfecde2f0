"""Differences of large snapshots by hashes of buckets.

Rows are dealt to buckets by their key. A bucket's digest is the number of its rows with sums and the exclusive or of their
hashes, so it does not depend on order and is summed up within tasks. Only buckets whose digests differ are read again and
compared; rows of equal buckets are neither shuffled nor joined. Digests may be kept beside a snapshot for the next time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 4096
_DIGEST = ("n", "mixed", "low", "high")


def _hash(columns: Sequence[str]) -> Column:
    """A hash that also tells a null from a missing place."""
    return F.xxhash64(*[part for c in columns for part in (F.col(c), F.col(c).isNull())])


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(_hash(key), F.lit(buckets)).cast("int")


def bucket_digests(rows: DataFrame, key: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS,
                   bucket_key: Sequence[str] | None = None) -> DataFrame:
    """(bucket, n, mixed, low, high), at most ``buckets`` rows. ``bucket_key`` names the leading part of the key that must
    not be split over buckets."""
    hashed = rows.select(bucket_of(bucket_key or key, buckets).alias("bucket"), _hash([*key, *columns]).alias("h"))
    return hashed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("mixed"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned("h", 32)).alias("high"))


def differing_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(bucket) whose digests are not the same."""
    names = {c: f"new_{c}" for c in ("bucket", *_DIGEST)}
    both = old.join(new.withColumnsRenamed(names), F.col("bucket") == F.col("new_bucket"), "full")
    same = F.lit(True)
    for c in _DIGEST:
        same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return both.filter(~same).select(F.coalesce("bucket", "new_bucket").alias("bucket"))


def within(rows: DataFrame, differing: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    """The rows in differing buckets, of which there are ``buckets`` at most."""
    named = rows.withColumn("__bucket", bucket_of(key, buckets))
    return named.join(F.broadcast(differing), F.col("__bucket") == F.col("bucket"), "left_semi").drop("__bucket")
