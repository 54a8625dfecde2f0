"""Splitting keys by how many rows they hold, and large keys into time chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from brightwell.plans.bounded import known
from brightwell.plans.joins import null_safe_join
from brightwell.plans.lineage_cut import cut_lineage

TARGET_ROWS = 2_000_000
WIDTHS = (2_592_000, 86_400, 3_600, 600, 60)


def chunk_widths(rows: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Seconds per chunk for every key of ``rows``: the widest whose fullest chunk stays within ``target_rows``.

    ``rows`` carries ``at_us``. Counting is pre-aggregated by minute, then rolled up to each width.
    """
    keys = list(keys)
    minute = F.floor(F.col("at_us") / 60_000_000).alias("m")
    per_minute = rows.groupBy(*keys, minute).agg(F.count("*").alias("n"))
    widths = F.explode(F.array(*[F.lit(w) for w in WIDTHS])).alias("w")
    filled = per_minute.select(*keys, "m", "n", widths).groupBy(
        *keys, "w", F.floor(F.col("m") * 60 / F.col("w")).alias("c")).agg(F.sum("n").alias("n")).groupBy(*keys, "w").agg(
        F.max("n").alias("n"))
    fits = F.max(F.when(F.col("n") <= target_rows, F.col("w")))
    finest = F.max(F.when(F.col("w") == WIDTHS[-1], F.greatest(F.lit(1), F.floor(WIDTHS[-1] * target_rows / F.col("n")))))
    return filled.groupBy(*keys).agg(F.coalesce(fits, finest).cast("bigint").alias("chunk_seconds"))


def split_by_density(rows: DataFrame, keys: Sequence[str], ts: str, seconds: int | None = None,
                     target_rows: int = TARGET_ROWS) -> tuple[DataFrame | None, DataFrame | None]:
    """``(quiet, dense)``: rows of keys that fit one task, and rows of larger keys with a ``chunk`` number.

    Both carry ``at_us``, the moment in microseconds. Either may be ``None``. ``seconds`` puts every key into chunks of
    that width without counting.
    """
    keys = list(keys)
    timed = rows.withColumn("at_us", F.unix_micros(F.col(ts).cast("timestamp")))
    if seconds is not None:
        return None, timed.withColumn("chunk", F.floor(F.col("at_us") / (seconds * 1_000_000)).cast("bigint"))
    large = cut_lineage(timed.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > target_rows).select(*keys))
    count = large.count()
    if count == 0:
        return timed, None
    sized = known(large, count)
    dense = null_safe_join(timed, sized, keys, "left_semi")
    widths = known(cut_lineage(chunk_widths(dense, keys, target_rows)), count)
    chunk = F.floor(F.col("at_us") / (F.col("chunk_seconds") * 1_000_000)).cast("bigint")
    return (null_safe_join(timed, sized, keys, "left_anti"),
            null_safe_join(dense, widths, keys).withColumn("chunk", chunk).drop("chunk_seconds"))
