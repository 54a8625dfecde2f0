"""Ranks and first rows of every key without sorting a large key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightwell.plans.lineage_cut import cut_lineage

SALTS = 64


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], unique: str, n: int,
                name: str = "position") -> DataFrame:
    """Rows ranked up to ``n`` within their key, with the rank; ``unique`` names a column that tells rows apart.

    Up to the planner's limit the rank is cut in every task ahead of the shuffle. Beyond it the key is first ranked in
    salted parts that keep ``n`` rows each, so the last sort meets at most ``SALTS * n`` rows of a key.
    """
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salted = df.withColumn("salt", F.pmod(F.xxhash64(unique), F.lit(SALTS)))
        part = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order))
        df = salted.withColumn("part_rank", part).filter(F.col("part_rank") <= n).drop("salt", "part_rank")
    return df.withColumn(name, ranked).filter(F.col(name) <= n)


def ranked_up_to(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limits: DataFrame, limit: str,
                 name: str = "position") -> DataFrame:
    """Rows ranked within their key up to the key's ``limit``, which may be as large as the key; keys without one go.

    The rows are laid out once in global order, so a key of any size spans as many parts as it needs. A part's ranks
    start at the number of the key's rows in the parts before it; parts that start beyond the limit are left out, and
    only rows of one part and key are ever sorted together. ``order`` must tell rows apart.
    """
    laid = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("part", F.spark_partition_id())
    laid = cut_lineage(laid)
    counts = laid.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(
        limits.select(*keys, F.col(limit).alias("most")), list(keys)).filter(F.col("before") < F.col("most"))
    inside = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    ranked = laid.join(starts, [*keys, "part"]).withColumn(name, (F.col("before") + inside).cast("int"))
    return ranked.filter(F.col(name) <= F.col("most")).drop("part", "before", "most")
