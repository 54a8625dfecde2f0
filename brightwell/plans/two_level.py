"""Look-back windows over keys that may hold a large share of all rows.

A window partitioned by the key alone would sort a hot key in one task. Keys that fit a task use that plain window.
Larger ones are windowed per key and time chunk, each chunk is summarised in one row, values are carried across the
summaries and handed to the rows by an equi-join on key and chunk. All steps stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightwell.plans.chunks import TARGET_ROWS, split_by_density


def _celled(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key and chunk as one struct: null keys are equal inside it, and windows and joins share one shuffle on it."""
    return rows.withColumn("cell", F.struct(*keys, "chunk"))


def _along(keys: Sequence[str], *more: str) -> Window:
    """The chunks of a key in order."""
    return Window.partitionBy(*[F.col(f"cell.{k}") for k in keys], *more).orderBy("cell.chunk")


def previous_value(rows: DataFrame, keys: Sequence[str], ts: str, order: str, value: Column, name: str,
                   seconds: int | None = None, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``value`` of the row before, per key in the order of ``ts`` and ``order``; null on the first row."""
    keys = list(keys)
    quiet, dense = split_by_density(rows, keys, ts, seconds, target_rows)
    parts = []
    if quiet is not None:
        along = Window.partitionBy(*keys).orderBy(ts, order)
        parts.append(quiet.select(*rows.columns, F.lag(value).over(along).alias(name)))
    if dense is not None:
        marked = _celled(dense, keys).withColumn("current_value", value)
        inside = Window.partitionBy("cell").orderBy(ts, order)
        near = marked.withColumns({"nearby": F.lag("current_value").over(inside),
                                   "leads": F.row_number().over(inside) == 1})
        last = marked.groupBy("cell").agg(F.max_by("current_value", F.struct(ts, order)).alias("last_value"))
        carried = last.select("cell", F.lag("last_value").over(_along(keys)).alias("carried"))
        picked = F.when(F.col("leads"), F.col("carried")).otherwise(F.col("nearby"))
        parts.append(near.join(carried, "cell").select(*rows.columns, picked.alias(name)))
    return reduce(DataFrame.unionByName, parts)


def _spells(rows: DataFrame, cells: list[str], ts: str, order: str) -> DataFrame:
    """Position of each row in its cell and the position of the last row up to it that broke the run."""
    inside = Window.partitionBy(*cells).orderBy(ts, order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("position", F.row_number().over(inside)).withColumn(
        "last_reset", F.max(F.when(~F.col("met"), F.col("position"))).over(so_far))


def streaks(rows: DataFrame, keys: Sequence[str], ts: str, order: str, condition: Column, name: str,
            seconds: int | None = None, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Length of the unbroken run of rows meeting ``condition`` that ends at each row; zero where it does not."""
    keys = list(keys)
    marked = rows.withColumn("met", F.coalesce(condition, F.lit(False)))
    quiet, dense = split_by_density(marked, keys, ts, seconds, target_rows)
    parts = []
    if quiet is not None:
        length = F.col("position") - F.coalesce("last_reset", F.lit(0))
        parts.append(_spells(quiet, keys, ts, order).select(*rows.columns, length.cast("bigint").alias(name)))
    if dense is not None:
        near = _spells(_celled(dense, keys), ["cell"], ts, order)
        cell = near.groupBy("cell").agg(F.count("*").alias("n"), F.max("last_reset").alias("reset"))
        cell = cell.withColumn("tail", F.col("n") - F.coalesce("reset", F.lit(0)))
        along = _along(keys)
        # Chunks with a reset so far: a new spell starts at each of them.
        cell = cell.withColumn("spell", F.count("reset").over(along)).withColumn(
            "running", F.sum("tail").over(_along(keys, "spell")))
        carried = cell.select("cell", F.coalesce(F.lag("running").over(along), F.lit(0)).alias("carried"))
        length = F.when(F.col("last_reset").isNull(), F.col("position") + F.col("carried")).otherwise(
            F.col("position") - F.col("last_reset"))
        parts.append(near.join(carried, "cell").select(*rows.columns, length.cast("bigint").alias(name)))
    return reduce(DataFrame.unionByName, parts)
