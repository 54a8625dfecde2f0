"""Full and incremental table synchronisation."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

PARALLEL_TABLES = 3
RESULT = ("table_name string, target string, status string, rows_read bigint, rows_written bigint, "
          "duration_ms bigint, error string")


def target_name(table: str, database: str | None = None) -> str:
    clean = lambda s: re.sub(r"[^a-zA-Z0-9_]", "_", s)
    return f"sync_{clean(database or 'default')}_{clean(table)}"


def sync_full(source: DataFrame, mapping: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Mapped columns under their target names; all columns without a mapping."""
    if not mapping:
        return source
    return source.select(*[F.col(a).alias(b) for a, b in mapping if a and b])


def _class_of(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "NUMERIC"
    return "TEMPORAL" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "OTHER"


def sync_incremental(source: DataFrame, target: DataFrame | None, field: str, has_success: bool,
                     target_field: str | None = None) -> DataFrame:
    """Source rows beyond the highest value of the target.

    All rows while no run has succeeded, the target is empty or missing, or the field's types do not compare. The
    highest value is one scalar; as a literal it reaches the source scan.
    """
    there = target_field or field
    if not has_success or target is None or field not in source.columns or there not in target.columns:
        return source
    left = _class_of(source.schema[field].dataType)
    if left == "OTHER" or left != _class_of(target.schema[there].dataType):
        return source
    highest = target.agg(F.max(there).alias("highest")).first()["highest"]
    return source if highest is None else source.filter(F.col(field) > F.lit(highest))


@dataclass(frozen=True)
class SyncJob:
    """One table to copy: ``read`` gives the source frame, ``write`` stores the mapped one."""

    table: str
    read: Callable[[], DataFrame]
    write: Callable[[DataFrame], None]
    target: str | None = None
    mapping: Sequence[tuple[str, str]] | None = None


def _run(job: SyncJob) -> tuple:
    started, target = time.monotonic(), job.target or target_name(job.table)
    elapsed = lambda: int((time.monotonic() - started) * 1000)
    try:
        seen, stored = Observation(), Observation()
        source = job.read().observe(seen, F.count(F.lit(1)).alias("n"))
        job.write(sync_full(source, job.mapping).observe(stored, F.count(F.lit(1)).alias("n")))
        return (job.table, target, "SUCCESS", seen.get["n"], stored.get["n"], elapsed(), None)
    except Exception as error:  # whatever a job raises is its own result
        return (job.table, target, "FAILED", None, None, elapsed(), (str(error) or type(error).__name__).split("\n")[0])


def sync_many(spark: SparkSession, jobs: Iterable[SyncJob], parallel: int = PARALLEL_TABLES) -> DataFrame:
    """Copies every table and reports one row each; a failing table does not stop the others.

    Counts are taken while the rows pass, so no table is read twice.
    """
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return spark.createDataFrame(list(pool.map(_run, list(jobs))), RESULT)


def overall_status(results: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "FAILED")
    return results.agg(F.count("*").alias("tables"), failed.alias("failed"),
                       F.when(failed == 0, "SUCCESS").otherwise("FAILED").alias("status"))
