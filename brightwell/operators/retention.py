"""Retention of append-only logs."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, functions as F

from brightwell.functions.values import ago

# Days each log is kept.
DEFAULT_DAYS = {"call_log": 30, "sql_history": 30, "run_history": 30, "collect_history": 30, "check_batch": 30,
                "metric_minute": 30, "audit_log": 90, "alert_history": 90, "asset_view": 90, "lineage": 90,
                "score_history": 90}


PARTITIONS_AT_ONCE = 1000


def retain(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows younger than ``days`` (at least one day). The bare comparison prunes date partitions."""
    return df.filter(F.col(ts) >= ago(as_of, days=max(days, 1)))


def expired(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    return df.filter(F.col(ts) < ago(as_of, days=max(days, 1)))


def cascade(children: DataFrame, parents_expired: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children whose parent stays."""
    return children.join(parents_expired.select(F.col(pk).alias(fk)), fk, "left_anti")


def drop_expired_partitions(spark, table: str, partition_column: str, days: int, as_of: str) -> list[str]:
    """Drop whole expired date partitions of a partitioned table without reading rows; returns the days dropped.

    The date may be one of several partition columns: all partitions of an expired day go, many per statement.
    """
    limit = spark.sql("SELECT date_sub(CAST(:now AS DATE), :days) AS d", args={"now": as_of, "days": max(days, 1)}
                      ).first()["d"].isoformat()
    specs = [[part.split("=", 1) for part in r["partition"].split("/")] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    old = [spec for spec in specs if dict(spec)[partition_column] < limit]
    texts = ["PARTITION (" + ", ".join(f"`{name}` = '{_literal(value)}'" for name, value in spec) + ")" for spec in old]
    for start in range(0, len(texts), PARTITIONS_AT_ONCE):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(texts[start:start + PARTITIONS_AT_ONCE])}")
    return sorted({dict(spec)[partition_column] for spec in old})


def _literal(value: str) -> str:
    """A partition value as listed, unescaped and quoted."""
    return unquote(value).replace("\\", "\\\\").replace("'", "\\'")
