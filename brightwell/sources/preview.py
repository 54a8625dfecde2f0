"""Previews, bounded results and text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Preview sizes and shown time formats.
PREVIEW_ROWS = 100
TIME_FORMAT, DATE_FORMAT = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"


def shown_times(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text."""
    def shown(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, TIME_FORMAT)
        elif isinstance(field.dataType, T.DateType):
            col = F.date_format(col, DATE_FORMAT)
        return col.alias(field.name)
    return df.select(*[shown(f) for f in df.schema.fields])


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by the first column; ties follow the other columns, so the choice is stable."""
    return shown_times(df.orderBy(*df.columns).limit(n))


def preview_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_rows"))


def truncated(df: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """At most ``n`` rows with a flag that is true only if more exist. One row beyond ``n`` is read, never all."""
    head = (df.orderBy(*order) if order else df).limit(n + 1)
    flagged = head.withColumn("truncated", F.count("*").over(Window.partitionBy()) > n)  # n + 1 rows at most
    return (flagged.orderBy(*order) if order else flagged).limit(n)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma-separated files with a header; quotes are doubled, nulls are empty. One file per partition."""
    shown_times(df).write.mode(mode).csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")
