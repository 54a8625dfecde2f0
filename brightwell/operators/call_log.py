"""Statistics over the API call log.

Input columns: ``id, api_id, key_id, key_name, status_code, duration_ms, created_at``. Every function filters on
``created_at`` first, so the range reaches the scan and prunes date partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brightwell.functions.values import ago, count_when, half_open, ntz

# Status classes, grade limits and grade points that decide results.
SUCCESS_FROM, SUCCESS_TO, FAILED_FROM, LIMITED = 200, 300, 400, 429
SEVERE_ERROR_PCT, WARNING_ERROR_PCT, WARNING_LIMITED_PCT = 5, 1, 5
SEVERE_P95_MS, WARNING_P95_MS = 1000, 500
GRADE_POINTS = {"PASS": 100, "WARNING": 60, "SEVERE": 20}
RANGES = {"24h": (1, "hour"), "7d": (7, "day"), "30d": (30, "day")}
ZOMBIE_DAYS = 7


def stats_range(name: str | None) -> tuple[int, str]:
    """``(days back, bucket unit)`` of a named range; anything unknown means the last 24 hours."""
    return RANGES.get(name or "24h", RANGES["24h"])


def _status() -> Column:
    return F.col("status_code")


def _is_success() -> Column:
    return (_status() >= SUCCESS_FROM) & (_status() < SUCCESS_TO)


def _is_failed() -> Column:
    return _status() >= FAILED_FROM


def _is_limited() -> Column:
    return _status() == LIMITED


def _p95(calls: Column) -> Column:
    """Interpolated P95 of the known durations; zero when there are none.

    Durations are whole milliseconds, so the counts kept per task are as many as there are different latencies, not
    calls.
    """
    return F.coalesce(F.percentile("duration_ms", 0.95, calls), F.lit(0.0))


def _calls(log: DataFrame) -> Column:
    """How many calls a row stands for: one, or the ``calls`` of a histogram."""
    return F.col("calls") if "calls" in log.columns else F.lit(1).cast("long")


def _number(calls: Column, condition: Column | None = None) -> Column:
    counted = calls if condition is None else F.when(condition, calls)
    return F.coalesce(F.sum(counted), F.lit(0).cast("long"))


def latency_histograms(log: DataFrame, unit: str = "hour") -> DataFrame:
    """(api_id, created_at, status_code, duration_ms, calls): the log as counts per time bucket, exact to the millisecond.

    The statistics below read it in place of the log, for ranges that begin with a bucket. Counts of buckets, tasks and
    days add up, so it is kept per day and a long range merges what is stored instead of reading calls again.
    """
    bucket = F.date_trunc(unit, F.col("created_at")).cast("timestamp_ntz").alias("created_at")
    return log.groupBy("api_id", bucket, "status_code", "duration_ms").agg(_number(_calls(log)).alias("calls"))


def _recent(log: DataFrame, since, api_id=None) -> DataFrame:
    rows = log.filter(F.col("created_at") >= ntz(since))
    return rows if api_id is None else rows.filter(F.col("api_id") == F.lit(api_id))


def call_overview(log: DataFrame, since, api_id=None, as_of=None) -> DataFrame:
    """One row of totals and P95 from the log or its :func:`latency_histograms`; for one API also the mean duration and the calls of the day of ``as_of``."""
    calls = _calls(log)
    aggregates = [
        _number(calls).alias("total"),
        _number(calls, _is_success()).alias("success"),
        _number(calls, _is_limited()).alias("limited"),
        _p95(calls).alias("p95_ms"),
    ]
    if api_id is not None:
        today = F.date_trunc("day", ntz(as_of)).cast("timestamp_ntz")
        known = F.when(F.col("duration_ms").isNotNull(), calls)
        aggregates += [
            _number(calls, _is_failed()).alias("failed"),
            F.coalesce(F.try_divide(F.sum(F.col("duration_ms") * calls), F.sum(known)), F.lit(0.0)).alias("avg_ms"),
            _number(calls, F.col("created_at") >= today).alias("today"),
        ]
    return _recent(log, since, api_id).agg(*aggregates)


def call_stats_by_api(log: DataFrame, since) -> DataFrame:
    calls = _calls(log)
    return _recent(log, since).groupBy("api_id").agg(
        _number(calls).alias("total"),
        _number(calls, _is_failed()).alias("failed"),
        _number(calls, _is_limited()).alias("limited"),
        _p95(calls).alias("p95_ms"),
    )


def health_grades(stats: DataFrame) -> DataFrame:
    """Grade each API on its unrounded error and limiting shares; the shares shown are rounded afterwards."""
    total = F.col("total")
    severe = (F.col("failed") * 100 >= total * SEVERE_ERROR_PCT) | (F.col("p95_ms") >= SEVERE_P95_MS)
    warning = (
        (F.col("failed") * 100 >= total * WARNING_ERROR_PCT)
        | (F.col("p95_ms") >= WARNING_P95_MS)
        | (F.col("limited") * 100 >= total * WARNING_LIMITED_PCT)
    )
    share = lambda part: F.coalesce(
        F.round(F.try_divide(F.col(part).cast("decimal(18,0)") * 100, total.cast("decimal(18,0)")), 2), F.lit(0)
    ).cast("decimal(9,2)")
    return stats.filter(total > 0).select(
        "api_id", "total",
        share("failed").alias("error_pct"), share("limited").alias("limited_pct"), "p95_ms",
        F.when(severe, "SEVERE").when(warning, "WARNING").otherwise("PASS").alias("grade"),
    )


def overall_health(grades: DataFrame) -> DataFrame:
    """Mean of the grade points, rounded; 100 when nothing was graded."""
    points = F.when(F.col("grade") == "PASS", GRADE_POINTS["PASS"]).when(
        F.col("grade") == "WARNING", GRADE_POINTS["WARNING"]).otherwise(GRADE_POINTS["SEVERE"])
    return grades.agg(
        F.count("*").alias("apis"),
        F.coalesce(F.floor(F.avg(points) + 0.5), F.lit(100)).cast("int").alias("score"),
    )


def call_trend(log: DataFrame, since, unit: str, api_id=None) -> DataFrame:
    return _recent(log, since, api_id).groupBy(_bucket(unit)).agg(
        F.count("*").alias("total"), count_when(_is_failed()).alias("failed"))


def limited_trend(log: DataFrame, since, unit: str) -> DataFrame:
    return _recent(log, since).filter(_is_limited()).groupBy(_bucket(unit)).agg(F.count("*").alias("limited"))


def hourly_today(log: DataFrame, api_id, as_of) -> DataFrame:
    today = F.date_trunc("day", ntz(as_of)).cast("timestamp_ntz")
    return _recent(log, today, api_id).groupBy(_bucket("hour")).agg(F.count("*").alias("total"))


def _bucket(unit: str) -> Column:
    return F.date_trunc(unit, "created_at").cast("timestamp_ntz").alias("bucket")


def top_apis(log: DataFrame, apis: DataFrame, since, n: int = 10) -> DataFrame:
    """The busiest APIs; the cut happens before the names are joined, so only ``n`` rows meet the name table."""
    top = _recent(log, since).groupBy("api_id").agg(F.count("*").alias("total")).orderBy(
        F.desc("total"), F.asc("api_id")).limit(n)
    return top.join(apis.select("api_id", "api_name"), "api_id", "left")


def top_keys(log: DataFrame, since, n: int = 10, api_id=None) -> DataFrame:
    return _recent(log, since, api_id).groupBy("key_id").agg(
        F.max("key_name").alias("key_name"), F.count("*").alias("total")
    ).orderBy(F.desc("total"), F.asc("key_id")).limit(n)


def error_codes(log: DataFrame, since, n: int = 10) -> DataFrame:
    """The commonest error codes with their share of the calls listed."""
    from pyspark.sql import Window

    top = _recent(log, since).filter(_is_failed()).groupBy("status_code").agg(F.count("*").alias("total")).orderBy(
        F.desc("total"), F.asc("status_code")).limit(n)
    listed = F.sum("total").over(Window.partitionBy())
    share = F.round(F.col("total").cast("decimal(18,0)") * 100 / listed.cast("decimal(18,0)"), 2)
    return top.select("status_code", "total", share.cast("decimal(9,2)").alias("share_pct"))


def most_limited_api(log: DataFrame, since) -> DataFrame:
    return _recent(log, since).filter(_is_limited()).groupBy("api_id").agg(F.count("*").alias("limited")).orderBy(
        F.desc("limited"), F.asc("api_id")).limit(1)


def zombie_keys(keys: DataFrame, log: DataFrame, as_of) -> DataFrame:
    """Enabled keys without a call in the fixed look-back."""
    used = _recent(log, ago(as_of, days=ZOMBIE_DAYS)).select("key_id").distinct()
    return keys.filter(F.col("enabled")).join(used, "key_id", "left_anti")


def counts_by(df: DataFrame, key: str, ids: DataFrame | None = None, since=None, ts: str = "created_at",
              name: str = "total") -> DataFrame:
    """Rows per key since a moment; with ``ids`` only those keys, zero included."""
    rows = df if since is None else df.filter(F.col(ts) >= ntz(since))
    counts = rows.groupBy(key).agg(F.count("*").alias(name))
    if ids is None:
        return counts
    return ids.select(key).distinct().join(counts, key, "left").select(
        key, F.coalesce(F.col(name), F.lit(0)).alias(name))


def status_classes(log: DataFrame, since, api_id=None) -> DataFrame:
    between = lambda lo, hi: count_when((_status() >= lo) & (_status() < hi))
    return _recent(log, since, api_id).agg(
        between(200, 300).alias("ok_2xx"), between(400, 500).alias("client_4xx"), between(500, 600).alias("server_5xx"))


def latest_calls(log: DataFrame, api_id, n: int = 5) -> DataFrame:
    return log.filter(F.col("api_id") == F.lit(api_id)).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def calls_between(log: DataFrame, start=None, end=None) -> DataFrame:
    return log.filter(half_open(F.col("created_at"), start, end))
