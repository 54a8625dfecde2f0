"""Alert histories: statistics, summaries, pages and merged batch alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brightwell.functions.values import count_when, ntz

# Alert types by weight in the summary, and alert levels.
ALERT_TYPES = ("FAILURE", "TIMEOUT", "LAG_EXCEEDED", "EXTERNAL_STOP", "SUCCESS")
SEVERE_ONLY = "SEVERE_ONLY"


def alert_stats(alerts: DataFrame, t_from=None, t_to=None, object_type: str | None = None) -> DataFrame:
    """Alerts per type and failed sends; ``total`` leaves success notices out."""
    rows = alerts
    if t_from is not None:
        rows = rows.filter(F.col("sent_at") >= ntz(t_from))
    if t_to is not None:
        rows = rows.filter(F.col("sent_at") <= ntz(t_to))
    if object_type:
        rows = rows.filter(F.col("object_type") == object_type)
    kind = F.col("alert_type")
    return rows.agg(
        *[count_when(kind == t).alias(t.lower()) for t in ALERT_TYPES],
        count_when(F.col("send_status") == "FAILED").alias("send_failed"),
        count_when(kind.isin(*ALERT_TYPES[:4])).alias("total"))


def alert_headline(stats: DataFrame) -> DataFrame:
    """The dominant kind of alert and its count, taken from :func:`alert_stats`."""
    total, failure = F.col("total"), F.col("failure")
    kinds = [(failure >= total - failure, "FAILURE", failure)]
    kinds += [(F.col(t.lower()) > 0, t, F.col(t.lower())) for t in ALERT_TYPES[1:4]]
    label = F.when(total == 0, "NONE")
    count = F.when(total == 0, F.lit(0))
    for condition, name, value in kinds:
        label, count = label.when(condition, name), count.when(condition, value)
    return stats.select("total", label.otherwise("OTHER").alias("main_type"), count.otherwise(total).alias("main_count"))


def merge_batch_alerts(details: DataFrame, batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """One alert row per finished batch.

    Severe findings always count, warnings unless the job asks for severe ones only. With findings the alert is a
    FAILURE listing them; without findings a successful batch gives a SUCCESS listing all rules. Batches already
    alerted, without details, or of jobs without an alert level give nothing. Lines are ordered by detail id.
    """
    alerting = jobs.filter(F.trim(F.coalesce("alert_level", F.lit(""))) != "").select("job_id", "alert_level")
    pending = batches.filter(~F.coalesce(F.col("alert_sent"), F.lit(False))).join(alerting, "job_id")
    level = F.col("result_level")
    findings = F.coalesce((level == "SEVERE") | ((level == "WARNING") & (F.upper("alert_level") != SEVERE_ONLY)), F.lit(False))
    line = F.concat(F.lit("["), level, F.lit("] "), F.col("rule_name"),
                    F.when(F.trim(F.coalesce("detail", F.lit(""))) != "", F.concat(F.lit(": "), "detail")).otherwise(""))
    rows = details.join(pending.select("batch_id", "job_id", "batch_status", "alert_level"), "batch_id").select(
        "batch_id", "job_id", "batch_status", findings.alias("hit"), F.struct("id", line.alias("line")).alias("item"))
    # Only lines that are shown are gathered: the findings of a failing batch, all lines of a clean, successful one.
    state = rows.groupBy("batch_id").agg(F.max("hit").alias("failing"))
    shown = rows.join(state, "batch_id").filter(
        F.col("hit") | (~F.col("failing") & (F.upper("batch_status") == "SUCCESS")))
    grouped = shown.groupBy("batch_id", "job_id", "failing").agg(F.sort_array(F.collect_list("item")).alias("lines"))
    return grouped.select(
        "batch_id", "job_id", F.when(F.col("failing"), "FAILURE").otherwise("SUCCESS").alias("alert_type"),
        F.size("lines").alias("items"), F.array_join(F.col("lines")["line"], "\n").alias("summary"))
