"""Run histories: status counts, trends, recovery, time-outs, admission and listings.

A run frame has ``id, kind, task_id, status, start_time`` and, where needed, ``end_time, queue_id, priority``. The
two logs of the platform (task graphs and table syncs) are one frame told apart by ``kind``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brightwell.functions.values import ago, count_when, half_open, interval, ntz, percent
from brightwell.plans.lineage_cut import cut_lineage
from brightwell.plans.seek import page_of
from brightwell.plans.topk import ranked_up_to

# Statuses and default limits.
STATUSES = ("RUNNING", "SUCCESS", "FAILED", "TERMINATED")
ABNORMAL_FAILURE_PCT = 10
DEFAULT_TIMEOUT_MINUTES = 30
STUCK_MINUTES = 120
QUEUE_CAPACITY = 10
RECONCILE_HOURS, RECONCILE_MARGIN_MINUTES, BATCH_TOLERANCE_MINUTES = 2, 5, 1
RETRY_INTERVAL_MINUTES = 5



def _start() -> Column:
    return F.col("start_time")


def _state() -> Column:
    return F.col("status")


def status_counts(df: DataFrame, values: Sequence[str] = STATUSES, col: str = "status", ts: str | None = None,
                  t_from=None, t_to=None) -> DataFrame:
    """Rows in total and per status, optionally within a closed time range, in one pass."""
    if ts is not None and t_from is not None:
        df = df.filter(F.col(ts) >= ntz(t_from))
    if ts is not None and t_to is not None:
        df = df.filter(F.col(ts) <= ntz(t_to))
    return df.agg(F.count("*").alias("total"),
                  *[count_when(F.col(col) == v).alias(v.lower()) for v in values])


def flag_counts(df: DataFrame, flag: str = "enabled") -> DataFrame:
    return df.agg(F.count("*").alias("total"), count_when(F.col(flag)).alias("enabled"),
                  count_when(~F.col(flag)).alias("disabled"))


def _daily() -> list[Column]:
    return [F.count("*").alias("total"), count_when(_state() == "SUCCESS").alias("success"),
            count_when(_state() == "FAILED").alias("failed")]


def daily_runs(history: DataFrame, since) -> DataFrame:
    """Runs per calendar day. Grouping is on the date, so equal days of different years stay apart."""
    return history.filter(_start() >= ntz(since)).groupBy(F.to_date("start_time").alias("day")).agg(*_daily())


def run_trend(history: DataFrame, as_of, days: int = 14) -> DataFrame:
    """One row per calendar day up to ``as_of``, days without runs included, with an abnormal-day flag."""
    today = F.to_date(ntz(as_of))
    calendar = history.sparkSession.range(days).select(F.date_sub(today, F.col("id").cast("int")).alias("day"))
    counts = daily_runs(history, F.date_sub(today, days - 1)).filter(F.col("day") <= today)
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "success", "failed")]
    return calendar.join(counts, "day", "left").select("day", *filled).withColumn(
        "abnormal", (F.col("total") > 0) & (F.col("failed") * 100 > F.col("total") * ABNORMAL_FAILURE_PCT))


def success_rate_delta(history: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Success share of finished runs now and in the period before; null without samples. Ranges are half-open."""
    edge, first = ago(as_of, days=days), ago(as_of, days=2 * days)
    current = _start() >= edge
    counts = history.filter(half_open(_start(), first, as_of)).agg(
        count_when(current & (_state() == "SUCCESS")).alias("s1"), count_when(current & (_state() == "FAILED")).alias("f1"),
        count_when(~current & (_state() == "SUCCESS")).alias("s0"), count_when(~current & (_state() == "FAILED")).alias("f0"))
    rates = counts.select(percent(F.col("s1"), F.col("s1") + F.col("f1"), 1).alias("rate"),
                          percent(F.col("s0"), F.col("s0") + F.col("f0"), 1).alias("previous_rate"))
    return rates.withColumn("delta", F.col("rate") - F.col("previous_rate"))


def today_vs_yesterday(history: DataFrame, as_of) -> DataFrame:
    midnight = F.date_trunc("day", ntz(as_of)).cast("timestamp_ntz")
    today = _start() >= midnight
    return history.filter(half_open(_start(), midnight - interval(days=1), midnight + interval(days=1))).agg(
        count_when(today).alias("today"), count_when(~today).alias("yesterday"),
        (count_when(today) - count_when(~today)).alias("delta"),
        count_when(today & (_state() == "SUCCESS")).alias("today_success"),
        count_when(today & (_state() == "FAILED")).alias("today_failed"))


def unresolved_failures(history: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Tasks whose latest failure was not followed by a success, and unresolved failed runs of the last hour.

    A failure is unresolved when no success of its task started later, so the latest failure and the latest success
    decide the task, and one aggregation answers it. Failures of the last hour are counted per task next to that:
    those after the latest success are the unresolved ones, kept by collecting only distinct start times of one hour
    with their counts.
    """
    recent = history.filter(_start() >= ago(as_of, days=days))
    failed, last_hour = _state() == "FAILED", _start() > ago(as_of, hours=1)
    keys = ["kind", "task_id"]
    # Pre-aggregated on the start time, so a hot task reaches the second step as one row per distinct moment.
    moments = recent.filter(failed & last_hour).groupBy(*keys, "start_time").agg(F.count("*").alias("n"))
    tasks = recent.groupBy(*keys).agg(
        F.max(F.when(failed, _start())).alias("last_failure"), F.max(F.when(_state() == "SUCCESS", _start())).alias("last_ok"))
    late = moments.join(tasks.select(*keys, "last_ok"), keys).filter(
        F.col("last_ok").isNull() | (F.col("last_ok") <= _start()))
    late_counts = late.groupBy(*keys).agg(F.sum("n").alias("failed_last_hour"))
    open_tasks = tasks.filter(F.col("last_failure").isNotNull() & (
        F.col("last_ok").isNull() | (F.col("last_ok") <= F.col("last_failure"))))
    return open_tasks.join(late_counts, keys, "left").select(
        *keys, "last_failure", F.coalesce("failed_last_hour", F.lit(0)).alias("failed_last_hour"))


def unresolved_summary(history: DataFrame, as_of, days: int = 7) -> DataFrame:
    return unresolved_failures(history, as_of, days).agg(
        F.count("*").alias("pending_failed"),
        F.coalesce(F.sum("failed_last_hour"), F.lit(0)).alias("failed_last_hour"))


def top_failures(history: DataFrame, as_of, days: int = 14, n: int = 5) -> DataFrame:
    return history.filter((_state() == "FAILED") & half_open(_start(), ago(as_of, days=days), as_of)).groupBy(
        "kind", "task_id").agg(
        F.count("*").alias("fail_count"), F.max(F.coalesce("end_time", "start_time")).alias("last_failed_at")
    ).orderBy(F.desc("fail_count"), F.desc("last_failed_at"), "kind", "task_id").limit(n)


def recent_runs(history: DataFrame, n: int = 8) -> DataFrame:
    """The newest runs of all logs; a top-n over the union equals the merge of per-log top-n lists."""
    return history.orderBy(F.desc_nulls_last("start_time"), F.desc("id")).limit(n)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row per key by ``order`` as an aggregation, so each task sends one row per key to the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*")


def latest_run_per_task(history: DataFrame) -> DataFrame:
    return latest_by(history, ["kind", "task_id"], [_start(), F.col("id")])


def timeout_scan(runs: DataFrame, tasks: DataFrame, as_of, default_minutes: int = DEFAULT_TIMEOUT_MINUTES) -> DataFrame:
    limit = F.coalesce(F.col("timeout_minutes"), F.lit(default_minutes))
    joined = runs.filter(_state() == "RUNNING").join(
        tasks.select("task_id", "timeout_minutes"), "task_id", "left")
    return joined.filter(_start() < ntz(as_of) - F.make_dt_interval(mins=limit)).select(
        "id", "kind", "task_id", "start_time", limit.alias("limit_minutes"))


def reap_stuck(runs: DataFrame, as_of, minutes: int = STUCK_MINUTES) -> DataFrame:
    """Runs left RUNNING too long become FAILED as of now; a missing duration is filled."""
    stuck = (_state() == "RUNNING") & (_start() < ago(as_of, mins=minutes))
    return _expire(runs, stuck, as_of, "stuck run closed")


def expire_waiting(runs: DataFrame, as_of, minutes: int) -> DataFrame:
    return _expire(runs, (_state() == "WAITING") & (_start() < ago(as_of, mins=minutes)), as_of, "waiting timed out")


def _expire(runs: DataFrame, late: Column, as_of, message: str) -> DataFrame:
    elapsed = F.timestamp_diff("MILLISECOND", _start(), ntz(as_of))
    duration = F.col("duration_ms") if "duration_ms" in runs.columns else F.lit(None).cast("bigint")
    return runs.withColumns({
        "duration_ms": F.when(late, F.coalesce(duration, elapsed)).otherwise(duration),
        "end_time": F.when(late, ntz(as_of)).otherwise(F.col("end_time")),
        "error": F.when(late, message),
        "status": F.when(late, "FAILED").otherwise(_state()),
    })


def missed_triggers(nodes: DataFrame, bindings: DataFrame, batches: DataFrame, as_of,
                    hours: int = RECONCILE_HOURS) -> DataFrame:
    """Nodes that succeeded in the scan window but lack an automatic check batch of some bound, enabled job.

    ``nodes``: node_id, status, end_time, run_start; ``bindings``: node_id, job_id, enabled; ``batches``: job_id,
    trigger_type, created_at. Only the newest batch per job matters for "created at or after", so the range test
    runs against one row per job.
    """
    window = half_open(F.col("run_start"), ago(as_of, hours=hours),
                       ago(as_of, mins=RECONCILE_MARGIN_MINUTES))
    ended = nodes.filter((_state() == "SUCCESS") & window & F.col("end_time").isNotNull()).groupBy("node_id").agg(
        F.max("end_time").alias("end_time"))
    newest = batches.filter(F.col("trigger_type") == "AUTO_TRIGGER").groupBy("job_id").agg(
        F.max("created_at").alias("newest_batch"))
    uncovered = F.col("newest_batch").isNull() | (
        F.col("newest_batch") < F.col("end_time") - interval(mins=BATCH_TOLERANCE_MINUTES))
    return ended.join(bindings.filter("enabled").select("node_id", "job_id").distinct(), "node_id").join(
        newest, "job_id", "left").filter(uncovered).groupBy("node_id").agg(
        F.max("end_time").alias("end_time"), F.count("*").alias("missing_jobs"))


def admit(waiting: DataFrame, running: DataFrame, queues: DataFrame) -> DataFrame:
    """Per queue the first ``capacity - running`` waiting runs, by priority then age."""
    settings = queues.select("queue_id", F.coalesce("capacity", F.lit(QUEUE_CAPACITY)).alias("capacity"))
    used = running.groupBy("queue_id").agg(F.count("*").alias("used"))
    slots = settings.join(used, "queue_id", "left").select(
        "queue_id", (F.col("capacity") - F.coalesce("used", F.lit(0))).alias("slots"))
    return ranked_up_to(waiting, ["queue_id"], [F.desc("priority"), F.asc("start_time"), F.asc("id")], slots, "slots")


def run_list(runs: DataFrame, owners: DataFrame, owner_like: str | None = None, statuses: str | None = None,
             trigger: str | None = None, t_from=None, t_to=None, owner_id: int | None = None,
             project_like: str | None = None, projects: DataFrame | None = None) -> DataFrame:
    """Runs with their owner's name under optional filters; count them for the total that goes with a page.

    Owners are narrowed by a part of their own name and of their project's (``projects``: project_id, project_name),
    runs by the exact owner, status, trigger and a half-open time range.
    """
    from brightwell.functions.values import escaped_contains

    rows = runs
    if owner_id is not None:
        rows = rows.filter(F.col("task_id") == owner_id)
    if statuses:
        rows = rows.filter(_state() == statuses)
    if trigger:
        rows = rows.filter(F.col("trigger_type") == trigger)
    if t_from is not None or t_to is not None:
        rows = rows.filter(half_open(_start(), t_from, t_to))
    named = owners
    if owner_like:
        named = named.filter(escaped_contains(F.col("task_name"), owner_like))
    if project_like:
        mine = projects.filter(escaped_contains(F.col("project_name"), project_like)).select("project_id")
        named = named.join(mine, "project_id", "left_semi")
    return rows.join(named.select("task_id", "task_name"), "task_id", "inner" if owner_like or project_like else "left")


def run_page(runs: DataFrame, owners: DataFrame, nodes: DataFrame, page: int = 1, size: int = 20,
             after: Mapping[str, object] | None = None, **filters) -> DataFrame:
    """One page of :func:`run_list`, newest first, with node counts per status; ``after`` as in :func:`seek.page_of`.

    Filters come first, the page is cut and written next, and node rows are counted only for the runs on the page.
    """
    rows = run_list(runs, owners, **filters)
    paged = cut_lineage(page_of(rows, [("start_time", True), ("id", True)], size, page, after))
    on_page = nodes.join(F.broadcast(paged.select(F.col("id").alias("run_id"))), "run_id", "left_semi")  # <= size rows
    counts = on_page.groupBy("run_id").agg(
        F.count("*").alias("nodes"), count_when(F.col("node_status") == "SUCCESS").alias("nodes_ok"),
        count_when(F.col("node_status") == "FAILED").alias("nodes_failed"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "nodes_ok", "nodes_failed")]
    return paged.join(counts, paged["id"] == counts["run_id"], "left").select(
        "id", "kind", "task_id", "task_name", "status", "trigger_type", "start_time", *zero)


def queue_load(queues: DataFrame, runs: DataFrame, owners: DataFrame) -> DataFrame:
    load = runs.filter(_state().isin("RUNNING", "WAITING")).groupBy("queue_id").agg(
        count_when(_state() == "RUNNING").alias("running"), count_when(_state() == "WAITING").alias("waiting"))
    bound = owners.groupBy("queue_id").agg(F.count("*").alias("owners"))
    return queues.select("queue_id").join(load, "queue_id", "left").join(bound, "queue_id", "left").select(
        "queue_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("running", "waiting", "owners")])


def due_retries(history: DataFrame, jobs: DataFrame, as_of, minutes: int = RETRY_INTERVAL_MINUTES) -> DataFrame:
    """Failed runs whose retry is due and whose job still has attempts left, with the next attempt scheduled."""
    due = history.filter((_state() == "FAILED") & (F.col("next_retry_at") <= ntz(as_of)))
    left = F.col("max_retries") - F.col("retry_count")
    return due.join(
        jobs.filter("enabled").select("job_id", "max_retries", "retry_interval_minutes"), "job_id").filter(
        left > 0).select(
        "id", "job_id", F.col("id").alias("parent_history_id"), (F.col("retry_count") + 1).alias("attempt"),
        (left - 1).alias("remaining"),
        (ntz(as_of) + F.make_dt_interval(mins=F.coalesce("retry_interval_minutes", F.lit(minutes)))).alias(
            "next_retry_at"))
