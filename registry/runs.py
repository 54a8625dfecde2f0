"""Run histories and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwell.operators import alerts, runs as ops
from brightwell.operators.table_query import total
from registry.base import Registry, shown
from registry.views import EVENT_CLOCK, RUN_CLOCK

R = Registry()
NOW = "TIMESTAMP '2001-08-02 00:00:00'"
COUNTS = ", ".join(f"COUNT(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in
                   ("RUNNING", "SUCCESS", "FAILED", "TERMINATED"))
DAILY = """COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'SUCCESS') AS success,
  COUNT(*) FILTER (WHERE status = 'FAILED') AS failed"""


@R.query("c19_run_status_counts", f"""
SELECT COUNT(*) AS total, {COUNTS} FROM exec_history
WHERE start_time >= TIMESTAMP '1996-01-01 00:00:00' AND start_time <= TIMESTAMP '2000-12-31 00:00:00'""")
def _(lake):
    return ops.status_counts(lake("exec_history"), ts="start_time", t_from="1996-01-01", t_to="2000-12-31")


@R.query("c19_check_level_counts", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE result_level = 'PASS') AS pass,
  COUNT(*) FILTER (WHERE result_level = 'WARNING') AS warning, COUNT(*) FILTER (WHERE result_level = 'SEVERE') AS severe,
  COUNT(*) FILTER (WHERE result_level = 'UNAVAILABLE') AS unavailable FROM check_detail""")
def _(lake):
    return ops.status_counts(lake("check_detail"), ("PASS", "WARNING", "SEVERE", "UNAVAILABLE"), "result_level")


@R.query("c19_task_flag_counts", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE enabled) AS enabled, COUNT(*) FILTER (WHERE NOT enabled) AS disabled
FROM task""")
def _(lake):
    return ops.flag_counts(lake("task"))


@R.query("c20_daily_runs", f"""
SELECT CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, {DAILY} FROM exec_history
WHERE start_time >= TIMESTAMP '1999-01-01 00:00:00' GROUP BY 1""")
def _(lake):
    return shown(ops.daily_runs(lake("exec_history"), "1999-01-01"))


@R.query("c21_run_trend", f"""
WITH days AS (SELECT CAST(TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 1 DAY * i AS DATE) AS day FROM range(14) t(i)),
counts AS (SELECT CAST(start_time AS DATE) AS day, {DAILY} FROM exec_history GROUP BY 1)
SELECT CAST(d.day AS VARCHAR) AS day, COALESCE(total, 0) AS total, COALESCE(success, 0) AS success,
  COALESCE(failed, 0) AS failed, COALESCE(failed * 100 > total * 10, FALSE) AS abnormal
FROM days d LEFT JOIN counts c ON c.day = d.day""")
def _(lake):
    return shown(ops.run_trend(lake("exec_history"), RUN_CLOCK))


def _rate(ok, bad):
    return (f"CASE WHEN {ok} + {bad} = 0 THEN NULL ELSE CAST((2000 * {ok} + {ok} + {bad}) // (2 * ({ok} + {bad})) "
            f"AS DOUBLE) / 10 END")


@R.query("c22_success_rate_delta", f"""
WITH c AS (SELECT COUNT(*) FILTER (WHERE start_time >= {NOW} - INTERVAL 30 DAY AND status = 'SUCCESS') AS s1,
  COUNT(*) FILTER (WHERE start_time >= {NOW} - INTERVAL 30 DAY AND status = 'FAILED') AS f1,
  COUNT(*) FILTER (WHERE start_time < {NOW} - INTERVAL 30 DAY AND status = 'SUCCESS') AS s0,
  COUNT(*) FILTER (WHERE start_time < {NOW} - INTERVAL 30 DAY AND status = 'FAILED') AS f0
  FROM exec_history WHERE start_time >= {NOW} - INTERVAL 60 DAY AND start_time < {NOW}),
r AS (SELECT {_rate('s1', 'f1')} AS rate, {_rate('s0', 'f0')} AS previous_rate FROM c)
SELECT rate, previous_rate, ROUND(rate - previous_rate, 1) AS delta FROM r""")
def _(lake):
    return shown(ops.success_rate_delta(lake("exec_history"), RUN_CLOCK, days=30))


@R.query("c23_today_vs_yesterday", """
SELECT t AS today, y AS yesterday, t - y AS delta, today_success, today_failed FROM (SELECT
  COUNT(*) FILTER (WHERE start_time >= TIMESTAMP '2001-08-01 00:00:00') AS t,
  COUNT(*) FILTER (WHERE start_time < TIMESTAMP '2001-08-01 00:00:00') AS y,
  COUNT(*) FILTER (WHERE start_time >= TIMESTAMP '2001-08-01 00:00:00' AND status = 'SUCCESS') AS today_success,
  COUNT(*) FILTER (WHERE start_time >= TIMESTAMP '2001-08-01 00:00:00' AND status = 'FAILED') AS today_failed
FROM exec_history WHERE start_time >= TIMESTAMP '2001-07-31 00:00:00' AND start_time < TIMESTAMP '2001-08-02 00:00:00') x""")
def _(lake):
    return ops.today_vs_yesterday(lake("exec_history"), "2001-08-01 18:00:00")


UNRESOLVED = """
WITH recent AS (SELECT * FROM exec_history WHERE start_time >= TIMESTAMP '2001-07-25 12:00:00'),
ok AS (SELECT kind, task_id, MAX(start_time) AS last_ok FROM recent WHERE status = 'SUCCESS' GROUP BY ALL),
bad AS (SELECT r.* FROM recent r LEFT JOIN ok ON ok.kind = r.kind AND ok.task_id = r.task_id
  WHERE status = 'FAILED' AND (last_ok IS NULL OR last_ok <= start_time))"""


@R.query("c24_unresolved_failures", UNRESOLVED + """
SELECT kind, task_id, MAX(start_time) AS last_failure,
  COUNT(*) FILTER (WHERE start_time > TIMESTAMP '2001-08-01 11:00:00') AS failed_last_hour FROM bad GROUP BY ALL""")
def _(lake):
    return ops.unresolved_failures(lake("exec_history"), "2001-08-01 12:00:00")


@R.query("c24_unresolved_summary", UNRESOLVED + """
SELECT COUNT(DISTINCT kind || task_id) AS pending_failed,
  COUNT(*) FILTER (WHERE start_time > TIMESTAMP '2001-08-01 11:00:00') AS failed_last_hour FROM bad""")
def _(lake):
    return ops.unresolved_summary(lake("exec_history"), "2001-08-01 12:00:00")


@R.query("c25_top_failures", f"""
SELECT kind, task_id, COUNT(*) AS fail_count, MAX(COALESCE(end_time, start_time)) AS last_failed_at FROM run_log
WHERE status = 'FAILED' AND start_time >= {NOW} - INTERVAL 14 DAY AND start_time < {NOW}
GROUP BY kind, task_id ORDER BY fail_count DESC, last_failed_at DESC, kind, task_id LIMIT 5""")
def _(lake):
    return ops.top_failures(lake("run_log"), RUN_CLOCK)


@R.query("c26_recent_runs", """
SELECT id, kind, task_id, status, start_time FROM exec_history ORDER BY start_time DESC NULLS LAST, id DESC LIMIT 8""")
def _(lake):
    return ops.recent_runs(lake("exec_history"))


@R.query("c27_latest_run_per_task", """
SELECT DISTINCT ON (kind, task_id) kind, task_id, id, status, start_time FROM exec_history
ORDER BY kind, task_id, start_time DESC NULLS LAST, id DESC""")
def _(lake):
    return ops.latest_run_per_task(lake("exec_history"))


@R.query("c28_runs_per_task", """
SELECT task_id, COUNT(*) AS total FROM exec_history WHERE start_time >= TIMESTAMP '2000-01-01 00:00:00' GROUP BY 1""")
def _(lake):
    from brightwell.operators.call_log import counts_by
    return counts_by(lake("exec_history"), "task_id", since="2000-01-01", ts="start_time")


STATS = """SELECT COUNT(*) FILTER (WHERE alert_type = 'FAILURE') AS failure,
  COUNT(*) FILTER (WHERE alert_type = 'TIMEOUT') AS timeout,
  COUNT(*) FILTER (WHERE alert_type = 'LAG_EXCEEDED') AS lag_exceeded,
  COUNT(*) FILTER (WHERE alert_type = 'EXTERNAL_STOP') AS external_stop,
  COUNT(*) FILTER (WHERE alert_type = 'SUCCESS') AS success, COUNT(*) FILTER (WHERE send_status = 'FAILED') AS send_failed,
  COUNT(*) FILTER (WHERE alert_type <> 'SUCCESS') AS total FROM alert_history"""


@R.query("c29_alert_stats", f"""{STATS}
WHERE sent_at >= TIMESTAMP '2024-01-10 00:00:00' AND sent_at <= TIMESTAMP '2024-01-20 00:00:00' AND object_type = 'DAG'""")
def _(lake):
    return alerts.alert_stats(lake("alert_history"), "2024-01-10", "2024-01-20", "DAG")


@R.query("c29_alert_headline", f"""
WITH s AS ({STATS} WHERE sent_at >= TIMESTAMP '2024-01-30 00:00:00' AND sent_at <= TIMESTAMP '2024-01-31 00:00:00')
SELECT total, CASE WHEN total = 0 THEN 'NONE' WHEN failure >= total - failure THEN 'FAILURE' WHEN timeout > 0 THEN 'TIMEOUT'
  WHEN lag_exceeded > 0 THEN 'LAG_EXCEEDED' WHEN external_stop > 0 THEN 'EXTERNAL_STOP' ELSE 'OTHER' END AS main_type,
  CASE WHEN total = 0 THEN 0 WHEN failure >= total - failure THEN failure WHEN timeout > 0 THEN timeout
  WHEN lag_exceeded > 0 THEN lag_exceeded WHEN external_stop > 0 THEN external_stop ELSE total END AS main_count FROM s""")
def _(lake):
    return alerts.alert_headline(alerts.alert_stats(lake("alert_history"), "2024-01-30", EVENT_CLOCK))


@R.query("c32_merged_batch_alerts", """
WITH j AS (SELECT d.*, b.job_id, b.batch_status, a.alert_level,
    result_level = 'SEVERE' OR (result_level = 'WARNING' AND alert_level = 'SEVERE_WARNING') AS hit,
    '[' || result_level || '] ' || rule_name || CASE WHEN detail IS NULL THEN '' ELSE ': ' || detail END AS line
  FROM batch_detail d JOIN alert_batch b ON b.batch_id = d.batch_id AND NOT b.alert_sent
  JOIN alert_job a ON a.job_id = b.job_id AND a.alert_level IS NOT NULL),
g AS (SELECT batch_id, job_id, batch_status, COUNT(*) FILTER (WHERE hit) AS hits, COUNT(*) AS n,
    string_agg(line, chr(10) ORDER BY id) FILTER (WHERE hit) AS hit_lines, string_agg(line, chr(10) ORDER BY id) AS all_lines
  FROM j GROUP BY ALL)
SELECT batch_id, job_id, CASE WHEN hits > 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS alert_type,
  CAST(CASE WHEN hits > 0 THEN hits ELSE n END AS INT) AS items, CASE WHEN hits > 0 THEN hit_lines ELSE all_lines END AS summary
FROM g WHERE hits > 0 OR batch_status = 'SUCCESS'""")
def _(lake):
    return alerts.merge_batch_alerts(lake("batch_detail"), lake("alert_batch"), lake("alert_job"))


@R.query("c33_timeout_scan", """
SELECT id, kind, r.task_id, start_time, COALESCE(timeout_minutes, 30) AS limit_minutes FROM run_log r
LEFT JOIN task t ON t.task_id = r.task_id WHERE status = 'RUNNING'
  AND start_time < TIMESTAMP '2000-06-01 12:00:00' - INTERVAL 1 MINUTE * COALESCE(timeout_minutes, 30)""")
def _(lake):
    return ops.timeout_scan(lake("run_log"), lake("task"), "2000-06-01 12:00:00")


def _expired(condition, minutes, message):
    late = f"{condition} AND start_time < TIMESTAMP '2000-06-01 12:00:00' - INTERVAL {minutes} MINUTE"
    return f"""SELECT id, kind, task_id, start_time, queue_id, priority,
  CASE WHEN {late} THEN 'FAILED' ELSE status END AS status,
  CASE WHEN {late} THEN TIMESTAMP '2000-06-01 12:00:00' ELSE end_time END AS end_time, trigger_type,
  CASE WHEN {late} THEN date_diff('millisecond', start_time, TIMESTAMP '2000-06-01 12:00:00') END AS duration_ms,
  CASE WHEN {late} THEN '{message}' END AS error FROM run_log"""


@R.query("c34_reap_stuck_runs", _expired("status = 'RUNNING'", 120, "stuck run closed"))
def _(lake):
    return ops.reap_stuck(lake("run_log"), "2000-06-01 12:00:00")


@R.query("c35_missed_triggers", """
WITH ended AS (SELECT node_id, MAX(end_time) AS end_time FROM node_run WHERE status = 'SUCCESS' AND end_time IS NOT NULL
    AND run_start >= TIMESTAMP '2001-07-01 00:00:00' AND run_start < TIMESTAMP '2001-07-30 23:55:00' GROUP BY node_id),
  pairs AS (SELECT DISTINCT e.node_id, e.end_time, b.job_id FROM ended e JOIN node_binding b ON b.node_id = e.node_id AND enabled)
SELECT node_id, MAX(end_time) AS end_time, COUNT(*) AS missing_jobs FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM auto_batch a
  WHERE a.job_id = p.job_id AND trigger_type = 'AUTO_TRIGGER' AND created_at >= p.end_time - INTERVAL 1 MINUTE) GROUP BY node_id""")
def _(lake):
    return ops.missed_triggers(lake("node_run"), lake("node_binding"), lake("auto_batch"), "2001-07-31", hours=720)


@R.query("c36_admission", """
WITH used AS (SELECT queue_id, COUNT(*) AS used FROM run_log WHERE status = 'RUNNING' GROUP BY 1),
slots AS (SELECT q.queue_id, COALESCE(capacity, 10) - COALESCE(used, 0) AS slots FROM queue q LEFT JOIN used u
  ON u.queue_id = q.queue_id),
ranked AS (SELECT id, queue_id, priority, start_time, CAST(ROW_NUMBER() OVER (PARTITION BY queue_id
  ORDER BY priority DESC, start_time, id) AS INT) AS position FROM run_log WHERE status = 'WAITING')
SELECT r.* FROM ranked r JOIN slots s ON s.queue_id = r.queue_id WHERE position <= slots""")
def _(lake):
    runs = lake("run_log")
    return ops.admit(runs.filter("status = 'WAITING'").select("id", "queue_id", "priority", "start_time"),
                     runs.filter("status = 'RUNNING'"), lake("queue"))


@R.query("c37_expire_waiting", _expired("status = 'WAITING'", 60, "waiting timed out"))
def _(lake):
    return ops.expire_waiting(lake("run_log"), "2000-06-01 12:00:00", 60)


CRON_RUNS = {"owner_like": "Task_1", "statuses": "SUCCESS", "trigger": "CRON", "t_from": "1997-01-01", "t_to": "2001-01-01"}


@R.query("c38_run_page", """
WITH p AS (SELECT r.*, t.task_name FROM run_log r JOIN task t ON t.task_id = r.task_id
  WHERE contains(lower(task_name), 'task_1') AND status = 'SUCCESS' AND trigger_type = 'CRON'
    AND start_time >= TIMESTAMP '1997-01-01 00:00:00' AND start_time < TIMESTAMP '2001-01-01 00:00:00'
  ORDER BY start_time DESC, r.id DESC LIMIT 20 OFFSET 20)
SELECT p.id, kind, task_id, task_name, status, trigger_type, start_time, COUNT(node_no) AS nodes,
  COUNT(*) FILTER (WHERE node_status = 'SUCCESS') AS nodes_ok, COUNT(*) FILTER (WHERE node_status = 'FAILED') AS nodes_failed
FROM p LEFT JOIN run_node n ON n.run_id = p.id GROUP BY ALL""")
def _(lake):
    return ops.run_page(lake("run_log"), lake("task"), lake("run_node"), page=2, **CRON_RUNS)


@R.query("c38_run_total", """
SELECT COUNT(*) AS total FROM run_log r JOIN task t ON t.task_id = r.task_id
WHERE contains(lower(task_name), 'task_1') AND status = 'SUCCESS' AND trigger_type = 'CRON'
  AND start_time >= TIMESTAMP '1997-01-01 00:00:00' AND start_time < TIMESTAMP '2001-01-01 00:00:00'""")
def _(lake):
    return total(ops.run_list(lake("run_log"), lake("task"), **CRON_RUNS))


@R.query("c38_run_page_of_projects", """
WITH p AS (SELECT r.*, t.task_name FROM run_log r JOIN task t ON t.task_id = r.task_id JOIN project j ON j.project_id = t.project_id
  WHERE contains(lower(project_name), 't_1') AND contains(lower(task_name), '1') ORDER BY start_time DESC, r.id DESC LIMIT 30)
SELECT p.id, kind, task_id, task_name, status, trigger_type, start_time, COUNT(node_no) AS nodes,
  COUNT(*) FILTER (WHERE node_status = 'SUCCESS') AS nodes_ok, COUNT(*) FILTER (WHERE node_status = 'FAILED') AS nodes_failed
FROM p LEFT JOIN run_node n ON n.run_id = p.id GROUP BY ALL""")
def _(lake):
    return ops.run_page(lake("run_log"), lake("task"), lake("run_node"), size=30, owner_like="1", project_like="T_1",
                        projects=lake("project"))


@R.query("c38_runs_of_one_owner", "SELECT id, kind, task_id, status, start_time FROM run_log WHERE task_id = 7")
def _(lake):
    return ops.run_list(lake("run_log"), lake("task"), owner_id=7).select("id", "kind", "task_id", "status", "start_time")


@R.query("c39_queue_load", """
SELECT q.queue_id, (SELECT COUNT(*) FROM run_log r WHERE r.queue_id = q.queue_id AND status = 'RUNNING') AS running,
  (SELECT COUNT(*) FROM run_log r WHERE r.queue_id = q.queue_id AND status = 'WAITING') AS waiting,
  (SELECT COUNT(*) FROM task t WHERE t.queue_id = q.queue_id) AS owners FROM queue q""")
def _(lake):
    return ops.queue_load(lake("queue"), lake("run_log"), lake("task"))


@R.query("a8_due_retries", """
SELECT h.id, h.job_id, h.id AS parent_history_id, retry_count + 1 AS attempt, max_retries - retry_count - 1 AS remaining,
  TIMESTAMP '2001-01-01 00:00:00' + INTERVAL 1 MINUTE * COALESCE(retry_interval_minutes, 5) AS next_retry_at
FROM retry_history h JOIN retry_job j ON j.job_id = h.job_id AND enabled
WHERE status = 'FAILED' AND next_retry_at <= TIMESTAMP '2001-01-01 00:00:00' AND max_retries - retry_count > 0""")
def _(lake):
    return ops.due_retries(lake("retry_history"), lake("retry_job"), "2001-01-01")
