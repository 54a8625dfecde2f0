"""Check rules, scores and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwell.functions.values import ntz
from brightwell.operators import quality as ops, quality_report as report
from brightwell.operators.quality import Rule
from registry.base import Registry, shown
from registry.views import EVENT_CLOCK

R = Registry()
SCOPE = report.Scope(as_of=EVENT_CLOCK)
RANGE = "BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"


def _share(part, whole, places=6):
    """Half-up rounded share of two counts, in whole-number arithmetic."""
    unit = 10 ** places
    return f"COALESCE(CAST((2 * {unit} * ({part}) + ({whole})) // NULLIF(2 * ({whole}), 0) AS DOUBLE) / {unit}, 0)"


def _mean(col):
    total = f"CAST(SUM(CAST({col} * 100 AS BIGINT)) AS BIGINT)"
    return f"CAST((2 * {total} + COUNT({col})) // (2 * COUNT({col})) AS DOUBLE) / 100"


@R.query("d1_completeness", f"SELECT {_share('COUNT(*) - COUNT(duration_ms)', 'COUNT(*)')} AS null_rate FROM call_log")
def _(lake):
    return shown(ops.completeness(lake("call_log"), "duration_ms"))


@R.query("d2_whole_row_completeness", f"""
SELECT {_share('COUNT(*) FILTER (WHERE end_time IS NULL OR status IS NULL OR start_time IS NULL)', 'COUNT(*)')} AS null_rate
FROM run_log""")
def _(lake):
    return shown(ops.completeness(lake("run_log")))


@R.query("d3_uniqueness", """
SELECT CAST(COUNT(*) - COUNT(DISTINCT duration_ms) AS DOUBLE) AS duplicate_count FROM call_log""")
def _(lake):
    return shown(ops.uniqueness(lake("call_log"), "duration_ms"))


@R.query("d4_value_range", f"""
SELECT {_share('COUNT(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45.5)', 'COUNT(*)')} AS out_of_range_rate FROM lineitem""")
def _(lake):
    return shown(ops.value_range(lake("lineitem"), "l_quantity", 5, 45.5))


RULES = [
    Rule(1, "orders", "COMPLETENESS", "o_totalprice", severe="0.1", warning="0.01", weight=3, table_id=1),
    Rule(2, "orders", "UNIQUENESS", "o_orderkey", warning="1", weight=2, table_id=1),
    Rule(3, "orders", "RANGE", "o_totalprice", 1000, 400000, warning="0.005", severe="0.2", weight=1, table_id=1),
    Rule(4, "orders", "CUSTOM_SQL", sql="SELECT count(*) AS n, count_if(o_orderstatus = 'P') AS open FROM {orders}",
         metric="OPEN", warning="100", severe="100000", table_id=1),
    Rule(5, "lineitem", "COMPLETENESS", None, severe="0.5", weight=4, table_id=2),
    Rule(6, "lineitem", "UNIQUENESS", "l_orderkey", warning="10", severe="100000000", weight=1, table_id=2),
    Rule(7, "lineitem", "RANGE", "l_discount", 0, 0.05, warning="0.2", severe="0.9", weight=0, table_id=2),
    Rule(8, "lineitem", "RANGE", "no_such_column", 0, 1, warning="0.2", table_id=2),
    Rule(9, "call_log", "COMPLETENESS", "duration_ms", warning="0.01", severe="0.05", weight=2, table_id=3),
    Rule(10, "call_log", "UNIQUENESS", "duration_ms", warning="10", severe="20", weight=5, table_id=3),
    Rule(11, "customer", "CUSTOM_SQL", sql="SELECT avg(no_such_column) FROM {customer}", warning="1", table_id=4),
    Rule(12, "supplier", "PYTHON", check=lambda df: {"negative": df.filter("s_acctbal < 0").count()},
         metric="negative", warning="1", severe="1000000", weight=2, table_id=5),
    Rule(13, "supplier", "COMPLETENESS", "s_name", warning="0.5", weight=2, table_id=5),
]


def _details_sql():
    def value(rule):
        if rule.kind == "COMPLETENESS":
            return _share(f"COUNT(*) - COUNT({rule.column or 'l_orderkey'})", "COUNT(*)")
        if rule.kind == "UNIQUENESS":
            return f"CAST(COUNT(*) - COUNT(DISTINCT {rule.column}) AS DOUBLE)"
        if rule.kind == "RANGE":
            return _share(f"COUNT(*) FILTER (WHERE {rule.column} < {rule.low} OR {rule.column} > {rule.high})", "COUNT(*)")
        return {4: "CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE)",
                12: "CAST(COUNT(*) FILTER (WHERE s_acctbal < 0) AS DOUBLE)"}[rule.rule_id]

    parts = []
    for r in RULES:
        lead = f"CAST({r.rule_id} AS BIGINT) AS rule_id, CAST({r.table_id} AS BIGINT) AS table_id, '{r.kind}' AS kind"
        tail = ", ".join(f"CAST({'NULL' if v is None else v} AS {t}) AS {n}" for v, t, n in (
            (r.weight, "INT", "weight"), (r.warning, "DOUBLE", "warning"), (r.severe, "DOUBLE", "severe")))
        if r.rule_id in (8, 11):
            parts.append(f"SELECT {lead}, CAST(NULL AS DOUBLE) AS result_value, FALSE AS success, {tail}")
        else:
            parts.append(f"SELECT {lead}, {value(r)} AS result_value, TRUE AS success, {tail} FROM {r.table}")
    return f"""SELECT rule_id, table_id, kind, weight, result_value, success, CASE WHEN NOT success THEN 'UNAVAILABLE'
  WHEN warning IS NULL AND severe IS NULL THEN 'PASS' WHEN result_value >= severe THEN 'SEVERE'
  WHEN result_value >= warning THEN CASE WHEN severe IS NULL THEN 'SEVERE' ELSE 'WARNING' END ELSE 'PASS' END AS result_level
FROM ({' UNION ALL '.join(parts)}) p"""


def _run(lake):
    return ops.run_rules(lake.spark, {n: lake(n) for n in ("orders", "lineitem", "call_log", "customer", "supplier")},
                         RULES)


@R.query("d7_run_rules", _details_sql())
def _(lake):
    return shown(_run(lake).select("rule_id", "table_id", "kind", "weight", "result_value", "success", "result_level"))


def _scores_sql(results):
    """Scores from rows of (table_id, weight, result_level) in whole-number arithmetic of a millionth."""
    return f"""
s AS (SELECT table_id, CAST(SUM(w) AS BIGINT) AS vw,
    CAST(COALESCE(SUM(w) FILTER (WHERE result_level = 'PASS'), 0) AS BIGINT) AS pw,
    CAST(COALESCE(SUM(w) FILTER (WHERE result_level = 'WARNING'), 0) AS BIGINT) AS ww,
    CAST(COALESCE(SUM(w) FILTER (WHERE result_level = 'SEVERE'), 0) AS BIGINT) AS sw,
    COUNT(*) FILTER (WHERE result_level = 'PASS') AS pass_rules, COUNT(*) FILTER (WHERE result_level = 'WARNING') AS warning_rules,
    COUNT(*) FILTER (WHERE result_level = 'SEVERE') AS severe_rules
  FROM (SELECT table_id, result_level, CASE WHEN weight > 0 THEN weight ELSE 1 END AS w FROM {results}
    WHERE result_level IS NOT NULL AND result_level <> 'UNAVAILABLE') x GROUP BY table_id),
b AS (SELECT *, GREATEST((200000000 * pw + vw) // (2 * vw) - 1000000 * (10 * ww + 30 * sw), 0) AS micro FROM s),
c AS (SELECT *, CASE WHEN severe_rules > 0 THEN LEAST((micro + 5000) // 10000, 5999) ELSE (micro + 5000) // 10000 END AS cent FROM b)
SELECT table_id, CAST(cent AS DOUBLE) / 100 AS score, pass_rules, warning_rules, severe_rules,
  CASE WHEN severe_rules > 0 THEN 'BAD' WHEN cent >= 8500 THEN 'EXCELLENT' WHEN cent >= 7500 THEN 'GOOD'
       WHEN cent >= 6000 THEN 'WARNING' ELSE 'BAD' END AS health_level FROM c"""


@R.query("d11_table_scores_from_rules", f"WITH r AS ({_details_sql()}), {_scores_sql('r')}")
def _(lake):
    return shown(ops.table_scores(_run(lake)))


LATEST = """latest AS (SELECT rule_id, ARG_MAX(result_level, id) AS result_level FROM check_detail GROUP BY rule_id),
r AS (SELECT q.rule_id, q.table_id, q.weight, l.result_level FROM quality_rule q LEFT JOIN latest l ON l.rule_id = q.rule_id
  WHERE enabled)"""


@R.query("d11_table_scores_from_history", f"WITH {LATEST}, {_scores_sql('r')}")
def _(lake):
    return shown(ops.table_scores(ops.rule_results(lake("quality_rule"), lake("check_detail"))))


@R.query("d12_health_with_other_limits", f"""
WITH {LATEST}, {_scores_sql('r').replace('(10 * ww + 30 * sw)', '(5 * ww + 20 * sw)').replace('5999', '4999').replace('cent >= 6000', 'cent >= 5000')}""")
def _(lake):
    return shown(ops.table_scores(ops.rule_results(lake("quality_rule"), lake("check_detail")), 5, 20, 50))


@R.query("d5_custom_sql", """
SELECT CAST(ROUND(MAX(n), 6) AS DOUBLE) AS result_value FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) x""")
def _(lake):
    rule = Rule(1, "orders", "CUSTOM_SQL", metric="Busiest",
                sql="SELECT 'x' AS label, max(n) AS busiest FROM (SELECT count(*) AS n FROM {orders} GROUP BY o_custkey)")
    return shown(ops.run_rules(lake.spark, {"orders": lake("orders")}, [rule]).select("result_value"))


@R.query("d6_levels", """
SELECT id, CASE WHEN result_value >= 400 THEN 'SEVERE' WHEN result_value >= 200 THEN 'WARNING' ELSE 'PASS' END AS both_limits,
  CASE WHEN result_value >= 200 THEN 'SEVERE' ELSE 'PASS' END AS warning_only,
  CASE WHEN result_value >= 400 THEN 'SEVERE' ELSE 'PASS' END AS severe_only, 'PASS' AS no_limits FROM check_detail""")
def _(lake):
    value, none = F.col("result_value"), F.lit(None).cast("decimal(20,6)")
    lo, hi = F.lit(200).cast("decimal(20,6)"), F.lit(400).cast("decimal(20,6)")
    return lake("check_detail").select(
        "id", ops.level(value, lo, hi).alias("both_limits"), ops.level(value, lo, none).alias("warning_only"),
        ops.level(value, none, hi).alias("severe_only"), ops.level(value, none, none).alias("no_limits"))


@R.query("d8_batch_status", """
SELECT batch_id, COUNT(*) FILTER (WHERE result_level <> 'SEVERE') AS succeeded,
  COUNT(*) FILTER (WHERE result_level = 'SEVERE') AS failed,
  CASE WHEN COUNT(*) FILTER (WHERE result_level = 'SEVERE') = 0 THEN 'SUCCESS'
       WHEN COUNT(*) FILTER (WHERE result_level <> 'SEVERE') = 0 THEN 'FAILED' ELSE 'PARTIAL_FAILED' END AS batch_status
FROM batch_detail GROUP BY batch_id""")
def _(lake):
    return ops.batch_status(lake("batch_detail").withColumn("success", F.col("result_level") != "SEVERE"))


@R.query("d9_python_rule", """
SELECT CAST(COUNT(*) AS DOUBLE) AS result_value FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING AVG(c_acctbal) < 4500) x""")
def _(lake):
    def check(df):
        means = df.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"))
        return {"poor_nations": means.filter("mean < 4500").count()}

    rule = Rule(1, "customer", "PYTHON", check=check, metric="poor_nations")
    return shown(ops.run_rules(lake.spark, {"customer": lake("customer")}, [rule]).select("result_value"))


@R.query("d9_python_rule_by_group", """
SELECT c_nationkey, ROUND(AVG(c_acctbal), 4) AS result_value, TRUE AS success FROM customer GROUP BY 1""")
def _(lake):
    found = ops.python_rule_by_group(
        lake("customer").select("c_nationkey", "c_acctbal"), ["c_nationkey"],
        lambda rows: {"n": len(rows), "total": rows["c_acctbal"].astype(float).sum()},
        lambda sums: {"mean": sums["total"] / sums["n"]}, "Mean")
    return found.select("c_nationkey", F.round("result_value", 4).alias("result_value"), "success")


@R.query("d10_latest_results", """
SELECT DISTINCT ON (rule_id) rule_id, id, batch_id, table_id, weight, CAST(result_value AS DOUBLE) AS result_value,
  result_level, created_at FROM check_detail ORDER BY rule_id, id DESC""")
def _(lake):
    return shown(ops.latest_details(lake("check_detail")))


@R.query("d13_score_history_appended", f"""
WITH {LATEST}, {_scores_sql('r').replace('SELECT table_id, CAST(cent', ', d AS (SELECT table_id, CAST(cent', 1)})
SELECT table_id, CAST(score AS DOUBLE) AS score, checked_at FROM score_history
UNION ALL SELECT table_id, score, TIMESTAMP '{EVENT_CLOCK}' FROM d""")
def _(lake):
    scores = ops.table_scores(ops.rule_results(lake("quality_rule"), lake("check_detail")))
    return shown(ops.append_score_history(lake("score_history").select("table_id", "score", "checked_at"), scores, ntz(EVENT_CLOCK)))


@R.query("d13_score_history_backfill", f"""
WITH {LATEST}, {_scores_sql('r')} WHERE table_id NOT IN (SELECT table_id FROM score_history)""")
def _(lake):
    scores = ops.table_scores(ops.rule_results(lake("quality_rule"), lake("check_detail")))
    return shown(ops.score_history_backfill(scores, lake("score_history")))


LEVEL_COUNTS = """COUNT(*) FILTER (WHERE result_level = 'PASS') AS {p}, COUNT(*) FILTER (WHERE result_level <> 'UNAVAILABLE') AS valid,
  COUNT(*) FILTER (WHERE result_level = 'SEVERE') AS severe, COUNT(*) FILTER (WHERE result_level = 'WARNING') AS warning"""


@R.query("d14_quality_summary", f"""
SELECT *, CAST((20000 * passed + valid) // NULLIF(2 * valid, 0) AS DOUBLE) / 100 AS pass_rate FROM (
SELECT COUNT(*) AS details, COUNT(DISTINCT batch_id) AS batches, {LEVEL_COUNTS.format(p='passed')}
FROM check_detail d WHERE created_at {RANGE} AND table_id IN (SELECT table_id FROM checked_table WHERE datasource_id = 1
  AND database_name = 'db2') AND batch_id IN (SELECT batch_id FROM alert_batch WHERE job_id = 4)) x""")
def _(lake):
    scope = report.Scope(as_of=EVENT_CLOCK, datasource_id=1, database_name="db2", job_id=4)
    return shown(report.quality_summary(report.scoped_details(
        lake("check_detail"), scope, lake("checked_table"), lake("alert_batch"))))


@R.query("d15_level_trend", f"""
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, COUNT(*) FILTER (WHERE result_level = 'PASS') AS pass,
  COUNT(*) FILTER (WHERE result_level = 'WARNING') AS warning, COUNT(*) FILTER (WHERE result_level = 'SEVERE') AS severe,
  COUNT(*) FILTER (WHERE result_level = 'UNAVAILABLE') AS unavailable FROM check_detail WHERE created_at {RANGE} GROUP BY 1""")
def _(lake):
    return shown(report.level_trend(report.scoped_details(lake("check_detail"), SCOPE, lake("checked_table"))))


NEWEST = """newest AS (SELECT table_id, ARG_MAX(score, id) AS score FROM score_history GROUP BY table_id),
scores AS (SELECT *, CASE WHEN score >= 85 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 60 THEN 'WARNING'
  ELSE 'BAD' END AS health_level FROM newest)"""


def _scores(lake):
    newest = lake("score_history").groupBy("table_id").agg(F.max_by("score", "id").alias("score"))
    return newest.withColumn("health_level", ops.health(F.col("score"), F.lit(False)))


@R.query("d16_average_score", f"""
WITH {NEWEST} SELECT {_mean('score')} AS avg_score, COUNT(*) AS tables FROM scores WHERE table_id IN (
  SELECT table_id FROM checked_table WHERE source_status = 'ONLINE' AND datasource_id = 2) AND table_id IN (
  SELECT table_id FROM quality_rule WHERE rule_id IN (SELECT rule_id FROM quality_job_rule WHERE job_id = 5))""")
def _(lake):
    scope = report.Scope(as_of=EVENT_CLOCK, datasource_id=2, job_id=5)
    job_tables = lake("quality_job_rule").join(lake("quality_rule"), "rule_id")
    return shown(report.avg_score(_scores(lake), report.online_in(scope, lake("checked_table"), job_tables)))


@R.query("d17_score_distribution", f"""
WITH {NEWEST} SELECT COUNT(*) AS total_tables, COUNT(*) FILTER (WHERE health_level = 'EXCELLENT') AS excellent,
  COUNT(*) FILTER (WHERE health_level = 'GOOD') AS good, COUNT(*) FILTER (WHERE health_level = 'WARNING') AS warning,
  COUNT(*) FILTER (WHERE health_level = 'BAD') AS bad, COUNT(*) FILTER (WHERE health_level IS NULL) AS no_score
FROM checked_table t LEFT JOIN scores s ON s.table_id = t.table_id
WHERE source_status = 'ONLINE'""")
def _(lake):
    return report.score_distribution(_scores(lake), report.online_in(SCOPE, lake("checked_table")))


@R.query("d18_score_by_datasource", f"""
WITH {NEWEST} SELECT datasource_id, {_mean('score')} AS avg_score, COUNT(*) AS tables FROM scores s
JOIN checked_table t ON t.table_id = s.table_id AND source_status = 'ONLINE' GROUP BY datasource_id""")
def _(lake):
    return shown(report.score_by_datasource(_scores(lake), report.online_in(SCOPE, lake("checked_table"))))


@R.query("d19_score_trend", f"""
SELECT CAST(CAST(checked_at AS DATE) AS VARCHAR) AS day, {_mean('score')} AS avg_score, COUNT(DISTINCT table_id) AS tables
FROM score_history WHERE checked_at {RANGE} AND table_id IN (SELECT table_id FROM checked_table WHERE source_status = 'ONLINE')
GROUP BY 1""")
def _(lake):
    return shown(report.score_trend(lake("score_history"), SCOPE, report.online_in(SCOPE, lake("checked_table"))))


@R.query("d19_score_series_of_one_table", f"""
SELECT id, table_id, CAST(score AS DOUBLE) AS score, checked_at FROM score_history WHERE table_id = 7 AND checked_at {RANGE}""")
def _(lake):
    return shown(report.score_series(lake("score_history"), SCOPE, 7))


ISSUES = f"""SELECT d.id AS detail_id, d.table_id, database_name || '.' || table_name AS table_name, d.rule_id, d.rule_name, rule_type,
  result_metric, CAST(result_value AS DOUBLE) AS result_value,
  CAST(CASE WHEN result_level = 'SEVERE' THEN severe_threshold ELSE warning_threshold END AS DOUBLE) AS threshold, result_level,
  created_at AS checked_at FROM issue_detail d LEFT JOIN checked_table t ON t.table_id = d.table_id
  LEFT JOIN quality_rule q ON q.rule_id = d.rule_id AND q.rule_id % 13 <> 0
  WHERE result_level IN ('WARNING', 'SEVERE') AND created_at {RANGE}"""


def _issue_inputs(lake):
    """Details of the report's range, and the rules of which some have been deleted since."""
    return (report.scoped_details(lake("issue_detail"), SCOPE, lake("checked_table")), lake("checked_table"),
            lake("quality_rule").filter("rule_id % 13 <> 0"))


@R.query("d20_issues", ISSUES)
def _(lake):
    return shown(report.issues(*_issue_inputs(lake)))


@R.query("d20_issue_page", f"{ISSUES} ORDER BY detail_id DESC LIMIT 10 OFFSET 20")
def _(lake):
    return shown(report.issue_page(*_issue_inputs(lake), page=3))


@R.query("d20_issue_total", f"SELECT COUNT(*) AS total FROM ({ISSUES}) x")
def _(lake):
    return report.issue_total(_issue_inputs(lake)[0])


@R.query("d21_export_issues", f"SELECT *, FALSE AS truncated FROM ({ISSUES}) x")
def _(lake):
    return shown(report.export_issues(*_issue_inputs(lake)))


@R.query("d21_export_newest_issues", f"""
SELECT *, (SELECT COUNT(*) > 100 FROM check_detail WHERE result_level IN ('WARNING', 'SEVERE') AND created_at {RANGE}) AS truncated
FROM ({ISSUES} ORDER BY detail_id DESC LIMIT 100) x""")
def _(lake):
    return shown(report.export_issues(*_issue_inputs(lake), n=100))


@R.query("d22_rules_per_job", "SELECT job_id, COUNT(*) AS rules FROM quality_job_rule GROUP BY job_id")
def _(lake):
    return report.rules_per_job(lake("quality_job_rule"))


@R.query("d22_jobs_by_rule", """
SELECT r.rule_id, COALESCE(string_agg(DISTINCT job_name, ',' ORDER BY job_name), '') AS job_names FROM quality_rule r
LEFT JOIN quality_job_rule l ON l.rule_id = r.rule_id GROUP BY r.rule_id""")
def _(lake):
    return shown(report.jobs_by_rule(lake("quality_rule"), lake("quality_job_rule")))
