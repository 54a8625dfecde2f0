"""Call-log statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwell.operators import call_log as ops
from registry.base import Registry, shown
from registry.views import EVENT_CLOCK

R = Registry()
WEEK, MONTH = "2024-01-24 00:00:00", "2024-01-01 00:00:00"
S_WEEK, S_MONTH = f"TIMESTAMP '{WEEK}'", f"TIMESTAMP '{MONTH}'"
P95 = "ROUND(COALESCE(quantile_cont(duration_ms, 0.95), 0), 4) AS p95_ms"


def _round_p95(df):
    return shown(df.withColumn("p95_ms", F.round("p95_ms", 4)))


@R.query("c1_call_overview", f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS success,
  COUNT(*) FILTER (WHERE status_code = 429) AS limited, {P95}
FROM call_log WHERE created_at >= {S_WEEK}""")
def _(lake):
    return _round_p95(ops.call_overview(lake("call_log"), WEEK))


@R.query("c1_call_overview_from_histograms", f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS success,
  COUNT(*) FILTER (WHERE status_code = 429) AS limited, {P95}
FROM call_log WHERE created_at >= {S_WEEK}""")
def _(lake):
    return _round_p95(ops.call_overview(ops.latency_histograms(lake("call_log")), WEEK))


@R.query("c2_call_overview_of_one_api", f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS success,
  COUNT(*) FILTER (WHERE status_code = 429) AS limited, {P95},
  COUNT(*) FILTER (WHERE status_code >= 400) AS failed, ROUND(COALESCE(AVG(duration_ms), 0), 4) AS avg_ms,
  COUNT(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00') AS today
FROM call_log WHERE created_at >= {S_MONTH} AND api_id = 3""")
def _(lake):
    one = ops.call_overview(lake("call_log"), MONTH, api_id=3, as_of="2024-01-30 12:00:00")
    return _round_p95(one.withColumn("avg_ms", F.round("avg_ms", 4)))


STATS = f"""SELECT api_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE status_code >= 400) AS failed,
  COUNT(*) FILTER (WHERE status_code = 429) AS limited, COALESCE(quantile_cont(duration_ms, 0.95), 0) AS p95_ms
FROM call_log WHERE created_at >= {S_MONTH} GROUP BY api_id"""
GRADES = f"""SELECT api_id, total, CAST((20000 * failed + total) // (2 * total) AS DOUBLE) / 100 AS error_pct,
  CAST((20000 * limited + total) // (2 * total) AS DOUBLE) / 100 AS limited_pct, ROUND(p95_ms, 4) AS p95_ms,
  CASE WHEN failed * 100 >= total * 5 OR p95_ms >= 1000 THEN 'SEVERE'
       WHEN failed * 100 >= total OR p95_ms >= 500 OR limited * 100 >= total * 5 THEN 'WARNING' ELSE 'PASS' END AS grade
FROM ({STATS}) s"""


@R.query("c3_call_stats_by_api", f"SELECT * REPLACE (ROUND(p95_ms, 4) AS p95_ms) FROM ({STATS}) s")
def _(lake):
    return _round_p95(ops.call_stats_by_api(lake("call_log"), MONTH))


@R.query("c4_health_grades_from_histograms", GRADES)
def _(lake):
    daily = ops.latency_histograms(ops.latency_histograms(lake("call_log")), "day")  # hours merged to days
    return _round_p95(ops.health_grades(ops.call_stats_by_api(daily, MONTH)))


@R.query("c4_health_grades", GRADES)
def _(lake):
    return _round_p95(ops.health_grades(ops.call_stats_by_api(lake("call_log"), MONTH)))


@R.query("c5_overall_health", f"""
SELECT COUNT(*) AS apis, CAST(COALESCE(FLOOR(AVG(CASE grade WHEN 'PASS' THEN 100 WHEN 'WARNING' THEN 60 ELSE 20 END) + 0.5),
  100) AS INT) AS score FROM ({GRADES}) g""")
def _(lake):
    return ops.overall_health(ops.health_grades(ops.call_stats_by_api(lake("call_log"), MONTH)))


@R.query("c6_call_trend_by_day", f"""
SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, COUNT(*) AS total,
  COUNT(*) FILTER (WHERE status_code >= 400) AS failed
FROM call_log WHERE created_at >= {S_MONTH} GROUP BY 1""")
def _(lake):
    return ops.call_trend(lake("call_log"), MONTH, ops.stats_range("30d")[1])


@R.query("c6_call_trend_of_one_api_by_hour", f"""
SELECT date_trunc('hour', created_at)::TIMESTAMP AS bucket, COUNT(*) AS total,
  COUNT(*) FILTER (WHERE status_code >= 400) AS failed
FROM call_log WHERE created_at >= {S_WEEK} AND api_id = 2 GROUP BY 1""")
def _(lake):
    return ops.call_trend(lake("call_log"), WEEK, ops.stats_range("24h")[1], api_id=2)


@R.query("c7_limited_trend", f"""
SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, COUNT(*) AS limited
FROM call_log WHERE created_at >= {S_MONTH} AND status_code = 429 GROUP BY 1""")
def _(lake):
    return ops.limited_trend(lake("call_log"), MONTH, "day")


@R.query("c8_hourly_distribution_today", """
SELECT date_trunc('hour', created_at)::TIMESTAMP AS bucket, COUNT(*) AS total
FROM call_log WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' AND api_id = 5 GROUP BY 1""")
def _(lake):
    return ops.hourly_today(lake("call_log"), 5, "2024-01-30 18:00:00")


@R.query("c9_top_apis", f"""
SELECT t.api_id, total, api_name FROM (SELECT api_id, COUNT(*) AS total FROM call_log WHERE created_at >= {S_MONTH}
  GROUP BY api_id ORDER BY total DESC, api_id LIMIT 10) t LEFT JOIN api a ON a.api_id = t.api_id""")
def _(lake):
    return ops.top_apis(lake("call_log"), lake("api"), MONTH, 10)


@R.query("c10_top_keys", f"""
SELECT key_id, MAX(key_name) AS key_name, COUNT(*) AS total FROM call_log WHERE created_at >= {S_MONTH}
GROUP BY key_id ORDER BY total DESC, key_id LIMIT 10""")
def _(lake):
    return ops.top_keys(lake("call_log"), MONTH, 10)


@R.query("c10_top_keys_of_one_api", f"""
SELECT key_id, MAX(key_name) AS key_name, COUNT(*) AS total FROM call_log WHERE created_at >= {S_MONTH} AND api_id = 7
GROUP BY key_id ORDER BY total DESC, key_id LIMIT 5""")
def _(lake):
    return ops.top_keys(lake("call_log"), MONTH, 5, api_id=7)


@R.query("c11_error_codes", f"""
SELECT status_code, total, ROUND(CAST((20000 * total + s) // (2 * s) AS DOUBLE) / 100, 2) AS share_pct
FROM (SELECT *, CAST(SUM(total) OVER () AS BIGINT) AS s FROM (SELECT status_code, COUNT(*) AS total FROM call_log
  WHERE created_at >= {S_MONTH} AND status_code >= 400 GROUP BY status_code ORDER BY total DESC, status_code LIMIT 5) t) u""")
def _(lake):
    return shown(ops.error_codes(lake("call_log"), MONTH, 5))


@R.query("c12_most_limited_api", f"""
SELECT api_id, COUNT(*) AS limited FROM call_log WHERE created_at >= {S_MONTH} AND status_code = 429
GROUP BY api_id ORDER BY limited DESC, api_id LIMIT 1""")
def _(lake):
    return ops.most_limited_api(lake("call_log"), MONTH)


@R.query("c13_zombie_keys", f"""
SELECT key_id, key_name FROM api_key k WHERE enabled AND NOT EXISTS
  (SELECT 1 FROM call_log l WHERE l.key_id = k.key_id AND l.created_at >= {S_WEEK})""")
def _(lake):
    return ops.zombie_keys(lake("api_key"), lake("call_log"), EVENT_CLOCK).select("key_id", "key_name")


@R.query("c14_calls_per_key", f"""
SELECT k.key_id, COALESCE(n, 0) AS total FROM (SELECT DISTINCT key_id FROM api_key) k LEFT JOIN
  (SELECT key_id, COUNT(*) AS n FROM call_log WHERE created_at >= {S_WEEK} GROUP BY key_id) c ON c.key_id = k.key_id""")
def _(lake):
    return ops.counts_by(lake("call_log"), "key_id", lake("api_key"), WEEK)


@R.query("c14_bindings_per_api", "SELECT api_id, COUNT(*) AS bindings FROM api_key GROUP BY api_id")
def _(lake):
    return ops.counts_by(lake("api_key"), "api_id", name="bindings")


@R.query("c15_status_classes", f"""
SELECT COUNT(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS ok_2xx,
  COUNT(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS client_4xx,
  COUNT(*) FILTER (WHERE status_code BETWEEN 500 AND 599) AS server_5xx
FROM call_log WHERE created_at >= {S_MONTH} AND api_id = 1""")
def _(lake):
    return ops.status_classes(lake("call_log"), MONTH, 1)


@R.query("c16_latest_calls", """
SELECT id, api_id, key_id, key_name, status_code, duration_ms, created_at FROM call_log WHERE api_id = 4
ORDER BY created_at DESC, id DESC LIMIT 5""")
def _(lake):
    return ops.latest_calls(lake("call_log"), 4, 5)
