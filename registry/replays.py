"""Replays of sequential rules. Windows are long here because the bundled calls are hours apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwell.operators import replay as ops
from registry.base import Registry

R = Registry()


def window_sql(rows, keys, ts, limit, seconds):
    """Row-by-row recursion: the list holds the moments passed and still inside the window."""
    same = " AND ".join(f"o.{k} = r.{k}" for k in keys)
    key = ", ".join(f"o.{k}" for k in keys)
    kept = f"list_filter(r.held, lambda x: x > o.at - INTERVAL {seconds} SECOND)"
    return f"""WITH RECURSIVE o AS (SELECT *, date_trunc('millisecond', {ts}) AS at, {limit} AS bound, ROW_NUMBER() OVER (PARTITION BY {', '.join(keys)}
  ORDER BY date_trunc('millisecond', {ts}), id) AS rn FROM {rows}),
r AS (SELECT o.*, TRUE AS passed, [o.at] AS held FROM o WHERE rn = 1
  UNION ALL SELECT o.*, len({kept}) < o.bound, CASE WHEN len({kept}) < o.bound THEN list_append({kept}, o.at) ELSE {kept} END
  FROM r JOIN o ON {same} AND o.rn = r.rn + 1)"""


RATE = "(SELECT l.*, COALESCE(qps_limit, 0) AS qps_limit FROM call_log l LEFT JOIN key_limit k ON k.key_id = l.key_id) x"
LIMIT = "CASE WHEN qps_limit <= 0 THEN 1000000000 ELSE qps_limit END"


@R.query("c17_rate_limit_replay", f"""{window_sql(RATE, ['key_id'], 'created_at', LIMIT, 172800)}
SELECT id, key_id, created_at, qps_limit, passed AS admitted FROM r""")
def _(lake):
    log = lake("call_log").select("id", "key_id", "created_at")
    return ops.rate_limit_replay(log, lake("key_limit"), window_s=172_800).select(
        "id", "key_id", "created_at", "qps_limit", "admitted")


WAIT = "INTERVAL 14400 SECOND"


@R.query("c18_circuit_replay", f"""
WITH RECURSIVE o AS (SELECT id, api_id, created_at, status_code >= 500 AS failed, ROW_NUMBER() OVER (PARTITION BY api_id
  ORDER BY created_at, id) AS rn FROM call_log),
r AS (SELECT o.*, 'CLOSED' AS breaker, 'CLOSED' AS next_mode, o.created_at AS since, [CAST(failed AS INT)] AS seen FROM o WHERE rn = 1
  UNION ALL SELECT id, api_id, created_at, failed, rn, mode,
    CASE WHEN mode = 'OPEN' THEN 'OPEN' WHEN mode = 'HALF_OPEN' THEN CASE WHEN failed THEN 'OPEN' ELSE 'CLOSED' END
         WHEN trips THEN 'OPEN' ELSE 'CLOSED' END,
    CASE WHEN (mode = 'HALF_OPEN' AND failed) OR (mode = 'CLOSED' AND trips) THEN created_at ELSE since END,
    CASE WHEN mode = 'CLOSED' AND NOT trips THEN seen ELSE [] END
  FROM (SELECT *, len(seen) = 5 AND list_sum(seen) >= 2.5 AS trips FROM (SELECT o.*, r.since,
      CASE WHEN r.next_mode = 'OPEN' AND o.created_at >= r.since + {WAIT} THEN 'HALF_OPEN' ELSE r.next_mode END AS mode,
      list_append(CASE WHEN len(r.seen) = 5 THEN r.seen[2:5] ELSE r.seen END, CAST(o.failed AS INT)) AS seen
    FROM r JOIN o ON o.api_id = r.api_id AND o.rn = r.rn + 1) y) z)
SELECT id, api_id, created_at, failed, breaker, breaker <> 'OPEN' AS admitted FROM r""")
def _(lake):
    log = lake("call_log").select("id", "api_id", "created_at", (F.col("status_code") >= 500).alias("failed"))
    return ops.circuit_replay(log, "api_id", wait_s=14_400)


@R.query("c31_deduplicated_alerts", f"""
{window_sql('alert_candidate', ['object_type', 'object_id', 'alert_type'], 'fired_at', '1', 21600)}
SELECT id, object_type, object_id, alert_type, fired_at, passed AS sent FROM r""")
def _(lake):
    return ops.dedupe_alerts(lake("alert_candidate"), window_s=21_600)
