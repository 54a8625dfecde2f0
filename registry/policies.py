"""Grants, sensitivity and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwell.operators import policy as ops, retention
from registry.base import Registry, shown
from registry.views import EVENT_CLOCK, RUN_CLOCK

R = Registry()
LEVEL = "COALESCE(NULLIF(trim(sensitivity_level), ''), 'PUBLIC')"
RANK = f"CASE {LEVEL} WHEN 'CONFIDENTIAL' THEN 3 WHEN 'INTERNAL' THEN 2 ELSE 1 END"


def _assets(lake):
    return lake("asset").select("table_id", "datasource_id", "database_name", "table_name")


@R.query("i1_granted_tables", """
SELECT table_id, datasource_id, database_name, table_name FROM asset a WHERE EXISTS (SELECT 1 FROM access_grant g
  WHERE g.datasource_id = a.datasource_id AND (g.database_name IS NULL OR g.database_name = a.database_name)
  AND (g.table_name IS NULL OR g.table_name = a.table_name))""")
def _(lake):
    return ops.apply_grants(_assets(lake), lake("access_grant"))


@R.query("i1_unrestricted", "SELECT table_id, datasource_id, database_name, table_name FROM asset")
def _(lake):
    return ops.apply_grants(_assets(lake), None)


@R.query("i1_no_grants", "SELECT table_id, datasource_id, database_name, table_name FROM asset WHERE 1 = 0")
def _(lake):
    return ops.apply_grants(_assets(lake), lake("access_grant").filter("datasource_id = -5"))


@R.query("i2_accessible_databases", """
SELECT DISTINCT datasource_id, database_name FROM asset a WHERE EXISTS (SELECT 1 FROM access_grant g
  WHERE g.datasource_id = a.datasource_id AND (g.database_name IS NULL OR g.database_name = a.database_name))""")
def _(lake):
    return ops.accessible_databases(lake("asset").select("datasource_id", "database_name").distinct(), lake("access_grant"))


@R.query("i2_accessible_datasources", """
SELECT DISTINCT datasource_id FROM asset WHERE datasource_id IN (SELECT datasource_id FROM access_grant)""")
def _(lake):
    return ops.accessible_datasources(lake("asset").select("datasource_id").distinct(), lake("access_grant"))


@R.query("i3_sensitivity_tree", f"""
SELECT datasource_id, database_name, owner_user_id AS table_name, ARG_MAX({LEVEL}, {RANK}) AS sensitivity_level FROM asset
WHERE source_status = 'ONLINE' GROUP BY ALL""")
def _(lake):
    # Several assets share an owner, so owners stand in for equally named tables of different schemas.
    return ops.sensitivity_tree(lake("asset").drop("table_name").withColumnRenamed("owner_user_id", "table_name"))


@R.query("i5_publishable", f"""
SELECT datasource_id, database_name, owner_user_id AS table_name, MAX(w) = 0 AS publishable,
  CASE MAX(w) WHEN 2 THEN 'CONFIDENTIAL' WHEN 1 THEN 'NOT_EXEMPTED' END AS reason FROM (SELECT *, CASE WHEN {LEVEL} = 'CONFIDENTIAL'
    THEN 2 WHEN {LEVEL} = 'INTERNAL' AND table_id % 10 <> 0 THEN 1 ELSE 0 END AS w FROM asset) x GROUP BY ALL""")
def _(lake):
    assets = lake("asset").drop("table_name").withColumnRenamed("owner_user_id", "table_name")
    return ops.publishable(assets, F.col("table_id") % 10 == 0)


@R.query("i6_endpoints_to_disable", f"""
SELECT api_id, table_id FROM endpoint WHERE status = 'PUBLISHED' AND NOT deleted AND table_id IN
  (SELECT table_id FROM asset WHERE {LEVEL} = 'CONFIDENTIAL')""")
def _(lake):
    return ops.to_disable(lake("endpoint"), lake("asset")).select("api_id", "table_id")


@R.query("i7_level_changes", """
SELECT table_id, sensitivity_level AS old_level, CASE WHEN table_id % 3 = 0 THEN 'INTERNAL' ELSE sensitivity_level END AS new_level
FROM asset WHERE table_id % 3 = 0 AND sensitivity_level IS DISTINCT FROM 'INTERNAL'""")
def _(lake):
    old = lake("asset").select("table_id", "sensitivity_level")
    new = old.withColumn("sensitivity_level", F.when(F.col("table_id") % 3 == 0, "INTERNAL").otherwise(
        F.col("sensitivity_level")))
    return ops.level_changes(old, new)


@R.query("j1_retained_calls", """
SELECT * FROM call_log WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00'""")
def _(lake):
    return retention.retain(lake("call_log"), "created_at", 7, EVENT_CLOCK)


@R.query("j1_retained_runs", """
SELECT id, kind, task_id, status, start_time FROM exec_history WHERE start_time >= TIMESTAMP '2001-07-03 00:00:00'""")
def _(lake):
    return retention.retain(lake("exec_history"), "start_time", retention.DEFAULT_DAYS["run_history"], RUN_CLOCK)


@R.query("j2_cascade_to_nodes", """
SELECT run_id, node_no, node_status FROM run_node WHERE run_id NOT IN (SELECT id FROM exec_history
  WHERE start_time < TIMESTAMP '2000-08-02 00:00:00')""")
def _(lake):
    gone = retention.expired(lake("exec_history"), "start_time", 365, RUN_CLOCK)
    return retention.cascade(lake("run_node"), gone, "run_id", "id")
