"""Table reads, synchronisation and previews."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from brightwell.operators import table_query as ops
from brightwell.operators.table_query import QuerySpec
from brightwell.plans.lineage_cut import ensure_checkpoint_dir
from brightwell.sources import preview, sync
from registry.base import Registry, leafed, shown

R = Registry()

SPEC = QuerySpec(filters=[("o_orderstatus", "EQ"), ("o_totalprice", "RANGE"), ("o_orderdate", "RANGE"), ("o_custkey", "EQ"),
                          ("o_orderstatus", "EQ")],
                 fields=["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderkey"], order_by="o_totalprice desc",
                 paginated=True, page_size_max=50, tie_break=("o_orderkey",))
WHOLE = QuerySpec(filters=SPEC.filters)


@R.query("b1_equality_filter", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def _(lake):
    return ops.table_query(lake("orders"), WHOLE, {"o_orderstatus": " F ", "o_custkey": " "})


@R.query("b1_equality_on_a_number", "SELECT * FROM orders WHERE o_custkey = 77")
def _(lake):
    return ops.table_query(lake("orders"), WHOLE, {"o_custkey": "77"})


@R.query("b2_range_filter", """
SELECT * FROM orders WHERE o_totalprice >= 1000.5 AND o_totalprice <= 250000 AND o_orderdate >= TIMESTAMP '1998-05-01 00:00:00'""")
def _(lake):
    return ops.table_query(lake("orders"), WHOLE, {"min_o_totalprice": "1000.5", "max_o_totalprice": "250000",
                                                   "min_o_orderdate": "1998-05-01"})


@R.query("b3_projection", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 300000")
def _(lake):
    return ops.table_query(lake("orders"), QuerySpec(SPEC.filters, SPEC.fields), {"min_o_totalprice": "300000"})


@R.query("b4_order", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def _(lake):
    return ops.table_query(lake("orders"), SPEC)


@R.query("b5_page", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def _(lake):
    return ops.table_query(lake("orders"), SPEC, {"o_orderstatus": "O"}, page=3, size=5000)


@R.query("b5_page_behind_a_row", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def _(lake):
    return leafed(lambda after: ops.table_query(lake("orders"), SPEC, {"o_orderstatus": "O"}, size=5000, after=after),
                  ["o_totalprice", "o_orderkey"], 3)


@R.query("b6_total_count", "SELECT COUNT(*) AS total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice <= 100000")
def _(lake):
    return ops.table_count(lake("orders"), SPEC, {"o_orderstatus": "O", "max_o_totalprice": "100000"})


@R.query("b9_named_parameters", """
SELECT o_orderpriority, COUNT(*) AS orders, '2001-07-01' AS biz_date FROM orders
WHERE o_orderdate <= TIMESTAMP '2001-07-01 00:00:00' AND o_orderstatus = 'F' AND o_totalprice > 5000 GROUP BY 1""")
def _(lake):
    return ops.run_sql(
        lake.spark, "SELECT o_orderpriority, count(*) AS orders, '${biz_date}' AS biz_date FROM {orders} "
        "WHERE o_orderdate <= CAST(:biz_date AS TIMESTAMP_NTZ) AND o_orderstatus = '${state}' AND o_totalprice > :floor "
        "GROUP BY o_orderpriority", datetime(2001, 7, 2), {"state": "O", "biz_date": "1990-01-01"},
        {"state": "F", "floor": 5000}, orders=lake("orders"))


@R.query("c30_alert_history_page", """
SELECT id, object_type, object_name, alert_type, send_status, rule_name, sent_at FROM alert_history
WHERE object_type = 'DAG' AND alert_type = 'FAILURE' AND sent_at >= TIMESTAMP '2024-01-03 00:00:00'
  AND contains(lower(object_name), '1') AND contains(lower(rule_name), 'rule 3') ORDER BY sent_at DESC, id LIMIT 20""")
def _(lake):
    spec = QuerySpec([("object_type", "EQ"), ("alert_type", "EQ"), ("sent_at", "RANGE")],
                     ["id", "object_type", "object_name", "alert_type", "send_status", "rule_name", "sent_at"],
                     "sent_at DESC", True, tie_break=("id",))
    return ops.history_page(lake("alert_history"), spec, {
        "object_type": "DAG", "alert_type": "FAILURE", "min_sent_at": "2024-01-03"},
        {"object_name": "1", "rule_name": "Rule 3"})


AUDIT = QuerySpec([("action", "EQ"), ("created_at", "RANGE")], ["id", "resource_name", "operator", "action", "created_at"],
                  "created_at DESC", True, tie_break=("id",))
AUDIT_LIKE = {("resource_name", "content"): "7", "operator": "USER_3"}
AUDIT_WHERE = """action = 'click' AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND contains(operator, 'user_3')
  AND (contains(resource_name, '7') OR contains(content, '7'))"""


@R.query("c30_audit_page", f"""
SELECT id, resource_name, operator, action, created_at FROM audit_log WHERE {AUDIT_WHERE}
ORDER BY created_at DESC, id LIMIT 20 OFFSET 20""")
def _(lake):
    return ops.history_page(lake("audit_log"), AUDIT, {"action": "click", "min_created_at": "2024-01-05"}, AUDIT_LIKE, page=2)


@R.query("c30_audit_total", f"SELECT COUNT(*) AS total FROM audit_log WHERE {AUDIT_WHERE}")
def _(lake):
    return ops.history_count(lake("audit_log"), AUDIT, {"action": "click", "min_created_at": "2024-01-05"}, AUDIT_LIKE)


@R.query("a2_full_sync", "SELECT c_custkey AS id, c_name AS full_name, c_acctbal AS balance FROM customer")
def _(lake):
    path = f"{ensure_checkpoint_dir(lake.spark)}/{sync.target_name('customer', 'shop-db')}-{uuid.uuid4().hex}"
    sync.sync_full(lake("customer"), [("c_custkey", "id"), ("c_name", "full_name"), ("c_acctbal", "balance")]).write.parquet(path)
    return lake.spark.read.parquet(path)


@R.query("a3_incremental_sync", """
SELECT * FROM events WHERE ts > (SELECT MAX(created_at) FROM call_log WHERE created_at < TIMESTAMP '2024-01-20 00:00:00')""")
def _(lake):
    stored = lake("call_log").filter(F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return sync.sync_incremental(lake("events"), stored, "ts", True, "created_at")


@R.query("a3_first_sync_reads_all", "SELECT * FROM events")
def _(lake):
    return sync.sync_incremental(lake("events"), lake("call_log"), "ts", False, "created_at")


@R.query("a5_sync_of_many_tables", """
SELECT 'orders' AS table_name, 'sync_default_orders' AS target, 'SUCCESS' AS status, COUNT(*) AS rows_read, COUNT(*) AS rows_written
FROM orders
UNION ALL SELECT 'events', 'ods_events', 'SUCCESS', COUNT(*), COUNT(*) FROM events
UNION ALL SELECT 'missing', 'sync_default_missing', 'FAILED', NULL, NULL""")
def _(lake):
    base = f"{ensure_checkpoint_dir(lake.spark)}/sync-{uuid.uuid4().hex}"
    job = lambda table, **more: sync.SyncJob(
        table, lambda: lake.spark.read.parquet(f"{lake.folder}/{table}.parquet"),
        lambda df: df.write.parquet(f"{base}/{table}"), **more)
    results = sync.sync_many(lake.spark, [
        job("orders", mapping=[("o_orderkey", "id"), ("o_totalprice", "price")]), job("events", target="ods_events"),
        job("missing")])
    return results.select("table_name", "target", "status", "rows_read", "rows_written")


@R.query("a9_preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders ORDER BY 1, 2, 3, 4, 5, 6 LIMIT 100""")
def _(lake):
    return preview.preview(lake("orders"))


@R.query("a9_preview_total", "SELECT COUNT(*) AS total_rows FROM orders")
def _(lake):
    return preview.preview_total(lake("orders"))


@R.query("a10_truncated_result", """
SELECT o_orderkey, o_totalprice, TRUE AS truncated FROM orders ORDER BY o_orderkey LIMIT 200""")
def _(lake):
    return preview.truncated(lake("orders").select("o_orderkey", "o_totalprice"), 200, [F.col("o_orderkey")])


@R.query("a10_complete_result", """
SELECT o_orderpriority, COUNT(*) AS orders, FALSE AS truncated FROM orders GROUP BY o_orderpriority""")
def _(lake):
    return preview.truncated(lake("orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders")), 5)


@R.query("a11_csv_export", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source FROM documents""")
def _(lake):
    path = f"{ensure_checkpoint_dir(lake.spark)}/csv-{uuid.uuid4().hex}"
    preview.export_csv(lake("documents").select("doc_id", "text", "source"), path)
    return lake.spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True,
                               schema="doc_id string, text string, source string")
