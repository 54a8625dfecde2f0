"""Derived views over the bundled tables, written once for Spark and for the SQL check."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

EVENT_CLOCK = "2024-01-31 00:00:00"
RUN_CLOCK = "2001-08-02 00:00:00"

VIEWS: dict[str, str] = {}

VIEWS["call_log"] = """
SELECT event_id AS id, user_id % 20 AS api_id, user_id AS key_id,
  concat('key_', CAST(user_id AS STRING)) AS key_name,
  CAST(CASE WHEN event_type = 'error' AND user_id % 20 < 4 THEN 500
            WHEN event_type = 'error' AND user_id % 20 < 8 AND event_id % 10 = 0 THEN 404
            WHEN event_type = 'signup' AND user_id % 20 BETWEEN 8 AND 11 AND event_id % 12 = 0 THEN 429
            ELSE 200 END AS INT) AS status_code,
  CASE WHEN event_id % 50 = 0 THEN NULL
       ELSE CAST(FLOOR(value * (1 + user_id % 20) / 4) AS INT) END AS duration_ms,
  ts AS created_at FROM events"""

VIEWS["api"] = """
SELECT c_nationkey AS api_id, concat('api_', CAST(c_nationkey AS STRING)) AS api_name, COUNT(*) AS owners
FROM customer WHERE c_nationkey <> 3 GROUP BY c_nationkey"""

VIEWS["api_key"] = """
SELECT c_custkey AS key_id, c_name AS key_name, c_custkey % 7 <> 0 AS enabled, c_nationkey AS api_id FROM customer"""

VIEWS["exec_history"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'dag' ELSE 'sync' END AS kind,
  o_custkey % 40 AS task_id,
  CASE WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'RUNNING'
       ELSE 'SUCCESS' END AS status,
  o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 86400 AS INT) AS start_time FROM orders"""

VIEWS["run_log"] = """
SELECT id, kind, task_id, start_time, task_id % 4 AS queue_id, CAST(id % 5 AS INT) AS priority,
  CASE WHEN status = 'SUCCESS' AND id % 9 = 0 THEN 'WAITING' ELSE status END AS status,
  CASE WHEN status = 'RUNNING' OR id % 9 = 0 THEN NULL
       ELSE start_time + INTERVAL '1' SECOND * CAST(id % 7200 AS INT) END AS end_time,
  CASE WHEN id % 3 = 0 THEN 'MANUAL' ELSE 'CRON' END AS trigger_type
FROM exec_history"""

VIEWS["task"] = """
SELECT DISTINCT task_id, concat('task_', CAST(task_id AS STRING)) AS task_name, task_id % 6 AS project_id,
  task_id % 4 AS queue_id, CASE WHEN task_id % 5 = 0 THEN NULL ELSE CAST(10 + task_id AS INT) END AS timeout_minutes,
  task_id % 8 <> 0 AS enabled FROM exec_history"""

VIEWS["project"] = """
SELECT DISTINCT project_id, concat('project_', CAST(project_id AS STRING)) AS project_name FROM task"""

VIEWS["audit_log"] = """
SELECT event_id AS id, concat('res_', CAST(user_id AS STRING)) AS resource_name, props AS content,
  concat('user_', CAST(user_id % 9 AS STRING)) AS operator, event_type AS action, ts AS created_at FROM events"""

VIEWS["issue_detail"] = """
SELECT id, batch_id, rule_id, table_id, result_value, result_level, created_at, concat('rule ', CAST(rule_id AS STRING)) AS rule_name,
  CASE WHEN rule_id % 2 = 0 THEN 'RANGE' ELSE 'COMPLETENESS' END AS rule_type,
  CASE WHEN rule_id % 2 = 0 THEN 'out_of_range' ELSE 'null_rate' END AS result_metric FROM check_detail"""

VIEWS["queue"] = """
SELECT queue_id, CASE WHEN queue_id = 1 THEN NULL ELSE CAST(FLOOR(COUNT(*) / 10) AS INT) END AS capacity
  FROM run_log GROUP BY queue_id
UNION ALL SELECT CAST(r_regionkey + 90 AS BIGINT) AS queue_id, CAST(7 AS INT) AS capacity FROM region"""

VIEWS["run_node"] = """
SELECT l_orderkey AS run_id, l_linenumber AS node_no,
  CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'SUCCESS' ELSE 'RUNNING' END AS node_status FROM lineitem"""

VIEWS["node_run"] = """
SELECT id, task_id AS node_id, status, start_time AS run_start, end_time FROM run_log"""

VIEWS["node_binding"] = """
SELECT DISTINCT o_custkey % 40 AS node_id, o_custkey % 120 AS job_id, o_custkey % 120 % 9 <> 0 AS enabled FROM orders"""

VIEWS["auto_batch"] = """
SELECT o_orderkey AS id, o_custkey % 120 AS job_id, o_orderdate + INTERVAL '12' HOUR AS created_at,
  CASE WHEN o_orderkey % 7 = 0 THEN 'AUTO_TRIGGER' ELSE 'MANUAL' END AS trigger_type FROM orders"""

VIEWS["retry_history"] = """
SELECT id, task_id AS job_id, status, CAST(id % 4 AS INT) AS retry_count,
  CASE WHEN id % 6 = 0 THEN NULL ELSE start_time + INTERVAL '5' MINUTE END AS next_retry_at FROM run_log"""

VIEWS["retry_job"] = """
SELECT task_id AS job_id, enabled, CAST(1 + task_id % 3 AS INT) AS max_retries,
  CASE WHEN task_id % 2 = 0 THEN NULL ELSE CAST(task_id AS INT) END AS retry_interval_minutes FROM task"""

VIEWS["batch_detail"] = """
SELECT event_id AS id, CAST(FLOOR(event_id / 3) AS BIGINT) AS batch_id, concat('rule ', CAST(user_id AS STRING)) AS rule_name,
  CASE event_type WHEN 'error' THEN 'SEVERE' WHEN 'signup' THEN 'WARNING' ELSE 'PASS' END AS result_level,
  CASE WHEN event_id % 2 = 0 THEN props ELSE NULL END AS detail FROM events"""

VIEWS["alert_batch"] = """
SELECT batch_id, batch_id % 25 AS job_id, CASE WHEN batch_id % 4 = 0 THEN 'PARTIAL_FAILED' ELSE 'SUCCESS' END AS batch_status,
  batch_id % 10 = 0 AS alert_sent, COUNT(*) AS n FROM batch_detail GROUP BY batch_id"""

VIEWS["alert_job"] = """
SELECT n_nationkey AS job_id, CASE n_nationkey % 3 WHEN 0 THEN 'SEVERE_ONLY' WHEN 1 THEN 'SEVERE_WARNING' ELSE NULL END
  AS alert_level FROM nation"""

VIEWS["check_detail"] = """
SELECT event_id AS id, CAST(FLOOR(event_id / 50) AS BIGINT) AS batch_id, user_id AS rule_id,
  user_id % 30 AS table_id, CAST(1 + user_id % 5 AS INT) AS weight, CAST(value AS DECIMAL(20,6)) AS result_value,
  CASE event_type WHEN 'error' THEN 'SEVERE' WHEN 'signup' THEN 'WARNING' WHEN 'purchase' THEN 'UNAVAILABLE'
       ELSE 'PASS' END AS result_level, ts AS created_at FROM events"""

VIEWS["quality_rule"] = """
SELECT rule_id, MIN(table_id) AS table_id, MIN(weight) AS weight, rule_id % 11 <> 0 AS enabled,
  concat('rule_', CAST(rule_id AS STRING)) AS rule_name,
  CAST(200 AS DECIMAL(20,6)) AS warning_threshold, CAST(400 AS DECIMAL(20,6)) AS severe_threshold
FROM check_detail GROUP BY rule_id"""

VIEWS["quality_job_rule"] = """
SELECT rule_id % 6 AS job_id, concat('job_', CAST(rule_id % 6 AS STRING)) AS job_name, rule_id FROM quality_rule
UNION ALL SELECT 6 AS job_id, 'job_6' AS job_name, rule_id FROM quality_rule WHERE rule_id % 4 = 0"""

VIEWS["checked_table"] = """
SELECT DISTINCT table_id, concat('table_', CAST(table_id AS STRING)) AS table_name, table_id % 3 AS datasource_id,
  concat('db', CAST(table_id % 4 AS STRING)) AS database_name,
  CASE WHEN table_id % 10 = 9 THEN 'OFFLINE' ELSE 'ONLINE' END AS source_status FROM check_detail"""

VIEWS["score_history"] = """
SELECT event_id AS id, user_id % 30 AS table_id, CAST(CAST(FLOOR(value * 20) AS INT) % 10001 * 0.01 AS DECIMAL(5,2)) AS score,
  ts AS checked_at FROM events WHERE event_type <> 'click' AND user_id % 30 <> 5"""

VIEWS["lineage_edge"] = """
SELECT concat('t', CAST(CAST(FLOOR(p_partkey / 3) AS BIGINT) AS STRING)) AS source_table,
  concat('t', CAST(p_partkey AS STRING)) AS target_table,
  concat('c', CAST(CAST(FLOOR(p_partkey / 3) AS BIGINT) % 5 AS STRING)) AS source_column,
  concat('c', CAST(p_partkey % 5 AS STRING)) AS target_column,
  CASE p_size % 3 WHEN 0 THEN 'SQL' WHEN 1 THEN 'PYTHON' ELSE 'SYNC' END AS lineage_type, p_size AS dag_id, p_partkey AS id
  FROM part WHERE p_partkey > 0"""

VIEWS["edge_version_1"] = """
SELECT source_table, target_table FROM lineage_edge WHERE id % 5 <> 0"""

VIEWS["edge_version_2"] = """
SELECT source_table, target_table FROM lineage_edge WHERE id % 7 <> 0"""

VIEWS["meta_column_old"] = """
SELECT p_brand AS table_name,
  concat(CASE p_size % 4 WHEN 0 THEN 'order_' WHEN 1 THEN 'tmp_' WHEN 2 THEN 'dim_' ELSE 'x' END, CAST(p_partkey AS STRING)) AS column_name,
  CASE p_type WHEN 'ECONOMY' THEN 'VARCHAR(50)' WHEN 'LARGE' THEN 'varchar' WHEN 'MEDIUM' THEN 'DECIMAL(18,2)'
       WHEN 'PROMO' THEN 'bigint' WHEN 'SMALL' THEN 'INT' ELSE 'DATE' END AS data_type,
  CAST(p_partkey % 40 AS INT) AS ordinal_position, p_size % 2 = 0 AS nullable, p_name AS column_comment,
  CASE WHEN p_partkey % 29 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS source_status, p_partkey AS k FROM part"""

VIEWS["meta_column_new"] = """
SELECT table_name, column_name,
  CASE WHEN k % 7 = 0 THEN 'BIGINT' ELSE data_type END AS data_type,
  CASE WHEN k % 13 = 0 THEN ordinal_position + 1 ELSE ordinal_position END AS ordinal_position,
  CASE WHEN k % 17 = 0 THEN NOT nullable ELSE nullable END AS nullable,
  CASE WHEN k % 19 = 0 THEN NULL ELSE column_comment END AS column_comment FROM meta_column_old WHERE k % 11 <> 0
  UNION ALL SELECT table_name, concat(column_name, '_v2'), data_type, ordinal_position, nullable, column_comment
  FROM meta_column_old WHERE k % 23 = 0
  UNION ALL SELECT concat(table_name, '_new'), column_name, data_type, ordinal_position, nullable, column_comment
  FROM meta_column_old WHERE k % 97 = 0"""

VIEWS["meta_table_old"] = """
SELECT c_nationkey AS datasource_id, c_mktsegment AS database_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'public' END AS schema_name, c_name AS table_name,
  concat('comment ', c_name) AS table_comment,
  CASE WHEN c_custkey % 17 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS source_status, c_custkey AS k FROM customer"""

VIEWS["meta_table_new"] = """
SELECT datasource_id, database_name, schema_name, table_name,
  CASE WHEN k % 13 = 0 THEN concat(table_comment, ' v2') ELSE table_comment END AS table_comment
  FROM meta_table_old WHERE k % 11 <> 0 AND datasource_id <> 7
UNION ALL SELECT datasource_id, database_name, schema_name, concat(table_name, '_new'), table_comment
  FROM meta_table_old WHERE k % 23 = 0 AND datasource_id <> 7"""

VIEWS["std_table"] = """
SELECT DISTINCT p_brand AS table_name, 'dw' AS database_name, CASE WHEN p_brand < 'Brand#3' THEN 'public' END AS schema_name,
  CAST(substr(p_brand, 7) AS BIGINT) AS table_id,
  CASE WHEN p_brand = 'Brand#11' THEN 'OFFLINE' ELSE 'ONLINE' END AS source_status FROM part"""

VIEWS["std_column"] = """
SELECT c.k AS column_id, t.table_id, t.database_name, t.schema_name, c.table_name, c.column_name, c.data_type, c.source_status
FROM meta_column_old c JOIN std_table t ON t.table_name = c.table_name"""

VIEWS["collect_change"] = """
SELECT event_id AS id, concat('db', CAST(user_id % 3 AS STRING)) AS database_name,
  CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'public' END AS schema_name, concat('table_', CAST(user_id AS STRING)) AS table_name,
  CASE event_type WHEN 'error' THEN 'DELETED_COLUMN' WHEN 'signup' THEN 'ADDED_COLUMN' WHEN 'purchase' THEN 'MODIFIED_TABLE'
       ELSE 'MODIFIED_COLUMN_TYPE' END AS change_type, ts AS created_at FROM events"""

VIEWS["compliance_result"] = """
SELECT event_id AS id, user_id AS table_id, CASE event_type WHEN 'error' THEN 'TYPE' ELSE 'NAMING' END AS violation_type,
  event_id % 4 = 0 AS ignored, ts AS checked_at FROM events WHERE event_type <> 'click'"""

VIEWS["cdc_raw"] = """
SELECT event_id AS seq, concat('cdc-events-', CAST(user_id % 10 AS STRING)) AS topic, ts AS kafka_ts,
  concat('{"op":"', CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' WHEN 'view' THEN 'r' ELSE 'u' END,
   '","before":{"user_id":', CAST(user_id AS STRING), '},"after":',
   CASE WHEN event_type = 'error' THEN 'null' ELSE concat('{"user_id":', CAST(user_id AS STRING), ',"cents":',
   CAST(CAST(FLOOR(value * 100) AS BIGINT) AS STRING), '}') END,
   ',"source":{"table":"t', CAST(user_id % 3 AS STRING), '"}',
   CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(',"ts_ms":', CAST(1704067200000 + event_id * 1000 AS STRING)) END, '}') AS value
  FROM events"""

VIEWS["cdc_base"] = """
SELECT c_custkey AS user_id, CAST(ROUND(c_acctbal * 100) AS BIGINT) AS cents FROM customer"""

VIEWS["cdc_route"] = """
SELECT concat('t', CAST(n_regionkey AS STRING)) AS source_table, concat('lake.r', CAST(n_regionkey AS STRING)) AS sink_table,
  COUNT(*) AS n FROM nation WHERE n_regionkey <> 1 GROUP BY n_regionkey"""

VIEWS["subscription"] = """
SELECT CAST(n_nationkey % 12 AS BIGINT) AS pipeline_id, CAST(n_regionkey AS BIGINT) AS key_id, COUNT(*) AS n FROM nation GROUP BY 1, 2"""

VIEWS["push_event"] = """
SELECT event_id AS id, user_id % 4 AS pipeline_id, user_id AS key_id, ts, CAST(FLOOR(value * 7) AS BIGINT) AS latency_ms,
  event_type <> 'error' AS ok FROM events"""

VIEWS["subtask_metric"] = """
SELECT l_suppkey % 10 AS pipeline_id, l_shipdate AS sampled_at, l_linenumber AS subtask,
  CASE WHEN l_linenumber % 3 = 0 THEN 'Source: db' WHEN l_linenumber % 3 = 1 THEN 'Sink: lake' ELSE 'Source: db -> Sink: lake' END AS vertex,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity < 6 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS records_out,
  CASE WHEN l_returnflag = 'A' AND l_linenumber = 2 AND l_quantity < 6 THEN NULL ELSE CAST(l_quantity * 2 AS BIGINT) END AS records_per_second,
  CAST(FLOOR(l_extendedprice) AS BIGINT) - 5000 AS lag_ms FROM lineitem"""

VIEWS["key_limit"] = """
SELECT user_id AS key_id, CAST(user_id % 4 AS INT) AS qps_limit, COUNT(*) AS n FROM events GROUP BY user_id"""

VIEWS["metric_sample"] = """
SELECT user_id % 10 AS pipeline_id, ts AS sampled_at,
  CASE WHEN event_type = 'error' THEN -1 ELSE CAST(FLOOR(value) AS BIGINT) END AS lag_seconds,
  CAST(FLOOR(value * 3) AS BIGINT) AS records_per_second, CAST(event_id % 4 AS INT) AS restarts,
  event_id AS total_changes FROM events"""

VIEWS["asset"] = """
SELECT d.doc_id AS table_id, concat(d.source, '_', d.lang, '_', CAST(d.doc_id AS STRING)) AS table_name,
  d.doc_id % 5 AS datasource_id,
  d.source AS database_name, CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE 'public' END AS schema_name,
  d.text AS table_comment, d.doc_id % 17 AS owner_user_id,
  CASE WHEN l.toxic = 1 THEN 'OFFLINE' ELSE 'ONLINE' END AS source_status,
  CASE d.doc_id % 3 WHEN 0 THEN 'EXTERNAL' WHEN 1 THEN 'BUILTIN' ELSE 'MANUAL' END AS source_type,
  CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE d.lang END AS data_domain,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.source END AS data_topic,
  CASE WHEN d.doc_id % 25 = 0 THEN 'CONFIDENTIAL' WHEN d.doc_id % 5 = 0 THEN 'INTERNAL'
       WHEN d.doc_id % 7 = 0 THEN NULL ELSE 'PUBLIC' END AS sensitivity_level,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(d.doc_id * 2591 % 2592000 AS INT) AS updated_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

VIEWS["asset_column"] = """
SELECT conv_id * 10 + turn AS column_id, conv_id AS table_id, concat(role, '_', CAST(turn AS STRING)) AS column_name,
  text AS column_comment, CASE WHEN turn % 5 = 4 THEN 'OFFLINE' ELSE 'ONLINE' END AS source_status FROM conversations"""

VIEWS["asset_tag"] = """
SELECT s_suppkey AS tag_id, concat('tag_', s_name) AS tag_name FROM supplier"""

VIEWS["asset_table_tag"] = """
SELECT DISTINCT d.doc_id AS table_id, d.n_chars % 60 + 1 AS tag_id FROM documents d WHERE d.doc_id % 3 <> 0"""

VIEWS["asset_owner"] = """
SELECT n_nationkey AS user_id, n_name AS user_name FROM nation"""

VIEWS["asset_collection"] = """
SELECT user_id AS table_id, MAX(ts) AS last_collect_time FROM events GROUP BY user_id"""

VIEWS["asset_view_event"] = """
SELECT user_id AS table_id, ts FROM events WHERE event_type = 'view'"""

VIEWS["follow"] = """
SELECT event_id % 40 AS user_id, user_id AS table_id, MIN(ts) AS followed_at FROM events WHERE event_type = 'signup' GROUP BY 1, 2"""

VIEWS["followable"] = """
SELECT user_id AS table_id, concat('db', CAST(user_id % 3 AS STRING)) AS database_name,
  CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'public' END AS schema_name, concat('table_', CAST(user_id AS STRING)) AS table_name,
  COUNT(*) AS n FROM events GROUP BY user_id"""

VIEWS["collect_task"] = """
SELECT c_custkey AS ref_id, c_name AS ref_name, c_nationkey AS datasource_id FROM customer"""

VIEWS["source_rule"] = """
SELECT p_partkey AS ref_id, p_name AS ref_name, p_size % 25 AS datasource_id FROM part"""

VIEWS["source_sync"] = """
SELECT s_suppkey AS ref_id, s_name AS ref_name, s_nationkey AS datasource_id FROM supplier"""

VIEWS["access_grant"] = """
SELECT DISTINCT doc_id % 5 AS datasource_id, CAST(NULL AS STRING) AS database_name, CAST(NULL AS STRING) AS table_name
  FROM documents WHERE doc_id % 5 = 1
UNION ALL SELECT DISTINCT doc_id % 5, source, CAST(NULL AS STRING) FROM documents WHERE doc_id % 5 = 2 AND source LIKE '%1'
UNION ALL SELECT doc_id % 5, source, concat(source, '_', lang, '_', CAST(doc_id AS STRING)) FROM documents WHERE doc_id % 5 = 3 AND doc_id % 4 = 0"""

VIEWS["endpoint"] = """
SELECT o_orderkey AS api_id, o_custkey AS table_id, CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'O' THEN 'PUBLISHED' ELSE 'DRAFT' END
  AS status, o_orderkey % 10 = 0 AS deleted FROM orders"""

VIEWS["asset_view"] = """
SELECT user_id AS table_id, CAST(ts AS DATE) AS view_date, COUNT(*) AS view_count FROM events
  WHERE event_type = 'view' GROUP BY user_id, CAST(ts AS DATE)"""

VIEWS["asset_score"] = """
SELECT doc_id AS table_id, CAST(CAST(n_chars % 10001 AS INT) * 0.01 AS DECIMAL(5,2)) AS score,
  CASE WHEN n_chars % 10001 >= 8500 THEN 'EXCELLENT' WHEN n_chars % 10001 >= 7500 THEN 'GOOD'
       WHEN n_chars % 10001 >= 6000 THEN 'WARNING' ELSE 'BAD' END AS health_level
FROM documents WHERE doc_id % 8 <> 0"""

VIEWS["alert_candidate"] = """
SELECT event_id AS id, 'DAG' AS object_type, user_id % 3 AS object_id,
  CASE WHEN event_id % 2 = 0 THEN 'FAILURE' ELSE 'TIMEOUT' END AS alert_type, ts AS fired_at FROM events WHERE event_type = 'error'"""

VIEWS["alert_history"] = """
SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'DAG' WHEN 1 THEN 'SYNC' ELSE 'QUALITY' END AS object_type,
  user_id AS object_id, concat('object ', CAST(user_id AS STRING)) AS object_name,
  CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'signup' THEN 'TIMEOUT' WHEN 'purchase' THEN 'LAG_EXCEEDED'
       WHEN 'view' THEN 'EXTERNAL_STOP' ELSE 'SUCCESS' END AS alert_type,
  CASE WHEN event_id % 13 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS send_status,
  concat('rule ', CAST(user_id % 12 AS STRING)) AS rule_name, props AS summary, ts AS sent_at FROM events"""

VIEWS["statement_log"] = """
SELECT o_orderkey AS id, CASE o_orderkey % 5
   WHEN 0 THEN concat('INSERT INTO dw.t', CAST(o_custkey % 9 AS STRING), '(a, b) SELECT x, y + 1 FROM ods.s', CAST(o_custkey % 7 AS STRING))
   WHEN 1 THEN concat('CREATE TABLE dw.c', CAST(o_custkey % 9 AS STRING), ' AS SELECT p AS q FROM ods.s1 JOIN ods.s2 ON s1.k = s2.k')
   WHEN 2 THEN concat('SELECT * FROM ods.s', CAST(o_custkey % 7 AS STRING), ' WHERE z = '';''')
   WHEN 3 THEN concat('UPDATE dw.t', CAST(o_custkey % 9 AS STRING), ' SET a = 1')
   ELSE CASE o_orderkey % 15
     WHEN 9 THEN concat('INSERT INTO dw.t', CAST(o_custkey % 9 AS STRING), '(a, b) SELECT trim(both '' '' FROM x), y IS DISTINCT FROM z FROM ods.s',
       CAST(o_custkey % 7 AS STRING))
     WHEN 14 THEN 'CREATE TABLE dw.f1 AS SELECT v AS w FROM (ods.s3 JOIN ods.s4 ON s3.k = s4.k), generate_series(1, 3) g'
     ELSE CASE o_orderkey % 90
       WHEN 4 THEN concat('DELETE FROM dw.t', CAST(o_custkey % 9 AS STRING), ' USING ods.s', CAST(o_custkey % 7 AS STRING), ' WHERE p = q')
       WHEN 19 THEN concat('WITH c AS (SELECT x FROM ods.s', CAST(o_custkey % 7 AS STRING), ') INSERT INTO dw.t',
         CAST(o_custkey % 9 AS STRING), '(a) SELECT x FROM c')
       WHEN 34 THEN concat('INSERT IGNORE INTO dw.t', CAST(o_custkey % 9 AS STRING), ' SELECT x AS a FROM ods.s', CAST(o_custkey % 7 AS STRING))
       WHEN 49 THEN concat('CREATE TABLE dw.l', CAST(o_custkey % 9 AS STRING), ' LIKE ods.s', CAST(o_custkey % 7 AS STRING))
       WHEN 64 THEN concat('INSERT INTO dw.t', CAST(o_custkey % 9 AS STRING), ' SELECT $$a; FROM x.y$$ AS a FROM ods.s',
         CAST(o_custkey % 7 AS STRING))
       ELSE 'not a statement' END END END AS sql_text, o_orderdate AS executed_at FROM orders"""

VIEWS["script_log"] = """
SELECT id, concat(sql_text, '; -- done; really', chr(10), ' /* a;b */ DELETE FROM x.y WHERE k = "q;r";;') AS script FROM statement_log"""

VIEWS["graph_node"] = """
SELECT l_suppkey % 200 AS graph_id, l_partkey % 50 AS node_id, COUNT(*) AS n FROM lineitem GROUP BY 1, 2"""

VIEWS["graph_edge"] = """
SELECT DISTINCT l_suppkey % 200 AS graph_id, l_partkey % 50 AS source, (l_partkey % 50) * 2 + l_linenumber % 3 AS target
FROM lineitem WHERE l_partkey % 50 > 0 OR l_linenumber % 3 > 0"""

VIEWS["python_step"] = """
SELECT event_id AS id, concat('out_', CAST(user_id % 9 AS STRING)) AS first_output, concat('`tmp`') AS second_output FROM events"""

_NAME = re.compile(r"\b(" + "|".join((*VIEWS, *TABLES)) + r")\b")


def _references(text: str) -> list[str]:
    """Relations named in a view text; column names never collide with them in the texts above."""
    outside_strings = re.sub(r"'(?:[^']|'')*'", "''", text)
    return sorted(set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", outside_strings)) & {*VIEWS, *TABLES})


class Lake:
    """The bundled tables and derived views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._known = spark, folder, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._build(name)
        return self._known[name]

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables and views named in ``text``."""
        names = _references(text)
        holes = text.replace("{", "{{").replace("}", "}}")
        for name in names:
            holes = re.sub(rf"((?:FROM|JOIN)\s+){name}\b(?! AS\b)(\s+[a-z]\b)?", rf"\1{{{name}}}\2", holes)
        # Literals without a zone keep the tables' zone-free timestamps.
        holes = holes.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
        return self.spark.sql(holes, **{name: self(name) for name in names})


class StreamLake(Lake):
    """The same tables and views over file streams."""

    def _build(self, name: str) -> DataFrame:
        if name not in TABLES:
            return super()._build(name)
        static = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.spark.readStream.schema(static.schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def needed_views(text: str) -> list[str]:
    """The views a text needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for inner in _references(VIEWS[name]):
                visit(inner)
            order.append(name)

    for name in _references(text):
        visit(name)
    return order


def with_views(text: str) -> str:
    """The text as one statement that carries the views it needs as named sub-queries."""
    views = [f"{name} AS ({VIEWS[name].strip()})" for name in needed_views(text)]
    body = text.strip()
    if not views:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{', '.join(views)}, {body[len(head):]}"
    return f"WITH {', '.join(views)} {body}"
