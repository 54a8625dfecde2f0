"""Schema snapshots, differences and standards."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwell.operators import compliance as std, schema as ops
from registry.base import Registry, leafed, shown

R = Registry()


@R.query("a4_type_category", """
SELECT column_name, data_type, CASE WHEN regexp_matches(lower(data_type),
    '^(int|tinyint|smallint|mediumint|bigint|decimal|numeric|float|double|real|number|serial)') THEN 'NUMERIC'
  WHEN regexp_matches(lower(data_type), '^(date|time|year)') THEN 'TEMPORAL' ELSE 'OTHER' END AS category
FROM meta_column_old""")
def _(lake):
    return lake("meta_column_old").select("column_name", "data_type", std.type_category(F.col("data_type")).alias("category"))


@R.query("a4_comparable_fields", """
WITH c AS (SELECT table_name, column_name, data_type, CASE WHEN regexp_matches(lower(data_type), '^(int|bigint|decimal)')
  THEN 1 WHEN lower(data_type) LIKE 'date%' THEN 2 END AS cat FROM meta_column_old),
n AS (SELECT table_name, column_name, data_type, CASE WHEN regexp_matches(lower(data_type), '^(int|bigint|decimal)')
  THEN 1 WHEN lower(data_type) LIKE 'date%' THEN 2 END AS cat FROM meta_column_new)
SELECT c.table_name, c.column_name, c.data_type AS source_type, n.data_type AS target_type,
  COALESCE(c.cat = n.cat, FALSE) AS comparable FROM c JOIN n ON n.table_name = c.table_name AND n.column_name = c.column_name""")
def _(lake):
    old = lake("meta_column_old").select("table_name", "column_name", F.col("data_type").alias("source_type"))
    new = lake("meta_column_new").select("table_name", "column_name", F.col("data_type").alias("target_type"))
    return old.join(new, ["table_name", "column_name"]).withColumn(
        "comparable", std.comparable(F.col("source_type"), F.col("target_type")))


DIFF = """
j AS (SELECT COALESCE(o.table_name, n.table_name) AS table_name, COALESCE(o.column_name, n.column_name) AS column_name,
    o.k IS NOT NULL AS has_old, n.column_name IS NOT NULL AS has_new, COALESCE(o.source_status = 'ONLINE', FALSE) AS online,
    o.data_type AS ot, n.data_type AS nt, o.ordinal_position AS oo, n.ordinal_position AS no, o.nullable AS ob, n.nullable AS nb,
    o.column_comment AS oc, n.column_comment AS nc
  FROM meta_column_old o FULL JOIN meta_column_new n ON n.table_name = o.table_name AND n.column_name = o.column_name),
v AS (SELECT *, ot || '|' || CASE WHEN ob THEN 'true' ELSE 'false' END || '|' || COALESCE(oc, '') AS o_all,
    nt || '|' || CASE WHEN nb THEN 'true' ELSE 'false' END || '|' || COALESCE(nc, '') AS n_all FROM j),
changes AS (SELECT table_name, column_name, CASE WHEN table_name IN (SELECT table_name FROM meta_column_old) THEN 'ADDED_COLUMN'
    ELSE 'ADDED_TABLE' END AS change_type, CAST(NULL AS VARCHAR) AS old_value, n_all AS new_value FROM v WHERE has_new AND NOT online
  UNION ALL SELECT table_name, column_name, 'DELETED_COLUMN', o_all, NULL FROM v WHERE NOT has_new AND online
    AND table_name IN (SELECT table_name FROM meta_column_new)
  UNION ALL SELECT table_name, column_name, 'MODIFIED_COLUMN_TYPE', ot, nt FROM v WHERE has_new AND online AND ot IS DISTINCT FROM nt
  UNION ALL SELECT table_name, column_name, 'MODIFIED_COLUMN_COMMENT', oc, nc FROM v WHERE has_new AND online AND oc IS DISTINCT FROM nc
  UNION ALL SELECT table_name, column_name, 'MODIFIED_COLUMN_ORDINAL', CAST(oo AS VARCHAR), CAST(no AS VARCHAR) FROM v
    WHERE has_new AND online AND oo IS DISTINCT FROM no
  UNION ALL SELECT table_name, column_name, 'MODIFIED_COLUMN_NULLABLE', CASE WHEN ob THEN 'true' ELSE 'false' END,
    CASE WHEN nb THEN 'true' ELSE 'false' END FROM v WHERE has_new AND online AND ob IS DISTINCT FROM nb)"""


@R.query("e1_schema_diff", f"WITH {DIFF.strip()} SELECT * FROM changes")
def _(lake):
    return ops.schema_diff(lake("meta_column_old"), lake("meta_column_new"))


@R.query("e1_schema_diff_by_hashes", f"WITH {DIFF.strip()} SELECT * FROM changes")
def _(lake):
    return ops.schema_diff(lake("meta_column_old"), lake("meta_column_new"), buckets=256)


TABLES = """
o AS (SELECT *, COALESCE(schema_name, '') AS s FROM meta_table_old), n AS (SELECT *, COALESCE(schema_name, '') AS s FROM meta_table_new),
listed AS (SELECT DISTINCT datasource_id, database_name, s FROM n),
j AS (SELECT COALESCE(o.datasource_id, n.datasource_id) AS datasource_id, COALESCE(o.database_name, n.database_name) AS database_name,
    COALESCE(o.s, n.s) AS schema_name, COALESCE(o.table_name, n.table_name) AS table_name, o.table_comment AS oc,
    n.table_comment AS nc, o.source_status AS status, o.k IS NOT NULL AS has_old, n.table_name IS NOT NULL AS has_new
  FROM o FULL JOIN n ON o.datasource_id = n.datasource_id AND o.database_name = n.database_name AND o.s = n.s
    AND o.table_name = n.table_name),
t AS (SELECT datasource_id, database_name, schema_name, table_name, 'ADDED_TABLE' AS change_type, CAST(NULL AS VARCHAR) AS old_value,
    CAST(NULL AS VARCHAR) AS new_value FROM j WHERE NOT has_old
  UNION ALL SELECT datasource_id, database_name, schema_name, table_name, 'MODIFIED_TABLE', oc, nc FROM j WHERE has_old AND has_new
    AND oc IS DISTINCT FROM nc
  UNION ALL SELECT datasource_id, database_name, schema_name, table_name, 'REVIVED_TABLE', NULL, NULL FROM j WHERE has_old AND has_new
    AND status <> 'ONLINE'
  UNION ALL SELECT datasource_id, database_name, schema_name, table_name, 'DELETED_TABLE', oc, NULL FROM j WHERE NOT has_new
    AND status = 'ONLINE' AND EXISTS (SELECT 1 FROM listed l WHERE l.datasource_id = j.datasource_id
      AND l.database_name = j.database_name AND l.s = j.schema_name))"""


@R.query("e2_table_diff", f"WITH {TABLES.strip()} SELECT * FROM t")
def _(lake):
    return ops.table_diff(lake("meta_table_old"), lake("meta_table_new"))


@R.query("e2_table_diff_by_hashes", f"WITH {TABLES.strip()} SELECT * FROM t")
def _(lake):
    return ops.table_diff(lake("meta_table_old"), lake("meta_table_new"), buckets=256)


@R.query("e2_cascade_to_columns", f"""
WITH {TABLES.strip()} SELECT o_orderkey AS column_id, c.c_name AS table_name FROM orders o2 JOIN customer c ON c.c_custkey = o2.o_custkey
WHERE c.c_name IN (SELECT table_name FROM t WHERE change_type = 'DELETED_TABLE')""")
def _(lake):
    owned = lake("orders").join(lake("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("column_id"), F.col("c_name").alias("table_name"))
    return ops.cascade_deleted(owned, ops.table_diff(lake("meta_table_old"), lake("meta_table_new")), ["table_name"])


def _parsed(col):
    return f"""regexp_extract(upper(trim({col})), '^(\\w+)(?:\\(([^)]+)\\))?$', 1)"""


def _number(col, i):
    return f"""COALESCE(TRY_CAST(split_part(regexp_extract(upper(trim({col})), '^(\\w+)(?:\\(([^)]+)\\))?$', 2), ',', {i}) AS INT), 2147483647)"""


def _matches(expected, col):
    base, sizes = expected.split("(")[0], expected.split("(")[1].rstrip(")").split(",") if "(" in expected else []
    sizes += ["2147483647"] * (2 - len(sizes))
    same = f"{_parsed(col)} = '{base}'"
    if base == "VARCHAR":
        return f"({same} AND {sizes[0]} >= {_number(col, 1)})"
    if base == "DECIMAL":
        return f"({same} AND {sizes[0]} >= {_number(col, 1)} AND {sizes[1]} >= {_number(col, 2)})"
    return f"({same})"


EXPECTED = ("VARCHAR(64)", "VARCHAR", "DECIMAL(18,2)", "DECIMAL(10,2)", "INT", "BIGINT")


@R.query("e3_type_matches", "SELECT column_name, data_type, " + ", ".join(
    f"{_matches(t, 'data_type')} AS fits_{i}" for i, t in enumerate(EXPECTED)) + " FROM std_column")
def _(lake):
    return lake("std_column").select("column_name", "data_type", *[
        std.type_matches(F.lit(t), F.col("data_type")).alias(f"fits_{i}") for i, t in enumerate(EXPECTED)])


STANDARDS = [  # id, name, applies to, kind, value, target type standard, priority, enabled
    (1, "orders", "COLUMN", "PREFIX", "order_", 1, 10, True), (2, "dims", "COLUMN", "REGEX", "dim_[0-9]*[05]", 2, 20, True),
    (3, "all dims", "COLUMN", "PREFIX", "dim_", 1, 20, True), (4, "nines", "COLUMN", "SUFFIX", "9", None, 5, True),
    (5, "broken", "COLUMN", "REGEX", "x[0-9", None, 99, True), (6, "off", "COLUMN", "PREFIX", "tmp_", None, 50, False),
    (7, "brands", "TABLE", "REGEX", "Brand#[1-3][0-9]", None, 1, True), (8, "blank", "TABLE", "PREFIX", " ", None, 9, True),
    (9, "fives", "TABLE", "SUFFIX", "5", None, 0, True)]
TYPE_STANDARDS = [(1, ["INT", "BIGINT", "DATE"]), (2, ["VARCHAR(64)", "DECIMAL(18,2)"])]


def _standards(lake):
    rules = lake.spark.createDataFrame(STANDARDS, "id bigint, name string, applies_to string, rule_type string, "
                                       "rule_value string, target_standard_id bigint, priority int, enabled boolean")
    return rules, lake.spark.createDataFrame(TYPE_STANDARDS, "id bigint, allowed_types array<string>")


STANDARD_OF = """CASE WHEN regexp_full_match(column_name, 'dim_[0-9]*[05]') THEN 2 WHEN starts_with(column_name, 'dim_') THEN 3
  WHEN starts_with(column_name, 'order_') THEN 1 WHEN ends_with(column_name, '9') THEN 4 END"""


@R.query("e4_naming_standard", f"SELECT column_id, column_name, CAST({STANDARD_OF} AS BIGINT) AS standard_id FROM std_column")
def _(lake):
    rules, _ = _standards(lake)
    return std.match_standard(lake("std_column").select("column_id", "column_name"), "column_name",
                              std.standards_for(rules, "COLUMN"))


OFFERED = {"TABLE": "blank|PREFIX| |;brands|REGEX|Brand#[1-3][0-9]|;fives|SUFFIX|5|",
           "COLUMN": "broken|REGEX|x[0-9|;dims|REGEX|dim_[0-9]*[05]|;all dims|PREFIX|dim_|;orders|PREFIX|order_|;nines|SUFFIX|9|"}
FINDINGS = f"""
named AS (SELECT *, CAST({STANDARD_OF} AS BIGINT) AS standard_id, concat_ws('.', database_name, schema_name, table_name, column_name)
  AS object_path FROM std_column WHERE source_status = 'ONLINE'),
findings AS (
  SELECT table_id, 'TABLE' AS object_type, concat_ws('.', database_name, schema_name, table_name) AS object_path,
    'NAMING' AS violation_type, CAST(NULL AS BIGINT) AS standard_id, CAST(NULL AS VARCHAR) AS actual_value,
    CAST(NULL AS VARCHAR) AS expected_value, '{OFFERED['TABLE']}' AS offered FROM std_table WHERE source_status = 'ONLINE'
    AND NOT regexp_full_match(table_name, 'Brand#[1-3][0-9]') AND NOT ends_with(table_name, '5')
  UNION ALL SELECT table_id, 'COLUMN', object_path, 'NAMING', NULL, NULL, NULL, '{OFFERED['COLUMN']}' FROM named WHERE standard_id IS NULL
  UNION ALL SELECT table_id, 'COLUMN', object_path, 'TYPE', standard_id, data_type, 'INT,BIGINT,DATE',
    CASE standard_id WHEN 1 THEN 'orders|PREFIX|order_|INT,BIGINT,DATE' ELSE 'all dims|PREFIX|dim_|INT,BIGINT,DATE' END FROM named
    WHERE standard_id IN (1, 3) AND upper(data_type) NOT IN ('INT', 'BIGINT', 'DATE')
  UNION ALL SELECT table_id, 'COLUMN', object_path, 'TYPE', standard_id, data_type, 'VARCHAR(64),DECIMAL(18,2)', 'dims|REGEX|dim_[0-9]*[05]|VARCHAR(64),DECIMAL(18,2)' FROM named
    WHERE standard_id = 2 AND NOT ({_matches('VARCHAR(64)', 'data_type')} OR {_matches('DECIMAL(18,2)', 'data_type')}))"""


def _scan(lake):
    """Findings with the offered standards as one text each, so that their content is compared too."""
    return std.compliance_scan(lake("std_table"), lake("std_column"), *_standards(lake)).join(
        _sets(lake), "standards_set").drop("standards_set")


def _sets(lake):
    one = lambda s: F.concat_ws(
        "|", s["standard_name"], s["rule_type"], s["rule_value"], F.coalesce(F.concat_ws(",", s["allowed_types"]), F.lit("")))
    return std.applicable_standards(*_standards(lake)).select(
        "standards_set", F.array_join(F.transform("applicable_standards", one), ";").alias("offered"))


@R.query("e5_compliance_scan", f"WITH {FINDINGS.strip()} SELECT * FROM findings")
def _(lake):
    return _scan(lake)


@R.query("e5_findings_by_set_of_standards", f"""
WITH {FINDINGS.strip()} SELECT CASE violation_type WHEN 'NAMING' THEN object_type ELSE '#' || CAST(standard_id AS VARCHAR) END
  AS standards_set, COUNT(*) AS findings FROM findings GROUP BY 1""")
def _(lake):
    return std.compliance_scan(lake("std_table"), lake("std_column"), *_standards(lake)).groupBy("standards_set").agg(
        F.count("*").alias("findings"))


@R.query("e6_rescan_of_a_scope", f"""
WITH {FINDINGS.strip()} SELECT object_path, violation_type, checked FROM (
  SELECT table_id, object_path, violation_type, 'first' AS checked FROM findings
  WHERE table_id NOT IN (SELECT table_id FROM std_table WHERE schema_name = 'public')
  UNION ALL SELECT table_id, object_path, violation_type, 'again' FROM findings
  WHERE table_id IN (SELECT table_id FROM std_table WHERE schema_name = 'public')) x""")
def _(lake):
    scope = lake("std_table").filter("schema_name = 'public'")
    keep = ("table_id", "object_path", "violation_type")
    old = std.compliance_scan(lake("std_table"), lake("std_column"), *_standards(lake)).select(*keep).withColumn(
        "checked", F.lit("first"))
    rescan = std.compliance_scan(scope, lake("std_column").filter("schema_name = 'public'"), *_standards(lake))
    return std.replace_scope(old, rescan.select(*keep).withColumn("checked", F.lit("again")), scope).select(
        "object_path", "violation_type", "checked")


@R.query("e7_compliance_summary", f"""
WITH {FINDINGS.strip()}, c AS (SELECT COUNT(*) FILTER (WHERE table_id % 4 <> 0) AS non_compliant,
  COUNT(*) FILTER (WHERE table_id % 4 = 0) AS ignored, (SELECT COUNT(*) FROM std_table WHERE source_status = 'ONLINE')
  + (SELECT COUNT(*) FROM std_column WHERE source_status = 'ONLINE') AS objects FROM findings)
SELECT *, CAST(((objects - non_compliant) * 2000 + objects) // (2 * objects) AS DOUBLE) / 10 AS rate FROM c""")
def _(lake):
    results = std.compliance_scan(lake("std_table"), lake("std_column"), *_standards(lake)).withColumn("ignored", F.col("table_id") % 4 == 0)
    return std.compliance_summary(results, lake("std_table"), lake("std_column"))


@R.query("e8_compliance_page", """
SELECT * FROM compliance_result WHERE NOT ignored AND violation_type = 'TYPE' AND checked_at >= TIMESTAMP '2024-01-05 00:00:00'
  AND checked_at <= TIMESTAMP '2024-01-25 00:00:00' ORDER BY checked_at DESC, id DESC LIMIT 20 OFFSET 40""")
def _(lake):
    return std.compliance_page(lake("compliance_result"), 0, "TYPE", "2024-01-05", "2024-01-25", page=3)


@R.query("e8_compliance_page_behind_a_row", """
SELECT * FROM compliance_result WHERE NOT ignored AND violation_type = 'TYPE' AND checked_at >= TIMESTAMP '2024-01-05 00:00:00'
  AND checked_at <= TIMESTAMP '2024-01-25 00:00:00' ORDER BY checked_at DESC, id DESC LIMIT 20 OFFSET 40""")
def _(lake):
    return leafed(lambda after: std.compliance_page(
        lake("compliance_result"), 0, "TYPE", "2024-01-05", "2024-01-25", after=after), ["checked_at", "id"], 3)


@R.query("e9_diff_counts", f"""
WITH {DIFF.strip()}, added AS (SELECT DISTINCT table_name FROM changes WHERE change_type = 'ADDED_TABLE'),
{TABLES.strip().replace('j AS', 'jt AS').replace('FROM j ', 'FROM jt ').replace('j.', 'jt.')},
every AS (SELECT table_name, column_name, change_type FROM changes UNION ALL SELECT concat_ws('.', CAST(datasource_id AS VARCHAR), table_name),
  NULL, change_type FROM t)
SELECT COUNT(*) FILTER (WHERE column_name IS NULL AND change_type = 'ADDED_TABLE') AS tables_added,
  COUNT(*) FILTER (WHERE change_type = 'MODIFIED_TABLE') AS tables_modified,
  COUNT(*) FILTER (WHERE change_type = 'DELETED_TABLE') AS tables_deleted,
  COUNT(*) FILTER (WHERE column_name IS NOT NULL AND change_type IN ('ADDED_TABLE', 'ADDED_COLUMN')) AS columns_added,
  COUNT(DISTINCT table_name || column_name) FILTER (WHERE change_type LIKE 'MODIFIED_COLUMN%') AS columns_modified,
  COUNT(*) FILTER (WHERE change_type = 'DELETED_COLUMN') AS columns_deleted FROM every""")
def _(lake):
    columns = ops.schema_diff(lake("meta_column_old"), lake("meta_column_new")).select(
        "table_name", "column_name", "change_type")
    tables = ops.table_diff(lake("meta_table_old"), lake("meta_table_new")).select(
        F.concat_ws(".", F.col("datasource_id").cast("string"), "table_name").alias("table_name"),
        F.lit(None).cast("string").alias("column_name"), "change_type")
    return ops.diff_counts(columns.unionByName(tables))


@R.query("e10_latest_change", """
SELECT DISTINCT ON (database_name, COALESCE(schema_name, ''), table_name) database_name, COALESCE(schema_name, '') AS schema_name,
  table_name, id, change_type, created_at FROM collect_change
ORDER BY database_name, COALESCE(schema_name, ''), table_name, id DESC""")
def _(lake):
    return ops.latest_change(lake("collect_change"))


KEYED = """
WITH n AS (SELECT * FROM meta_column_new), o AS (SELECT * FROM meta_column_old)
SELECT COALESCE(o.table_name, n.table_name) AS table_name, COALESCE(o.column_name, n.column_name) AS column_name, CASE WHEN o.column_name IS NULL THEN 'ADDED'
  WHEN n.column_name IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change
FROM o FULL JOIN n ON n.table_name = o.table_name AND n.column_name = o.column_name WHERE o.column_name IS NULL OR n.column_name IS NULL
  OR o.data_type IS DISTINCT FROM n.data_type OR o.ordinal_position IS DISTINCT FROM n.ordinal_position
  OR o.nullable IS DISTINCT FROM n.nullable OR o.column_comment IS DISTINCT FROM n.column_comment"""
COMPARED = ["data_type", "ordinal_position", "nullable", "column_comment"]


@R.query("e11_keyed_diff", KEYED)
def _(lake):
    return ops.keyed_diff(lake("meta_column_old"), lake("meta_column_new"), ["table_name", "column_name"], COMPARED)


@R.query("e11_keyed_diff_by_hashes", KEYED)
def _(lake):
    return ops.keyed_diff(lake("meta_column_old"), lake("meta_column_new"), ["table_name", "column_name"], COMPARED, buckets=256)


@R.query("e11_edge_set_diff", """
WITH l AS (SELECT DISTINCT source_table, target_table FROM edge_version_1),
r AS (SELECT DISTINCT source_table, target_table FROM edge_version_2)
SELECT *, 'ADDED' AS change FROM (SELECT * FROM r EXCEPT SELECT * FROM l) a
UNION ALL SELECT *, 'REMOVED' FROM (SELECT * FROM l EXCEPT SELECT * FROM r) b""")
def _(lake):
    return ops.edge_set_diff(lake("edge_version_1"), lake("edge_version_2"), "source_table", "target_table")
