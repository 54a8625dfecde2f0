"""Lineage walks, graph audits and statement logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwell.operators import lineage as ops, policy, quality, statements
from registry.base import Registry, shown

R = Registry()


def _walk(start, depth, direction):
    """Level of every node within ``depth`` steps of ``start``, as a bounded recursion."""
    down = "SELECT e.target_table, w.level + 1 FROM w JOIN e ON e.source_table = w.table_name WHERE w.level < {d}"
    up = "SELECT e.source_table, w.level + 1 FROM w JOIN e ON e.target_table = w.table_name WHERE w.level < {d}"
    both = ("SELECT CASE WHEN e.source_table = w.table_name THEN e.target_table ELSE e.source_table END, w.level + 1 FROM w "
            "JOIN e ON e.source_table = w.table_name OR e.target_table = w.table_name WHERE w.level < {d}")
    step = {"DOWN": down, "UP": up, "BOTH": both}[direction].format(d=depth)
    return f"""WITH RECURSIVE e AS (SELECT source_table, target_table, MIN(lineage_type) AS lineage_type FROM lineage_edge GROUP BY 1, 2),
w(table_name, level) AS (SELECT '{start}', 0 UNION {step}),
n AS (SELECT table_name, CAST(MIN(level) AS INT) AS level FROM w GROUP BY table_name)"""


@R.query("g1_downstream_impact", f"{_walk('t1', 99, 'DOWN')} SELECT * FROM n")
def _(lake):
    return ops.impact(lake("lineage_edge"), "t1", None)[0]


@R.query("g1_downstream_edges_default_depth", f"""{_walk('t2', 1, 'DOWN')} SELECT e.* FROM e JOIN n ON n.table_name = e.source_table
WHERE level < 1""")
def _(lake):
    return ops.impact(lake("lineage_edge"), "t2", 0)[1]


@R.query("g2_upstream_origin", f"{_walk('t1500', 10, 'UP')} SELECT * FROM n")
def _(lake):
    return ops.origin(lake("lineage_edge"), "t1500", 10)[0]


@R.query("g3_neighbourhood", f"{_walk('t30', 3, 'BOTH')} SELECT * FROM n")
def _(lake):
    return ops.neighbourhood(lake("lineage_edge"), "t30", 3)[0]


@R.query("g3_neighbourhood_edges", f"""{_walk('t30', 3, 'BOTH')} SELECT e.* FROM e
WHERE source_table IN (SELECT table_name FROM n WHERE level < 3) OR target_table IN (SELECT table_name FROM n WHERE level < 3)""")
def _(lake):
    return ops.neighbourhood(lake("lineage_edge"), "t30", 3)[1]


@R.query("g5_table_edges", "SELECT source_table, target_table, MIN(lineage_type) AS lineage_type FROM lineage_edge GROUP BY 1, 2")
def _(lake):
    return ops.table_edges(lake("lineage_edge"))


@R.query("g6_column_lineage", """
WITH RECURSIVE e AS (SELECT source_table, source_column, target_table, target_column, MIN(lineage_type) AS lineage_type
  FROM lineage_edge GROUP BY 1, 2, 3, 4),
w(t, c) AS (SELECT 't40', 'c0' UNION
  SELECT CASE WHEN e.source_table = w.t AND e.source_column = w.c THEN e.target_table ELSE e.source_table END,
    CASE WHEN e.source_table = w.t AND e.source_column = w.c THEN e.target_column ELSE e.source_column END
  FROM w JOIN e ON (e.source_table = w.t AND e.source_column = w.c) OR (e.target_table = w.t AND e.target_column = w.c)
),
n AS (SELECT DISTINCT t, c FROM w)
SELECT DISTINCT e.* FROM e JOIN n ON ((e.source_table = n.t AND e.source_column = n.c)
  OR (e.target_table = n.t AND e.target_column = n.c))""")
def _(lake):
    return ops.column_lineage(lake("lineage_edge"), "t40", "c0")


@R.query("g7_nodes_with_scores", f"""{_walk('t1', 4, 'DOWN')},
s AS (SELECT concat('t', CAST(table_id AS VARCHAR)) AS table_name, ARG_MAX(score, id) AS score FROM score_history GROUP BY 1)
SELECT n.table_name, level, CAST(FLOOR(score) AS INT) AS quality_score, CASE WHEN score >= 85 THEN 'EXCELLENT'
  WHEN score >= 75 THEN 'GOOD' WHEN score >= 60 THEN 'WARNING' WHEN score IS NOT NULL THEN 'BAD' END AS health_level
FROM n LEFT JOIN s ON s.table_name = n.table_name""")
def _(lake):
    newest = lake("score_history").groupBy("table_id").agg(F.max_by("score", "id").alias("score"))
    scores = newest.select(F.concat(F.lit("t"), F.col("table_id").cast("string")).alias("table_name"), "score",
                           quality.health(F.col("score"), F.lit(False)).alias("health_level"))
    return ops.with_scores(ops.impact(lake("lineage_edge"), "t1", 4)[0], scores)


@R.query("g8_records_of_a_graph", "SELECT * FROM lineage_edge WHERE dag_id = 12")
def _(lake):
    return ops.lineage_records(lake("lineage_edge"), dag_id=12)


@R.query("g8_records_of_a_target", "SELECT * FROM lineage_edge WHERE target_table = 't77'")
def _(lake):
    return ops.lineage_records(lake("lineage_edge"), target_table="t77")


EDGES = """
SELECT id, executed_at, source_table, source_column, target_table, target_column, 'SQL' AS lineage_type FROM (
SELECT id, executed_at, regexp_extract(sql_text, 'ods\\.s\\d') AS source_table, NULL AS source_column,
  regexp_extract(sql_text, 'dw\\.t\\d') AS target_table, NULL AS target_column FROM statement_log WHERE id % 5 = 0
UNION ALL SELECT id, executed_at, regexp_extract(sql_text, 'ods\\.s\\d'), 'x', regexp_extract(sql_text, 'dw\\.t\\d'), 'a'
  FROM statement_log WHERE id % 5 = 0
UNION ALL SELECT id, executed_at, regexp_extract(sql_text, 'ods\\.s\\d'), 'y + 1', regexp_extract(sql_text, 'dw\\.t\\d'), 'b'
  FROM statement_log WHERE id % 5 = 0
UNION ALL SELECT id, executed_at, 'ods.s1', NULL, regexp_extract(sql_text, 'dw\\.c\\d'), NULL FROM statement_log WHERE id % 5 = 1
UNION ALL SELECT id, executed_at, 'ods.s2', NULL, regexp_extract(sql_text, 'dw\\.c\\d'), NULL FROM statement_log WHERE id % 5 = 1
UNION ALL SELECT id, executed_at, NULL, NULL, regexp_extract(sql_text, 'dw\\.t\\d'), NULL FROM statement_log WHERE id % 5 = 3
UNION ALL SELECT id, executed_at, regexp_extract(sql_text, 'ods\\.s\\d'), c.s, regexp_extract(sql_text, 'dw\\.t\\d'), c.t FROM statement_log,
  (VALUES (NULL, NULL), ('trim(both '' '' FROM x)', 'a'), ('y IS DISTINCT FROM z', 'b')) c(s, t) WHERE id % 15 = 9
UNION ALL SELECT id, executed_at, c.s, NULL, 'dw.f1', NULL FROM statement_log, (VALUES ('ods.s3'), ('ods.s4')) c(s) WHERE id % 15 = 14
UNION ALL SELECT id, executed_at, regexp_extract(sql_text, 'ods\\.s\\d'), c.s, regexp_extract(sql_text, 'dw\\.[tl]\\d'), c.t FROM statement_log,
  (VALUES (4, NULL, NULL), (19, NULL, NULL), (19, 'x', 'a'), (34, NULL, NULL), (34, 'x', 'a'), (49, NULL, NULL), (64, NULL, NULL),
    (64, '$$a; FROM x.y$$', 'a')) c(m, s, t) WHERE id % 90 = c.m) x"""


@R.query("g9_edges_from_statements", EDGES)
def _(lake):
    return statements.lineage_from_statements(lake("statement_log"))


@R.query("g10_split_and_classify", """
SELECT id, script, CAST(1 AS INT) AS position, sql_text AS statement, CASE WHEN sql_text LIKE 'SELECT%' OR sql_text LIKE 'WITH%' THEN 'QUERY'
  WHEN sql_text LIKE 'CREATE%' THEN 'DDL' WHEN sql_text LIKE 'INSERT%' OR sql_text LIKE 'UPDATE%' OR sql_text LIKE 'DELETE%' THEN 'DML'
  ELSE 'UNKNOWN' END AS statement_class FROM script_log JOIN statement_log s USING (id)
UNION ALL SELECT id, script, 2, concat('--', chr(10), ' /* a;b */ DELETE FROM x.y WHERE k = "q;r"'), 'UNKNOWN' FROM script_log""")
def _(lake):
    return statements.split_log(lake("script_log"), "script")


@R.query("g10_classes_in_the_log", """
SELECT CASE WHEN sql_text LIKE 'SELECT%' OR sql_text LIKE 'WITH%' THEN 'QUERY' WHEN sql_text LIKE 'CREATE%' THEN 'DDL'
  WHEN sql_text LIKE 'INSERT%' OR sql_text LIKE 'UPDATE%' OR sql_text LIKE 'DELETE%' THEN 'DML' ELSE 'UNKNOWN' END AS statement_class, COUNT(*) AS statements
FROM statement_log GROUP BY 1""")
def _(lake):
    return lake("statement_log").groupBy(statements.classify(F.col("sql_text")).alias("statement_class")).agg(
        F.count("*").alias("statements"))


@R.query("g11_declared_outputs", """
SELECT id, CAST(NULL AS VARCHAR) AS source_table, first_output AS target_table, 'PYTHON' AS lineage_type FROM python_step
UNION ALL SELECT id, NULL, 'tmp', 'PYTHON' FROM python_step""")
def _(lake):
    steps = lake("python_step").select("id", F.array("first_output", "second_output").alias("output_tables"))
    return statements.declared_outputs(steps)


VALID = """valid AS (SELECT e.* FROM graph_edge e JOIN graph_node s ON s.graph_id = e.graph_id AND s.node_id = e.source
  JOIN graph_node t ON t.graph_id = e.graph_id AND t.node_id = e.target)"""


AUDIT = f"""RECURSIVE {VALID}, roots AS (SELECT graph_id, node_id FROM graph_node n WHERE NOT EXISTS (SELECT 1 FROM valid v
    WHERE v.graph_id = n.graph_id AND v.target = n.node_id)),
paths(graph_id, node_id, level) AS (SELECT graph_id, node_id, 0 FROM roots UNION SELECT v.graph_id, v.target, p.level + 1
    FROM paths p JOIN valid v ON v.graph_id = p.graph_id AND v.source = p.node_id),
levels AS (SELECT graph_id, node_id, CAST(MAX(level) AS INT) AS level FROM paths GROUP BY 1, 2)"""


@R.query("g12_audit_of_nodes", f"""
WITH {AUDIT}
SELECT n.graph_id, n.node_id, l.level, r.node_id IS NOT NULL AS is_root, r.node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM valid v
  WHERE v.graph_id = n.graph_id AND v.source = n.node_id) AND (SELECT COUNT(*) FROM graph_node g WHERE g.graph_id = n.graph_id) > 1
  AS is_isolated
FROM graph_node n LEFT JOIN levels l ON l.graph_id = n.graph_id AND l.node_id = n.node_id
LEFT JOIN roots r ON r.graph_id = n.graph_id AND r.node_id = n.node_id""")
def _(lake):
    return ops.graph_audit(lake("graph_node"), lake("graph_edge"))[0]


@R.query("g12_audit_of_graphs", f"""
WITH {AUDIT}, size AS (SELECT graph_id, COUNT(*) AS nodes FROM graph_node GROUP BY 1)
SELECT g.graph_id, COUNT(*) AS nodes, COUNT(r.node_id) AS roots, COUNT(*) FILTER (WHERE r.node_id IS NOT NULL AND s.nodes > 1
    AND NOT EXISTS (SELECT 1 FROM valid v WHERE v.graph_id = g.graph_id AND v.source = g.node_id)) AS isolated,
  CAST(MAX(l.level) + 1 AS INT) AS levels, COUNT(l.node_id) < COUNT(*) AS cyclic,
  (SELECT COUNT(*) FROM valid v WHERE v.graph_id = g.graph_id) AS valid_edges,
  (SELECT COUNT(*) FROM graph_edge v WHERE v.graph_id = g.graph_id) - (SELECT COUNT(*) FROM valid v
    WHERE v.graph_id = g.graph_id) AS dangling_edges
FROM graph_node g JOIN size s ON s.graph_id = g.graph_id LEFT JOIN roots r ON r.graph_id = g.graph_id AND r.node_id = g.node_id
LEFT JOIN levels l ON l.graph_id = g.graph_id AND l.node_id = g.node_id GROUP BY g.graph_id""")
def _(lake):
    return ops.graph_audit(lake("graph_node"), lake("graph_edge"))[1]


# With one edge back per graph: nodes on and behind the cycle have no level.
CYCLE = """cyclic_edge AS (SELECT graph_id, source, target FROM graph_edge UNION SELECT graph_id, target AS source, source AS target
  FROM graph_edge WHERE graph_id % 3 = 0 AND source = 5)"""
BEHIND = """on_cycle(graph_id, start, node_id) AS (SELECT graph_id, source, target FROM valid UNION SELECT c.graph_id, c.start, v.target
  FROM on_cycle c JOIN valid v ON v.graph_id = c.graph_id AND v.source = c.node_id),
stuck AS (SELECT DISTINCT c.graph_id, c.node_id FROM on_cycle c JOIN (SELECT DISTINCT graph_id, start FROM on_cycle
  WHERE start = node_id) s ON s.graph_id = c.graph_id AND s.start = c.start)"""


@R.query("g12_audit_of_cyclic_graphs", f"""
WITH RECURSIVE {CYCLE}, {VALID.replace('graph_edge', 'cyclic_edge')}, {BEHIND}
SELECT n.graph_id, COUNT(*) AS nodes, COUNT(s.node_id) AS unlevelled, COUNT(s.node_id) > 0 AS cyclic
FROM graph_node n LEFT JOIN stuck s ON s.graph_id = n.graph_id AND s.node_id = n.node_id GROUP BY n.graph_id""")
def _(lake):
    back = lake("graph_edge").filter("graph_id % 3 = 0 AND source = 5").select(
        "graph_id", F.col("target").alias("source"), F.col("source").alias("target"))
    per_node, per_graph = ops.graph_audit(lake("graph_node"), lake("graph_edge").unionByName(back))
    levels = per_node.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("level").isNull()).alias("unlevelled"))
    return levels.join(per_graph.select("graph_id", "cyclic"), "graph_id")


@R.query("i4_confidential_access", """
WITH closed AS (SELECT DISTINCT 's' || CAST(table_id % 175 // 25 AS VARCHAR) AS n FROM asset WHERE sensitivity_level = 'CONFIDENTIAL'),
used AS (SELECT id, UNNEST(regexp_extract_all(sql_text, '(?:ods|dw)\\.([a-z]\\d)', 1)) AS n FROM statement_log)
SELECT id, COUNT(DISTINCT n) AS confidential_tables, MIN(n) AS first_table FROM used WHERE n IN (SELECT n FROM closed) GROUP BY id""")
def _(lake):
    # Every asset lends its level to one of the source tables the statements name.
    named = lake("asset").withColumn(
        "table_name", F.expr("concat('S', CAST(table_id % 175 DIV 25 AS STRING))"))
    return policy.confidential_hits(statements.statement_tables(lake("statement_log").select("id", "sql_text")), named)
