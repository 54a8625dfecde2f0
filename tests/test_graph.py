"""Walks, audits and statement reading."""

import pytest

from brightwell.operators import lineage as ops, statements as st

EDGE = "source_table string, target_table string, source_column string, target_column string, lineage_type string"


@pytest.fixture(scope="module")
def cyclic(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "c"), (None, "d"), ("d", None)]
    return spark.createDataFrame([(s, t, "x", "y", "SQL") for s, t in pairs], EDGE)


def names(nodes):
    return {r["table_name"]: r["level"] for r in nodes.collect()}


def test_walks_end_on_cycles(cyclic):
    nodes, edges = ops.impact(cyclic, "a", 99)
    assert names(nodes) == {"a": 0, "b": 1, "c": 2, "d": 3} and edges.count() == 4


def test_depth_is_the_one_given(cyclic):
    assert names(ops.impact(cyclic, "a", 0)[0]) == {"a": 0, "b": 1}
    assert names(ops.impact(cyclic, "a")[0]) == {"a": 0, "b": 1}
    assert names(ops.impact(cyclic, "a", None)[0]) == names(ops.impact(cyclic, "a", 99)[0]) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert ops.walk_depth(99) == 99 and ops.walk_depth(-1) == 1 and ops.walk_depth(None) is None


def test_directions(cyclic):
    assert names(ops.origin(cyclic, "d", 1)[0]) == {"d": 0, "c": 1}
    assert names(ops.neighbourhood(cyclic, "d", 2)[0]) == {"d": 0, "c": 1, "a": 2, "b": 2}
    assert names(ops.impact(cyclic, "d", 5)[0]) == {"d": 0}
    assert names(ops.impact(cyclic, "nowhere", 5)[0]) == {"nowhere": 0}


def test_column_walk_ends(spark):
    rows = [("a", "b", "x", "x", "SQL"), ("b", "a", "x", "x", "SQL"), ("b", "c", "x", "y", "SQL"), ("b", "c", "q", "q", "SQL")]
    assert ops.column_lineage(spark.createDataFrame(rows, EDGE), "a", "x").count() == 3


def test_audit_finds_cycles_isolated_and_dangling(spark):
    nodes = spark.createDataFrame([(1, n) for n in "abcde"] + [(2, "x")] + [(3, n) for n in "pq"], "graph_id int, node_id string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "b"), (1, "c", "d"), (1, "a", "zz"), (3, "p", "q"), (3, "p", "q")],
                                  "graph_id int, source string, target string")
    per_node, per_graph = ops.graph_audit(nodes, edges)
    got = {(r["graph_id"], r["node_id"]): (r["level"], r["is_root"], r["is_isolated"]) for r in per_node.collect()}
    assert got == {(1, "a"): (0, True, False), (1, "b"): (None, False, False), (1, "c"): (None, False, False),
                   (1, "d"): (None, False, False), (1, "e"): (0, True, True), (2, "x"): (0, True, False),
                   (3, "p"): (0, True, False), (3, "q"): (1, False, False)}
    graphs = {r["graph_id"]: r.asDict() for r in per_graph.collect()}
    assert graphs[1]["cyclic"] and graphs[1]["dangling_edges"] == 1 and graphs[1]["valid_edges"] == 4
    assert not graphs[3]["cyclic"] and graphs[3]["levels"] == 2 and graphs[2]["isolated"] == 0


STATEMENTS = [
    ("INSERT INTO t SELECT a.x, f(g(b), 'from, (') z, c d FROM s a WHERE x IN (SELECT y FROM s)",
     [("s", None, "t", None), ("s", "f(g(b), 'from, (')", "t", "z"), ("s", "c", "t", "d")]),
    ("INSERT INTO t(x) WITH c AS (SELECT 1 FROM r) SELECT x FROM c", [("r", None, "t", None), ("r", "x", "t", "x")]),
    ("DELETE FROM t WHERE id IN (SELECT id FROM u, v w)", [("u", None, "t", None), ("v", None, "t", None)]),
    ("DROP TABLE x", []), ("SELECT * FROM a", []), ("not a statement", []),
    ("INSERT INTO `t` SELECT extract(year FROM d) AS y FROM `s`",
     [("s", None, "t", None), ("s", "extract(year FROM d)", "t", "y")]),
    ("INSERT INTO t SELECT * FROM t", [(None, None, "t", None)]),
    ("INSERT INTO t(a) SELECT x FROM s UNION SELECT y FROM s", [("s", None, "t", None)]),
    ("CREATE VIEW v AS SELECT a AS b FROM s", [("s", None, "v", None)]),
    ("CREATE TABLE k (a int, b string)", [(None, None, "k", None)]),
    ("/* from x */ UPDATE t SET a = 'from y'", [(None, None, "t", None)]),
    ("INSERT INTO d(a, b) SELECT trim(both ' ' FROM c), x IS NOT DISTINCT FROM y FROM s",
     [("s", None, "d", None), ("s", "trim(both ' ' FROM c)", "d", "a"), ("s", "x IS NOT DISTINCT FROM y", "d", "b")]),
    ("DELETE FROM t USING s, u v WHERE t.k = s.k", [("s", None, "t", None), ("u", None, "t", None)]),
    ("WITH c AS (SELECT x FROM s) INSERT INTO t(a) SELECT x FROM c", [("s", None, "t", None), ("s", "x", "t", "a")]),
    ("WITH RECURSIVE c(n) AS (SELECT 1 UNION SELECT n FROM c), d AS (SELECT * FROM r) UPDATE t SET a = (SELECT max(n) FROM c, d)",
     [("r", None, "t", None)]),
    ("INSERT IGNORE INTO t SELECT a AS b FROM s", [("s", None, "t", None), ("s", "a", "t", "b")]),
    ("INSERT OVERWRITE TABLE t SELECT a b FROM s", [("s", None, "t", None), ("s", "a", "t", "b")]),
    ("CREATE TABLE t LIKE s", [("s", None, "t", None)]), ("CREATE TABLE t (LIKE s INCLUDING ALL)", [("s", None, "t", None)]),
    ("CREATE TABLE t (k decimal(10, 2), PRIMARY KEY (k)) AS SELECT x FROM s", [("s", None, "t", None), ("s", "x", "t", "k")]),
    ("INSERT INTO t SELECT $$a, b FROM x; $$ AS c, d e FROM s", [("s", None, "t", None), ("s", "$$a, b FROM x; $$", "t", "c"), ("s", "d", "t", "e")]),
    ("CREATE INDEX i ON t (a)", []), ("MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN DELETE", []),
    ("INSERT INTO t (SELECT a FROM s)", [("s", None, "t", None)]), ("INSERT INTO t SELECT a.* FROM s a WHERE b LIKE 'x FROM y'", [("s", None, "t", None)]),
    ("CREATE OR REPLACE TEMPORARY VIEW v AS SELECT * FROM `d`.`s` JOIN e.f USING (k)", [("`d`.`s`", None, "v", None), ("e.f", None, "v", None)]),
    ("UPDATE LOW_PRIORITY t, u SET t.a = u.a", [("u", None, "t", None)]),
    ("SELECT 1; INSERT INTO t SELECT 1 FROM s", [("s", None, "t", None)]),
    ("INSERT INTO T SELECT a FROM t", [("t", None, "T", None)]), ("insert into é.ü select ß as ö from ñ", [("ñ", None, "é.ü", None), ("ñ", "ß", "é.ü", "ö")]),
    ("INSERT INTO t SELECT CASE WHEN a THEN b END, c FROM s", [("s", None, "t", None)]), ("", []), ("   ", []), ("--", []), ("(SELECT 1 FROM s)", []),
    ("INSERT INTO t VALUES (1, 'INSERT INTO x SELECT 1 FROM y')", [(None, None, "t", None)]),
]


def test_statement_edges(spark):
    log = spark.createDataFrame([(k, sql) for k, (sql, _) in enumerate(STATEMENTS)], "id int, sql_text string")
    found = {}
    for r in st.lineage_from_statements(log).collect():
        found.setdefault(r.id, []).append((r.source_table, r.source_column, r.target_table, r.target_column))
    for k, (sql, edges) in enumerate(STATEMENTS):
        assert sorted(found.get(k, []), key=repr) == sorted(edges, key=repr), sql


SCRIPTS = [
    ("a; b 'x;y' -- c;d\n /* e;f */ g;; ", ["a", "b 'x;y' --\n /* e;f */ g"]), ("", []), (None, []), (" ; ; ", []),
    ("a 'it''s;'; b \"q;\"", ["a 'it''s;'", 'b "q;"']), ("x 'open;", ["x 'open;"]), ("a 'b\\';c'; d", ["a 'b\\';c'", "d"]),
    ("a $$x;'y$$; b $q$ ; $$ ; $q$ c; d", ["a $$x;'y$$", "b $q$ ; $$ ; $q$ c", "d"]), ("a `x;y`; b - c / d; $1", ["a `x;y`", "b - c / d", "$1"]),
    ("a /* b; ", ["a /* b;"]), ("SELECT $$open; b", ["SELECT $$open; b"]), ("v$a; v$b$", ["v$a", "v$b$"]), ("/* a ** ; */ b; /**/", ["/* a ** ; */ b", "/**/"])]


def test_split(spark):
    log = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(SCRIPTS)], "id int, sql_text string")
    found = {}
    for r in st.split_log(log).orderBy("id", "position").collect():
        found.setdefault(r.id, []).append(r.statement)
    assert [found.get(k, []) for k in range(len(SCRIPTS))] == [parts for _, parts in SCRIPTS]


def test_long_texts_do_not_overflow(spark):
    texts = ["INSERT INTO t VALUES ('" + "x''y" * 50_000 + "'); SELECT 1", "SELECT '" + "\\'" * 50_000 + "'; b", "/*" + "* " * 50_000 + "*/; c",
             "SELECT " + "(" * 200 + "1" + ")" * 200 + " FROM t; d"]
    log = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, sql_text string")
    assert [r["count"] for r in st.split_log(log).groupBy("id").count().orderBy("id").collect()] == [2, 2, 2, 2]
    assert {(r.id, r.table_name) for r in st.statement_tables(log).collect()} == {(0, "t"), (3, "t")}


def test_same_text_is_read_once_and_kept_per_row(spark):
    log = spark.createDataFrame([(i, "INSERT INTO t SELECT x FROM s") for i in range(50)], "id bigint, sql_text string")
    assert st.lineage_from_statements(log).count() == 50


SOURCES = [
    ("SELECT a IS DISTINCT FROM y AS d FROM t", ["t"]), ("SELECT trim(both ' ' FROM c) FROM t", ["t"]),
    ("SELECT substring(c FROM 2 FOR 3), EXTRACT(YEAR FROM d) FROM t", ["t"]), ("SELECT 1 FROM (s)", ["s"]),
    ("SELECT 1 FROM s TABLESAMPLE (10 PERCENT), u", ["s", "u"]), ("SELECT 1 FROM generate_series(1,3) g, t", ["t"]),
    ("SELECT 1 FROM (SELECT x FROM a, b) q JOIN (c JOIN d ON c.k = d.k) ON q.x = c.x WHERE e IN (SELECT z FROM f)",
     ["a", "b", "c", "d", "f"]),
    ("SELECT 1 FROM t LATERAL VIEW explode(xs) v AS p, q", ["t"]), ("DELETE FROM t WHERE k IN (SELECT k FROM u)", ["t", "u"]),
    ("UPDATE t JOIN u ON t.k = u.k SET t.a = 1", ["u"]), ("SELECT a, b FROM x AS p, y q, `z.w` WHERE 1 = 1", ["x", "y", "z.w"]),
    ("SELECT (a, b) FROM t GROUP BY f, g", ["t"]), ("WITH c AS (SELECT 1 FROM a), e (x, y) AS (SELECT 2 FROM C) SELECT * FROM c JOIN E ON 1 = 1 JOIN g", ["a", "g"]),
    ("INSERT INTO w SELECT 1 FROM r", ["w", "r"]), ("SELECT count(*) FILTER (WHERE a), b FROM x, LATERAL (SELECT 1 FROM y) z", ["x", "y"])]


def test_tables_of_statements(spark):
    log = spark.createDataFrame([(k, sql) for k, (sql, _) in enumerate(SOURCES)], "id int, sql_text string")
    found = {}
    for r in st.statement_tables(log).collect():
        found.setdefault(r.id, set()).add(r.table_name)
    for k, (sql, tables) in enumerate(SOURCES):
        assert found.get(k, set()) - ({"t"} if sql.startswith("UPDATE") else set()) == set(tables), sql


def test_statements_are_read_in_the_plan(spark):
    log = spark.createDataFrame([(1, "INSERT INTO t SELECT x FROM s")], "id int, sql_text string")
    for df in (st.lineage_from_statements(log), st.split_log(log), st.statement_tables(log)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def counted(monkeypatch):
    """Records the rows of every frame that a walk or an audit writes."""
    from brightwell.plans import rounds

    written = []

    def record(module, name):
        plain = getattr(module, name)

        def write(df):
            out = plain(df)
            written.append(out[1] if isinstance(out, tuple) else out.count())
            return out

        monkeypatch.setattr(module, name, write)

    record(ops, "cut_lineage"), record(ops, "cut_and_count"), record(rounds, "cut_lineage")
    return written


def test_deep_chains_write_each_node_about_once(spark, monkeypatch):
    def chain(n):
        return spark.createDataFrame([(f"n{k}", f"n{k + 1}", "x", "x", "SQL") for k in range(n)], EDGE)

    written = counted(monkeypatch)
    assert names(ops.impact(chain(40), "n0", None)[0]) == {f"n{k}": k for k in range(41)}
    short = sum(written)
    written.clear()
    nodes, edges = ops.neighbourhood(chain(80), "n40", None)
    assert names(nodes) == {f"n{k}": abs(k - 40) for k in range(81)} and edges.count() == 80
    # Edges twice (read, laid out) for each way, nodes once; one way old frames are merged now and then.
    assert sum(written) <= 2 * 2 * 80 + 81 and short <= 2 * 40 + 41 + 41 * 4


def random_edges(spark, seed, nodes, edges):
    import random

    rng = random.Random(seed)
    pairs = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)} | {(0, k) for k in range(nodes)}
    return pairs, spark.createDataFrame([(f"n{a}", f"n{b}", "x", "x", "SQL") for a, b in pairs], EDGE)


@pytest.mark.parametrize("direction", ["DOWN", "UP", "BOTH"])
def test_hubs_are_split(spark, monkeypatch, direction):
    monkeypatch.setattr(ops, "PART_EDGES", 20)
    monkeypatch.setattr(ops, "HUB_EDGES", 10)
    pairs, frame = random_edges(spark, 3, 60, 50)
    ends = (["source_table"], ["target_table"])
    nodes, edges = ops.walk(ops.table_edges(frame), ["n7"], *ends, ["table_name"], 3, direction)
    level, front, touched = {7: 0}, {7}, set()
    for k in range(1, 4):
        hit = {(a, b) for a, b in pairs if direction != "UP" and a in front or direction != "DOWN" and b in front}
        touched |= hit
        front = {x for a, b in hit for x in ((b,) if direction == "DOWN" else (a,) if direction == "UP" else (a, b))} - set(level)
        level |= {x: k for x in front}
    assert names(nodes) == {f"n{x}": k for x, k in level.items()}
    assert {(r.source_table, r.target_table) for r in edges.collect()} == {(f"n{a}", f"n{b}") for a, b in touched}


def test_audit_writes_no_more_counters_than_edges(spark, monkeypatch):
    import random

    rng = random.Random(8)
    edges = {(g, a, b) for g in range(6) for a in range(30) for b in rng.sample(range(31), 4) if b > a}
    edges |= {(5, 9, 3), (5, 3, 9)}
    nodes = [(g, n) for g in range(6) for n in range(31)]
    monkeypatch.setattr(ops, "PART_EDGES", 50)
    written = counted(monkeypatch)
    frames = spark.createDataFrame(nodes, "graph_id int, node_id int"), spark.createDataFrame(list(edges), "graph_id int, source int, target int")
    levels = {(r.graph_id, r.node_id): r.level for r in ops.graph_audit(*frames)[0].collect()}
    expected, preds = {}, {}
    for g, a, b in edges:
        preds.setdefault((g, b), []).append((g, a))
    while True:
        more = {n: 1 + max((expected[p] for p in preds.get(n, [])), default=-1) for n in nodes
                if n not in expected and all(p in expected for p in preds.get(n, []))}
        if not more:
            break
        expected |= more
    assert levels == {n: expected.get(n) for n in nodes}
    # The edges and nodes are laid out before; the rounds write a counter per edge at most and merge old ones.
    assert sum(written) <= 2 * len(edges) + 3 * len(edges) + 3 * len(nodes)
