"""Standards, type names and differences on small rows."""

import pytest
from pyspark.sql import functions as F

from brightwell.operators import compliance as std, schema

RULES = "id bigint, name string, applies_to string, rule_type string, rule_value string, target_standard_id bigint, priority int, enabled boolean"


def test_four_findings_and_a_rescan(spark):
    tables = spark.createDataFrame([(1, "orders_raw", "testdb", None, "ONLINE")],
                                   "table_id bigint, table_name string, database_name string, schema_name string, source_status string")
    columns = spark.createDataFrame(
        [(1, "testdb", None, "orders_raw", c, t, "ONLINE") for c, t in (("id", "bigint"), ("order_no", "varchar"), ("amount", "decimal"))],
        "table_id bigint, database_name string, schema_name string, table_name string, column_name string, data_type string, source_status string")
    rules = spark.createDataFrame([(1, "t", "TABLE", "PREFIX", "dwd_", None, 1, True), (2, "c", "COLUMN", "PREFIX", "order_", 7, 1, True)], RULES)
    types = spark.createDataFrame([(7, ["INT"])], "id bigint, allowed_types array<string>")
    found = std.compliance_scan(tables, columns, rules, types)
    got = sorted((r["object_type"], r["violation_type"], r["object_path"]) for r in found.collect())
    assert got == [("COLUMN", "NAMING", "testdb.orders_raw.amount"), ("COLUMN", "NAMING", "testdb.orders_raw.id"),
                   ("COLUMN", "TYPE", "testdb.orders_raw.order_no"), ("TABLE", "NAMING", "testdb.orders_raw")]
    again = std.replace_scope(found, found, tables)
    assert again.count() == 4
    flags = found.withColumn("ignored", F.lit(False))
    assert std.compliance_summary(flags, tables, columns).first()["rate"] == 0.0
    one = found.withColumn("ignored", F.col("object_type") == "TABLE")
    assert std.compliance_summary(one, tables, columns).first()["rate"] == 25.0
    assert std.compliance_summary(flags.limit(0), tables.limit(0), columns.limit(0)).first()["rate"] == 100.0


@pytest.mark.parametrize("expected, actual, fits", [
    ("VARCHAR(64)", "varchar(64)", True), ("VARCHAR(64)", "varchar(65)", False), ("VARCHAR(64)", "varchar", False),
    ("VARCHAR", "varchar(9999)", True), ("DECIMAL(18,2)", "decimal(10,2)", True), ("DECIMAL(18,2)", "decimal(18,3)", False),
    ("DECIMAL(18)", "decimal(18,9)", True), ("INT", "BIGINT", False), ("INT", " int ", True), ("NUMERIC(1)", "numeric(30,9)", True),
    ("INT", "int unsigned", False), ("INT", None, False), ("VARCHAR(x)", "varchar(7)", True), ("CHAR(-1)", "char(0)", False)])
def test_type_matches(spark, expected, actual, fits):
    row = spark.range(1).select(std.type_matches(F.lit(expected), F.lit(actual).cast("string"))).first()
    assert row[0] is fits


def test_offline_columns_and_null_keys(spark):
    fields = "schema_name string, table_name string, column_name string, data_type string, nullable boolean, column_comment string"
    old = spark.createDataFrame([(None, "t", "a", "int", True, None, "ONLINE"), (None, "t", "b", "int", True, None, "OFFLINE"),
                                 (None, "t", "c", "int", True, None, "OFFLINE"), (None, "t", "d", "int", False, "x", "ONLINE")],
                                fields + ", source_status string")
    new = spark.createDataFrame([(None, "t", "a", "bigint", False, "n"), (None, "t", "b", "int", True, None),
                                 (None, "u", "z", "int", True, None)], fields)
    got = {(r["table_name"], r["column_name"], r["change_type"], r["old_value"], r["new_value"])
           for r in schema.schema_diff(old, new, ["schema_name", "table_name", "column_name"]).collect()}
    assert got == {
        ("t", "a", "MODIFIED_COLUMN_TYPE", "int", "bigint"), ("t", "a", "MODIFIED_COLUMN_NULLABLE", "true", "false"),
        ("t", "a", "MODIFIED_COLUMN_COMMENT", None, "n"), ("t", "b", "ADDED_COLUMN", None, "int|true|"),
        ("t", "d", "DELETED_COLUMN", "int|false|x", None), ("u", "z", "ADDED_TABLE", None, "int|true|")}


def test_snapshot_reads_only_schemas(spark):
    got = schema.snapshot(spark, {"r": spark.range(1).withColumn("s", F.lit("x"))}).collect()
    assert [(r["column_name"], r["data_type"], r["ordinal_position"]) for r in got] == [("id", "bigint", 1), ("s", "string", 2)]


def test_a_thousand_standards(spark):
    rules = [(k, f"n{k}", "COLUMN", ("PREFIX", "SUFFIX", "REGEX")[k % 3], (f"p{k}_", f"_s{k}", f"r{k}_[0-9]+")[k % 3], None, k % 7, True)
             for k in range(1000)]
    df = spark.createDataFrame(rules, "id bigint, name string, applies_to string, rule_type string, rule_value string, "
                                      "target_standard_id bigint, priority int, enabled boolean")
    names = spark.createDataFrame([("p3_x",), ("x_s400",), ("r500_12",), ("p3_x_s400",), ("none",), (None,)], "column_name string")
    got = {r[0]: r[1] for r in std.match_standard(names, "column_name", std.standards_for(df, "COLUMN")).collect()}
    assert got == {"p3_x": 3, "x_s400": 400, "r500_12": 500, "p3_x_s400": 3, "none": None, None: None}


PATTERNS = [("dim_[0-9]*[05]", "dim_"), ("abc", "abc"), ("ab?c", "a"), ("ab+cd", "ab"), ("a{2}b", "a"), ("a{0,3}bcd", "bcd"), ("(abc)+de", "de"),
            ("a|b", ""), ("(?i)abc", ""), (r"a\.b\d+wxyz", "wxyz"), (r"\x41bc", ""), (r"\Qa.b\E", ""), ("[abc]+_end", "_end"), ("x[^]a]y_z", "y_z"),
            (".*", ""), ("", ""), (r"a\_b", "a_b"), ("^start$", "start"), ("(a|b)tail", "tail"), (r"\p{L}+name", ""), ("é+ñandú", "ñandú"),
            ("abc*?de", "ab"), (r"q\?r", "q?r")]


def test_required_texts(spark):
    df = spark.createDataFrame([(p,) for p, _ in PATTERNS], "p string")
    got = {r[0]: r[1] for r in df.select("p", std.required_text(F.col("p"))).collect()}
    assert got == dict(PATTERNS)


def test_prefilter_equals_trying_every_pattern(spark):
    import random
    import re

    rng = random.Random(7)
    pieces = ["a", "b", "ab", "[ab]", "(ab|c)", "a?", "b*", "c+", r"\d", "_", r"\.", "x{2}", "[0-9]+", "|"]
    patterns = ["".join(rng.choices(pieces, k=rng.randint(1, 5))) for _ in range(300)] + ["x[0-9", "(a", "*a", "a{", "[a-b-]"]
    names = ["".join(rng.choices(["a", "b", "c", "ab", "_", ".", "x", "xx", "7", "42"], k=rng.randint(0, 6))) for _ in range(300)]
    rules = spark.createDataFrame([(k, f"n{k}", "COLUMN", "REGEX", p, None, k % 5, True) for k, p in enumerate(patterns)], RULES)
    objects = spark.createDataFrame([(n,) for n in names], "column_name string")
    usable = []
    for k, p in enumerate(patterns):
        try:
            usable.append((-(k % 5), k, re.compile(f"(?:{p})")))
        except re.error:
            pass
    expected = {n: min(((q, k) for q, k, p in usable if p.fullmatch(n)), default=(0, None))[1] for n in names}
    got = {r[0]: r[1] for r in std.match_standard(objects, "column_name", std.standards_for(rules, "COLUMN")).collect()}
    assert got == expected


def test_twenty_thousand_patterns_without_a_nested_loop(spark):
    rules = spark.range(20_000).selectExpr(
        "id", "concat('n', id) AS name", "'COLUMN' AS applies_to", "'REGEX' AS rule_type", "concat('r', id, '_[0-9]+') AS rule_value",
        "CAST(NULL AS BIGINT) AS target_standard_id", "CAST(id % 7 AS INT) AS priority", "true AS enabled")
    names = spark.range(30_000).selectExpr("concat('r', id * 3, '_', id) AS column_name")
    found = std.match_standard(names, "column_name", std.standards_for(rules, "COLUMN"))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert found.filter("standard_id IS NOT NULL").count() == len(range(0, 20_000, 3))
    assert found.filter("standard_id <> CAST(substring_index(substr(column_name, 2), '_', 1) AS BIGINT)").count() == 0


def test_standards_are_stored_once_and_linked(spark):
    rules = spark.createDataFrame([(1, "t", "TABLE", "PREFIX", "dwd_", None, 1, True), (2, "c", "COLUMN", "PREFIX", "order_", 7, 1, True),
                                   (3, "d", "COLUMN", "SUFFIX", "_id", None, 5, True), (4, "off", "COLUMN", "SUFFIX", "x", 7, 5, False)], RULES)
    types = spark.createDataFrame([(7, ["INT"]), (8, [])], "id bigint, allowed_types array<string>")
    sets = {r.standards_set: [(s.standard_name, s.allowed_types) for s in r.applicable_standards]
            for r in std.applicable_standards(rules, types).collect()}
    assert sets == {"TABLE": [("t", None)], "COLUMN": [("d", None), ("c", None)], "#2": [("c", ["INT"])]}


def test_diffs_by_hashes_join_only_what_differs(spark):
    import random

    from brightwell.plans.tree_diff import bucket_digests, differing_buckets

    rng = random.Random(4)
    fields = "table_name string, column_name string, data_type string, nullable boolean, column_comment string"
    old = [(f"t{k // 10}", f"c{k}", rng.choice(["int", "bigint", None]), rng.random() < 0.5, rng.choice([None, "", "x"])) for k in range(600)]
    new = [r if rng.random() < 0.98 else (*r[:2], "changed", *r[3:]) for r in old if rng.random() < 0.99] + [("t9", "fresh", "int", True, None), ("u", "c", "int", True, None)]
    status = [(*r, rng.choice(["ONLINE"] * 9 + ["OFFLINE"])) for r in old]
    before, after = spark.createDataFrame(status, fields + ", source_status string"), spark.createDataFrame(new, fields)
    rows = lambda df: sorted(map(str, df.collect()))
    for buckets in (1, 8, 512):
        assert rows(schema.schema_diff(before, after, buckets=buckets)) == rows(schema.schema_diff(before, after))
        plain = before.drop("source_status")
        assert rows(schema.keyed_diff(plain, after, ["table_name", "column_name"], ["data_type", "column_comment"], buckets)) == \
            rows(schema.keyed_diff(plain, after, ["table_name", "column_name"], ["data_type", "column_comment"]))
    key, columns = ["table_name", "column_name"], ["data_type", "nullable", "column_comment"]
    digests = [bucket_digests(before, key, columns, 64, ["table_name"]), bucket_digests(
        before.withColumn("data_type", F.when(F.col("column_name") == "c33", "other").otherwise(F.col("data_type"))), key, columns, 64, ["table_name"])]
    assert differing_buckets(*digests).count() == 1 and differing_buckets(digests[0], digests[0]).count() == 0
    swapped = spark.createDataFrame([("a", None, "x")], "k string, l string, m string"), spark.createDataFrame([("a", "x", None)], "k string, l string, m string")
    assert differing_buckets(*[bucket_digests(s, ["k"], ["l", "m"], 4) for s in swapped]).count() == 1


def test_table_diff_by_hashes(spark):
    fields = "datasource_id int, database_name string, schema_name string, table_name string, table_comment string"
    old = [(1, "d", None if k % 2 else "s", f"t{k}", "c", "ONLINE" if k % 5 else "OFFLINE") for k in range(80)]
    new = [(1, "d", "" if k % 2 else "s", f"t{k}", "c" if k % 7 else "n") for k in range(10, 90)]
    before, after = spark.createDataFrame(old, fields + ", source_status string"), spark.createDataFrame(new, fields)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(schema.table_diff(before, after, buckets=32)) == rows(schema.table_diff(before, after))
