"""Golden scores and levels, null handling, failing rules."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brightwell.operators import quality as q
from brightwell.operators.quality import Rule

CHECKED = "id bigint, order_no string, amount decimal(18,2)"
ROWS = [(1, "A001", Decimal("100.00")), (2, "A002", Decimal("200.50")), (3, None, Decimal("50.00")), (4, "A003", None)]


@pytest.fixture(scope="module")
def checked(spark):
    return spark.createDataFrame(ROWS, CHECKED)


@pytest.mark.parametrize("levels, score, health", [
    ([("PASS", 1), ("PASS", 1)], "100.00", "EXCELLENT"),
    ([("WARNING", 1), ("PASS", 4)], "70.00", "WARNING"),
    ([("SEVERE", 1), ("PASS", 1)], "20.00", "BAD"),
    ([("PASS", None), ("PASS", -3), ("UNAVAILABLE", 9)], "100.00", "EXCELLENT"),
    ([("PASS", 9), ("SEVERE", 1)], "59.99", "BAD"),
    ([("WARNING", 50)], "0.00", "BAD"),
])
def test_golden_scores(spark, levels, score, health):
    rows = spark.createDataFrame([(1, w, lvl) for lvl, w in levels], "table_id bigint, weight int, result_level string")
    row = q.table_scores(rows).first()
    assert (row["score"], row["health_level"]) == (Decimal(score), health)


def test_unusable_rules_give_no_score(spark):
    rows = spark.createDataFrame([(1, 1, "UNAVAILABLE"), (2, 1, None)], "table_id bigint, weight int, result_level string")
    assert q.table_scores(rows).count() == 0


def value(df):
    return df.first()[0]


def test_template_rules_with_nulls(checked):
    assert value(q.completeness(checked, "order_no")) == Decimal("0.25")
    assert value(q.completeness(checked, "id")) == 0
    assert value(q.completeness(checked)) == Decimal("0.5")
    assert value(q.uniqueness(checked, "order_no")) == 1
    assert value(q.value_range(checked, "amount", 60, 150)) == Decimal("0.5")
    assert value(q.value_range(checked, "amount", None, 150)) == Decimal("0.25")


def test_template_rules_on_an_empty_table(checked):
    empty = checked.limit(0)
    for df in (q.completeness(empty, "order_no"), q.completeness(empty), q.uniqueness(empty, "id"),
               q.value_range(empty, "amount", 0, 1)):
        assert value(df) == 0


@pytest.mark.parametrize("warning, severe, at, expected", [
    (None, None, 9, "PASS"), (1, 2, 0, "PASS"), (1, 2, 1, "WARNING"), (1, 2, 2, "SEVERE"), (1, None, 1, "SEVERE"),
    (None, 2, 1, "PASS"), (None, 2, 2, "SEVERE"), (1, 2, None, "PASS")])
def test_levels(spark, warning, severe, at, expected):
    number = lambda v: F.lit(v).cast("decimal(20,6)")
    assert spark.range(1).select(q.level(number(at), number(warning), number(severe))).first()[0] == expected


def test_failing_rules_do_not_stop_others(spark, checked):
    def broken(df):
        raise ValueError("no luck")

    rules = [Rule(1, "t", "COMPLETENESS", "order_no", warning="0.2", severe="0.5"), Rule(2, "t", "UNIQUENESS", "nowhere"),
             Rule(3, "gone", "UNIQUENESS", "id"), Rule(4, "t", "CUSTOM_SQL", sql="SELECT 1/0 AS x FROM {t}"),
             Rule(5, "t", "CUSTOM_SQL", sql="SELECT id FROM {t} WHERE id > 100"), Rule(6, "t", "PYTHON", check=broken),
             Rule(7, "t", "PYTHON", check=lambda df: {"other": 1}, metric="wanted"),
             Rule(8, "t", "PYTHON", check=lambda df: {"Wanted": "12.5"}, metric="wanted", warning=10),
             Rule(9, "t", "CUSTOM_SQL", sql="SELECT 'abc' AS x FROM {t}", warning=1)]
    rows = {r["rule_id"]: r for r in q.run_rules(spark, {"t": checked}, rules).collect()}
    assert rows[1]["result_level"] == "WARNING" and rows[1]["result_value"] == Decimal("0.25")
    assert [k for k, r in sorted(rows.items()) if r["result_level"] == "UNAVAILABLE"] == [2, 3, 4, 5, 6, 7]
    assert rows[8]["result_level"] == "SEVERE" and rows[8]["result_value"] == Decimal("12.5")
    assert rows[9]["result_value"] == 0 and rows[9]["success"]


def test_rules_of_a_table_share_one_scan(spark, tmp_path, checked):
    checked.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    rules = [Rule(1, "t", "COMPLETENESS", "order_no"), Rule(2, "t", "RANGE", "amount", 0, 1), Rule(3, "t", "COMPLETENESS", "id")]
    plan = q.run_rules(spark, {"t": stored}, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_batch_status_without_rules(spark):
    details = spark.createDataFrame([(1, True), (1, False), (2, False)], "batch_id bigint, success boolean")
    batches = spark.createDataFrame([(1,), (2,), (3,)], "batch_id bigint")
    got = {r["batch_id"]: r["batch_status"] for r in q.batch_status(details, batches).collect()}
    assert got == {1: "PARTIAL_FAILED", 2: "FAILED", 3: "SUCCESS"}


def test_python_rules_by_group(spark):
    rows = [(k % 4 if k % 4 else None, float(k)) for k in range(400)] + [(9, None)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(6)

    def final(sums):
        if not sums["n"]:
            raise ValueError("no values\nin this group")
        return {"Mean": sums["total"] / sums["n"]}

    found = q.python_rule_by_group(df, ["k"], lambda part: {"n": part["v"].count(), "total": part["v"].sum()}, final, "mean")
    got = {r.k: (r.result_value, r.success, r.error) for r in found.collect()}
    assert got == {None: (198.0, True, None), 1: (199.0, True, None), 2: (200.0, True, None), 3: (201.0, True, None),
                   9: (None, False, "no values")}
    missing = q.python_rule_by_group(df, ["k"], lambda part: {"n": 1}, lambda sums: {"other": 1}, "mean").filter("k = 1").first()
    assert not missing.success and "no metric" in missing.error
    assert q.python_rule_by_group(df.limit(0), ["k"], lambda part: {"n": 1}, final).count() == 0
