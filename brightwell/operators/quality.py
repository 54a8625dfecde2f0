"""Check rules over whole tables, graded results and weighed table scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from brightwell.functions.values import DECIMAL, count_when, decimal_value, ratio

# Score defaults and health limits.
WARNING_DEDUCT, SEVERE_DEDUCT, BAD_THRESHOLD = 10, 30, 60
EXCELLENT_FROM, GOOD_FROM = 85, 75
LEVELS = ("PASS", "WARNING", "SEVERE", "UNAVAILABLE")
PARALLEL_CHECKS = 4

DETAIL_SCHEMA = T.StructType([
    T.StructField("rule_id", T.LongType()), T.StructField("result_value", T.DecimalType(20, 6)),
    T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()),
])


@dataclass(frozen=True)
class Rule:
    """One check. ``kind`` is COMPLETENESS, UNIQUENESS, RANGE, CUSTOM_SQL or PYTHON.

    Completeness without a column checks whole rows. Custom SQL names its tables in braces, as in
    ``SELECT count(*) AS n FROM {orders}``. A Python check gets the DataFrame and returns a dict of metrics.
    """

    rule_id: int
    table: str
    kind: str
    column: str | None = None
    low: float | None = None
    high: float | None = None
    sql: str | None = None
    metric: str | None = None
    check: Callable[[DataFrame], Mapping[str, object]] | None = None
    warning: Decimal | float | str | None = None
    severe: Decimal | float | str | None = None
    weight: int | None = None
    table_id: int | None = None


def completeness_value(df: DataFrame, column: str | None) -> Column:
    """Share of rows with a null in ``column``, or in any column when none is given."""
    if column is not None:
        return ratio(F.count("*") - F.count(F.col(column)), F.count("*"))
    any_null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in df.columns])
    return ratio(count_when(any_null), F.count("*"))


def uniqueness_value(column: str, approximate: bool = False) -> Column:
    """Rows minus distinct known values, so nulls count as duplicates."""
    distinct = F.approx_count_distinct(column) if approximate else F.count_distinct(F.col(column))
    return (F.count("*") - distinct).cast(DECIMAL)


def range_value(df: DataFrame, column: str, low, high) -> Column:
    """Share of rows outside ``[low, high]``; nulls are inside and an open side never fails."""
    col = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        col = col.try_cast("double")
    tests = ([col < F.lit(low)] if low is not None else []) + ([col > F.lit(high)] if high is not None else [])
    outside = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    return ratio(count_when(outside), F.count("*"))


def completeness(df: DataFrame, column: str | None = None) -> DataFrame:
    return df.agg(completeness_value(df, column).alias("null_rate"))


def uniqueness(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    return df.agg(uniqueness_value(column, approximate).alias("duplicate_count"))


def value_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    return df.agg(range_value(df, column, low, high).alias("out_of_range_rate"))


def level(value: Column, warning: Column, severe: Column) -> Column:
    """Grade by "at or above" limits; a lone warning limit grades as severe."""
    return (
        F.when((warning.isNull() & severe.isNull()) | value.isNull(), "PASS")
        .when(value >= severe, "SEVERE")
        .when(value >= warning, F.when(severe.isNull(), "SEVERE").otherwise("WARNING"))
        .otherwise("PASS")
    )


def _pick(row: Mapping[str, object], metric: str | None):
    """The named metric, whatever its case; else the first one."""
    if not row:
        raise ValueError("the check returned no metric")
    by_name = {str(k).lower(): v for k, v in row.items()}
    if metric is not None and by_name.get(metric.lower()) is not None:
        return by_name[metric.lower()]
    return next(iter(row.values()))


def custom_sql(spark: SparkSession, sql: str, metric: str | None = None, **tables: DataFrame) -> object:
    """First row of a statement: its metric column, or its first column. No row is an error."""
    row = spark.sql(sql, **tables).limit(1).first()
    if row is None:
        raise ValueError("the check returned no row")
    return _pick(row.asDict(), metric)


def python_rule(df: DataFrame, check: Callable[[DataFrame], Mapping[str, object]], metric: str | None = None):
    """A user function over the Spark frame; a missing named metric makes the rule unavailable."""
    return _named(check(df), metric)


def _named(found: Mapping[str, object], metric: str | None) -> object:
    result = dict(found)
    if metric is not None and metric.lower() not in {k.lower() for k in result}:
        raise ValueError(f"the check returned no metric {metric}")
    return _pick(result, metric)


def python_rule_by_group(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], Mapping[str, float]],
                         final: Callable[[Mapping[str, float]], Mapping[str, object]], metric: str | None = None) -> DataFrame:
    """A user check for every group: the keys, ``result_value``, ``success`` and ``error``.

    ``partial`` sees a piece of a group as a pandas frame and gives numbers that add up; ``final`` makes the metrics from
    their sums. So a group of any size is read where it lies, and a task holds a batch of rows or a row of sums. What
    ``final`` raises is that group's own error. Null keys are a group; keys come back in their own types.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name in keys}
    texts = df.withColumns({k: F.col(k).cast("string") for k in keys})  # pandas would turn numbers with nulls into fractions
    named = ", ".join(f"`{k}` string" for k in keys)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, name, float(value)) for key, part in batch.groupby(list(keys), dropna=False, sort=False)
                    for name, value in partial(part).items()]
            frame = pd.DataFrame(rows, columns=[*keys, "part", "value"])
            yield frame.astype(object).where(frame.notna(), None)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, errors = [], []
            for sums in batch["sums"]:
                try:
                    values.append(float(_named(final(dict(sums)), metric)))
                    errors.append(None)
                except Exception as error:  # user code may raise anything
                    values.append(None)
                    errors.append(str(error).split("\n")[0])
            yield batch[list(keys)].assign(result_value=pd.array(values, dtype="Float64"), success=[e is None for e in errors],
                                           error=errors)

    sums = texts.mapInPandas(summed, f"{named}, part string, value double").groupBy(*keys, "part").agg(F.sum("value").alias("value"))
    whole = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("part", "value"))).alias("sums"))
    found = whole.mapInPandas(judged, f"{named}, result_value double, success boolean, error string")
    return found.withColumns({k: F.col(k).cast(kind) for k, kind in kinds.items()})


def _fused(df: DataFrame, rules: Iterable[Rule]) -> tuple[list[tuple[Rule, Column]], list[tuple[Rule, str]]]:
    """Aggregates that share one pass over the table, and rules that cannot run with the reason."""
    good, bad = [], []
    for rule in rules:
        if rule.column is not None and rule.column not in df.columns:
            bad.append((rule, f"no column {rule.column}"))
        elif rule.kind == "COMPLETENESS":
            good.append((rule, completeness_value(df, rule.column)))
        elif rule.column is None:
            bad.append((rule, "the rule names no column"))
        elif rule.kind == "UNIQUENESS":
            good.append((rule, uniqueness_value(rule.column)))
        elif rule.kind == "RANGE":
            good.append((rule, range_value(df, rule.column, rule.low, rule.high)))
        else:
            bad.append((rule, f"unknown kind {rule.kind}"))
    return good, bad


def _single_value(spark: SparkSession, tables: Mapping[str, DataFrame], rule: Rule) -> tuple:
    """The one value of a statement or Python check; any failure is that rule's own."""
    try:
        if rule.kind == "PYTHON":
            value = python_rule(tables[rule.table], rule.check, rule.metric)
        else:
            named = {n: t for n, t in tables.items() if "{" + n + "}" in rule.sql}
            value = custom_sql(spark, rule.sql, rule.metric, **named)
        return (rule.rule_id, _number(value), True, None)
    except Exception as error:  # user code may raise anything
        return (rule.rule_id, None, False, str(error).split("\n")[0])


def run_rules(spark: SparkSession, tables: Mapping[str, DataFrame], rules: Iterable[Rule]) -> DataFrame:
    """One graded detail row per rule.

    All template rules of a table become one aggregation, hence one scan of the columns they name, instead of one
    query per rule. Statements and Python checks return one value each and run side by side, so a failing one makes
    only its own row UNAVAILABLE.
    """
    rules = list(rules)
    frames, single = [], []
    for name in dict.fromkeys(r.table for r in rules if r.kind not in ("CUSTOM_SQL", "PYTHON")):
        mine = [r for r in rules if r.table == name and r.kind not in ("CUSTOM_SQL", "PYTHON")]
        if name not in tables:
            single += [(r.rule_id, None, False, f"no table {name}") for r in mine]
            continue
        good, bad = _fused(tables[name], mine)
        single += [(r.rule_id, None, False, reason) for r, reason in bad]
        if good:
            wide = tables[name].agg(*[value.cast(DECIMAL).alias(f"r{r.rule_id}") for r, value in good])
            entries = [F.struct(F.lit(r.rule_id).cast("bigint").alias("rule_id"), F.col(f"r{r.rule_id}").alias(
                "result_value"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
                for r, _ in good]
            frames.append(wide.select(F.inline(F.array(*entries))))
    free = [r for r in rules if r.kind in ("CUSTOM_SQL", "PYTHON")]
    if free:
        with ThreadPoolExecutor(max_workers=PARALLEL_CHECKS) as pool:
            single += list(pool.map(lambda r: _single_value(spark, tables, r), free))
    if single:
        frames.append(spark.createDataFrame(single, DETAIL_SCHEMA))
    limits = spark.createDataFrame(
        [(r.rule_id, r.table_id, r.table, r.kind, _text(r.warning), _text(r.severe), r.weight) for r in rules],
        "rule_id bigint, table_id bigint, table_name string, kind string, warning string, severe string, weight int")
    limits = limits.withColumns({c: F.col(c).cast(DECIMAL) for c in ("warning", "severe")})
    graded = F.when(F.col("success"), level(F.col("result_value"), F.col("warning"), F.col("severe"))).otherwise(
        "UNAVAILABLE")
    return limits.join(reduce(DataFrame.unionByName, frames), "rule_id").select(
        "rule_id", "table_id", "table_name", "kind", "weight", "result_value", graded.alias("result_level"),
        "success", "error")


def _text(limit) -> str | None:
    return None if limit is None else str(limit)


def _number(value) -> Decimal:
    """Driver-side twin of the coercion rule for the single value of a statement or Python check."""
    try:
        return Decimal(str(value).strip()).quantize(Decimal("0.000001")) if value is not None else Decimal(0)
    except ArithmeticError:
        return Decimal(0)


def coerce_results(details: DataFrame, column: str = "result_value") -> DataFrame:
    return details.withColumn(column, decimal_value(F.col(column)))


def batch_status(details: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """SUCCESS without failures (or without rules), FAILED when all failed, else PARTIAL_FAILED."""
    ok, failed = count_when(F.col("success")), count_when(~F.col("success"))
    counts = details.groupBy("batch_id").agg(ok.alias("succeeded"), failed.alias("failed"))
    if batches is not None:
        counts = batches.select("batch_id").join(counts, "batch_id", "left").fillna(0)
    return counts.withColumn("batch_status", F.when(F.col("failed") == 0, "SUCCESS").when(
        F.col("succeeded") == 0, "FAILED").otherwise("PARTIAL_FAILED"))


def latest_details(details: DataFrame) -> DataFrame:
    """The newest result of each rule, as an aggregation that keeps one row per rule and task."""
    rest = [c for c in details.columns if c not in ("rule_id", "id")]
    newest = details.groupBy("rule_id").agg(
        F.max("id").alias("id"), F.max_by(F.struct(*rest), F.col("id")).alias("row"))
    return newest.select("rule_id", "id", "row.*")


def table_scores(results: DataFrame, warning_deduct: int = WARNING_DEDUCT, severe_deduct: int = SEVERE_DEDUCT,
                 bad_threshold: int = BAD_THRESHOLD) -> DataFrame:
    """Weighed score and health per table from one result per enabled rule (table_id, weight, result_level).

    100 times the passing share of the weight, minus deductions, not below zero; rules without a usable result stay
    out of the denominator, and a table without any usable rule gives no row.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1).cast("decimal(18,0)")
    lvl = F.col("result_level")
    total = lambda name: F.coalesce(F.sum(F.when(lvl == name, weight)), F.lit(0))
    sums = results.filter(lvl.isNotNull() & (lvl != "UNAVAILABLE")).groupBy("table_id").agg(
        F.sum(weight).alias("valid_w"), total("PASS").alias("pass_w"), total("WARNING").alias("warning_w"),
        total("SEVERE").alias("severe_w"), count_when(lvl == "PASS").alias("pass_rules"),
        count_when(lvl == "WARNING").alias("warning_rules"), count_when(lvl == "SEVERE").alias("severe_rules"))
    base = F.round((F.col("pass_w") * 100).cast("decimal(20,0)") / F.col("valid_w").cast("decimal(20,0)"), 6)
    deduction = F.col("warning_w") * warning_deduct + F.col("severe_w") * severe_deduct
    raw = F.round(F.greatest(base - deduction, F.lit(0).cast("decimal(20,6)")), 2).cast("decimal(5,2)")
    capped = F.least(raw, (F.lit(bad_threshold) - F.lit(Decimal("0.01"))).cast("decimal(5,2)"))
    severe = F.col("severe_rules") > 0
    score = F.when(severe, capped).otherwise(raw)
    return sums.select("table_id", score.cast("decimal(5,2)").alias("score"), "pass_rules", "warning_rules",
                       "severe_rules").withColumn("health_level", health(F.col("score"), severe, bad_threshold))


def health(score: Column, severe: Column, bad_threshold: int = BAD_THRESHOLD) -> Column:
    return (F.when(severe | (score < bad_threshold) & (score < GOOD_FROM), "BAD")
            .when(score >= EXCELLENT_FROM, "EXCELLENT").when(score >= GOOD_FROM, "GOOD").otherwise("WARNING"))


def rule_results(rules: DataFrame, details: DataFrame) -> DataFrame:
    """Latest level of every enabled rule; rules never run carry no level."""
    newest = latest_details(details).select("rule_id", "result_level")
    return rules.filter("enabled").select("rule_id", "table_id", "weight").join(newest, "rule_id", "left")


def append_score_history(history: DataFrame, scores: DataFrame, checked_at: Column) -> DataFrame:
    return history.unionByName(scores.withColumn("checked_at", checked_at).select(*history.columns))


def score_history_backfill(scores: DataFrame, history: DataFrame) -> DataFrame:
    """Current scores of tables that have no history yet: the rows a one-off back-fill appends."""
    return scores.join(history.select("table_id").distinct(), "table_id", "left_anti")
