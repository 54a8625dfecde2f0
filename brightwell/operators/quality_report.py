"""Reports over graded check results and scores."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightwell.functions.values import ago, count_when, ntz, percent
from brightwell.plans.seek import page_of

EXPORT_CAP = 5000  # fixed value: rows in an exported issue list
DEFAULT_DAYS = 30


@dataclass(frozen=True)
class Scope:
    """Optional narrowing of a report; the time range is closed and defaults to the 30 days before ``as_of``."""

    as_of: str
    t_from: str | None = None
    datasource_id: int | None = None
    database_name: str | None = None
    job_id: int | None = None

    def within(self, ts: Column) -> Column:
        first = ntz(self.t_from) if self.t_from else ago(self.as_of, days=DEFAULT_DAYS)
        return (ts >= first) & (ts <= ntz(self.as_of))


def _tables_in(scope: Scope, tables: DataFrame) -> DataFrame | None:
    if scope.datasource_id is None and scope.database_name is None:
        return None
    if scope.datasource_id is not None:
        tables = tables.filter(F.col("datasource_id") == scope.datasource_id)
    if scope.database_name is not None:
        tables = tables.filter(F.col("database_name") == scope.database_name)
    return tables


def scoped_details(details: DataFrame, scope: Scope, tables: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    rows = details.filter(scope.within(F.col("created_at")))
    inside = _tables_in(scope, tables)
    if inside is not None:
        rows = rows.join(inside.select("table_id"), "table_id", "left_semi")
    if scope.job_id is not None and batches is not None:
        rows = rows.join(batches.filter(F.col("job_id") == scope.job_id).select("batch_id"), "batch_id", "left_semi")
    return rows


def online_in(scope: Scope, tables: DataFrame, job_tables: DataFrame | None = None) -> DataFrame:
    """ONLINE tables in scope; a job narrows to the tables its rules check."""
    inside = _tables_in(scope, tables)
    online = (tables if inside is None else inside).filter(F.col("source_status") == "ONLINE")
    if scope.job_id is not None and job_tables is not None:
        mine = job_tables.filter(F.col("job_id") == scope.job_id).select("table_id")
        online = online.join(mine, "table_id", "left_semi")
    return online


def quality_summary(details: DataFrame) -> DataFrame:
    lvl = F.col("result_level")
    sums = details.agg(
        F.count("*").alias("details"), F.count_distinct("batch_id").alias("batches"),
        count_when(lvl == "PASS").alias("passed"), count_when(lvl != "UNAVAILABLE").alias("valid"),
        count_when(lvl == "SEVERE").alias("severe"), count_when(lvl == "WARNING").alias("warning"))
    return sums.withColumn("pass_rate", percent(F.col("passed"), F.col("valid")))


def level_trend(details: DataFrame) -> DataFrame:
    lvl = F.col("result_level")
    return details.groupBy(F.to_date("created_at").alias("day")).agg(
        *[count_when(lvl == name).alias(name.lower()) for name in ("PASS", "WARNING", "SEVERE", "UNAVAILABLE")])


def _mean(col: str) -> Column:
    """Mean of a two-place decimal, rounded half up once."""
    return F.round(F.try_divide(F.sum(col), F.count(col).cast("decimal(20,0)")), 2).cast("decimal(5,2)")


def avg_score(scores: DataFrame, online: DataFrame) -> DataFrame:
    return scores.join(online.select("table_id"), "table_id", "left_semi").agg(
        _mean("score").alias("avg_score"), F.count("*").alias("tables"))


def score_distribution(scores: DataFrame, online: DataFrame) -> DataFrame:
    """ONLINE tables per health level and those without a score."""
    joined = online.select("table_id").join(scores.select("table_id", "health_level"), "table_id", "left")
    lvl = F.col("health_level")
    return joined.agg(
        F.count("*").alias("total_tables"),
        *[count_when(lvl == name).alias(name.lower()) for name in ("EXCELLENT", "GOOD", "WARNING", "BAD")],
        count_when(lvl.isNull()).alias("no_score"))


def score_by_datasource(scores: DataFrame, online: DataFrame) -> DataFrame:
    return scores.join(online.select("table_id", "datasource_id"), "table_id").groupBy("datasource_id").agg(
        _mean("score").alias("avg_score"), F.count("*").alias("tables")).orderBy(
        F.desc("avg_score"), F.asc("datasource_id"))


def score_trend(history: DataFrame, scope: Scope, online: DataFrame) -> DataFrame:
    rows = history.filter(scope.within(F.col("checked_at"))).join(
        online.select("table_id"), "table_id", "left_semi")
    return rows.groupBy(F.to_date("checked_at").alias("day")).agg(
        _mean("score").alias("avg_score"), F.count_distinct("table_id").alias("tables"))


def score_series(history: DataFrame, scope: Scope, table_id: int) -> DataFrame:
    return history.filter((F.col("table_id") == F.lit(table_id)) & scope.within(F.col("checked_at"))).orderBy(
        "checked_at", "id")


def _found(details: DataFrame) -> DataFrame:
    return details.filter(F.col("result_level").isin("WARNING", "SEVERE"))


def issues(details: DataFrame, tables: DataFrame, rules: DataFrame) -> DataFrame:
    """Warnings and severe findings with the limit that was crossed.

    Rule name, type and metric are those recorded with the detail and outlive the rule; only the limit is looked up, so
    it is null once the rule is gone. The table is named with its schema, or else its database, in front.
    """
    lvl = F.col("result_level")
    kept = [c for c in ("rule_name", "rule_type", "result_metric") if c in details.columns]
    found = _found(details).select(
        F.col("id").alias("detail_id"), "table_id", "rule_id", *kept, "result_value", "result_level",
        F.col("created_at").alias("checked_at"))
    front = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in ("schema_name", "database_name") if c in tables.columns]
    named = tables.select("table_id", F.concat_ws(".", F.coalesce(*front), "table_name").alias("table_name") if front
                          else F.col("table_name"))
    limit = F.when(lvl == "SEVERE", F.col("severe_threshold")).otherwise(F.col("warning_threshold"))
    return found.join(named, "table_id", "left").join(
        rules.select("rule_id", "warning_threshold", "severe_threshold"), "rule_id", "left").select(
        "detail_id", "table_id", "table_name", "rule_id", *kept, "result_value", limit.alias("threshold"),
        "result_level", "checked_at")


def issue_total(details: DataFrame) -> DataFrame:
    return _found(details).agg(F.count("*").alias("total"))


def issue_page(details: DataFrame, tables: DataFrame, rules: DataFrame, page: int = 1, size: int = 10,
               after: Mapping[str, object] | None = None) -> DataFrame:
    """One page, newest first, by its number or behind the ``id`` in ``after``. It is cut before names are joined."""
    return issues(page_of(_found(details), [("id", True)], size, page, after), tables, rules)


def export_issues(details: DataFrame, tables: DataFrame, rules: DataFrame, n: int | None = None) -> DataFrame:
    """All issues, or the newest ``n`` if the caller asks, with a flag that says whether more exist."""
    if n is None:
        return issues(details, tables, rules).withColumn("truncated", F.lit(False))
    newest = _found(details).orderBy(F.desc("id")).limit(n + 1)
    flagged = newest.withColumn("truncated", F.count("*").over(Window.partitionBy()) > n)  # at most n + 1 rows
    kept = flagged.orderBy(F.desc("id")).limit(n)
    return issues(kept, tables, rules).join(kept.select(F.col("id").alias("detail_id"), "truncated"), "detail_id")


def rules_per_job(links: DataFrame) -> DataFrame:
    return links.groupBy("job_id").agg(F.count("*").alias("rules"))


def jobs_by_rule(rules: DataFrame, links: DataFrame) -> DataFrame:
    """Names of the jobs each rule belongs to, sorted; a rule without jobs has an empty list."""
    names = links.groupBy("rule_id").agg(F.sort_array(F.collect_set("job_name")).alias("job_names"))
    return rules.select("rule_id").join(names, "rule_id", "left").select(
        "rule_id", F.coalesce("job_names", F.array().cast("array<string>")).alias("job_names"))
