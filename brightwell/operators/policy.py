"""Access grants and sensitivity levels as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


# Sensitivity levels from open to closed.
LEVELS = ("PUBLIC", "INTERNAL", "CONFIDENTIAL")


def _level(col: str = "sensitivity_level") -> Column:
    """An unlabelled table is public."""
    return F.when(F.trim(F.coalesce(F.col(col), F.lit(""))) == "", LEVELS[0]).otherwise(F.col(col))


def _rank(level: Column) -> Column:
    return F.when(level == "CONFIDENTIAL", 3).when(level == "INTERNAL", 2).otherwise(1)


def apply_grants(tables: DataFrame, grants: DataFrame | None) -> DataFrame:
    """Rows reachable by at least one grant of source, database or table grain.

    ``None`` stands for an unrestricted user. Each grain is an equi-join against its distinct keys, so no grain needs
    a nested loop and a table is kept once however many grants reach it.
    """
    if grants is None:
        return tables
    db, table = F.col("database_name"), F.col("table_name")
    keys = ["datasource_id", "database_name", "table_name"]
    flag = lambda df, cols, name: df.select(*cols).distinct().withColumn(name, F.lit(True))
    by_source = flag(grants.filter(db.isNull() & table.isNull()), keys[:1], "g1")
    by_database = flag(grants.filter(db.isNotNull() & table.isNull()), keys[:2], "g2")
    by_table = flag(grants.filter(table.isNotNull()), keys, "g3")
    joined = tables.join(by_source, keys[:1], "left").join(by_database, keys[:2], "left").join(by_table, keys, "left")
    return joined.filter(F.coalesce("g1", "g2", "g3")).select(*tables.columns)


def accessible_databases(databases: DataFrame, grants: DataFrame | None) -> DataFrame:
    """Databases reachable by a source or database grant (a table grant names its database too)."""
    if grants is None:
        return databases
    db = F.col("database_name")
    keys = ["datasource_id", "database_name"]
    whole = grants.filter(db.isNull()).select("datasource_id").distinct().withColumn("g1", F.lit(True))
    single = grants.filter(db.isNotNull()).select(*keys).distinct().withColumn("g2", F.lit(True))
    joined = databases.join(whole, "datasource_id", "left").join(single, keys, "left")
    return joined.filter(F.coalesce("g1", "g2")).select(*databases.columns)


def accessible_datasources(sources: DataFrame, grants: DataFrame | None) -> DataFrame:
    return sources if grants is None else sources.join(grants.select("datasource_id"), "datasource_id", "left_semi")


def sensitivity_tree(tables: DataFrame) -> DataFrame:
    """The strictest level per source, database and table over all schemas; the internal source -1 is left out."""
    level = _level()
    return tables.filter((F.col("source_status") == "ONLINE") & (F.col("datasource_id") != -1)).groupBy(
        "datasource_id", "database_name", "table_name").agg(F.max_by(level, _rank(level)).alias("sensitivity_level"))


def _strictest(tables: DataFrame, *keys: str) -> DataFrame:
    level = _level()
    return tables.groupBy(*keys).agg(F.max_by(level, _rank(level)).alias("sensitivity_level"))


def confidential_hits(statement_tables: DataFrame, tables: DataFrame) -> DataFrame:
    """Logged statements that touch a confidential table; names are compared without their database prefix.

    ``statement_tables`` holds (id, table_name) rows as the lineage operators give them.
    """
    bare = F.element_at(F.split("table_name", r"\."), -1)
    named = statement_tables.select("id", F.lower(bare).alias("bare_name")).distinct()
    closed = _strictest(tables.withColumn("bare_name", F.lower("table_name")), "bare_name").filter(
        F.col("sensitivity_level") == "CONFIDENTIAL")
    hits = named.join(closed.select("bare_name"), "bare_name")
    return hits.groupBy("id").agg(F.count("*").alias("confidential_tables"), F.min("bare_name").alias("first_table"))


def publishable(tables: DataFrame, exempted: Column | None = None) -> DataFrame:
    """Whether a table may feed a public endpoint; the strictest of several rows of one name decides."""
    level = _level()
    free = F.lit(False) if exempted is None else F.coalesce(exempted, F.lit(False))
    reason = F.when(level == "CONFIDENTIAL", 2).when((level == "INTERNAL") & ~free, 1).otherwise(0)
    worst = tables.groupBy("datasource_id", "database_name", "table_name").agg(F.max(reason).alias("w"))
    return worst.select("datasource_id", "database_name", "table_name", (F.col("w") == 0).alias("publishable"),
                        F.when(F.col("w") == 2, "CONFIDENTIAL").when(F.col("w") == 1, "NOT_EXEMPTED").alias("reason"))


def to_disable(apis: DataFrame, tables: DataFrame) -> DataFrame:
    """Published endpoints over tables that are now confidential."""
    closed = tables.filter(_level() == "CONFIDENTIAL").select("table_id").distinct()
    live = apis.filter((F.col("status") == "PUBLISHED") & ~F.coalesce("deleted", F.lit(False)))
    return live.join(closed, "table_id", "left_semi")


def level_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables whose level differs between two states."""
    before = old.select("table_id", F.col("sensitivity_level").alias("old_level"))
    after = new.select("table_id", F.col("sensitivity_level").alias("new_level"))
    return before.join(after, "table_id").filter(~F.col("old_level").eqNullSafe(F.col("new_level")))
