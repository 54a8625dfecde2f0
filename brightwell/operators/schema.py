"""Snapshots of tables and columns, their differences, and keyed document differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brightwell.functions.values import count_when
from brightwell.plans.joins import null_safe_join
from brightwell.plans.tree_diff import bucket_digests, differing_buckets, within

# Column attributes whose change is reported, with the name each change carries.
ATTRIBUTES = {"data_type": "TYPE", "column_comment": "COMMENT", "ordinal_position": "ORDINAL", "nullable": "NULLABLE",
              "column_default": "DEFAULT"}
TABLE_KEY = ("datasource_id", "database_name", "schema_name", "table_name")


def snapshot(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column rows of live frames, read from their schemas without touching data."""
    rows = [(table, f.name, f.dataType.simpleString(), i + 1, f.nullable, f.metadata.get("comment"))
            for table, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal_position int, "
                                       "nullable boolean, column_comment string")


def _text(attribute: str, side: str) -> Column:
    """How the change log shows a value of an attribute."""
    col = F.col(f"{side}.{attribute}")
    if attribute == "nullable":
        return F.when(col, "true").otherwise("false")
    if attribute == "ordinal_position":
        return F.coalesce(col.cast("string"), F.lit("null"))
    if attribute == "column_default":
        return F.coalesce(col.cast("string"), F.lit(""))
    return col.cast("string")


def _summary(side: str) -> Column:
    return F.concat(F.coalesce(F.col(f"{side}.data_type"), F.lit("null")), F.lit("|"), _text("nullable", side),
                    F.lit("|"), F.coalesce(F.col(f"{side}.column_comment"), F.lit("")))


def changed_parts(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str], buckets: int,
                  bucket_key: Sequence[str] | None = None, counted: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Both snapshots without the buckets in which they agree; ``counted`` says which old rows stand for a present object."""
    present = old if counted is None else old.filter(counted)
    digests = [bucket_digests(side, key, columns, buckets, bucket_key) for side in (present, new)]
    differing = differing_buckets(*digests)
    return within(old, differing, bucket_key or key, buckets), within(new, differing, bucket_key or key, buckets)


def schema_diff(old: DataFrame, new: DataFrame, key: Sequence[str] = ("table_name", "column_name"),
                buckets: int | None = None) -> DataFrame:
    """Column changes from the stored snapshot to the collected one.

    One full outer join on the column key, then one row per changed attribute. Old columns marked OFFLINE that come
    back count as added; OFFLINE columns that stay away give nothing. Columns of a table unknown to the old snapshot
    are logged as part of the added table. A table absent from the new snapshot belongs to :func:`table_diff`. With
    ``buckets`` large snapshots are first compared by the hashes of so many buckets of tables, and only what differs is joined.
    """
    key = list(key)
    table_key = [k for k in key if k != "column_name"]
    attributes = [a for a in ATTRIBUTES if a in old.columns and a in new.columns]
    online = (F.col("source_status") == "ONLINE") if "source_status" in old.columns else F.lit(True)
    if buckets:
        old, new = changed_parts(old, new, key, attributes, buckets, table_key, F.coalesce(online, F.lit(False)))
    pack = lambda df, extra: df.select(*key, F.struct(*attributes, *extra).alias("s"))
    left = pack(old, [online.alias("online")]).withColumnRenamed("s", "o")
    right = pack(new, []).withColumnRenamed("s", "n")
    known = old.select(*table_key).distinct().withColumn("known", F.lit(True))
    kept = new.select(*table_key).distinct()
    matched = null_safe_join(left, right, key, "full")
    missing, was_online = F.col("o").isNull(), F.coalesce(F.col("o.online"), F.lit(False))
    appeared = F.col("n").isNotNull() & (missing | ~was_online)
    change = lambda kind, before, after: F.struct(
        kind.alias("change_type"), before.cast("string").alias("old_value"), after.cast("string").alias("new_value"))
    none = F.lit(None)
    added = F.when(appeared, change(F.lit("ADDED_COLUMN"), none, _summary("n")))
    deleted = F.when(F.col("n").isNull() & was_online, change(F.lit("DELETED_COLUMN"), _summary("o"), none))
    both = was_online & F.col("n").isNotNull()
    modified = [F.when(both & ~F.col(f"o.{a}").eqNullSafe(F.col(f"n.{a}")),
                       change(F.lit(f"MODIFIED_COLUMN_{ATTRIBUTES[a]}"), _text(a, "o"), _text(a, "n")))
                for a in attributes]
    entries = F.filter(F.array(added, deleted, *modified), lambda c: c.isNotNull())
    changes = matched.select(*key, F.explode(entries).alias("c")).select(*key, "c.*")
    labelled = null_safe_join(changes, known, table_key, "left")
    new_table = (F.col("change_type") == "ADDED_COLUMN") & F.col("known").isNull()
    gone = F.col("change_type") == "DELETED_COLUMN"
    # Columns of a table that vanished as a whole are cascaded by the table difference, not logged one by one.
    still_there = null_safe_join(labelled.filter(gone), kept, table_key, "left_semi")
    return labelled.filter(~gone).unionByName(still_there).withColumn(
        "change_type", F.when(new_table, "ADDED_TABLE").otherwise(F.col("change_type"))).drop("known")


def table_diff(old: DataFrame, new: DataFrame, buckets: int | None = None) -> DataFrame:
    """Table changes: added, comment modified, revived and deleted.

    A database of a source whose new list is empty is taken as not collected, so nothing in it counts as deleted.
    ``buckets`` as in :func:`schema_diff`.
    """
    key = list(TABLE_KEY)
    blank = F.coalesce(F.col("schema_name"), F.lit("")).alias("schema_name")
    old, new = old.withColumn("schema_name", blank), new.withColumn("schema_name", blank)
    lists = new.select("datasource_id", "database_name", "schema_name").distinct().withColumn("listed", F.lit(True))
    if buckets:
        online = F.coalesce(F.col("source_status") == "ONLINE", F.lit(False))
        old, new = changed_parts(old, new, key, ["table_comment"], buckets, counted=online)
    left = old.select(*key, F.struct("table_comment", "source_status").alias("o"))
    right = new.select(*key, F.struct("table_comment").alias("n"))
    joined = left.join(right, key, "full").join(lists, key[:3], "left")
    online = F.col("o.source_status") == "ONLINE"
    same = F.col("o.table_comment").eqNullSafe(F.col("n.table_comment"))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    change = lambda kind, before, after: F.struct(
        F.lit(kind).alias("change_type"), before.alias("old_value"), after.alias("new_value"))
    none = F.lit(None).cast("string")
    entries = F.array(
        F.when(F.col("o").isNull(), change("ADDED_TABLE", none, none)),
        F.when(both & ~same, change("MODIFIED_TABLE", F.col("o.table_comment"), F.col("n.table_comment"))),
        F.when(both & ~online, change("REVIVED_TABLE", none, none)),
        F.when(F.col("n").isNull() & online & F.col("listed"),
               change("DELETED_TABLE", F.col("o.table_comment"), none)))
    return joined.select(*key, F.explode(F.filter(entries, lambda c: c.isNotNull())).alias("c")).select(*key, "c.*")


def cascade_deleted(columns: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The column rows that go offline with their deleted tables."""
    deleted = changes.filter(F.col("change_type") == "DELETED_TABLE").select(*key)
    return columns.join(deleted, list(key), "left_semi")


def diff_counts(changes: DataFrame) -> DataFrame:
    """Counters of a collection run. A column changed in several attributes counts once."""
    kind, is_column = F.col("change_type"), F.col("column_name").isNotNull()
    per_object = changes.groupBy("table_name", "column_name").agg(
        F.max((kind == "ADDED_TABLE") & ~is_column).alias("ta"), F.max(kind == "MODIFIED_TABLE").alias("tm"),
        F.max(kind == "DELETED_TABLE").alias("td"),
        F.max(is_column & kind.isin("ADDED_TABLE", "ADDED_COLUMN")).alias("ca"),
        F.max(kind.startswith("MODIFIED_COLUMN")).alias("cm"), F.max(kind == "DELETED_COLUMN").alias("cd"))
    names = {"ta": "tables_added", "tm": "tables_modified", "td": "tables_deleted",
             "ca": "columns_added", "cm": "columns_modified", "cd": "columns_deleted"}
    return per_object.agg(*[count_when(F.col(c)).alias(n) for c, n in names.items()])


def latest_change(changes: DataFrame) -> DataFrame:
    """The newest change of each table (database, schema, table)."""
    from brightwell.operators.runs import latest_by

    keyed = changes.withColumn("schema_name", F.coalesce("schema_name", F.lit("")))
    return latest_by(keyed, ["database_name", "schema_name", "table_name"], [F.col("id")])


def keyed_diff(left: DataFrame, right: DataFrame, key: str | Sequence[str], cols: Sequence[str],
               buckets: int | None = None) -> DataFrame:
    """Keys added, removed or modified between two versions; the compared columns travel as one digest. ``buckets`` as in
    :func:`schema_diff`."""
    keys = [key] if isinstance(key, str) else list(key)
    if buckets:
        left, right = changed_parts(left, right, keys, cols, buckets)
    digest = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    a = left.select(*keys, digest.alias("l"))
    b = right.select(*keys, digest.alias("r"))
    state = (F.when(F.col("l").isNull(), "ADDED").when(F.col("r").isNull(), "REMOVED")
             .when(F.col("l") != F.col("r"), "MODIFIED"))
    return a.join(b, keys, "full").select(*keys, state.alias("change")).filter(F.col("change").isNotNull())


def edge_set_diff(left: DataFrame, right: DataFrame, source: str, target: str) -> DataFrame:
    """Edges only on one side, as sets: both versions are counted in one aggregation."""
    tagged = left.select(source, target, F.lit(1).alias("side")).unionByName(
        right.select(source, target, F.lit(2).alias("side")))
    sides = tagged.groupBy(source, target).agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return sides.filter(F.col("lo") == F.col("hi")).select(
        source, target, F.when(F.col("lo") == 2, "ADDED").otherwise("REMOVED").alias("change"))
