"""Asset catalogue: search, browsing, classification, tags and popularity.

``tables`` carries ``table_id, table_name, datasource_id, database_name, schema_name, table_comment, owner_user_id,
source_status, source_type, data_domain, data_topic, updated_at``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from brightwell.functions.values import ago, count_when, escaped_contains, ntz
from brightwell.operators.runs import latest_by
from brightwell.operators import text_index
from brightwell.plans.lineage_cut import cut_lineage
from brightwell.plans.seek import page_of

# Search scores and look-back periods.
SCORES = {"table_name": 100, "prefix_bonus": 20, "comment": 60, "column": 40, "tag": 40, "owner": 20}
HEAT_DAYS, NEW_DAYS = 30, 7
SOURCE_RANK = {"BUILTIN": 3, "EXTERNAL": 2, "MANUAL": 1}


def _online() -> Column:
    return F.col("source_status") == "ONLINE"


def clean_keyword(keyword: str | None) -> str | None:
    """Trimmed; nothing for blanks and bare wildcards."""
    text = (keyword or "").strip()
    return text if text.strip("%_ ") else None


def column_hits(columns: DataFrame, keyword: str) -> DataFrame:
    """Tables that own an ONLINE column whose name or comment mentions the keyword."""
    return columns.filter(_online() & _mentions(columns, keyword, "column_name", "column_comment", "manual_comment")
                          ).select("table_id").distinct()


def _mentions(df: DataFrame, keyword: str, *names: str) -> Column:
    """Whether any of the named columns that exist contains the keyword."""
    tests = [F.coalesce(escaped_contains(F.col(n), keyword), F.lit(False)) for n in names if n in df.columns]
    return reduce(lambda a, b: a | b, tests)


def search(tables: DataFrame, columns: DataFrame, tags: DataFrame, table_tags: DataFrame, owners: DataFrame,
           keyword: str | None, n: int | None = None, index: str | None = None) -> DataFrame:
    """ONLINE tables that mention the keyword, scored by the strongest place it occurs in; the first ``n`` if given.

    Every place gives (table, score) hits; their maximum per table is joined to the tables once. Narrow ``tables``
    beforehand, by :func:`narrowed`, to search within a datasource, a health level or the tables granted. With the folder of
    a :func:`search_index` only rows that the index names are tested.
    """
    word = clean_keyword(keyword)
    shown = ["table_id", "table_name", "datasource_id", "database_name"]
    online = tables.filter(_online())
    if word is None:
        return online.select(*shown, F.lit(0).alias("score")).limit(0)
    hit = lambda ids, score: ids.select("table_id", F.lit(score).alias("score"))
    named = F.when(F.lower("table_name").startswith(word.lower()), SCORES["table_name"] + SCORES["prefix_bonus"]).when(
        escaped_contains(F.col("table_name"), word), SCORES["table_name"]).when(
        _mentions(tables, word, "table_comment", "manual_comment"), SCORES["comment"])
    near = online
    if index is not None:
        found = cut_lineage(text_index.candidates(tables.sparkSession, index, word))
        at = lambda df, place, key: df.join(
            found.filter(F.col("place") == place).select(F.col("id").alias(key)), key, "left_semi")
        near, columns = at(online, "table", "table_id"), at(columns, "column", "table_id")
        tags, owners = at(tags, "tag", "tag_id"), at(owners, "owner", "user_id")
    direct = near.select("table_id", named.alias("score")).filter(F.col("score").isNotNull())
    tagged = table_tags.join(tags.filter(escaped_contains(F.col("tag_name"), word)).select("tag_id"), "tag_id", "left_semi")
    people = owners.filter(escaped_contains(F.col("user_name"), word)).select(F.col("user_id").alias("owner_user_id"))
    owned = online.select("table_id", "owner_user_id").join(people, "owner_user_id", "left_semi")
    hits = direct.unionByName(hit(column_hits(columns, word), SCORES["column"])).unionByName(
        hit(tagged, SCORES["tag"])).unionByName(hit(owned, SCORES["owner"]))
    best = hits.groupBy("table_id").agg(F.max("score").alias("score"))
    found = online.select(*shown).join(best, "table_id").select(*shown, "score")
    return found if n is None else found.orderBy(F.desc("score"), "table_name", "table_id").limit(n)


def search_index(path: str, tables: DataFrame, columns: DataFrame, tags: DataFrame, owners: DataFrame) -> None:
    """Writes the trigrams of all texts that :func:`search` looks into, offline objects included, to a folder."""
    texts = lambda df, place, key, *names: [
        df.select(F.lit(place).alias("place"), F.col(key).cast("long").alias("id"), F.col(c).alias("text"))
        for c in names if c in df.columns]
    every = [*texts(tables, "table", "table_id", "table_name", "table_comment", "manual_comment"),
             *texts(columns, "column", "table_id", "column_name", "column_comment", "manual_comment"),
             *texts(tags, "tag", "tag_id", "tag_name"), *texts(owners, "owner", "user_id", "user_name")]
    text_index.build(reduce(DataFrame.unionByName, every), path)


def path_search(tables: DataFrame, keyword: str | None, n: int | None = None) -> DataFrame:
    """ONLINE tables whose database, schema or name mentions the keyword, in order of the path; the first ``n`` if given."""
    word = clean_keyword(keyword)
    path = ["datasource_id", "database_name", "schema_name", "table_name"]
    if word is None:
        return tables.select("table_id", *path).limit(0)
    hit = _mentions(tables, word, "database_name", "schema_name", "table_name")
    found = tables.filter(_online() & hit).select("table_id", *path)
    if n is None:
        return found
    return found.orderBy("datasource_id", "database_name", F.coalesce("schema_name", F.lit("")), "table_name",
                         "table_id").limit(n)


def narrowed(tables: DataFrame, datasource_id: int | None = None, health: DataFrame | None = None,
             health_level: str | None = None, granted: DataFrame | None = None) -> DataFrame:
    """Tables of one datasource, one health level and the grants of a user, each only if given."""
    if datasource_id is not None:
        tables = tables.filter(F.col("datasource_id") == datasource_id)
    if health_level and health is not None:
        tables = tables.join(health.filter(F.col("health_level") == health_level).select("table_id"), "table_id", "left_semi")
    return tables if granted is None else tables.join(granted.select("table_id"), "table_id", "left_semi")


def heat(view_log: DataFrame, as_of, days: int = HEAT_DAYS) -> DataFrame:
    return view_log.filter(F.col("view_date") >= F.to_date(ago(as_of, days=days))).groupBy("table_id").agg(
        F.sum("view_count").alias("view_count"))


def browsed(tables: DataFrame, scores: DataFrame, domain: str | None = None, topic: str | None = None,
            datasource_id: int | None = None, uncategorized: bool = False, health_level: str | None = None,
            tagged: DataFrame | None = None, granted: DataFrame | None = None) -> DataFrame:
    """ONLINE tables under optional filters; count them for the total that goes with a page."""
    rows = narrowed(tables.filter(_online()), datasource_id, scores, health_level, granted)
    blank = F.trim(F.coalesce("data_domain", F.lit(""))) == ""
    if uncategorized:
        rows = rows.filter(blank)
    else:
        rows = rows.filter(F.col("data_domain") == domain) if domain else rows
        rows = rows.filter(F.col("data_topic") == topic) if topic else rows
    return rows if tagged is None else rows.join(tagged.select("table_id"), "table_id", "left_semi")


def browse(tables: DataFrame, scores: DataFrame, view_log: DataFrame, as_of, sort: str = "name", page: int = 1,
           size: int = 20, after: Mapping[str, object] | None = None, **filters) -> DataFrame:
    """One page of :func:`browsed`, sorted by name, latest, score or hot over all of them; ``after`` as in
    :func:`seek.page_of`."""
    rows = browsed(tables, scores, **filters).select("table_id", "table_name", "data_domain", "data_topic", "updated_at")
    scored, views = scores.select("table_id", "score", "health_level"), F.coalesce("view_count", F.lit(0))
    # A page is written once, so the look-ups below do not search the catalogue again.
    first = {"score": [("score", True)], "hot": [("view_count", True)], "latest": [("updated_at", True)]}.get(sort, [])
    ranked = rows
    if sort == "score":
        ranked = rows.join(scored, "table_id", "left")
    elif sort == "hot":
        ranked = rows.join(heat(view_log, as_of), "table_id", "left").withColumn("view_count", views)
    shown = cut_lineage(page_of(ranked, [*first, ("table_name", False), ("table_id", False)], size, page, after))
    # What the page still lacks is looked up for its rows alone, of which there are at most ``size``.
    on_page = lambda df: df.join(F.broadcast(shown.select("table_id")), "table_id", "left_semi")
    if sort != "score":
        shown = shown.join(on_page(scored), "table_id", "left")
    if sort != "hot":
        shown = shown.join(heat(on_page(view_log), as_of), "table_id", "left").withColumn("view_count", views)
    return shown


def classification_counts(tables: DataFrame) -> DataFrame:
    """Totals, uncategorised, per domain and per topic of a domain, from one roll-up."""
    clean = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    rows = tables.filter(_online()).select(clean("data_domain").alias("domain"), clean("data_topic").alias("topic"))
    rolled = rows.rollup("domain", "topic").agg(F.grouping_id().alias("g"), F.count("*").alias("tables"))
    g, domain, topic = F.col("g"), F.col("domain"), F.col("topic")
    kind = (F.when(g == 3, "ALL").when((g == 1) & domain.isNull(), "UNCATEGORIZED").when(g == 1, "DOMAIN")
            .when((g == 0) & domain.isNotNull() & topic.isNotNull(), "TOPIC"))
    return rolled.select(kind.alias("kind"), "domain", "topic", "tables").filter(F.col("kind").isNotNull())


def table_listing(tables: DataFrame, columns: DataFrame, collections: DataFrame) -> DataFrame:
    """ONLINE tables with their ONLINE column count and latest collection time."""
    counts = columns.filter(_online()).groupBy("table_id").agg(F.count("*").alias("column_count"))
    return tables.filter(_online()).join(counts, "table_id", "left").join(
        collections.select("table_id", "last_collect_time"), "table_id", "left").select(
        "table_id", "datasource_id", "database_name", "schema_name", "table_name",
        F.coalesce("column_count", F.lit(0)).alias("column_count"), "last_collect_time")


def tag_cloud(tags: DataFrame, table_tags: DataFrame) -> DataFrame:
    counts = table_tags.groupBy("tag_id").agg(F.count("*").alias("n"))
    return tags.select("tag_id", "tag_name").join(counts, "tag_id", "left").select(
        "tag_id", "tag_name", F.coalesce("n", F.lit(0)).alias("references"))


def tags_by_table(tags: DataFrame, table_tags: DataFrame) -> DataFrame:
    """Sorted tag names per table; a set, so its length is bounded by the tag list."""
    return table_tags.join(tags, "tag_id").groupBy("table_id").agg(
        F.sort_array(F.collect_set("tag_name")).alias("tags"))


def orphan_tags(tags: DataFrame, table_tags: DataFrame) -> DataFrame:
    return tags.join(table_tags.select("tag_id"), "tag_id", "left_anti").select("tag_id", "tag_name")


def view_counts(views: DataFrame, ts: str = "ts") -> DataFrame:
    """Views per table and day."""
    return views.groupBy("table_id", F.to_date(ts).alias("view_date")).agg(F.count("*").alias("view_count"))


def hot_tables(view_log: DataFrame, tables: DataFrame, as_of, n: int = 10, days: int = HEAT_DAYS) -> DataFrame:
    online = tables.filter(_online()).select("table_id", "table_name")
    return heat(view_log, as_of, days).join(online, "table_id").orderBy(F.desc("view_count"), "table_id").limit(n)


def asset_totals(tables: DataFrame, as_of, ts: str = "updated_at") -> DataFrame:
    return tables.agg(F.count("*").alias("total"), count_when(_online()).alias("online"),
                      count_when((F.col(ts) >= ago(as_of, days=NEW_DAYS)) & (F.col(ts) <= ntz(as_of))).alias("new_7d"))


def datasources(tables: DataFrame) -> DataFrame:
    """Datasources with ONLINE tables and the source type that ranks highest among them."""
    rank = F.coalesce(*[F.when(F.col("source_type") == k, v) for k, v in SOURCE_RANK.items()], F.lit(0))
    return tables.filter(_online()).groupBy("datasource_id").agg(
        F.max_by("source_type", F.struct(rank, "source_type")).alias("source_type"), F.count("*").alias("tables"))


def followed_changes(follows: DataFrame, tables: DataFrame, changes: DataFrame, user_id: int) -> DataFrame:
    """The tables a user follows, newest follow first, each with its latest change."""
    from brightwell.operators.schema import latest_change

    mine = follows.filter(F.col("user_id") == user_id).select("table_id", "followed_at")
    named = mine.join(tables.select("table_id", "database_name", F.coalesce("schema_name", F.lit("")).alias(
        "schema_name"), "table_name"), "table_id")
    newest = latest_change(changes).select("database_name", "schema_name", "table_name", "change_type",
                                           F.col("created_at").alias("changed_at"))
    return named.join(newest, ["database_name", "schema_name", "table_name"], "left")


def where_used(datasource_id: int, tasks: DataFrame, rules: DataFrame, jobs: DataFrame) -> DataFrame:
    """Everything that refers to a datasource as one typed list."""
    pick = lambda df, kind: df.filter(F.col("datasource_id") == datasource_id).select(
        "ref_id", "ref_name", F.lit(kind).alias("ref_type"))
    return pick(tasks, "COLLECT").unionByName(pick(rules, "QUALITY_RULE")).unionByName(pick(jobs, "SYNC"))


def latest_score(history: DataFrame) -> DataFrame:
    return latest_by(history, ["table_id"], [F.col("id")])
