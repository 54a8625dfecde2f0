"""Asset catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brightwell.operators import catalog as ops
from brightwell.operators.table_query import total
from brightwell.plans.lineage_cut import ensure_checkpoint_dir
from registry.base import Registry, shown
from registry.views import EVENT_CLOCK

R = Registry()
KEYWORD = "en_1"


def _search(lake, word, cap=None):
    return ops.search(lake("asset"), lake("asset_column"), lake("asset_tag"), lake("asset_table_tag"), lake("asset_owner"),
                      word, cap)


def _search_sql(word):
    return f"""
WITH cols AS (SELECT DISTINCT table_id FROM asset_column WHERE source_status = 'ONLINE' AND
    (contains(lower(column_name), '{word}') OR contains(lower(column_comment), '{word}'))),
tags AS (SELECT DISTINCT b.table_id FROM asset_table_tag b JOIN asset_tag t ON t.tag_id = b.tag_id
    WHERE contains(lower(tag_name), '{word}')),
s AS (SELECT table_id, table_name, datasource_id, database_name, CASE
    WHEN starts_with(lower(table_name), '{word}') THEN 120 WHEN contains(lower(table_name), '{word}') THEN 100
    WHEN contains(lower(table_comment), '{word}') THEN 60 WHEN table_id IN (SELECT table_id FROM cols) THEN 40
    WHEN table_id IN (SELECT table_id FROM tags) THEN 40
    WHEN owner_user_id IN (SELECT user_id FROM asset_owner WHERE contains(lower(user_name), '{word}')) THEN 20 END AS score
  FROM asset WHERE source_status = 'ONLINE')
SELECT * FROM s WHERE score IS NOT NULL"""


@R.query("h1_search", _search_sql("en_1"))
def _(lake):
    return _search(lake, " EN_1 ")


def _indexed(lake, word):
    folder = f"{ensure_checkpoint_dir(lake.spark)}/grams-{uuid.uuid4().hex}"
    ops.search_index(folder, lake("asset"), lake("asset_column"), lake("asset_tag"), lake("asset_owner"))
    return ops.search(lake("asset"), lake("asset_column"), lake("asset_tag"), lake("asset_table_tag"), lake("asset_owner"),
                      word, index=folder)


@R.query("h1_search_by_index", _search_sql("en_1"))
def _(lake):
    return _indexed(lake, "EN_1")


@R.query("h1_search_of_two_letters_by_index", _search_sql("00"))
def _(lake):
    return _indexed(lake, "00")


@R.query("h1_search_by_prefix", _search_sql("src1"))
def _(lake):
    return _search(lake, "src1")


@R.query("h1_search_by_tag_and_owner", _search_sql("000"))
def _(lake):
    return _search(lake, "000")


@R.query("h1_search_top", f"SELECT * FROM ({_search_sql('a')}) x ORDER BY score DESC, table_name, table_id LIMIT 200")
def _(lake):
    return _search(lake, "a", 200)


@R.query("h1_search_within_a_datasource", f"""SELECT x.* FROM ({_search_sql('a')}) x JOIN asset_score s ON s.table_id = x.table_id
  WHERE datasource_id = 2 AND health_level = 'BAD' AND x.table_id % 3 = 0""")
def _(lake):
    granted = lake("asset").filter("table_id % 3 = 0")
    tables = ops.narrowed(lake("asset"), 2, lake("asset_score"), "BAD", granted)
    return ops.search(tables, lake("asset_column"), lake("asset_tag"), lake("asset_table_tag"), lake("asset_owner"), "a")


@R.query("h3_column_hits", """
SELECT DISTINCT table_id FROM asset_column WHERE source_status = 'ONLINE'
  AND (contains(lower(column_name), 'user') OR contains(lower(column_comment), 'user'))""")
def _(lake):
    return ops.column_hits(lake("asset_column"), "User")


@R.query("h4_path_search", """
SELECT table_id, datasource_id, database_name, schema_name, table_name FROM asset WHERE source_status = 'ONLINE' AND
  (contains(lower(database_name), '1') OR contains(lower(COALESCE(schema_name, '')), '1') OR contains(lower(table_name), '1'))
""")
def _(lake):
    return ops.path_search(lake("asset"), "1")


@R.query("h4_path_search_top", """
SELECT table_id, datasource_id, database_name, schema_name, table_name FROM asset WHERE source_status = 'ONLINE' AND
  (contains(lower(database_name), '1') OR contains(lower(COALESCE(schema_name, '')), '1') OR contains(lower(table_name), '1'))
ORDER BY datasource_id, database_name, COALESCE(schema_name, ''), table_name, table_id LIMIT 100""")
def _(lake):
    return ops.path_search(lake("asset"), "1", 100)


HEAT = """heat AS (SELECT table_id, CAST(SUM(view_count) AS BIGINT) AS view_count FROM asset_view
  WHERE view_date >= DATE '2024-01-01' GROUP BY table_id)"""
BROWSE = """SELECT a.table_id, a.table_name, data_domain, data_topic, updated_at, CAST(score AS DOUBLE) AS score, health_level,
  COALESCE(view_count, 0) AS view_count FROM asset a LEFT JOIN asset_score s ON s.table_id = a.table_id
  LEFT JOIN heat h ON h.table_id = a.table_id WHERE source_status = 'ONLINE'"""


def _browse(lake, **options):
    return shown(ops.browse(lake("asset"), lake("asset_score"), lake("asset_view"), EVENT_CLOCK, **options))


@R.query("h5_browse_by_name", f"WITH {HEAT} {BROWSE} AND data_domain = 'en' AND data_topic = 'src3' "
                              "ORDER BY a.table_name, a.table_id LIMIT 20")
def _(lake):
    return _browse(lake, domain="en", topic="src3")


@R.query("h5_browse_latest", f"WITH {HEAT} {BROWSE} AND (data_domain IS NULL OR trim(data_domain) = '') "
                             "ORDER BY updated_at DESC, a.table_name, a.table_id LIMIT 20 OFFSET 20")
def _(lake):
    return _browse(lake, uncategorized=True, sort="latest", page=2)


@R.query("h5_browse_by_score", f"WITH {HEAT} {BROWSE} AND datasource_id = 2 "
                               "ORDER BY score DESC NULLS LAST, a.table_name, a.table_id LIMIT 30 OFFSET 30")
def _(lake):
    return _browse(lake, datasource_id=2, sort="score", page=2, size=30)


@R.query("h5_browse_hot_with_tag", f"""WITH {HEAT} {BROWSE} AND health_level = 'BAD' AND a.table_id IN (SELECT table_id FROM
  asset_table_tag b JOIN asset_tag t ON t.tag_id = b.tag_id WHERE tag_name LIKE '%1')
ORDER BY COALESCE(view_count, 0) DESC, a.table_name, a.table_id LIMIT 20""")
def _(lake):
    tagged = lake("asset_table_tag").join(lake("asset_tag").filter("tag_name LIKE '%1'"), "tag_id", "left_semi")
    return _browse(lake, sort="hot", health_level="BAD", tagged=tagged)


@R.query("h5_browse_total_under_grants", """SELECT COUNT(*) AS total FROM asset WHERE source_status = 'ONLINE'
  AND datasource_id = 2 AND table_id % 3 = 0""")
def _(lake):
    return total(ops.browsed(lake("asset"), lake("asset_score"), datasource_id=2, granted=lake("asset").filter("table_id % 3 = 0")))


@R.query("h6_classification_counts", """
WITH o AS (SELECT NULLIF(trim(data_domain), '') AS domain, NULLIF(trim(data_topic), '') AS topic FROM asset
  WHERE source_status = 'ONLINE')
SELECT 'ALL' AS kind, NULL AS domain, NULL AS topic, COUNT(*) AS tables FROM o
UNION ALL SELECT 'UNCATEGORIZED', NULL, NULL, COUNT(*) FROM o WHERE domain IS NULL
UNION ALL SELECT 'DOMAIN', domain, NULL, COUNT(*) FROM o WHERE domain IS NOT NULL GROUP BY domain
UNION ALL SELECT 'TOPIC', domain, topic, COUNT(*) FROM o WHERE domain IS NOT NULL AND topic IS NOT NULL GROUP BY domain, topic""")
def _(lake):
    return ops.classification_counts(lake("asset"))


@R.query("h7_table_listing", """
SELECT a.table_id, datasource_id, database_name, schema_name, table_name, (SELECT COUNT(*) FROM asset_column c
  WHERE c.table_id = a.table_id AND c.source_status = 'ONLINE') AS column_count, last_collect_time FROM asset a
LEFT JOIN asset_collection l ON l.table_id = a.table_id WHERE a.source_status = 'ONLINE'""")
def _(lake):
    return ops.table_listing(lake("asset"), lake("asset_column"), lake("asset_collection"))


@R.query("h8_tag_cloud", """
SELECT t.tag_id, tag_name, COUNT(b.table_id) AS references FROM asset_tag t LEFT JOIN asset_table_tag b ON b.tag_id = t.tag_id
GROUP BY ALL""".replace("AS references", 'AS "references"'))
def _(lake):
    return ops.tag_cloud(lake("asset_tag"), lake("asset_table_tag"))


@R.query("h9_tags_by_table", """
SELECT table_id, string_agg(DISTINCT tag_name, ',' ORDER BY tag_name) AS tags FROM asset_table_tag b
JOIN asset_tag t ON t.tag_id = b.tag_id GROUP BY table_id""")
def _(lake):
    return shown(ops.tags_by_table(lake("asset_tag"), lake("asset_table_tag")))


@R.query("h10_orphan_tags", """
SELECT tag_id, tag_name FROM asset_tag WHERE tag_id NOT IN (SELECT tag_id FROM asset_table_tag)""")
def _(lake):
    return ops.orphan_tags(lake("asset_tag"), lake("asset_table_tag"))


@R.query("h11_daily_view_counts", "SELECT table_id, CAST(view_date AS VARCHAR) AS view_date, view_count FROM asset_view")
def _(lake):
    return shown(ops.view_counts(lake("asset_view_event")))


@R.query("h12_heat", f"WITH {HEAT} SELECT * FROM heat")
def _(lake):
    return ops.heat(lake("asset_view"), EVENT_CLOCK)


@R.query("h13_hot_tables", f"""
WITH {HEAT} SELECT h.table_id, view_count, table_name FROM heat h JOIN asset a ON a.table_id = h.table_id
  AND source_status = 'ONLINE' ORDER BY view_count DESC, h.table_id LIMIT 80""")
def _(lake):
    return ops.hot_tables(lake("asset_view"), lake("asset"), EVENT_CLOCK, 80)


@R.query("h14_asset_totals", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE source_status = 'ONLINE') AS online, COUNT(*) FILTER (WHERE
  updated_at BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00') AS new_7d FROM asset""")
def _(lake):
    return ops.asset_totals(lake("asset"), EVENT_CLOCK)


@R.query("h15_datasources", """
SELECT datasource_id, ARG_MAX(source_type, CASE source_type WHEN 'BUILTIN' THEN 3 WHEN 'EXTERNAL' THEN 2 ELSE 1 END) AS source_type,
  COUNT(*) AS tables FROM asset WHERE source_status = 'ONLINE' GROUP BY datasource_id""")
def _(lake):
    return ops.datasources(lake("asset"))


@R.query("h16_followed_changes", """
WITH newest AS (SELECT DISTINCT ON (database_name, COALESCE(schema_name, ''), table_name) database_name,
  COALESCE(schema_name, '') AS schema_name, table_name, change_type, created_at FROM collect_change
  ORDER BY database_name, COALESCE(schema_name, ''), table_name, id DESC)
SELECT t.database_name, COALESCE(t.schema_name, '') AS schema_name, t.table_name, f.table_id, followed_at, change_type,
  created_at AS changed_at FROM follow f JOIN followable t ON t.table_id = f.table_id LEFT JOIN newest n ON
  n.database_name = t.database_name AND n.schema_name = COALESCE(t.schema_name, '') AND n.table_name = t.table_name
WHERE f.user_id = 7""")
def _(lake):
    return ops.followed_changes(lake("follow"), lake("followable"), lake("collect_change"), 7)


@R.query("h17_where_used", """
SELECT ref_id, ref_name, 'COLLECT' AS ref_type FROM collect_task WHERE datasource_id = 3
UNION ALL SELECT ref_id, ref_name, 'QUALITY_RULE' FROM source_rule WHERE datasource_id = 3
UNION ALL SELECT ref_id, ref_name, 'SYNC' FROM source_sync WHERE datasource_id = 3""")
def _(lake):
    return ops.where_used(3, lake("collect_task"), lake("source_rule"), lake("source_sync"))
