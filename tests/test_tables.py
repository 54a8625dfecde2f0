"""Parameterised reads, synchronisation, previews, grants and retention."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brightwell.operators import call_log, catalog, policy, retention, runs, table_query as tq
from brightwell.operators.table_query import QuerySpec
from brightwell.sources import jdbc, preview, sync

PRODUCTS = [(i, "phone" if i <= 6 else "computer" if i <= 8 else "earphone", 100.0 * i) for i in range(1, 11)]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(PRODUCTS, "id bigint, category string, price double")


SPEC = QuerySpec([("category", "EQ"), ("price", "RANGE"), ("id", "EQ")], order_by="price DESC", paginated=True,
                 page_size_max=4, tie_break=("id",))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_filters_order_and_pages(products):
    assert ids(tq.table_query(products, SPEC, {"category": "phone"})) == [6, 5, 4, 3]
    assert ids(tq.table_query(products, SPEC, {"category": "phone"}, page=2, size=99)) == [2, 1]
    assert ids(tq.table_query(products, SPEC, {"min_price": "900"}, page=-3, size=0)) == [10]
    assert ids(tq.table_query(products, SPEC, {"max_price": "250.5", "category": "  "})) == [2, 1]
    assert tq.table_count(products, SPEC, {"category": "phone"}).first()["total"] == 6


def test_parameters_of_the_wrong_shape_match_nothing(products):
    assert ids(tq.table_query(products, SPEC, {"id": "abc"})) == []
    assert ids(tq.table_query(products, SPEC, {"id": "1.5"})) == []
    assert ids(tq.table_query(products, SPEC, {"category": "x' OR '1'='1"})) == []


@pytest.mark.parametrize("spec", [QuerySpec([("nope", "EQ")]), QuerySpec([("id", "LIKE")]), QuerySpec(fields=["id; DROP"]),
                                  QuerySpec(order_by="id DESC, price"), QuerySpec(page_size_max=1001),
                                  QuerySpec([("id", "EQ")] * 21)])
def test_bad_definitions_are_refused(products, spec):
    with pytest.raises(ValueError):
        tq.table_query(products, spec)


def test_filters_and_columns_reach_the_scan(spark, products, folder):
    products.write.parquet(f"{folder}/p")
    spec = QuerySpec([("price", "RANGE")], ["id"])
    df = tq.table_query(spark.read.parquet(f"{folder}/p"), spec, {"min_price": "300"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(price,300.0)" in plan and "ReadSchema: struct<id:bigint,price:double>" in plan


def test_parameter_precedence():
    got = tq.resolve_parameters(datetime(2024, 3, 1, 5), {"biz_date": "x", "a": "1", "b": " "}, {"a": 2, "current_time": "now"})
    assert got == {"biz_date": "2024-02-29", "current_time": "now", "a": 2}
    assert tq.replace_placeholders("${a} ${b} '${c}'", {"a": 1, "c": "it's"}) == "1 ${b} 'it''s'"


def test_incremental_sync(spark, products):
    stored = products.filter("id <= 7")
    assert ids(sync.sync_incremental(products, stored, "id", True)) == [8, 9, 10]
    for target, done, field in ((stored, False, "id"), (None, True, "id"), (stored.limit(0), True, "id"),
                                (stored, True, "category")):
        assert sync.sync_incremental(products, target, field, done).count() == 10
    mixed = stored.withColumn("id", F.col("id").cast("string"))
    assert sync.sync_incremental(products, mixed, "id", True).count() == 10
    assert sync.target_name("my-table", "shop.db") == "sync_shop_db_my_table"


def test_sync_of_many(spark, products, folder):
    def boom():
        raise ValueError("no source")

    jobs = [sync.SyncJob("good", lambda: products, lambda df: df.write.parquet(f"{folder}/good"), mapping=[("id", "k")]),
            sync.SyncJob("bad", boom, lambda df: None)]
    results = sync.sync_many(spark, jobs)
    got = {r["table_name"]: (r["status"], r["rows_read"], r["rows_written"], r["error"]) for r in results.collect()}
    assert got == {"good": ("SUCCESS", 10, 10, None), "bad": ("FAILED", None, None, "no source")}
    assert spark.read.parquet(f"{folder}/good").columns == ["k"]
    assert sync.overall_status(results).first()["status"] == "FAILED"


def test_truncation_flag(products):
    assert {r["truncated"] for r in preview.truncated(products, 10).collect()} == {False}
    cut = preview.truncated(products, 3, [F.desc("id")]).collect()
    assert [r["id"] for r in cut] == [10, 9, 8] and all(r["truncated"] for r in cut)


def test_csv_export(spark, folder):
    rows = [(1, 'say "hi", now', None), (2, "two\nlines", "x")]
    preview.export_csv(spark.createDataFrame(rows, "id int, a string, b string").coalesce(1), f"{folder}/csv")
    text = "".join(r["value"] for r in spark.read.text(f"{folder}/csv", wholetext=True).collect())
    assert text == 'id,a,b\n1,"say ""hi"", now",\n2,"two\nlines",x\n'


def test_jdbc_addresses_and_names():
    post = jdbc.Connection("postgresql", "h", 5432, "shop", schema="sales")
    assert post.address() == "jdbc:postgresql://h:5432/shop?currentSchema=sales"
    assert post.qualified('a"b') == '"sales"."a""b"'
    assert jdbc.Connection("mysql", "h", 1, "d").qualified("t") == "`d`.`t`"
    assert jdbc.Connection("sqlserver", "h", 1, "d").qualified("t]") == "[dbo].[t]]]"
    with pytest.raises(ValueError):
        jdbc.Connection("redis", "h", 1, "d").address()


def test_grants(spark):
    fields = "datasource_id bigint, database_name string, table_name string"
    tables = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "src0", "x"), (2, "src1", "src1_en_7"), (2, "src1", "z"), (3, "q", "x")], fields)
    grants = spark.createDataFrame([(1, None, None), (2, "src0", None), (2, "src1", "src1_en_7"), (1, "a", "x")], fields)
    got = {(r[0], r[1], r[2]) for r in policy.apply_grants(tables, grants).collect()}
    assert got == {(1, "a", "x"), (1, "b", "y"), (2, "src0", "x"), (2, "src1", "src1_en_7")}
    assert policy.apply_grants(tables, grants).count() == 4
    assert policy.apply_grants(tables, grants.limit(0)).count() == 0
    assert policy.apply_grants(tables, None).count() == 6


def test_keywords():
    assert catalog.clean_keyword("  %_ ") is None and catalog.clean_keyword(None) is None
    assert catalog.clean_keyword(" a%") == "a%" and catalog.clean_keyword("x" * 300) == "x" * 300


def test_overall_health_of_nothing(spark):
    grades = spark.createDataFrame([], "grade string")
    assert call_log.overall_health(grades).first()["score"] == 100


def test_no_window_spans_a_whole_queue(spark, folder):
    rows = [(i, i % 3, i % 5, datetime(2024, 1, 1)) for i in range(50)]
    spark.createDataFrame(rows, "id bigint, queue_id int, priority int, start_time timestamp_ntz").write.parquet(f"{folder}/w")
    waiting = spark.read.parquet(f"{folder}/w")
    queues = spark.createDataFrame([(0, 5), (1, None), (2, 0)], "queue_id int, capacity int")
    admitted = runs.admit(waiting, waiting.limit(0), queues)
    plan = admitted._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "row_number()" in line and "windowspecdefinition(queue_id#" in line
            and "part#" not in line] == []
    assert {r["queue_id"]: r["count"] for r in admitted.groupBy("queue_id").count().collect()} == {0: 5, 1: 10}


def test_expired_partitions_are_dropped(spark):
    rows = [(1, "2024-01-01"), (2, "2024-01-20"), (3, "2024-01-31")]
    spark.createDataFrame(rows, "id int, day string").write.mode("overwrite").partitionBy("day").saveAsTable("kept_log")
    assert retention.drop_expired_partitions(spark, "kept_log", "day", 15, "2024-01-31") == ["2024-01-01"]
    assert sorted(r["id"] for r in spark.table("kept_log").collect()) == [2, 3]
    assert retention.retain(spark.table("kept_log").withColumn("d", F.col("day").cast("date")), "d", 0, "2024-01-31").count() == 1
    spark.sql("DROP TABLE kept_log")


@pytest.mark.parametrize("limit", ["1000", "3"])
def test_top_rows_per_key_with_and_without_salting(spark, limit):
    from brightwell.plans.topk import top_per_key

    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", limit)
    try:
        got = {(r["k"], r["position"]): r["id"] for r in top_per_key(rows, ["k"], [F.desc("id")], "id", 20).collect()}
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)
    expected = {}
    for k in range(7):
        mine = sorted((i for i in range(500) if (0 if i % 3 == 0 else i % 7) == k), reverse=True)[:20]
        expected |= {(k, n): i for n, i in enumerate(mine, 1)}
    assert got == expected


def test_any_error_of_a_job_is_its_own_result(spark, folder):
    def broken():
        raise KeyError("gone")

    jobs = [sync.SyncJob("a", broken, lambda df: None), sync.SyncJob("b", lambda: spark.range(3), lambda df: df.write.parquet(f"{folder}/b"))]
    got = {r["table_name"]: (r["status"], r["rows_read"]) for r in sync.sync_many(spark, jobs).collect()}
    assert got == {"a": ("FAILED", None), "b": ("SUCCESS", 3)}


def test_nested_partitions_expire_by_day(spark):
    spark.sql("DROP TABLE IF EXISTS nested_log")
    spark.range(4).selectExpr("id", "concat('2024-01-0', 1 + id % 2) AS day", "cast(id AS string) AS hour").write.partitionBy(
        "day", "hour").saveAsTable("nested_log")
    assert retention.drop_expired_partitions(spark, "nested_log", "day", 1, "2024-01-03") == ["2024-01-01"]
    assert sorted(r["id"] for r in spark.table("nested_log").collect()) == [1, 3]


def test_admission_of_a_queue_that_holds_everything(spark):
    rows = [(k, 1 if k % 10 else 2, k % 3, k * 7 % 1000) for k in range(3000)]
    waiting = spark.createDataFrame(rows, "id bigint, queue_id bigint, priority int, start_time bigint")
    queues = spark.createDataFrame([(1, 2000), (2, 5), (3, 9)], "queue_id bigint, capacity int")
    admitted = runs.admit(waiting, waiting.limit(0), queues)
    got = [(r["id"], r["position"]) for r in admitted.collect()]
    want = []
    for queue, most in ((1, 2000), (2, 5)):
        own = sorted((-p, t, k) for k, q, p, t in rows if q == queue)[:most]
        want += [(k, n) for n, (_, _, k) in enumerate(own, 1)]
    assert sorted(got) == sorted(want)


def test_pages_behind_a_row_equal_pages_by_number(spark):
    import itertools
    import random

    from brightwell.plans.seek import page_of

    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, n int, t string").repartition(4)
    for first, second in itertools.product([True, False], repeat=2):
        order = [("n", first), ("t", second), ("id", False)]
        whole, after = [], None
        for number in range(1, 10):
            page = page_of(df, order, 7, after=after).collect()
            assert page == page_of(df, order, 7, page=number).collect()
            whole += page
            if not page:
                break
            after = page[-1].asDict()
        assert sorted(r.id for r in whole) == list(range(60))


def test_a_page_behind_a_row_reaches_the_scan(spark, folder):
    from brightwell.plans.seek import page_of

    spark.range(1000).write.parquet(f"{folder}/t")
    page = page_of(spark.read.parquet(f"{folder}/t"), [("id", False)], 5, after={"id": 900})
    plan = page._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,900)" in plan and [r.id for r in page.collect()] == [901, 902, 903, 904, 905]


def test_search_by_index_equals_the_scan(spark, folder):
    import random

    from brightwell.operators import catalog

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abAB_% é\U0001F600") for _ in range(rng.randint(0, n)))
    tables = spark.createDataFrame([(k, text(6), 1, "d", text(20) if k % 3 else None, rng.randrange(5), rng.choice(["ONLINE", "OFFLINE"]))
                                    for k in range(120)], "table_id long, table_name string, datasource_id int, database_name string, "
                                   "table_comment string, owner_user_id long, source_status string")
    columns = spark.createDataFrame([(rng.randrange(120), text(5), text(9), rng.choice(["ONLINE", "OFFLINE"])) for _ in range(200)],
                                    "table_id long, column_name string, column_comment string, source_status string")
    tags = spark.createDataFrame([(k, text(4)) for k in range(20)], "tag_id long, tag_name string")
    table_tags = spark.createDataFrame([(rng.randrange(120), rng.randrange(20)) for _ in range(60)], "table_id long, tag_id long")
    owners = spark.createDataFrame([(k, text(4)) for k in range(5)], "user_id long, user_name string")
    catalog.search_index(f"{folder}/grams", tables, columns, tags, owners)
    for word in ("a", "B", "ab", "é", "_%", "aba", "ABAB", "b a", "\U0001F600", "ab\U0001F600a", "zzz", "abababababab"):
        frames = tables, columns, tags, table_tags, owners, word
        scan = sorted(map(tuple, catalog.search(*frames).collect()))
        assert sorted(map(tuple, catalog.search(*frames, index=f"{folder}/grams").collect())) == scan, word


def test_a_long_text_is_indexed_in_one_scan(spark, folder):
    from brightwell.operators import text_index

    df = spark.createDataFrame([("t", 1, "é" + "word " * 100_000 + "needle")], "place string, id long, text string")
    text_index.build(df, f"{folder}/g")
    assert text_index.candidates(spark, f"{folder}/g", "Needle").count() == 1
    assert text_index.candidates(spark, f"{folder}/g", "le").count() == 1
    assert text_index.candidates(spark, f"{folder}/g", "needles").count() == 0


def test_grams_are_numbers_in_order_of_their_characters(spark, folder):
    from brightwell.operators import text_index

    texts = [("t", 1, "abcab"), ("t", 1, "xabc"), ("t", 2, "AB"), ("c", 1, "ab\U0001F600"), ("c", 2, ""), ("c", 3, None)]
    text_index.build(spark.createDataFrame(texts, "place string, id long, text string"), f"{folder}/g")
    rows = spark.read.parquet(f"{folder}/g")
    characters = lambda g: "".join(chr(g >> k & 0x1FFFFF) for k in (42, 21, 0)).rstrip("\0")
    got = sorted((r.place, r.id, characters(r.gram)) for r in rows.collect())
    assert got == sorted([("t", 1, g) for g in ("abc", "bca", "cab", "ab", "b", "xab", "bc", "c")]
                         + [("t", 2, "ab"), ("t", 2, "b"), ("c", 1, "ab\U0001F600"), ("c", 1, "b\U0001F600"), ("c", 1, "\U0001F600")])
    assert rows.schema["gram"].dataType.simpleString() == "bigint"
    named = lambda word: sorted(map(tuple, text_index.candidates(spark, f"{folder}/g", word).collect()))
    assert named("ab") == [("c", 1), ("t", 1), ("t", 2)] and named("B\U0001F600") == [("c", 1)]
    assert named("abca") == [("t", 1)] and named("\U0001F600") == [("c", 1)] and named("abd") == []


def test_long_texts_leave_a_task_in_bounded_batches():
    import pyarrow as pa

    from brightwell.operators import text_index

    texts = ["".join(chr(97 + k) + chr(0x4E00 + j % 20_000) for j in range(20_000)) for k in range(8)]
    batch = pa.RecordBatch.from_pydict({"place": ["t"] * 8, "id": [*range(7), None], "text": texts})
    out = list(text_index._exploded(iter([batch])))
    assert len(out) > 1 and all(b.num_rows <= max(text_index.BATCH_ROWS, len(text_index.grams_of(texts[0]))) for b in out)
    assert sum(b.num_rows for b in out) == sum(len(text_index.grams_of(t)) for t in texts)


def test_histograms_merge_to_the_same_statistics(spark):
    import random
    from datetime import datetime, timedelta

    from brightwell.operators import call_log

    rng = random.Random(9)
    rows = [(k, rng.randrange(3), rng.choice([200, 201, 404, 429, 500]), rng.choice([None, *range(40)]),
             datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(6000))) for k in range(800)]
    log = spark.createDataFrame(rows, "id long, api_id int, status_code int, duration_ms int, created_at timestamp_ntz")
    hours = call_log.latency_histograms(log)
    days = call_log.latency_histograms(hours, "day")
    for rolled, since in ((hours, "2024-01-02 05:00:00"), (days, "2024-01-02 00:00:00"), (days, "2025-01-01 00:00:00")):
        for one in (None, 1):
            assert call_log.call_overview(rolled, since, one, "2024-01-03 12:00:00").collect() == \
                call_log.call_overview(log, since, one, "2024-01-03 12:00:00").collect()
        by_api = lambda df: sorted(map(tuple, call_log.call_stats_by_api(df, since).collect()))
        assert by_api(rolled) == by_api(log)
    assert hours.count() < 800
