"""Queries against their SQL, and the pipeline's stages against plain loops."""

import os
import sys

import pytest
from sentencepiece import SentencePieceProcessor

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as contract  # noqa: E402
import corpus_pipeline  # noqa: E402
from brightwell.llm.queries import PIECE_BPE, QUERIES, SQL  # noqa: E402
from llm.test_decontaminate import brute as brute_hits  # noqa: E402
from llm.test_exact_dedup import brute as brute_equals  # noqa: E402
from llm.test_simhash import slow_components  # noqa: E402
from oracle_check import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql(spark, name):
    verdict, rows = compare(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL.get(name))
    assert verdict in ("ok", "rows only") and rows > 0, verdict


def test_registration():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]


def extended(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    more = [(90_000, None, None, None, None, 1), (90_001, "", "en", "s", 0, 1), (None, "No id here at all, but words.", "en", "s", 1, 1),
            (90_002, "Before. " + item + " After.", "en", "s", 1, 1), (90_003, "word " * 30_000, "en", "s", 1, 1)]
    from pyspark.sql import functions as F

    own = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    copies = docs.limit(30).withColumn("doc_id", F.col("doc_id") + 70_000)
    return docs.union(copies).withColumn("kept", F.lit(1)).union(own)


def test_stages_against_plain_loops(spark, folder):
    docs = extended(spark)
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    columns = docs.columns
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        out.append((texts(docs), spark.read.parquet(f"{folder}/{k}")))
        docs = out[-1][1]
        assert k == 4 or docs.columns == columns, name
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)
    before, after = out[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r[0] for r in texts(after)}
    judged = [(d in kept) == (labels[d] == 1) for d, _ in before if d in labels]
    assert sum(judged) / len(judged) > 0.9
    before, after = out[1]
    assert ids(after) == sorted((r[0] for r in brute_equals(before) if r[3]), key=repr)
    before, after = out[2]
    named = slow_components([(d, t) for d, t in before if d is not None])
    assert {x for x in ids(after) if x is not None} == {d for d, (_, c) in named.items() if c == d}
    before, after = out[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = brute_hits(before, items, 10)
    assert ids(after) == sorted((d for d, _ in before if not hit[d][4]), key=repr) and 90_002 not in ids(after)
    before, after = out[4]
    library = SentencePieceProcessor(model_file=PIECE_BPE)
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in after.collect()}
    assert got == {d: (len(i := library.encode(t or "")), i, library.decode(i)) for d, t in before}


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    rows = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(docs) and docs.count() > 50


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_rows_are_judged_by_themselves(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    other = "A quiet river runs past the old stone mill and on through nine green fields to the grey and distant sea."
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, frame(rows), FOLDER).collect()), key=repr)
    rows = [(None, item), (None, "clean"), (None, "clean"), (5, item), (5, "clean too"), (6, other)]
    assert left(corpus_pipeline.uncontaminated, rows) == sorted([r for r in rows if r[1] != item], key=repr)
    rows = [(None, "same"), (None, "same"), (None, "once"), (None, "held"), (3, "held"), (3, "held"), (3, "own"), (4, "own"), (2, "o wn")]
    assert left(corpus_pipeline.first_of_equals, rows) == sorted(
        [(None, "same"), (None, "once"), (3, "held"), (2, "o wn")], key=repr)
    rows = [(None, other), (None, other), (None, item), (3, item), (3, item.upper()), (3, "Ten short words that have nothing to do with it."),
            (4, "Ten short words that have nothing to do with it.")]
    assert [r[0] for r in left(corpus_pipeline.first_of_similar, rows)] == [3, 3, None]
