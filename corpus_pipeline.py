"""A training corpus from raw documents: quality filter, exact and near deduplication, decontamination, token ids."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import brightwell
from brightwell.llm import decontaminate, exact_dedup, piece_bpe, quality, simhash
from brightwell.llm.queries import NEAR_BITS, NEAR_SHINGLE, PIECE_BPE, QUALITY_FROM, remainder
from brightwell.llm.shared import read_table, written

# Functions shipped to tasks travel with their code, so executors need no copy of this folder.
cloudpickle.register_pickle_by_value(brightwell)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels outside its held-out fold, does not reject."""
    forest = quality.fit(docs, read_table(spark, sf_dir, "labels"), "quality", remainder(5) != 0)
    return quality.keep_scored(docs, forest, QUALITY_FROM)


#: The number of a row in a stage's written input; ids may be missing or shared, so stages judge rows by it.
ROW = "__row"
#: Numbers of dropped rows that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def numbered(docs: DataFrame, stage: str) -> DataFrame:
    """``docs`` with a number of its own for each row, fixed by writing them out."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), f"rows-{stage}")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose number is not among ``dropped``, a column of numbers; all columns but the number stay as they are."""
    numbers = written(dropped.toDF("__dropped"), "dropped")
    if numbers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        numbers = F.broadcast(numbers)  # the texts then stay where they lie; beyond the bound they are shuffled
    return rows.join(numbers, F.col(ROW) == F.col("__dropped"), "left_anti").drop(ROW)


def first_of_each(rows: DataFrame, groups: DataFrame, *order: Column) -> DataFrame:
    """Of each group of ``groups`` (row, group) the first row by ``order``, then by id with null last, then any one."""
    place = F.struct(*order, F.col("doc_id").isNull().alias("__no_id"), F.col("doc_id").alias("__id"), F.col(ROW))
    placed = rows.select(F.col(ROW).alias("__at"), place.alias("__place"))
    members = written(groups.toDF("__member", "__group"), "members")
    first = members.join(placed, F.col("__member") == F.col("__at")).groupBy("__group").agg(
        F.min("__place").alias("__place")).select(F.col("__place")[ROW].alias("__first"))
    return without(rows, members.select("__member").join(first, F.col("__member") == F.col("__first"), "left_anti"))


def first_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one that the exact dedup keeps; of rows that repeat id and text, one."""
    rows = numbered(docs, "equals")
    found = exact_dedup.exact_duplicates(rows, ROW)
    longest = -F.char_length(F.coalesce("text", F.lit("")))
    return first_of_each(rows, found.select("doc_id", "keep_id"), longest.alias("__longest"))


def first_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id."""
    rows = numbered(docs, "similar")
    found = simhash.near_duplicates(rows, NEAR_SHINGLE, NEAR_BITS, ROW)
    return first_of_each(rows, found.select("doc_id", "component_id"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    rows = numbered(docs, "clean")
    found = decontaminate.contamination(rows, read_table(spark, sf_dir, "benchmark"), id_col=ROW)
    return without(rows, found.filter("contaminated").select("doc_id"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) by the SentencePiece operator."""
    return piece_bpe.round_trip(docs, PIECE_BPE).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("text").alias("decoded"))


STAGES = [("quality classifier", good_documents), ("exact dedup", first_of_equals), ("simhash near-dedup", first_of_similar),
          ("benchmark decontamination", uncontaminated), ("sentencepiece", token_ids)]

#: Trees, fingerprints and vocabulary pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage is written out and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
