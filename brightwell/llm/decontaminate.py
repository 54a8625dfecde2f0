"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index holds one posting (term, doc_id, position) for every occurrence of a benchmark term in the training texts, and
an end posting for each document at its number of words. A window is looked up from its rarest terms: postings of the
rarest give candidates, the list of the second rarest is intersected with them after its offset is taken off, and the
few that are left are intersected with the postings of all other terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brightwell.llm.shared import ascii_lower, written

#: Words of a lower-cased text; capitals are taken along because lower-casing comes after the cut.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: The term number of end postings.
END = 0
#: Terms and document ids that are broadcast at most; larger sides are joined by a shuffle.
BROADCAST_TERMS, BROADCAST_DOCUMENTS = 1_000_000, 1_000_000


def words(text) -> F.Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words) of every item that has words."""
    split = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words"))
    return split.select("item_id", F.transform("words", ascii_lower).alias("words")).filter(F.size("words") > 0)


def vocabulary(items: DataFrame) -> DataFrame:
    """(word, term) for the distinct words of ``item_words``; terms are numbers from 1, fixed by writing them out."""
    distinct = items.select(F.explode("words").alias("word")).distinct()
    return written(distinct.withColumn("term", F.monotonically_increasing_id() + 1), "vocabulary")


def build_index(df: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, position) for every occurrence of a term, and (0, doc_id, number of words) for every row."""
    spread = df.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("words")).select(
        "doc_id", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("position", "raw"))
    spread = spread.select("doc_id", "position", ascii_lower(F.col("raw")).alias("word"))
    known = terms.select("word", "term").unionByName(
        terms.sparkSession.createDataFrame([("", END)], "word string, term long"))
    side = F.broadcast(known) if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else known
    return written(spread.join(side, "word").select("term", "doc_id", "position"), "postings")


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(item_id, words): every run of ``length`` words of an item, a shorter item as a whole."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - length + 1))
    return items.select("item_id", "words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("words", F.col("at"), F.lit(length)).alias("words"))


def phrase_matches(index: DataFrame, terms: DataFrame, runs: DataFrame) -> DataFrame:
    """(words, doc_id, start, size): every place where all words of a run stand one after another.

    ``runs`` holds (item_id, words), all of them in ``terms``. Equal runs of several items are searched once.
    """
    distinct = runs.select("words").distinct().withColumn("run", F.monotonically_increasing_id())
    distinct = written(distinct, "runs").withColumn("size", F.size("words"))
    placed = distinct.select("run", "size", F.posexplode("words").alias("offset", "word"))
    placed = written(placed.join(terms, "word").drop("word"), "placed")
    frequency = index.filter(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = placed.join(frequency, "term", "left")
    # Per run its terms from the rarest on; a run with a term that no document holds is nowhere.
    ranked = counted.groupBy("run", "size").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("t"))
    ranked = written(ranked.filter(F.col("t")[0]["n"] > 0), "ranked")
    rarest = ranked.select("run", "size", F.col("t")[0]["term"].alias("term"), F.col("t")[0]["offset"].alias("offset"))
    second = ranked.filter("size > 1").select("run", F.col("t")[1]["term"].alias("next_term"),
                                              F.col("t")[1]["offset"].alias("next_offset"))
    found = index.join(rarest, "term").select(
        "run", "size", "doc_id", (F.col("position") - F.col("offset")).alias("start")).filter("start >= 0")
    alone = found.filter("size = 1")
    asked = found.filter("size > 1").join(second, "run").select(
        "run", "size", F.col("doc_id").alias("asked_id"), "start", F.col("next_term").alias("asked_term"),
        (F.col("start") + F.col("next_offset")).alias("asked_position"))
    lists = index.join(second.select(F.col("next_term").alias("term")).distinct(), "term", "left_semi")
    # Rows that repeat within a document give one candidate: the probes below are counted against the run's size.
    both = written(asked.join(lists, F.col("asked_id").eqNullSafe(F.col("doc_id")) & (F.col("asked_term") == F.col("term"))
                              & (F.col("asked_position") == F.col("position")), "left_semi").select(
        "run", "size", F.col("asked_id").alias("doc_id"), "start").distinct(), "candidates")
    # The other terms: probes of all candidates, each once, against the postings of the documents concerned.
    probes = both.join(placed.select("run", "offset", "term"), "run").select(
        "run", "size", F.col("doc_id").alias("asked_id"), "start", F.col("term").alias("asked_term"),
        (F.col("start") + F.col("offset")).alias("asked_position"))
    wanted = probes.select("asked_id", "asked_term", "asked_position").distinct()
    concerned = both.select(F.col("doc_id").alias("some_id")).distinct()
    if concerned.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS:
        concerned = F.broadcast(concerned)  # the index then stays where it lies; beyond the bound it is shuffled
    postings = index.join(concerned, F.col("doc_id").eqNullSafe(F.col("some_id")), "left_semi")
    hit = postings.join(wanted, F.col("asked_id").eqNullSafe(F.col("doc_id")) & (F.col("asked_term") == F.col("term"))
                        & (F.col("asked_position") == F.col("position")), "left_semi").distinct()
    whole = probes.join(hit, F.col("asked_id").eqNullSafe(F.col("doc_id")) & (F.col("asked_term") == F.col("term"))
                        & (F.col("asked_position") == F.col("position")))
    full = whole.groupBy("run", "size", F.col("asked_id").alias("doc_id"), "start").agg(
        F.count(F.lit(1)).alias("n")).filter("n = size").drop("n")
    result = full.unionByName(alone.select("run", "size", "doc_id", "start").distinct())
    return result.join(distinct.select("run", "words"), "run").select("words", "doc_id", "start", "size")


def proximity_matches(index: DataFrame, terms: DataFrame, runs: DataFrame, within: int) -> DataFrame:
    """(words, doc_id, start): places where a run's rarest term stands with each other term at most ``within`` words away.

    ``runs`` holds (item_id, words), all of them in ``terms``; order and repetition of words do not matter.
    """
    distinct = written(runs.select("words").distinct().withColumn("run", F.monotonically_increasing_id()), "runs")
    single = distinct.select("run", F.explode(F.array_distinct("words")).alias("word")).join(terms, "word").drop("word")
    frequency = index.filter(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = single.join(frequency, "term", "left").select("run", "term", F.coalesce("n", F.lit(0)).alias("n"))
    anchor = counted.groupBy("run").agg(F.min(F.struct("n", "term")).alias("a"), F.count(F.lit(1)).alias("size"))
    anchor = anchor.select("run", "size", F.col("a")["term"].alias("anchor"))
    found = index.join(anchor, F.col("term") == F.col("anchor")).select(
        "run", "size", F.col("doc_id").alias("at_id"), F.col("position").alias("start"))
    others = single.join(anchor.select("run", "anchor"), "run").filter("term <> anchor").select("run", "term")
    near = found.join(others, "run").withColumn("near", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("start") - within), F.col("start") + within)))
    hits = near.alias("a").join(index.alias("b"), F.col("a.at_id").eqNullSafe(F.col("b.doc_id"))
                                & (F.col("a.term") == F.col("b.term")) & (F.col("a.near") == F.col("b.position")))
    enough = hits.groupBy("a.run", "a.at_id", "a.start").agg(F.countDistinct("a.term").alias("n"))
    several = enough.join(anchor.select("run", "size"), "run").filter("n = size - 1").select("run", "at_id", "start")
    result = several.unionByName(found.filter("size = 1").select("run", "at_id", "start"))
    return result.join(distinct, "run").select("words", F.col("at_id").alias("doc_id"), "start")


def contamination(df: DataFrame, items: DataFrame, length: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) for every document.

    A word is hit if it lies in an occurrence of a window; ``items`` lists the items with occurring windows, sorted as
    text. Null and empty texts have no words and are clean, as is everything when no item has words. Each row is searched by
    itself: where rows share an id or lack one, all rows are written with a number first. They are then reported as one
    document for each id, as long as the longest and hit where any of them is; so are the rows without an id.
    """
    split = written(item_words(items, item_col, item_text_col), "items")
    terms = vocabulary(split)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    numbers = None
    if known.ids < known.rows:
        numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        numbers = numbered.select(F.col("row").alias("own_row"), F.col("doc_id").alias("owner"))
        rows = numbered.select(F.col("row").alias("doc_id"), "text")

    def of_owners(found: DataFrame) -> DataFrame:
        if numbers is None:
            return found
        return found.join(numbers, F.col("doc_id") == F.col("own_row")).withColumn("doc_id", F.col("owner")).drop("own_row", "owner")

    index = build_index(rows, terms)
    runs = windows(split, length)
    matches = written(of_owners(phrase_matches(index, terms, runs)), "matches")
    hits = (matches.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at"))
            .distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit")))
    owners = runs.select("words", F.col("item_id").cast("string").alias("item")).distinct()
    named = (matches.select("doc_id", "words").distinct().join(owners, "words").groupBy("doc_id")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    found = hits.join(named, hits["doc_id"].eqNullSafe(named["doc_id"])).select(
        hits["doc_id"].alias("found_id"), "n_hit", "items")
    ends = of_owners(index.filter(F.col("term") == END)).groupBy("doc_id").agg(F.max("position").alias("n_words"))
    return ends.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
