"""Substring search by trigrams.

The index is a table of (gram, place, id) in order of gram: every three neighbouring characters of a lower-cased text, the
last two filled up, so a keyword of any length is found: a short one as the beginning of trigrams. A gram is a number, its
three code points of 21 bits side by side, so it sorts as its characters do. The condition on grams reaches the scan, which
by the files' statistics reads only the parts that hold them. What the index names is a candidate; the text itself decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SIZE, BITS = 3, 21
#: Fills up the last grams; no text is expected to hold it.
FILL = "\x00"
#: Rows of a batch on its way out of a task; one longer text makes a batch of its own.
BATCH_ROWS = 200_000
BATCH_BYTES = 8 << 20


def _number(characters: str) -> int:
    return reduce(lambda number, c: number << BITS | ord(c), characters, 0)


def grams_of(text: str) -> np.ndarray:
    """The distinct grams that start at each character of the text, as numbers in ascending order."""
    points = np.frombuffer((text + FILL * (SIZE - 1)).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("int64")
    return np.unique(points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, id, text) to (place, id, gram)."""
    for batch in batches:
        held, grams, size = [], [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.array(np.repeat(held, [len(g) for g in grams]))
            return pa.RecordBatch.from_arrays([batch.column("place").take(rows), batch.column("id").take(rows),
                                               pa.array(np.concatenate(grams))], names=["place", "id", "gram"])

        for row, text in enumerate(batch.column("text")):
            found = grams_of(text.as_py())
            if size and size + len(found) > BATCH_ROWS:
                yield flush()
                held, grams, size = [], [], 0
            held.append(row)
            grams.append(found)
            size += len(found)
        if size:
            yield flush()


def build(texts: DataFrame, path: str) -> None:
    """Indexes (place, id, text); several texts of one place and id are one."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    schema = T.StructType([texts.schema["place"], texts.schema["id"], T.StructField("gram", T.LongType())])
    lowered = texts.filter(F.char_length("text") > 0).select("place", "id", F.lower("text").alias("text"))
    rows = lowered.mapInArrow(_exploded, schema)
    # Equal rows meet in one part of the range, so those of several texts are dropped where they lie.
    rows.repartitionByRange("gram", "place", "id").distinct().sortWithinPartitions("gram", "place", "id").write.parquet(path)


def candidates(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """(place, id) whose texts may hold the keyword: all of its trigrams occur in them."""
    word = keyword.lower()
    rows = spark.read.parquet(path)
    if len(word) < SIZE:
        first, free = _number(word), BITS * (SIZE - len(word))
        return rows.filter(F.col("gram").between(first << free, (first + 1 << free) - 1)).select("place", "id").distinct()
    grams = sorted({_number(word[k:k + SIZE]) for k in range(len(word) - SIZE + 1)})
    found = rows.filter(F.col("gram").isin(grams)).groupBy("place", "id").agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") == len(grams)).select("place", "id")
