"""The words of a corpus with dense numbers, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions import text as T
from postlens.functions.arrays import token_counts
from postlens.sources.staging import stage

_IN_PARTITION = (1 << 33) - 1


def vocabulary_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``token, df, tf``: posts with the token, and its occurrences."""
    C.require_columns(df, text_col)
    bag = df.select(F.inline(token_counts(T.words(F.col(text_col)))))
    return bag.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def number_words(terms: DataFrame, partitions: int | None = None) -> DataFrame:
    """``terms`` with ``index``: 0, 1, ... by falling ``tf``, ties by spelling; a written table.

    Words are sorted over ranges, one range for a task; a word's number is its place in its range
    plus the size of the ranges before. Only these sizes, one for each range, reach the driver.
    The numbers do not depend on the ranges. ``terms(token, tf, ...)`` has a token once.
    """
    spark = terms.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("tf"), F.asc("token")]
    place = F.monotonically_increasing_id()
    ranges = terms.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    ranges = ranges.withColumns(
        {"_range": F.spark_partition_id(), "_place": place.bitwiseAND(F.lit(_IN_PARTITION))}
    )
    ranges = stage(ranges, "ranges")
    sizes = {r["_range"]: r["count"] for r in ranges.groupBy("_range").count().collect()}
    before, starts = 0, []
    for i in range(partitions):
        starts.append(F.lit(before).cast("long"))
        before += sizes.get(i, 0)
    start = F.get(F.array(*starts), F.col("_range"))
    kept = [c for c in terms.columns if c != "index"]
    return ranges.select((start + F.col("_place")).alias("index"), *kept)
