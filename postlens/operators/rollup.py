"""Row filters of the rollup and the rollup itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions import text as T
from postlens.functions.labels import TEMP_LABELS, UNKNOWN_TEMP, share_text, temp_category

ALL_LABELS = (*TEMP_LABELS, UNKNOWN_TEMP)


def with_word_count(df: DataFrame, col: str = C.LEMMATIZED_TEXT, out: str = C.WORD_COUNT) -> DataFrame:
    C.require_columns(df, col)
    return df.withColumn(out, T.word_count(F.col(col)))


def filter_min_words(df: DataFrame, col: str = C.LEMMATIZED_TEXT, more_than: int = 3) -> DataFrame:
    """Rows with more than ``more_than`` words; null text drops out."""
    C.require_columns(df, col)
    return df.where(T.word_count(F.col(col)) > more_than)


def with_group_topic(df: DataFrame) -> DataFrame:
    """Keyword tag, else the words of the post's topic."""
    C.require_columns(df, C.WEATHER_TOPICS, C.TOP_3_WORDS)
    return df.withColumn(C.GROUP_TOPIC, F.coalesce(C.WEATHER_TOPICS, C.TOP_3_WORDS))


def with_combined_text(df: DataFrame, null_token: str = "None") -> DataFrame:
    """Classifier input: lemmas, a blank, the conditions; no condition reads ``None``."""
    C.require_columns(df, C.LEMMATIZED_TEXT, C.WEATHER_TEMP)
    condition = F.coalesce(C.WEATHER_TEMP, F.lit(null_token))
    return df.withColumn(C.COMBINED_TEXT, F.concat(C.LEMMATIZED_TEXT, F.lit(" "), condition))


def with_temp_category(
    df: DataFrame, col: str = C.TEMP_SENTIMENT, out: str = C.TEMP_CATEGORY
) -> DataFrame:
    C.require_columns(df, col)
    return df.withColumn(out, temp_category(F.col(col)))


def value_counts(df: DataFrame, keys: list[str], col: str, out: str = "n") -> DataFrame:
    """Counts of each value of ``col`` per group as rows: any number of values, one shuffle."""
    C.require_columns(df, *keys, col)
    return df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias(out))


def value_counts_map(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Counts of each value of ``col`` per group as a map, largest first.

    Counted per (group, value) first, so a hot group is spread over its values and only
    the finished counts of a group meet. A map is one cell: a column with very many values
    belongs in ``value_counts``.
    """
    counts = value_counts(df, keys, col, "_n")
    entry = F.struct((-F.col("_n")).alias("order"), F.col(col).alias("value"))
    entries = F.array_sort(F.collect_list(entry))
    as_map = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["value"], -e["order"])))
    return counts.groupBy(*keys).agg(as_map.alias(out))


def count_percentages(counts: Column) -> Column:
    """Map of counts -> map of ``"n (p%)"`` texts, shares of the map's total."""
    total = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, n: a + n)
    return F.transform_values(counts, lambda _, n: share_text(n, total))


def _grouped(df: DataFrame, approx_accounts: bool) -> DataFrame:
    """One row per (topic, location).

    Rows that do not count (short text, no topic, no location) are left out of the counts
    and their groups dropped afterwards: a filter before the grouping would be pushed below
    the steps that made these columns and run them twice. Partial counts meet per
    (group, account) before they meet per group, so neither a hot group nor a hot account
    lands in one task as rows.
    """
    C.require_columns(
        df, C.LEMMATIZED_TEXT, C.WEATHER_TOPICS, C.TOP_3_WORDS, C.TEMP_SENTIMENT,
        C.FINAL_LOCATION, C.ACCOUNT,
    )
    counts = T.word_count(F.col(C.LEMMATIZED_TEXT)) > 3
    rows = with_temp_category(with_group_topic(df)).select(
        C.GROUP_TOPIC,
        C.FINAL_LOCATION,
        F.when(counts, F.col(C.TEMP_CATEGORY)).alias(C.TEMP_CATEGORY),
        F.when(counts, F.col(C.ACCOUNT)).alias(C.ACCOUNT),
        (counts & F.col(C.GROUP_TOPIC).isNotNull() & F.col(C.FINAL_LOCATION).isNotNull()).alias(
            "_counts"
        ),
    )
    distinct = F.approx_count_distinct if approx_accounts else F.countDistinct
    grouped = rows.groupBy(C.GROUP_TOPIC, C.FINAL_LOCATION).agg(
        F.count(C.ACCOUNT).alias(C.TWEET_COUNT),
        distinct(C.ACCOUNT).alias(C.ACCOUNT_COUNT),
        F.count_if("_counts").alias("row_count"),
        *[F.count_if(F.col(C.TEMP_CATEGORY) == name).alias(name) for name in ALL_LABELS],
    )
    return grouped.where("row_count > 0")


def rollup_posts(df: DataFrame, approx_accounts: bool = False) -> DataFrame:
    """The report: one row per (topic, location), most posts first.

    ``tweet_count`` counts posts with an account, ``account_count`` distinct accounts;
    ``temp_counts`` and ``temp_percentages`` are maps over all posts of the group.
    """
    labelled = F.array(
        *[
            F.struct(F.col(name).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("label"))
            for i, name in enumerate(ALL_LABELS)
        ]
    )
    present = F.filter(F.sort_array(labelled, asc=False), lambda e: e["n"] > 0)
    counts = F.map_from_entries(F.transform(present, lambda e: F.struct(e["label"], e["n"])))
    return (
        _grouped(df, approx_accounts)
        .withColumn(C.TEMP_COUNTS, counts)
        .withColumn(C.TEMP_PERCENTAGES, count_percentages(F.col(C.TEMP_COUNTS)))
        .orderBy(F.desc("row_count"), C.GROUP_TOPIC, C.FINAL_LOCATION)
        .select(
            C.GROUP_TOPIC, C.FINAL_LOCATION, C.TWEET_COUNT, C.ACCOUNT_COUNT, C.TEMP_COUNTS,
            C.TEMP_PERCENTAGES,
        )
    )


def rollup_long(df: DataFrame, approx_accounts: bool = False) -> DataFrame:
    """The same numbers without maps: one row per (topic, location, temperature label)."""
    grouped = _grouped(df, approx_accounts)
    keys = [c for c in grouped.columns if c not in ALL_LABELS]
    return (
        grouped.unpivot(keys, list(ALL_LABELS), C.TEMP_CATEGORY, "temp_count")
        .where("temp_count > 0")
        .withColumn("temp_percentage", share_text(F.col("temp_count"), F.col("row_count")))
    )
