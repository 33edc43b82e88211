"""Where a post is about: country lookup, place names, region."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions import text as T
from postlens.functions.labels import UNKNOWN_LOCATION, region_of
from postlens.functions.token_table import (
    ROW_ID,
    TokenTable,
    annotate_tokens,
    with_row_id,
    word_frame,
)
from postlens.sources.staging import stage

# Which gazetteer column answers first when several know the same word.
COUNTRY_FIRST = ("country", "iso2", "iso3", "city")
CITY_FIRST = ("city", "iso2", "iso3", "country")

# Place names known without any table.
ALWAYS_PLACES = ("iceland",)


def gazetteer_tokens(
    gazetteer: DataFrame, priority: tuple[str, ...] = COUNTRY_FIRST
) -> DataFrame:
    """One row per known word: ``token, country``.

    The first column of ``priority`` wins; within one column the last row (``row_no``)
    wins. Names of several words are left out: the lookup is word by word.
    """
    C.require_columns(gazetteer, "row_no", "country", *priority)
    entries = gazetteer.select(
        "row_no",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(rank).alias("rank"),
                        F.lower(F.col(name)).alias("token"),
                        F.lower(F.col("country")).alias("country"),
                    )
                    for rank, name in enumerate(priority)
                ]
            )
        ),
    ).where(F.col("token").rlike("^" + T.NON_BLANKS + "$") & F.col("country").isNotNull())
    first = F.struct(F.col("rank"), -F.col("row_no"))
    return entries.groupBy("token").agg(F.min_by("country", first).alias("country"))


def map_country(
    df: DataFrame,
    text_col: str,
    gazetteer: DataFrame | TokenTable,
    out: str = "country",
    priority: tuple[str, ...] = COUNTRY_FIRST,
    **bounds: int,
) -> DataFrame:
    """Country of the first known word in text order, else ``Unknown``.

    ``gazetteer`` is the city table, or an already reduced ``TokenTable``.
    """
    C.require_columns(df, text_col)
    if isinstance(gazetteer, DataFrame):
        gazetteer = TokenTable.of(gazetteer_tokens(gazetteer, priority), **bounds)
    first = F.coalesce(F.get(F.col("_hits"), F.lit(0))["value"], F.lit(UNKNOWN_LOCATION))
    words = T.words(F.lower(text_col))
    if gazetteer.is_constant:
        annotated = annotate_tokens(df, words, gazetteer, "_hits")
        return annotated.withColumn(out, first).drop("_hits")
    # the words alone are read several times and pass through the lookup, not the whole rows
    rows = with_row_id(df)
    words = stage(rows.select(ROW_ID, words.alias("_words")), "words")
    hits = annotate_tokens(words, F.col("_words"), gazetteer, "_hits", drop=("_words",))
    found = stage(hits.select(F.col(ROW_ID).alias("_country_id"), first.alias(out)), "countries")
    rows = rows.drop(out)
    joined = rows.join(found, rows[ROW_ID] == F.col("_country_id"), "left").drop("_country_id")
    return joined if ROW_ID in df.columns else joined.drop(ROW_ID)


def _place_tables(df: DataFrame, places: DataFrame | Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """``first, lengths`` and ``name, n``: which lengths names with a first word have, and the names.

    A row per first word holds lengths, never names: however many names start with
    one word, it is as long as the longest name. Both are counted up from partial sums.
    """
    if not isinstance(places, DataFrame):
        places = word_frame(df.sparkSession, name=places)
    names = places.select(F.lower(F.col(places.columns[0])).alias("name")).unionByName(
        word_frame(df.sparkSession, name=ALWAYS_PLACES)
    )
    words = names.select(T.words(F.col("name")).alias("w")).where(F.size("w") > 0)
    shapes = words.select(F.col("w")[0].alias("first"), F.size("w").alias("n")).distinct()
    lengths = shapes.groupBy("first").agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    return lengths, words.select(F.array_join("w", " ").alias("name"), F.size("w").alias("n"))


def extract_places(
    df: DataFrame,
    text_col: str,
    places: DataFrame | Iterable[str] | None = None,
    predictor: Callable[[], Callable[[pd.Series], pd.Series]] | None = None,
    out: str = "places",
    only_where: Column | None = None,
    **bounds: int,
) -> DataFrame:
    """All place names of a text, in order, joined by ``", "``; null without one.

    Names may have any number of words: from left to right the longest known name is
    taken and its words are used up. A word that starts names is looked up for their lengths, the
    stretches of such lengths for the names themselves; each table is a constant or joined. ``predictor`` replaces the table with a model: a
    factory, called once per task, of a function from a batch of texts to place strings.
    ``only_where`` restricts the work to the rows that need it.
    """
    C.require_columns(df, text_col)
    text = F.col(text_col) if only_where is None else F.when(only_where, F.col(text_col))
    if predictor is not None:
        return df.withColumn(out, F.nullif(_text_model(predictor)(text), F.lit("")))

    lengths, names = _place_tables(df, places or ())
    lengths = TokenTable.of(lengths, "array<int>", **bounds)
    names = TokenTable.of(names, "int", **bounds)
    found = "_places_found"
    if lengths.is_constant and names.is_constant:
        named = _named(df.withColumn("_words", T.words(F.lower(text))), lengths, names, found)
        return named.withColumn(out, F.col(found)).drop(found)
    rows = with_row_id(df)
    words = stage(rows.select(ROW_ID, T.words(F.lower(text)).alias("_words")), "words")
    named = _named(words, lengths, names, found).select(F.col(ROW_ID).alias("_places_id"), found)
    joined = rows.join(named, rows[ROW_ID] == F.col("_places_id"), "left").drop("_places_id")
    joined = joined.withColumn(out, F.col(found)).drop(found)
    return joined if ROW_ID in df.columns else joined.drop(ROW_ID)


def _named(df: DataFrame, lengths: TokenTable, names: TokenTable, out: str) -> DataFrame:
    """``df`` with the names in its ``_words``, which are dropped."""
    df = annotate_tokens(df, F.col("_words"), lengths, "_firsts")
    df = df.withColumn("_spans", _spans(F.col("_words"), F.col("_firsts"))).drop("_firsts", "_words")
    if not names.is_constant:
        df = stage(df, "spans")
    df = annotate_tokens(df, F.transform("_spans", lambda s: s["name"]), names, "_names")
    # by position, the longest first: later ones at a position lie within it
    found = F.array_sort(
        F.transform(
            "_names",
            lambda h: F.struct(
                F.get("_spans", h["pos"])["pos"].alias("pos"),
                (-h["value"]).alias("less"),
                h["token"].alias("name"),
            ),
        )
    )

    def take(acc: Column, hit: Column) -> Column:
        taken = F.struct(
            (hit["pos"] - hit["less"]).alias("next"),
            F.concat(acc["names"], F.array(hit["name"])).alias("names"),
        )
        return F.when(hit["pos"] >= acc["next"], taken).otherwise(acc)

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("names"))
    joined = F.aggregate(found, start, take, lambda a: F.array_join(a["names"], ", "))
    return df.withColumn(out, F.nullif(joined, F.lit(""))).drop("_spans", "_names")


def _spans(words: Column, firsts: Column) -> Column:
    """The stretches of words that may be names: ``pos, name``, by their first words' lengths."""

    def at(hit: Column) -> Column:
        fitting = F.filter(hit["value"], lambda n: hit["pos"] + n <= F.size(words))
        return F.transform(
            fitting,
            lambda n: F.struct(
                hit["pos"].alias("pos"),
                F.array_join(F.slice(words, hit["pos"] + 1, n), " ").alias("name"),
            ),
        )

    return F.flatten(F.transform(firsts, at))


def _text_model(predictor: Callable[[], Callable[[pd.Series], pd.Series]]):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = predictor()
        for texts in batches:
            result = pd.Series([None] * len(texts), index=texts.index, dtype="object")
            asked = texts.notna()
            if asked.any():
                result[asked] = list(model(texts[asked]))
            yield result

    return run


def final_location(
    df: DataFrame,
    text_col: str,
    gazetteer: DataFrame | TokenTable,
    places: DataFrame | Iterable[str] | None = None,
    predictor: Callable | None = None,
    priority: tuple[str, ...] = COUNTRY_FIRST,
    **bounds: int,
) -> DataFrame:
    """Add ``final_location``: the country, else the place names, else ``Unknown``."""
    df = map_country(df, text_col, gazetteer, "_country", priority, **bounds)
    unknown = F.col("_country") == UNKNOWN_LOCATION
    df = extract_places(
        df, text_col, places, predictor, "_places", only_where=unknown, **bounds
    )
    location = F.when(unknown, F.coalesce("_places", F.lit(UNKNOWN_LOCATION))).otherwise(
        F.col("_country")
    )
    return df.withColumn(C.FINAL_LOCATION, location).drop("_country", "_places")


def with_region(df: DataFrame, location_col: str = C.FINAL_LOCATION, out: str = C.REGION) -> DataFrame:
    """Add the region (``EU``, ``US``, ``Unknown``, ``Other``) of a location column."""
    C.require_columns(df, location_col)
    return df.withColumn(out, region_of(F.col(location_col)))
