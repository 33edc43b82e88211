"""The whole analysis: posts in, labelled posts and the topic/location report out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions.text import ENGLISH_STOP_WORDS
from postlens.functions.token_table import ROW_ID, TokenTable, with_row_id
from postlens.operators import classify, glossary, keywords, places, rollup, text_prep, topics
from postlens.sources.readers import read_posts
from postlens.sources.staging import stage, staging_path
from postlens.sources.writers import write_result, write_rollup


@dataclass
class Lookups:
    """The tables an analysis needs besides the posts.

    ``mapping`` has one row per keyword (``word, mapping``; see ``dedupe_mapping``),
    ``gazetteer`` is the city table, ``glossary`` has ``term, definition``, ``lexicon``
    the plain words of the glossary step. ``nouns`` and ``noun_exceptions`` drive the
    lemmas. Tables left out switch their step off.
    """

    mapping: DataFrame
    gazetteer: DataFrame | TokenTable
    glossary: DataFrame | None = None
    lexicon: DataFrame | None = None
    nouns: DataFrame | Iterable[str] | None = None
    noun_exceptions: DataFrame | Mapping[str, str] | None = None
    places: DataFrame | Iterable[str] | None = None
    place_predictor: Callable | None = None
    stop_words: Iterable[str] = field(default=ENGLISH_STOP_WORDS)


def enrich_posts(posts: DataFrame, lookups: Lookups, max_rows: int | None = None) -> DataFrame:
    """Every step that looks at one post at a time: text, glossary, keywords, place, region.

    With lookup tables within the constant bound this is one projection over the scan, for
    batch and streaming tables alike. Larger tables are joined, in batch tables; ``max_rows``
    lowers the bound. Number the posts first then (``with_row_id``), else each such step does.
    """
    bounds = {} if max_rows is None else {"max_rows": max_rows}
    keys = {} if max_rows is None else {"max_keys": max_rows}
    df = text_prep.prepare_text(
        posts, C.TEXT, lookups.stop_words, lookups.noun_exceptions, lookups.nouns, max_rows=max_rows
    )
    if max_rows is not None:
        df = stage(df, "prepared")  # the joins below read it again and again
    if lookups.glossary is not None and lookups.lexicon is not None:
        df = glossary.map_glossary(
            df, C.LEMMATIZED_TEXT, lookups.glossary, lookups.lexicon, **bounds
        )
    df = keywords.map_conditions(df, C.CLEANED_TEXT, lookups.mapping, **keys)
    df = places.final_location(
        df, C.LEMMATIZED_TEXT, lookups.gazetteer, lookups.places, lookups.place_predictor, **bounds
    )
    return places.with_region(df)


def score_posts(
    enriched: DataFrame,
    topic_model: topics.TopicModel | None,
    classifier: PipelineModel | Callable,
    id_col: str | None = None,
) -> DataFrame:
    """Add topic columns, classifier input and temperature class.

    Row-local with a topic model within the bound; a larger one is joined by ``id_col``.
    """
    df = topics.assign_topics(enriched, topic_model, id_col=id_col)
    return classify.predict_temperature(rollup.with_combined_text(df), classifier)


def analyze_posts(
    posts: DataFrame,
    lookups: Lookups,
    classifier: PipelineModel | Callable,
    id_col: str | None = None,
    topic_model: topics.TopicModel | None = None,
    fit: bool = True,
    result_path: str | None = None,
    **topic_options,
) -> tuple[DataFrame, DataFrame]:
    """Return ``(result, rollup)``.

    The enriched posts are written once into the staging folder: the topic fit reads them
    several times, and a lost executor then costs a re-read instead of the whole text work.
    ``result_path`` writes the result as parquet and lets the rollup read its six columns
    back from there; without it both stay lazy.

    Pass ``id_col``, a unique column of the posts, where there is one. Otherwise row numbers
    are made and written down first. ``topic_model`` reuses a fitted model; ``fit=False``
    without one leaves the topic columns null.
    """
    C.require_columns(posts, C.TEXT, C.ACCOUNT)
    key = id_col or ROW_ID
    if id_col is None:
        posts = with_row_id(posts)
    enriched = enrich_posts(posts, lookups)
    if topic_model is None and fit:
        enriched = stage(enriched, "enriched")
        topic_model = topics.fit_topics(enriched, key, **topic_options)
    result = score_posts(enriched, topic_model, classifier, key)
    if id_col is None:
        result = result.drop(ROW_ID)
    if result_path is not None:
        write_result(result, result_path, "parquet")
        result = result.sparkSession.read.parquet(result_path)
    return result, rollup.rollup_posts(result)


def run_analysis(
    spark: SparkSession,
    posts_path: str,
    lookups: Lookups,
    classifier: PipelineModel | Callable,
    result_path: str,
    rollup_path: str,
    fmt: str = "csv",
    posts_fmt: str = "csv",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """From posts on disk to the two output tables on disk; returns both as DataFrames."""
    posts = read_posts(spark, posts_path, posts_fmt)
    written = result_path if fmt == "parquet" else staging_path(spark, "result")
    result, report = analyze_posts(posts, lookups, classifier, result_path=written, **options)
    if fmt != "parquet":
        write_result(result, result_path, fmt)
    write_rollup(report, rollup_path, fmt)
    return result, report
