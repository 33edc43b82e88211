"""Sentiment from word-score tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions import text as T
from postlens.functions.token_table import TokenTable, annotate_tokens

# Thresholds and the normaliser of the valence score.
COMPOUND_LIMIT = 0.05
NORMALISER = 15.0

Scores = DataFrame | Mapping[str, float] | TokenTable


def _scored(
    df: DataFrame, text_col: str, lexicon: Scores, bounds: dict
) -> DataFrame:
    C.require_columns(df, text_col)
    table = TokenTable.of(lexicon, "double", **bounds)
    tokens = F.regexp_extract_all(F.lower(text_col), F.lit(T.WORD), F.lit(0))
    return annotate_tokens(df, tokens, table, "_hits")


def _sum(hits: str) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda total, h: total + h["value"])


def lexicon_sentiment(
    df: DataFrame,
    text_col: str,
    lexicon: Scores,
    out: str = "lexicon_sentiment",
    score_col: str | None = None,
    **bounds: int,
) -> DataFrame:
    """Valence sum ``s`` scaled to ``s / sqrt(s^2 + 15)``: positive from 0.05, negative from -0.05.

    Null text has a null label. ``score_col`` keeps the scaled score. Of a word that repeats in
    ``lexicon`` the smallest score counts.
    """
    scored = _scored(df, text_col, lexicon, bounds).withColumn("_s", _sum("_hits"))
    compound = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + NORMALISER)
    scored = scored.withColumn("_score", F.when(F.col(text_col).isNotNull(), compound))
    label = (
        F.when(F.col("_score") >= COMPOUND_LIMIT, "positive")
        .when(F.col("_score") <= -COMPOUND_LIMIT, "negative")
        .when(F.col("_score").isNotNull(), "neutral")
    )
    return _finish(scored, label, out, score_col)


def polarity_sentiment(
    df: DataFrame,
    text_col: str,
    lexicon: Scores,
    out: str = "polarity_sentiment",
    score_col: str | None = None,
    **bounds: int,
) -> DataFrame:
    """Mean polarity of the known words: its sign is the label; no known word is neutral."""
    scored = _scored(df, text_col, lexicon, bounds)
    mean = F.coalesce(_sum("_hits") / F.nullif(F.size("_hits"), F.lit(0)), F.lit(0.0))
    scored = scored.withColumn("_score", F.when(F.col(text_col).isNotNull(), mean))
    label = (
        F.when(F.col("_score") > 0, "positive")
        .when(F.col("_score") < 0, "negative")
        .when(F.col("_score").isNotNull(), "neutral")
    )
    return _finish(scored, label, out, score_col)


def _finish(scored: DataFrame, label: Column, out: str, score_col: str | None) -> DataFrame:
    scored = scored.withColumn(out, label)
    if score_col:
        scored = scored.withColumn(score_col, F.col("_score"))
    return scored.drop("_hits", "_s", "_score")


def compare_sentiment(
    df: DataFrame, text_col: str, scorers: Mapping[str, Callable[[DataFrame, str, str], DataFrame]]
) -> DataFrame:
    """One label column per scorer: ``{column: scorer(df, text_col, column) -> df}``."""
    C.require_columns(df, text_col)
    for name, scorer in scorers.items():
        df = scorer(df, text_col, name)
    return df
