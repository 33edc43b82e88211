"""Text preparation: clean, tokenise, drop stop words, lemmatise."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions import text as T
from postlens.functions.lemma import best_candidate, has_noun_suffix, lemma_candidates
from postlens.functions.token_table import TokenTable, annotate_tokens, word_frame
from postlens.sources.staging import stage

Exceptions = DataFrame | Mapping[str, str] | None
Lexicon = DataFrame | Iterable[str] | None


def _exceptions_frame(df: DataFrame, exceptions: Exceptions) -> DataFrame:
    if not isinstance(exceptions, DataFrame):
        pairs = exceptions or {}
        return word_frame(df.sparkSession, word=pairs.keys(), lemma=pairs.values())
    word, lemma = exceptions.columns[:2]
    return exceptions.select(F.col(word).alias("word"), F.col(lemma).alias("lemma"))


def _lexicon_frame(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    if not isinstance(lexicon, DataFrame):
        return word_frame(df.sparkSession, word=dict.fromkeys(lexicon or ()))
    return lexicon.select(F.col(lexicon.columns[0]).alias("word"))


def resolve_exceptions(exceptions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One lemma per exception word: the shortest of the word and its lemmas in the lexicon.

    A word none of whose forms is in the lexicon stays as it is.
    """
    forms = exceptions.select("word", F.explode(F.array("word", "lemma")).alias("form"))
    known = lexicon.select(F.col("word").alias("form"), F.lit(True).alias("known"))
    rank = F.struct(F.length("form"), F.col("form") != F.col("word"), F.col("form").alias("form"))
    best = F.min(F.when(F.col("known"), rank))["form"]
    return (
        forms.join(known, "form", "left")
        .groupBy("word")
        .agg(F.coalesce(best, F.col("word")).alias("lemma"))
    )


def lemmatize(
    df: DataFrame,
    tokens_col: str,
    exceptions: Exceptions = None,
    lexicon: Lexicon = None,
    out: str = "lemmas",
    max_rows: int | None = None,
) -> DataFrame:
    """Noun lemma of every token. Without a known form a token stays unchanged.

    Both tables within the constant bound: a projection. Otherwise the lemmas of the distinct
    tokens are worked out; those that change a token are a table of their own, mostly small enough
    for a constant, else joined.
    """
    C.require_columns(df, tokens_col)
    lexicon = _lexicon_frame(df, lexicon)
    bounds = {} if max_rows is None else {"max_rows": max_rows}
    lexicon_table = TokenTable.of(lexicon, **bounds)
    if lexicon_table.is_constant:
        lexicon = word_frame(df.sparkSession, word=lexicon_table.pairs)
    resolved = resolve_exceptions(_exceptions_frame(df, exceptions), lexicon)
    exception_table = TokenTable.of(resolved, **bounds)

    if lexicon_table.is_constant and exception_table.is_constant:
        in_lexicon, exception = lexicon_table.lookup(), exception_table.lookup()

        def lemma(token: Column) -> Column:
            known = F.filter(
                lemma_candidates(token), lambda c: in_lexicon(c["form"]).isNotNull()
            )
            by_rule = F.when(has_noun_suffix(token), best_candidate(known))
            return F.coalesce(exception(token), by_rule, token)

        return df.withColumn(out, F.transform(F.col(tokens_col), lemma))

    vocabulary = df.select(
        F.explode(F.array_distinct(F.filter(F.col(tokens_col), has_noun_suffix))).alias("word")
    ).distinct()
    by_rule = (
        vocabulary.join(resolved, "word", "left_anti")
        .select("word", F.posexplode(lemma_candidates(F.col("word"))).alias("i", "c"))
        .select("word", "i", "c.level", "c.form")
        .join(lexicon.select(F.col("word").alias("form")), "form", "left_semi")
        .groupBy("word")
        .agg(F.min_by("form", F.struct("level", F.length("form"), "i")).alias("lemma"))
    )
    changed = resolved.unionByName(by_rule).where(F.col("word") != F.col("lemma"))
    table = TokenTable.of(stage(changed, "changed-words"), **bounds)
    if table.is_constant:
        change = table.lookup()
        return df.withColumn(
            out, F.transform(F.col(tokens_col), lambda t: F.coalesce(change(t), t))
        )
    annotated = annotate_tokens(df, F.col(tokens_col), table, "_hits", keep_misses=True)
    lemmas = F.transform("_hits", lambda h: F.coalesce(h["value"], h["token"]))
    return annotated.withColumn(out, F.when(F.col(tokens_col).isNotNull(), lemmas)).drop("_hits")


def prepare_text(
    df: DataFrame,
    text_col: str = C.TEXT,
    stop_words: Iterable[str] = T.ENGLISH_STOP_WORDS,
    exceptions: Exceptions = None,
    lexicon: Lexicon = None,
    contractions: bool = True,
    max_rows: int | None = None,
) -> DataFrame:
    """Add ``cleaned_text`` and ``lemmatized_text``; null text gives null in both."""
    C.require_columns(df, text_col)
    cleaned = df.withColumn(C.CLEANED_TEXT, T.clean_text(F.col(text_col)))
    tokens = T.remove_stopwords(T.tokenize(F.col(C.CLEANED_TEXT), contractions), stop_words)
    cleaned = cleaned.withColumn("_tokens", tokens)
    if lexicon is None and exceptions is None:
        lemmas = cleaned.withColumn("_lemmas", F.col("_tokens"))
    else:
        lemmas = lemmatize(cleaned, "_tokens", exceptions, lexicon, "_lemmas", max_rows)
    return lemmas.withColumn(C.LEMMATIZED_TEXT, F.array_join("_lemmas", " ")).drop(
        "_tokens", "_lemmas"
    )
