"""Sentiment that follows the words around a scored word: negations, boosters, modifiers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions.arrays import let
from postlens.functions.token_table import TokenTable, annotate_tokens
from postlens.operators.sentiment import COMPOUND_LIMIT, NORMALISER, Scores

WORD = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)*"
WORD_OR_MARK = WORD + "|!"

# Fixed values of the published valence rules: words that strengthen or weaken, by how much,
# words that turn a meaning round, and the factors of the rules.
BOOST = 0.293
STRENGTHEN = tuple(
    """
    absolutely amazingly awfully completely considerably decidedly deeply enormously entirely
    especially exceptionally extremely fabulously flipping flippin frickin frigging friggin
    fully greatly hella highly hugely incredibly intensely majorly more most particularly
    purely quite really remarkably so substantially thoroughly totally tremendously uber
    unbelievably unusually utterly very
    """.split()
)
WEAKEN = tuple(
    """
    almost barely hardly kinda kindof less little marginally occasionally partly scarcely
    slightly somewhat sorta sortof
    """.split()
)
NEGATIONS = tuple(
    """
    aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt
    mustnt neednt neither never none nope nor not nothing nowhere oughtnt shant shouldnt
    wasnt werent without wont wouldnt rarely seldom despite
    """.split()
)
NEGATED_PART = "n't"
NEGATION = -0.74
CAPITALS = 0.733
DECAY = (1.0, 0.95, 0.9)
AFTER_NEVER = ("so", "this")
NEVER_SO = (None, 1.5, 1.25)
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MOST_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96

# Fixed values of the published polarity rules.
NEGATED_POLARITY = -0.5
MARK = 1.25
KEEPS_MODIFIER, KEEPS_NEGATION = 2, 1


@dataclass(frozen=True)
class ValenceRules:
    """The words that the rules know. ``contrast`` shifts the weight to what follows it."""

    boosters: Mapping[str, float] = field(
        default_factory=lambda: dict.fromkeys(STRENGTHEN, BOOST) | dict.fromkeys(WEAKEN, -BOOST)
    )
    negations: Iterable[str] = NEGATIONS
    contrast: str = "but"


def _sign(value: Column) -> Column:
    return F.when(value > 0, 1.0).otherwise(-1.0)


def _told(df: DataFrame, text_col: str, lexicon: Scores, rules: ValenceRules, bounds: dict) -> DataFrame:
    """``_words``: what the rules need of each word, in text order."""
    C.require_columns(df, text_col)
    table = TokenTable.of(lexicon, "double", **bounds)
    boosters = TokenTable.of({w: float(b) for w, b in rules.boosters.items()}, "double").lookup()
    negations = list(rules.negations)
    raw = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    df = annotate_tokens(df, F.transform(raw, F.lower), table, "_hits", keep_misses=True)

    def told(hit: Column, words: Column) -> Column:
        word, own = hit["token"], F.get(words, hit["pos"])
        return F.struct(
            word.alias("word"),
            hit["value"].alias("value"),
            boosters(word).alias("boost"),
            (word.isin(negations) | F.contains(word, F.lit(NEGATED_PART))).alias("negates"),
            ((own == F.upper(own)) & (own != word)).alias("capital"),
        )

    words = let(F.struct(raw.alias("raw"), F.col("_hits").alias("hits")), lambda s: F.transform(
        s["hits"], lambda h: told(h, s["raw"])
    ))
    return df.withColumn("_words", words).drop("_hits")


def _word_valence(words: Column, i: Column, mixed: Column) -> Column:
    """The valence of word ``i`` after capitals and the three words before it."""
    word = F.get(words, i)
    capital = lambda w, v: F.when(w["capital"] & mixed, CAPITALS * _sign(v)).otherwise(0.0)

    def before(valence: Column, d: int) -> Column:
        near = F.get(words, i - d)
        counts = (i >= d) & near["value"].isNull()

        def boosted(v: Column) -> Column:
            boost = near["boost"] * _sign(v) + capital(near, v)
            return F.when(counts & near["boost"].isNotNull(), v + boost * DECAY[d - 1]).otherwise(v)

        def negated(v: Column) -> Column:
            out = F.when(counts & near["negates"], v * NEGATION).otherwise(v)
            if NEVER_SO[d - 1] is None:
                return out
            between = [F.get(words, i - e)["word"].isin(*AFTER_NEVER) for e in range(1, d)]
            so = between[0] if d == 2 else between[0] | between[1]
            return F.when(counts & (near["word"] == "never") & so, v * NEVER_SO[d - 1]).otherwise(out)

        return let(let(valence, boosted), negated)

    def least(valence: Column) -> Column:
        one, two = F.get(words, i - 1), F.get(words, i - 2)
        told = (i >= 1) & one["value"].isNull() & (one["word"] == "least")
        kept = (i >= 2) & two["word"].isin("at", "very")
        return F.when(told & ~kept, valence * NEGATION).otherwise(valence)

    valence = word["value"] + capital(word, word["value"])
    for d in (1, 2, 3):
        valence = before(valence, d)
    scored = word["value"].isNotNull() & word["boost"].isNull()
    return F.when(scored, let(valence, least)).otherwise(0.0)


def _emphasis(text: Column) -> Column:
    """What exclamation and question marks add to the strength of a text."""
    marks = lambda m: F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))
    calls = F.least(marks("!"), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION
    asks = marks("?")
    asked = F.when(asks > MOST_QUESTIONS, MANY_QUESTIONS).when(asks > 1, asks * QUESTION).otherwise(0.0)
    return calls + asked


def valence_sentiment(
    df: DataFrame,
    text_col: str,
    lexicon: Scores,
    rules: ValenceRules | None = None,
    out: str = "valence_sentiment",
    score_col: str | None = None,
    **bounds: int,
) -> DataFrame:
    """Valence of a text by the published rules: its label, and in ``score_col`` its score.

    A scored word gains by capitals in a text of mixed case; up to three unscored words before it
    strengthen, weaken (less so from afar) or negate it. Before the first ``contrast`` word
    valence counts half, after it half as much again; exclamation and question marks add to
    the sum ``s``, which is scaled to ``s / sqrt(s^2 + 15)``. Positive from 0.05, negative from
    -0.05. Idioms and emoticons are not known. Null text has a null label and score; of a
    word that repeats in ``lexicon`` the smallest score counts. No shuffle with a constant table.
    """
    rules = rules or ValenceRules()
    told = _told(df, text_col, lexicon, rules, bounds)

    def summed(words: Column) -> Column:
        capitals = F.exists(words, lambda w: w["capital"]) & F.exists(words, lambda w: ~w["capital"])
        turn = F.array_position(F.transform(words, lambda w: w["word"]), rules.contrast) - 1

        def with_context(context: Column) -> Column:
            held, at = context["words"], context["turn"]
            share = lambda i: F.when(at < 0, 1.0).when(i < at, BEFORE_CONTRAST).when(
                i > at, AFTER_CONTRAST
            ).otherwise(1.0)
            valence = F.transform(
                held, lambda w, i: _word_valence(held, i, context["mixed"]) * share(i)
            )
            return F.aggregate(valence, F.lit(0.0), lambda total, v: total + v)

        return let(
            F.struct(words.alias("words"), capitals.alias("mixed"), turn.alias("turn")), with_context
        )

    told = told.withColumn("_s", summed(F.col("_words"))).drop("_words")
    emphasis = _emphasis(F.col(text_col))
    total = F.when(F.col("_s") > 0, F.col("_s") + emphasis).when(F.col("_s") < 0, F.col("_s") - emphasis)
    told = told.withColumn("_s", F.coalesce(total, F.lit(0.0)))
    compound = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + NORMALISER)
    told = told.withColumn("_score", F.when(F.col(text_col).isNotNull(), compound))
    label = (
        F.when(F.col("_score") >= COMPOUND_LIMIT, "positive")
        .when(F.col("_score") <= -COMPOUND_LIMIT, "negative")
        .when(F.col("_score").isNotNull(), "neutral")
    )
    told = told.withColumn(out, label)
    if score_col:
        told = told.withColumn(score_col, F.col("_score"))
    return told.drop("_s", "_score")


_CHAIN = "struct<factor:double,negated:boolean,total:double,n:int,last:double>"


def modified_polarity(
    df: DataFrame,
    text_col: str,
    lexicon: Scores,
    modifiers: Mapping[str, float],
    negations: Iterable[str] = NEGATIONS,
    out: str = "modified_polarity",
    score_col: str | None = None,
    **bounds: int,
) -> DataFrame:
    """Mean polarity of the scored words after the chains of words before them.

    Modifiers multiply the next scored word, several of them one another; a negation turns it round
    at half strength. Words of up to two letters do not end a chain of modifiers, words of
    one letter no negation; longer unknown words do. A product is held within -1 and 1, and
    an exclamation mark strengthens the word before it. A word that is no scored word only
    because it modifies or negates still does. The sign of the mean is the label; no
    scored word is neutral, null text null. One pass over the words of each row.
    """
    C.require_columns(df, text_col)
    table = TokenTable.of(lexicon, "double", **bounds)
    factors = TokenTable.of({w: float(f) for w, f in modifiers.items()}, "double").lookup()
    negations = list(negations)
    tokens = F.regexp_extract_all(F.lower(text_col), F.lit(WORD_OR_MARK), F.lit(0))
    told = annotate_tokens(df, tokens, table, "_hits", keep_misses=True)
    within = lambda p: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p))
    none = F.lit(None).cast("double")

    def state(factor, negated, total, n, last) -> Column:
        return F.struct(
            factor.cast("double").alias("factor"), negated.alias("negated"),
            total.alias("total"), n.cast("int").alias("n"), last.alias("last"),
        )

    def follow(acc: Column, hit: Column) -> Column:
        word, value = hit["token"], hit["value"]
        factor = factors(word)
        negates = word.isin(negations) | F.contains(word, F.lit(NEGATED_PART))
        own = within(value * F.coalesce(acc["factor"], F.lit(1.0)))
        own = F.when(acc["negated"], own * NEGATED_POLARITY).otherwise(own)
        stronger = within(acc["last"] * MARK)
        kept = F.when(F.length(word) <= KEEPS_MODIFIER, acc["factor"])
        still = acc["negated"] & (F.length(word) <= KEEPS_NEGATION)
        total, n, last = acc["total"], acc["n"], acc["last"]
        return (
            F.when(
                word == "!",
                state(acc["factor"], acc["negated"], total + F.when(n > 0, stronger - last).otherwise(0.0), n, stronger),
            )
            .when(factor.isNotNull(), state(F.coalesce(acc["factor"], F.lit(1.0)) * factor, acc["negated"], total, n, last))
            .when(negates, state(acc["factor"], F.lit(True), total, n, last))
            .when(value.isNotNull(), state(none, F.lit(False), total + own, n + 1, own))
            .otherwise(state(kept, still, total, n, last))
            .cast(_CHAIN)
        )

    start = state(none, F.lit(False), F.lit(0.0), F.lit(0), F.lit(0.0)).cast(_CHAIN)
    mean = F.aggregate("_hits", start, follow, lambda a: F.when(a["n"] > 0, a["total"] / a["n"]).otherwise(0.0))
    told = told.withColumn("_score", F.when(F.col(text_col).isNotNull(), mean)).drop("_hits")
    label = (
        F.when(F.col("_score") > 0, "positive")
        .when(F.col("_score") < 0, "negative")
        .when(F.col("_score").isNotNull(), "neutral")
    )
    told = told.withColumn(out, label)
    if score_col:
        told = told.withColumn(score_col, F.col("_score"))
    return told.drop("_score")
