"""The registered queries: every operator over the whole given tables.

Lookup tables are derived from the ``benchmark`` and ``conversations`` tables, so they hold
words that occur in ``documents`` and grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions import text as T
from postlens.functions.labels import (
    CLIMATE_SENTIMENT_LABELS,
    TWITTER_SENTIMENT_LABELS,
    share_text,
)
from postlens.functions.token_table import TokenTable, word_frame
from postlens.operators import (
    classify,
    epochs,
    glossary,
    keywords,
    places,
    rollup,
    selection,
    sentiment,
    text_prep,
    tfidf,
    tone,
    topics,
)
from postlens.plans.analyze import Lookups, analyze_posts
from postlens.plans.topic_chain import fill_by_topics
from postlens.plans.train import train_and_evaluate
from postlens.sources import readers, writers
from postlens.sources.staging import stage, staging_path
from postlens.streaming.enrich import (
    read_post_stream,
    start_batch_enrichment,
    start_enrichment,
)

STOP_WORDS = "the of and to a in is that for it was on with be as by are this at".split()
KEYWORDS = [
    ("tion", "cold", "cold", 0),
    ("heed", "warm, windy", "warm, windy", 0),
    ("rewh", "warm", "warm", 0),
    ("two words", "cold", "cold", 0),
]
TEMP_KEYWORDS = (("ouer",), ("cold",), (), ("warm",), ("heed",))
JOINED = {"max_rows": 0}  # forces the join that large lookup tables take


# --- tables -----------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(_table(spark, sf_dir, "documents"), "doc_id")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, cleaned_text`` of all documents."""
    df = documents(spark, sf_dir)
    return df.select("doc_id", T.clean_text(F.col("text")).alias(C.CLEANED_TEXT))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts; one source stands for missing accounts."""
    account = F.nullif(F.col("source"), F.lit("src0")).alias(C.ACCOUNT)
    return documents(spark, sf_dir).select("doc_id", C.TEXT, account, "lang")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with class ``quality * 2 + toxic``."""
    labels = _table(spark, sf_dir, "labels")
    label = (F.col("quality") * 2 + F.col("toxic")).alias("label")
    return documents(spark, sf_dir).join(labels, "doc_id").select("doc_id", "text", label)


def _benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0))
    return _table(spark, sf_dir, "benchmark").select(F.explode(words).alias("word")).distinct()


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0))
    return _table(spark, sf_dir, "conversations").select(F.explode(words).alias("word")).distinct()


def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping table with repeated words: one row per word occurrence in ``benchmark``."""
    words = F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words).alias("pos", "word"))
    odd = F.length("word") % 2 == 1
    return rows.select(
        "word",
        F.when(odd, "cold").otherwise("warm, windy").alias("EU"),
        F.concat(F.when(odd, "warm ").otherwise("cold "), F.col("item_id")).alias("USA"),
        (F.col("pos") % 2).alias("need_location"),
        (F.col("item_id") * 1000000 + F.col("pos")).alias("row_no"),
    )


def keyword_mapping(spark: SparkSession) -> DataFrame:
    words, eu, usa, need = zip(*KEYWORDS, strict=True)
    rows = word_frame(spark, word=words, EU=eu, USA=usa, need_location=map(str, need))
    return keywords.dedupe_mapping(keywords.unpivot_mapping(rows))


def key_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large key table: every benchmark word of six or more letters."""
    words = _benchmark_words(spark, sf_dir).where(F.length("word") >= 6)
    return words.select("word", F.concat(F.lit("c"), F.length("word") % 3).alias("mapping"))


def gazetteer(spark: SparkSession, sf_dir: str, min_length: int = 6, codes: bool = True) -> DataFrame:
    """Cities are benchmark words, 25 of which double as countries; word ends are the codes."""
    words = _benchmark_words(spark, sf_dir).where(F.length("word") >= min_length)
    # numbered by a hash, so that no single task has to order them
    numbered = words.withColumn("row_no", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long"))
    countries = numbered.groupBy((F.col("row_no") % 25).alias("bucket")).agg(F.min("word").alias("country"))
    rows = numbered.join(countries, F.col("row_no") % 25 == F.col("bucket"))

    def code(n: int) -> Column:
        return F.when(F.lit(codes), F.right("word", F.lit(n))).alias(f"iso{n}")

    return rows.select("row_no", F.col("word").alias("city"), "country", code(2), code(3))


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one to three words that occur in ``benchmark``."""
    words = T.words(T.clean_text(F.col("text")))
    at = _table(spark, sf_dir, "benchmark").select(words.alias("w"), F.posexplode(words).alias("pos", "word"))
    length = (
        F.when(F.length("word") >= 10, 1)
        .when(F.length("word") == 9, 3)
        .when(F.length("word") == 8, 2)
    )
    return (
        at.withColumn("n", length)
        .where(F.col("pos") + F.col("n") <= F.size("w"))
        .select(F.array_join(F.slice("w", F.col("pos") + 1, F.col("n")), " ").alias("name"))
        .distinct()
    )


def glossary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words, each defined by the last item that uses it."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0))
    rows = _table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(words).alias("term"))
    return rows.groupBy("term").agg(F.max_by("text", "item_id").alias("definition"))


def noun_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _benchmark_words(spark, sf_dir).where(F.length("word") >= 7)
    return words.select("word", F.left("word", F.lit(4)).alias("lemma"))


def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _benchmark_words(spark, sf_dir)
    return words.select("word", ((F.length("word") % 5 - 2) * F.lit(0.5)).alias("score"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the columns the rollup needs, none of them from a model.

    Location is the language, class is ``quality * 2 + toxic``, the topic of an untagged
    document is ``lang topic``.
    """
    labels = _table(spark, sf_dir, "labels")
    df = posts(spark, sf_dir).join(labels, "doc_id", "left")
    df = df.withColumn(C.LEMMATIZED_TEXT, T.clean_text(F.col(C.TEXT)))
    df = keywords.map_conditions(df, C.LEMMATIZED_TEXT, keyword_mapping(spark))
    return df.withColumns(
        {
            C.TOP_3_WORDS: F.concat(F.col("lang"), F.lit(" topic")),
            C.TEMP_SENTIMENT: F.col("quality") * 2 + F.col("toxic"),
            C.FINAL_LOCATION: F.col("lang"),
        }
    )


def topic_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``labels`` from fixed topic words, for the TF-IDF operators."""
    df = keywords.map_conditions(cleaned(spark, sf_dir), C.CLEANED_TEXT, keyword_mapping(spark))
    df = df.withColumn(C.LEMMATIZED_TEXT, F.col(C.CLEANED_TEXT))
    return topics.label_by_topic_words(df, TOPIC_WORDS)


TOPIC_WORDS = [["tion", "heed", "the"], ["que", "eau", "oi"], ["sch", "ung", "keit"]]


def example_lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    return Lookups(
        mapping=keyword_mapping(spark),
        gazetteer=gazetteer(spark, sf_dir, 9, codes=False),
        glossary=glossary_rows(spark, sf_dir),
        lexicon=conversation_words(spark, sf_dir),
        nouns=conversation_words(spark, sf_dir),
        noun_exceptions=noun_exceptions(spark, sf_dir),
        places=place_names(spark, sf_dir),
        stop_words=STOP_WORDS,
    )


# --- queries ----------------------------------------------------------------------------


def word_count(spark, sf_dir):
    return rollup.with_word_count(documents(spark, sf_dir), "text").select("doc_id", "word_count")


def filter_min_words(spark, sf_dir):
    df = _table(spark, sf_dir, "conversations")
    return rollup.filter_min_words(df, "text").select("conv_id", "turn")


def topic_eligible(spark, sf_dir):
    df = keywords.map_conditions(cleaned(spark, sf_dir), C.CLEANED_TEXT, keyword_mapping(spark))
    return df.select("doc_id", topics.topic_eligible(C.CLEANED_TEXT).alias("eligible"))


def combined_text(spark, sf_dir):
    df = keywords.map_conditions(cleaned(spark, sf_dir), C.CLEANED_TEXT, keyword_mapping(spark))
    df = rollup.with_combined_text(df.withColumnRenamed(C.CLEANED_TEXT, C.LEMMATIZED_TEXT))
    return df.select("doc_id", C.COMBINED_TEXT)


def temp_category(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").select("doc_id")
    df = df.join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    df = df.withColumn("class_id", F.col("quality") * 4 + F.col("toxic"))
    return rollup.with_temp_category(df, "class_id").select("doc_id", "temp_category")


def categorize_region(spark, sf_dir):
    location = (
        F.when(F.col("source") == "src0", "unknown")
        .when(F.col("source") == "src1", "paris, london")
        .when(F.col("lang") == "de", "Germany")
        .when(F.col("lang") == "fr", "france")
        .when(F.col("lang") == "en", "United States")
        .otherwise("Moldova")
    )
    df = _table(spark, sf_dir, "documents").withColumn("location", location)
    return places.with_region(df, "location").select("doc_id", "region")


def clean_text(spark, sf_dir):
    return cleaned(spark, sf_dir)


def clean_text_links(spark, sf_dir):
    pages = readers.spread(_table(spark, sf_dir, "pages"), "page_id")
    text = F.concat(F.lit("see "), F.col("url"), F.lit("#part "), F.col("html"), F.lit(" www.a-b.org/x"))
    return pages.select("page_id", T.clean_text(text).alias(C.CLEANED_TEXT))


def tokenize(spark, sf_dir):
    text = F.concat(F.lit("we cannot gonna "), F.col("text"), F.lit(" wanna lemmes gotta"))
    tokens = T.tokenize(T.clean_text(text))
    df = _table(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", F.array_join(tokens, "|").alias("tokens"))


def remove_stopwords(spark, sf_dir):
    tokens = T.remove_stopwords(T.words(F.col(C.CLEANED_TEXT)), STOP_WORDS)
    return cleaned(spark, sf_dir).select("doc_id", F.array_join(tokens, " ").alias("kept"))


def _text_table(spark, sf_dir, joined):
    """Cleaned documents; a join reads them twice, so then they are written down first."""
    df = cleaned(spark, sf_dir)
    return stage(df, "cleaned") if joined else df


def _lemmatize(spark, sf_dir, **options):
    df = _text_table(spark, sf_dir, "max_rows" in options).select("doc_id", T.words(F.col(C.CLEANED_TEXT)).alias("tokens"))
    df = text_prep.lemmatize(
        df, "tokens", noun_exceptions(spark, sf_dir), conversation_words(spark, sf_dir), **options
    )
    return df.select("doc_id", F.array_join("lemmas", " ").alias(C.LEMMATIZED_TEXT))


def lemmatize_lookup(spark, sf_dir):
    return _lemmatize(spark, sf_dir)


def lemmatize_joined(spark, sf_dir):
    return _lemmatize(spark, sf_dir, **JOINED)


def prepare_text(spark, sf_dir):
    df = text_prep.prepare_text(
        documents(spark, sf_dir), "text", STOP_WORDS, noun_exceptions(spark, sf_dir),
        conversation_words(spark, sf_dir),
    )
    return df.select("doc_id", C.CLEANED_TEXT, C.LEMMATIZED_TEXT)


def unpivot_mapping(spark, sf_dir):
    return keywords.unpivot_mapping(mapping_rows(spark, sf_dir))


def dedupe_mapping(spark, sf_dir):
    return keywords.dedupe_mapping(keywords.unpivot_mapping(mapping_rows(spark, sf_dir)))


def match_keywords(spark, sf_dir):
    df = keywords.match_keywords(cleaned(spark, sf_dir), C.CLEANED_TEXT, keyword_mapping(spark))
    return df.select("doc_id", F.array_join("matched_keys", "|").alias("matched_keys"))


def map_conditions(spark, sf_dir):
    df = keywords.map_conditions(cleaned(spark, sf_dir), C.CLEANED_TEXT, keyword_mapping(spark))
    return df.select("doc_id", C.WEATHER_TOPICS, C.WEATHER_TEMP)


def map_conditions_joined(spark, sf_dir):
    df = keywords.map_conditions(
        _text_table(spark, sf_dir, True), C.CLEANED_TEXT, key_words(spark, sf_dir), max_keys=0
    )
    return df.select("doc_id", C.WEATHER_TOPICS, C.WEATHER_TEMP)


def _map_glossary(spark, sf_dir, **options):
    df = glossary.map_glossary(
        _text_table(spark, sf_dir, "max_rows" in options), C.CLEANED_TEXT, glossary_rows(spark, sf_dir),
        conversation_words(spark, sf_dir), **options,
    )
    return df.select("doc_id", C.GLOSSARY_MAP)


def benchmark_phrases(spark, sf_dir):
    """Every three neighbouring words of ``benchmark`` as a key, with half of a word at each end."""
    words = T.words(T.clean_text(F.col("text")))
    at = _table(spark, sf_dir, "benchmark").select(words.alias("w"), F.posexplode(words).alias("pos", "first"))
    second, third = (F.get("w", F.col("pos") + i) for i in (1, 2))
    phrase = F.concat(
        F.right("first", F.ceil(F.length("first") / 2).cast("int")), F.lit(" "), second, F.lit(" "),
        F.left(third, F.ceil(F.length(third) / 2).cast("int")),
    )
    rows = at.select(phrase.alias("word")).where("word is not null").distinct()
    return rows.select("word", F.concat(F.lit("c"), F.length("word") % 3).alias("mapping"))


def map_phrases(spark, sf_dir):
    phrases = benchmark_phrases(spark, sf_dir).unionByName(
        key_words(spark, sf_dir).where(F.length("word") >= 9)
    )
    df = keywords.map_conditions(
        cleaned(spark, sf_dir), C.CLEANED_TEXT, phrases, phrases=True, max_keys=0
    )
    return df.select("doc_id", C.WEATHER_TOPICS, C.WEATHER_TEMP)


def map_glossary(spark, sf_dir):
    return _map_glossary(spark, sf_dir)


def map_glossary_joined(spark, sf_dir):
    return _map_glossary(spark, sf_dir, **JOINED)


def _map_country(spark, sf_dir, **options):
    df = places.map_country(
        _text_table(spark, sf_dir, "max_rows" in options), C.CLEANED_TEXT,
        gazetteer(spark, sf_dir), **options,
    )
    return df.select("doc_id", "country")


def map_country(spark, sf_dir):
    return _map_country(spark, sf_dir)


def map_country_joined(spark, sf_dir):
    return _map_country(spark, sf_dir, **JOINED)


def map_country_city_first(spark, sf_dir):
    return _map_country(spark, sf_dir, priority=places.CITY_FIRST)


def _extract_places(spark, sf_dir, **options):
    df = places.extract_places(
        _text_table(spark, sf_dir, "max_rows" in options), C.CLEANED_TEXT,
        place_names(spark, sf_dir), **options,
    )
    return df.select("doc_id", "places")


def extract_places(spark, sf_dir):
    return _extract_places(spark, sf_dir)


def extract_places_joined(spark, sf_dir):
    return _extract_places(spark, sf_dir, **JOINED)


def final_location(spark, sf_dir):
    df = places.final_location(
        cleaned(spark, sf_dir), C.CLEANED_TEXT, gazetteer(spark, sf_dir, 9, codes=False),
        place_names(spark, sf_dir),
    )
    return places.with_region(df).select("doc_id", C.FINAL_LOCATION, C.REGION)


def vocabulary_counts(spark, sf_dir):
    return topics.vocabulary_counts(cleaned(spark, sf_dir), C.CLEANED_TEXT)


def long_word_places() -> Callable:
    """A stand-in for a model of place names: the long words of a text, in order."""

    def load():
        return lambda texts: texts.map(lambda t: ", ".join(w for w in t.split(" ") if len(w) >= 14))

    return load


def extract_places_model(spark, sf_dir):
    """Places by a predictor, asked only for the posts without a country."""
    df = places.final_location(
        cleaned(spark, sf_dir), C.CLEANED_TEXT, gazetteer(spark, sf_dir, 9, codes=False),
        predictor=long_word_places(),
    )
    return df.select("doc_id", C.FINAL_LOCATION)


def number_words(spark, sf_dir):
    terms = topics.vocabulary_counts(cleaned(spark, sf_dir), C.CLEANED_TEXT)
    return topics.number_words(terms).select("index", "token", "tf")


def bag_of_words(spark, sf_dir):
    return topics.bag_of_words(cleaned(spark, sf_dir), C.CLEANED_TEXT, "doc_id")


def _fit(spark, sf_dir, **options):
    df = keywords.map_conditions(cleaned(spark, sf_dir), C.CLEANED_TEXT, keyword_mapping(spark))
    df = stage(df.withColumn(C.LEMMATIZED_TEXT, F.col(C.CLEANED_TEXT)), "topic-input")
    return df, topics.fit_topics(df, "doc_id", **options)


def topic_words(spark, sf_dir):
    return topics.topic_table(_fit(spark, sf_dir)[1])


def assign_topics(spark, sf_dir):
    df, model = _fit(spark, sf_dir)
    return topics.assign_topics(df, model).select("doc_id", C.DOMINANT_TOPIC, C.TOP_3_WORDS)


def topic_word_mass(spark, sf_dir):
    """How often a fit has counted each word: what its weights must sum to, turned round.

    The weights of a word start at a sum of k; each update fades them towards k priors plus
    the occurrences that the posts' topics share out. So every token must have been
    shared out once in each update.
    """
    _, model = _fit(spark, sf_dir)
    left = math.prod(1 - (1 + t) ** topics.DECAY for t in range(1, 11))
    total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    counted = (total - model.k * left) / (1 - left) - model.k * topics.BETA
    return model.weights.join(model.terms, "index").select(
        "index", "token", F.round(counted).cast("long").alias("counted")
    )


def topic_assignment_check(spark, sf_dir):
    """Whether each topic is the one that most of the post's tokens fall to, by their shares.

    A topic's weight in a post is its prior plus the sum of n * share of the post's tokens.
    """
    df, model = _fit(spark, sf_dir)
    done = topics.assign_topics(df, model).select("doc_id", C.DOMINANT_TOPIC, C.TOP_3_WORDS)
    shares = topics.token_responsibilities(df, model, "doc_id")
    weights = shares.groupBy("doc_id", "topic").agg(F.sum(F.col("n") * F.col("share")).alias("w"))
    most = weights.groupBy("doc_id").agg(F.max("w").alias("most"))
    own = weights.withColumnRenamed("topic", C.DOMINANT_TOPIC)
    labels = F.array(*[F.lit(", ".join(w)) for w in topics.topic_words(model)])
    checked = done.join(own, ["doc_id", C.DOMINANT_TOPIC], "left").join(most, "doc_id", "left")
    return checked.select(
        "doc_id",
        F.col(C.DOMINANT_TOPIC).isNotNull().alias("has_topic"),
        (F.col("w") > F.col("most") - 1e-6).alias("is_heaviest"),
        (F.col(C.TOP_3_WORDS) == F.get(labels, F.col(C.DOMINANT_TOPIC))).alias("has_its_words"),
    )


def token_responsibilities(spark, sf_dir):
    """The topics of each word of each post: all four, with shares between 0 and 1 of sum 1."""
    df, model = _fit(spark, sf_dir)
    shares = topics.token_responsibilities(df, model, "doc_id")
    per_word = shares.groupBy("doc_id", "token").agg(
        F.max("n").alias("n"),
        # one bit per topic, so that a word of a post is one row when it is shuffled
        F.bit_count(F.bit_or(F.expr("shiftleft(1L, topic)"))).cast("long").alias("topics"),
        F.round(F.sum("share"), 6).alias("total"),
        F.every(F.col("share").between(0, 1.000001)).alias("in_range"),
    )
    return per_word


def topic_words_learned_prior(spark, sf_dir):
    """The alternative settings: ten topics, learned prior, every non-empty text."""
    model = _fit(spark, sf_dir, eligible=topics.any_text(), k=10, learn_prior=True)[1]
    return topics.topic_table(model)


def relevance_words_model(spark, sf_dir):
    df, model = _fit(spark, sf_dir)
    return topics.relevance_words(df, model).select("doc_id", "top_3_relevance_words")


def relevance_words(spark, sf_dir):
    """The same ranking with a relevance that SQL can follow: in how many documents a word is."""
    df = _text_table(spark, sf_dir, True)
    counts = topics.vocabulary_counts(df, C.CLEANED_TEXT)
    relevance = counts.select("token", F.col("df").cast("double").alias("relevance"))
    out = topics.relevance_words(df, relevance, text_col=C.CLEANED_TEXT)
    return out.select("doc_id", "top_3_relevance_words")


def _lexicon_sentiment(spark, sf_dir, **options):
    df = sentiment.lexicon_sentiment(
        documents(spark, sf_dir), "text", word_scores(spark, sf_dir), score_col="score", **options
    )
    return df.select("doc_id", "lexicon_sentiment", F.round("score", 6).alias("score"))


def lexicon_sentiment(spark, sf_dir):
    return _lexicon_sentiment(spark, sf_dir)


def lexicon_sentiment_joined(spark, sf_dir):
    return _lexicon_sentiment(spark, sf_dir, **JOINED)


def polarity_sentiment(spark, sf_dir):
    df = sentiment.polarity_sentiment(
        documents(spark, sf_dir), "text", word_scores(spark, sf_dir), score_col="score"
    )
    return df.select("doc_id", "polarity_sentiment", F.round("score", 6).alias("score"))


#: Rules with words that the given texts have.
BOOSTERS = {"the": 0.293, "de": -0.293, "of": -0.5, "is": 0.25}
NEGATIONS = ("and", "la", "der")
MODIFIERS = {"the": 1.3, "de": 0.5, "of": 1.25, "is": 0.8}
CONTRAST = "with"


def valence_sentiment(spark, sf_dir, **options):
    rules = tone.ValenceRules(BOOSTERS, NEGATIONS, CONTRAST)
    df = tone.valence_sentiment(
        documents(spark, sf_dir), "text", word_scores(spark, sf_dir), rules, score_col="score", **options
    )
    return df.select("doc_id", "valence_sentiment", F.round("score", 6).alias("score"))


def modified_polarity(spark, sf_dir):
    df = tone.modified_polarity(
        documents(spark, sf_dir), "text", word_scores(spark, sf_dir), MODIFIERS, NEGATIONS, score_col="score"
    )
    return df.select("doc_id", "modified_polarity", F.round("score", 6).alias("score"))


def compare_sentiment(spark, sf_dir):
    """The four scorers side by side: two by words, two by a predictor in their own class orders."""
    scores = TokenTable.of(word_scores(spark, sf_dir), "double")
    rules = tone.ValenceRules(BOOSTERS, NEGATIONS, CONTRAST)
    model = keyword_scores()
    df = sentiment.compare_sentiment(
        _table(spark, sf_dir, "conversations"),
        "text",
        {
            "valence": lambda d, c, out: tone.valence_sentiment(d, c, scores, rules, out),
            "polarity": lambda d, c, out: tone.modified_polarity(d, c, scores, MODIFIERS, NEGATIONS, out),
            "twitter": lambda d, c, out: classify.classify(d, c, model, TWITTER_SENTIMENT_LABELS, out),
            "climate": lambda d, c, out: classify.classify(d, c, model, CLIMATE_SENTIMENT_LABELS, out),
        },
    )
    return df.select("conv_id", "turn", "valence", "polarity", "twitter", "climate")


def keyword_scores() -> Callable:
    """A stand-in for a pretrained model: one score per class, here 1 for a keyword found.

    The factory is nested so that it travels to the workers by value.
    """
    classes = (("tion",), ("e",), ("heed", "sch"))

    def load():
        return lambda texts: np.array(
            [[float(any(w in t for w in c)) for c in classes] for t in texts]
        )

    return load


def classify_hook(spark, sf_dir):
    df = documents(spark, sf_dir)
    df = classify.classify(df, "text", keyword_scores(), CLIMATE_SENTIMENT_LABELS, "label")
    return df.select("doc_id", "label")


def train_val_split(spark, sf_dir):
    return classify.split_train_val(_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "is_val")


def exact_split(spark, sf_dir):
    df = selection.split_train_val_exact(_table(spark, sf_dir, "documents"), "doc_id")
    return df.select("doc_id", "is_val")


def classification_metrics(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    df = df.select(
        (F.col("quality") * 2 + F.col("toxic")).alias("label"),
        (F.when(F.col("n_chars") > 2500, 3).when(F.col("n_chars") > 500, 2).otherwise(0)).alias("prediction"),
    )
    metrics = classify.classification_metrics(df)
    return metrics.select(*[F.round(c, 6).alias(c) for c in metrics.columns])


def train_temperature_model(spark, sf_dir):
    path = staging_path(spark, "model")
    return train_and_evaluate(labelled(spark, sf_dir), path, id_col="doc_id")


def predict_temperature(spark, sf_dir):
    """Train on the labelled documents, save, load, and class every document."""
    parts = classify.split_train_val(labelled(spark, sf_dir), "doc_id")
    model = classify.train_temperature_model(parts.where("not is_val"), parts.where("is_val"))
    path = staging_path(spark, "model")
    writers.save_model(model, path)
    df = classify.predict_temperature(documents(spark, sf_dir), writers.load_model(path), "text")
    return df.select("doc_id", C.TEMP_SENTIMENT)


def epochs_resumed(spark, sf_dir):
    """Whether training that stops after its first epoch and goes on ends like training in one go.

    Per epoch: are the validation losses the same, and in the end the weights.
    """
    posts = stage(labelled(spark, sf_dir), "labelled")  # read by both trainings, call by call
    parts = selection.split_train_val_exact(posts, "doc_id")
    train, val = parts.where("not is_val"), parts.where("is_val")
    schedule = epochs.Schedule(epochs=3, batches=4)
    whole, halves = staging_path(spark, "whole"), staging_path(spark, "halves")
    epochs.train_by_epochs(train, val, whole, "doc_id", schedule=schedule)
    for stop in (1, None):
        epochs.train_by_epochs(train, val, halves, "doc_id", schedule=schedule, stop_after=stop)
    one, two = (epochs.read_progress(spark, path) for path in (whole, halves))
    rows = []
    for a, b in zip(one, two, strict=True):
        left, right = spark.read.parquet(a["state"]), spark.read.parquet(b["state"])
        differ = left.exceptAll(right).count() + right.exceptAll(left).count()
        rows.append((a["epoch"], a["loss"] == b["loss"], differ == 0))
    return spark.createDataFrame(rows, "epoch int, same_loss boolean, same_weights boolean")


def model_round_trip(spark, sf_dir):
    """Whether models that were saved and loaded class and assign every document as before."""
    parts = classify.split_train_val(labelled(spark, sf_dir), "doc_id")
    model = classify.train_temperature_model(
        parts.where("not is_val"), parts.where("is_val"), reg_params=(0.01,)
    )
    topic_input, topic_model = _fit(spark, sf_dir)
    path, topic_path = staging_path(spark, "model"), staging_path(spark, "topic-model")
    writers.save_model(model, path)
    topic_model.save(topic_path)
    docs, loaded = documents(spark, sf_dir), topics.TopicModel.load(topic_path)
    parts = [
        classify.predict_temperature(docs, model, "text", "before"),
        classify.predict_temperature(docs, writers.load_model(path), "text", "after"),
        topics.assign_topics(topic_input, topic_model).withColumn("topic_before", F.col(C.DOMINANT_TOPIC)),
        topics.assign_topics(topic_input, loaded).withColumn("topic_after", F.col(C.DOMINANT_TOPIC)),
    ]
    names = ("before", "after", "topic_before", "topic_after")
    joined = docs.select("doc_id")
    for part, name in zip(parts, names, strict=True):
        joined = joined.join(part.select("doc_id", name), "doc_id")
    return joined.select(
        "doc_id",
        (F.col("before").eqNullSafe(F.col("after")) & F.col("before").between(0, 4)).alias("same_class"),
        F.col("topic_before").eqNullSafe(F.col("topic_after")).alias("same_topic"),
    )


def value_count_rows(spark, sf_dir):
    words = cleaned(spark, sf_dir).select(F.length(C.CLEANED_TEXT).alias("size"), F.explode(T.words(F.col(C.CLEANED_TEXT))).alias("word"))
    words = words.withColumn("bucket", F.col("size") % 3)
    return rollup.value_counts(words, ["bucket"], "word")


def topic_chain(spark, sf_dir):
    """The alternative chain, from the fit to the filled words."""
    df = keywords.map_conditions(cleaned(spark, sf_dir), C.CLEANED_TEXT, keyword_mapping(spark))
    df = stage(df.withColumn(C.LEMMATIZED_TEXT, F.col(C.CLEANED_TEXT)), "topic-input")
    done, _ = fill_by_topics(df, "doc_id", k=10, learn_prior=False)
    return done.select("doc_id", "labels", "final_weather_words", C.WEATHER_TOPICS)


def analyze_posts_trained(spark, sf_dir):
    """All steps with a classifier trained on the labelled documents."""
    parts = selection.split_train_val_exact(labelled(spark, sf_dir), "doc_id")
    model = classify.train_temperature_model(parts.where("not is_val"), parts.where("is_val"))
    result, _ = analyze_posts(
        posts(spark, sf_dir), example_lookups(spark, sf_dir), model, id_col="doc_id", fit=False
    )
    return result.select("doc_id", C.COMBINED_TEXT, C.TEMP_SENTIMENT)


def value_counts(spark, sf_dir):
    df = rollup.with_temp_category(tagged(spark, sf_dir))
    counts = rollup.value_counts_map(df, [C.FINAL_LOCATION], C.TEMP_CATEGORY, "counts")
    return counts.select(C.FINAL_LOCATION, F.explode("counts").alias("temp_category", "n"))


def group_counts(spark, sf_dir):
    return rollup.rollup_posts(tagged(spark, sf_dir)).select(
        C.GROUP_TOPIC, C.FINAL_LOCATION, C.TWEET_COUNT, C.ACCOUNT_COUNT
    )


def count_percentages(spark, sf_dir):
    df = posts(spark, sf_dir).groupBy("lang", "account").agg(F.count("*").alias("n"))
    totals = df.groupBy("lang").agg(F.sum("n").alias("total"))
    return df.join(totals, "lang").select(
        "lang", "account", share_text(F.col("n"), F.col("total")).alias("share")
    )


def rollup_posts(spark, sf_dir):
    """The report with its maps in their text form, as the CSV sink writes them."""
    df = rollup.rollup_posts(tagged(spark, sf_dir))
    return df.withColumns(
        {
            C.TEMP_COUNTS: writers.map_text(F.col(C.TEMP_COUNTS), False),
            C.TEMP_PERCENTAGES: writers.map_text(F.col(C.TEMP_PERCENTAGES), True),
        }
    )


def rollup_long(spark, sf_dir):
    return rollup.rollup_long(tagged(spark, sf_dir))


def analyze_posts_rollup(spark, sf_dir):
    """All steps but the topic fit, with a rule as classifier; the report in long form."""
    result, _ = analyze_posts(
        posts(spark, sf_dir), example_lookups(spark, sf_dir),
        classify.RuleClasses(TEMP_KEYWORDS), id_col="doc_id", fit=False,
    )
    return rollup.rollup_long(result)


def analyze_posts_result(spark, sf_dir):
    result, _ = analyze_posts(
        posts(spark, sf_dir), example_lookups(spark, sf_dir),
        classify.RuleClasses(TEMP_KEYWORDS), id_col="doc_id", fit=False,
    )
    return result.select(
        "doc_id", C.LEMMATIZED_TEXT, C.GLOSSARY_MAP, C.WEATHER_TOPICS, C.FINAL_LOCATION, C.REGION,
        C.COMBINED_TEXT, C.TEMP_SENTIMENT,
    )


def analyze_posts_full(spark, sf_dir):
    """Everything, topic fit included: the flagship."""
    _, report = analyze_posts(
        posts(spark, sf_dir), example_lookups(spark, sf_dir),
        classify.RuleClasses(TEMP_KEYWORDS), id_col="doc_id",
        result_path=staging_path(spark, "result"),
    )
    return report


def analyze_posts_totals(spark, sf_dir):
    """The flagship's report summed over its topics: every post of over three words has one."""
    report = analyze_posts_full(spark, sf_dir).select(
        C.FINAL_LOCATION, C.TWEET_COUNT, F.explode_outer(C.TEMP_COUNTS).alias("temp_category", "n"), C.GROUP_TOPIC
    )
    tweets = report.groupBy(C.GROUP_TOPIC, C.FINAL_LOCATION).agg(F.max(C.TWEET_COUNT).alias("t"))
    tweets = tweets.groupBy(C.FINAL_LOCATION).agg(F.sum("t").alias("tweets"))
    counts = report.groupBy(C.FINAL_LOCATION, "temp_category").agg(F.sum("n").alias("n"))
    return counts.join(tweets, C.FINAL_LOCATION)


def restrict_vocab(spark, sf_dir):
    phrases = _table(spark, sf_dir, "benchmark").select(T.clean_text(F.col("text")).alias("phrase"))
    df = tfidf.restrict_vocab(cleaned(spark, sf_dir), C.CLEANED_TEXT, phrases)
    return df.select("doc_id", F.array_join("Vocab", " ").alias("vocab"))


def label_by_topic_words(spark, sf_dir):
    return topic_labelled(spark, sf_dir).select("doc_id", "labels")


def finalize_words(spark, sf_dir):
    df = topics.finalize_words(topic_labelled(spark, sf_dir), TOPIC_WORDS)
    return df.select("doc_id", "final_weather_words")


def tfidf_by_group(spark, sf_dir):
    df = tfidf.tfidf_by_group(documents(spark, sf_dir), "lang", "text")
    return df.select("label", "token", F.round("tfidf", 8).alias("tfidf"))


def top_tfidf_words(spark, sf_dir):
    df = stage(topic_labelled(spark, sf_dir), "labelled")
    weights = tfidf.tfidf_by_group(df, "labels", C.CLEANED_TEXT)
    weights = stage(weights, "tfidf")
    return tfidf.fill_words_by_tfidf(df, weights).select("doc_id", C.WEATHER_TOPICS)


def csv_posts_round_trip(spark, sf_dir):
    """Posts through the CSV sink and the CSV scan, line breaks and quotes included."""
    path = staging_path(spark, "posts-csv")
    writers.write_result(posts(spark, sf_dir), path)
    df = readers.read_posts(spark, path)
    return df.select(F.col("doc_id").cast("long"), "text", "account", "lang")


def csv_rollup_round_trip(spark, sf_dir):
    path = staging_path(spark, "rollup-csv")
    writers.write_rollup(rollup.rollup_posts(tagged(spark, sf_dir)), path)
    df = spark.read.csv(path, header=True, escape='"')
    counts = [F.col(c).cast("long").alias(c) for c in (C.TWEET_COUNT, C.ACCOUNT_COUNT)]
    return df.select(C.GROUP_TOPIC, C.FINAL_LOCATION, *counts, C.TEMP_COUNTS, C.TEMP_PERCENTAGES)


def mapping_csv_scan(spark, sf_dir):
    path = staging_path(spark, "mapping-csv")
    rows = mapping_rows(spark, sf_dir).select("word", "EU", "USA", "need_location")
    writers.write_result(rows, path)
    return readers.read_mapping(spark, path).drop("row_no")


def gazetteer_csv_scan(spark, sf_dir):
    path = staging_path(spark, "cities-csv")

    def loud(name: str) -> Column:
        # upper-casing the German sharp s would not come back
        return F.when(F.contains(F.col(name), F.lit("ß")), F.col(name)).otherwise(F.upper(name)).alias(name)

    rows = gazetteer(spark, sf_dir).select(
        loud("city"), F.col("city").alias("city_ascii"), loud("country"),
        F.lit("n/a").alias("admin_name"), F.lit("").alias("capital"), loud("iso2"), "iso3",
    )
    writers.write_result(rows, path)
    return readers.read_gazetteer(spark, path).drop("row_no")


def glossary_json_scan(spark, sf_dir):
    """A glossary of eight JSON documents, each a file; terms repeat within and between them."""
    path = staging_path(spark, "glossary-json")
    words = F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))
    terms = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words).alias("pos", "word"))
    # upper-casing the German sharp s would not come back
    loud = F.concat(F.upper(F.left("word", F.lit(1))), F.expr("substring(word, 2)"))
    loud = F.when(F.startswith("word", F.lit("ß")), F.col("word")).otherwise(loud)
    definition = F.when(F.col("pos") % 7 != 3, F.concat_ws(" ", "item_id", "pos"))
    entry = F.struct("item_id", "pos", loud.alias("term"), definition.alias("definition"))
    documents = terms.groupBy((F.col("item_id") % 8).alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("glossary"))
    documents.repartition(8, "part").write.partitionBy("part").json(path)
    return readers.read_glossary(spark, path)


def labelled_csv_scan(spark, sf_dir):
    path = staging_path(spark, "labelled-csv")
    writers.write_result(labelled(spark, sf_dir), path)
    df = readers.read_labelled(spark, path)
    return df.select(F.col("doc_id").cast("long"), "text", "label")


def stream_enrichment(spark, sf_dir):
    """The per-post steps as a stream over the documents table, run until it is drained.

    The table may be one file or a folder of files; the braces make the path a pattern, as a
    stream takes no plain path of a file.
    """
    source = _table(spark, sf_dir, "documents")
    stream = read_post_stream(spark, f"{sf_dir}/{{documents.parquet}}", source.schema)
    out, state = staging_path(spark, "stream-out"), staging_path(spark, "stream-state")
    lookups = Lookups(
        mapping=keyword_mapping(spark),
        gazetteer=gazetteer(spark, sf_dir, 9, codes=False),
        places=place_names(spark, sf_dir),
        stop_words=STOP_WORDS,
    )
    start_enrichment(stream, lookups, out, state, once=True).awaitTermination()
    df = spark.read.parquet(out)
    return df.select("doc_id", C.LEMMATIZED_TEXT, C.WEATHER_TOPICS, C.FINAL_LOCATION, C.REGION)


def stream_batch_enrichment(spark, sf_dir):
    """The same with every lookup joined, batch by batch; the last batch is run twice."""
    source = _table(spark, sf_dir, "documents")
    folder = staging_path(spark, "stream-in")
    # a file is one task: a third of them fills all cores
    files = max(spark.sparkContext.defaultParallelism, math.ceil(source.rdd.getNumPartitions() / 3))
    source.repartition(3 * files, "doc_id").write.parquet(folder)
    files = math.ceil(len(spark.read.parquet(folder).inputFiles()) / 3)
    out = staging_path(spark, "stream-out")
    lookups = Lookups(
        mapping=keyword_mapping(spark),
        gazetteer=gazetteer(spark, sf_dir, 9, codes=False),
        places=place_names(spark, sf_dir),
        stop_words=STOP_WORDS,
    )
    for state in ("first", "again"):
        # a new state folder forgets what was done, as after a failure: the same batches run again
        stream = read_post_stream(spark, folder, source.schema, files_per_batch=files)
        start_batch_enrichment(
            stream, lookups, out, staging_path(spark, state), once=True, max_rows=0
        ).awaitTermination()
    df = spark.read.parquet(out)
    return df.select("doc_id", C.LEMMATIZED_TEXT, C.WEATHER_TOPICS, C.FINAL_LOCATION, C.REGION)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        word_count, filter_min_words, topic_eligible, combined_text, temp_category,
        categorize_region, clean_text, clean_text_links, tokenize, remove_stopwords,
        lemmatize_lookup, lemmatize_joined, prepare_text, unpivot_mapping, dedupe_mapping,
        match_keywords, map_conditions, map_conditions_joined, map_phrases, map_glossary,
        map_glossary_joined, map_country, map_country_joined, map_country_city_first,
        extract_places, extract_places_joined, final_location, vocabulary_counts, bag_of_words,
        number_words, topic_words, assign_topics, topic_word_mass, topic_assignment_check,
        token_responsibilities, topic_words_learned_prior,
        relevance_words, relevance_words_model, lexicon_sentiment, lexicon_sentiment_joined,
        polarity_sentiment, valence_sentiment, modified_polarity, compare_sentiment, classify_hook, train_val_split, exact_split,
        classification_metrics, train_temperature_model, predict_temperature, epochs_resumed, value_counts,
        group_counts, count_percentages, rollup_posts, rollup_long, analyze_posts_rollup,
        analyze_posts_result, analyze_posts_full, analyze_posts_totals, restrict_vocab, label_by_topic_words,
        finalize_words, tfidf_by_group, top_tfidf_words, csv_posts_round_trip,
        csv_rollup_round_trip, mapping_csv_scan, gazetteer_csv_scan, labelled_csv_scan,
        stream_enrichment, stream_batch_enrichment, glossary_json_scan, extract_places_model,
        model_round_trip, value_count_rows, topic_chain, analyze_posts_trained,
    )
}
