"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions import text as T
from postlens.functions.token_table import TokenTable, _joined_tokens, hot_tokens, with_row_id
from postlens.operators import glossary, keywords, places, rollup, sentiment, text_prep, tfidf, topics


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def posts(spark, tmp_path_factory):
    """A written table, as posts are."""
    path = str(tmp_path_factory.mktemp("posts") / "t")
    rows = [(i, f"storm in paris {i} w{i % 7}", f"acc{i % 3}") for i in range(40)]
    spark.createDataFrame(rows, "id long, text string, account string").withColumn("other", F.lit(1)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def enriched(spark, posts):
    mapping = spark.createDataFrame([("storm", "cold"), ("pa", "warm")], "word string, mapping string")
    cities = spark.createDataFrame(
        [(1, "paris", "france", "fr", "fra")], "row_no int, city string, country string, iso2 string, iso3 string"
    )
    words = spark.createDataFrame([("storm",)], "w string")
    terms = spark.createDataFrame([("paris", "a city")], "t string, d string")
    df = text_prep.prepare_text(posts, lexicon=["storm"])
    df = glossary.map_glossary(df, C.LEMMATIZED_TEXT, terms, words)
    df = keywords.map_conditions(df, C.CLEANED_TEXT, mapping)
    df = places.with_region(places.final_location(df, C.LEMMATIZED_TEXT, cities, ["new york"]))
    return sentiment.lexicon_sentiment(df, "text", {"storm": -1.0})


def test_row_level_steps_are_one_scan_without_shuffle_join_or_python(enriched):
    text = plan(enriched)
    for word in ("Exchange", "Join", "Python", "Arrow", "Generate"):
        assert word not in text, word
    assert text.count("FileScan") == 1


def test_cleaning_runs_once_per_row(enriched):
    # the pattern of the blank-collapsing step occurs once: no step repeats the cleaning
    assert plan(enriched).count(T.BLANKS) == 1


def test_keyword_tags_stay_in_generated_code(spark, posts):
    mapping = spark.createDataFrame([("storm", "cold"), ("pa", "warm")], "word string, mapping string")
    text = plan(keywords.map_conditions(posts.select("id", "text"), "text", mapping))
    assert text.startswith("*(1)")
    assert "ReadSchema: struct<id:bigint,text:string>" in text


def test_filters_and_columns_reach_the_scan(posts):
    text = plan(rollup.filter_min_words(posts.where("account = 'acc1'"), "text").select("id"))
    assert "PushedFilters: [IsNotNull(account), EqualTo(account,acc1)" in text
    assert "other" not in text


def rollup_input(posts):
    return posts.withColumns(
        {
            C.LEMMATIZED_TEXT: T.clean_text(F.col("text")),
            C.WEATHER_TOPICS: F.col("account"),
            C.TOP_3_WORDS: F.lit(None).cast("string"),
            C.TEMP_SENTIMENT: F.lit(1),
            C.FINAL_LOCATION: F.col("account"),
        }
    )


def test_rollup_counts_before_it_shuffles_and_cleans_once(posts):
    text = plan(rollup.rollup_posts(rollup_input(posts)))
    lines = [line for line in text.splitlines() if "Exchange" in line or "HashAggregate" in line]
    first = next(i for i, line in enumerate(lines[::-1]) if "Exchange" in line)
    assert first > 0, "an aggregate must come before the first exchange"
    # per (group, account), per group, and the final sort
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("Exchange rangepartitioning") == 1
    assert text.count(T.BLANKS) == 1


def test_bag_of_words_needs_no_shuffle(posts):
    assert "Exchange" not in plan(topics.bag_of_words(posts, "text", "id"))


def test_tfidf_reads_counts_not_posts(spark, posts):
    text = plan(tfidf.tfidf_by_group(posts, "account", "text"))
    assert posts.inputFiles()[0].rsplit("/", 1)[0] not in text
    assert "Window" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_joined_lookup_is_salted(spark, posts):
    table = TokenTable.joined(spark.createDataFrame([("storm", -1.0)], "w string, s double"))
    text = plan(_joined_tokens(with_row_id(posts), T.words(F.col("text")), table, False))
    assert "_salt" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_joined_lookup_leaves_a_written_table(spark, posts):
    table = spark.createDataFrame([("storm", -1.0)], "w string, s double")
    text = plan(sentiment.lexicon_sentiment(posts, "text", table, max_rows=0))
    assert "Generate" not in text and text.count("Join") <= 2


def test_large_key_table_is_a_salted_equi_join(spark, posts):
    mapping = spark.createDataFrame([("storm", "cold"), ("pa", "warm")], "word string, mapping string")
    text = plan(keywords._joined_keys(with_row_id(posts), "text", mapping))
    assert "_salt" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_hot_tokens_are_salted(spark):
    tokens = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "the").otherwise(F.concat(F.lit("w"), "id")).alias("token"))
    assert hot_tokens(tokens) == ["the"]
    assert hot_tokens(tokens.limit(0)) == []
