import random

from conftest import column
from pyspark.sql import functions as F

from postlens.functions.labels import share_text, temp_category
from postlens.operators import rollup
from postlens.sources.writers import map_text

SCHEMA = (
    "lemmatized_text string, weather_topics string, top_3_words string, climate_bert_temp_sentiment int,"
    " final_location string, account string"
)


def test_share_text_equals_python_formatting(spark):
    df = spark.range(0, 401).crossJoin(spark.range(1, 401).withColumnRenamed("id", "total")).where("id <= total")
    df = df.select("id", "total", share_text(F.col("id"), F.col("total")).alias("got"))
    wrong = [r for r in df.collect() if r["got"] != f"{r['id']} ({r['id'] / r['total'] * 100:.1f}%)"]
    assert not wrong


def test_temp_category(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, -1, None)], "c int")
    got = [r[0] for r in df.select(temp_category(F.col("c"))).collect()]
    assert got == ["very cold", "cold", "mild/not relevant", "hot", "very hot", "unknown", "unknown", "unknown"]


def test_null_accounts_and_shares(spark):
    rows = [
        ("a b c d", "k", None, 1, "L", None),
        ("a b c d", "k", None, 3, "L", "x"),
        ("a b c d", "k", "t", 3, "L", "x"),
        ("a b c d", None, "k", 9, "L", "y"),
        ("a b c", "k", None, 3, "L", "z"),
        (None, "k", None, 3, "L", "z"),
        ("a b c d", None, None, 3, "L", "z"),
        ("a b c d", "k", None, 3, None, "z"),
    ]
    report = rollup.rollup_posts(spark.createDataFrame(rows, SCHEMA))
    assert report.columns == [
        "group_topic", "final_location", "tweet_count", "account_count", "temp_counts", "temp_percentages",
    ]
    (row,) = report.collect()
    assert row[:4] == ("k", "L", 3, 2)
    # map order, which a Python dict does not show
    assert report.select(F.map_keys("temp_counts")).first()[0] == ["hot", "cold", "unknown"]
    assert row["temp_counts"] == {"hot": 2, "cold": 1, "unknown": 1}
    assert row["temp_percentages"] == {"hot": "2 (50.0%)", "cold": "1 (25.0%)", "unknown": "1 (25.0%)"}
    text = report.select(map_text(F.col("temp_counts"), False), map_text(F.col("temp_percentages"), True)).first()
    assert text[0] == "{'hot': 2, 'cold': 1, 'unknown': 1}"
    assert text[1] == str({"hot": "2 (50.0%)", "cold": "1 (25.0%)", "unknown": "1 (25.0%)"})


def test_rollup_equals_brute_force(spark):
    rng = random.Random(9)

    def maybe(*values):
        return rng.choice([*values, None])

    rows = [
        (maybe("a b c d", "a b c", "w x y z z"), maybe("k1", "k2"), maybe("t1"), maybe(0, 1, 2, 3, 4, 7),
         maybe("A", "B"), maybe("u", "v", "w"))
        for _ in range(3000)
    ]
    groups = {}
    for text, key, topic, cls, place, account in rows:
        topic = key if key is not None else topic
        if text is not None and len(text.split()) > 3 and topic is not None and place is not None:
            groups.setdefault((topic, place), []).append((cls, account))
    got = rollup.rollup_posts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r[0], r[1]) for r in got} == set(groups)
    sizes = [sum(r["temp_counts"].values()) for r in got]
    assert sizes == sorted(sizes, reverse=True)
    for r in got:
        posts = groups[r[0], r[1]]
        assert r["tweet_count"] == sum(a is not None for _, a in posts)
        assert r["account_count"] == len({a for _, a in posts} - {None})
        assert sum(r["temp_counts"].values()) == len(posts)
        assert r["temp_counts"].get("hot", 0) == sum(c == 3 for c, _ in posts)
        assert r["temp_counts"].get("unknown", 0) == sum(c in (None, 7) for c, _ in posts)
        shares = [float(t.split("(")[1].rstrip("%)")) for t in r["temp_percentages"].values()]
        assert abs(sum(shares) - 100) <= 0.1 * len(shares)


def test_value_counts_map(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "b"), ("g", None), ("h", None)], "k string, v string")
    counts = rollup.value_counts_map(df, ["k"], "v", "m").withColumn("e", F.map_entries("m"))
    got = column(counts, "e", "k")
    assert [tuple(e) for e in got["g"]] == [("b", 2), ("a", 1)]
    assert "h" not in got


def test_combined_text(spark):
    rows = [(1, "very cold", None), (2, "a", "warm, windy"), (3, None, "warm")]
    df = spark.createDataFrame(rows, "id int, lemmatized_text string, weather_temp string")
    got = column(rollup.with_combined_text(df), "combined_text")
    assert got == {1: "very cold None", 2: "a warm, windy", 3: None}


def test_min_words(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, None)], "id int, lemmatized_text string")
    assert [r["id"] for r in rollup.filter_min_words(df).collect()] == [2]
    assert column(rollup.with_word_count(df), "word_count") == {1: 3, 2: 4, 3: None}
