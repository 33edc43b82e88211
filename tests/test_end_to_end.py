"""Sources, sinks, the whole analysis, streaming, staging."""

import csv
import json
from pathlib import Path

import pytest
from conftest import column
from pyspark.sql import functions as F

from postlens.operators import classify, keywords
from postlens.plans.analyze import Lookups, analyze_posts, enrich_posts, run_analysis
from postlens.sources import readers, staging, writers
from postlens.plans.topic_chain import fill_by_topics
from postlens.streaming.enrich import read_post_stream, start_batch_enrichment, start_enrichment

POSTS = [
    ("Huge storm over Paris, nobody can sleep", "ann", "1"),
    ("Storm again in Paris and it is freezing cold", "bob", "2"),
    ("Lovely warm evening at the beach with friends", "ann", "3"),
    ("Lovely warm evening near New York with everybody", None, "4"),
    ('He said "hi",\nthen left for the beach at noon', "cyd", "5"),
    ("too short", "ann", "6"),
]


@pytest.fixture(scope="module")
def posts_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "posts.csv"
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["text", "account", "post_id"])
        out.writerows([["" if v is None else v for v in row] for row in POSTS])
        out.writerow(["null", "ann", "7"])
    return str(path)


@pytest.fixture(scope="module")
def lookups(spark):
    mapping = spark.createDataFrame([("storm", "cold, windy")], "word string, mapping string")
    cities = spark.createDataFrame(
        [(1, "paris", "france", "fr", "fra")],
        "row_no int, city string, country string, iso2 string, iso3 string",
    )
    glossary = spark.createDataFrame([("storm", "a strong wind")], "term string, definition string")
    words = spark.createDataFrame([("beach",), ("friend",)], "word string")
    return Lookups(
        mapping, cities, glossary, words, nouns=["friend", "evening", "beach"], places=["new york", "beach"]
    )


RULE = classify.rule_predictor((("freezing",), ("cold",), (), ("warm",), ()))


def test_csv_scan(spark, posts_csv):
    df = readers.read_posts(spark, posts_csv)
    assert df.columns == ["text", "account", "post_id"]
    assert [tuple(r) for r in df.orderBy("post_id").collect()] == [*POSTS, (None, "ann", "7")]
    with pytest.raises(ValueError, match="missing column"):
        readers.read_labelled(spark, posts_csv)


def test_gazetteer_scan(spark, tmp_path):
    path = tmp_path / "cities.csv"
    path.write_text(
        '"city","city_ascii","country","admin_name","capital","iso2","iso3","population"\n'
        '"Zürich","Zurich","Switzerland","ZH","admin","CH","CHE","1"\n"Rundu","Rundu","Namibia","","","NA","NAM","2"\n',
        encoding="utf-8",
    )
    rows = readers.read_gazetteer(spark, str(path)).orderBy("row_no").collect()
    assert rows[0][:7] == ("zürich", "zurich", "switzerland", "zh", "admin", "ch", "che")
    assert rows[1]["iso2"] is None and rows[1]["capital"] is None  # as a data-frame reader has it


def test_glossary_scan(spark, tmp_path):
    path = tmp_path / "glossary.json"
    entries = [
        {"term": "Gale", "definition": "old"}, {"term": None, "definition": "x"}, {"term": "GALE", "definition": "new"},
        {"term": "fog", "definition": None},
    ]
    path.write_text(json.dumps({"@context": {}, "glossary": entries}, indent=1))
    assert column(readers.read_glossary(spark, str(path)), "definition", "term") == {"gale": "new"}


def test_run_analysis_writes_both_tables(spark, posts_csv, lookups, tmp_path):
    out, report = str(tmp_path / "result"), str(tmp_path / "report")
    result, _ = run_analysis(spark, posts_csv, lookups, RULE, out, report, id_col="post_id", max_iter=2, mini_batch=1.0)
    assert result.columns == [
        "text", "account", "post_id", "cleaned_text", "lemmatized_text", "Glossary_Map", "weather_topics",
        "weather_temp", "final_location", "region", "dominant_topic", "top_3_words", "combined_text",
        "climate_bert_temp_sentiment",
    ]
    rows = {r["post_id"]: r for r in result.collect()}
    assert rows["1"]["Glossary_Map"] == "a strong wind"
    assert rows["1"]["weather_topics"] == "storm" and rows["1"]["dominant_topic"] is None
    assert (rows["1"]["final_location"], rows["1"]["region"]) == ("france", "EU")
    assert rows["2"]["climate_bert_temp_sentiment"] == 0
    assert rows["3"]["lemmatized_text"] == "lovely warm evening beach friend"
    assert rows["3"]["climate_bert_temp_sentiment"] == 3
    assert rows["3"]["combined_text"] == "lovely warm evening beach friend None"
    assert rows["3"]["dominant_topic"] in range(4) and rows["3"]["top_3_words"].count(", ") == 2
    assert rows["4"]["final_location"] == "new york" and rows["4"]["region"] == "Other"
    assert rows["6"]["top_3_words"] is None
    assert rows["7"]["lemmatized_text"] is None and rows["7"]["final_location"] == "Unknown"
    written = readers.read_posts(spark, out)
    assert written.count() == 7 and written.columns == result.columns
    lines = spark.read.csv(report, header=True, escape='"').collect()
    storm = next(r for r in lines if r["group_topic"] == "storm")
    assert (storm["final_location"], storm["tweet_count"], storm["account_count"]) == ("france", "2", "2")
    assert storm["temp_counts"] == str({"very cold": 1, "cold": 1})
    assert storm["temp_percentages"] == str({"very cold": "1 (50.0%)", "cold": "1 (50.0%)"})


def test_analysis_makes_row_numbers_when_there_is_no_id(spark, posts_csv, lookups):
    df = readers.read_posts(spark, posts_csv).drop("post_id")
    result, report = analyze_posts(df, lookups, RULE, max_iter=1, mini_batch=1.0)
    assert "_row_id" not in result.columns
    assert result.count() == 7
    assert sum(sum(r["temp_counts"].values()) for r in report.collect()) == 5


def test_parquet_result_is_read_back(spark, posts_csv, lookups, tmp_path):
    df = readers.read_posts(spark, posts_csv)
    path = str(tmp_path / "result")
    result, report = analyze_posts(df, lookups, RULE, "post_id", fit=False, result_path=path)
    assert Path(path).exists()
    assert result.where("top_3_words is not null").count() == 0
    assert [r["group_topic"] for r in report.collect()] == ["storm"]
    writers.write_rollup(report, str(tmp_path / "parquet"), "parquet")
    assert dict(spark.read.parquet(str(tmp_path / "parquet")).dtypes)["temp_counts"] == "map<string,bigint>"
    writers.write_rollup(report, str(tmp_path / "json"), map_format="json")
    line = spark.read.csv(str(tmp_path / "json"), header=True, escape='"').first()
    assert json.loads(line["temp_counts"]) == {"very cold": 1, "cold": 1}


def test_stream_gives_what_the_batch_gives(spark, posts_csv, lookups, tmp_path):
    posts = readers.read_posts(spark, posts_csv)
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    posts.repartition(3).write.parquet(folder)
    stream = read_post_stream(spark, folder, posts.schema, files_per_batch=1)
    start_enrichment(stream, lookups, out, state, classifier=RULE, once=True).awaitTermination()
    done = spark.read.parquet(out)
    assert done.count() == 7
    # the next files are picked up, the old ones are not done again
    posts.limit(1).write.mode("append").parquet(folder)
    stream = read_post_stream(spark, folder, posts.schema)
    start_enrichment(stream, lookups, out, state, classifier=RULE, once=True).awaitTermination()
    assert spark.read.parquet(out).count() == 8
    batch = enrich_posts(posts, lookups)
    for name in ("lemmatized_text", "weather_topics", "final_location", "region"):
        assert column(done, name, "post_id") == column(batch, name, "post_id")


def test_stream_over_joined_tables_gives_what_the_batch_gives(spark, posts_csv, lookups, tmp_path):
    posts = readers.read_posts(spark, posts_csv)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    posts.repartition(3).write.parquet(folder)
    for state in ("one", "two"):  # a lost state folder: the same batches are written over
        stream = read_post_stream(spark, folder, posts.schema, files_per_batch=1)
        start_batch_enrichment(
            stream, lookups, out, str(tmp_path / state), classifier=RULE, once=True, max_rows=0
        ).awaitTermination()
        done = spark.read.parquet(out)
        assert done.count() == 7 and done.select("batch_id").distinct().count() == 3
    batch = enrich_posts(posts, lookups)
    for name in ("lemmatized_text", "Glossary_Map", "weather_topics", "final_location", "region"):
        assert column(done, name, "post_id") == column(batch, name, "post_id")


def test_last_row_wins_by_file_name(spark, tmp_path):
    for name, size in (("b", 1), ("a", 500), ("c", 40)):
        filler = "".join(f"w{name}{i},x,y,1\n" for i in range(size))
        (tmp_path / f"{name}.csv").write_text(f"word,EU,USA,need_location\n{filler}same,{name},{name},0\n")
    rows = readers.read_mapping(spark, str(tmp_path))
    same = rows.where("word = 'same'").orderBy("row_no").collect()
    assert [r["EU"] for r in same] == ["a", "b", "c"]
    assert rows.count() == rows.select("row_no").distinct().count()
    folder = tmp_path / "json"
    folder.mkdir()
    for name, size in (("2", 300), ("1", 2), ("3", 0)):
        entries = [{"term": f"T{i}", "definition": f"{name} {i}"} for i in range(size)]
        (folder / f"{name}.json").write_text(json.dumps({"glossary": entries}))
    got = column(readers.read_glossary(spark, str(folder)), "definition", "term")
    assert got["t0"] == "2 0" and len(got) == 300


def test_posts_without_line_breaks_can_be_split(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text("text,account\n" + "".join(f"post {i},a\n" for i in range(30_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        whole, split = (readers.read_posts(spark, str(path), multi_line=m) for m in (True, False))
        assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 2
        assert split.count() == whole.count() == 30_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_topic_chain_fills_untagged_posts(spark):
    rows = [(i, "snow ice frost cold" if i % 2 else "sun beach sand sea", "storm" if i % 5 == 0 else None) for i in range(40)]
    rows += [(90, None, None), (91, "", None)]
    df = spark.createDataFrame(rows, "id int, lemmatized_text string, weather_topics string")
    df = df.withColumns({"cleaned_text": F.col("lemmatized_text"), "weather_temp": F.lit("windy")})
    done, words = fill_by_topics(df, "id", k=2, learn_prior=False)
    ranked = {(r["topic"], r["rank"]): r["word"] for r in words.collect()}
    assert len(ranked) == 6
    for r in done.collect():
        tagged = rows[r["id"]][2] if r["id"] < 90 else None
        if tagged:
            assert (r["weather_topics"], r["final_weather_words"]) == ("storm", "windy")
        elif r["id"] < 90:
            topic = int(r["labels"].split()[1])
            assert r["final_weather_words"] == ", ".join(ranked[topic, i] for i in range(3))
            own = r["weather_topics"].split(", ")
            assert len(own) == 2 and set(own) <= set(r["lemmatized_text"].split())
        else:
            assert (r["labels"], r["weather_topics"], r["final_weather_words"]) == (None, None, None)
    none, words = fill_by_topics(df.where("id >= 90"), "id")
    assert none.where("labels is not null").count() == 0 and words.count() == 0


def test_a_large_lookup_cannot_be_streamed_silently(spark, tmp_path):
    schema = "text string, account string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stream = read_post_stream(spark, str(tmp_path / "in"), schema)
    mapping = spark.createDataFrame([("a", "b"), ("c", "d")], "word string, mapping string")
    with pytest.raises(ValueError, match="stream"):
        keywords.map_conditions(stream, "text", mapping, max_keys=1)


def test_staging_uses_the_folder_of_the_session(spark):
    df = staging.stage(spark.range(5), "numbers")
    assert df.count() == 5
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]


def test_small_tables_are_spread_large_ones_are_not(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert readers.spread(one, "id").select(F.spark_partition_id()).distinct().count() > 1
    assert readers.spread(many, "id") is many
