"""Steps that must hold on tables of any size and layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.functions import token_table
from postlens.functions.token_table import TokenTable
from postlens.operators import classify, epochs, keywords, text_prep, topic_inference
from postlens.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()

TEXTS = ["The tionheed word is here", "deux mots dans une phrase", "", None, "ein Satz mit Worten"]


def write_tables(spark, folder, files):
    """``documents`` and ``benchmark`` as folders of files, or as single files."""
    docs = spark.createDataFrame([(i, t, "en", "src1", 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(0, "notablewords phrasing satzzeichen"), (1, "deux phrasewords")], "item_id long, text string")
    for name, df in (("documents", docs), ("benchmark", items)):
        if files > 1:
            df.repartition(files).write.parquet(f"{folder}/{name}.parquet")
        else:
            df.toPandas().to_parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("files", [1, 3])
def test_a_stream_reads_a_table_of_one_file_or_of_several(spark, tmp_path, files):
    rows = catalog.stream_enrichment(spark, write_tables(spark, tmp_path, files)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(TEXTS)))
    assert {r["doc_id"]: r["weather_topics"] for r in rows}[0] == "heed, tion"


def test_a_large_lexicon_that_changes_few_words_joins_no_tokens(spark):
    df = spark.createDataFrame([(1, ["dogs", "ran", "boxes"]), (2, None)], "id int, tokens array<string>")
    lexicon = [f"word{i}" for i in range(20)] + ["dog", "box"]
    done = text_prep.lemmatize(df, "tokens", {}, lexicon, max_rows=10)
    assert "Join" not in plan_of(done) and "CoGroup" not in plan_of(done)
    assert {r["id"]: r["lemmas"] for r in done.collect()} == {1: ["dog", "ran", "box"], 2: None}


def test_a_joined_table_meets_the_distinct_tokens_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_table, "BLOCK_TOKENS", 8)
    rows = [(1, ["a", "b", "a"]), (1, ["b", "z"] * 30), (None, None), (2, []), (3, ["a", None])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    table = TokenTable.of(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), max_rows=0)
    for misses in (False, True):
        done = token_table.annotate_tokens(df, F.col("tokens"), table, "hits", misses)
        assert "posexplode" not in plan_of(done).lower()
        found = sorted((str(r["id"]), [tuple(h) for h in r["hits"]]) for r in done.collect())
        pairs = {"a": 1, "b": 2}
        want = [
            (str(i), [(p, t, pairs.get(t)) for p, t in enumerate(ts or []) if misses or t in pairs])
            for i, ts in rows
        ]
        assert sorted(found, key=str) == sorted(want, key=str)


def test_prepared_texts_meet_a_joined_table_beside_their_own_tokens(spark):
    df = spark.createDataFrame([(1, "Two dogs, gonna"), (2, None)], "id int, text string")
    done = text_prep.prepare_text(df, "text", ["two"], {}, ["dog"], max_rows=0)
    assert {r["id"]: r["lemmatized_text"] for r in done.collect()} == {1: "dog gon na", 2: None}


def test_keys_of_a_large_table_are_looked_up_by_blocks_of_posts(spark):
    df = spark.createDataFrame([(1, "rewarm the cold cold"), (1, "nothing"), (None, None)], "id int, t string")
    keys = spark.createDataFrame([("arm", "hot"), ("cold", "cold"), ("co", None)], "word string, mapping string")
    done = keywords.map_conditions(df, "t", keys, max_keys=0, conditions_col="c")
    got = sorted((str(r["t"]), r["weather_topics"], r["weather_temp"], r["c"]) for r in done.collect())
    assert got == [
        ("None", None, None, None),
        ("nothing", None, None, None),
        ("rewarm the cold cold", "arm, co, cold", "cold, hot", ["cold", "hot"]),
    ]


def test_a_classifier_is_trained_on_no_more_parts_than_cores(spark, monkeypatch):
    parts = []
    fit = classify.LogisticRegression.fit
    monkeypatch.setattr(
        classify.LogisticRegression, "fit", lambda self, rows: (parts.append(rows.rdd.getNumPartitions()), fit(self, rows))[1]
    )
    rows = [(f"{'hot' if i % 2 else 'cold'} day {i}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "text string, label int").repartition(23)
    classify.train_temperature_model(df, df.limit(0), max_iter=2, reg_params=(0.1,))
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism


def test_posts_of_a_block_are_inferred_in_few_large_steps(monkeypatch):
    calls = []
    steps = topic_inference._steps
    monkeypatch.setattr(topic_inference, "_steps", lambda *a: (calls.append(a[1].shape), steps(*a))[1])
    rng = np.random.default_rng(0)
    sizes = np.array([0, 3, 9, 8, 500, 7])
    words, counts = rng.integers(0, 50, sizes.sum()), 1.0 + rng.integers(0, 3, sizes.sum())
    beta, alpha = rng.random((50, 4)), np.full(4, 0.5)
    out = topic_inference.infer(sizes, words, counts, beta, alpha, 100, 1e-6)
    assert sorted(calls) == [(1, 16), (1, 512), (3, 8)]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes):
        own = slice(begins[i], begins[i] + n)
        want = alpha + (out.shares[own] * counts[own, None]).sum(axis=0)
        assert np.allclose(out.gamma[i], want)


def test_phrases_are_sought_around_their_anchor_piece(spark, monkeypatch):
    calls = []
    look_up = keywords.annotate_tokens
    monkeypatch.setattr(keywords, "annotate_tokens", lambda *a, **o: (calls.append(a[3]), look_up(*a, **o))[1])
    texts = ["old town hall", "a  b old town", "town old", "hall of the old towns and old town hall", "xold town h", "", None, "b old"]
    words = ["ld town ha", "old town", "  b", "he old to", " old town hall", "town ", "own old", "hall", "of the old towns and o"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id int, t string")
    keys = spark.createDataFrame([(w, f"c{i % 3}") for i, w in enumerate(words)], "word string, mapping string")
    got = keywords.map_conditions(df, "t", keys, phrases=True, max_keys=0).collect()
    want = {t: ", ".join(sorted(w for w in words if t and w in t)) or None for t in texts}
    assert len(got) == len(texts) and {r["t"]: r["weather_topics"] for r in got} == want
    assert len(calls) == 2  # the words' keys, and the phrases by blocks of posts


def test_a_step_of_an_epoch_reads_its_own_batch_and_counts_it_on_the_way(spark, tmp_path, monkeypatch):
    folders = []
    path = epochs.staging_path
    monkeypatch.setattr(epochs, "staging_path", lambda s, name: (folders.append(path(s, name)), folders[-1])[1])
    monkeypatch.setattr(epochs, "_loss", lambda rows, weights: 0.0)
    df = spark.createDataFrame([(i, f"hot day {i}", i % 2) for i in range(30)], "id int, text string, label int")
    schedule = epochs.Schedule(epochs=1, batches=3)
    epochs.train_by_epochs(df, df.limit(0), str(tmp_path / "run"), "id", classes=2, num_features=64, schedule=schedule)
    batches = [spark.read.parquet(f"{folders[0]}/batch={b}") for b in range(3)]
    weights = np.zeros((65, 2))
    counted = [epochs._gradient(rows, weights) for rows in batches]
    assert sum(n for _, n in counted) == 30
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        again = [epochs._gradient(rows, weights) for rows in batches]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for (g, n), (h, m) in zip(counted, again, strict=True):
        assert n == m and (g == h).all()
