"""The topic fit and the joined steps on many posts and words: nothing is worked out again and again."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.operators import topic_inference, topics
from postlens.operators.dirichlet import newton_step, newton_step_table
from postlens.functions import text as T
from postlens.operators import places
from postlens.plans import catalog
from postlens.plans.analyze import Lookups, enrich_posts
from postlens.sources.staging import stage, staging_folder


def test_posts_of_different_lengths_step_together(monkeypatch):
    calls = []
    log_mean = topic_inference.log_mean
    monkeypatch.setattr(topic_inference, "log_mean", lambda w: (calls.append(len(w)), log_mean(w))[1])
    rng = np.random.default_rng(1)
    sizes = np.array([5, 20, 40, 100, 300, 0, 700, 2000])
    words, counts = rng.integers(0, 50, sizes.sum()), 1.0 + rng.integers(0, 3, sizes.sum())
    beta, alpha = rng.random((50, 4)), np.full(4, 0.5)
    out = topic_inference.infer(sizes, words, counts, beta, alpha, 20, 0.0)
    assert len(calls) <= 21
    shares = np.zeros_like(out.shares)
    taken = topic_inference.infer(sizes, words, counts, beta, alpha, 20, 0.0, shares.__setitem__)
    assert (shares == out.shares).all() and (taken.gamma == out.gamma).all() and not len(taken.shares)


def test_a_prior_in_cells_takes_the_same_steps(spark):
    rng = np.random.default_rng(2)
    prior, mean_log = np.full(30, 0.1), np.log(rng.dirichlet(np.full(30, 0.7), 200)).mean(axis=0)
    cuts = [0, 4, 19, 30]
    want = prior
    for _ in range(3):
        want = newton_step(want, mean_log, 200)
        rows = [(i, prior[a:b].tobytes(), mean_log[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        table = stage(spark.createDataFrame(rows, "slab int, prior binary, mean_log binary"), "prior")
        moved = newton_step_table(table, 200).orderBy("slab").collect()
        prior = np.concatenate([np.frombuffer(r["prior"]) for r in moved])
        assert np.allclose(prior, want, rtol=1e-9)
    empty = spark.createDataFrame([], "slab int, prior binary, mean_log binary")
    assert newton_step_table(empty, 3).count() == 0


POSTS = [(i % 17, " ".join(f"w{(i * j) % (7 + i % 5)}" for j in range(1, 4 + i % 9))) for i in range(60)]


@pytest.fixture(scope="module")
def posts(spark):
    df = spark.createDataFrame([*POSTS, (None, "w1 w2 w3 w4"), (3, None), (4, "")], f"id int, {C.LEMMATIZED_TEXT} string")
    return stage(df.withColumn(C.WEATHER_TOPICS, F.lit(None).cast("string")), "posts")


def test_a_fit_is_the_same_whatever_the_blocks_and_slabs(spark, posts, monkeypatch):
    found = []
    for entries, words in ((1 << 20, 1 << 14), (16, 2)):
        for name, value in (("BLOCK_ENTRIES", entries), ("SLAB_WORDS", words), ("LEAST_ENTRIES", entries), ("LEAST_WORDS", words)):
            monkeypatch.setattr(topics, name, value)
        model = topics.fit_topics(posts, "id", k=3, max_iter=3)
        weights = {r["token"]: (r["weights"], r["prior"]) for r in model.weights.join(model.terms, "index").collect()}
        shares = topics.token_responsibilities(posts, model, "id").collect()
        joined = topics.assign_topics(posts, model, id_col="id", max_bytes=0)
        found.append((weights, model.totals, sorted(map(str, shares)), sorted(map(str, joined.collect()))))
    assert found[0] == found[1]
    tokens = sum(len(t.split()) for _, t in POSTS if len(t.split()) > 3) + 4
    left = math.prod(1 - (1 + t) ** topics.DECAY for t in range(1, 4))
    counted = sum((sum(w) - 3 * left) / (1 - left) - 3 * topics.BETA for w, _ in found[0][0].values())
    assert round(counted, 3) == tokens


def test_updates_leave_no_tables_behind(spark, posts):
    def staged(updates):
        before = set(os.listdir(staging_folder(spark)))
        topics.fit_topics(posts, "id", k=3, max_iter=updates, learn_prior=True)
        return len(set(os.listdir(staging_folder(spark))) - before)

    assert staged(1) == staged(4)


def test_shares_are_counted_in_one_shuffle(spark, monkeypatch):
    rows = [(1, "a", 2, t, 0.25) for t in range(4)] + [(1, "b", 1, t, 0.5) for t in (0, 0, 2)] + [(None, "a", 3, 1, 1.5)]
    shares = spark.createDataFrame(rows, "doc_id int, token string, n long, topic int, share double")
    monkeypatch.setattr(catalog, "_fit", lambda *a, **o: (None, None))
    monkeypatch.setattr(catalog.topics, "token_responsibilities", lambda *a, **o: shares)
    done = catalog.token_responsibilities(spark, "")
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert dict(done.dtypes)["topics"] == "bigint"
    assert sorted(map(tuple, done.collect()), key=str) == [
        (1, "a", 2, 4, 1.0, True), (1, "b", 1, 2, 1.5, True), (None, "a", 3, 1, 1.5, False),
    ]


def test_joined_steps_read_written_columns(spark):
    texts = [(1, "Cold rain in Paris, France"), (1, "warmer NEW york"), (None, None), (2, "old york")]
    df = spark.createDataFrame(texts, "id int, text string")
    cities = [(1, "paris", "france", "fr", "fra"), (2, "york", "united kingdom", "uk", "gbr")]
    cities = spark.createDataFrame(cities, "row_no int, city string, country string, iso2 string, iso3 string")
    mapping = spark.createDataFrame([("cold", "cold"), ("arm", "warm")], "word string, mapping string")
    lookups = Lookups(mapping, cities.where("row_no = 1"), places=["new york", "york"], stop_words=["in"])
    done = enrich_posts(df, lookups, max_rows=0)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert T.BLANKS not in plan  # the texts were cleaned once, and written
    columns = ("id", C.LEMMATIZED_TEXT, C.WEATHER_TOPICS, C.FINAL_LOCATION, C.REGION)
    assert sorted(map(tuple, done.select(*columns).collect()), key=str) == sorted(
        map(tuple, enrich_posts(df, lookups).select(*columns).collect()), key=str
    )
    found = places.map_country(df, "text", cities, max_rows=0)
    assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == ["id", "text", "country"]
    assert sorted(r["country"] for r in found.collect()) == ["Unknown", "france", "united kingdom", "united kingdom"]
