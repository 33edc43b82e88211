"""Topics, sentiment, classifier, TF-IDF."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
from conftest import column
from pyspark.ml.clustering import LDA
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postlens.functions.labels import CLIMATE_SENTIMENT_LABELS, TWITTER_SENTIMENT_LABELS
from postlens.functions.special import digamma, trigamma
from postlens.operators import classify, epochs, selection, sentiment, tfidf, tone, topics
from postlens.operators.dirichlet import newton_step, newton_step_table
from postlens.plans import catalog
from postlens.plans.train import run_training
from postlens.sources.staging import stage
from postlens.sources.writers import load_model, save_model


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = ["sun", "beach", "sand", "sea"] if i % 2 else ["snow", "ice", "ski", "frost"]
        text = " ".join(rng.choice(words) for _ in range(rng.randint(2, 12)))
        rows.append((i, text, "storm" if i % 10 == 0 else None))
    rows += [(900, None, None), (901, "", None)]
    return spark.createDataFrame(rows, "id int, lemmatized_text string, weather_topics string").cache()


@pytest.fixture(scope="module")
def model(corpus):
    return topics.fit_topics(corpus, "id", k=2, mini_batch=0.5)


def test_topics_only_on_eligible_rows(corpus, model):
    out = topics.assign_topics(corpus, model)
    assert out.columns == [*corpus.columns, "dominant_topic", "top_3_words"]
    words = topics.topic_words(model)
    n_topics = 0
    for r in out.collect():
        eligible = r["weather_topics"] is None and r["lemmatized_text"] and len(r["lemmatized_text"].split()) > 3
        assert (r["dominant_topic"] is not None) == bool(eligible)
        if eligible:
            assert r["top_3_words"] == ", ".join(words[r["dominant_topic"]])
            n_topics += 1
    assert n_topics > 50


def test_topics_separate_the_two_themes(corpus, model):
    got = {}
    for r in topics.assign_topics(corpus, model).where("dominant_topic is not null").collect():
        got.setdefault(r["dominant_topic"], set()).update(r["lemmatized_text"].split())
    assert len(got) == 2
    assert not set(got[0]) & set(got[1])


def weight_rows(model):
    words = model.weights.join(model.terms, "index").orderBy("index").collect()
    return [(r["index"], r["token"], r["tf"], tuple(r["weights"]), r["prior"]) for r in words]


@pytest.mark.parametrize("options", [{}, {"mini_batch": 0.5}, {"learn_prior": True, "max_iter": 3}])
def test_the_fit_repeats_to_the_last_bit_whatever_the_layout(corpus, options, spark):
    one = topics.fit_topics(corpus, "id", k=2, **options)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = topics.fit_topics(corpus.repartition(7), "id", k=2, **options)
        assert weight_rows(two) == weight_rows(one)
        assert (two.totals, two.alpha) == (one.totals, one.alpha)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_vocabulary_is_ordered_by_count_then_spelling(corpus, model):
    counts = Counter()
    for r in corpus.where(topics.topic_eligible()).collect():
        counts.update(r["lemmatized_text"].split())
    order = sorted(counts, key=lambda w: (-counts[w], w))
    assert [r[:3] for r in weight_rows(model)] == [(i, w, counts[w]) for i, w in enumerate(order)]


@pytest.mark.parametrize("partitions", [1, 2, 7, 50])
def test_numbers_do_not_depend_on_ranges(spark, partitions):
    rng = random.Random(3)
    rows = [(f"w{i}", rng.choice([1, 1, 1, 2, 5])) for i in range(300)] + [("é", 5), ("Z", 5)]
    terms = spark.createDataFrame(rows, "token string, tf long").repartition(5)
    got = topics.number_words(terms, partitions)
    assert got.columns == ["index", "token", "tf"]
    assert sorted((r["index"], r["token"]) for r in got.collect()) == list(
        enumerate(w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0].encode())))
    )
    assert topics.number_words(terms.limit(0), partitions).count() == 0


def test_each_update_counts_every_token_once(corpus, model):
    full = topics.fit_topics(corpus, "id", k=2, max_iter=4)
    left = math.prod(1 - (1 + t) ** topics.DECAY for t in range(1, 5))
    for _, _, tf, weights, prior in weight_rows(full):
        assert abs(sum(weights) - (2 * left + (1 - left) * (2 * prior + tf))) < 1e-4


def mean_token_log(rows, shares, alpha):
    """Mean log probability of the tokens under inferred posts; ``shares`` is k x words."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for r in rows for w in r}))}
    total = n = 0
    for words in rows:
        ids, counts = np.unique([vocabulary[w] for w in words], return_counts=True)
        theta = np.full(len(alpha), 1 / len(alpha))
        for _ in range(200):
            own = theta[:, None] * shares[:, ids]
            theta = (own / own.sum(axis=0) * counts).sum(axis=1) + alpha
            theta /= theta.sum()
        total += (np.log(theta @ shares[:, ids]) * counts).sum()
        n += counts.sum()
    return total / n


@pytest.mark.parametrize("source", ["themes", "documents"])
def test_topics_explain_the_tokens_as_well_as_those_of_the_library(spark, corpus, source, data_dir):
    if source == "themes":
        df, k = corpus, 2
    else:
        df = spark.read.parquet(f"{data_dir}/documents.parquet").where("length(text) < 1500")
        df = df.selectExpr("doc_id as id", "lower(text) as lemmatized_text", "null as weather_topics")
        df, k = df.cache(), 4
    everything = topics.any_text()
    mine = topics.fit_topics(df, "id", k=k, eligible=everything)
    rows = [r["lemmatized_text"].split() for r in df.where(everything).orderBy("id").collect()]
    vocabulary = sorted({w for r in rows for w in r})
    own = {token: w for _, token, _, w, _ in weight_rows(mine)}
    shares = np.array([own[w] for w in vocabulary]).T
    mine_log = mean_token_log(rows, shares / shares.sum(axis=1, keepdims=True), mine.alpha)
    number = {w: i for i, w in enumerate(vocabulary)}
    bags = [sorted(Counter(number[w] for w in r).items()) for r in rows]
    vectors = [
        (Vectors.sparse(len(vocabulary), [i for i, _ in b], [float(n) for _, n in b]),) for b in bags
    ]
    lda = LDA(k=k, maxIter=10, seed=42, optimizer="online", docConcentration=[0.5],
              topicConcentration=0.1, subsamplingRate=1.0, learningOffset=1.0)
    theirs = lda.fit(spark.createDataFrame(vectors, ["features"])).topicsMatrix().toArray().T
    theirs_log = mean_token_log(rows, theirs / theirs.sum(axis=1, keepdims=True), mine.alpha)
    assert mine_log > theirs_log - 0.02 * abs(theirs_log)


def test_a_large_model_assigns_as_a_small_one(corpus, model):
    small = topics.assign_topics(corpus, model)
    for way in ({"id_col": "id"}, {}):
        large = topics.assign_topics(corpus, model, max_bytes=0, **way)
        assert large.columns == small.columns
        assert sorted(large.collect(), key=lambda r: r["id"]) == sorted(small.collect(), key=lambda r: r["id"])


def test_words_fall_to_topics_in_shares(corpus, model):
    rows = topics.token_responsibilities(corpus, model, "id").collect()
    bags, weights = {}, {}
    for r in rows:
        bags.setdefault((r["id"], r["token"]), []).append(r["share"])
        weights.setdefault(r["id"], [0.5, 0.5])[r["topic"]] += r["n"] * r["share"]
    assert all(len(s) == 2 and abs(sum(s) - 1) < 1e-9 for s in bags.values())
    told = column(topics.assign_topics(corpus, model), "dominant_topic")
    for r in corpus.where(topics.topic_eligible()).collect():
        assert {t for i, t in bags if i == r["id"]} == set(r["lemmatized_text"].split())
        assert told[r["id"]] == int(np.argmax(weights[r["id"]]))
    unknown = corpus.selectExpr("id", "'zz zz zz zz' as lemmatized_text", "null as weather_topics")
    assert topics.token_responsibilities(unknown, model, "id").count() == 0
    assert topics.assign_topics(unknown, model).where("dominant_topic is null").count() == 0


def test_derivatives_of_log_gamma():
    # Digamma and trigamma of 1, 1/2 and 10
    assert np.allclose(digamma(np.array([1, 0.5, 10])), [-0.5772156649015329, -1.9635100260214235, 2.251752589066721], rtol=1e-14)
    assert np.allclose(trigamma(np.array([1, 0.5, 10])), [math.pi**2 / 6, math.pi**2 / 2, 0.10516633568168575], rtol=1e-14)


@pytest.mark.parametrize("known", [[0.3, 1.5, 0.7, 4.0], [0.2] * 25])
def test_known_prior_is_recovered_from_generated_data(spark, known):
    draws = np.random.default_rng(1).dirichlet(known, 3000)
    mean_log = np.log(draws).mean(axis=0)
    rows = [(f"w{i}", 1.0, float(m)) for i, m in enumerate(mean_log)]
    table = spark.createDataFrame(rows, "name string, prior double, mean_log double").repartition(3)
    plain = np.ones(len(known))
    for _ in range(25):
        plain = newton_step(plain, mean_log, 3000)
    assert np.abs(plain / known - 1).max() < 0.1
    step = np.ones(len(known))
    for _ in range(3):
        table = stage(newton_step_table(table, 3000), "prior")
        step = newton_step(step, mean_log, 3000)
    got = column(table, "prior", "name")
    assert np.allclose([got[f"w{i}"] for i in range(len(known))], step, rtol=1e-9)
    assert newton_step_table(table.limit(0), 3).count() == 0


def test_word_priors_follow_the_words(corpus):
    model = topics.fit_topics(corpus, "id", k=2, learn_prior=True, max_iter=4, alpha=0.5)
    priors = {token: prior for _, token, _, _, prior in weight_rows(model)}
    assert min(priors.values()) > 0 and len(set(priors.values())) > 1
    assert model.alpha != (0.5, 0.5)


def test_no_eligible_rows(spark):
    df = spark.createDataFrame([(1, "a b", None)], "id int, lemmatized_text string, weather_topics string")
    assert topics.fit_topics(df, "id") is None
    row = topics.assign_topics(df, None).first()
    assert (row["dominant_topic"], row["top_3_words"]) == (None, None)


def test_topic_model_round_trip(corpus, model, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = topics.TopicModel.load(str(tmp_path / "m"))
    a = column(topics.assign_topics(corpus, model), "dominant_topic")
    assert column(topics.assign_topics(corpus, loaded), "dominant_topic") == a


def test_alternative_settings_use_every_text(corpus):
    model = topics.fit_topics(corpus, "id", eligible=topics.any_text(), k=3, learn_prior=True, max_iter=3, mini_batch=0.5)
    out = topics.assign_topics(corpus, model, eligible=topics.any_text())
    assert out.where("dominant_topic is null").count() == 2
    table = topics.topic_table(model, 2)
    assert table.columns == ["rank", "Topic 0", "Topic 1", "Topic 2"]
    assert table.count() == 2


def test_relevance_words(spark):
    df = spark.createDataFrame([(1, "b a a c c d"), (2, "x"), (3, None)], "id int, lemmatized_text string")
    scores = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 1.0), ("d", 0.5)], "token string, relevance double")
    for way in ({}, {"max_rows": 0}):
        got = column(topics.relevance_words(df, scores, **way), "top_3_relevance_words")
        assert got == {1: "b a c", 2: "", 3: None}


def test_relevance_of_a_model(corpus, model):
    relevance = {r["token"]: r["relevance"] for r in topics.term_relevance(model).collect()}
    rows = weight_rows(model)
    assert set(relevance) == {r[1] for r in rows}
    for _, token, _, weights, _ in rows:
        beta = np.exp(digamma(np.array(weights)) - digamma(np.array(model.totals)))
        assert abs(relevance[token] - beta[beta >= 1e-8].mean()) < 1e-12



def test_label_and_final_words(spark):
    rows = [(1, "a hot day", None, None), (2, "cold hot", "storm", "cold, windy"), (3, "nothing", None, None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, cleaned_text string, weather_topics string, weather_temp string")
    words = [["old"], ["hot", "day"]]
    labelled = topics.label_by_topic_words(df, words)
    assert column(labelled, "labels") == {1: "Topic 1", 2: "Topic 0", 3: None, 4: None}
    assert column(topics.finalize_words(labelled, words), "final_weather_words") == {
        1: "hot, day", 2: "cold, windy", 3: None, 4: None,
    }


@pytest.mark.parametrize("way", [{}, {"max_rows": 0}])
def test_sentiment(spark, way):
    df = spark.createDataFrame([(1, "Good, good!"), (2, "bad"), (3, "so so"), (4, None), (5, "good bad"), (6, "")], "id int, t string")
    scores = spark.createDataFrame([("good", 1.5), ("bad", -1.5)], "w string, s double")
    out = sentiment.lexicon_sentiment(df, "t", scores, score_col="s", **way)
    assert column(out, "lexicon_sentiment") == {
        1: "positive", 2: "negative", 3: "neutral", 4: None, 5: "neutral", 6: "neutral",
    }
    assert column(out, "s")[1] == pytest.approx(3 / math.sqrt(24))
    out = sentiment.polarity_sentiment(df, "t", scores, score_col="s", **way)
    assert column(out, "polarity_sentiment") == column(
        sentiment.lexicon_sentiment(df, "t", scores), "lexicon_sentiment"
    )
    assert column(out, "s") == {1: 1.5, 2: -1.5, 3: 0.0, 4: None, 5: 0.0, 6: 0.0}


def test_predictor_hook_and_comparison(spark):
    def by_length():
        return lambda texts: np.array([[len(t) == i for i in range(3)] for t in texts], dtype="float64")

    df = spark.createDataFrame([(1, ""), (2, "a"), (3, "ab"), (4, None)], "id int, t string")
    out = sentiment.compare_sentiment(
        df,
        "t",
        {
            "a": lambda d, c, name: classify.classify(d, c, by_length, TWITTER_SENTIMENT_LABELS, name),
            "b": lambda d, c, name: classify.classify(d, c, by_length, CLIMATE_SENTIMENT_LABELS, name, batch_size=1),
        },
    )
    assert column(out, "a") == {1: "negative", 2: "neutral", 3: "positive", 4: None}
    assert column(out, "b") == {1: "positive", 2: "neutral", 3: "negative", 4: None}


def test_rule_predictor(spark):
    df = spark.createDataFrame([(1, "ice cold"), (2, "nothing"), (3, None)], "id int, combined_text string")
    rule = classify.rule_predictor((("ice",), (), (), (), ("hot",)))
    got = column(classify.predict_temperature(df, rule), "climate_bert_temp_sentiment")
    assert got == {1: 0, 2: 2, 3: None}


def test_rules_as_a_column_class_like_the_predictor(spark):
    rng = random.Random(1)
    words = ["ice", "icy", "sun", "heat", "mild", "hot", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(rows, "id int, combined_text string")
    rules = (("ice", "ic"), ("cold",), ("mild",), ("sun",), ("hot", "heat"))
    both = [classify.predict_temperature(df, m) for m in (classify.RuleClasses(rules), classify.rule_predictor(rules))]
    one, two = (column(b, "climate_bert_temp_sentiment") for b in both)
    assert one == two and len(set(one.values())) == 5


def test_split_is_disjoint_whole_and_stable(spark):
    df = spark.range(2000)
    a = column(classify.split_train_val(df, "id"), "is_val")
    assert len(a) == 2000
    assert 0.15 < sum(a.values()) / 2000 < 0.25
    assert a == column(classify.split_train_val(df.repartition(9), "id"), "is_val")
    assert a != column(classify.split_train_val(df, "id", seed=1), "is_val")


def test_metrics_equal_a_direct_count(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0, 1, 2, 3]), rng.choice([0, 1, 2, 4])) for _ in range(500)] + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    got = classify.classification_metrics(df).first()
    rows = rows[:500]
    precision = recall = f1 = 0.0
    for c in range(5):
        tp = sum(a == b == c for a, b in rows)
        support, said = sum(a == c for a, _ in rows), sum(b == c for _, b in rows)
        p, r = tp / said if said else 0.0, tp / support if support else 0.0
        precision += p * support / 500
        recall += r * support / 500
        f1 += (2 * p * r / (p + r) if p + r else 0.0) * support / 500
    assert got["accuracy"] == pytest.approx(sum(a == b for a, b in rows) / 500)
    assert got["precision"] == pytest.approx(precision)
    assert got["recall"] == pytest.approx(recall)
    assert got["f1"] == pytest.approx(f1)


def test_training_run(spark, tmp_path):
    rng = random.Random(6)
    words = [["arctic"], ["chilly"], ["mild"], ["warm"], ["scorching"]]
    lines = ["text,label"]
    for i in range(400):
        filler = " ".join(rng.choice("today we had some weather here".split()) for _ in range(4))
        lines.append(f'"{filler} {words[i % 5][0]} {i}",{i % 5}')
    path = tmp_path / "labelled.csv"
    path.write_text("\n".join(lines))
    metrics = run_training(spark, str(path), str(tmp_path / "model"), num_features=256, max_iter=20, reg_params=(0.01, 1.0))
    assert metrics.first()["accuracy"] > 0.95
    model = load_model(str(tmp_path / "model"))
    df = spark.createDataFrame([(1, "so chilly"), (2, "scorching day"), (3, None)], "id int, combined_text string")
    want = {1: 1, 2: 4, 3: None}
    assert column(classify.predict_temperature(df, model), "climate_bert_temp_sentiment") == want
    save_model(model, str(tmp_path / "copy"))
    again = classify.predict_temperature(df, load_model(str(tmp_path / "copy")))
    assert column(again, "climate_bert_temp_sentiment") == want
    assert again.columns == ["id", "combined_text", "climate_bert_temp_sentiment"]


def test_tfidf_equals_direct_arithmetic(spark):
    rows = [("x", "aa bb aa c"), ("x", "bb"), ("y", "bb dd"), ("z", "1 ."), (None, "zz")]
    df = spark.createDataFrame(rows, "g string, t string")
    got = {(r["label"], r["token"]): r["tfidf"] for r in tfidf.tfidf_by_group(df, "g", "t").collect()}
    tf = {"x": {"aa": 2, "bb": 2}, "y": {"bb": 1, "dd": 1}}
    idf = {"aa": math.log(4 / 2) + 1, "bb": math.log(4 / 3) + 1, "dd": math.log(4 / 2) + 1}
    want = {}
    for g, counts in tf.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in counts.items()))
        want.update({(g, w): n * idf[w] / norm for w, n in counts.items()})
    assert got == pytest.approx(want)


def test_fill_words(spark):
    rows = [
        (1, None, "x", "aa bb cc aa"), (2, "kept", "x", "aa bb"), (3, None, None, "aa bb"), (4, None, "x", "abc"),
        (5, None, "y", "aa zz zz"), (6, None, "x", None),
    ]
    df = spark.createDataFrame(rows, "id int, weather_topics string, labels string, lemmatized_text string")
    weights = spark.createDataFrame(
        [("x", "aa", 0.1), ("x", "bb", 0.5), ("x", "cc", 0.5), ("x", "abc", 1.0), ("y", "zz", 0.2)],
        "label string, token string, tfidf double",
    )
    got = column(tfidf.fill_words_by_tfidf(df, weights), "weather_topics")
    assert got == {1: "bb, cc", 2: "kept", 3: None, 4: None, 5: "zz", 6: None}


@pytest.mark.parametrize("way", [{}, {"max_rows": 0}])
def test_restrict_vocab(spark, way):
    df = spark.createDataFrame([(1, "b a x b"), (2, None), (3, "x")], "id int, t string")
    got = column(tfidf.restrict_vocab(df, "t", ["a b", "c"], **way), "Vocab")
    assert got == {1: ["b", "a", "b"], 2: None, 3: []}
    empty = df.select("id", F.lit("").alias("t"))
    assert column(tfidf.restrict_vocab(empty, "t", ["a"]), "Vocab")[1] == []


@pytest.mark.parametrize("name", ["train_temperature_model", "predict_temperature"])
def test_queries_train_with_the_operator_defaults(spark, data_dir, monkeypatch, name):
    fits, sizes = [], []
    regression, features = classify.LogisticRegression, classify._features

    def fit(**options):
        fits.append((options["regParam"], options["maxIter"]))
        return regression(**options | {"maxIter": 1})

    monkeypatch.setattr(classify, "LogisticRegression", fit)
    monkeypatch.setattr(classify, "_features", lambda n: sizes.append(n) or features(n))
    assert catalog.QUERIES[name](spark, data_dir).count() > 0
    assert fits == [(reg, 50) for reg in (0.0, 0.01, 0.1)] and sizes == [1 << 18]


def plain_valence(text, lexicon, rules):
    """The rules word by word."""
    raw = regex.findall(tone.WORD, text)
    words = [w.lower() for w in raw]
    caps = [w.upper() == w and w.lower() != w for w in raw]
    mixed = any(caps) and not all(caps)
    negates = [w in rules.negations or "n't" in w for w in words]
    sign = lambda v: 1.0 if v > 0 else -1.0
    values = []
    for i, word in enumerate(words):
        if word not in lexicon or word in rules.boosters:
            values.append(0.0)
            continue
        v = lexicon[word]
        v += tone.CAPITALS * sign(v) if caps[i] and mixed else 0.0
        for d in (1, 2, 3):
            if i < d or words[i - d] in lexicon:
                continue
            if words[i - d] in rules.boosters:
                b = rules.boosters[words[i - d]] * sign(v)
                b += tone.CAPITALS * sign(v) if caps[i - d] and mixed else 0.0
                v += b * tone.DECAY[d - 1]
            so = any(words[i - e] in tone.AFTER_NEVER for e in range(1, d))
            if words[i - d] == "never" and so:
                v *= tone.NEVER_SO[d - 1]
            elif negates[i - d]:
                v *= tone.NEGATION
        if i >= 1 and words[i - 1] == "least" and "least" not in lexicon:
            if not (i >= 2 and words[i - 2] in ("at", "very")):
                v *= tone.NEGATION
        values.append(v)
    if rules.contrast in words:
        turn = words.index(rules.contrast)
        values = [v * (0.5 if i < turn else 1.5 if i > turn else 1.0) for i, v in enumerate(values)]
    total = sum(values)
    asks = text.count("?")
    marks = min(text.count("!"), 4) * 0.292 + (0.96 if asks > 3 else asks * 0.18 if asks > 1 else 0.0)
    total += marks if total > 0 else -marks if total < 0 else 0.0
    return total / math.sqrt(total * total + 15)


def plain_polarity(text, lexicon, modifiers, negations):
    factor, negated, own = None, False, []
    for word in regex.findall(tone.WORD_OR_MARK, text.lower()):
        if word == "!":
            own[-1:] = [max(-1.0, min(1.0, own[-1] * 1.25))] if own else []
        elif word in modifiers:
            factor = (factor or 1.0) * modifiers[word]
        elif word in negations or "n't" in word:
            negated = True
        elif word in lexicon:
            p = max(-1.0, min(1.0, lexicon[word] * (1.0 if factor is None else factor)))
            own.append(p * -0.5 if negated else p)
            factor, negated = None, False
        else:
            factor = factor if len(word) <= 2 else None
            negated = negated and len(word) <= 1
    return sum(own) / len(own) if own else 0.0


@pytest.mark.parametrize("way", [{}, {"max_rows": 0}])
def test_rules_of_tone_equal_word_by_word(spark, way):
    rng = random.Random(9)
    lexicon = {"good": 1.9, "bad": -2.5, "fine": 0.8, "awful": -2.0, "meh": 0.0}
    words = [*lexicon, "very", "hardly", "not", "never", "so", "this", "at", "least", "but", "a", "is",
             "GOOD", "Bad", "VERY", "isn't", "thing", "!", "?", "!!!", "??", "none", "NOT"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "good"), (903, "never so this good"), (904, "LEAST bad")]
    df = spark.createDataFrame(rows, "id int, t string")
    scores = spark.createDataFrame(list(lexicon.items()), "w string, s double")
    rules = tone.ValenceRules()
    got = tone.valence_sentiment(df, "t", scores, score_col="s", **way)
    valence, label = column(got, "s"), column(got, "valence_sentiment")
    modifiers = {"very": 1.3, "so": 1.2, "hardly": 0.5}
    small = {w: v / 3 for w, v in lexicon.items()}
    small_scores = spark.createDataFrame(list(small.items()), "w string, s double")
    polarity = column(
        tone.modified_polarity(df, "t", small_scores, modifiers, score_col="s", **way), "s"
    )
    for i, text in rows:
        if text is None:
            assert (valence[i], label[i], polarity[i]) == (None, None, None)
            continue
        want = plain_valence(text, lexicon, rules)
        assert valence[i] == pytest.approx(want, abs=1e-12), text
        assert label[i] == ("positive" if want >= 0.05 else "negative" if want <= -0.05 else "neutral")
        assert polarity[i] == pytest.approx(plain_polarity(text, small, modifiers, tone.NEGATIONS), abs=1e-12), text


def test_published_scores_of_valence(spark):
    lexicon = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "bad": -2.5}
    cases = {
        "VADER is smart, handsome, and funny.": 0.8316,
        "VADER is smart, handsome, and funny!": 0.8439,
        "VADER is very smart, handsome, and funny.": 0.8545,
        "VADER is VERY SMART, handsome, and FUNNY.": 0.9227,
        "VADER is VERY SMART, handsome, and FUNNY!!!": 0.9342,
        "VADER is not smart, handsome, nor funny.": -0.7424,
        "The book was good.": 0.4404,
        "The book was only kinda good.": 0.3832,
        "At least it isn't bad": 0.431,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, t string")
    got = column(tone.valence_sentiment(df, "t", lexicon, score_col="s"), "s")
    assert {t: round(got[i], 4) for i, t in enumerate(cases)} == cases


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 6, 99, 100, 101, 1000])
def test_exact_split_has_the_exact_size(spark, n):
    df = spark.range(n).selectExpr("id", "'x' as is_val").repartition(3)
    for share in (0.2, 0.5, 0.07):
        got = selection.split_train_val_exact(df, "id", share)
        order = sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        want = set(order[: math.ceil(round(share * n, 9))])
        assert {r["id"] for r in got.collect() if r["is_val"]} == want


def test_exact_split_keeps_shared_ids_together(spark):
    rows = [(i % 7 if i % 3 else None,) for i in range(60)]
    df = spark.createDataFrame(rows, "id int")
    for seed in (42, 7):
        got = selection.split_train_val_exact(df, "id", 0.3, seed).collect()
        sides = {}
        for r in got:
            sides.setdefault(r["id"], set()).add(r["is_val"])
        assert all(len(s) == 1 for s in sides.values())
        assert sum(r["is_val"] for r in got) >= 18


@pytest.fixture(scope="module")
def labelled_texts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        label = i % 3
        words = [["ice", "snow"], ["mild", "calm"], ["sun", "heat"]][label] + ["the", "a", "of"]
        rows.append((i, " ".join(rng.choice(words) for _ in range(8)), label))
    rows += [(900, None, 1), (901, "ice", None), (902, "", 2)]
    return spark.createDataFrame(rows, "id int, text string, label int").cache()


def epoch_run(df, path, schedule, **options):
    train, val = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    return epochs.train_by_epochs(
        train, val, str(path), "id", classes=3, num_features=64, schedule=schedule, **options
    )


def state_rows(spark, path, epoch):
    rows = spark.read.parquet(f"{path}/epoch-{epoch}").orderBy("feature").collect()
    return [(r["feature"], r["weights"], r["first"], r["second"]) for r in rows]


def test_stopped_and_resumed_training_equals_the_whole(spark, labelled_texts, tmp_path):
    schedule = epochs.Schedule(epochs=4, batches=3)
    epoch_run(labelled_texts, tmp_path / "whole", schedule)
    epoch_run(labelled_texts, tmp_path / "parts", schedule, stop_after=2)
    assert len(epochs.read_progress(spark, str(tmp_path / "parts"))) == 2
    model = epoch_run(labelled_texts.repartition(7), tmp_path / "parts", schedule)
    one, two = (epochs.read_progress(spark, str(tmp_path / p)) for p in ("whole", "parts"))
    assert [p["loss"] for p in one] == [p["loss"] for p in two]
    for e in range(1, 5):
        assert state_rows(spark, tmp_path / "whole", e) == state_rows(spark, tmp_path / "parts", e)
    assert one[-1]["loss"] < one[0]["loss"]
    val = labelled_texts.where("id % 5 = 0 and label is not null")
    scored = classify.predict_temperature(val, model, "text", "prediction")
    assert classify.classification_metrics(scored).first()["accuracy"] > 0.9
    save_model(model, str(tmp_path / "model"))
    again = classify.predict_temperature(val, load_model(str(tmp_path / "model")), "text", "prediction")
    assert again.collect() == scored.collect()


def test_gradient_and_loss_equal_the_dense_formula(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) * (rng.random((40, 6)) < 0.5)
    y, w = rng.integers(0, 3, 40), rng.normal(size=(7, 3))
    rows = [(int(t), np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r, t in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "label int, indices array<int>, values array<double>").repartition(3)
    scores = x @ w[:-1] + w[-1]
    chances = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    miss = chances.copy()
    miss[np.arange(40), y] -= 1
    gradient, n = epochs._gradient(df, w)
    assert n == 40 and np.abs(gradient - np.vstack([x.T @ miss, miss.sum(axis=0)]) / 40).max() < 1e-8
    assert abs(epochs._loss(df, w) + np.log(chances[np.arange(40), y]).mean()) < 1e-8
    assert epochs._loss(df.limit(0), w) == 0.0


def test_best_epoch_stays_and_patience_ends(spark, labelled_texts, tmp_path, monkeypatch):
    losses = iter([3.0, 1.0, 2.0, 2.5, 9.0])
    monkeypatch.setattr(epochs, "_loss", lambda rows, weights: next(losses))
    schedule = epochs.Schedule(epochs=5, batches=2, patience=2)
    model = epoch_run(labelled_texts, tmp_path, schedule)
    assert [p["loss"] for p in epochs.read_progress(spark, str(tmp_path))] == [3.0, 1.0, 2.0, 2.5]
    best = {f: w for f, w, _, _ in state_rows(spark, tmp_path, 2)}
    kept = model.stages[-1].coefficientMatrix.toArray()
    assert all(np.allclose(kept[:, f], w) for f, w in best.items() if f < 64)
