"""Lemmas, glossary, countries, places: constant and joined way, and brute force."""

import random

import pandas as pd
import pytest
from conftest import column
from pyspark.sql import functions as F

from postlens.functions.lemma import NOUN_SUFFIXES
from postlens.functions.token_table import TokenTable, annotate_tokens
from postlens.operators import glossary, keywords, places, sentiment, text_prep

BOTH_WAYS = [{}, {"max_rows": 0}]


@pytest.mark.parametrize("pairs", [{}, {"a": "1"}, {f"k{i}": f"v{i}" for i in range(5000)}])
def test_constant_and_join_find_the_same(spark, pairs):
    rng = random.Random(3)
    keys = list(pairs)[:20] + ["x", "ß", ""]
    rows = [(i, [rng.choice(keys) for _ in range(rng.randint(0, 9))]) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    frame = spark.createDataFrame(list(pairs.items()), "k string, v string")
    for misses in (False, True):
        want = {
            i: [(p, w, pairs.get(w)) for p, w in enumerate(t or []) if misses or w in pairs] for i, t in rows
        }
        for table in (TokenTable.of(frame), TokenTable.joined(frame), TokenTable.of(pairs)):
            out = annotate_tokens(df, F.col("t"), table, "h", misses)
            got = {r["id"]: [tuple(h) for h in r["h"]] for r in out.collect()}
            assert got == want


def test_a_table_over_a_bound_stays_a_dataframe(spark):
    frame = spark.range(100).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("x"), 1000).alias("v"))
    assert TokenTable.of(frame).is_constant
    assert not TokenTable.of(frame, max_rows=99).is_constant
    assert not TokenTable.of(frame, max_bytes=50_000).is_constant


def test_null_keys_and_values_are_no_entries(spark):
    frame = spark.createDataFrame([("a", None), (None, "b"), ("c", "d")], "k string, v string")
    assert TokenTable.of(frame).pairs == {"c": "d"}


def noun_lemma(word, lexicon, exceptions):
    """The published algorithm, straight from its description."""
    if word in exceptions:
        known = [f for f in [word, exceptions[word]] if f in lexicon]
        return min(known, key=len) if known else word
    forms, first = [word], True
    while forms:
        grown = [f[: len(f) - len(a)] + b for f in forms for a, b in NOUN_SUFFIXES if f.endswith(a)]
        known = [f for f in (forms + grown if first else grown) if f in lexicon]
        if known:
            return min(known, key=len)
        forms, first = grown, False
    return word


@pytest.mark.parametrize("way", BOTH_WAYS)
def test_lemmas_equal_brute_force(spark, way):
    rng = random.Random(11)
    stems = ["dog", "bus", "lens", "wolf", "box", "quiz", "church", "bush", "man", "city", "yes", "s", "men", "mas", "a"]
    ends = ["", "s", "ss", "es", "ses", "ves", "xes", "zes", "ches", "shes", "men", "mens", "ies", "sss", "sses"]
    words = sorted({rng.choice(stems) + rng.choice(ends) + rng.choice(["", "", "s", "es"]) for _ in range(400)})
    words += [w[:-1] + e for w in stems for e in ("ies", "ves") if len(w) > 1]
    lexicon = [*stems, "buses", "mensa", "woman", "goose"]
    exceptions = {"dogses": "dog", "geese": "goose", "boxs": "nowhere", "churchmen": "man"}
    words += list(exceptions)
    rows = [(i, words[i : i + 7]) for i in range(0, len(words), 7)] + [(-1, None), (-2, [])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    frame = spark.createDataFrame([(w,) for w in lexicon], "w string")
    got = column(text_prep.lemmatize(df, "t", exceptions, frame, "l", **way), "l")
    for i, tokens in rows:
        assert got[i] == (tokens and [noun_lemma(t, lexicon, exceptions) for t in tokens] or tokens), i


def test_prepare_text(spark):
    df = spark.createDataFrame([(1, "The 3 Dogs cannot see https://x.yz/a"), (2, None), (3, "")], "id int, text string")
    out = text_prep.prepare_text(df, lexicon=["dog"])
    assert column(out, "cleaned_text") == {1: "the dogs cannot see", 2: None, 3: ""}
    assert column(out, "lemmatized_text") == {1: "dog see", 2: None, 3: ""}
    assert out.columns == ["id", "text", "cleaned_text", "lemmatized_text"]
    with pytest.raises(ValueError, match="missing column"):
        text_prep.prepare_text(df, "body")


@pytest.fixture(scope="module")
def cities(spark):
    rows = [
        (1, "Bath", "United Kingdom", "GB", "GBR"),
        (2, "rewh", "france", "fr", "fra"),
        (3, "rewh", "spain", "es", "esp"),
        (4, "reno", "united states", "us", "usa"),
        (5, "fr", "germany", "de", "deu"),
        (6, "new york", "united states", "us", "usa"),
        (7, "nowhere", None, "zz", "zzz"),
    ]
    return spark.createDataFrame(rows, "row_no int, city string, country string, iso2 string, iso3 string")


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        (1, "bath usa"), (2, "united states"), (3, "x rewh bath"), (4, ""), (5, None), (6, "fr"), (7, "FRANCE"),
        (8, "zz nowhere"), (9, "storm near new york and paris"), (10, "paris iceland new york city york"),
    ]
    return spark.createDataFrame(rows, "id int, t string")


@pytest.mark.parametrize("way", BOTH_WAYS)
def test_country_of_the_first_known_word(spark, texts, cities, way):
    got = column(places.map_country(texts, "t", cities, **way), "country")
    want = {1: "united kingdom", 3: "spain", 6: "france", 7: "france"}
    assert got == {i: want.get(i, "Unknown") for i in range(1, 11)}


def test_city_first_priority(spark, texts, cities):
    got = column(places.map_country(texts, "t", cities, priority=places.CITY_FIRST), "country")
    assert got[6] == "germany"
    assert got[7] == "france"


def leftmost_longest(words, names):
    out, i = [], 0
    while i < len(words):
        for n in range(len(words) - i, 0, -1):
            if " ".join(words[i : i + n]) in names:
                out.append(" ".join(words[i : i + n]))
                i += n
                break
        else:
            i += 1
    return ", ".join(out) or None


@pytest.mark.parametrize("way", BOTH_WAYS)
def test_places_equal_brute_force(spark, way):
    rng = random.Random(5)
    names = {"a", "a b", "b c d e", "c", "c d", "e a b", "iceland"}
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 14)))) for i in range(200)]
    rows += [(900, None), (901, "x iceland b c d"), (902, "B C D E")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = column(places.extract_places(df, "t", sorted(names - {"iceland"}), **way), "places")
    for i, text in rows:
        assert got[i] == leftmost_longest((text or "").lower().split(), names), text


@pytest.mark.parametrize("way", BOTH_WAYS)
def test_very_many_places_start_with_one_word(spark, way):
    names = spark.range(100_000).selectExpr("concat('san p', id, if(id % 2 = 0, ' bay', '')) as name")
    rows = [(1, "near san p7 and san p8 bay"), (2, "san p8"), (3, "San San p100001"), (4, "san")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = column(places.extract_places(df, "t", names, **way), "places")
    assert got == {1: "san p7, san p8 bay", 2: None, 3: None, 4: None}


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "in a b", 5, 6)], "id int, t string, places int, _id int")
    for way in BOTH_WAYS:
        got = places.extract_places(df, "t", ["a b"], **way).first().asDict()
        assert got["places"] == "a b" and got["id"] == 1


def test_final_location_and_region(spark, texts, cities):
    out = places.with_region(places.final_location(texts, "t", cities, ["new york", "paris"]))
    location, region = column(out, "final_location"), column(out, "region")
    assert location[1] == "united kingdom" and region[1] == "EU"
    assert location[9] == "new york, paris" and region[9] == "Other"
    assert location[10] == "paris, iceland, new york"
    assert location[5] == "Unknown" and region[5] == "Unknown"


def test_place_model_sees_only_rows_without_a_country(spark, texts, cities):
    def load():
        return lambda batch: pd.Series(["seen " + t for t in batch], index=batch.index)

    got = column(places.final_location(texts, "t", cities, predictor=load), "final_location")
    assert got[1] == "united kingdom"
    assert got[2] == "seen united states"
    assert got[5] == "Unknown"


def test_regions(spark):
    rows = [("Iceland", "EU"), ("United States", "US"), ("unknown", "Unknown"), ("paris, london", "Other"),
            ("moldova", "Other"), ("kosovo", "Other"), ("russia", "EU"), (None, "Unknown")]
    df = spark.createDataFrame(rows, "final_location string, want string")
    assert all(r["region"] == r["want"] for r in places.with_region(df).collect())


@pytest.mark.parametrize("way", BOTH_WAYS)
def test_glossary(spark, way):
    df = spark.createDataFrame([(1, "a b C b"), (2, None), (3, "q"), (4, "")], "id int, t string")
    terms = spark.createDataFrame([("b", "def"), ("a", "never"), ("two words", "x")], "term string, definition string")
    words = spark.createDataFrame([("a",), ("C",)], "w string")
    got = column(glossary.map_glossary(df, "t", terms, words, **way), "Glossary_Map")
    assert got == {1: "a, def, c, def", 2: None, 3: "", 4: ""}


@pytest.mark.parametrize("way", BOTH_WAYS)
def test_repeated_and_null_ids_and_repeated_keys(spark, way):
    rows = [(1, "b good"), (1, "bad"), (None, "good"), (None, "b q"), (2, "good"), (2, "good"), (3, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    terms = spark.createDataFrame([("b", "d2"), ("b", "d1"), ("b", None)], "term string, definition string")
    words = spark.createDataFrame([("good",), ("good",)], "w string")
    scores = spark.createDataFrame([("good", 3.0), ("good", 1.0), ("bad", -1.0), ("bad", None)], "w string, s double")
    out = glossary.map_glossary(df, "t", terms, words, **way)
    out = sentiment.polarity_sentiment(out, "t", scores, "p", "s", **way)
    got = {(r["id"], r["t"], r["Glossary_Map"], r["s"]) for r in out.collect()}
    assert got == {
        (1, "b good", "d1, good", 1.0), (1, "bad", "", -1.0), (None, "good", "good", 1.0), (None, "b q", "d1", 0.0),
        (2, "good", "good", 1.0), (3, None, None, None),
    }
    assert out.count() == len(rows)
    assert "_row_id" not in out.columns


@pytest.mark.parametrize("way", [{}, {"max_keys": 0}])
def test_keywords_with_repeated_and_null_ids(spark, way):
    df = spark.createDataFrame([(1, "storm"), (1, "heat"), (None, "storms"), (None, "x")], "id int, t string")
    mapping = spark.createDataFrame([("storm", "cold"), ("storm", "wet"), ("heat", "warm")], "word string, mapping string")
    out = keywords.map_conditions(df, "t", mapping, **way)
    got = {(r["id"], r["t"], r["weather_topics"], r["weather_temp"]) for r in out.collect()}
    storm = ("storm", "cold, wet")
    assert {(i, t, x, y) for i, t, x, y in got if t != "x"} == {(1, "storm", *storm), (1, "heat", "heat", "warm"), (None, "storms", *storm)}
    assert (None, "x", None, None) in got
