import random
import re

import pytest
from conftest import column

from postlens.operators import keywords
from postlens.sources.readers import read_mapping

# A keyword mapping as users ship it, byte order mark included.
MAPPING_CSV = """﻿word,EU,USA,need_location
polarvortex,"warm, windy","warm, windy",0
PV,"warm, windy","warm, windy",0
stratospheric warming,cold,cold,0
NAOnegative,"cold, not windy","cold, not windy",0
NAO-,"cold, not windy","cold, not windy",0
NAO,"warm, windy","warm, windy",0
storm,"cold, windy","cold, windy",1
"""


@pytest.fixture(scope="module")
def mapping(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("mapping") / "words.csv"
    path.write_text(MAPPING_CSV, encoding="utf-8")
    rows = read_mapping(spark, str(path))
    assert rows.columns == ["word", "EU", "USA", "need_location", "row_no"]
    unpivoted = keywords.unpivot_mapping(rows)
    assert unpivoted.count() == 14
    return keywords.dedupe_mapping(unpivoted)


CASES = [
    (1, "brainstorm today", "storm", "cold, windy"),
    (2, "naonegative", "nao, naonegative", "cold, not windy, warm, windy"),
    (3, "stratospheric warming", None, None),
    (4, "PVC pipes", "pv", "warm, windy"),
    (5, "sto rm", None, None),
    (6, "", None, None),
    (7, None, None, None),
    (8, "nao-", "nao", "warm, windy"),
]


@pytest.mark.parametrize("way", [{}, {"max_keys": 0}])
def test_conditions(spark, mapping, way):
    df = spark.createDataFrame([c[:2] for c in CASES], "id int, t string")
    out = keywords.map_conditions(df, "t", mapping, conditions_col="c", **way)
    topics, temps, lists = (column(out, c) for c in ("weather_topics", "weather_temp", "c"))
    for i, _, topic, temp in CASES:
        assert (topics[i], temps[i]) == (topic, temp), i
    assert lists[2] == ["cold, not windy", "warm, windy"]
    assert lists[3] is None


def test_matched_keys(spark, mapping):
    df = spark.createDataFrame([(2, "naonegative"), (3, "x")], "id int, t string")
    assert column(keywords.match_keywords(df, "t", mapping), "matched_keys") == {2: ["nao", "naonegative"], 3: None}


def test_phrases_are_an_option(spark, mapping):
    df = spark.createDataFrame([(3, "a stratospheric warming event")], "id int, t string")
    out = keywords.map_conditions(df, "t", mapping, phrases=True)
    assert column(out, "weather_topics") == {3: "stratospheric warming"}


@pytest.mark.parametrize("way", [{}, {"max_keys": 0}])
def test_matches_equal_brute_force(spark, way):
    rng = random.Random(2)
    keys = sorted({"".join(rng.choices("abc_é", k=rng.randint(1, 4))) for _ in range(40)})
    texts = ["".join(rng.choices("abc_éX -.\n", k=rng.randint(0, 25))) for _ in range(300)]
    table = spark.createDataFrame([(k, f"c{len(k)}") for k in keys], "word string, mapping string")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = keywords.map_conditions(df, "t", table, **way)
    topics, temps = column(out, "weather_topics"), column(out, "weather_temp")
    for i, text in enumerate(texts):
        words = re.findall(r"\w+", text.lower())
        hits = [k for k in keys if any(k in w for w in words)]
        assert topics[i] == (", ".join(hits) or None), repr(text)
        assert temps[i] == (", ".join(sorted({f"c{len(k)}" for k in hits})) or None)


def test_later_region_then_later_row_wins(spark):
    rows = [("Storm", "a", "b", 0, 1), ("storm", "c", "d", 0, 2), (None, "x", "x", 0, 3), ("eu", "only", None, 0, 4)]
    df = spark.createDataFrame(rows, "word string, EU string, USA string, need_location int, row_no int")
    unpivoted = keywords.unpivot_mapping(df)
    assert column(keywords.dedupe_mapping(unpivoted), "mapping", "word")["storm"] == "d"
    only_eu = unpivoted.where("region = 'EU'")
    assert column(keywords.dedupe_mapping(only_eu), "mapping", "word") == {"storm": "c", "eu": "only"}


def test_phrases_of_any_number_equal_brute_force(spark):
    rng = random.Random(8)
    pieces = ["a", "ab", "abc", "b", "bab", "c", "ca,", "é", "", "\n"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(250)]
    texts += [None, "", "AB C", "xab cx", "ab  c", "a" * 3000]
    keys = {" ".join(rng.choice(["a", "ab", "b", "c", "é", ""]) for _ in range(rng.randint(1, 4))) for _ in range(90)}
    keys = sorted(k for k in keys | {"ab c", "zz a", " a", "a ", "a  b"} if k.strip()) + ["  ", "a-b"]
    mapping = spark.createDataFrame([(k, f"c{len(k)}") for k in keys], "word string, mapping string")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    live = [k for k in keys if k.strip() and "-" not in k]
    want = {i: ", ".join(sorted(k for k in live if k in (t or "").lower())) or None for i, t in enumerate(texts)}
    for limit in (0, 1000):
        got = keywords.map_conditions(df, "t", mapping, phrases=True, max_keys=limit)
        assert column(got, "weather_topics") == want
        temps = {i: ", ".join(sorted({f"c{len(k)}" for k in live if k in (t or "").lower()})) or None for i, t in enumerate(texts)}
        assert column(got, "weather_temp") == temps


def test_phrases_that_share_a_common_part_meet_few_posts(spark):
    rows = [(i, f"new town{i} of the") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string")
    phrases = spark.range(20_000).selectExpr("concat('new town', id, ' of') as word", "'c' as mapping")
    got = column(keywords.map_conditions(df, "t", phrases, phrases=True), "weather_topics")
    assert got == {i: f"new town{i} of" for i, _ in rows}
