import random
import re

import pytest
from conftest import column
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.functions.arrays import argmax, token_counts

# the published step-by-step patterns; the library uses an equivalent shorter form
LINK_STEPS = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"


def clean(text):
    for pattern, new in (
        (LINK_STEPS, ""), (T.WWW_HOST, ""), (r"[^\w\s]", ""), (r"\d+", ""), (r"\s+", " "),
    ):
        text = re.sub(pattern, new, text)
    return text.strip().lower()


def test_cleaning_cases(spark):
    cases = {
        "see https://a.example.com/x?y=1&z=%20#frag~tail now": "see fragtail now",
        "HTTP://UP.example.com/x": "httpupexamplecomx",
        "www.example.com/path ok": "path ok",
        "www.a.b.example.com x": "wwwabexamplecom x",
        "it's 3-degree don't_stop ½ ² naïve é": "its degree dont_stop ½ ² naïve é",
        "": "",
        " \t\n ": "",
        None: None,
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for r in df.select("text", "want", T.clean_text(F.col("text")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_cleaning_equals_the_regex_steps(spark):
    rng = random.Random(7)
    pieces = [
        "http://", "https://", "www.", ".com", "a", "Zz", "0", "9", "-", "_", "~", "#", "/", "?", "%2F", "%",
        " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "é", "ß", "Ä", "½", "²", "٣", "ⅷ",
        "中", "'", "’", "!", "(", ")", "[", "]", "^", "\\", "|", "{", "$", "@", "😀", "́", "‍", "`",
    ]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = column(df.select("id", T.clean_text(F.col("text")).alias("t")), "t")
    for i, text in enumerate(texts):
        assert got[i] == clean(text), repr(text)


def test_a_very_long_link_does_not_overflow_the_regex_stack(spark):
    df = spark.range(1).select(F.concat(F.lit("a http://"), F.repeat(F.lit("x/"), 200_000), F.lit(" b")).alias("t"))
    assert df.select(T.clean_text(F.col("t"))).first()[0] == "a b"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("cannot cannot gonna", ["can", "not", "can", "not", "gon", "na"]),
        ("gimme gotta lemme wanna", ["gim", "me", "got", "ta", "lem", "me", "wan", "na"]),
        ("cannots xcannot wannabe", ["cannots", "xcannot", "wannabe"]),
        ("", []),
        (None, None),
    ],
)
def test_fused_words(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.tokenize(F.col("t"))).first()[0] == want


def test_fused_words_can_stay(spark):
    df = spark.createDataFrame([("cannot",)], "t string")
    assert df.select(T.tokenize(F.col("t"), contractions=False)).first()[0] == ["cannot"]


def test_stop_words_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["b", "the", "a", "b", "The"],)], "t array<string>")
    kept = df.select(T.remove_stopwords(F.col("t"), ["the", "a"])).first()[0]
    assert kept == ["b", "b", "The"]
    assert df.select(T.remove_stopwords(F.col("t"), [])).first()[0][1] == "the"
    assert len(T.ENGLISH_STOP_WORDS) == len(set(T.ENGLISH_STOP_WORDS)) == 179


def test_word_count(spark):
    rows = [(1, "", 0), (2, None, None), (3, "  a\tb\xa0c ", 3), (4, "x", 1)]
    df = spark.createDataFrame(rows, "id int, t string, want int")
    for r in df.withColumn("got", T.word_count(F.col("t"))).collect():
        assert r["got"] == r["want"], r


def test_token_counts(spark):
    rng = random.Random(1)
    arrays = [[rng.choice("abcde") for _ in range(n)] for n in (0, 1, 2, 50, 500)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)] + [(9, None)], "id int, t array<string>")
    got = column(df.select("id", token_counts(F.col("t")).alias("b")), "b")
    for i, a in enumerate(arrays):
        assert [(b["token"], b["n"]) for b in got[i]] == [(w, a.count(w)) for w in sorted(set(a))]
    assert got[9] is None


def test_argmax_takes_the_first_of_a_tie(spark):
    df = spark.createDataFrame([([0.1, 0.4, 0.4],), ([1.0],)], "p array<double>")
    assert [r[0] for r in df.select(argmax(F.col("p"))).collect()] == [1, 0]
