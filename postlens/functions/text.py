"""Text cleaning and tokenising as native column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a link, a word character and a blank.
#
# A link runs over every character from "$" to "_" (that range holds digits,
# capitals and "% & ( ) * + , - . / : ; = ? @"), lower-case letters and "!". It stops
# at "#", "~", blanks and anything outside ASCII, and only a lower-case scheme counts.
# It is one character class on purpose: a repeated alternation makes the Java regex
# engine recurse once per character, which overflows the stack on very long links.
LINK = r"https?://[!$-_a-z]+"
WWW_HOST = r"www\.[a-zA-Z0-9\-]+\.[a-zA-Z]{2,}"
WORD_CHARS = r"\p{L}\p{N}_"
BLANK_CHARS = r"\s\x1c-\x1f"
# Everything cleaning deletes: neither letter, nor non-decimal numeral, nor "_", nor blank.
UNWANTED = r"(?U)[^\p{L}\p{Nl}\p{No}_" + BLANK_CHARS + r"]+"
BLANKS = r"(?U)[" + BLANK_CHARS + r"]+"
NON_BLANKS = r"(?U)[^" + BLANK_CHARS + r"]+"
WORD = "[" + WORD_CHARS + "]+"
WORD_OF_TWO = "[" + WORD_CHARS + "]{2,}"

# Fused words that a Penn-Treebank tokenizer splits in two.
FUSED_WORDS = (
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
)

# The usual English stop list. The forms with an apostrophe are part of
# the list although cleaned text never contains one.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours
    yourself yourselves he him his himself she she's her hers herself it it's its itself
    they them their theirs themselves what which who whom this that that'll these those
    am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don don't
    should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
    doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't
    mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't
    won won't wouldn wouldn't
    """.split()
)


def clean_text(text: Column) -> Column:
    """Delete links, hosts, punctuation and digits; collapse blanks; lower-case.

    The two link passes only run on texts that can hold a link.
    """
    text = F.when(text.contains("http"), F.regexp_replace(text, LINK, "")).otherwise(text)
    text = F.when(text.contains("www."), F.regexp_replace(text, WWW_HOST, "")).otherwise(text)
    text = F.regexp_replace(text, UNWANTED, "")
    return F.lower(F.trim(F.regexp_replace(text, BLANKS, " ")))


def words(text: Column) -> Column:
    """Whitespace-separated words of any text; an empty array for a blank one."""
    return F.regexp_extract_all(text, F.lit(NON_BLANKS), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; null stays null."""
    return F.when(text.isNotNull(), F.size(words(text)))


def tokenize(cleaned: Column, contractions: bool = True) -> Column:
    """Tokens of cleaned text, with the fused words split when asked for.

    Cleaned text has single blanks, so a plain split replaces the slower regex scan.
    """
    if contractions:
        heads = "|".join(f"{a}(?={b}(?: |$))" for a, b in FUSED_WORDS)
        fused = [cleaned.contains(a + b) for a, b in FUSED_WORDS]
        any_fused = fused[0]
        for test in fused[1:]:
            any_fused = any_fused | test
        cleaned = F.when(
            any_fused, F.regexp_replace(cleaned, f"(^| )({heads})", "$1$2 ")
        ).otherwise(cleaned)
    return F.array_remove(F.split(cleaned, " "), "")


def remove_stopwords(tokens: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Drop exact matches; the order and the repeats of the others are kept."""
    stop_words = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(stop_words)) if stop_words else tokens


def live_key(key: Column) -> Column:
    """True for a key made of word characters only, the kind that can sit inside a word."""
    return key.rlike("^" + WORD + "$")
