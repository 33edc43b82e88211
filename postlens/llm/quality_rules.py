"""Quality rules: fixed rules, and thresholds that follow each language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import byte_texts, slices
from postlens.sources.staging import stage

SYMBOLS = b"#*$%&|<>"
#: Blanks, and all bytes of a UTF-8 character but its first.
NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
KEPT = ("doc_id", "lang", "source", "text_hash")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

#: A group's sketch is joined by its parent's, in the weight of this many documents: a small
#: group follows its language, a small language all documents, without a step in between.
PARENT_WEIGHT = 200
LOW_QUANTILE, MIDDLE_QUANTILE = 0.25, 0.5
#: name: (bin width, outer quantile, spreads to the upper fence, spreads to the lower one or 0,
#: part of the language's spread that a group has at least). A spread is the ratio of the outer
#: quantile to the median; fences are that many such ratios from the median. Bins are far
#: narrower than a spread. No cutoff on a value is fixed.
MEASURES = {
    "mean_word": (1.005, 0.75, 8.0, 8.0, 0.5),
    "symbol_ratio": (1.02, 0.75, 6.0, 0.0, 0.0),
    "dup_line_ratio": (1.02, 0.75, 6.0, 0.0, 0.0),
    "repeat_ratio": (1.02, 0.9, 2.0, 0.0, 0.0),
}
#: A text without any of these cannot have too many of them.
COUNT_OF = {"symbol_ratio": "n_symbols", "dup_line_ratio": "n_dup_lines", "repeat_ratio": "n_repeat_words"}


def text_counts(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of a UTF-8 text. Words in 3-word windows that come twice count once each."""
    words, seen, n_dup = text.split(), set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup += 1
        elif line.strip():
            seen.add(line)
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), len(text.translate(None, NOT_COUNTED)), n_symbols, n_dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    first = codes[:n] * len(ids) + codes[1 : n + 1]
    if len(ids) >= 1 << 20:
        first = np.unique(first, return_inverse=True)[1]
    _, at, times = np.unique(
        first * len(ids) + codes[2 : n + 2], return_inverse=True, return_counts=True
    )
    twice = times[at] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(WINDOW):
        covered[shift : shift + n] |= twice
    return int(covered.sum())


def _counted(batches) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches):
        found = [text_counts(t) for t in byte_texts(rows.column("text"))]
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
        kept = [rows.column(n) for n in KEPT]
        yield pa.RecordBatch.from_arrays(kept + columns, [*KEPT, *COUNTS])


def measures() -> dict[str, Column]:
    """The measures of a text with words. Rates of rare things are those of a text with half a
    thing more: most texts have none, and a long one without any tells more than a short one."""
    words = F.col("n_words")
    rate = lambda count: (F.col(count) + 0.5) / (words + 1)
    return {
        "mean_word": F.col("word_chars") / words,
        "symbol_ratio": rate("n_symbols"),
        "dup_line_ratio": rate("n_dup_lines"),
        "repeat_ratio": rate("n_repeat_words"),
    }


def bin_of(value: Column, growth: float) -> Column:
    """Bin of a log-spaced histogram."""
    return F.floor(F.log(value) / math.log(growth)).cast("int")


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: counts by (language, source, measure, bin).

    Sketches of groups merge by adding counts. Copies of a text count once in a group, else one
    that is half of a source would be its norm. Each task drops its own copies and adds up
    its own counts first, so a text or a source with a third of all rows arrives as few rows.
    """
    measured = measured.dropDuplicates(["lang", "source", "text_hash"])
    named = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("name"), bin_of(F.col(n), own[0]).alias("bin"))
                for n, own in MEASURES.items()
            ]
        )
    )
    rows = measured.where("n_words > 0").select("lang", "source", named.alias("m"))
    return rows.groupBy("lang", "source", "m.name", "m.bin").agg(F.count("*").alias("n"))


def _by_measure(at: int) -> Column:
    """The entry of ``MEASURES`` at this place for the measure in ``name``."""
    pairs = [x for name, own in MEASURES.items() for x in (F.lit(name), F.lit(own[at]))]
    return F.create_map(*pairs)[F.col("name")]


def _merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of groups as one for each of the keys."""
    return sketch.groupBy(*keys, "name", "bin").agg(F.sum("n").alias("n"))


def _joined_by(own: DataFrame, parent: DataFrame, keys: list[str], parent_keys: list[str]) -> DataFrame:
    """``own`` with the shares of the parent's bins added in the weight of ``PARENT_WEIGHT``."""
    total = parent.groupBy(*parent_keys, "name").agg(F.sum("n").alias("total"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*parent_keys, "name")]
    shares = parent.alias("p").join(total.alias("t"), same("p", "t")).select(
        *[f"p.{k}" for k in parent_keys], "p.name", "p.bin",
        (F.lit(PARENT_WEIGHT) * F.col("p.n") / F.col("t.total")).alias("n"),
    )
    groups = own.select(*keys, "name").distinct().alias("g")
    lent = groups.join(shares.alias("s"), same("g", "s")).select(
        *[f"g.{k}" for k in keys], "g.name", "s.bin", "s.n"
    )
    return _merged(own.withColumn("n", F.col("n").cast("double")).unionByName(lent), keys)


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``q_low``, ``q_mid``, ``q_high`` for each of the keys and each measure: middles of bins."""
    keys = [*keys, "name"]
    over = Window.partitionBy(*keys)
    run = sketch.withColumns(
        {"below": F.sum("n").over(over.orderBy("bin")), "total": F.sum("n").over(over)}
    )
    at = {"q_low": LOW_QUANTILE, "q_mid": MIDDLE_QUANTILE, "q_high": _by_measure(1)}
    value = lambda bin_: F.pow(_by_measure(0), bin_ + 0.5)
    bins = [F.min(F.when(F.col("below") >= q * F.col("total"), F.col("bin"))).alias(n) for n, q in at.items()]
    return run.groupBy(*keys).agg(*bins).select(*keys, *[value(F.col(n)).alias(n) for n in at])


def fences(sketch: DataFrame) -> DataFrame:
    """``upper`` and ``lower`` for each (language, source, measure), a row for each group.

    Each group's sketch is joined by the one of its language, which is joined by the one of all
    documents. Every fence follows the quantiles of such a sketch.
    """
    lang = _joined_by(_merged(sketch, ["lang"]), _merged(sketch, []), ["lang"], [])
    own = _joined_by(sketch, lang, ["lang", "source"], ["lang"])
    up, down = F.col("q_high") / F.col("q_mid"), F.col("q_low") / F.col("q_mid")
    wider = quantiles(lang, ["lang"]).select(
        F.col("lang").alias("_lang"), F.col("name").alias("_name"),
        F.pow(up, _by_measure(4)).alias("least_up"), F.pow(down, _by_measure(4)).alias("least_down"),
    )
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("name") == F.col("_name"))
    found = quantiles(own, ["lang", "source"]).join(wider, same)
    # fences are edges of bins, so that what shares a bin with the median is within them
    half = F.sqrt(_by_measure(0))
    upper = F.col("q_mid") * F.pow(F.greatest(up, "least_up"), _by_measure(2)) * half
    lower = F.col("q_mid") * F.pow(F.least(down, "least_down"), _by_measure(3)) / half
    return found.select(
        "lang", "source", "name", upper.alias("upper"), F.when(_by_measure(3) > 0, lower).alias("lower")
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, the fixed verdict and the adaptive verdict of each document.

    Takes ``doc_id``, ``text``, ``lang`` and ``source``; other columns are ignored. Returns
    ``doc_id``, ``COUNTS``, ``base_failed``, ``failed`` (measures beyond a fence of the language
    and source, comma-joined) and ``kept``. A null text has no words and fails the fixed
    rules; null languages and sources are groups like any other; repeated rows are all judged,
    but count once in the sketch of their group. Texts are read once: the counts are a written table.
    """
    rows = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("text_hash"))
    counted = rows.mapInArrow(
        _counted,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, source string, "
        "text_hash long, " + ", ".join(f"{n} long" for n in COUNTS),
    )
    counted = stage(counted, "counts")
    valid = {n: F.when(F.col("n_words") > 0, m) for n, m in measures().items()}
    measured = counted.withColumns(valid)
    sketch = stage(sketches(measured), "sketches")
    wide = fences(sketch).groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("name") == n, F.col(v))).alias(f"{n}_{v}") for n in MEASURES for v in ("upper", "lower")]
    )
    wide = wide.withColumnsRenamed({"lang": "own_lang", "source": "own_source"})
    same = F.expr("lang <=> own_lang and source <=> own_source")
    has = {n: F.col(COUNT_OF[n]) > 0 if n in COUNT_OF else F.lit(True) for n in MEASURES}
    beyond = [
        F.when(has[n] & ((F.col(n) > F.col(f"{n}_upper")) | (F.col(n) < F.col(f"{n}_lower"))), F.lit(n))
        for n in MEASURES
    ]
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    judged = measured.join(wide, same, "left").select(
        "doc_id", *COUNTS, base_failed.alias("base_failed"), F.concat_ws(",", *beyond).alias("failed")
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))
