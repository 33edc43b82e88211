"""Document fingerprints: Order MinHash over words, in built-in functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a k-mer, k-mers of a tuple, tuples of a fingerprint.
K, TUPLE, PARTS = 3, 2, 16
#: Low k-mers that each part looks at first, on average; one that finds too few looks at all.
CHOICE = 8
PLACE_BITS = 26
PLACE = (1 << PLACE_BITS) - 1
CODE = ((1 << 63) - 1) & ~PLACE
SPACES = r"[\x20\x09-\x0D]+"
#: Blocks of neighbouring ids for each shuffle partition.
BLOCKS = 4


def _code(x: Column) -> Column:
    return x.bitwiseAND(F.lit(CODE))


def _packed(hashed: Column, place: Column) -> Column:
    """A hash above, a place in the text below. Places beyond 2^26 words start again at 0."""
    return _code(hashed).bitwiseOR(place.bitwiseAND(F.lit(PLACE)))


def fingerprint(df: DataFrame, text: str, name: str, parts: int = PARTS) -> DataFrame:
    """Add column ``name``: an array of ``parts`` hashes of ordered k-mer tuples.

    Each k-mer of words is numbered by its occurrence in the text, and (k-mer, occurrence) is hashed
    into one of the parts. A part takes the lowest hashes it has, puts them back in text order
    and hashes that tuple; a part without any is 0. So a fingerprint tells which k-mers a text
    has, how often, and in which order. A text of fewer words than a k-mer is one k-mer, one
    without words is one of all its characters, and a null text is empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.transform(F.array_remove(F.split(t, SPACES, -1), ""), lambda w: F.xxhash64(w))
    df = df.withColumn("__print_w", words)
    n = F.size("__print_w")
    kmers = F.transform(
        F.slice("__print_w", 1, F.greatest(n - (K - 1), F.least(n, F.lit(1)))),
        lambda w, i: _packed(
            F.xxhash64(w, *[F.get("__print_w", i + d) for d in range(1, K)]), i.cast("long")
        ),
    )
    whole = F.array(_packed(F.xxhash64(t), F.lit(0).cast("long")))
    # sorted, equal k-mers stand together in text order
    df = df.withColumn("__print_s", F.sort_array(F.when(n > 0, kmers).otherwise(whole))).drop("__print_w")
    n = F.size("__print_s")
    heads = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (_code(F.get("__print_s", i)) != _code(F.get("__print_s", i - 1))),
    )
    df = df.withColumn("__print_h", heads)

    def numbered(x: Column, occurrence: Column) -> Column:
        return _packed(F.xxhash64(_code(x), occurrence), x)

    once = F.transform("__print_s", lambda x: numbered(x, F.lit(0)))
    runs = F.transform(
        "__print_h",
        lambda h, r: F.transform(
            F.sequence(h, F.coalesce(F.get("__print_h", r + 1), n) - 1),
            lambda at: numbered(F.get("__print_s", at), at - h),
        ),
    )
    kept = F.lit(float(1 << 63)) * (parts * CHOICE) / n
    below = F.when(n > parts * CHOICE, kept.cast("long")).otherwise(F.lit((1 << 63) - 1))
    df = df.withColumns(
        {"__print_a": F.when(F.size("__print_h") == n, once).otherwise(F.flatten(runs)), "__print_b": below}
    ).drop("__print_s", "__print_h")
    df = df.withColumn("__print_c", F.sort_array(F.filter("__print_a", lambda c: c <= F.col("__print_b")))).drop("__print_b")

    def of_part(candidates: str, part: Column) -> Column:
        return F.filter(candidates, lambda c: F.shiftright(c, PLACE_BITS) % parts == part)

    low = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)), lambda part: F.slice(of_part("__print_c", part), 1, TUPLE)
    )
    # what is above the bound comes after all below it, so only a part that found too few looks again
    bounded = F.size("__print_c") < F.size("__print_a")
    df = df.withColumns({"__print_l": low, "__print_n": bounded}).drop("__print_c")
    chosen = F.transform(
        "__print_l",
        lambda own, part: F.when(
            F.col("__print_n") & (F.size(own) < TUPLE),
            F.slice(F.sort_array(of_part("__print_a", part)), 1, TUPLE),
        ).otherwise(own),
    )
    df = df.withColumn("__print_l", chosen).drop("__print_a", "__print_n")

    def tuple_hash(own: Column) -> Column:
        lowest = F.transform(
            own,
            lambda c: F.struct(c.bitwiseAND(F.lit(PLACE)).alias("place"), _code(c).alias("code")),
        )
        in_order = F.transform(F.array_sort(lowest), lambda s: s["code"])
        return F.when(F.size(in_order) > 0, F.xxhash64(in_order)).otherwise(F.lit(0).cast("long"))

    return df.withColumn(name, F.transform("__print_l", tuple_hash)).drop("__print_l")


def likeness(a: Column, b: Column) -> Column:
    """Share of the parts, of those that either fingerprint has, in which the two agree."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    same = F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != 0))
    any_ = F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0))
    return F.size(same) / F.greatest(F.size(any_), F.lit(1))


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _block(order: Column, bounds: list[int]) -> Column:
    """Number of bounds not above the key, found in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.size(F.filter(literal(bounds[step - 1 :: step]), lambda b: b <= order))
    fine = F.slice(literal(bounds), coarse * step + 1, step)
    return coarse * step + F.size(F.filter(fine, lambda b: b <= order))


def with_next(
    docs: DataFrame, carry: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Each row of ``doc_id, text`` with the ``carry`` columns of the next row as ``next_*``.

    Rows follow each other by ``doc_id``, a null one first, and by text where ids repeat; the first
    follows the last. Ids are cut into blocks of neighbours, a few for each shuffle
    partition, whose bounds alone pass the driver. A block is read in order, with the
    first row of the next block behind its last, so texts are shuffled once. ``prepare`` adds
    columns to rows before they are dealt, to those that stand behind a block once more. Rows
    that share an id are in one block. Other columns stay; names that begin with
    ``__next_`` are the operator's own. An empty table stays empty.
    """
    spark = docs.sparkSession
    prepare = prepare or (lambda df: df)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    n_blocks = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(order.alias("o")).repartitionByRange(n_blocks, "o")
    firsts = ids.select("o", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min("o").alias("o"))
    bounds = sorted({r["o"] for r in firsts.collect()})
    if not bounds:
        empty = prepare(docs.limit(0))
        return empty.withColumns({f"next_{c}": F.col(c) for c in carry})
    rows = docs.withColumns({"__next_o": order, "__next_ghost": F.lit(False)})
    rows = rows.withColumn("__next_block", _block(F.col("__next_o"), bounds[1:]))
    # bounds[i] is the first id of block i
    before = {b: (i - 1) % len(bounds) for i, b in enumerate(bounds)}
    pairs = spark.createDataFrame(list(before.items()), "__next_first long, __next_to int")
    ghosts = rows.join(F.broadcast(pairs), F.col("__next_o") == F.col("__next_first"))
    lowest = Window.partitionBy("__next_first").orderBy("text")
    ghosts = ghosts.withColumn("__next_nth", F.row_number().over(lowest)).where("__next_nth = 1")
    ghosts = ghosts.withColumns({"__next_block": F.col("__next_to"), "__next_ghost": F.lit(True)})
    both = prepare(rows.unionByName(ghosts.select(*[f"`{c}`" for c in rows.columns])))
    along = Window.partitionBy("__next_block").orderBy("__next_ghost", "__next_o", "text")
    return (
        both.withColumns({f"next_{c}": F.lead(c).over(along) for c in carry})
        .where(~F.col("__next_ghost"))
        .drop("__next_o", "__next_ghost", "__next_block")
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the text's characters replaced by the first as many of another text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    head = F.substr(text, F.lit(1), F.length(text) - quarter)
    return F.concat(head, F.substr(following, F.lit(1), quarter))
