"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import byte_texts, slices
from postlens.sources.staging import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
CHUNK_ROWS = 2000
FAN_IN = 8
SEED = 17


def _sized(batches) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches):
        sizes = pa.array([len(t.split()) for t in byte_texts(rows.column(2))], pa.int64())
        names = ["doc_id", "source", "size"]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), sizes], names)


def targets(
    sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES
) -> DataFrame:
    """``source, number, rows, source_size, target``: a row for each source.

    Weights repeat over the sources by code point, null last. Sources that would pass
    ``most_copies`` times their size stop there and the excess is shared again by weight; the
    end of that is one level ``t`` with targets ``min(most_copies * size, t * weight)``,
    which running sums over the sources by size per weight give at once.
    """
    by_source = sized.groupBy("source").agg(
        F.count("*").alias("rows"), F.sum("size").alias("source_size")
    )
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    numbered = by_source.withColumn("number", F.row_number().over(ordered) - 1).withColumn(
        "weight", F.get(cycle, F.col("number") % len(weights))
    )
    cap = most_copies * F.col("source_size")
    by_cap = Window.orderBy(cap / F.col("weight"), "number")
    upto = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (share * total - (F.sum(cap).over(upto) - cap)) / F.sum("weight").over(onward)
    full = cap / F.col("weight") <= level
    leveled = numbered.withColumns({"level": level, "open": ~full})
    rest = F.min(F.when(F.col("open"), F.struct("number_by_cap", "level"))).over(Window.partitionBy())
    leveled = leveled.withColumn("number_by_cap", F.row_number().over(by_cap)).withColumn(
        "level", rest["level"]
    )
    target = F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(cap)
    return leveled.select("source", "number", "rows", "source_size", target.cast("double").alias("target"))


def pivotal(share: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int:
    """Round all but one of the shares to 0 or 1, in place; the place of that one, or -1.

    Two open shares at a time trade words until one is whole. Words are kept exactly, and the
    expected share of each is what it was.
    """
    draws, open_ = rng.random(len(share)), -1
    for j in range(len(share)):
        b = share[j]
        if b <= 0.0 or b >= 1.0:
            continue
        if open_ < 0:
            open_ = j
            continue
        i, a = open_, share[open_]
        s, t = size[i], size[j]
        up, down = min((1 - a) * s, b * t), min(a * s, (1 - b) * t)
        if draws[j] * (up + down) < down:
            if up == (1 - a) * s:
                share[i], share[j], open_ = 1.0, b - up / t, j
            else:
                share[i], share[j] = a + up / s, 0.0
        elif down == a * s:
            share[i], share[j], open_ = 0.0, b + down / t, j
        else:
            share[i], share[j] = a - down / s, 1.0
        left = share[open_]
        if left < 1e-9 or left > 1 - 1e-9:
            share[open_], open_ = round(left), -1
    return open_


def _round_chunk(level: int, order: list[str], seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        rng = np.random.default_rng([seed, level, int(pdf["number"][0]), int(pdf["group"][0])])
        share = pdf["share"].to_numpy(np.float64, copy=True)
        open_ = pivotal(share, pdf["size"].to_numpy(np.float64), rng)
        pdf["share"] = share
        pdf["open"] = np.arange(len(pdf)) == open_
        return pdf

    return run


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    most_copies: int = MOST_COPIES,
    seed: int = SEED,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """How many copies of each document the mix takes.

    Takes ``doc_id``, ``text`` and ``source``; returns ``doc_id, source, size, source_size, target,
    copies`` for each row. A document's expected copies are its source's target over its
    size: the whole part is given, the rest is rounded by pivots. Chunks of a source, dealt by
    hash, are rounded in parallel and leave one open share each; eight chunks at a time
    meet in a reduction tree until a source has one, which is drawn. So the words taken differ
    from a target by less than one document. Draws depend on the seed and the rows
    alone. A null text has size 0 and no copies beyond the whole part; equal rows are dealt over the
    chunks by their number; a null source is the last source. Only ids and sizes are shuffled.
    """
    kinds = ", ".join(
        f"{n} {docs.schema[n].dataType.simpleString()}" for n in ("doc_id", "source")
    )
    sized = docs.select("doc_id", "source", "text").mapInArrow(_sized, f"{kinds}, size long")
    sized = stage(sized, "sized")
    by_source = stage(targets(sized, weights, share, most_copies), "targets")
    chunks = F.pow(F.lit(float(FAN_IN)), F.ceil(F.log(F.greatest(F.col("rows") / chunk_rows, F.lit(1.0))) / math.log(FAN_IN))).cast("long")
    by_source = by_source.withColumn("chunks", chunks).withColumnRenamed("source", "own_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    equal = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    rows = equal.join(by_source, F.expr("source <=> own_source")).withColumn("expected", expected)
    rows = rows.select(
        "doc_id",
        "source",
        "number",
        "size",
        "source_size",
        "target",
        "chunks",
        F.floor("expected").alias("whole"),
        F.when(F.col("size") > 0, F.col("expected") - F.floor("expected")).otherwise(0.0).alias("share"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"),
    )
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "size", "nth"), F.col("chunks")))
    order = ["doc_id", "size", "nth"]
    first = rows.drop("chunks").groupBy("number", "group").applyInPandas(
        _round_chunk(0, order, seed),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, number int, "
        "size long, source_size long, target double, whole long, share double, nth long, "
        "group long, open boolean",
    )
    first = stage(first, "rounded")
    levels = by_source.agg(F.max(F.log(F.col("chunks")) / math.log(FAN_IN))).first()[0] or 0
    left = first.where("open").select("number", F.col("group").alias("chunk"), "group", "size", "share")
    closed = None
    for level in range(1, round(levels) + 1):
        met = left.withColumn("group", F.floor(F.col("group") / FAN_IN))
        met = met.groupBy("number", "group").applyInPandas(
            _round_chunk(level, ["chunk"], seed),
            "number int, chunk long, group long, size long, share double, open boolean",
        )
        met = stage(met, "met")
        left = met.where("open").drop("open")
        done = met.where("not open").select("number", "chunk", "share")
        closed = done if closed is None else closed.union(done)
    draw = F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(1 << 30)) / float(1 << 30)
    last = left.select("number", "chunk", (draw < F.col("share")).cast("double").alias("share"))
    closed = last if closed is None else closed.union(last)
    closed = closed.withColumnsRenamed({"number": "n", "chunk": "c", "share": "end"})
    return first.join(closed, F.expr("open and number = n and `group` = c"), "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.coalesce("end", F.round("share"))).cast("long").alias("copies"),
    )
