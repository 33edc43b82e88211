"""Exactly so many rows, chosen by a hash, without a sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.sources.staging import stage

#: Hex digits of a hash that one round looks at: 65,536 counts at most.
DIGITS = 4
HASH_DIGITS = 32


def hash_of(id_col: str, seed: int = 42) -> Column:
    """The hash by which rows are chosen. Seed 42 is the plain one; a null id is an empty one."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.md5(key if seed == 42 else F.concat(F.lit(f"{seed}:"), key))


def kth_hash(hashes: DataFrame, k: int) -> str | None:
    """The ``k``-th smallest value of ``hashes(hash)``, from 1; None for ``k`` < 1.

    Each round counts the next digits of the rows that share the digits found so far: a
    partial count and a small table. Two rounds meet a few rows, so a third is the last but
    for copies. ``k`` beyond the last row gives the last row's value.
    """
    if k < 1:
        return None
    found, left = "", k
    while len(found) < HASH_DIGITS:
        open_rows = hashes.where(F.startswith("hash", F.lit(found))) if found else hashes
        digits = F.substring("hash", len(found) + 1, DIGITS)
        counts = open_rows.groupBy(digits.alias("d")).count().orderBy("d").collect()
        if not counts:
            return None
        for row in counts:
            if left <= row["count"] or row is counts[-1]:
                break
            left -= row["count"]
        found += row["d"]
        if row["count"] == 1:
            only = hashes.where(F.startswith("hash", F.lit(found)))
            return only.first()["hash"]
    return found


def split_train_val_exact(
    df: DataFrame, id_col: str, val_share: float = 0.2, seed: int = 42, out: str = "is_val"
) -> DataFrame:
    """Mark ``ceil(val_share * rows)`` rows for validation: those with the smallest hashes of ids.

    The hashes are counted in rounds (see ``kth_hash``), then every row is marked where it
    lies; nothing is sorted or joined, and the split is the same under any partitioning.
    The count is exact for distinct ids. Rows that share an id, and rows without one, stay on
    one side, so with them there can be more. An empty table stays empty.
    """
    C.require_columns(df, id_col)
    hashes = stage(df.select(hash_of(id_col, seed).alias("hash")), "hashes")
    wanted = math.ceil(round(val_share * hashes.count(), 9))
    last = kth_hash(hashes, wanted)
    chosen = F.lit(False) if last is None else hash_of(id_col, seed) <= F.lit(last)
    return df.withColumn(out, chosen)
