"""Sharding by a hierarchical weighted hash tree of regions, racks and shards."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A region, a rack or a shard; a node above shards weighs what its shards weigh."""

    name: int
    own_weight: float = 1.0
    children: tuple[Node, ...] = ()

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def hash_tree(n_shards: int, per_rack: int = 4, racks: int = 2) -> Node:
    """Shards 0 to n-1 of weight 1, filled into racks and regions in order."""
    shards = [Node(s) for s in range(n_shards)]
    for size in (per_rack, racks):
        shards = [
            Node(at // size, children=tuple(shards[at : at + size]))
            for at in range(0, len(shards), size)
        ]
    return Node(0, children=tuple(shards))


def with_new_region(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """One more shard as a region of its own: only it gains rows, from everywhere alike."""
    region = max((c.name for c in tree.children), default=-1) + 1
    rack = Node(0, children=(Node(shard, weight),))
    return Node(tree.name, children=(*tree.children, Node(region, children=(rack,))))


def place(tree: Node, key: Column, path: tuple[int, ...] = ()) -> Column:
    """The shard of a key: at each level the child with the lowest weighted draw.

    A draw hashes the key with the child's own path: -ln(u) / weight. A child is taken with a
    chance of its weight's share, and a weight that changes moves keys only from or to
    that child; below all others nothing moves.
    """
    if not tree.children:
        return F.lit(tree.name)
    draws = []
    for child in tree.children:
        own = (*path, child.name)
        bits = F.shiftrightunsigned(F.xxhash64(key, *map(F.lit, own)), 11)
        score = -F.log((bits + 0.5) * 2.0**-53) / child.weight
        draws.append(F.struct(score.alias("score"), F.lit(child.name).alias("child")))
    taken = F.least(*draws)["child"] if len(draws) > 1 else draws[0]["child"]
    if not tree.children[0].children:
        return taken
    shard = F.lit(None).cast("int")
    for child in tree.children:
        below = place(child, key, (*path, child.name))
        shard = F.when(taken == child.name, below).otherwise(shard)
    return shard


def shard_rows(
    docs: DataFrame, tree: Node, grown: Node | None = None, rows_per_group: int = 20_000
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` and, for a grown tree, ``grown_shard``.

    The size is the text's UTF-8 bytes plus 16; a null text has none and the CRC 0. The id alone
    decides the shard (a null id is a key like any other), so equal ids share one. Slots of a
    shard run from 0 without a gap. They are numbered in groups of a shard by hash, in two
    steps (counts of the groups, then rows within), so no task holds a shard. Equal rows are
    counted before they are numbered, so a row that repeats very often is one row until the
    end. Only ids, sizes and checksums are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    groups = max(1, math.ceil(docs.count() / rows_per_group))
    key = F.col("doc_id")
    rows = rows.withColumns(
        {
            "shard": place(tree, key),
            "group": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(groups)),
        }
    )
    sizes = rows.groupBy("shard", "group").agg(F.sum("times").alias("rows"))
    before = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "shard", "group", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("shard", "group").orderBy("doc_id", "size", "text_crc32")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("times").over(within), F.lit(0)))
    placed = rows.join(sizes, ["shard", "group"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("start") + F.col("first")).alias("first"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("at"),
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("at")).alias("slot"),
        *([place(grown, key).cast("int").alias("grown_shard")] if grown else []),
    )
