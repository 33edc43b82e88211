"""Connected components by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.signature_tree import Union
from postlens.sources.staging import stage

#: Edges that a task contracts at once before they are dealt, and that a task writes in a round.
EDGES_AT_ONCE = 1 << 16


def _stars(batches) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: each node and the smallest one its piece of edges reaches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES_AT_ONCE:
            yield _contracted(held)
            held, n = [], 0
    if n:
        yield _contracted(held)


def _contracted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    ends = [np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1)]
    nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
    groups = Union(len(nodes))
    for x, y in place.reshape(2, -1).T.tolist():
        groups.join(x, y)
    root = np.array([groups.find(x) for x in range(len(nodes))], np.int64)
    hung = root != np.arange(len(nodes))
    arrays = [pa.array(nodes[hung]), pa.array(nodes[root[hung]])]
    return pa.RecordBatch.from_arrays(arrays, ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node reached.

    Each task first contracts its own edges, piece by piece, to stars. Each round then hangs the
    larger neighbours of a node on its smallest neighbour, and the smaller ones too, until nothing
    moves; the number of rounds grows with the logarithm of the size. A round deals the
    edges three times, by partial minima, by their smaller and by their larger ends, and drops
    repeats by the way. Its edges are a written table, so that a lost executor costs one round. A
    node with very many larger neighbours, as every root of a large component, is met by a join
    that Spark can split. Few edges are written by few tasks: the last stage of a round has a task
    for each core at least, more where there are more edges. Loops and null ends are dropped; no
    edges give no rows.
    """
    a = F.greatest("a", "b").cast("long").alias("a")
    b = F.least("a", "b").cast("long").alias("b")
    valid = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    edges = stage(edges.where(valid).select(a, b).mapInArrow(_stars, "a long, b long"), "edges")
    n, cores = edges.count(), edges.sparkSession.sparkContext.defaultParallelism
    while True:
        nearest = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = edges.join(nearest, "b", "left")
        large = large.groupBy("a", F.coalesce("m", "b").alias("b")).agg(F.max(F.col("m").isNotNull()).alias("moved"))
        least = F.min("b").over(Window.partitionBy("a"))
        small = large.withColumn("m", least).select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("m").alias("b"),
            (F.col("moved") | (F.col("b") != F.col("m"))).alias("moved"),
        )
        written = stage(small.coalesce(max(cores, n // EDGES_AT_ONCE + 1)), "edges")
        edges = written.select("a", "b")
        n, moved = written.agg(F.count("*"), F.max("moved")).first()
        if not moved:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct()
    )
