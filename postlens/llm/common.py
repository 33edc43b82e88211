"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
HELD_OUT_FOLDS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short pieces of Arrow batches, so that a task holds few texts as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model may learn from; a null id is held out."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS
    return F.coalesce(fold == 0, F.lit(True))


def _sum_counts(pdf):
    total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
    return pdf.head(1).assign(counts=[total.tobytes()])


def summed_counts(tasks: DataFrame) -> dict[int, np.ndarray]:
    """Sums of fixed-size count vectors ``(part, task, counts)`` of tasks, 64 at a time."""
    for _ in range(3):
        tasks = tasks.withColumn("task", F.floor(F.col("task") / 64).cast("int"))
        tasks = tasks.groupBy("part", "task").applyInPandas(
            _sum_counts, "part int, task int, counts binary"
        )
    sums: dict[int, np.ndarray] = {}
    for row in tasks.collect():
        own = np.frombuffer(row["counts"], np.int64)
        sums[row["part"]] = sums.get(row["part"], 0) + own
    return sums
