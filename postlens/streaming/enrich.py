"""The per-post steps over posts that keep arriving.

They hold no state, so a stream runs the batch operators unchanged: no watermark and no
state store. Models are fitted in batch and only applied here. With lookup tables that must be
joined, each micro-batch is a batch job of its own whose output is a folder named after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from postlens.functions.token_table import ROW_ID, TokenTable, with_row_id
from postlens.operators.places import gazetteer_tokens
from postlens.operators.topics import TopicModel
from postlens.plans.analyze import Lookups, enrich_posts, score_posts
from postlens.sources.readers import spread
from postlens.sources.staging import stage


def read_post_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    **options: str,
) -> DataFrame:
    """Posts from a folder to which files are added."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start_enrichment(
    posts: DataFrame,
    lookups: Lookups,
    out_path: str,
    checkpoint_path: str,
    topic_model: TopicModel | None = None,
    classifier: PipelineModel | Callable | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Write enriched, and with a classifier scored, posts as parquet, exactly once.

    The lookup tables must be within the constant bound: a join that regroups by post would
    need state; ``start_batch_enrichment`` takes larger ones. ``once`` handles what is
    there and stops.
    """
    out = enrich_posts(posts, lookups)
    if classifier is not None:
        out = score_posts(out, topic_model, classifier)
    writer = (
        out.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_path)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_batch_enrichment(
    posts: DataFrame,
    lookups: Lookups,
    out_path: str,
    checkpoint_path: str,
    topic_model: TopicModel | None = None,
    classifier: PipelineModel | Callable | None = None,
    once: bool = False,
    max_rows: int | None = None,
) -> StreamingQuery:
    """The same for lookup tables and models of any size: every micro-batch runs in batch.

    A micro-batch writes the folder ``batch_id=<n>`` of ``out_path`` over whatever is there, so one
    that is run again after a failure leaves no row twice. Read ``out_path`` as one table;
    ``batch_id`` is a column of it. Rows are numbered once for all the joins of a batch; one
    of fewer files than there are cores is dealt to all of them first. Lookup tables are worked out
    and written once, before the first batch.
    """
    lookups = _written(lookups, max_rows)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = enrich_posts(with_row_id(spread(batch)), lookups, max_rows)
        if classifier is not None:
            out = score_posts(out, topic_model, classifier, ROW_ID)
        out.drop(ROW_ID).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = posts.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _written(lookups: Lookups, max_rows: int | None) -> Lookups:
    """The same tables, read from where they are written; the cities already by word."""
    bounds = {} if max_rows is None else {"max_rows": max_rows}
    tables = {n: stage(t, n) for n, t in vars(lookups).items() if isinstance(t, DataFrame) and n != "gazetteer"}
    if isinstance(lookups.gazetteer, DataFrame):
        words = stage(gazetteer_tokens(lookups.gazetteer), "gazetteer")
        tables["gazetteer"] = TokenTable.of(words, **bounds)
    return replace(lookups, **tables)
