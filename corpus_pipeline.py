"""From raw documents to tokens: the stages of a training corpus, each a written table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.bpe import encode_documents, with_digests
from postlens.llm.mixing import mix
from postlens.llm.ngram_join import ngram_jaccard_join
from postlens.llm.quality_rules import quality_rules
from postlens.llm.secret_scan import redact, secret_scan
from postlens.sources.staging import stage

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: No SQL: components, pivots and merges of tokens are not expressible.
ORACLE_SQL = None


ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, so that every row has its own verdict.

    Each stage reads a written table: the numbers are the same each time it is read.
    """
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _by_number(docs: DataFrame) -> DataFrame:
    """The rows with their numbers as ``doc_id``, for an operator that tells rows apart by it."""
    return docs.withColumn("doc_id", F.col(ROW)).drop(ROW)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; ids may repeat or be null."""
    rows = _numbered(docs)
    kept = quality_rules(_by_number(rows)).where("kept").select(F.col("doc_id").alias(ROW))
    return rows.join(kept, ROW).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near copies link: the one with the smallest id.

    Of rows with equal ids the first stays, a row without an id only if all are.
    """
    rows = _numbered(docs)
    joined = ngram_jaccard_join(_by_number(rows)).select(F.col("doc_id").alias(ROW), "component_id")
    ids = rows.select(ROW, "doc_id").join(joined, ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW))
    kept = ids.groupBy("component_id").agg(first.alias("first")).select(F.col("first")[ROW].alias(ROW))
    return rows.join(kept, ROW).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan finds, replaced by a mark; documents all stay."""
    rows = _numbered(docs)
    found = secret_scan(_by_number(rows)).select(
        F.col("id").alias(ROW), F.concat("base", "added").alias("__spans")
    )
    both = rows.join(found.where(F.size("__spans") > 0), ROW, "left")
    spans = F.coalesce("__spans", F.array().cast(both.schema["__spans"].dataType))
    text = redact(F.col("text"), spans)
    n_chars = F.when(F.size(spans) > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long")
    return both.withColumns({"n_chars": n_chars, "text": text}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows are dealt by a hash of id and text, so that reruns agree however the rows are laid
    out; rows that agree in both are taken equally often.
    """
    rows = docs.withColumn(ROW, F.xxhash64("doc_id", "text"))
    copies = mix(_by_number(rows)).groupBy(F.col("doc_id").alias(ROW)).agg(F.max("copies").alias("__copies"))
    taken = rows.join(copies.where(F.col("__copies") > 0), ROW)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")
    return taken.select(*docs.columns, each).drop("__copy")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digests."""
    path = public_tokenizers.path(VOCABULARY)
    return with_digests(encode_documents(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
