"""Table scans. CSV columns are read as text from the header, without an inference pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import columns as C

# Cell texts that a data-frame CSV reader takes for a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

GAZETTEER_COLUMNS = ("city", "city_ascii", "country", "admin_name", "capital", "iso2", "iso3")
GLOSSARY_SCHEMA = "glossary array<struct<term:string,definition:string>>"


def _read_csv(spark: SparkSession, path: str, multi_line: bool = True, numbered: bool = False) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    cells = [
        F.when(~F.col(f"`{c}`").isin(list(MISSING_TEXTS)), F.col(f"`{c}`")).alias(c)
        for c in df.columns
    ]
    return df.select(*cells, *([_row_no(df)] if numbered else []))


def _read_table(spark: SparkSession, path: str, fmt: str, multi_line: bool = True) -> DataFrame:
    if fmt == "csv":
        return _read_csv(spark, path, multi_line)
    return spark.read.format(fmt).load(path)


def read_posts(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True
) -> DataFrame:
    """Posts with at least ``text`` and ``account``; other columns pass through.

    A CSV post may hold line breaks, so a CSV file is one task. Where no post does, pass
    ``multi_line=False``: Spark then splits the files. So it does with ``fmt="parquet"`` (any
    Spark format works).
    """
    df = _read_table(spark, path, fmt, multi_line)
    C.require_columns(df, C.TEXT, C.ACCOUNT)
    return df


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Keyword mapping: ``word, EU, USA, need_location, row_no``; a BOM does no harm."""
    df = _read_csv(spark, path, numbered=True)
    C.require_columns(df, "word", "EU", "USA", "need_location")
    return df.select(
        "word", "EU", "USA", F.col("need_location").try_cast("int").alias("need_location"), "row_no"
    )


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """World cities, lower-cased, with ``row_no`` by file name, then in file order."""
    df = _read_csv(spark, path, numbered=True)
    C.require_columns(df, *GAZETTEER_COLUMNS)
    return df.select(*[F.lower(c).alias(c) for c in GAZETTEER_COLUMNS], "row_no")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document ``{"glossary": [{"term", "definition"}, ...]}`` -> ``term, definition``.

    Terms are lower-cased, the last entry of a term wins (over several files the one of the
    last file by name), nulls drop.
    """
    entries = (
        spark.read.schema(GLOSSARY_SCHEMA)
        .json(path, multiLine=True)
        .select(F.col("_metadata.file_path").alias("file"), F.posexplode("glossary").alias("pos", "e"))
        .select("file", "pos", F.lower("e.term").alias("term"), "e.definition")
        .where(F.col("term").isNotNull() & F.col("definition").isNotNull())
    )
    last = F.max_by("definition", F.struct("file", "pos"))
    return entries.groupBy("term").agg(last.alias("definition"))


def read_labelled(
    spark: SparkSession, path: str, label_col: str = "label", fmt: str = "csv"
) -> DataFrame:
    """Training posts: ``text`` and an integer class; other columns pass through."""
    df = _read_table(spark, path, fmt)
    C.require_columns(df, C.TEXT, label_col)
    return df.withColumn(label_col, F.col(label_col).try_cast("int"))


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Give a table whose scan has fewer splits than there are cores to all of them.

    A larger table is returned as it is: its scan already fills the cluster. Without ``key``
    rows are dealt in turn.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)


def _row_no(df: DataFrame) -> Column:
    """A rising number: by file name, then in file order. Which task reads what does not matter.

    A file that may hold line breaks in cells is read by one task, from front to back.
    """
    files = df.select(F.col("_metadata.file_path").alias("f")).distinct().orderBy("f").collect()
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    if len(files) > 1:
        names = F.array(*[F.lit(r["f"]) for r in files])
        place = place + F.shiftleft(F.array_position(names, F.col("_metadata.file_path")) - 1, 40)
    return place.alias("row_no")
