"""Sinks for the row-level result, the rollup and the models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Row-level result, one row per post, without an index column."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True, escape='"')
    else:
        writer.format(fmt).save(path)


def map_text(col: Column, quoted_values: bool) -> Column:
    """A map in the text form of a Python dict: ``{'cold': 3, 'hot': 1}``."""

    def entry(e: Column) -> Column:
        value = e["value"].cast("string")
        quote = F.lit("'")
        value = F.concat(quote, value, quote) if quoted_values else value
        return F.concat(quote, e["key"], quote, F.lit(": "), value)

    return F.concat(
        F.lit("{"), F.array_join(F.transform(F.map_entries(col), entry), ", "), F.lit("}")
    )


def write_rollup(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", map_format: str = "dict"
) -> None:
    """Rollup table. CSV has no maps: they are written as ``dict`` text or as ``json``."""
    if fmt == "csv":
        for field in df.schema.fields:
            if isinstance(field.dataType, MapType):
                quoted = isinstance(field.dataType.valueType, StringType)
                text = F.to_json(field.name) if map_format == "json" else map_text(
                    F.col(field.name), quoted
                )
                df = df.withColumn(field.name, text)
    write_result(df, path, fmt, mode)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
