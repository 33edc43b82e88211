"""Train, keep and measure the temperature classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.operators.classify import (
    classification_metrics,
    predict_temperature,
    split_train_val,
    train_temperature_model,
)
from postlens.sources.readers import read_labelled
from postlens.sources.writers import load_model, save_model


def train_and_evaluate(
    labelled: DataFrame,
    model_path: str,
    text_col: str = C.TEXT,
    label_col: str = "label",
    id_col: str | None = None,
    val_share: float = 0.2,
    seed: int = 42,
    **training_options,
) -> DataFrame:
    """Split, train, save, and return the validation metrics as one row.

    Without ``id_col`` the text itself decides the side, so copies never straddle the split.
    """
    if id_col is None:
        id_col, labelled = "_split_key", labelled.withColumn("_split_key", F.col(text_col))
    parts = split_train_val(labelled, id_col, val_share, seed)
    train, val = parts.where(~F.col("is_val")), parts.where("is_val")
    model = train_temperature_model(train, val, text_col, label_col, **training_options)
    save_model(model, model_path)
    scored = predict_temperature(val, load_model(model_path), text_col, "prediction")
    return classification_metrics(scored, label_col, "prediction")


def run_training(
    spark: SparkSession, path: str, model_path: str, label_col: str = "label", **options
) -> DataFrame:
    """The same from a labelled CSV file on disk."""
    labelled = read_labelled(spark, path, label_col, options.pop("fmt", "csv"))
    return train_and_evaluate(labelled, model_path, label_col=label_col, **options)
