"""Classifiers: the batch-predictor hook, the trainable temperature model, its metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from postlens import columns as C
from postlens.functions.arrays import argmax
from postlens.functions.labels import TEMP_LABELS

SPLIT_BUCKETS = 100


def predicted_class(
    text: Column, predictor: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 64
) -> Column:
    """Position of the largest model score per text; null text gives null.

    ``predictor`` is a factory: it loads the model once per Python worker and returns a
    function from a batch of texts to a (batch, classes) array of logits or probabilities.
    The softmax between the two does not change which class is largest.
    """
    scores = predict_batch_udf(predictor, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return F.when(text.isNotNull(), argmax(scores(F.coalesce(text, F.lit("")))))


def classify(
    df: DataFrame,
    text_col: str,
    predictor: Callable[[], Callable[[np.ndarray], np.ndarray]],
    labels: Sequence[str],
    out: str,
    batch_size: int = 64,
) -> DataFrame:
    """Add the label of the best class. ``labels`` are in the class order of the model."""
    C.require_columns(df, text_col)
    names = F.array(*[F.lit(name) for name in labels])
    best = predicted_class(F.col(text_col), predictor, batch_size)
    return df.withColumn(out, F.get(names, best))


class RuleClasses:
    """Class ``i`` scores a point for each of ``keywords[i]`` that a text holds; the first best wins.

    No keyword at all gives the mild class. A column expression: no Python worker.
    """

    def __init__(self, keywords: Sequence[Sequence[str]]) -> None:
        self.keywords = keywords

    def best(self, text: Column) -> Column:
        mild = TEMP_LABELS.index("mild/not relevant")
        scores = []
        for i, words in enumerate(self.keywords):
            score = F.lit(0.5 if i == mild else 0.0)
            for word in words:
                score = score + F.contains(text, F.lit(word)).cast("double")
            scores.append(score)
        return F.when(text.isNotNull(), argmax(F.array(*scores)))


def predict_temperature(
    df: DataFrame,
    model: PipelineModel | RuleClasses | Callable[[], Callable[[np.ndarray], np.ndarray]],
    text_col: str = C.COMBINED_TEXT,
    out: str = C.TEMP_SENTIMENT,
) -> DataFrame:
    """Add the temperature class 0-4, from a trained model, keyword rules or a predictor factory."""
    C.require_columns(df, text_col)
    if isinstance(model, RuleClasses):
        return df.withColumn(out, model.best(F.col(text_col)))
    if not isinstance(model, PipelineModel):
        return df.withColumn(out, predicted_class(F.col(text_col), model))
    keep = [F.col(f"`{c}`") for c in df.columns]
    asked = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    known = F.when(F.col(text_col).isNotNull(), F.col("_prediction").cast("int"))
    return model.transform(asked).select(*keep, known.alias(out))


def split_train_val(
    df: DataFrame, id_col: str, val_share: float = 0.2, seed: int = 42, out: str = "is_val"
) -> DataFrame:
    """Mark the validation rows by a hash of the id.

    Row-local and repeatable under any partitioning, so nothing is sorted or shuffled; the
    size is approximate. Seed 42 is the plain hash, other seeds salt the id.
    """
    C.require_columns(df, id_col)
    key = F.col(id_col).cast("string")
    key = key if seed == 42 else F.concat(F.lit(f"{seed}:"), key)
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % SPLIT_BUCKETS
    return df.withColumn(out, bucket < round(val_share * SPLIT_BUCKETS))


def _features(num_features: int) -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=num_features),
            IDF(inputCol="_counts", outputCol="_features"),
        ]
    )


def _few_parts(rows: DataFrame) -> DataFrame:
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def train_temperature_model(
    train: DataFrame,
    val: DataFrame,
    text_col: str = C.TEXT,
    label_col: str = "label",
    num_features: int = 1 << 18,
    max_iter: int = 50,
    reg_params: Sequence[float] = (0.0, 0.01, 0.1),
) -> PipelineModel:
    """Multinomial logistic regression on TF-IDF; the fit with the least validation loss stays.

    Features are computed once and cached; every fit is a distributed gradient sum. Each part of the
    training rows sends a dense gradient in every step, so there are no more parts than cores.
    """
    C.require_columns(train, text_col, label_col)

    def prepared(df: DataFrame) -> DataFrame:
        df = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
        return df.select(F.col(text_col).alias("_text"), F.col(label_col).cast("double").alias("_label"))

    featurizer = _features(num_features).fit(prepared(train))
    rows = _few_parts(featurizer.transform(prepared(train)).select("_label", "_features"))
    held = featurizer.transform(prepared(val)).select("_label", "_features")
    rows, held = rows.persist(StorageLevel.MEMORY_AND_DISK), held.persist(StorageLevel.MEMORY_AND_DISK)
    loss = MulticlassClassificationEvaluator(
        labelCol="_label", predictionCol="_prediction", probabilityCol="_probability", metricName="logLoss"
    )
    try:
        has_val = not held.isEmpty()
        fits = []
        for reg in reg_params:
            model = LogisticRegression(
                featuresCol="_features", labelCol="_label", predictionCol="_prediction",
                probabilityCol="_probability", rawPredictionCol="_raw",
                family="multinomial", regParam=reg, maxIter=max_iter,
            ).fit(rows)
            fits.append((loss.evaluate(model.transform(held)) if has_val else 0.0, model))
    finally:
        rows.unpersist()
        held.unpersist()
    best = min(fits, key=lambda f: f[0])[1]
    return PipelineModel(stages=[*featurizer.stages, best])


def rule_predictor(keywords: Sequence[Sequence[str]]) -> Callable[[], Callable]:
    """A predictor without weights: scores class ``i`` by the ``keywords[i]`` it finds.

    Useful where no trained model is at hand; no keyword at all gives the mild class.
    """

    def factory() -> Callable[[np.ndarray], np.ndarray]:
        mild = TEMP_LABELS.index("mild/not relevant")

        def predict(texts: np.ndarray) -> np.ndarray:
            scores = np.zeros((len(texts), len(keywords)))
            scores[:, mild] = 0.5
            for row, text in enumerate(texts):
                for i, words in enumerate(keywords):
                    scores[row, i] += sum(word in text for word in words)
            return scores

        return predict

    return factory


def classification_metrics(
    df: DataFrame, label_col: str = "label", prediction_col: str = "prediction"
) -> DataFrame:
    """One row: ``accuracy, f1, precision, recall``, the last three weighted by support.

    One count per (label, prediction) pair; everything after it is arithmetic on at most
    classes x classes rows. Undefined ratios count as 0.
    """
    C.require_columns(df, label_col, prediction_col)
    pairs = (
        df.groupBy(F.col(label_col).alias("label"), F.col(prediction_col).alias("prediction"))
        .agg(F.count("*").alias("n"))
        .where(F.col("label").isNotNull() & F.col("prediction").isNotNull())
    )
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    per_class = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    per_class = per_class.select(
        "support",
        "hits",
        ratio(hits, predicted).alias("p"),
        ratio(hits, support).alias("r"),
        ratio(2 * hits, support + predicted).alias("f"),
    )
    total = F.sum("support")
    return per_class.agg(
        (F.sum("hits") / total).alias("accuracy"),
        (F.sum(F.col("f") * support) / total).alias("f1"),
        (F.sum(F.col("p") * support) / total).alias("precision"),
        (F.sum(F.col("r") * support) / total).alias("recall"),
    )
