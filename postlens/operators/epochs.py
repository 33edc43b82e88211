"""Training by epochs: batches in a seeded order, the best epoch kept, resumed where it stopped.

The weights are a dense matrix of ``num_features`` rows and a column per class: its size is set by
parameters and does not grow with the posts. Gradients of a batch are summed in Spark, one
row per feature, in whole units, so that a run gives the same bits on any layout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import Normalizer
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions.labels import TEMP_LABELS
from postlens.operators.classify import _features
from postlens.sources.staging import stage, staging_path

#: Gradients are summed in units of this fraction.
UNIT = 1 << 30
#: Row of a gradient that holds the intercepts; of a loss, its sum and the rows. The row that counts rows.
INTERCEPT, COUNT = -1, -2


@dataclass(frozen=True)
class Schedule:
    """How steps are taken. ``warmup`` is the share of all steps in which the rate rises."""

    epochs: int = 3
    batches: int = 16
    rate: float = 0.05
    warmup: float = 0.1
    weight_decay: float = 0.01
    patience: int | None = None
    seed: int = 42

    def rate_at(self, step: int) -> float:
        whole = self.epochs * self.batches
        rising = max(1, round(self.warmup * whole))
        if step <= rising:
            return self.rate * step / rising
        return self.rate * max(0.0, (whole - step + 1) / max(1, whole - rising))


@dataclass
class _State:
    """Weights with the intercepts as last row, and the running moments of their gradients."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    epoch: int = 0

    @classmethod
    def start(cls, num_features: int, classes: int) -> _State:
        return cls(*(np.zeros((num_features + 1, classes)) for _ in range(3)))

    def step(self, gradient: np.ndarray, step: int, schedule: Schedule) -> None:
        """Adam with decay of the weights (not of the intercepts) apart from the gradient."""
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        move = (self.first / (1 - 0.9**step)) / (np.sqrt(self.second / (1 - 0.999**step)) + 1e-8)
        rate = schedule.rate_at(step)
        self.weights[:-1] *= 1 - rate * schedule.weight_decay
        self.weights -= rate * move

    def save(self, spark: SparkSession, path: str) -> None:
        used = np.flatnonzero(self.second.any(axis=1) | self.weights.any(axis=1))
        columns = {"feature": pa.array(used.astype(np.int64))}
        for name in ("weights", "first", "second"):
            rows = getattr(self, name)[used]
            offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
            columns[name] = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
        spark.createDataFrame(pa.table(columns)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, num_features: int, classes: int, epoch: int) -> _State:
        state = cls.start(num_features, classes)
        held = spark.read.parquet(path).toArrow()
        rows = held.column("feature").to_numpy()
        for name in ("weights", "first", "second"):
            flat = pa.concat_arrays(held.column(name).chunks).flatten().to_numpy()
            getattr(state, name)[rows] = flat.reshape(-1, classes)
        state.epoch = epoch
        return state


def _rows(featurizer: PipelineModel, df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id, label, index, value``: the labelled texts as sparse rows; a written table."""
    known = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(text_col).alias("_text"),
        F.col(label_col).cast("int").alias("label"),
    )
    vectors = featurizer.transform(known).select("id", "label", F.unwrap_udt("_unit").alias("v"))
    return stage(vectors.select("id", "label", "v.indices", "v.values"), "feature-rows")


def _scores(batch: pa.RecordBatch, weights: np.ndarray):
    """Sparse rows of a batch as flat arrays, labels, and the class probabilities of each."""
    index = batch.column("indices")
    sizes = np.diff(index.offsets.to_numpy())
    index = index.flatten().to_numpy(zero_copy_only=False)
    value = batch.column("values").flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # a row's terms are added in their order, its intercept first
    places = np.concatenate([np.arange(len(sizes)), owner])
    terms = np.concatenate([np.tile(weights[-1], (len(sizes), 1)), weights[index] * value[:, None]])
    scores = _summed(places, terms, len(sizes))
    scores -= scores.max(axis=1, keepdims=True)
    chances = np.exp(scores)
    chances /= chances.sum(axis=1, keepdims=True)
    return index, value, owner, batch.column("label").to_numpy(zero_copy_only=False), chances


def _summed(places: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    """Column by column, the sum of the terms of each of ``n`` places."""
    return np.stack([np.bincount(places, c, n) for c in terms.T], axis=1)


_SUMS = "feature long, sums array<long>"


def _as_rows(features: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return _unit_rows(features, np.rint(sums * UNIT).astype(np.int64))


def _unit_rows(features: np.ndarray, units: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(0, units.size + 1, units.shape[1], dtype=np.int32)
    lists = pa.ListArray.from_arrays(offsets, pa.array(units.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(features.astype(np.int64)), lists], ["feature", "sums"])


def _gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Mean of the gradients of ``rows``, and how many they are: a row per feature from Spark.

    A task sums all its rows before it sends a row per feature.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    weights_shape = weights.shape
    classes = weights_shape[1]

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(weights_shape, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            index, value, owner, label, miss = _scores(batch, shared.value)
            miss[np.arange(len(label)), label] -= 1
            # each row is rounded by itself: the sum is then the same however rows are batched
            units = np.rint(miss[owner] * value[:, None] * UNIT)
            features, place = np.unique(index, return_inverse=True)
            sums[features] += _summed(place, units, len(features)).astype(np.int64)
            sums[-1] += np.rint(miss * UNIT).sum(axis=0).astype(np.int64)
            n += len(label)
        if n:
            features = np.flatnonzero(sums[:-1].any(axis=1))
            counted = np.full((1, classes), n)
            yield _unit_rows(np.append(features, [INTERCEPT, COUNT]), np.concatenate([sums[features], sums[-1:], counted]))

    sums = rows.select("label", "indices", "values").mapInArrow(of_task, _SUMS)
    each = [F.sum(F.get("sums", F.lit(i))).alias(str(i)) for i in range(classes)]
    total = sums.groupBy("feature").agg(*each).toArrow()
    shared.unpersist()
    gradient, n = np.zeros_like(weights), 0
    if total.num_rows:
        features = total.column("feature").to_numpy()
        table = np.stack([total.column(str(i)).to_numpy() for i in range(classes)], axis=1)
        n = int(table[features == COUNT][0, 0])
        own = features != COUNT
        gradient[features[own]] = table[own] / UNIT
    return gradient / max(1, n), n


def _loss(rows: DataFrame, weights: np.ndarray) -> float:
    """Mean negative log probability of the labels; 0 without rows."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *_, label, chances = _scores(batch, shared.value)
                lost = -np.log(np.maximum(chances[np.arange(len(label)), label], 1e-15))
                lost = (np.rint(lost * UNIT) / UNIT).sum()
                yield _as_rows(np.array([INTERCEPT]), np.array([[lost, len(label) / UNIT]]))

    sums = rows.select("label", "indices", "values").mapInArrow(of_task, _SUMS)
    total = sums.agg(*[F.sum(F.get("sums", F.lit(i))).alias(str(i)) for i in range(2)]).first()
    shared.unpersist()
    return total["0"] / UNIT / total["1"] if total["1"] else 0.0


def read_progress(spark: SparkSession, path: str) -> list[dict]:
    """``epoch, loss, state`` of the epochs that a run in ``path`` has finished, in order."""
    try:
        rows = spark.read.parquet(f"{path}/progress").collect()
    except AnalysisException:
        return []
    by_epoch = {r["epoch"]: r.asDict() for r in rows}
    return [by_epoch[e] for e in sorted(by_epoch)]


def _model(state: _State, featurizer: PipelineModel) -> PipelineModel:
    spark = SparkSession.active()
    context, classes = spark.sparkContext, state.weights.shape[1]
    # Spark's model keeps a row per class
    matrix = DenseMatrix(classes, len(state.weights) - 1, state.weights[:-1].ravel().tolist())
    intercepts = DenseVector(state.weights[-1])
    java = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "epochs", _py2java(context, matrix), _py2java(context, intercepts), classes, True
    )
    model = LogisticRegressionModel(java)
    model.setFeaturesCol("_unit").setPredictionCol("_prediction")
    model.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    return PipelineModel(stages=[*featurizer.stages, model])


def train_by_epochs(
    train: DataFrame,
    val: DataFrame,
    path: str,
    id_col: str,
    text_col: str = C.TEXT,
    label_col: str = "label",
    classes: int = len(TEMP_LABELS),
    num_features: int = 1 << 18,
    schedule: Schedule | None = None,
    stop_after: int | None = None,
) -> PipelineModel:
    """Softmax regression on TF-IDF, trained in epochs; the epoch of least validation loss stays.

    In each epoch a hash of id, seed and epoch deals the rows into batches, each of
    which is one step. After an epoch the validation loss and the whole state are written to
    ``path``; called again with the same arguments, training goes on after the last written epoch
    and ends as if it had never stopped. ``stop_after`` ends a call after that epoch.
    ``schedule.patience`` ends training after so many epochs without a better loss. Without
    validation rows the last epoch stays. Labels are 0 to ``classes - 1``.
    """
    C.require_columns(train, id_col, text_col, label_col)
    schedule = schedule or Schedule()
    spark = train.sparkSession
    progress = read_progress(spark, path)
    if progress:
        featurizer = PipelineModel.load(f"{path}/features")
        last = progress[-1]
        state = _State.load(spark, last["state"], num_features, classes, last["epoch"])
    else:
        known = train.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
        # texts of all lengths weigh the same
        unit = Normalizer(inputCol="_features", outputCol="_unit")
        steps = Pipeline(stages=[*_features(num_features).getStages(), unit])
        featurizer = steps.fit(known.select(F.col(text_col).alias("_text")))
        featurizer.write().overwrite().save(f"{path}/features")
        state = _State.start(num_features, classes)
    rows = _rows(featurizer, train, id_col, text_col, label_col)
    held = _rows(featurizer, val, id_col, text_col, label_col)
    until = min(schedule.epochs, stop_after or schedule.epochs)
    while state.epoch < until and not _no_better(progress, schedule.patience):
        epoch = state.epoch + 1
        deal = F.pmod(F.xxhash64("id", F.lit(schedule.seed), F.lit(epoch)), F.lit(schedule.batches))
        # a folder for each batch, so that a step reads its own rows only
        folder = staging_path(spark, "epoch")
        dealt = rows.withColumn("batch", deal)
        dealt.write.partitionBy("batch").parquet(folder)
        dealt = spark.read.schema(dealt.schema).parquet(folder)
        for b in range(schedule.batches):
            gradient, n = _gradient(dealt.where(F.col("batch") == b), state.weights)
            if n:
                state.step(gradient, state.epoch * schedule.batches + b + 1, schedule)
        state.epoch = epoch
        saved = f"{path}/epoch-{epoch}"
        state.save(spark, saved)
        done = {"epoch": epoch, "loss": _loss(held, state.weights), "state": saved}
        progress.append(done)
        line = spark.createDataFrame([tuple(done.values())], "epoch int, loss double, state string")
        line.coalesce(1).write.mode("append").parquet(f"{path}/progress")
    if not progress:
        return _model(state, featurizer)
    best = progress[-1] if held.isEmpty() else min(progress, key=lambda p: (p["loss"], p["epoch"]))
    return _model(_State.load(spark, best["state"], num_features, classes, best["epoch"]), featurizer)


def _no_better(progress: list[dict], patience: int | None) -> bool:
    if patience is None or len(progress) <= patience:
        return False
    best = min(p["loss"] for p in progress[:-patience])
    return all(p["loss"] >= best for p in progress[-patience:])
