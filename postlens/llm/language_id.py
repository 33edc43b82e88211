"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import held_out, slices, summed_counts

#: Documents a fit takes at most, and of one language; the ones whose ids hash lowest.
TRAIN_ROWS, TRAIN_ROWS_PER_LANGUAGE = 5000, 1000
SIZES, BITS = (1, 2, 3), 15
#: FTRL: learning rate, its smoothing, and the elastic net's two penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 2
UNKNOWN = "und"
#: Temperatures are sought from this to its inverse, far beyond any that fits.
LEAST_TEMPERATURE = 1e-4


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the letters of a whole text, and how often each comes.

    Letters are lower-cased; everything between two words is one blank. Nothing without a letter.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    none = np.empty(0, np.int64)
    if not letter.any():
        return none, none
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    found = []
    for size in SIZES:
        n = len(codes) - size + 1
        if n < 1:
            continue
        h = np.full(n, size, np.uint64)
        for at in range(size):
            h = (h ^ codes[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        found.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    counts = np.bincount(np.concatenate(found), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class Model:
    """Weights by (n-gram, language), the n-grams' IDF, and the temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def values(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[at]
        return x / max(1e-12, float(np.sqrt((x * x).sum())))

    def chances(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = self.values(at, counts) @ self.weights[at] + self.bias
        e = np.exp((logits - logits.max()) / self.temperature)
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = ngram_counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        chances = self.chances(at, counts)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], model: Model) -> Model:
    """One pass after another over ``(n-grams, counts, language)`` with FTRL-proximal steps.

    The L1 penalty keeps weights at zero until their summed gradients pass it, L2 shrinks them.
    """
    n_languages = len(model.languages)
    z, n = np.zeros((2, 1 << BITS, n_languages))
    bias = np.zeros(n_languages)

    def weights(z, n):
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for row in order:
            at, counts, y = rows[row]
            x = model.values(at, counts)
            z_at, n_at = z[at], n[at]
            w = weights(z_at, n_at)
            logits = x @ w + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1.0
            g = np.outer(x, p)
            squares = n_at + g * g
            z[at] = z_at + g - (np.sqrt(squares) - np.sqrt(n_at)) / ALPHA * w
            n[at] = squares
            bias -= 0.05 * p
    return Model(model.languages, weights(z, n), bias, model.idf)


def calibrated(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """The model at the temperature at which rows that it has not seen are likeliest.

    Of n rows each counts as right to (n + 1) parts and as any other language to 1 part in all, as
    if one row more had been wrong: without it rows that are all told right would ask for
    a temperature of zero. The loss has one minimum in the logarithm of the temperature, which a
    golden section search closes in on from far outside.
    """
    if not rows or len(model.languages) < 2:
        return model
    logits = np.stack([model.values(a, c) @ model.weights[a] + model.bias for a, c, _ in rows])
    right = np.array([y for *_, y in rows])
    others = 1 / (len(rows) + 2) / (len(model.languages) - 1)
    target = np.full(logits.shape, others)
    target[np.arange(len(rows)), right] = 1 - 1 / (len(rows) + 2)

    def loss(log_temperature: float) -> float:
        scaled = logits / np.exp(log_temperature)
        top = scaled.max(axis=1, keepdims=True)
        logs = scaled - top - np.log(np.exp(scaled - top).sum(axis=1, keepdims=True))
        return -(target * logs).sum()

    low, high = np.log(LEAST_TEMPERATURE), np.log(1 / LEAST_TEMPERATURE)
    golden = (np.sqrt(5) - 1) / 2
    left, right_end = high - golden * (high - low), low + golden * (high - low)
    at_left, at_right = loss(left), loss(right_end)
    while high - low > 1e-4:
        if at_left <= at_right:
            high, right_end, at_right = right_end, left, at_left
            left = high - golden * (high - low)
            at_left = loss(left)
        else:
            low, left, at_left = left, right_end, at_right
            right_end = low + golden * (high - low)
            at_right = loss(right_end)
    best = float(np.exp((low + high) / 2))
    return Model(model.languages, model.weights, model.bias, model.idf, best)


def _frequencies(batches) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((1 << BITS) + 1, np.int64)
    for rows in slices(batches):
        for text in rows.column(0).to_pylist():
            counts[ngram_counts(text)[0]] += 1
        counts[-1] += rows.num_rows
    if counts[-1]:
        columns = [[0], [TaskContext.get().partitionId()], [counts.tobytes()]]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "task", "counts"])


def _samples(batches) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches):
        grams = [ngram_counts(t) for t in rows.column("text").to_pylist()]
        at = pa.array([g[0].astype(np.uint16).tobytes() for g in grams])
        counts = pa.array([g[1].astype(np.uint32).tobytes() for g in grams])
        kept = [rows.column(n) for n in ("doc_id", "lang")]
        yield pa.RecordBatch.from_arrays([*kept, at, counts], ["doc_id", "lang", "at", "counts"])


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, per_language: int = TRAIN_ROWS_PER_LANGUAGE):
    """A model from documents outside the held-out fifth whose language is known.

    Document frequencies count all of these; the weights are fitted on a bounded sample that
    depends on the ids alone, and a fifth of it sets the temperature. Only the sample's ids are
    broadcast and only its n-gram counts come to the driver. Rows without id, text or
    language are not learned from; of rows that share an id one counts.
    """
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    ).where(~held_out(F.col("doc_id")))
    tasks = known.select("text").mapInArrow(_frequencies, "part int, task int, counts binary")
    counts = summed_counts(tasks).get(0)
    if counts is None:
        return Model((), np.zeros((1 << BITS, 0)), np.zeros(0), np.zeros(1 << BITS))
    idf = np.log((1.0 + counts[-1]) / (1.0 + counts[:-1])) + 1.0
    by_language = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = known.select("doc_id", "lang").withColumn("nth", F.row_number().over(by_language))
    sample = sample.where(F.col("nth") <= per_language).orderBy("nth", "lang").limit(train_rows)
    sample = sample.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"])
    rows = rows.mapInArrow(_samples, f"doc_id {kind}, lang string, at binary, counts binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "at", "counts")).alias("r"))
    rows = sorted(rows.select("doc_id", "r.*").collect(), key=lambda r: r["doc_id"])
    languages = tuple(sorted({r["lang"] for r in rows}))
    number = {name: i for i, name in enumerate(languages)}
    data = [
        (
            np.frombuffer(r["at"], np.uint16).astype(np.int64),
            np.frombuffer(r["counts"], np.uint32),
            number[r["lang"]],
        )
        for r in rows
    ]
    data = [d for d in data if len(d[0])]
    empty = Model(languages, np.zeros((1 << BITS, len(languages))), np.zeros(len(languages)), idf)
    model = fit_ftrl([d for i, d in enumerate(data) if i % 5], empty)
    return calibrated(model, data[::5])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; ``und`` and 0 where no letter is."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for rows in slices(batches):
            found = [own.predict(t) for t in rows.column(1).to_pylist()]
            columns = [rows.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double"
    )
