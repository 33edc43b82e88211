"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import byte_texts, held_out, slices

#: Labelled rows that a fit takes at most; the ones whose ids hash lowest.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 60, 4, 64, 0.2, 1.0, 2.0
PREDICTED_FROM = 0.3

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SIGNS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b"!", b"?", b".", b",", b"=", b"/", b'"')


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text; shares and logarithms, so that length alone moves few."""
    n, words = max(1, len(text)), text.split()
    n_words = max(1, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) if len(words) > 2 else 0
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        len(text) / n_words,
        len(set(words)) / n_words,
        triples / max(1, len(words) - 2),
        len(set(lines)) / max(1, len(lines)),
        n_words / max(1, len(lines)),
        max(map(len, words), default=0) / 10.0,
        share(UPPER),
        share(DIGITS),
        share(LETTERS),
        *[text.count(s) / n_words for s in SIGNS],
    ]


@dataclass(frozen=True)
class Forest:
    """Trees of one depth as arrays: node ``k`` has the children ``2k+1`` and ``2k+2``."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boosted trees by logistic loss; every level takes its splits from histograms.

    Without rows, or with one class, the forest is the smoothed share of label 1.
    """
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        trees = 0
    inner = 2**DEPTH - 1
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if trees:
        steps = np.arange(1, BINS) / BINS
        cuts = [np.unique(np.quantile(x[:, f], steps)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), start)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            at = (node - first) * BINS
            for f, c in enumerate(cuts):
                g, h = (
                    np.bincount(at + binned[:, f], w, width * BINS).reshape(width, BINS)
                    for w in (grad, hess)
                )
                g_left, h_left = g.cumsum(axis=1), h.cumsum(axis=1)
                g_all, h_all = g_left[:, -1:], h_left[:, -1:]
                gain = (
                    g_left**2 / (h_left + RIDGE)
                    + (g_all - g_left) ** 2 / (h_all - h_left + RIDGE)
                    - g_all**2 / (h_all + RIDGE)
                )
                gain[(h_left < LEAST_WEIGHT) | (h_all - h_left < LEAST_WEIGHT)] = 0
                gain = gain[:, : len(c)]
                if not gain.size:
                    continue
                cut = gain.argmax(axis=1)
                top = gain[np.arange(width), cut]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k] = top[k]
                    feature[t, first + k], threshold[t, first + k] = f, c[cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > threshold[t, node])
        g = np.bincount(node - inner, grad, inner + 1)
        h = np.bincount(node - inner, hess, inner + 1)
        leaf[t] = -RATE * g / (h + RIDGE)
        margin += leaf[t, node - inner]
    return Forest(start, feature, threshold, leaf)


def _statistics(batches) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches):
        x = [statistics(t) for t in byte_texts(rows.column(1))]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"]
        )


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest:
    """A forest from at most ``train_rows`` labelled documents outside the held-out fifth.

    Which rows it takes, and so the forest, depends on the ids alone. Repeated labels of an id
    count once (the highest), rows without a label not at all; of rows that share an id
    the one with the lowest statistics counts. Only the sample's ids are broadcast and only its
    statistics come to the driver, both within the bound.
    """
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    labels = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id")
    sample = labels.agg(F.max("quality").alias("y"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id")
    x = texts.mapInArrow(_statistics, f"doc_id {kind}, x array<double>")
    rows = x.groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(sample), "doc_id")
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    n_features = len(statistics(b""))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), n_features)
    return fit(x, np.array([r["y"] for r in rows], float))


def score_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, score`` for every row; a null text counts as an empty one, which has a score too."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            x = np.array([statistics(t) for t in byte_texts(rows.column(1))])
            score = pa.array(forest.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([rows.column(0), score], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
