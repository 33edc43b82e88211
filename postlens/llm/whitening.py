"""Whitening of embeddings by refined eigenvectors of their covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.sources.staging import stage

#: Steps per unit of an embedding entry.
GRID = 256
LARGEST = 2.0**61
COMPONENTS = 4
FAN_IN = 64
MAX_STEPS = 60
#: Rows of a block, so that a task holds few vectors as doubles.
BLOCK_ROWS = 4096
_LIMB = 24
_PARTIAL = "task int, sums binary"


@dataclass(frozen=True)
class Whitener:
    """What whitening needs of a fit list: bounded by the square of the dimension.

    ``sums`` are exact. ``vectors`` holds one component per column, by falling eigenvalue.
    """

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def projected(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened coordinates of grid vectors; nan on components without variance."""
        centred = (self._centred(x) / self.n).astype(float)
        values = self.values[:components]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred @ self.vectors[:, :components]) / np.sqrt(values)
        out[:, values <= 0] = np.nan
        return out

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of ``(n * x - sum)^2``, exact; None beyond a long."""
        centred = self._centred(x)
        if centred.size and centred.dtype != object:
            largest = float(np.abs(centred).max())
            if largest * largest * centred.shape[1] < 2.0**62:
                return (centred * centred).sum(axis=1).tolist()
        exact = [sum(int(v) * int(v) for v in row) for row in centred]
        return [v if v < 2**63 else None for v in exact]

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sum`` in integers, of any size where longs do not hold them."""
        largest = max([abs(int(x.max())), abs(int(x.min()))]) if x.size else 0
        if largest * self.n + max(map(abs, self.sums), default=0) < 2**62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)


def grid_vector(vector: Column) -> Column:
    """Entries as longs: the floor of ``GRID`` times the entry, taken as double.

    What would be beyond ``LARGEST`` either way is held there.
    """
    held = lambda c: F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.transform(vector, lambda c: F.floor(held(c.cast("double") * GRID)).cast("long"))


def _usable(vector: Column) -> Column:
    finite = F.forall(
        vector,
        lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)),
    )
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def grid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x``: the rows with a vector, as grid vectors of one length.

    Null and empty vectors and vectors with null or non-finite entries are left out, and so
    are vectors whose length is not the commonest one (of equally common ones the longest).
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("vector")).where(_usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    common = lengths.first()
    rows = rows.where(F.size("vector") == (common["d"] if common else 0))
    return rows.select("id", grid_vector(F.col("vector")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            yield part, _matrix(part.column("x"))


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [np.frombuffer(s, np.float64) for s in pdf.sort_values("task")["sums"]]
    return pdf.head(1).assign(sums=[np.sum(parts, axis=0).tobytes()])


def summed(vectors: DataFrame, size: int, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``partial(block)`` over all blocks of ``x``: a row per task, then a tree of
    ``FAN_IN``. What reaches the driver are a few vectors of ``size`` doubles."""

    def of_task(batches):
        total = np.zeros(size)
        for _, x in _blocks(batches):
            total += partial(x)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {"task": pa.array([task], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())}
        )

    tasks = vectors.select("x").mapInArrow(of_task, _PARTIAL)
    for _ in range(3):
        tasks = tasks.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int"))
        tasks = tasks.groupBy("task").applyInPandas(_added, _PARTIAL)
    parts = [np.frombuffer(r["sums"], np.float64) for r in tasks.orderBy("task").collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(size)


def _count_and_limbs(x: np.ndarray) -> np.ndarray:
    """Rows, and per dimension the sums of the high and low bits: exact as doubles."""
    low = x & ((1 << _LIMB) - 1)
    return np.concatenate([[len(x)], (x >> _LIMB).sum(axis=0), low.sum(axis=0)]).astype(float)


def covariance(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...], np.ndarray]:
    """Rows, exact sums and the covariance (divisor n) of distinct grid vectors.

    Entries are centred on the rounded mean before they are multiplied. Their products are
    integers, so their sums do not depend on the order of the tasks below 2^53; what
    the rounding of the mean leaves is taken off at the end.
    """
    counts = summed(fit, 2 * d + 1, _count_and_limbs)
    n = int(counts[0])
    high, low = counts[1 : d + 1], counts[d + 1 :]
    sums = tuple((int(h) << _LIMB) + int(v) for h, v in zip(high, low, strict=True))
    centre = [(2 * s + n) // (2 * n) for s in sums]
    middle = np.array(centre, np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - middle).astype(float)
        return (y.T @ y).ravel()

    total = summed(fit, d * d, products).reshape(d, d).astype(np.longdouble)
    left = np.array([s - n * c for s, c in zip(sums, centre, strict=True)], np.longdouble) / n
    matrix = total / n - np.outer(left, left)
    return n, sums, (matrix + matrix.T) / 2


def _clusters(values: np.ndarray, gap: np.longdouble) -> list[np.ndarray]:
    """Indices of eigenvalues that a chain of gaps within ``gap`` ties together."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > gap) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def _step(a: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction by matrix multiplication in the precision of ``a``.

    Eigenvalues nearer to each other than the correction can tell apart are only made
    orthogonal; then the small matrix of each such cluster, shifted by its mean so
    that its own differences keep their digits, is solved and turns the cluster's vectors.
    """
    one = np.eye(len(a), dtype=a.dtype)
    defect = one - vectors.T @ vectors
    image = vectors.T @ (a @ vectors)
    values = np.diag(image) / (1 - np.diag(defect))
    off = image - np.diag(values)
    scale = np.abs(a).sum(axis=0).max()
    gap = 2 * (np.sqrt((off**2).sum()) + scale * np.sqrt((defect**2).sum()))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    correction = np.where(
        far, (image + values[None, :] * defect) / np.where(far, apart, 1), defect / 2
    )
    vectors = vectors + vectors @ correction
    moved = np.abs(correction).max()
    for part in _clusters(values, gap):
        own = vectors[:, part]
        mean = values[part].mean()
        small = own.T @ (a @ own - mean * own)
        small = (small + small.T) / 2
        size = np.abs(small).max()
        if size > np.finfo(a.dtype).eps * scale:
            _, turn = np.linalg.eigh((small / size).astype(np.float64))
            turn = turn[:, ::-1].astype(a.dtype)
            turn = turn @ (3 * np.eye(len(part), dtype=a.dtype) - turn.T @ turn) / 2
            vectors[:, part] = own @ turn
    return vectors, values, float(moved)


def refined_eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix.

    The start are eigenvectors in single precision. They are corrected in double precision
    until nothing moves any more, then in extended precision. Each vector's largest entry
    is positive. Equal eigenvalues give any orthonormal vectors of their space.
    """
    exact = np.asarray(matrix, np.longdouble)
    size = np.abs(exact).max() if exact.size else 0
    if not size > 0:
        return np.zeros(len(exact)), np.eye(len(exact))
    exact = exact / size
    vectors = np.linalg.eigh(exact.astype(np.float32))[1]
    for kind in (np.float64, np.longdouble):
        a, vectors = exact.astype(kind), vectors.astype(kind)
        least = 8 * len(a) * float(np.finfo(kind).eps)
        before = np.inf
        for _ in range(MAX_STEPS):
            vectors, values, moved = _step(a, vectors)
            if moved <= least or (moved < 1e-6 and moved > before / 2):
                break
            before = moved
    for _ in range(2):
        vectors = vectors @ (3 * np.eye(len(a), dtype=a.dtype) - vectors.T @ vectors) / 2
    values = np.einsum("ij,ij->j", vectors, a @ vectors) / (vectors**2).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.sqrt((vectors[:, order] ** 2).sum(axis=0))
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(len(vectors))])
    values = values[order]
    # what rounding leaves of a variance of zero is none
    values = np.where(values > len(values) * np.finfo(np.float64).eps * values[0], values, 0)
    return (values * size).astype(float), vectors.astype(float)


def fit_whitener(vectors: DataFrame) -> tuple[Whitener, DataFrame] | None:
    """The whitener of the distinct ``x`` of ``vectors`` and that fit list, a written table.

    Equal vectors meet as partial rows, so a vector that a third of all rows share costs
    one row per task. None if there are no vectors.
    """
    fit = stage(vectors.select("x").distinct(), "fit-list")
    first = fit.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    n, sums, matrix = covariance(fit, first["d"])
    values, components = refined_eigenvectors(matrix)
    return Whitener(n, sums, components, values, float(np.trace(matrix))), fit


def identity_error(fit: DataFrame, whitener: Whitener, components: int = COMPONENTS) -> float:
    """Largest entry by which the covariance of the whitened fit list differs from one.

    Measured over all rows of the fit list. Components without variance do not count;
    with none that counts it is 0.
    """
    k = int((whitener.values[:components] > 0).sum())

    def moments(x: np.ndarray) -> np.ndarray:
        w = whitener.projected(x, k).astype(float)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    if k == 0:
        return 0.0
    total = summed(fit, k + k * k, moments) / whitener.n
    spread = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    return float(np.abs(spread - np.eye(k)).max())


def whiten(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """``id, deviation, whitened, n, explained, identity_error`` for each row with a vector.

    ``whitened`` and ``explained`` are arrays over the first ``components`` components (all,
    if the vectors have fewer entries). Vectors are fitted once each, however often they
    occur; ids may repeat or be null and every row keeps its own result. Rows without
    a usable vector (see ``grid_vectors``) have no result, an empty table gives no rows. Only
    the two named columns are read, so other columns and their names do not matter.
    A component without variance is null in ``whitened`` and 0 in ``explained``; a
    ``deviation`` beyond a long is null.
    """
    vectors = grid_vectors(df, id_col, vector_col)
    kind = vectors.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, deviation long, whitened array<double>, n long, "
        "explained array<double>, identity_error double"
    )
    fitted = fit_whitener(vectors)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    whitener, fit = fitted
    shown = min(components, len(whitener.values))
    error = identity_error(fit, whitener, shown)
    share = whitener.values[:shown] / (whitener.trace or 1.0)

    def rows(batches):
        for part, x in _blocks(batches):
            white = whitener.projected(x, shown).astype(float)
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)
            offsets = np.arange(0, white.size + 1, shown, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(whitener.deviation(x), pa.int64()),
                    pa.ListArray.from_arrays(offsets, flat),
                ],
                ["id", "deviation", "whitened"],
            )

    done = vectors.mapInArrow(rows, schema.split(", n long")[0])
    explained = F.array(*[F.lit(float(s)) for s in share])
    return done.withColumns(
        {
            "n": F.lit(whitener.n).cast("long"),
            "explained": explained,
            "identity_error": F.lit(error),
        }
    )
