"""Priors of Dirichlet distributions, learned from tables of mean logarithms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from postlens.functions.special import digamma, trigamma


#: Largest part of an entry that one step may take off.
LARGEST_CUT = 0.8


def newton_step(prior: np.ndarray, mean_log: np.ndarray, n: float, rate: float = 1.0) -> np.ndarray:
    """One Newton step of a small prior towards ``n`` draws with these mean logarithms.

    The Hessian is a diagonal plus a constant, so the step needs two sums only. A step that
    would take more than ``LARGEST_CUT`` off an entry is made shorter, so entries stay positive.
    """
    gradient = n * (digamma(prior.sum()) - digamma(prior) + mean_log)
    curve = -n * trigamma(prior)
    shared = n * trigamma(prior.sum())
    level = (gradient / curve).sum() / (1 / shared + (1 / curve).sum())
    step = -(gradient - level) / curve
    return prior + _shortened(rate, (-step / prior).max()) * step


def _shortened(rate: float, cut: float) -> float:
    return LARGEST_CUT / cut if rate * cut > LARGEST_CUT else rate


def newton_step_table(table: DataFrame, n: float, rate: float = 1.0) -> DataFrame:
    """The same step for a prior with an entry per row: ``table(..., prior, mean_log)``.

    Sums over the table, then the step in place; no entry leaves its row. ``prior`` is
    replaced, the other columns stay. Read several times, so pass a written table. Both columns may
    also be binary cells, each with the doubles of many entries.
    """
    if table.schema["prior"].dataType == BinaryType():
        return _newton_step_cells(table, n, rate)
    total = float(table.agg(F.sum("prior")).first()[0] or 0.0)
    if not total:
        return table
    at_total, shared = float(digamma(total)), float(n * trigamma(total))

    @F.pandas_udf("gradient double, curve double")
    def slopes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for prior, mean_log in batches:
            p = prior.to_numpy(float)
            gradient = n * (at_total - digamma(p) + mean_log.to_numpy(float))
            yield pd.DataFrame({"gradient": gradient, "curve": -n * trigamma(p)})

    step = table.withColumn("_s", slopes("prior", "mean_log"))
    gradient, curve = F.col("_s.gradient"), F.col("_s.curve")
    sums = step.agg(F.sum(gradient / curve).alias("g"), F.sum(1 / curve).alias("h")).first()
    level = sums["g"] / (1 / shared + sums["h"])
    step = step.withColumn("_by", -(gradient - F.lit(level)) / curve)
    cut = step.agg(F.max(-F.col("_by") / F.col("prior"))).first()[0]
    moved = F.col("prior") + F.lit(_shortened(rate, cut)) * F.col("_by")
    return step.withColumn("prior", moved).drop("_s", "_by")


def _newton_step_cells(table: DataFrame, n: float, rate: float) -> DataFrame:
    @F.pandas_udf("double")
    def sums(cells: pd.Series) -> pd.Series:
        return cells.map(lambda cell: np.frombuffer(cell).sum()).astype(float)

    total = float(table.agg(F.sum(sums("prior"))).first()[0] or 0.0)
    if not total:
        return table
    at_total, shared = float(digamma(total)), float(n * trigamma(total))

    def slopes(prior: bytes, mean_log: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.frombuffer(prior)
        return p, n * (at_total - digamma(p) + np.frombuffer(mean_log)), -n * trigamma(p)

    @F.pandas_udf("g double, h double")
    def slope_sums(prior: pd.Series, mean_log: pd.Series) -> pd.DataFrame:
        rows = [slopes(*cells) for cells in zip(prior, mean_log, strict=True)]
        return pd.DataFrame([((g / c).sum(), (1 / c).sum()) for _, g, c in rows], columns=["g", "h"], dtype=float)

    both = table.select(slope_sums("prior", "mean_log").alias("s"))
    both = both.agg(F.sum("s.g").alias("g"), F.sum("s.h").alias("h")).first()
    level = both["g"] / (1 / shared + both["h"])

    @F.pandas_udf("double")
    def cuts(prior: pd.Series, mean_log: pd.Series) -> pd.Series:
        rows = [slopes(*cells) for cells in zip(prior, mean_log, strict=True)]
        return pd.Series([((g - level) / c / p).max() for p, g, c in rows], dtype=float)

    shortened = _shortened(rate, table.agg(F.max(cuts("prior", "mean_log"))).first()[0])

    @F.pandas_udf("binary")
    def moved(prior: pd.Series, mean_log: pd.Series) -> pd.Series:
        rows = [slopes(*cells) for cells in zip(prior, mean_log, strict=True)]
        return pd.Series([(p + shortened * (-(g - level) / c)).tobytes() for p, g, c in rows], dtype=object)

    return table.withColumn("prior", moved("prior", "mean_log"))
