"""Small array idioms shared by the operators. All of them stay inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Without the binding the optimizer may paste ``value`` into a lambda and
    evaluate it again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_counts(tokens: Column) -> Column:
    """Bag of words of one row: ``array<struct<token, n>>``, sorted by token.

    Sorts the tokens and measures the runs, so a long post costs n log n and
    nothing is shuffled.
    """

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            F.struct(ordered.alias("words"), starts.alias("starts")),
            lambda s: F.transform(
                s["starts"],
                lambda start, k: F.struct(
                    F.get(s["words"], start).alias("token"),
                    (F.coalesce(F.get(s["starts"], k + 1), F.size(s["words"])) - start)
                    .cast("long")
                    .alias("n"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<token:string,n:bigint>>")
    return F.when(F.size(tokens) > 0, let(F.array_sort(tokens), runs)).when(
        tokens.isNotNull(), empty
    )


def argmax(values: Column) -> Column:
    """Zero-based position of the largest element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
