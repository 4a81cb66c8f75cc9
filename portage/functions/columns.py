"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row.

    A lambda evaluates every outer expression it mentions once per element; bound this way, ``value`` is a variable
    to the lambdas inside ``body``.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same_names(left: Sequence[str], right: Sequence[str]) -> list[Column]:
    """Join condition: columns of names on either side are equal.

    Names that begin alike are slow to sort. A number made of all of them in front decides nearly all comparisons; it is an
    expression of the join, so the rows are not moved with it.
    """
    return [F.hash(*left) == F.hash(*right), *(F.col(a) == F.col(b) for a, b in zip(left, right))]
