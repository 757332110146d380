"""Name a value once so that an expression can use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda is otherwise computed again for every
    element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(df: DataFrame, keep: list, array: Column, position: str, name: str) -> DataFrame:
    """One row per element with its position from 0; empty and null arrays give none.

    The outer form is deliberate: for the inner one the optimizer adds a size
    filter and pushes it to the scan, which computes the array a second time.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return out.where(F.col(position).isNotNull())


def settle(df: DataFrame) -> DataFrame:
    """Compute the columns of ``df`` here, once per row.

    Later projections and filters would otherwise be merged with the expressions
    below and evaluate them again wherever a column is used, inside lambdas once
    per element. A one-element generator keeps them apart.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
