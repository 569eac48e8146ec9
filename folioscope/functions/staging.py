"""Keeping an expensive expression in one place of the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read but never recompute.

    The optimiser copies a projected expression into every predicate it pushes
    down, which for a tokenised text inside a lambda means once per element. A
    one-row generator is a border it does not push through.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", packed.alias("_once")).select(*[F.col(c) for c in df.columns], *[F.col(f"_once.{n}").alias(n) for n in columns])
