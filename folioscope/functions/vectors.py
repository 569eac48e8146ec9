"""Vector expressions that stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

UNROLL = 128


def _pairwise(column: Column, vector: Sequence[float], step) -> Column:
    if len(vector) <= UNROLL:
        terms = [step(F.get(column, F.lit(i)).cast("double"), F.lit(float(v))) for i, v in enumerate(vector)]
        return reduce(lambda a, b: a + b, terms)
    literal = F.lit([float(v) for v in vector])
    return F.aggregate(F.zip_with(column.cast("array<double>"), literal, step), F.lit(0.0), lambda a, x: a + x)


def dot_with(column: Column, vector: Sequence[float]) -> Column:
    """Dot product with one fixed vector."""
    return _pairwise(column, vector, lambda x, y: x * y)


def l2_to(column: Column, vector: Sequence[float]) -> Column:
    """Euclidean distance to one fixed vector."""
    return F.sqrt(_pairwise(column, vector, lambda x, y: (x - y) * (x - y)))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left.cast("array<double>"), right.cast("array<double>"), lambda x, y: x * y),
                       F.lit(0.0), lambda a, x: a + x)


def norm(column: Column) -> Column:
    return F.sqrt(dot(column, column))


def normalised(column: Column) -> Column:
    """Unit vector; null when the length is zero."""
    size = norm(column)
    return F.when(size > 0, F.transform(column.cast("array<double>"), lambda x: x / size))
