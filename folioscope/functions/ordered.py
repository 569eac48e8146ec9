"""Order-aware helpers that never put a whole key into one task.

A plain `lag` over (key) sends every row of a key to one task. Here the order
column is first cut into ranges: `lag` runs inside (key, range) and only the
last row of each range is carried to the next one, through a table that holds
one row per (key, range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

RANGE = 1_000_000


def with_previous(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str],
                  prefix: str = "prev_", width: int = RANGE) -> DataFrame:
    """Add `prefix`+column for the preceding row of the same key.

    `order` is a whole number that is unique within a key, such as a log
    position. Keys are not null.
    """
    keys = list(keys)
    cut = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    payload = F.struct(*[F.col(c).alias(c) for c in columns])
    group = keys + ["_range"]
    local = cut.withColumn("_prev", F.lag(payload).over(W.partitionBy(*group).orderBy(order)))
    tails = cut.groupBy(*group).agg(F.max_by(payload, F.col(order)).alias("_tail"))
    carried = tails.select(*group, F.lag("_tail").over(W.partitionBy(*keys).orderBy("_range")).alias("_carry"))
    joined = local.join(carried, group, "left")
    before = F.coalesce(F.col("_prev"), F.col("_carry"))
    return joined.select(*[F.col(c) for c in df.columns],
                         *[before[c].alias(prefix + c) for c in columns])
