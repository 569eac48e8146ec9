"""Reproducible shuffle into shards by a keyed permutation of row numbers.

Global row numbers come from the files themselves: rows of the files before,
plus the row's place in its file, so numbering moves no row. A Feistel network
over (n // b, n % b) with a * b >= rows permutes the numbers; a value beyond
the rows walks on along its cycle until it is back inside. Only a * b - rows <
sqrt(rows) + 1 values lie outside, so the longest walk is found exactly from
those, and the expression is unrolled that often.

Permuted number p goes to shard p % shards, slot p // shards: shard sizes
differ by one row at most, and both follow from (row number, rows, key) alone.
Equal texts and repeated rows are rows like any other; nulls stay where they
are; an empty table gives no rows. A column of the table that has the name of an
ADDED one, in any case, is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.staging import let
from ..session import cut_lineage

ROUNDS = 4
RANGES = 64
#: Up to so many files (some 20 MB of paths), their offsets go to every task.
BROADCAST_FILES = 100_000
STRETCH = 1_000_000
ADDED = ("row_number", "permuted", "shard", "slot")


def numbered(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Rows of a Parquet table, whole, with `row_number`, 0-based, and how many there are."""
    table = spark.read.parquet(path)
    meta = table.metadataColumn("_metadata")
    own = [table[f"`{c}`"] for c in table.columns if c.lower() not in ADDED]
    rows = table.select(F.struct(*own).alias("whole"), meta["file_path"].alias("file"), meta["row_index"].alias("index"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    cut = files.withColumn("range", F.pmod(F.xxhash64(F.element_at(F.split("file", "/"), -1)), F.lit(RANGES)))
    ranges = cut.groupBy("range").agg(F.sum("n").alias("all"))
    total = ranges.agg(F.sum("all")).first()[0] or 0
    earlier = (W.unboundedPreceding, -1)
    inside = F.sum("n").over(W.partitionBy("range").orderBy("file").rowsBetween(*earlier))
    before = F.sum("all").over(W.orderBy("range").rowsBetween(*earlier))
    offsets = cut.withColumn("inside", inside).join(ranges.withColumn("before", before), "range")
    offsets = offsets.select("file", "n", (F.coalesce("inside", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("offset"))
    if files.count() <= BROADCAST_FILES:
        placed = rows.join(F.broadcast(offsets.drop("n")), "file")
    else:
        # Too many files for every task: a file's rows meet its offset in stretches, so none of them is one task.
        stretches = offsets.select("file", "offset", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {STRETCH}"))).alias("stretch"))
        placed = rows.withColumn("stretch", F.expr(f"index div {STRETCH}")).join(stretches, ["file", "stretch"])
    return placed.select("whole", (F.col("offset") + F.col("index")).alias("row_number")), total


def sides(rows: int) -> tuple[int, int]:
    """a, b with a * b the smallest near-square size that holds the rows."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def feistel(number: Column, a: int, b: int, key: int) -> Column:
    """One pass of the network over 0 .. a * b - 1; a bijection for every key."""
    left, right, sizes = F.floor(number / F.lit(b)).cast("long"), number % b, (a, b)
    for r in range(ROUNDS):
        left, right = right, (left + F.pmod(F.xxhash64(F.lit(key), F.lit(r), right), F.lit(sizes[0]))) % sizes[0]
        sizes = sizes[::-1]
    return left * b + right


def longest_walk(spark: SparkSession, rows: int, key: int) -> int:
    """Further passes that the longest walk through values beyond the rows needs."""
    if not rows:
        return 0
    a, b = sides(rows)
    outside, steps = spark.range(rows, a * b).toDF("p"), 0
    while not outside.isEmpty():
        outside = cut_lineage(outside.select(feistel(F.col("p"), a, b, key).alias("p")).where(F.col("p") >= rows))
        steps += 1
    return steps


def permute(number: Column, rows: int, key: int, walk: int) -> Column:
    """The permuted number: one pass, and up to `walk` more until it is below `rows`."""
    a, b = sides(rows)

    def settle(value: Column, left: int) -> Column:
        return let(value, lambda p: F.when(p < rows, p).otherwise(settle(feistel(p, a, b, key), left - 1))) if left else value

    return settle(feistel(number, a, b, key), walk)


def shuffle_to_shards(spark: SparkSession, path: str, shards: int = 40, key: int = 20240229) -> DataFrame:
    """The table's rows with `row_number`, `permuted`, `shard` (int) and `slot` (long)."""
    rows, total = numbered(spark, path)
    placed = rows.withColumn("permuted", permute(F.col("row_number"), total, key, longest_walk(spark, total, key)))
    placed = placed.select("whole.*", "row_number", "permuted")
    return placed.withColumns({"shard": (F.col("permuted") % shards).cast("int"), "slot": F.floor(F.col("permuted") / F.lit(shards)).cast("long")})
