"""Training rows for the classifiers: a bounded, reproducible sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import fold, stored

#: Labelled rows a classifier is fitted on, expected number; its one bound.
SAMPLE_ROWS = 24_000
SHARDS = 6
CELLS = 1 << 20


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label, shard) of about `rows` labelled documents outside the held-out fold.

    Ids are kept by hash, so the sample is spread over the whole table and does
    not depend on file order. Labels other than 0 and 1 and null ids are left
    out; an id labelled twice counts as the larger. The ids are at most a few
    times `rows`, which bounds what is broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    share = min(CELLS, -(-rows * CELLS // max(total, 1)))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(CELLS)) < share)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = text.join(F.broadcast(picked), "doc_id")
    return stored(found.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(SHARDS)).cast("int")), f"sample-{label}")
