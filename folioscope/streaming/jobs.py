"""Streaming forms of the log folds.

Three shapes cover them all. A fold with an associative update is a streaming
aggregate in update mode, whose changed rows are written per batch. A job that
asks what it knows of a key has state by key (`keyed.py`). A job that must look
at everything kept so far runs in `foreachBatch` against a log table. All write one folder per batch, replaced when a batch is replayed, so a job
that dies and restarts leaves the same rows. Order within a key is the source's
`seq`, never the order of arrival.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import content_hash
from ..operators import intake as it, state as st
from ..operators.corpus import sections
from ..operators.similarity import embedding_cache
from ..session import work_dir
from . import keyed


class BatchLog:
    """A table with one folder per streaming batch."""

    def __init__(self, root: str, schema: str):
        self.root, self.schema = root, schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Rows with their batch number; only earlier batches when `before` is given."""
        try:
            df = spark.read.schema(f"{self.schema}, batch bigint").parquet(self.root)
        except AnalysisException as exc:
            # Only a log that no batch has written yet is empty; one that cannot be read is an error.
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"{self.schema}, batch bigint")
        return df.filter(F.col("batch") < before) if before is not None else df

    def latest(self, spark: SparkSession, keys: Sequence[str]) -> DataFrame:
        """The newest row per key."""
        df = self.read(spark)
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[f"_r.{c}" for c in rest if c != "batch"])


def new_root(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job below the shared working folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def run(stream: DataFrame, root: str, each: Callable[[DataFrame, int], None], mode: str = "append", **trigger):
    """Start a job; without a trigger it reads what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(each)
    query = writer.trigger(**(trigger or {"availableNow": True})).start()
    if not trigger:
        query.awaitTermination()
    return query


# ------------------------------------------------------------------ folds

def fold(stream: DataFrame, root: str, keys: Sequence[str], aggregates: dict[str, Column], schema: str, **trigger) -> BatchLog:
    """A streaming aggregate whose changed rows are kept per batch."""
    log = BatchLog(f"{root}/folded", schema)
    folded = stream.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    run(folded, root, log.write, mode="update", **trigger)
    return log


def decisions(stream: DataFrame, root: str, **trigger) -> BatchLog:
    """Last write wins per (report, id). Readers drop `reset`."""
    return fold(stream, root, ["report", "id"], {"decision": F.max_by("decision", "seq")}, "report string, id string, decision string", **trigger)


def session_bounds(stream: DataFrame, root: str, **trigger) -> BatchLog:
    """First and last turn per session."""
    spoken = stream.filter(F.length(F.trim("text")) > 0)
    return fold(spoken, root, ["host", "session_id"], {"started": F.min("at"), "ended": F.max("at"), "turns": F.count("*")},
                "host string, session_id string, started timestamp, ended timestamp, turns bigint", **trigger)


def weekly_spend(stream: DataFrame, root: str, lateness: str = "14 days", **trigger) -> BatchLog:
    """Calls per week from Monday, kind and tier. State of weeks older than the lateness is dropped."""
    log = BatchLog(f"{root}/folded", "week_start timestamp, kind string, tier string, spent bigint, failed bigint")
    weeks = stream.withWatermark("at", lateness).groupBy(F.window("at", "7 days", "7 days", "4 days"), "kind", "tier").agg(
        F.count("*").alias("spent"), F.count_if(~F.coalesce(F.col("ok"), F.lit(True))).alias("failed"))
    run(weeks.select(F.col("window.start").alias("week_start"), "kind", "tier", "spent", "failed"), root, log.write, mode="update", **trigger)
    return log


# ------------------------------------------------------------------ jobs against a kept table

def first_seen(stream: DataFrame, root: str, **trigger) -> BatchLog:
    """Ids never met before, kept forever in state by key. One whose smaller seq comes late is written again: readers take the least."""
    log = BatchLog(f"{root}/seen", "id string, seq bigint")
    run(keyed.first_seen(stream), root, log.write, mode="update", **trigger)
    return log


def spawn_alerts(stream: DataFrame, root: str, every: int = 25, keep_days: int = 7, **trigger) -> tuple[BatchLog, BatchLog]:
    """Counts per session and day, and an alert row for each multiple of `every` passed.

    A batch is counted before it meets the kept counts, so a busy session is one
    row there. Days more than `keep_days` before the newest kept day do not count.
    """
    counts = BatchLog(f"{root}/counts", "session string, day date, n bigint")
    alerts = BatchLog(f"{root}/alerts", "session string, spawns bigint, alerts bigint")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        added = batch.groupBy("session", F.to_date("at").alias("day")).agg(F.count("*").alias("n"))
        counts.write(added, batch_id)
        kept = counts.read(spark, batch_id)
        newest = kept.agg(F.max("day")).scalar()
        kept = kept.filter(F.col("day").isNull() | (F.col("day") >= F.date_sub(newest, keep_days)))
        before = kept.groupBy("session").agg(F.sum("n").alias("_before"))
        now = counts.read(spark).filter(F.col("batch") == batch_id).groupBy("session").agg(F.sum("n").alias("_new"))
        total = now.join(before, "session", "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
        passed = F.floor((F.col("_before") + F.col("_new")) / every) - F.floor(F.col("_before") / every)
        alerts.write(total.select("session", (F.col("_before") + F.col("_new")).alias("spawns"), passed.alias("alerts")), batch_id)

    run(stream, root, each, **trigger)
    return counts, alerts


def host_conflicts(stream: DataFrame, notes: DataFrame, root: str, seconds: int = st.CONFLICT_SECONDS, **trigger) -> BatchLog:
    """Conflicting pairs, recomputed for the notes a batch touches; null when a note has none (any more)."""
    moves = BatchLog(f"{root}/moves", "slug string, seq bigint, at timestamp, host string, src string, dst string")
    found = BatchLog(f"{root}/found", "slug string, first_seq bigint, second_seq bigint")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        moves.write(st.moves(batch).select("slug", "seq", "at", "host", "src", "dst"), batch_id)
        every = moves.read(spark)
        touched = every.filter(F.col("batch") == batch_id).select("slug").distinct()
        pairs = st.conflicts(notes, every.drop("batch").join(touched, "slug", "left_semi"), seconds)
        found.write(touched.join(pairs.select("slug", "first_seq", "second_seq"), "slug", "left"), batch_id)

    run(stream, root, each, **trigger)
    return found


def enqueue(stream: DataFrame, batch_events: DataFrame, root: str, **trigger) -> BatchLog:
    """Requests admitted to the queue: not already waiting, retries always."""
    queue = BatchLog(f"{root}/queue", "seq bigint, req_id string, source_type string, value string, retry_of string")

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("seq", "req_id", "source_type", "value", "retry_of")
        held = queue.read(batch.sparkSession, batch_id).drop("batch")
        queue.write(it.admit_requests(rows, held, batch_events), batch_id)

    run(stream, root, each, **trigger)
    return queue


def incremental_index(stream: DataFrame, root: str, **trigger) -> tuple[BatchLog, BatchLog]:
    """Files by hash and the sections of new or changed ones.

    `stream`: library, path, seq, text, where a null text deletes the file.
    Unchanged files write nothing: their hash is state by key. `current_chunks`
    reads the result.
    """
    files = BatchLog(f"{root}/files", "library string, path string, hash string, change string")
    chunks = BatchLog(f"{root}/chunks", "library string, path string, heading string, start_line int, end_line int, content string")

    def each(batch: DataFrame, batch_id: int) -> None:
        moved = batch.persist(StorageLevel.DISK_ONLY)
        files.write(moved.select("library", "path", "hash", "change"), batch_id)
        fresh = moved.where("hash is not null")
        chunks.write(sections(fresh).select("library", "path", "heading", "start_line", "end_line", "content"), batch_id)
        moved.unpersist()

    run(keyed.changed(stream, ["library", "path"], content_hash(F.col("text")), "text"), root, each, **trigger)
    return files, chunks


def current_chunks(spark: SparkSession, files: BatchLog, chunks: BatchLog) -> DataFrame:
    """Sections of the files as they stand; deleted files are gone."""
    live = files.read(spark).groupBy("library", "path").agg(F.max("batch").alias("batch"), F.max_by("hash", "batch").alias("hash")).filter("hash IS NOT NULL")
    return chunks.read(spark).join(live.select("library", "path", "batch"), ["library", "path", "batch"], "left_semi").drop("batch")


def cached_embeddings(stream: DataFrame, root: str, embedder: Callable, **trigger) -> BatchLog:
    """Vectors by name and text hash; unchanged texts are not embedded again."""
    cache = BatchLog(f"{root}/cache", "name string, hash string, embedding array<double>, cached boolean")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = cache.read(spark, batch_id)
        rest = held.groupBy("name").agg(F.max_by(F.struct("hash", "embedding"), "batch").alias("c")).select("name", "c.hash", "c.embedding")
        latest = batch.groupBy("name").agg(F.max_by("text", "seq").alias("text"))
        cache.write(embedding_cache(latest, rest, embedder), batch_id)

    run(stream, root, each, **trigger)
    return cache
