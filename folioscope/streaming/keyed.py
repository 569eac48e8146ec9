"""State by key for the streaming jobs, kept in Spark's state store.

A job that must know what it has seen of a key asks the store for the keys of
its batch and those that share a bucket with them. What is held of a bucket is
one value: a call of Python for each key took most of the time. The store lives
in the query's checkpoint, is written as changes and compacted by Spark, and a
replayed batch finds it as it was before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of keys. More of them make the values smaller that a small batch reads, and the calls of a large batch more.
BUCKETS = 1024


def _newest(part: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The row with the largest seq of each key, the first of equals."""
    ordered = part.sort_values("seq", kind="stable", ascending=False)
    return ordered[~ordered.duplicated(keys)]


def reduced(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the largest seq of each key, within batches of a partition."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield _newest(part, keys)

    return stream.mapInPandas(run, stream.schema)


class Changed(StatefulProcessor):
    """Holds the newest seq and hash of a bucket's keys; emits a key's newest row when its hash is another: new, changed or deleted.

    Rows that are older than what is held come late and change nothing.
    """

    def __init__(self, keys: list[str], payload: list[str]) -> None:
        self.keys, self.payload = keys, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "entries binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:
            newest = _newest(part if newest is None else pd.concat([newest, part]), self.keys)
        if newest is None:
            return
        before = self.held.get()
        held = {tuple(names): (seq, digest) for *names, seq, digest in json.loads(bytes(before[0]))} if before else {}
        at, changes = [], []
        text = lambda x: x if isinstance(x, str) else None
        for i, (seq, digest, *names) in enumerate(zip(*[newest[c] for c in ("seq", "hash", *self.keys)])):
            name, seq, digest = tuple(map(text, names)), int(seq), text(digest)
            last, old = held.get(name, (None, None))
            if last is not None and last >= seq:
                continue
            held[name] = seq, digest
            if digest != old:
                at.append(i)
                changes.append("new" if old is None else "deleted" if digest is None else "changed")
        self.held.update((json.dumps([[*name, *entry] for name, entry in held.items()]).encode(),))
        if at:
            yield newest.iloc[at].assign(change=changes)[[*self.keys, "hash", "change", *self.payload]].reset_index(drop=True)


def first_seen(stream: DataFrame) -> DataFrame:
    """(id, seq) of ids never met before, or met with a larger seq only; for update mode.

    A streaming aggregate keeps the smallest seq of an id and the time of the
    batch that brought it. Ids whose smallest seq is of the present batch are new,
    or lower than before; all other ids of the batch are dropped. A replayed batch has the time it had.
    """
    now = F.current_timestamp()
    rows = stream.select("id", F.col("seq").cast("long").alias("seq"), now.alias("at")).where("seq is not null")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    least = rows.groupBy("id").agg(F.min(F.struct("seq", "at")).alias("least"))
    return least.where(F.col("least.at") == now).select("id", "least.seq")


def changed(stream: DataFrame, keys: list[str], digest: Column, payload: str, buckets: int = BUCKETS) -> DataFrame:
    """(keys..., hash, change, payload) of keys whose newest row has another hash than before; a null hash deletes."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    rows = stream.select(bucket, *keys, F.col("seq").cast("long").alias("seq"), digest.alias("hash"), payload)
    names = ", ".join(f"{k} string" for k in keys)
    return _kept(rows, ["_bucket"], Changed(keys, [payload]), f"{names}, hash string, change string, {payload} string")


def _kept(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "none")
