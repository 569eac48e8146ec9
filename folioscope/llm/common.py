"""Helpers shared by the operators: texts as bytes, word hashes, folds, stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import work_dir

#: Folds by crc32 of the id's text; remainder 0 is held out of training.
FOLDS = 5


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class WordHashes:
    """64-bit hashes of a text's words, in order, without a Python object for each.

    Words stand between the six ASCII blanks. A word's hash is its bytes'
    polynomial, taken from sums over the whole text, with its length, mixed.
    """

    BASE = 0x9E3779B97F4A7C15
    LONGEST = 1 << 20

    def __init__(self) -> None:
        self.blank = np.zeros(256, bool)
        self.blank[list(b" \t\n\x0b\x0c\r")] = True
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)

        self.up, self.down = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        edges = np.flatnonzero(np.diff(~self.blank[np.frombuffer(text, np.uint8)], prepend=False, append=False))
        return edges[::2], edges[1::2]

    def of(self, text: bytes) -> np.ndarray:
        if len(text) > self.LONGEST:
            return self.of_long(text)
        if len(text) >= len(self.up):
            self.grow(2 * len(text))
        starts, ends = self.spans(text)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(np.frombuffer(text, np.uint8) * self.up[:len(text)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def of_long(self, text: bytes) -> np.ndarray:
        """The same for a text of any length, in parts; a word beyond LONGEST is hashed whole."""
        out, part, size = [], [], 0
        for word in [*text.split(), None]:
            if word is None or size + len(word) >= self.LONGEST:
                out.append(self.of(b" ".join(part)))
                part, size = [], 0
            if word is not None and len(word) >= self.LONGEST - 1:
                out.append(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))
            elif word is not None:
                part.append(word)
                size += len(word) + 1
        return np.concatenate(out)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` consecutive word hashes."""
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    return mixed(out)


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text modulo FOLDS; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % FOLDS


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: a lineage
    that ends there, so a lost executor costs a reread and no recomputation."""
    path = f"{work_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_at_once(df: DataFrame, rows: int) -> None:
    """Rows of one Arrow batch for Python tasks of this session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def batches(columns: dict[str, pa.DataType], rows: Iterator[tuple], size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches of the given columns."""
    schema, held = pa.schema(list(columns.items())), []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), columns.values())], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield packed()
            held.clear()
    if held:
        yield packed()
