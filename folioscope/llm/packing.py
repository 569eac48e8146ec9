"""Packing: order-preserving dynamic programming over sentence and document boundaries.

Documents are taken in the order of the table's files. Each is its token ids
and an end id; the stream of all of them is cut into windows of at most `width`
tokens. Cuts fall at document or sentence ends (inside a sentence only where
one is longer than a window). With S the tokens before a boundary,

    cost(j) = min over S_j - S_i <= width of cost(i) + S_i, plus width - S_j + penalty(j)

so the transition is a sliding-window minimum, kept in a monotone queue.
A stream's last window may also be split at powers of two, which need no
padding. Blocks of about BLOCK tokens are solved one after another, the open
last window carried over: memory does not grow with the input.

A null text is empty: its document is the end id alone. A null id is kept.
Repeated rows are packed as often as they occur, empty tables give no pieces,
other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import batches

WIDTH = 1024
END = 0
BLOCK = 1 << 18
#: Tokens of padding that a cut at a sentence end, or inside a sentence, is worth.
SENTENCE, INSIDE = 2.0, 24.0

PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}


def tokenizer(ranks_path: str):
    """Ids of the byte-level vocabulary; the rank file holds the same merges as the JSON file."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cuts(ends: np.ndarray, penalty: np.ndarray, width: int, last: bool) -> list[int]:
    """Window ends for a stream whose boundaries are `ends` (increasing, gaps of at most
    `width`), `penalty` for a cut at each; the final boundary ends the stream.

    With `last`, the tail may be split at powers of two, at INSIDE a cut.
    """
    at = [0, *ends.tolist()]
    price = [0.0, *penalty.tolist()]
    n = len(at)
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        s = at[j]
        while at[queue[0][1]] < s - width:
            queue.popleft()
        best, i = queue[0]
        cost[j], back[j] = best + width - s + price[j], i
        key = cost[j] + s
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    if last:
        total = at[-1]
        tails = ((cost[i] + INSIDE * ((total - at[i]).bit_count() - 1), i) for i in range(n - 2, -1, -1) if 0 < total - at[i] <= width)
        split, i = min(tails, default=(np.inf, 0))
        if split < cost[-1]:
            tail, s = [], at[i]
            for k in range(width.bit_length() - 1, -1, -1):
                if (total - at[i]) >> k & 1:
                    s += 1 << k
                    tail.append(s)
            return [*chain(at, back, i), *tail]
    return chain(at, back, n - 1)


def chain(at: list[int], back: list[int], j: int) -> list[int]:
    out = []
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


class Stream:
    """Documents of one partition, packed block by block."""

    def __init__(self, width: int, first_sequence: int) -> None:
        self.width, self.sequence = width, first_sequence
        self.docs: list[tuple] = []  # (doc_id, ids with the end id, tokens already packed)
        self.marks: list[tuple[np.ndarray, int]] = []  # sentence ends in the document
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, marks: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.marks.append(marks)
        self.held += len(ids)

    def solve(self, last: bool) -> Iterator[tuple]:
        ends, prices, s = [], [], 0
        for (_, ids, done), marks in zip(self.docs, self.marks):
            inner = marks[(marks > done) & (marks < len(ids))] - done + s
            edges = np.concatenate([[s], inner, [s + len(ids) - done]])
            gaps = np.flatnonzero(np.diff(edges) > self.width)
            forced = [np.arange(edges[g] + self.width // 4, edges[g + 1], self.width // 4) for g in gaps]
            whole = np.concatenate([inner, [edges[-1]], *forced]).astype(np.int64)
            price = np.concatenate([np.full(len(inner), SENTENCE), [0.0], *[np.full(len(f), INSIDE) for f in forced]])
            order = np.argsort(whole, kind="stable")
            ends.append(whole[order])
            prices.append(price[order])
            s = int(edges[-1])
        if not s:
            return
        found = cuts(np.concatenate(ends), np.concatenate(prices), self.width, last)
        if not last:
            # The open end is not a document's choice yet: its windows within two widths are carried over.
            found = [c for c in found if c <= s - 2 * self.width]
        yield from self.emit(found)

    def emit(self, found: list[int]) -> Iterator[tuple]:
        low, d = 0, 0
        for high in found:
            offset = 0
            while low < high:
                doc_id, ids, done = self.docs[d]
                take = min(high - low, len(ids) - done)
                part = np.ascontiguousarray(ids[done:done + take], dtype="<u4").tobytes()
                yield doc_id, done, take, zlib.crc32(part), len(ids), self.sequence, offset, part
                offset, low, done = offset + take, low + take, done + take
                self.docs[d] = (doc_id, ids, done)
                d += done == len(ids)
            self.sequence += 1
        self.docs, self.marks = self.docs[d:], self.marks[d:]
        self.held -= low


def pack(docs: DataFrame, ranks_path: str, width: int = WIDTH) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks_path)
        with open(ranks_path, "rb") as f:
            enders = np.zeros(1 << 17, bool)
            for a, b in map(bytes.split, f):
                enders[int(b)] = re.fullmatch(rb".*[.!?\n]+[\"')\]]*", base64.b64decode(a), re.S) is not None
        stream = Stream(width, TaskContext.get().partitionId() << 33)

        def rows() -> Iterator[tuple]:
            for b in parts:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = np.asarray(encode(text.as_py() or "") + [END], np.uint32)
                    marks = np.flatnonzero(enders[ids[:-1]]) + 1
                    stream.add(doc_id, ids, marks)
                    if stream.held >= BLOCK:
                        yield from stream.solve(False)
            yield from stream.solve(True)

        yield from batches(PIECES, rows(), 4096)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
