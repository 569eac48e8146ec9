"""Cross-tokenizer alignment: groups and links between two tokenizers' ids of one text.

Both tokenizers read a text; ids become bytes, and each id list has the sorted
byte offsets where its tokens end. Offsets that both have slice the two id lists
into groups; every two tokens whose byte ranges overlap are linked, once for
each end of either. A pair of linked ids is counted in the documents that hold
it, over the whole corpus.

Texts are tokenised once: each row's distinct pairs with their multiplicity are
stored, packed. Tasks sum their pairs before the shuffle. The HEAD most frequent
pairs go to every task as arrays (a fixed number of them, at any corpus size);
all other pairs meet their counts in a join on the pair, where no key is hot
since each is rarer than every pair of the head.

Defined results: a null or empty text, or one whose tokens do not spell it byte
for byte (a tokenizer that normalises it), has no tokens: zeros and an empty
digest. Every row is a document of its own, repeated rows and equal or null ids
too. Strings of special tokens in a text are plain text. Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, stored
from .packing import tokenizer

#: Pair key: id of the first tokenizer times SECOND plus id of the second, whose ids are below it.
SECOND = 1 << 17
#: Pairs that every task holds in memory: 13 bytes each.
HEAD = 1 << 18
#: Pairs that a task sums before it passes them on.
SUMMED = 1 << 22

ALIGNED = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary()}
ALIGNED_DDL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary"
SCORED = {"row": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
          "n_best": pa.int64(), "count_sum": pa.int64(), "rare": pa.list_(pa.int64()), "rare_links": pa.list_(pa.int64())}
SCORED_DDL = ALIGNED_DDL.replace("pairs binary", "n_best bigint, count_sum bigint, rare array<bigint>, rare_links array<bigint>")


class Tokenizers:
    """Ids and bytes of both vocabularies, read from their files in the task."""

    def __init__(self, ranks_path: str, pieces_path: str) -> None:
        import sentencepiece

        self.encode_a = tokenizer(ranks_path)
        with open(ranks_path, "rb") as f:
            own = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        self.a = [own.get(i, b"") for i in range(max(own) + 1)]
        pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.encode_b = pieces.encode
        self.b = [bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.vocab_size())]

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Both id lists, empty where they do not spell a space and the text."""
        if not text:
            return [], []
        a, b, wanted = self.encode_a(" " + text), self.encode_b(text), b" " + text.encode()
        fine = b"".join(map(self.a.__getitem__, a)) == wanted == b"".join(map(self.b.__getitem__, b))
        return (a, b) if fine else ([], [])


class Aligner:
    """Groups and links of two id lists, given how long each id's bytes are."""

    def __init__(self, spelled_a: list[bytes], spelled_b: list[bytes]) -> None:
        self.size_a, self.size_b = (np.array(list(map(len, spelled)), np.int64) for spelled in (spelled_a, spelled_b))
        # Each id as text, followed by what stands after it inside and at the end of its side of a group.
        self.said = [f"{i}{mark}" for spelled, last in ((spelled_a, "|"), (spelled_b, ";")) for i in range(len(spelled)) for mark in (",", last)]
        self.said_b = 2 * len(spelled_a)

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets where the tokens of both lists end."""
        return np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])

    def slices(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of both lists up to each offset where tokens of both end."""
        return self.common(*self.ends(a, b))

    def common(self, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Both lists spell the same bytes, so an end of the first has one of the second at or after it.
        at = np.searchsorted(ends_b, ends_a)
        common = np.flatnonzero(ends_b[at] == ends_a)
        return common + 1, at[common] + 1

    def joined(self, a: list[int], b: list[int]) -> tuple[str, int, np.ndarray]:
        """All groups as one text, how many they are, and the keys of all links, in text order."""
        if not a:
            return "", 0, np.zeros(0, np.int64)
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = self.ends(ids_a, ids_b)
        p, q = self.common(ends_a, ends_b)
        # Two tokens overlap in one run of bytes, and it ends where either does: one link for each end.
        ends = np.zeros(ends_a[-1] + 1, bool)
        ends[ends_a] = ends[ends_b] = True
        ends = np.flatnonzero(ends)
        keys = ids_a[np.searchsorted(ends_a, ends)] * SECOND + ids_b[np.searchsorted(ends_b, ends)]
        # A group's ids of the first list stand after those of the second in the groups before it.
        said = np.empty(len(a) + len(b), np.int64)
        own_a, own_b = 2 * ids_a, 2 * ids_b + self.said_b
        own_a[p - 1] += 1
        own_b[q - 1] += 1
        said[np.arange(len(a)) + np.repeat(q - np.diff(q, prepend=0), np.diff(p, prepend=0))] = own_a
        said[np.arange(len(b)) + np.repeat(p, np.diff(q, prepend=0))] = own_b
        return "".join(map(self.said.__getitem__, said.tolist()))[:-1], len(p), keys

    def read(self, a: list[int], b: list[int]) -> tuple[list[str], np.ndarray]:
        """Each group as text, and the keys of all links."""
        text, groups, keys = self.joined(a, b)
        return text.split(";") if groups else [], keys


def packed(keys: np.ndarray) -> bytes:
    """Distinct keys as differences, then their multiplicities."""
    own, times = np.unique(keys, return_counts=True)
    return zlib.compress(np.diff(own, prepend=0).astype("<u8").tobytes() + times.astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u8", n).astype(np.int64)), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)


def aligned(docs: DataFrame, ranks_path: str, pieces_path: str) -> DataFrame:
    """ALIGNED columns of every row: sizes, the digest of its groups, and its pairs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokenizers(ranks_path, pieces_path)
        aligner = Aligner(own.a, own.b)

        def rows() -> Iterator[tuple]:
            for batch in parts:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    a, b = own.ids(text.as_py() or "")
                    said, groups, keys = aligner.joined(a, b)
                    digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
                    yield doc_id, len(a), len(b), groups, len(keys), digest, packed(keys)

        yield from batches(ALIGNED, rows(), 256)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ALIGNED_DDL)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs, best): documents that hold each linked pair, and whether its first id has no pair in more."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            own, docs = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(docs, pa.int64())], names=["pair", "docs"])

        for batch in parts:
            for data in batch.column(0).to_pylist():
                keys, _ = unpacked(data)
                held.append(keys)
                size += len(keys)
                if size >= SUMMED:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    counts = stored(rows.select("pairs").mapInArrow(run, "pair bigint, docs bigint").groupBy("pair").agg(F.sum("docs").alias("docs")), "align-counts")
    first = F.floor(F.col("pair") / SECOND).alias("first")
    most = counts.groupBy(first).agg(F.max("docs").alias("most"))
    # One row for each id of a vocabulary: a bounded table.
    return stored(counts.withColumn("first", first).join(F.broadcast(most), "first").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "align-best")


def alignment(docs: DataFrame, ranks_path: str, pieces_path: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    rows = stored(aligned(docs, ranks_path, pieces_path), "align-rows")
    counts = pair_counts(rows)
    top = counts.orderBy(F.desc("docs"), "pair").limit(head).toPandas()
    last = top.iloc[-1] if len(top) else None
    top = top.sort_values("pair")
    known = rows.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["docs"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs_of, best = known.value

        def out() -> Iterator[tuple]:
            for batch in parts:
                for *own, data in zip(*(c.to_pylist() for c in batch.columns)):
                    keys, times = unpacked(data)
                    at = np.searchsorted(pairs, keys)
                    found = np.zeros(len(keys), bool)
                    inside = at < len(pairs)
                    found[inside] = pairs[at[inside]] == keys[inside]
                    at, n = at[found], times[found]
                    yield (*own, int(n[best[at]].sum()), int((n * docs_of[at]).sum()), keys[~found].tolist(), times[~found].tolist())

        yield from batches(SCORED, out(), 256)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "*")
    scored = stored(numbered.mapInArrow(run, "row bigint, " + SCORED_DDL), "align-scored")
    rest = counts if last is None else counts.where((F.col("docs") < int(last.docs)) | ((F.col("docs") == int(last.docs)) & (F.col("pair") > int(last.pair))))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_links")).alias("p")).select("row", F.col("p.rare").alias("pair"), F.col("p.rare_links").alias("n"))
    by_row = rare.join(rest, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("docs")).alias("more_sum"))
    whole = scored.drop("rare", "rare_links").join(by_row, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
