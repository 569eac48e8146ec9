"""Substring dedup by prefix-partitioned suffix trees over words.

Every window of WINDOW words has an anchor: the leftmost smallest of its GRAM-word
hashes, so equal windows have equal anchors at equal places. The suffixes that
start with those windows are partitioned by a prefix that grows where needed:
by the anchor's GRAM words, and by all WINDOW words where an anchor begins more
than GROUP suffix runs. A group is memory-sized; a task sorts its suffixes,
takes the words neighbours share (their lowest common node's depth), and every
internal node at depth WINDOW or more is a repeat. All occurrences of a repeat
but the first (smaller doc_id, then earlier start) are removed.

Only anchors that occur twice anywhere are followed up: counts of anchor hashes
are summed before the shuffle, texts that hold a repeated anchor are read again,
and one Arrow batch sends each distinct run of windows once. Texts travel
compressed.

Defined results: a null or empty text has no words; fewer than WINDOW words are
never removed; a null doc_id counts as the largest; rows that share an id are
read as one document with its starts, so repeated rows keep the same words;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, batches, rolling, stored, texts

WINDOW, GRAM = 20, 6
SPREAD = WINDOW - GRAM + 1
#: Runs of windows a group may hold before its prefix is lengthened, and runs sorted at once at least.
GROUP, CHUNK = 20_000, 2_048
LAST_ID = 2**63 - 1

CONTEXTS = {"gram": pa.int64(), "context": pa.binary(), "content": pa.binary(), "windows": pa.int32(), "doc": pa.int64(), "text_hash": pa.int64(), "start": pa.int32()}
CONTEXTS_DDL = "gram bigint, context binary, content binary, windows int, doc bigint, text_hash bigint, start int"
JUDGED_DDL = "context binary, doc bigint, start int, mask int"


def text_hash(text: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For word hashes of WINDOW words or more: anchor hashes, the first window of
    each and how many consecutive windows it serves."""
    g = rolling(h, GRAM)
    low, at, width = g, np.arange(len(g)), 1
    while width < SPREAD:  # minima of twice the width, the left one on ties
        step = min(width, SPREAD - width)
        n = len(low) - step
        right = low[step:] < low[:n]
        low, at, width = np.where(right, low[step:], low[:n]), np.where(right, at[step:], at[:n]), width + step
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return low[first].view(np.int64), first, np.diff(np.append(first, len(at)))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(gram, text_hash) of every anchor."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in parts:
            grams, whose = [], []
            for text in texts(b):
                h = hashes.of(text)
                if len(h) >= WINDOW:
                    own = anchors(h)[0]
                    grams.append(own)
                    whose.append(np.full(len(own), text_hash(text)))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(whose))], ["gram", "text_hash"])

    return docs.select("text").mapInArrow(run, "gram bigint, text_hash bigint")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text_hash, packed): the words of every row's text, one blank between them, compressed."""
    out = {"doc": pa.int64(), "doc_id": pa.int64(), "text_hash": pa.int64(), "packed": pa.binary()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in parts:
            rows = ((LAST_ID if i is None else i, i, text_hash(t), press.compress(b" ".join(t.split()))) for i, t in zip(b.column("doc_id").to_pylist(), texts(b)))
            yield from batches(out, rows, 1024)

    return docs.mapInArrow(run, "doc bigint, doc_id bigint, text_hash bigint, packed binary")


def context_rows(rows: DataFrame) -> DataFrame:
    """Runs of windows under repeated anchors of (doc, text_hash, packed, grams).

    `content` is set once for each distinct run of a batch, at its first occurrence.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, open_ = WordHashes(), zstandard.ZstdDecompressor()
        for b in parts:
            found, first = [], {}
            for doc, h, packed, wanted in zip(b.column("doc").to_pylist(), b.column("text_hash").to_pylist(), b.column("packed").to_pylist(), b.column("grams")):
                text = open_.decompress(packed)
                h_words = hashes.of(text)
                low, high = hashes.spans(text)
                grams, starts, counts = anchors(h_words)
                for i in np.flatnonzero(np.isin(grams, wanted.values.to_numpy())):
                    s, n = int(starts[i]), int(counts[i])
                    content = text[low[s]:high[s + n + WINDOW - 2]]
                    context = xxhash.xxh3_128_digest(content)
                    found.append([int(grams[i]), context, content, n, doc, h, s])
                    if context not in first or (doc, s) < first[context]:
                        first[context] = (doc, s)
            for row in found:
                if first[row[1]] != (row[4], row[6]):
                    row[2] = None
            yield from batches(CONTEXTS, found, 4096)

    return rows.select("doc", "text_hash", "packed", "grams").mapInArrow(run, CONTEXTS_DDL)


def subtree(runs: list[tuple], hashes: WordHashes) -> Iterator[tuple]:
    """Judge the windows of runs (context, content, windows, doc, start): yields
    (context, doc, start, mask), a bit set for each window that starts earlier elsewhere.

    The leaves are sorted suffixes cut at WINDOW words; the words that two
    neighbours share are the depth of the node that parts them.
    """
    counts = np.array([r[2] for r in runs])
    words, first = hashes.of(b" ".join(r[1] for r in runs)), np.cumsum(counts + WINDOW - 1) - (counts + WINDOW - 1)
    whose = np.repeat(np.arange(len(runs)), counts)
    which = np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)
    leaves = np.lib.stride_tricks.sliding_window_view(words, WINDOW)[first[whose] + which]
    doc = np.array([r[3] for r in runs], np.int64)[whose]
    start = np.array([r[4] for r in runs], np.int64)[whose] + which
    order = np.argsort(np.ascontiguousarray(leaves.astype(">u8")).view(f"S{8 * WINDOW}").ravel(), kind="stable")
    same = leaves[order[1:]] == leaves[order[:-1]]
    depth = np.where(same.all(axis=1), WINDOW, same.argmin(axis=1))
    node = np.zeros(len(order), np.int64)
    node[order[1:]] = np.cumsum(depth < WINDOW)
    by_place = np.lexsort((start, doc, node))
    leads = np.append(True, np.diff(node[by_place]) != 0)
    lead = by_place[np.flatnonzero(leads)[np.cumsum(leads) - 1]]
    later = np.zeros(len(order), bool)
    later[by_place] = (doc[by_place] != doc[lead]) | (start[by_place] != start[lead])
    masks = np.zeros(len(runs), np.int64)
    np.add.at(masks, whose[later], 1 << which[later])
    for r, mask in zip(runs, masks.tolist()):
        yield r[0], r[3], r[4], mask


def judged_by_trees(rows: DataFrame) -> DataFrame:
    """`subtree` over groups by gram, several small groups at once."""
    ordered = rows.repartition("gram").sortWithinPartitions("gram", "context", "doc", "start").select("gram", "context", "content", "windows", "doc", "start")
    out = {"context": pa.binary(), "doc": pa.int64(), "start": pa.int32(), "mask": pa.int32()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged() -> Iterator[tuple]:
            hashes, held, last = WordHashes(), [], (None, None)
            for b in parts:
                for gram, context, content, windows, doc, start in zip(*(c.to_pylist() for c in b.columns)):
                    if (gram, context) == last:
                        continue  # sorted: the first occurrence of a run came before
                    if gram != last[0] and len(held) >= CHUNK:
                        yield from subtree(held, hashes)
                        held = []
                    held.append((context, content, windows, doc, start))
                    last = gram, context
            if held:
                yield from subtree(held, hashes)
        yield from batches(out, judged(), 4096)

    return ordered.mapInArrow(run, JUDGED_DDL)


def judged_by_window(rows: DataFrame) -> DataFrame:
    """The same where an anchor is too common: the prefix is the whole window, so a
    group is one node and its first leaf a minimum taken before the shuffle."""
    out = {"window": pa.binary(), "context": pa.binary(), "doc": pa.int64(), "run": pa.int32(), "bit": pa.int32()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows() -> Iterator[tuple]:
            for b in parts:
                for context, content, n, doc, start in zip(*(c.to_pylist() for c in b.columns)):
                    words = content.split()
                    for j in range(n):
                        yield xxhash.xxh3_128_digest(b" ".join(words[j:j + WINDOW])), context, doc, start, j
        yield from batches(out, windows(), 4096)

    leaves = rows.select("context", "content", "windows", "doc", "start").mapInArrow(run, "window binary, context binary, doc bigint, run int, bit int")
    first = leaves.groupBy("window").agg(F.min(F.struct("doc", (F.col("run") + F.col("bit")).alias("at"))).alias("first"))
    later = (F.col("doc") != F.col("first.doc")) | (F.col("run") + F.col("bit") != F.col("first.at"))
    marked = leaves.join(first, "window").select("context", "doc", F.col("run").alias("start"), F.when(later, F.expr("shiftleft(1, bit)")).otherwise(0).alias("mask"))
    return marked.groupBy("context", "doc", "start").agg(F.bit_or("mask").alias("mask"))


def removals(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, marks): runs (start, windows, mask) of windows to remove, for rows that have some."""
    grams = anchor_rows(docs)
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    wanted = grams.join(often, "gram").groupBy("text_hash").agg(F.collect_set("gram").alias("grams"))
    contexts = stored(context_rows(packed_texts(docs).join(wanted, "text_hash")), "substring-contexts")
    sent = contexts.where("content is not null")
    common = sent.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("gram")
    judged = judged_by_trees(sent.join(common, "gram", "left_anti"))
    if not common.isEmpty():
        judged = judged.unionByName(judged_by_window(sent.join(common, "gram")))
    firsts = judged.groupBy("context").agg(F.min(F.struct("doc", "start", "mask")).alias("f")).select("context", F.col("f.doc").alias("d"), F.col("f.start").alias("s"), F.col("f.mask").alias("m"))
    own = (F.col("doc") == F.col("d")) & (F.col("start") == F.col("s"))
    marked = contexts.select("context", "doc", "text_hash", "start", "windows").join(firsts, "context")
    marked = marked.withColumn("mask", F.when(own, F.col("m")).otherwise(F.expr("shiftleft(1, windows) - 1"))).where("mask != 0")
    return marked.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "windows", "mask")).alias("marks"))


def covered(n: int, marks: list[dict]) -> np.ndarray:
    """Which of n words lie in a marked window."""
    edge = np.zeros(n + 1, np.int64)
    for m in marks:
        start, windows, mask = m["start"], m["windows"], m["mask"]
        if mask == (1 << windows) - 1:
            edge[start] += 1
            edge[start + windows + WINDOW - 1] -= 1
        else:
            for j in range(windows):
                if mask >> j & 1:
                    edge[start + j] += 1
                    edge[start + j + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text): kept words joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = removals(rows)
    joined = packed_texts(rows).join(marks, ["doc", "text_hash"], "left").select("doc_id", "packed", "marks")
    out = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "text": pa.string()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()

        def kept() -> Iterator[tuple]:
            for b in parts:
                for doc_id, packed, own in zip(*(c.to_pylist() for c in b.columns)):
                    text = open_.decompress(packed)
                    n = left = text.count(b" ") + (text != b"")
                    if own:
                        words = [w for w, gone in zip(text.split(b" "), covered(n, own).tolist()) if not gone]
                        text, left = b" ".join(words), len(words)
                    yield doc_id, n, n - left, hashlib.sha256(text).hexdigest(), text.decode()
        yield from batches(out, kept(), 512)

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string")
