"""Near-duplicate documents: MinHash bands, signature check, exact check, components.

A document's set holds its distinct shingles of `SHINGLE` words. Texts with
equal sets form one class first, so copies cost one row each. A class has
`BANDS` x `ROWS` universal minima (odd multiplier and offset modulo 2^32 over
mixed shingle hashes); classes that agree on a band are candidates. Candidates
must agree on enough minima, and are then confirmed on the full sets.

No bucket emits its pairs. In a round, every bucket compares its members with
one head; linked ones become components by alternating large-star and
small-star, and a bucket whose members are one component is done. Rounds with
other heads follow; one without new links leaves the components as they are.
What is open after ROUNDS_OF_HEADS is compared exactly: members outside their
bucket's largest component against the rest of it. Before that, shingles are summed over the open documents: a link to another component
needs shingles that occur in another component, so a document with fewer than
three quarters of those is done. The rest of a bucket is compared in blocks of
about BLOCK shingles: a matrix product over the shingles that occur in both
counts all intersections, and only pairs that reach the similarity leave a task.

Defined results: a null or wordless text has an empty set, is linked with
nothing and is its own component; fewer than SHINGLE words make one shingle;
repeated rows and rows that share an id are one vertex; a null id takes part in
nothing, its component is null and it is kept; empty tables give no rows; other
columns are ignored. At 40 bands of 4, a pair at 0.75 is missed with
probability 3e-7, one at 0.8 with 6e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import WordHashes, batches, mixed, rolling, stored, texts

SHINGLE, SIMILAR = 5, 75
BANDS, ROWS = 40, 4
#: Of 160 minima, a pair at 0.75 agrees on fewer than 90 with probability 3e-7.
AGREE = 90
ROUNDS_OF_HEADS, PRUNINGS = 3, 2
BLOCK = 1 << 18
#: Common shingles by which a pair may fall short there, where 32-bit hashes stand for them.
SLACK = 2
SEED = 7


def shingles(text: bytes, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    h = hashes.of(text.lower())
    if not len(h):
        return h
    return np.unique(rolling(h, min(width, len(h))))


class Signer:
    """Minima of a set under BANDS * ROWS universal hashes, and its band keys."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (draw.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = draw.integers(0, 2**32, bands * rows, np.uint32)[:, None]

    def minima(self, members: np.ndarray) -> np.ndarray:
        x = (mixed(members) >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(low, (self.a * x[None, at:at + 2048] + self.b).min(axis=1), out=low)
        return low

    def keys(self, minima: np.ndarray) -> np.ndarray:
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in minima.reshape(self.bands, self.rows).T:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column)
        return h.view(np.int64)


def sketched(minima: np.ndarray) -> np.ndarray:
    """One byte of each minimum: differing minima agree by chance once in 256."""
    return (mixed(minima.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


SIGNED = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_key": pa.binary(), "minima": pa.binary(), "keys": pa.list_(pa.int64())}


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, minima, keys) of every row; an empty set has null lists."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, signer = WordHashes(), Signer()

        def rows() -> Iterator[tuple]:
            for b in parts:
                for doc_id, text in zip(b.column(0).to_pylist(), texts(b)):
                    s = shingles(text, hashes)
                    if len(s):
                        low = signer.minima(s)
                        yield doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), sketched(low).tobytes(), signer.keys(low)
                    else:
                        yield doc_id, 0, None, None, None
        yield from batches(SIGNED, rows(), 1024)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, minima binary, keys array<bigint>")


def verified(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (a, b, text_a, text_b) whose full sets are similar."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows() -> Iterator[tuple]:
            last, left = None, None
            for b in parts:
                for x, y, s, t in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), texts(b, "text_a"), texts(b, "text_b")):
                    if s != last:
                        last, left = s, shingles(s, hashes)
                    right = shingles(t, hashes)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    if 100 * both >= SIMILAR * (len(left) + len(right) - both):
                        yield x, y
        yield from batches({"a": pa.int64(), "b": pa.int64()}, rows())

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def dealt(rows: DataFrame, on: str, *needed: str) -> DataFrame:
    """Rows dealt out by `on`, none null in it or in `needed`: with no filter
    left to push below, the sums by `on` and their join share one exchange."""
    return rows.where(" and ".join(f"{c} is not null" for c in (on, *needed))).repartition(on)


def starred(edges: DataFrame) -> bool:
    """Whether every vertex of the edges (a, b), b < a, is a centre or has one edge, to a centre."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    degrees = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return degrees.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for undirected edges (a, b): smallest reachable vertex,
    for every vertex that is not its own component's smallest.

    Alternating large-star and small-star: each vertex hands its larger, then
    its smaller neighbours on to the smallest of them, until all edges are stars.
    Each half is dealt out by vertex once, for the minima and for their join;
    every exchange leaves the driver a thread for a minute, whatever its size.
    """
    edges = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = dealt(edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))), "a", "b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # m <= a, so this is b > a; naming m keeps the filter above the exchange, which both sides then share.
        large = dealt(both.join(low.hint("merge"), "a").where("b > greatest(a, m)").select(F.col("b").alias("a"), F.col("m").alias("b")), "a", "b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # The smallest neighbour's own edge becomes the vertex's edge to it; every other neighbour is handed on.
        small = large.join(least.hint("merge"), "a").select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()
        edges = cut_lineage(small)
        if starred(edges):
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))


def joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of `links` and the earlier ones `found`, whose stars stand for their links."""
    return components(links if found is None else found.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(links))


def labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, vertex, ...) with the component of each."""
    return members.join(found, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))


def shingle_rows(rows: DataFrame) -> DataFrame:
    """(vertex, component, shingle) of every distinct shingle of (vertex, component, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in parts:
            own = [shingles(t, hashes) for t in texts(b)]
            whose = [np.repeat(np.asarray(b.column(c).to_pylist(), np.int64), [len(x) for x in own]) for c in ("vertex", "component")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, whose), pa.array(np.concatenate(own).view(np.int64))], ["vertex", "component", "shingle"])

    return rows.select("vertex", "component", "text").mapInArrow(run, "vertex bigint, component bigint, shingle bigint")


def linkable(open_: DataFrame, involved: DataFrame, sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, vertex, component) of open buckets that may still link to another
    component, and per vertex its size `n` and the `items` of its set that occur there."""
    members = open_.select("key", "vertex", "component")
    own = members.select("vertex", "component").distinct()
    rows = shingle_rows(involved.join(own, "vertex"))
    common = rows.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("shingle")
    items = rows.join(common, "shingle").groupBy("vertex").agg(F.collect_set("shingle").alias("items"))
    fit = sketch.groupBy("vertex").agg(F.max("n").alias("n")).join(items, "vertex").where(100 * F.size("items") >= SIMILAR * F.col("n"))
    fit = stored(fit.select("vertex", "n", F.transform("items", lambda x: F.hash(x)).alias("items")), "minhash-items")
    rest = dealt(members.join(fit.select("vertex"), "vertex", "left_semi"), "key")
    still = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    return stored(rest.join(still, "key"), "minhash-linkable"), fit


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many items each of `a` has in common with each of `b`."""
    out = np.zeros((len(a), len(b)), np.float32)
    x, y = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(x, y)
    rows_a, rows_b = np.repeat(np.arange(len(a)), [len(v) for v in a]), np.repeat(np.arange(len(b)), [len(v) for v in b])
    at_a, at_b = np.searchsorted(both, x), np.searchsorted(both, y)
    in_a, in_b = np.isin(x, both), np.isin(y, both)
    for low in range(0, len(both), width):
        sides = []
        for at, known, rows, n in ((at_a, in_a, rows_a, len(a)), (at_b, in_b, rows_b, len(b))):
            here = known & (at >= low) & (at < low + width)
            side = np.zeros((n, min(width, len(both) - low)), np.float32)
            side[rows[here], at[here] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def open_pairs(open_: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b), a < b, of different components of a bucket, one of them outside its
    largest, whose sets are similar by their hashed items."""
    sizes = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    rows = open_.join(items, "vertex")
    weight = rows.groupBy("key").agg(F.sum(F.size("items")).alias("weight"))
    member = F.struct("vertex", "component", "n", (F.col("component") != F.col("main")).alias("outside"), "items")
    block = F.pmod(F.xxhash64("vertex"), F.ceil(F.col("weight") / BLOCK))
    blocks = rows.join(largest, "key").join(weight, "key").groupBy("key", block.alias("block")).agg(F.collect_list(member).alias("own"))
    left, right = blocks.toDF("key", "block_a", "a"), blocks.toDF("key", "block_b", "b")

    def columns(own: pa.StructScalar):
        v = own.values
        lists = v.field("items")
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        return (*(v.field(c).to_numpy(zero_copy_only=False) for c in ("vertex", "component", "n", "outside")), [flat[i:j] for i, j in zip(ends, ends[1:])])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in parts:
                for one, two in zip(batch.column("a"), batch.column("b")):
                    va, ca, na, oa, xa = columns(one)
                    vb, cb, nb, ob, xb = columns(two)
                    common = intersections(xa, xb) + SLACK
                    may = (ca[:, None] != cb) & (oa[:, None] | ob) & ((100 + SIMILAR) * common >= SIMILAR * (na[:, None] + nb))
                    for x, y in np.argwhere(may).tolist():
                        p, q = int(va[x]), int(vb[y])
                        yield min(p, q), max(p, q)
        yield from batches({"a": pa.int64(), "b": pa.int64()}, rows())

    return left.join(right, "key").where("block_a <= block_b").select("a", "b").mapInArrow(run, "a bigint, b bigint").distinct()


def matrix(minima: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(minima), np.uint8).reshape(len(minima), -1)


def likely(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (a, b, na, nb, ma, mb) whose sizes allow the similarity and whose minima agree."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if batch.num_rows:
                same = (matrix(batch.column("ma").to_pylist()) == matrix(batch.column("mb").to_pylist())).sum(axis=1) >= AGREE
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(same)), batch.column("b").filter(pa.array(same))], ["a", "b"])

    sized = pairs.where(f"100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)")
    return sized.select("a", "b", "ma", "mb").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    signed = stored(signatures(docs), "minhash-signed")
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("vertex"), F.first("n_shingles").alias("n"), F.first("minima").alias("minima"), F.first("keys").alias("keys"))
    classes = stored(classes, "minhash-classes")
    banded = dealt(classes.select("vertex", F.explode("keys").alias("key")), "key").distinct()
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    open_ = stored(banded.join(shared, "key"), "minhash-buckets")
    sketch = classes.select("vertex", "n", "minima")
    members = docs.select(F.col("doc_id").cast("long").alias("vertex"), F.col("text").cast("string").alias("text")).where("vertex is not null and text is not null")
    involved = members.join(open_.select("vertex").distinct(), "vertex", "left_semi").join(classes.select("vertex").distinct(), "vertex", "left_semi").distinct()
    involved = stored(involved, "minhash-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sketch.select(F.col("vertex").alias("a"), F.col("n").alias("na"), F.col("minima").alias("ma"))
        right = sketch.select(F.col("vertex").alias("b"), F.col("n").alias("nb"), F.col("minima").alias("mb"))
        agreeing = likely(pairs.join(left, "a").join(right, "b"))
        with_texts = agreeing.join(involved.select(F.col("vertex").alias("b"), F.col("text").alias("text_b")), "b").join(involved.select(F.col("vertex").alias("a"), F.col("text").alias("text_a")), "a")
        return stored(verified(with_texts), "minhash-links")

    found = None
    for turn in range(ROUNDS_OF_HEADS):
        rank = F.col("vertex") if turn == 0 else F.xxhash64("vertex", F.lit(turn))
        own = dealt(open_, "key", "vertex", *["component"] * bool(turn))
        if turn:
            heads = own.groupBy("key").agg(F.min_by(F.struct("vertex", "component"), rank).alias("h")).select("key", "h.*").toDF("key", "a", "head_component")
            pairs = own.join(heads, "key").where("component != head_component").select("a", F.col("vertex").alias("b"))
        else:
            heads = own.groupBy("key").agg(F.min_by("vertex", rank).alias("a"))
            pairs = own.join(heads, "key").where("a != vertex").select("a", F.col("vertex").alias("b"))
        new = confirmed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if found is not None and new.isEmpty():
            continue
        found = joined(found, new)
        marked = dealt(labelled(open_.select("key", "vertex"), found), "key")
        unsettled = marked.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
        open_ = stored(marked.join(unsettled, "key"), "minhash-open")
        if open_.isEmpty():
            break
    else:
        for _ in range(PRUNINGS):
            open_, items = linkable(open_, involved, sketch)
        new = confirmed(open_pairs(open_, items))
        found = found if new.isEmpty() else joined(found, new)
    groups = labelled(classes.select("set_key", "vertex"), found).select("set_key", "component")
    # Ids that stand for several texts join their classes through the shared vertex already.
    out = signed.select("doc_id", "n_shingles", "set_key").join(groups, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
