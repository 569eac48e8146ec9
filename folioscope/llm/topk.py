"""Exact top-k by inner product: a ball tree per shard, branch and bound in batches.

Vectors are integer. Equal vectors become one entry that keeps its `k + 1`
smallest ids (no query can return more of them), so copies cost nothing.
Entries are dealt by direction: to the nearest of at most PIVOTS fixed vectors,
in large cells also by the second nearest, and by hash beyond `shard_rows`.
Each shard is one row that holds its ball tree. Queries travel in blocks of
like direction. For a block and a shard the balls of both bound every score;
a block first visits the shard of its largest bound, then the next NEXT, then
all whose bound reaches the least k-th score of its queries: the others are
never joined. Between rounds the k-th scores are shared. In a tree, a node is
entered only by queries whose bound q.c + |q| r reaches their k-th score, the
child with the larger bounds first. Ties at the bound are entered, so ids
decide exactly.

Null and empty vectors, vectors with a null, NaN or infinite component and null
ids take no part. Vectors of several lengths have no inner product and raise ValueError.
Scores are exact whatever the size of the components; one beyond a long counts
as the nearest value of -(2^63 - 1) to 2^63 - 1. Empty tables give no rows. A
query never returns its own id. Repeated (id, vector) rows count once. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import batches, stored

LEAF = 128
SHARD_ROWS = 8192
BLOCK = 1024
#: Directions that entries are dealt to; their pairs, PIVOTS^2 at most, are counted on the driver.
PIVOTS = 256
#: Shards of the second round, and roots that travel in one row.
NEXT = 8
PAGE = 4096
#: No score found yet; below every score.
NONE = np.iinfo(np.int64).min
NOBODY = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows**2).sum(axis=1))


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs. No partial sum exceeds |q| |v|, which names the arithmetic that suffices."""
    largest = lengths(queries).max() * lengths(vectors).max()
    if largest < 2.0**52:
        return (queries @ vectors.T).astype(np.int64)
    if largest < 2.0**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(queries) @ whole(vectors).T, NONE + 1, NOBODY).astype(np.int64)


def ball(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius of a ball around the rows; the radius makes up for rounding."""
    centre = rows.mean(axis=0)
    radius = float(lengths(rows - centre).max()) * (1 + 1e-9) + 1e-9 * float(np.sqrt((centre**2).sum())) + 1e-6
    return centre, radius if np.isfinite(radius) else np.inf


def reach(bound: np.ndarray) -> np.ndarray:
    """A bound that can be compared: unknown is without end, and none is below the scores that a long holds."""
    return np.maximum(np.where(np.isnan(bound), np.inf, bound), float(NONE))


class BallTree:
    """Nodes in preorder over rows put in leaf order: centre, radius, range, right child."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int]] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.grow(vectors, 0, len(vectors))

    def grow(self, vectors: np.ndarray, low: int, high: int) -> int:
        here, at = self.order[low:high], len(self.nodes)
        own = vectors[here]
        centre, radius = ball(own)
        self.centres.append(centre)
        self.radii.append(radius)
        self.nodes.append((low, high, 0))
        if high - low > LEAF:
            one = own[((own - centre) ** 2).sum(axis=1).argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            middle = (high - low) // 2
            self.order[low:high] = here[np.argsort(own @ (other - one), kind="stable")]
            self.grow(vectors, low, low + middle)
            right = self.grow(vectors, low + middle, high)
            self.nodes[at] = (low, high, right)
        return at


class Search:
    """Best k of each query of a block over one tree, kept as (score, id) sorted by (-score, id)."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, known: np.ndarray, k: int) -> None:
        self.q, self.own, self.k = queries, own, k
        self.norms = lengths(queries)
        self.known = known
        self.scores = np.full((len(queries), k), NONE)
        self.ids = np.full((len(queries), k), NOBODY)

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.known[rows])

    def bounds(self, rows: np.ndarray, tree: BallTree, node: int) -> np.ndarray:
        return reach(self.q[rows] @ tree.centres[node] + self.norms[rows] * tree.radii[node] + 1e-3)

    def visit(self, tree: BallTree, vectors: np.ndarray, ids: np.ndarray, node: int, rows: np.ndarray, bound: np.ndarray) -> None:
        rows = rows[bound >= self.kth(rows)]
        if not len(rows):
            return
        low, high, right = tree.nodes[node]
        if right:
            children = sorted(((self.bounds(rows, tree, c), c) for c in (node + 1, right)), key=lambda x: -x[0].sum())
            for bound, child in children:
                self.visit(tree, vectors, ids, child, rows, bound)
            return
        scores = exact_scores(self.q[rows], vectors[low:high])
        wanted = scores.max(axis=1) >= self.kth(rows)
        rows, scores = rows[wanted], scores[wanted]
        if not len(rows):
            return
        # Every entry stands for its smallest ids; ids is (entries, k + 1), padded with the largest long.
        found = np.broadcast_to(ids[low:high].reshape(1, -1), (len(rows), (high - low) * ids.shape[1]))
        every = np.repeat(scores, ids.shape[1], axis=1)
        every = np.where((found == self.own[rows, None]) | (found == NOBODY), NONE, every)
        both, who = np.concatenate([self.scores[rows], every], axis=1), np.concatenate([self.ids[rows], found], axis=1)
        best = np.lexsort((who, ~both), axis=1)[:, :self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(both, best, axis=1), np.take_along_axis(who, best, axis=1)


def entries_of(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids."""
    ranked = vectors.distinct().withColumn("__n", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("__n") <= k + 1)
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def as_matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def direction(pivots: np.ndarray) -> Column:
    """The nearest pivot by angle and the second nearest, as one number."""
    units = pivots / np.maximum(lengths(pivots), 1e-300)[:, None]

    def run(vectors: pd.Series) -> pd.Series:
        like = np.nan_to_num(np.stack(vectors.to_numpy()) @ units.T)
        first = like.argmax(axis=1)
        like[np.arange(len(like)), first] = -np.inf
        return pd.Series((first * len(units) + like.argmax(axis=1)).astype(np.int32))

    return F.pandas_udf(run, "int")(F.col("vector"))


def dealt(entries: DataFrame, pivots: np.ndarray, shard_rows: int) -> tuple[DataFrame, int]:
    """Entries with their shard, and the number of shards: by cell, large cells by second pivot, large parts by hash."""
    at = entries.withColumn("code", direction(pivots))
    counts = sorted((r["code"], r["count"]) for r in at.groupBy("code").count().collect())
    cells: dict[int, int] = {}
    for code, n in counts:
        cells[code // len(pivots)] = cells.get(code // len(pivots), 0) + n
    whole = {c for c, n in cells.items() if n <= 2 * shard_rows}
    sizes: dict[int, int] = {}
    keys = {code: -1 - code // len(pivots) if code // len(pivots) in whole else code for code, _ in counts}
    for code, n in counts:
        sizes[keys[code]] = sizes.get(keys[code], 0) + n
    parts = {key: -(-n // shard_rows) for key, n in sizes.items()}
    first, shards = {}, 0
    for key, n in parts.items():
        first[key], shards = shards, shards + n
    deal = entries.sparkSession.createDataFrame([(code, first[key], parts[key]) for code, key in keys.items()], "code int, first int, parts int")
    shard = (F.col("first") + F.pmod(F.xxhash64("vector"), F.col("parts"))).cast("int")
    # At most PIVOTS^2 rows of three integers.
    return at.join(F.broadcast(deal), "code").select("vector", "ids", shard.alias("shard")), shards


def build_shards(entries: DataFrame, dimension: int) -> DataFrame:
    """One row (shard, rows in leaf order, their ids, ball) per shard; a shard has about SHARD_ROWS rows."""
    def pack(key, table):
        vectors = as_matrix(table.column("vector").combine_chunks(), dimension)
        tree, lists = BallTree(vectors), table.column("ids").to_pylist()
        width = max(map(len, lists))
        ids = np.full((len(lists), width), NOBODY)
        for i, own in enumerate(lists):
            ids[i, :len(own)] = own
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "width": pa.array([width], pa.int32()), "vectors": [vectors[tree.order].tobytes()], "ids": [ids[tree.order].tobytes()],
                         "nodes": [np.asarray(tree.nodes, np.int64).tobytes()], "centres": [np.asarray(tree.centres).tobytes()], "radii": [np.asarray(tree.radii).tobytes()],
                         "centre": [tree.centres[0].tolist()], "radius": [tree.radii[0]]})

    return entries.groupBy("shard").applyInArrow(pack, "shard int, width int, vectors binary, ids binary, nodes binary, centres binary, radii binary, centre array<double>, radius double")


def searched(pairs: DataFrame, dimension: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of each block's best k in the shard joined to it."""
    out = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in parts:
                for r in b.to_pylist():
                    tree = BallTree.__new__(BallTree)
                    tree.nodes = [tuple(n) for n in np.frombuffer(r["nodes"], np.int64).reshape(-1, 3)]
                    tree.centres, tree.radii = np.frombuffer(r["centres"]).reshape(-1, dimension), np.frombuffer(r["radii"])
                    vectors, ids = np.frombuffer(r["vectors"]).reshape(-1, dimension), np.frombuffer(r["ids"], np.int64).reshape(-1, r["width"])
                    own = np.asarray(r["query_ids"], np.int64)
                    known = np.asarray([NONE if x is None else x for x in r["known"]], np.int64)
                    s = Search(np.asarray(r["queries"], np.float64).reshape(-1, dimension), own, known, k)
                    every = np.arange(len(own))
                    s.visit(tree, vectors, ids, 0, every, s.bounds(every, tree, 0))
                    for q, scores, found in zip(own.tolist(), s.scores, s.ids):
                        for score, vec in zip(scores.tolist(), found.tolist()):
                            if score != NONE:
                                yield q, vec, score
        yield from batches(out, rows(), 8192)

    return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def pages_of(trees: DataFrame) -> DataFrame:
    """The balls of all shards, PAGE to a row."""
    page = (F.col("shard") / PAGE).cast("int").alias("page")
    return trees.groupBy(page).agg(F.collect_list("shard").alias("shards"), F.flatten(F.collect_list("centre")).alias("centres"), F.collect_list("radius").alias("radii"))


def summaries(blocks: DataFrame, dimension: int) -> DataFrame:
    """Each block's ball and the least k-th score of its queries; none while one of them has no k-th score."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            balls = [ball(np.asarray(q, np.float64).reshape(-1, dimension)) for q in b.column("queries").to_pylist()]
            least = [min(NONE if x is None else x for x in known) for known in b.column("known").to_pylist()]
            yield pa.record_batch({"block": b.column("block"), "middle": pa.array([c.tolist() for c, _ in balls], pa.list_(pa.float64())), "width": pa.array([r for _, r in balls], pa.float64()), "least": pa.array(least, pa.int64())})

    return blocks.mapInArrow(run, "block int, middle array<double>, width double, least bigint")


def reachable(blocks: DataFrame, pages: DataFrame, n_pages: int, dimension: int, most: int | None) -> DataFrame:
    """(block, shard, bound) where the bound of the two balls reaches the block's k-th scores; of a page only the `most` largest.

    A score of q = m + d with v = c + e is m.c + d.c + q.e, and |q| <= |m| + width.
    """
    out = {"block": pa.int32(), "shard": pa.int32(), "bound": pa.float64()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in parts:
                for r in b.to_pylist():
                    centres, radii, middle = np.asarray(r["centres"], np.float64).reshape(-1, dimension), np.asarray(r["radii"]), np.asarray(r["middle"], np.float64)
                    bounds = reach(centres @ middle + r["width"] * lengths(centres) + (np.sqrt((middle**2).sum()) + r["width"]) * radii + 1e-3)
                    order = np.argsort(-bounds, kind="stable")[:most]
                    for i in order[bounds[order] >= r["least"]].tolist():
                        yield r["block"], r["shards"][i], float(bounds[i])
        yield from batches(out, rows(), 8192)

    every = summaries(blocks, dimension).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))))
    return every.join(pages, "page").mapInArrow(run, "block int, shard int, bound double")


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "vector", "known"))).alias("__q")).select(
        "block", F.col("__q.id").alias("query_ids"), F.flatten("__q.vector").alias("queries"), F.col("__q.known").alias("known"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query row.

    Both inputs have `id` (long) and `vector` (array of double, whole numbers).
    Score ties go to the smaller id.
    """
    fine = usable(F.col("vector")) & F.col("id").isNotNull()
    vectors, queries = (df.where(fine).select("id", "vector") for df in (vectors, queries))
    entries = stored(entries_of(vectors, k), "topk-entries")
    asked = stored(queries.distinct(), "topk-asked")
    size = F.size("vector")
    low, high = entries.select(size.alias("n")).unionByName(asked.select(size.alias("n"))).agg(F.min("n"), F.max("n")).first()
    if low != high:  # Both are null where no vector takes part.
        raise ValueError(f"vectors of {low} and of {high} components have no inner product")
    dimension, n_pivots = high or 0, max(1, min(PIVOTS, -(-entries.count() // shard_rows)))
    pivots = np.asarray([r[0] for r in entries.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(n_pivots).collect()] or [[0.0] * dimension])
    placed, shards = dealt(entries, pivots, shard_rows)
    trees = stored(build_shards(placed, dimension), "topk-trees")
    n_pages = max(1, -(-shards // PAGE))
    pages = stored(pages_of(trees), "topk-pages")

    # Blocks hold queries of one cell; a cell's queries are cut by hash.
    cell = (direction(pivots) / len(pivots)).cast("int")
    homed = asked.withColumn("cell", cell)
    counts = {r["cell"]: -(-r["count"] // BLOCK) for r in homed.groupBy("cell").count().collect()}
    starts, total = [0] * len(pivots), 0
    for c in range(len(pivots)):
        starts[c], total = total, total + counts.get(c, 0)
    cut = [max(1, counts.get(c, 0)) for c in range(len(pivots))]
    asked = homed.withColumn("block", (F.element_at(F.lit(starts), F.col("cell") + 1) + F.pmod(F.xxhash64("id", "vector"), F.element_at(F.lit(cut), F.col("cell") + 1))).cast("int"))

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    blocks, found, seen = in_blocks(asked.withColumn("known", F.lit(None).cast("bigint"))), None, None
    for at, most in enumerate((1, NEXT, None)):
        # The first `visited` shards by bound were seen; ask for as many more.
        visited = (0, 1, 1 + NEXT)[at]
        pairs = reachable(blocks, pages, n_pages, dimension, None if most is None else visited + most)
        if seen is not None:
            pairs = pairs.join(seen, ["block", "shard"], "left_anti")
        if most is not None:
            order = F.row_number().over(W.partitionBy("block").orderBy(F.desc("bound"), "shard"))
            pairs = pairs.withColumn("__n", order).where(F.col("__n") <= most)
        pairs = stored(pairs.select("block", "shard"), "topk-pairs")
        got = searched(pairs.join(blocks, "block").join(trees, "shard"), dimension, k)
        merged = got if found is None else found.unionByName(got)
        found = merged.distinct().withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k)
        if most is None:
            break
        found = stored(found, "topk-found")
        kth = found.where(F.col("__n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("known"))
        blocks, found = in_blocks(asked.join(kth, "id", "left")), found.drop("__n")
        seen = pairs if seen is None else seen.unionByName(pairs)
        if shards <= visited + most:
            return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")
    return found.select("query_id", F.col("__n").alias("rank"), "vec_id", "score")
