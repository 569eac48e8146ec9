"""Card similarity: exact pairs over a threshold, merge plans, centroid relevance.

The pair search is exact. Vectors are assigned to cells around a few pivots; a
vector can only be close to members of a cell whose radius plus the threshold
angle reaches it, so it visits just those cells. Small cells stand together in
one block, which a vector visits once, and large ones are cut into blocks. One
task compares one pair of blocks, tile by tile: a matrix product in single
precision names the candidates, double precision decides them.

Boosts do not widen that search for everyone. A shared name or tag that few
cards hold meets on its own key; what many hold sets a level for its holders
alone, and two cards are searched at the angle of the smaller level of both.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx, vectors as vx
from ..session import cut_lineage

# Thresholds and boosts.
LINK, MERGE, AUTO = 0.75, 0.85, 0.95
ALIAS_BOOST, TAG_BOOST = 0.10, 0.05
STUBS = ("No explicit definition extracted from literature perspective.",
         "No explicit mathematical representation extracted from literature perspective.",
         "[STUB: Awaiting synthesis]")
EMBED_CHARS, EMBED_BATCH = 8000, 16
BLOCK_ROWS, CELL_ROWS = 8192, 256
TILE, CONFIRMED = 1 << 22, 1 << 16  # scores held at once, candidates confirmed at once
PIVOTS = 1024
RARE_KEY = 256  # up to so many holders, a shared name or tag is met on its own key
KEY_ROWS = 4096  # holders of rare keys that one task compares at once


def embedding_text(text: Column, tags: Column, aliases: Column) -> Column:
    """Card text for embedding: front matter, link syntax and headings off, tags and aliases on."""
    out = F.regexp_replace(text, r"(?s)^---.*?---\n", "")
    out = F.regexp_replace(out, r"\[\[(.*?)\]\]", "$1")
    out = F.regexp_replace(out, r"\[(.*?)\]\(.*?\)", "$1")
    out = F.regexp_replace(out, r"#+\s*", "")
    for phrase in STUBS:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    out = tx.strip(out)
    parts = F.filter(F.array(
        F.when(F.size(tags) > 0, F.concat(F.lit("Tags include "), F.array_join(tags, ", "), F.lit("."))),
        F.when(F.size(aliases) > 0, F.concat(F.lit("Known aliases: "), F.array_join(aliases, ", "), F.lit(".")))),
        lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(out, F.lit("\n\n[Metadata Context: "), F.array_join(parts, " "), F.lit("]"))).otherwise(out)


def hashed_embedding(dims: int = 64) -> Callable[[list[str]], list[list[float]] | None]:
    """Deterministic embedder for places without a model: signed hashed words, unit length."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims), dtype=np.float64)
        for row, text in enumerate(texts):
            codes = pd.util.hash_array(np.array(text.lower().split() or [""], dtype=object))
            np.add.at(out[row], (codes % dims).astype(int), np.where((codes >> 32) % 2 == 0, 1.0, -1.0))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1.0, norms)).tolist()
    return embed


def embed_texts(df: DataFrame, text: str, embedder: Callable[[list[str]], list | None], batch: int = EMBED_BATCH,
                out: str = "embedding") -> DataFrame:
    """Add a vector column. Texts go in batches; a batch that fails is null as a whole."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts = [(t or "")[:EMBED_CHARS] for t in series]
            vectors: list = []
            for at in range(0, len(texts), batch):
                part = texts[at:at + batch]
                got = embedder(part)
                vectors += list(got) if got is not None and len(got) == len(part) else [None] * len(part)
            yield pd.Series(vectors)
    return df.withColumn(out, F.pandas_udf(run, "array<double>")(F.col(text)))


def embedding_cache(cards: DataFrame, cache: DataFrame, embedder: Callable[[list[str]], list | None]) -> DataFrame:
    """name, hash, embedding, cached: vectors are recomputed only where the text hash changed.

    `cards`: name, text. `cache`: name, hash, embedding.
    """
    hashed = cards.select("name", "text", F.md5("text").alias("hash"))
    held = hashed.join(cache.select("name", "hash", "embedding"), ["name", "hash"], "left")
    hits = held.filter(F.col("embedding").isNotNull()).select("name", "hash", F.col("embedding").cast("array<double>").alias("embedding"),
                                                              F.lit(True).alias("cached"))
    misses = embed_texts(held.filter(F.col("embedding").isNull()).select("name", "hash", "text"), "text", embedder) \
        .filter(F.col("embedding").isNotNull()).select("name", "hash", "embedding", F.lit(False).alias("cached"))
    return hits.unionByName(misses)


def distinct_cards(cards: DataFrame, extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(representatives, members): cards with the same vector and the same extras share one representative.

    A third of the corpus may be copies of one card; they are compared once.
    """
    group = ["embedding", *extra]
    reps = cards.groupBy(*group).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = cards.join(reps.select(*group, "rep"), group).select("rep", "id")
    return reps, members


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _pivots(cards: DataFrame, count: int) -> np.ndarray:
    """A bounded, repeatable choice of vectors with a direction: the `count` smallest hashes."""
    some = cards.select("embedding").filter(F.exists("embedding", lambda x: x != 0))
    rows = some.orderBy(F.xxhash64("embedding")).limit(count).collect()
    return _unit(np.array([r[0] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))


def _angles(vectors: pd.Series, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles to the pivots, and which vectors are zero: those stand at a right angle to everything."""
    unit = _unit(np.stack(vectors.to_numpy()).astype(np.float64))
    zero = ~unit.any(axis=1)
    if not len(pivots):
        return np.zeros((len(unit), 0)), zero
    angles = np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))
    angles[zero] = math.pi / 2
    return angles, zero


def _placing(pivots: np.ndarray) -> Callable[[pd.Series], pd.DataFrame]:
    """Cell and distance of each vector; zero vectors have a cell of their own behind the others."""
    def run(vectors: pd.Series) -> pd.DataFrame:
        angles, zero = _angles(vectors, pivots)
        cell, near = np.full(len(angles), len(pivots)), np.zeros(len(angles))
        if angles.shape[1]:
            cell[~zero], near[~zero] = angles.argmin(axis=1)[~zero], angles.min(axis=1)[~zero]
        return pd.DataFrame({"cell": cell.astype(np.int32), "near": near})
    return F.pandas_udf(run, "cell int, near double")


def _blocks(homes: pd.DataFrame, block_rows: int) -> pd.Series:
    """Number of each home's block: neighbours share one as long as they fit."""
    numbers, held = [], block_rows + 1
    for rows in homes["rows"]:
        if held + rows > block_rows:
            numbers.append(numbers[-1] + 1 if numbers else 0)
            held = rows
        else:
            numbers.append(numbers[-1])
            held += rows
    return pd.Series(numbers, index=homes.index, dtype="int64")


def _visits(pivots: np.ndarray, homes: pd.DataFrame, threshold: float) -> Callable:
    """Numbers of the blocks that hold a home (cell, level) that a vector has to visit: none behind its own cell."""
    by_level = {int(level): (part.index.to_numpy(), part["cell"].to_numpy(), part["radius"].to_numpy()) for level, part in homes.groupby("level")}
    first = np.flatnonzero(homes["at"].diff().fillna(1).to_numpy())

    def run(vectors: pd.Series, cells: pd.Series, levels: pd.Series) -> pd.Series:
        angles, zero = _angles(vectors, pivots)
        angles = np.hstack([angles, np.full((len(angles), 1), math.pi / 2)])
        own, mine = cells.to_numpy()[:, None], levels.to_numpy()
        reached = np.zeros((len(angles), len(homes)), bool)
        for level, (numbers, at, radius) in by_level.items():
            lowest = np.clip(threshold - TAG_BOOST * np.minimum(mine, level), -1.0, 1.0)
            limit = np.where(zero[:, None], 0.0, radius[None, :]) + np.arccos(lowest)[:, None] + 1e-6
            reached[:, numbers] = (angles[:, at] <= limit) & (at[None, :] <= own)
        return pd.Series([np.flatnonzero(row) for row in np.logical_or.reduceat(reached, first, axis=1)], dtype=object)
    return F.pandas_udf(run, "array<int>")


def _entries(lists: pd.Series, codes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each member of the lists, in row order; `codes` grows by the new members."""
    rows = np.repeat(np.arange(len(lists)), [len(items) for items in lists])
    return rows, np.array([codes.setdefault(item, len(codes)) for items in lists for item in items], np.int64)


def _overlap(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], top: int, shape: tuple[int, int]) -> np.ndarray:
    """How many members each pair of lists shares, for the rows of `left` from `top`, as a matrix product of indicator rows."""
    lo, hi = np.searchsorted(left[0], [top, top + shape[0]])
    shared = np.intersect1d(left[1][lo:hi], right[1])
    if not len(shared):
        return np.float32(0)
    grids = []
    for rows, codes, height in ((left[0][lo:hi] - top, left[1][lo:hi], shape[0]), (*right, shape[1])):
        grid, at = np.zeros((height, len(shared)), np.float32), np.minimum(np.searchsorted(shared, codes), len(shared) - 1)
        held = shared[at] == codes
        grid[rows[held], at[held]] = 1.0
        grids.append(grid)
    return grids[0] @ grids[1].T


def analysed_cards(cards: DataFrame) -> DataFrame:
    """Cards that the pair search looks at: no stubs (a missing status is one) and no empty embedding text.

    `cards`: status and text beside the columns of `similar_pairs`.
    """
    return cards.filter((F.coalesce(F.col("status"), F.lit("stub")) != "stub") & (tx.strip(F.col("text")) != ""))


def _boosts(left: pd.DataFrame, right: pd.DataFrame) -> Callable[[int, tuple[int, int]], np.ndarray]:
    """Boosts of the rows of `left` from a given one, by row of `right`."""
    names, tags = {}, {}
    (title_a, alias_a), (title_b, alias_b) = ((_entries(t["title"], names), _entries(t["aliases"], names)) for t in (left, right))
    tags_a, tags_b = _entries(left["tags"], tags), _entries(right["tags"], tags)

    def run(top: int, shape: tuple[int, int]) -> np.ndarray:
        clash = _overlap(alias_a, alias_b, top, shape) + _overlap(title_a, alias_b, top, shape) + _overlap(alias_a, title_b, top, shape)
        return np.broadcast_to(np.where(clash > 0, ALIAS_BOOST, TAG_BOOST * _overlap(tags_a, tags_b, top, shape)), shape)

    return run


def _passing(left: pd.DataFrame, right: pd.DataFrame, once: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float, boosts: bool) -> pd.DataFrame:
    """Pairs of both tables, among those that `once` admits by row numbers, whose score reaches the threshold."""
    units = [_unit(np.stack(t["embedding"].to_numpy()).astype(np.float64)) for t in (left, right)]
    rough_a, rough_b = (u.astype(np.float32) for u in units)
    # More than single precision loses in a product of unit vectors.
    slack = (rough_a.shape[1] + 16) * 2.0 ** -23
    height = max(1, TILE // len(right))
    lifts = _boosts(left, right) if boosts else None
    found = []
    for top in range(0, len(left), height):
        rough = rough_a[top:top + height] @ rough_b.T
        boost, lost = None, slack
        if boosts:
            boost = lifts(top, rough.shape)
            rough += boost
            lost = slack * (1.0 + float(boost.max()))
        x, y = np.nonzero(rough >= threshold - lost)
        for at in range(0, len(x), CONFIRMED):
            i, j = x[at:at + CONFIRMED], y[at:at + CONFIRMED]
            fits = once(i + top, j)
            i, j = i[fits], j[fits]
            cosine = np.einsum("ij,ij->i", units[0][i + top], units[1][j])
            own = boost[i, j] if boosts else np.zeros(len(i))
            fits = np.minimum(1.0, cosine + own) >= threshold
            found.append((i[fits] + top, j[fits], cosine[fits], own[fits]))
    if not found:
        return _no_pairs()
    x, y, cosine, boost = map(np.concatenate, zip(*found))
    ids_a, ids_b = left["id"].to_numpy()[x], right["id"].to_numpy()[y]
    swap = ids_a > ids_b
    return pd.DataFrame({"a": np.where(swap, ids_b, ids_a), "b": np.where(swap, ids_a, ids_b), "cosine": cosine, "boost": boost,
                         "pairs": left["copies"].to_numpy()[x] * right["copies"].to_numpy()[y]})


def _no_pairs() -> pd.DataFrame:
    return pd.DataFrame({"a": [], "b": [], "cosine": [], "boost": [], "pairs": []})


def _boost_keys(base: DataFrame) -> DataFrame:
    """space, value, id, hot: the names and tags that can lift a pair. A name counts where a card holds it as an alias."""
    held = lambda column, space, alias: base.select("id", F.lit(space).alias("space"), F.lit(alias).alias("alias"), F.explode(column).alias("value"))
    keys = held("tags", "tag", True).unionByName(held("aliases", "name", True)).unionByName(held("title", "name", False))
    shared = keys.groupBy("space", "value").agg(F.count("*").alias("n"), F.max("alias").alias("alias")).filter("n > 1 AND alias")
    return keys.select("space", "value", "id").distinct().join(shared.select("space", "value", (F.col("n") > RARE_KEY).alias("hot")), ["space", "value"])


def _pairs_on_rare_keys(base: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share a rare name or tag. Keys go by bucket, so that a task compares about KEY_ROWS holders, key by key."""
    rare = keys.filter("NOT hot")
    buckets = max(1, -(-rare.count() // KEY_ROWS))
    rows = rare.withColumn("bucket", F.pmod(F.xxhash64("space", "value"), F.lit(buckets))).join(base, "id")

    def compare(bucket: pd.DataFrame) -> pd.DataFrame:
        found = [_no_pairs()]
        for _, holders in bucket.groupby(["space", "value"], sort=False):
            ids = holders["id"].to_numpy()
            found.append(_passing(holders, holders, lambda x, y, ids=ids: ids[x] < ids[y], threshold, True))
        return pd.concat([f for f in found if len(f)] or found[:1])

    kind = dict(base.dtypes)["id"]
    return rows.groupBy("bucket").applyInPandas(compare, f"a {kind}, b {kind}, cosine double, boost double, pairs long")


def similar_pairs(cards: DataFrame, threshold: float = LINK, boosts: bool = True, pivots: int = PIVOTS,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every pair a<b whose cosine plus boost reaches `threshold`: a, b, cosine, score, boost.

    `cards`: id, embedding and, with boosts, name, tags, aliases. An alias
    collision adds 0.10, otherwise each shared tag 0.05, capped at 1. Cards
    without a vector take no part; a zero vector has cosine 0 with every other;
    null names, tags and aliases lift nothing; ids are distinct.

    A pair that shares a rare name or tag is found on that key. Any other pair
    is lifted by common ones alone, by no more than the smaller level of both
    (tags in common use, or an alias collision's worth), so it is searched at
    that angle: cards without common keys go at the full threshold.
    """
    pairs = _search(cards.withColumn("copies", F.lit(1).cast("long")), threshold, boosts, pivots, block_rows)
    return pairs.select("a", "b", "cosine", F.least(F.lit(1.0), F.col("cosine") + F.col("boost")).alias("score"), "boost")


def _search(cards: DataFrame, threshold: float, boosts: bool, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b, cosine, boost and the product of both cards' `copies`."""
    base = cards.filter(F.col("embedding").isNotNull())
    none = F.array().cast("array<string>")
    if boosts:
        lowered = lambda c: F.array_compact(F.array_distinct(F.transform(F.coalesce(F.col(c), none), lambda x: F.lower(x))))
        title = F.array_compact(F.array(F.lower(F.regexp_replace(F.col("name"), "[-_]", " "))))
        base = base.select("id", "copies", "embedding", lowered("tags").alias("tags"), lowered("aliases").alias("aliases"), title.alias("title"))
        keys = cut_lineage(_boost_keys(base))
        worth = F.greatest(F.sum(F.when(F.col("space") == "tag", 1).otherwise(0)),
                           F.max(F.when(F.col("space") == "name", round(ALIAS_BOOST / TAG_BOOST)).otherwise(0)))
        # Beyond this level every angle is in reach.
        most = max(0, math.ceil((threshold + 1) / TAG_BOOST))
        levels = keys.filter("hot").groupBy("id").agg(F.least(worth, F.lit(most)).cast("int").alias("level"))
        base = base.join(levels, "id", "left").na.fill(0, ["level"])
    else:
        base = base.select("id", "copies", "embedding", none.alias("tags"), none.alias("aliases"), none.alias("title"), F.lit(0).alias("level"))
    centres = _pivots(base, max(1, min(pivots, -(-base.count() // CELL_ROWS))))
    placed = cut_lineage(base.withColumn("_p", _placing(centres)("embedding")).select("*", "_p.cell", "_p.near").drop("_p"))
    # At most (pivots + 1) * (most + 1) rows, whatever the input.
    homes = placed.groupBy("cell", "level").agg(F.max("near").alias("radius"), F.count("*").alias("rows")).orderBy("cell", "level").toPandas()
    homes["at"] = _blocks(homes, block_rows)
    reached = placed.withColumn("at", F.explode(_visits(centres, homes, threshold)("embedding", "cell", "level")))
    visitors = {r["at"]: r["n"] for r in reached.groupBy("at").agg(F.count("*").alias("n")).collect()}
    blocks = [(int(at), max(1, -(-int(rows) // block_rows)), max(1, -(-visitors.get(at, 0) // block_rows)))
              for at, rows in homes.groupby("at")["rows"].sum().items()]
    session = cards.sparkSession
    plan = F.broadcast(session.createDataFrame(blocks, "at int, nh int, nv int"))
    place = F.broadcast(session.createDataFrame([(int(h.at), int(h.cell), int(h.level)) for h in homes.itertuples()], "at int, cell int, level int"))
    spread = F.abs(F.xxhash64("id"))
    row = ["id", "copies", "cell", "embedding", *(["tags", "aliases", "title"] if boosts else [])]
    home = placed.join(place, ["cell", "level"]).join(plan, "at").withColumn("h", (spread % F.col("nh")).cast("int")) \
        .withColumn("v", F.explode(F.sequence(F.lit(0), F.col("nv") - 1))).select("at", "h", "v", *row)
    visit = reached.join(plan, "at").withColumn("v", (spread % F.col("nv")).cast("int")) \
        .withColumn("h", F.explode(F.sequence(F.lit(0), F.col("nh") - 1))).select("at", "h", "v", *row)

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["side"] == 0], block[block["side"] == 1]
        if left.empty or right.empty:
            return _no_pairs()
        (cells_a, ids_a), (cells_b, ids_b) = ((t["cell"].to_numpy(), t["id"].to_numpy()) for t in (left, right))

        def once(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return (cells_b[y] > cells_a[x]) | ((cells_b[y] == cells_a[x]) & (ids_a[x] < ids_b[y]))

        return _passing(left, right, once, threshold, boosts)

    kind = dict(cards.dtypes)["id"]
    both = home.withColumn("side", F.lit(0)).unionByName(visit.withColumn("side", F.lit(1)))
    pairs = both.groupBy("at", "h", "v").applyInPandas(compare, f"a {kind}, b {kind}, cosine double, boost double, pairs long")
    if boosts:
        pairs = pairs.unionByName(_pairs_on_rare_keys(base.drop("level"), keys, threshold)).dropDuplicates(["a", "b"])
    return pairs


def similar_groups(cards: DataFrame, threshold: float = LINK, **options) -> DataFrame:
    """Pairs between distinct vectors, each standing for `pairs` card pairs; copies pair with themselves.

    Lossless and not quadratic in the copies; `distinct_cards` names each one's members.
    """
    reps, _ = distinct_cards(cards)
    pairs = _search(reps.select(F.col("rep").alias("id"), "copies", "embedding"), threshold, False, **options).select("a", "b", "cosine", "pairs")
    nonzero = F.exists(F.col("embedding"), lambda x: x != 0)
    own = reps.filter((F.col("copies") > 1) & nonzero).select(
        F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine"),
        (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("pairs"))
    return pairs.unionByName(own)


def merge_candidates(pairs: DataFrame, threshold: float = MERGE) -> DataFrame:
    return pairs.filter(F.col("score") >= threshold)


def merge_plan(pairs: DataFrame, names: DataFrame, threshold: float = AUTO) -> DataFrame:
    """Greedy merges, strongest pair first: survivor, merged, score.

    A name already merged away is skipped; the shorter name survives, the first
    on a tie. The order (score desc, a, b) is total, so rounds give the
    sequential result: in each round every node decides the leading run of its
    pairs for which the other end has nothing stronger, up to the first pair it
    loses. Each round is two aggregates, never a per-node list.
    """
    sized = names.select("id", F.length("name").alias("_len"))
    todo = pairs.filter(F.col("score") >= threshold).select("a", "b", "score") \
        .join(sized.select(F.col("id").alias("a"), F.col("_len").alias("_la")), "a") \
        .join(sized.select(F.col("id").alias("b"), F.col("_len").alias("_lb")), "b") \
        .select("a", "b", "score", (F.col("_la") <= F.col("_lb")).alias("a_wins"))
    todo = cut_lineage(todo.withColumn("key", F.struct((-F.col("score")).alias("s"), "a", "b")))
    done = todo.select(F.col("a").alias("survivor"), F.col("b").alias("merged"), "score").limit(0)
    while not todo.isEmpty():
        ends = todo.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("a_wins").alias("wins"), "key") \
            .unionByName(todo.select(F.col("b").alias("node"), F.col("a").alias("other"), (~F.col("a_wins")).alias("wins"), "key"))
        best = ends.groupBy("node").agg(F.min("key").alias("best"))
        seen = ends.join(best.select(F.col("node").alias("other"), F.col("best").alias("other_best")), "other")
        free = F.col("key") == F.col("other_best")
        stops = seen.groupBy("node").agg(F.min(F.when(~free, F.col("key"))).alias("stop"),
                                         F.min(F.when(free & ~F.col("wins"), F.col("key"))).alias("lose"))
        judged = seen.join(stops, "node").filter(free)
        before_stop = F.col("stop").isNull() | (F.col("key") < F.col("stop"))
        before_loss = F.col("lose").isNull() | (F.col("key") < F.col("lose"))
        won = judged.filter(F.col("wins") & before_stop & before_loss).select(
            F.col("node").alias("survivor"), F.col("other").alias("merged"), (-F.col("key.s")).alias("score"))
        lost = judged.filter((F.col("key") == F.col("lose")) & before_stop).select(
            F.col("other").alias("survivor"), F.col("node").alias("merged"), (-F.col("key.s")).alias("score"))
        step = cut_lineage(won.unionByName(lost).distinct())
        done = done.unionByName(step)
        gone = step.select("merged").distinct()
        todo = cut_lineage(todo.join(gone.withColumnRenamed("merged", "a"), "a", "left_anti")
                           .join(gone.withColumnRenamed("merged", "b"), "b", "left_anti")
                           .select("a", "b", "score", "a_wins", "key"))
    return done


def merged_fields(left: DataFrame, right: DataFrame, key: str, lists: Sequence[str] = ("tags", "aliases", "sources")) -> DataFrame:
    """Merge two cards per key: list fields united in order, other fields from the survivor (left)."""
    other = right.select(key, *[F.col(c).alias("_r_" + c) for c in right.columns if c != key])
    joined = left.join(other, key)
    none = F.array().cast("array<string>")
    picks = []
    for c in left.columns:
        if c == key or "_r_" + c not in joined.columns:
            picks.append(F.col(c))
        elif c in lists:
            picks.append(F.array_distinct(F.concat(F.coalesce(F.col(c), none), F.coalesce(F.col("_r_" + c), none))).alias(c))
        else:
            picks.append(F.coalesce(F.col(c), F.col("_r_" + c)).alias(c))
    return joined.select(*picks)


def link_changes(existing: DataFrame, target: DataFrame) -> DataFrame:
    """added and removed links per document, from long tables (doc, link)."""
    added = target.select("doc", "link").distinct().join(existing.select("doc", "link"), ["doc", "link"], "left_anti")
    removed = existing.select("doc", "link").distinct().join(target.select("doc", "link"), ["doc", "link"], "left_anti")
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


def mean_vector(df: DataFrame, keys: Sequence[str], column: str = "embedding") -> DataFrame:
    """Element-wise mean per group, combined on the map side."""
    vec = array_to_vector(F.col(column).cast("array<double>"))
    grouped = df.withColumn("_v", vec).groupBy(*keys) if keys else df.withColumn("_v", vec).groupBy()
    return grouped.agg(Summarizer.mean(F.col("_v")).alias("_m")).select(*keys, vector_to_array("_m").alias(column))


def centroid(vectors: DataFrame, document: str = "path") -> list[float] | None:
    """Unit mean of per-document means; None when it has no direction. One vector reaches the driver."""
    row = mean_vector(mean_vector(vectors, [document]), []).first()
    if row is None or row[0] is None:
        return None
    centre = np.array(row[0], dtype=np.float64)
    size = float(np.linalg.norm(centre))
    return (centre / size).tolist() if size else None


def score_candidates(candidates: DataFrame, vectors: DataFrame, document: str = "path") -> DataFrame:
    """Add `score`: cosine with the library's centroid, 3 places; nothing on a width mismatch or zero vector."""
    centre = centroid(vectors, document)
    if centre is None:
        return candidates.withColumn("score", F.lit(None).cast("double"))
    column = F.col("embedding")
    size = vx.norm(column)
    fits = column.isNotNull() & (F.size(column) == len(centre)) & (size > 0)
    return candidates.withColumn("score", F.when(fits, F.round(vx.dot_with(column, centre) / size, 3)))
