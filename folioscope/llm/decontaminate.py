"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

Words are runs of letters and digits, lower-cased. A document holds an item if
at least SHARE of the item's words agree on one diagonal (document place minus
item place). So an item of n words may lose k = n - ceil(SHARE * n) of them.

The masks are fixed: two words, a gap of 0, 2, 4 or 6 words that may be
anything, two words. An item is cut into b = n div 2 blocks of two words, and
those into windows of WINDOW = 5 blocks. Every two blocks of a window are a seed
under one of the masks; masked runs of the documents meet them by hash.

That misses nothing: k changes spoil k blocks at most, so b - k are whole; if
b - k exceeds the number of windows, one window has two whole blocks, and these
are a seed. At SHARE = 0.7 this holds for 6 words and from 8 words on, so all
seeds have four words there. Shorter items (and longer ones at a lower share
that breaks the rule) go by one seed in each of k + 1 equal blocks, of which k
changes leave one whole: its first words, three at most. Around each hit the
whole item is compared on the diagonal met.

Defined results: null and empty texts hold nothing; an item without words is
never found; a null doc_id or item_id is reported as null; repeated rows are
reported once; a document may hold many items and one item may be in any number
of documents; words of an item beyond a document's ends count as changed; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.staging import computed_once

#: Words of a seed, by their offsets; what lies between is ignored.
MASKS = ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (0, 1, 8, 9))
#: Blocks of two words in a window; the masks reach over it.
WINDOW = len(MASKS) + 1
#: Longest seed of an item that is too short for two blocks.
SHORT = 3
SHARE = 0.7
#: Seeds up to this count are broadcast (some 40 MB); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hash of each word in order; no words give an empty array."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def pairs(h: Column) -> Column:
    """One hash for each two words in a row, by the place of the first."""
    return F.when(F.size(h) >= 2, F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))).otherwise(F.array().cast("array<bigint>"))


def short_seed(h: Column, start: Column, n: int) -> Column:
    return F.xxhash64(F.lit(-n), *[F.get(h, start + o) for o in range(n)])


def item_seeds(tests: DataFrame, share: float) -> DataFrame:
    """(item_id, item_hash, mask, first, seed, item_place): seeds of `mask` words offsets, or of -mask words in a row."""
    sized = tests.withColumn("n", F.size("h")).where("n > 0").withColumns({"k": (F.col("n") - F.ceil(F.lit(share) * F.col("n"))).cast("int"), "b": F.expr("int(n div 2)")})
    spaced = F.expr(f"b - k > int((b + {WINDOW - 1}) div {WINDOW})")
    # Block i and the mask-th one after it, in the same window.
    two = sized.where(spaced).withColumn("p", pairs(F.col("h"))).select("*", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("i"))
    two = two.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(MASKS)))).alias("mask")).where(f"i + mask < b and i % {WINDOW} + mask < {WINDOW}")
    first, second = F.get("p", 2 * F.col("i")), F.get("p", 2 * (F.col("i") + F.col("mask")))
    two = two.select("item_id", "item_hash", "mask", first.alias("first"), F.xxhash64("mask", first, second).alias("seed"), (2 * F.col("i")).alias("item_place"))
    one = sized.where(~spaced).select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).withColumn("item_place", F.expr("int(i * n div (k + 1))"))
    one = one.withColumn("words", F.least(F.lit(SHORT), F.expr("int((i + 1) * n div (k + 1))") - F.col("item_place")))
    own = F.coalesce(*[F.when(F.col("words") == m, short_seed(F.col("h"), F.col("item_place"), m)) for m in range(1, SHORT + 1)])
    return two.unionByName(one.select("item_id", "item_hash", (-F.col("words")).alias("mask"), F.lit(None).cast("long").alias("first"), own.alias("seed"), "item_place"))


def masked_runs(rows: DataFrame, keep: list[str], first: DataFrame) -> DataFrame:
    """(keep..., seed, place) of every masked run of rows with column `h` that begins like a seed."""
    reach = [2 * (m + 1) for m in range(len(MASKS))]
    paired = computed_once(rows, p=pairs(F.col("h"))).where(F.size("p") > 0)
    at = F.transform("p", lambda x, i: F.struct(i.alias("place"), x.alias("first"), F.array(*[F.get("p", i + o) for o in reach]).alias("second")))
    placed = paired.select(*keep, F.explode(at).alias("r")).select(*keep, "r.*").join(first, "first")
    masked = placed.select(*keep, "place", "first", F.posexplode("second").alias("mask", "other")).where("other is not null")
    return masked.select(*keep, F.xxhash64(F.col("mask") + 1, "first", "other").alias("seed"), "place")


def short_runs(rows: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """(keep..., seed, place) of every run of so many words at every place of rows with column `h`."""
    def runs(n: int) -> Column:
        at = lambda i: F.struct(short_seed(F.col("h"), i, n).alias("seed"), i.alias("place"))
        last = F.size("h") - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<struct<seed:bigint,place:int>>"))

    return rows.select(*keep, F.explode(F.concat(*[runs(n) for n in lengths])).alias("p")).select(*keep, "p.seed", "p.place")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, start, matched, item_words) of every item found in a document.

    `start` is the place of the item's first word in the document's words, the
    best diagonal's, the smallest among equals. `text_hash` is xxhash64 of the text.
    """
    if not 0 < share <= 1:
        raise ValueError(f"share must be over 0 and at most 1: {share}")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("h")).where("h is not null")
    tests = tests.distinct().withColumn("item_hash", F.xxhash64("h"))
    known = item_seeds(tests, share)
    masks = {r.mask: r["count"] for r in known.groupBy("mask").count().collect()}
    bounded = sum(masks.values()) <= BROADCAST_ROWS
    at_hand = F.broadcast if bounded else lambda df: df
    seeds = at_hand(known.select("seed", "item_id", "item_hash", "item_place"))
    keep = ["doc_id", "text_hash"]
    read = computed_once(source, h=word_hashes(F.col("text"))).select(*keep, "h")
    met = masked_runs(read, keep, at_hand(known.where("mask > 0").select("first").distinct())).join(seeds, "seed")
    if lengths := sorted(-m for m in masks if m < 0):
        met = met.unionByName(short_runs(read, keep, lengths).join(seeds, "seed"))
    # All diagonals of an item in a document are one row, so that a text goes along once for each of its items.
    met = met.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("starts"))
    words = source.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "text")
    items = tests.select(F.col("item_id").alias("i"), F.col("item_hash").alias("ih"), F.col("h").alias("item_h"))
    # Identical rows are one: only the documents met are read again.
    back = met.join(items, F.expr("item_id <=> i and item_hash = ih")).join(words, F.expr("doc_id <=> d and text_hash = t"))
    both = computed_once(back, doc_h=word_hashes(F.col("text")))

    def on(start: Column) -> Column:
        agree = lambda x, j: x == F.get(F.col("doc_h"), F.when(start + j >= 0, start + j))
        same = F.size(F.filter(F.transform("item_h", agree), lambda y: y))
        return F.struct((-same).alias("m"), start.alias("s"), F.size("item_h").alias("w"))

    found = both.select("doc_id", "text_hash", "item_id", F.array_min(F.transform("starts", on)).alias("b"))
    found = found.where(-F.col("b.m") >= F.ceil(F.lit(share) * F.col("b.w"))).groupBy("doc_id", "text_hash", "item_id").agg(F.min("b").alias("b"))
    return found.select("doc_id", "text_hash", "item_id", F.col("b.s").alias("start"), (-F.col("b.m")).alias("matched"), F.col("b.w").alias("item_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows, all columns as they are, of documents that hold no item."""
    hits = contaminated(docs, benchmark, share).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    same = F.col("whole.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(F.col("whole.text").cast("string")) == F.col("t"))
    return whole.join(hits, same, "left_anti").select("whole.*")
