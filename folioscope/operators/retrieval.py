"""Keyword and vector search with rank fusion.

Three ways to the keyword ranking: `keyword_scores` scans the chunks, counting
the query's own terms inside each row, `postings_scores` reads the query's terms
from a postings table, and `indexed_leg` ranks from a stored index, where bounds
of whole zones leave most postings unread. All give the same scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as tx, vectors as vx
from ..functions.staging import computed_once
from ..session import cut_lineage
from ..sources.search_index import Index

# Ranking constants and closeness bands.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
STRONG, RELATED = 0.70, 0.88
FOCUS_BOOST = 1.5
COLLECTION_WEIGHT = {"threads": 0.6}
SNIPPET = 300

RESULT_SCHEMA = ("library string, id bigint, path string, collection string, heading string, start_line int, "
                 "end_line int, score double, bm25_rank int, vector_rank int, distance double, closeness string, "
                 "snippet string")


def query_phrases(spark: SparkSession, query: str) -> list[list[str]]:
    """The query as an OR of phrases: one per whitespace word, each a list of terms.

    The same column expression that tokenises the corpus tokenises the query.
    """
    bare = F.replace(F.lit(query), F.lit('"'), F.lit(""))
    row = spark.range(1).select(F.transform(tx.words(tx.cjk_bigrams(bare)), tx.search_tokens).alias("p")).first()
    return [list(p) for p in row["p"] if p]


def _phrase_count(flat: Column, phrase: Sequence[str]) -> Column:
    """Positions of the phrase in the index form, overlapping ones too."""
    return F.regexp_count(flat, F.lit(f" (?={' '.join(phrase)} )"))


def _bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def keyword_scores(chunks: DataFrame, query: str) -> DataFrame:
    """BM25 score of every matching chunk: library, id, collection, path, score.

    One narrow pass over the texts counts the query's terms per chunk. Its rows
    of numbers, a few percent of the text's size, are stored, because both the
    library statistics and the scores read them; the text is scanned once.
    """
    phrases = query_phrases(chunks.sparkSession, query)
    keep = [c for c in ("library", "id", "collection", "path") if c in chunks.columns]
    if not phrases:
        return chunks.select(*keep, F.lit(0.0).alias("score")).limit(0)
    flat = computed_once(chunks.select(*keep, "content"), _flat=tx.search_text(F.col("content"))).drop("content")
    names = [f"_tf{i}" for i in range(len(phrases))]
    length = F.length("_flat") - F.length(F.replace("_flat", F.lit(" "))) - 1
    counted = computed_once(flat, _dl=length.cast("double"), **{
        n: _phrase_count(F.col("_flat"), p).cast("double") for p, n in zip(phrases, names)}).drop("_flat")
    counted = cut_lineage(counted)
    stats = counted.groupBy("library").agg(
        F.count("*").cast("double").alias("_n"), F.avg("_dl").alias("_avgdl"),
        *[F.count_if(F.col(n) > 0).cast("double").alias(n.replace("tf", "df")) for n in names])
    hits = counted.filter(reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names]))
    parts = [_bm25(F.col(n), F.col(n.replace("tf", "df")), F.col("_n"), F.col("_dl"), F.col("_avgdl")) for n in names]
    return hits.join(stats, "library").select(*keep, reduce(lambda a, b: a + b, parts).alias("score"))


def postings(chunks: DataFrame) -> DataFrame:
    """Term index: term, library, id, tf, dl, positions. One explode, one shuffle by (term, chunk)."""
    tokens = chunks.select("library", "id", tx.search_tokens(F.col("content")).alias("_t"))
    rows = tokens.select("library", "id", F.size("_t").alias("dl"), F.posexplode("_t").alias("pos", "term"))
    return rows.groupBy("term", "library", "id").agg(
        F.count("*").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("positions"))


def library_stats(chunks: DataFrame) -> DataFrame:
    """Chunk count and mean length per library, kept beside the postings."""
    return chunks.groupBy("library").agg(F.count("*").alias("n"), F.avg(F.size(tx.search_tokens(F.col("content")))).alias("avgdl"))


def postings_scores(index: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """The same scores from the postings table, of which the query's terms are read once."""
    spark = index.sparkSession
    phrases, found = query_phrases(spark, query), []
    if phrases:
        # Every phrase and the statistics read these rows; postings made on the fly would be made again for each.
        index = cut_lineage(index.filter(F.col("term").isin(sorted({t for p in phrases for t in p}))))
    for number, phrase in enumerate(phrases):
        first = index.filter(F.col("term") == phrase[0]).select("library", "id", "dl", "positions")
        for offset, term in enumerate(phrase[1:], 1):
            nxt = index.filter(F.col("term") == term).select(
                "library", "id", F.transform("positions", lambda p: p - offset).alias("_p"))
            first = first.join(nxt, ["library", "id"]).withColumn("positions", F.array_intersect("positions", "_p")).drop("_p")
        found.append(first.filter(F.size("positions") > 0)
                     .select("library", "id", F.size("positions").alias("tf"), "dl", F.lit(number).alias("phrase")))
    if not found:
        return index.select("library", "id", F.lit(0.0).alias("score")).limit(0)
    hits = reduce(DataFrame.unionByName, found)
    spread = hits.groupBy("library", "phrase").agg(F.count("*").alias("df"))
    scored = hits.join(spread, ["library", "phrase"]).join(stats, "library").withColumn(
        "part", _bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl")))
    return scored.groupBy("library", "id").agg(F.sum("part").alias("score"))


def scope_filter(df: DataFrame, collection: str | None = None, path: str | None = None) -> DataFrame:
    """Collection equality and path glob."""
    if collection:
        df = df.filter(F.col("collection") == collection)
    if path:
        df = df.filter(F.col("path").rlike(tx.glob_to_regex(path)))
    return df


def ranked(df: DataFrame, n: int, order: Sequence[Column], name: str) -> DataFrame:
    """1-based rank within each library, best `n` kept; the cut happens before the shuffle."""
    rank = F.row_number().over(W.partitionBy("library").orderBy(*order, F.col("id")))
    return df.withColumn(name, rank).filter(F.col(name) <= n)


def keyword_leg(chunks: DataFrame, query: str, n: int, collection: str | None = None, path: str | None = None) -> DataFrame:
    """Rank by score; the filters come before the cut, the statistics are the whole library's."""
    scores = scope_filter(keyword_scores(chunks, query), collection, path)
    return ranked(scores, n, [F.col("score").desc()], "bm25_rank").drop("score")


def _phrase_blocks(index: Index, phrase: Sequence[str], number: int) -> DataFrame:
    """Block rows of a phrase of several words, as `Index.postings` has them for a word."""
    keys = ["segment", "library", "zone", "id"]
    rows = index.postings(sorted(set(phrase)))
    at = lambda term: rows.where(F.col("term") == term).select("segment", "library", "zone", F.explode("docs").alias("d")).select("segment", "library", "zone", "d.*")
    found = at(phrase[0]).select(*keys, "dl", "positions")
    for offset, term in enumerate(phrase[1:], 1):
        nxt = at(term).select(*keys, F.transform("positions", lambda p: p - offset).alias("_p"))
        found = found.join(nxt, keys).withColumn("positions", F.array_intersect("positions", "_p")).drop("_p").where(F.size("positions") > 0)
    docs = F.collect_list(F.struct("id", "dl", F.size("positions").cast("long").alias("tf")))
    blocks = index.live(found).groupBy("segment", "library", "zone").agg(docs.alias("docs"), F.max(F.size("positions")).cast("long").alias("max_tf"), F.min("dl").alias("min_dl"), F.count("*").alias("n"))
    # Rows of a rare thing, which statistics, bounds and scores all read.
    return cut_lineage(blocks.withColumn("phrase", F.lit(number)))


def indexed_leg(index: Index, query: str, n: int, collection: str | None = None, path: str | None = None) -> DataFrame:
    """The best `n` of each library by BM25: segment, zone, library, id, score.

    The bounds of a zone's posting rows add up to a bound of every score in it.
    The `n` zones with the largest bounds are scored; the n-th best score found
    is a floor, and only zones whose bound reaches it are scored beside them.
    Exact: what is left unread cannot be among the best. Filters come before
    the cut; the statistics are the whole library's.
    """
    phrases = query_phrases(index.spark, query)
    if not phrases:
        return index.places().select("segment", "zone", "library", "id", F.lit(0.0).alias("score"), F.lit(0).alias("bm25_rank")).limit(0)
    columns = ["phrase", "segment", "library", "zone", "docs", "max_tf", "min_dl", "n"]
    words = [(i, p[0]) for i, p in enumerate(phrases) if len(p) == 1]
    terms = sorted({w for _, w in words})
    numbers = F.broadcast(index.spark.createDataFrame(words, "phrase int, term string"))
    single = index.postings(terms).join(numbers, "term").withColumn("docs", F.transform("docs", lambda d: F.struct(d["id"].alias("id"), d["dl"].alias("dl"), d["tf"].alias("tf"))))
    blocks = reduce(DataFrame.unionByName, [single.select(*columns), *[_phrase_blocks(index, p, i).select(*columns) for i, p in enumerate(phrases) if len(p) > 1]])
    less = index.less(terms).join(numbers, "term").select("phrase", "library", (-F.col("less")).alias("n"))
    spread = blocks.select("phrase", "library", "n").unionByName(less).groupBy("phrase", "library").agg(F.sum("n").cast("double").alias("df"))
    known = cut_lineage(spread.where("df > 0").join(index.stats().withColumnRenamed("n", "all"), "library"))
    bound = _bm25(F.col("max_tf"), F.col("df"), F.col("all"), F.col("min_dl"), F.col("avgdl"))
    zones = blocks.drop("docs").join(known, ["phrase", "library"]).groupBy("segment", "library", "zone").agg(F.sum(bound).alias("bound"))
    zones = cut_lineage(zones)
    places = scope_filter(index.places(), collection, path).select("segment", "library", "id") if collection or path else None

    def scored(wanted: DataFrame) -> DataFrame:
        rows = blocks.join(wanted.select("segment", "library", "zone"), ["segment", "library", "zone"], "left_semi")
        docs = rows.select("phrase", "segment", "library", "zone", F.explode("docs").alias("d")).select("phrase", "segment", "library", "zone", "d.*")
        docs = index.live(docs)
        if places is not None:
            docs = docs.join(places, ["segment", "library", "id"], "left_semi")
        part = _bm25(F.col("tf"), F.col("df"), F.col("all"), F.col("dl"), F.col("avgdl"))
        return docs.join(known, ["phrase", "library"]).groupBy("segment", "zone", "library", "id").agg(F.sum(part).alias("score"))

    by_bound = F.row_number().over(W.partitionBy("library").orderBy(F.col("bound").desc(), "segment", "zone"))
    first = zones.withColumn("_r", by_bound).where(F.col("_r") <= n)
    floor = ranked(scored(first), n, [F.col("score").desc()], "_r").where(F.col("_r") == n).select("library", F.col("score").alias("floor"))
    reach = zones.join(floor, "library", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-9))
    return ranked(scored(reach), n, [F.col("score").desc()], "bm25_rank")


def search_index(index: Index, query: str, vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None,
                 mode: str = "hybrid", k: int = 8, collection: str | None = None, path: str | None = None, focus: DataFrame | None = None) -> DataFrame:
    """`search` from a stored index: no text is read but that of the k hits."""
    n, spots = max(3 * k, 20), ["segment", "zone", "library", "id"]
    places = index.places()
    keyed = indexed_leg(index, query, n, collection, path).join(places.select(*spots, "path", "collection"), spots).drop("score") if mode in ("hybrid", "bm25") else None
    near = None
    if mode in ("hybrid", "vector") and vectors is not None and query_vector is not None:
        near = vector_leg(places, vectors, query_vector, n, collection, path).join(places.select(*spots, "path", "collection"), ["library", "id"])
    if keyed is None and near is None:
        return empty_result(index.spark)
    # The k hits are the answer itself; their zones say which parts of the texts to read.
    top = _fused(keyed, near, k, collection, focus, spots).collect()
    if not top:
        return empty_result(index.spark)
    held = index.spark.createDataFrame(top, "segment int, zone long, library string, id long, _score double, bm25_rank int, vector_rank int, distance double")
    at = places.where(F.col("zone").isin(sorted({h.zone for h in top})) & F.col("id").isin(sorted({h.id for h in top})))
    hits = F.broadcast(held).join(at.drop("zone"), ["segment", "library", "id"]).join(index.texts_of(top), ["segment", "library", "id"])
    return _shown(hits)


def vector_leg(chunks: DataFrame, vectors: DataFrame, query_vector: Sequence[float], n: int,
               collection: str | None = None, path: str | None = None) -> DataFrame:
    """Nearest by distance. The cut to `n` comes first and the filters second, so fewer may remain."""
    near = vectors.filter(F.size("embedding") == len(query_vector)).select(
        "library", "id", vx.l2_to(F.col("embedding"), query_vector).alias("distance"))
    top = ranked(near, n, [F.col("distance")], "_near")
    if collection or path:
        top = top.join(scope_filter(chunks, collection, path).select("library", "id"), ["library", "id"], "left_semi")
    again = F.row_number().over(W.partitionBy("library").orderBy("_near"))
    return top.select("library", "id", "distance", again.alias("vector_rank"))


def closeness(distance: Column) -> Column:
    """strong, related or weak; null without a distance."""
    return F.when(distance <= STRONG, "strong").when(distance <= RELATED, "related").when(distance.isNotNull(), "weak")


def fusion_score(*ranks: Column) -> Column:
    """Reciprocal rank fusion of any number of legs."""
    return reduce(lambda a, b: a + b, [F.coalesce(1.0 / (RRF_K + r), F.lit(0.0)) for r in ranks])


def collection_weight(collection: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in COLLECTION_WEIGHT.items():
        out = F.when(collection == name, weight).otherwise(out)
    return out


def snippet(content: Column) -> Column:
    return F.substring(tx.squash(content), 1, SNIPPET)


def search_scope(libraries: DataFrame, scope: str = "auto", library: str | None = None) -> DataFrame:
    """Libraries a search reads. `libraries`: library, enabled, indexed, companion.

    The local library is called `local`. Where companions are named, only they
    are read beside it. auto means the local one and the named companions.
    """
    usable = libraries.filter(F.col("indexed") & (F.col("enabled") | (F.col("library") == "local")))
    if library:
        return usable.filter(F.col("library") == library).select("library")
    local, companion = F.col("library") == "local", F.coalesce("companion", F.lit(False))
    if scope == "local":
        return usable.filter(local).select("library")
    if scope == "auto":
        return usable.filter(local | companion).select("library")
    named = F.coalesce(libraries.agg(F.bool_or(F.coalesce("companion", F.lit(False)))).scalar(), F.lit(False))
    others = ~local & (companion | ~named)
    return usable.filter(others if scope == "global" else local | others).select("library")


def skipped_libraries(libraries: DataFrame) -> DataFrame:
    """Libraries that no search reads, and why: library, reason."""
    reason = F.when(~F.col("indexed"), "no index").when(~F.col("enabled") & (F.col("library") != "local"), "disabled")
    return libraries.select("library", reason.alias("reason")).filter(F.col("reason").isNotNull())


def searchable_libraries(libraries: DataFrame, exclude: str | None = None) -> DataFrame:
    """Enabled libraries that have an index, minus the current one."""
    out = libraries.filter(F.col("enabled") & F.col("indexed"))
    return out.filter(F.col("library") != exclude) if exclude else out


def search(chunks: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None,
           mode: str = "hybrid", k: int = 8, collection: str | None = None, path: str | None = None,
           focus: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Fused top-k. `chunks`: library, id, path, collection, heading, start_line, end_line, content.

    Without vectors a hybrid search answers from keywords alone. `focus` is a
    table of paths of the local library that are boosted. `scope` restricts the
    libraries. Text is fetched for the k hits only.
    """
    if scope is not None:
        chunks = chunks.join(scope, "library", "left_semi")
        vectors = vectors.join(scope, "library", "left_semi") if vectors is not None else None
    n = max(3 * k, 20)
    keyed = keyword_leg(chunks, query, n, collection, path) if mode in ("hybrid", "bm25") else None
    near = None
    if mode in ("hybrid", "vector") and vectors is not None and query_vector is not None:
        # The leg is cut before it meets the chunks, so this join has a few rows per library on one side.
        near = vector_leg(chunks, vectors, query_vector, n, collection, path) \
            .join(chunks.select("library", "id", "path", "collection"), ["library", "id"])
    if keyed is None and near is None:
        return empty_result(chunks.sparkSession)
    top = _fused(keyed, near, k, collection, focus, ["library", "id"])
    hits = top.join(chunks.select("library", "id", "path", "collection", "heading", "start_line", "end_line", "content"), ["library", "id"])
    return _shown(hits)


def _fused(keyed: DataFrame | None, near: DataFrame | None, k: int, collection: str | None, focus: DataFrame | None, keys: list[str]) -> DataFrame:
    """The best k of one or two legs: keys, _score, bm25_rank, vector_rank, distance."""
    if keyed is None:
        fused = near.withColumn("bm25_rank", F.lit(None).cast("int"))
    elif near is None:
        fused = keyed.withColumn("vector_rank", F.lit(None).cast("int")).withColumn("distance", F.lit(None).cast("double"))
    else:
        known = near.select(*keys, "vector_rank", "distance", F.col("path").alias("_p"), F.col("collection").alias("_c"))
        fused = keyed.join(known, keys, "full_outer").withColumn("path", F.coalesce("path", "_p")) \
            .withColumn("collection", F.coalesce("collection", "_c")).drop("_p", "_c")
    weight = F.lit(1.0) if collection else collection_weight(F.col("collection"))
    if focus is not None:
        paths = focus.select("path").distinct().withColumn("_hit", F.lit(True))
        fused = fused.join(paths, "path", "left")
        weight = weight * F.when((F.col("library") == "local") & F.col("_hit"), FOCUS_BOOST).otherwise(1.0)
    score = fusion_score(F.col("bm25_rank"), F.col("vector_rank")) * weight
    return fused.withColumn("_score", score).orderBy(F.col("_score").desc(), "library", "id").limit(k) \
        .select(*keys, "_score", "bm25_rank", "vector_rank", "distance")


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("library", "id", "path", "collection", "heading", "start_line", "end_line",
                       F.round("_score", 5).alias("score"), "bm25_rank", "vector_rank",
                       F.round("distance", 4).alias("distance"), closeness(F.col("distance")).alias("closeness"),
                       snippet(F.col("content")).alias("snippet")) \
        .orderBy(F.col("score").desc(), "library", "id")


def search_report(chunks: DataFrame, query: str, vectors: DataFrame | None = None,
                  query_vector: Sequence[float] | None = None, mode: str = "hybrid", k: int = 8) -> DataFrame:
    """One row about the legs: hit counts, whether vectors were used or missing, best distance, weak flag."""
    n = max(3 * k, 20)
    spark = chunks.sparkSession
    wants, has = mode in ("hybrid", "vector"), vectors is not None and query_vector is not None
    rows = []
    if mode in ("hybrid", "bm25"):
        rows.append(keyword_leg(chunks, query, n).select(F.lit("bm25").alias("leg"), F.lit(None).cast("double").alias("distance")))
    if wants and has:
        rows.append(vector_leg(chunks, vectors, query_vector, n).select(F.lit("vector").alias("leg"), "distance"))
    hits = reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], "leg string, distance double")
    return hits.agg(
        F.count_if(F.col("leg") == "bm25").alias("bm25_hits"), F.count_if(F.col("leg") == "vector").alias("vector_hits"),
        F.lit(wants and has).alias("vector_available"), F.lit(wants and not has).alias("vector_degraded"),
        F.round(F.min("distance"), 4).alias("best_distance"),
        F.coalesce(F.min("distance") > RELATED, F.lit(False)).alias("weak_match"))


def empty_result(spark: SparkSession) -> DataFrame:
    """No rows with the full schema: the answer when there is nothing to search."""
    return spark.createDataFrame([], RESULT_SCHEMA)


def grep(docs: DataFrame, pattern: str, ignore_case: bool = False, limit: int = 200, text: str = "text") -> DataFrame:
    """Matching lines with numbers, at most `limit`; `truncated` once the limit is reached."""
    regex = ("(?i)" if ignore_case else "") + pattern
    rows = docs.select("path", F.posexplode(F.split(F.col(text), "\n")).alias("_i", "line_text")) \
        .filter(F.col("line_text").rlike(regex)).select("path", (F.col("_i") + 1).alias("line"), "line_text")
    top = rows.orderBy("path", "line").limit(limit)
    found = F.count("*").over(W.partitionBy(F.lit(0)))
    return top.withColumn("truncated", found >= limit)


def sections_by_matches(sections: DataFrame, query: str, limit: int = 8, samples: int = 3) -> DataFrame:
    """Sections ranked by matching lines, with the first matching lines as samples."""
    wanted = tx.fold_case(tx.strip(F.lit(query)))
    lines = F.split("content", "\n")
    hits = F.filter(F.transform(lines, lambda l, i: F.struct((i + F.col("start_line")).alias("line"), tx.strip(l).alias("text"))),
                    lambda s: F.contains(tx.fold_case(s["text"]), wanted))
    # Only sections that hold the text at all are read line by line, and once. A match stands inside one line.
    likely = computed_once(sections, _folded=tx.fold_case(F.col("content"))).filter(F.contains("_folded", wanted)).drop("_folded")
    return computed_once(likely, _h=hits).withColumn("match_count", F.size("_h")).filter(F.col("match_count") > 0) \
        .withColumn("matches", F.slice("_h", 1, samples)).drop("_h", "content") \
        .orderBy(F.col("match_count").desc(), "path", "start_line").limit(limit)
