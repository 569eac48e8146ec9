"""Search, similarity and claim queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import identifiers as ids, text as tx, vectors as vx
from ..operators import claims as cl, retrieval as rt, similarity as sm
from ..sources import search_index as si
from ..streaming.jobs import new_root
from .registry import query
from .tables import Tables

QUESTION = "the eau enden, que it's über"
FOLD = f"translate(lower({{0}}), '{tx.DIACRITICS}', '{tx.PLAIN}')"


def _tokens(column: str) -> str:
    flat = f"trim(regexp_replace({FOLD.format(column)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"CASE WHEN {flat} = '' THEN [] ELSE string_split({flat}, ' ') END"


PIECES = f"""
pieces AS (
  SELECT library, id AS doc, path, collection, p AS start_line, least(p + 249, len(l)) AS end_line,
    regexp_replace(array_to_string(l[p : p + 249], chr(10)), '^\\s+|\\s+$', '', 'g') AS content
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM chunk_rows), unnest(range(1, len(l) + 1, 250)) AS u(p)),
chunks AS (SELECT *, doc * 1000000 + start_line AS id, {_tokens('content')} AS t FROM pieces WHERE content <> '')"""

# one row per query phrase: the, eau, enden, que, it s, uber
BM25 = f"""{PIECES},
stats AS (SELECT library, count(*) AS n, avg(len(t)) AS avgdl FROM chunks GROUP BY library),
phrases AS (SELECT * FROM (VALUES (1, ['the']), (2, ['eau']), (3, ['enden']), (4, ['que']), (5, ['it', 's']), (6, ['uber'])) v(k, words)),
tf AS (SELECT c.library, c.id, c.collection, c.path, k, len(c.t) AS dl,
    CASE WHEN len(words) = 1 THEN len(list_filter(c.t, lambda x: x = words[1]))
      ELSE len(list_filter(range(1, len(c.t)), lambda i: c.t[i] = words[1] AND c.t[i + 1] = words[2])) END AS tf
  FROM chunks c, phrases),
hits AS (SELECT *, count(*) OVER (PARTITION BY library, k) AS df FROM tf WHERE tf > 0),
bm25 AS (SELECT library, id, any_value(collection) AS collection, any_value(path) AS path,
    sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM hits JOIN stats USING (library) GROUP BY library, id)"""


@query("S14 C1 C2 C3 W1 F2", f"""WITH {BM25},
ranked AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY score DESC, id) AS r FROM bm25)
SELECT library, id, round(score, 6) AS score, CAST(r AS INT) AS bm25_rank FROM ranked WHERE r <= 24""")
def keyword_search(t: Tables) -> DataFrame:
    return rt.indexed_leg(t.search_index, QUESTION, 24).select("library", "id", F.round("score", 6).alias("score"), "bm25_rank")


@query("C1 C2 C3 W1", f"""WITH {BM25},
ranked AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY score DESC, id) AS r FROM bm25)
SELECT library, id, round(score, 6) AS score, CAST(r AS INT) AS bm25_rank FROM ranked WHERE r <= 24""")
def keyword_search_by_scan(t: Tables) -> DataFrame:
    scores = rt.keyword_scores(t.chunks, QUESTION)
    return rt.ranked(scores, 24, [F.col("score").desc()], "bm25_rank").select("library", "id", F.round("score", 6).alias("score"), "bm25_rank")


@query("S14 C3", f"""WITH {BM25} SELECT library, id, round(score, 6) AS score FROM bm25""")
def keyword_search_from_postings(t: Tables) -> DataFrame:
    chunks = t.chunks.select("library", "id", "content")
    found = rt.postings_scores(rt.postings(chunks), rt.library_stats(chunks), QUESTION)
    return found.select("library", "id", F.round("score", 6).alias("score"))


@query("S14", f"""WITH {PIECES} SELECT library, term, count(*) AS chunks, CAST(sum(tf) AS BIGINT) AS occurrences FROM (
  SELECT library, id, unnest(t) AS term, 1 AS tf FROM chunks) x GROUP BY library, term""".replace("count(*)", "count(DISTINCT id)"))
def term_spread(t: Tables) -> DataFrame:
    # Texts are dealt by chunk, less than their postings would be: a task then has a chunk's postings whole, and only counts of terms leave it.
    chunks = t.chunks.select("library", "id", "content").repartition("library", "id")
    return rt.postings(chunks).groupBy("library", "term").agg(
        F.count("*").alias("chunks"), F.sum("tf").alias("occurrences"))


TOP = f"""WITH {BM25},
leg AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY score DESC, id) AS r FROM bm25 %WHERE%),
fused AS (SELECT library, id, path, collection, CAST(r AS INT) AS bm25_rank, 1.0 / (60 + r) * CASE WHEN collection = 'threads' THEN %WEIGHT% ELSE 1.0 END AS s FROM leg WHERE r <= 24),
best AS (SELECT * FROM fused ORDER BY s DESC, library, id LIMIT 8)
SELECT b.library, b.id, b.path, b.collection, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, round(s, 5) AS score, bm25_rank,
  substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 300) AS snippet FROM best b JOIN chunks c USING (library, id)"""


@query("S14 T1 C4 C5 C8 U1 X8", TOP.replace("%WHERE%", "").replace("%WEIGHT%", "0.6"))
def search_without_vectors(t: Tables) -> DataFrame:
    return rt.search_index(t.search_index, QUESTION, mode="hybrid", k=8).select(
        "library", "id", "path", "collection", "start_line", "end_line", "score", "bm25_rank", "snippet")


@query("S14 ST1 T1", TOP.replace("%WHERE%", "").replace("%WEIGHT%", "0.6"))
def search_after_changes(t: Tables) -> DataFrame:
    """Deltas instead of a rebuild: documents come late, others are replaced, one segment after another."""
    doc = F.floor(F.col("id") / 1_000_000)
    old = t.chunks.where(doc % 3 != 0).withColumn("content", F.when(doc % 5 == 0, F.concat(F.lit("que stale "), "content")).otherwise(F.col("content")))
    index = si.write_index(old, new_root(t.spark, "search"), buckets=8)
    index = si.add_segment(index, t.chunks.where(doc % 3 == 0), t.chunks.limit(0))
    changed = t.chunks.where((doc % 5 == 0) & (doc % 3 != 0))
    index = si.add_segment(index, changed, changed)
    return rt.search_index(index, QUESTION, mode="hybrid", k=8).select(
        "library", "id", "path", "collection", "start_line", "end_line", "score", "bm25_rank", "snippet")


@query("F2 C5", TOP.replace("%WHERE%", "WHERE collection = 'threads' AND path LIKE 'fr/doc-%5%.md'").replace("%WEIGHT%", "1.0"))
def search_in_collection(t: Tables) -> DataFrame:
    return rt.search_index(t.search_index, QUESTION, mode="bm25", k=8, collection="threads", path="fr/doc-*5*.md").select(
        "library", "id", "path", "collection", "start_line", "end_line", "score", "bm25_rank", "snippet")


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.concat(F.lit("lib"), (F.col("vec_id") % 4).cast("string")).alias("library"), F.col("vec_id").alias("id"), "embedding",
                               F.col("label").cast("string").alias("collection"))


def _query_vector(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.filter(F.col("vec_id") == 7).select("embedding").first()[0]]


NEAR = """
q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 7),
d AS (SELECT 'lib' || CAST(vec_id % 4 AS STRING) AS library, vec_id AS id, label,
  sqrt(list_sum(list_transform(list_zip(embedding, qv), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS distance
  FROM embeddings, q),
near AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY distance, id) AS r FROM d)"""


@query("C6 C7 W1", f"""WITH {NEAR} SELECT library, id, CAST(r AS INT) AS vector_rank, round(distance, 4) AS distance,
  CASE WHEN distance <= 0.70 THEN 'strong' WHEN distance <= 0.88 THEN 'related' ELSE 'weak' END AS closeness FROM near WHERE r <= 24""")
def vector_search(t: Tables) -> DataFrame:
    vec = _vectors(t)
    leg = rt.vector_leg(vec, vec, _query_vector(t), 24)
    return leg.select("library", "id", "vector_rank", F.round("distance", 4).alias("distance"), rt.closeness(F.col("distance")).alias("closeness"))


@query("C6", f"""WITH {NEAR} SELECT library, id, CAST(row_number() OVER (PARTITION BY library ORDER BY r) AS INT) AS vector_rank, round(distance, 4) AS distance
  FROM near WHERE r <= 24 AND label = 3""")
def vector_search_filtered_after(t: Tables) -> DataFrame:
    vec = _vectors(t).withColumn("path", F.lit(""))
    return rt.vector_leg(vec, vec, _query_vector(t), 24, collection="3").select("library", "id", "vector_rank", F.round("distance", 4).alias("distance"))


HYBRID = f"""
lab AS (SELECT doc_id, vec_id, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 7),
dist AS (SELECT c.library, c.id, sqrt(list_sum(list_transform(list_zip(embedding, qv), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS distance
  FROM chunks c JOIN lab ON c.doc = lab.doc_id, q),
vleg AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY distance, id) AS vr FROM dist),
kleg AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY score DESC, id) AS kr FROM bm25)"""


def _hybrid(t: Tables, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    chunks = t.chunks if chunks is None else chunks
    vec = t.embeddings.select(F.col("vec_id"), "embedding")
    vectors = chunks.select("library", "id").join(vec, F.floor(F.col("id") / 1_000_000) == F.col("vec_id")).select("library", "id", "embedding")
    return chunks, vectors, _query_vector(t)


@query("C4 C5 C7 C8 T1 U1 J20", f"""WITH {BM25}, {HYBRID},
merged AS (SELECT coalesce(k.library, v.library) AS library, coalesce(k.id, v.id) AS id, kr, vr, distance
  FROM (SELECT * FROM kleg WHERE kr <= 36) k FULL JOIN (SELECT * FROM vleg WHERE vr <= 36) v ON k.library = v.library AND k.id = v.id),
scored AS (SELECT m.*, c.path, c.collection, (coalesce(1.0 / (60 + kr), 0) + coalesce(1.0 / (60 + vr), 0)) * CASE WHEN c.collection = 'threads' THEN 0.6 ELSE 1.0 END AS s
  FROM merged m JOIN chunks c ON c.library = m.library AND c.id = m.id)
SELECT library, id, path, collection, round(s, 5) AS score, CAST(kr AS INT) AS bm25_rank, CAST(vr AS INT) AS vector_rank, round(distance, 4) AS distance,
  CASE WHEN distance <= 0.70 THEN 'strong' WHEN distance <= 0.88 THEN 'related' WHEN distance IS NOT NULL THEN 'weak' END AS closeness
FROM scored ORDER BY s DESC, library, id LIMIT 12""")
def hybrid_search(t: Tables) -> DataFrame:
    _, vectors, vector = _hybrid(t, t.search_index.places())
    return rt.search_index(t.search_index, QUESTION, vectors, vector, k=12).select(
        "library", "id", "path", "collection", "score", "bm25_rank", "vector_rank", "distance", "closeness")


@query("J20 C5", f"""WITH {BM25},
leg AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY score DESC, id) AS r FROM (SELECT * REPLACE (CASE library WHEN 'src3' THEN 'local' ELSE library END AS library) FROM bm25)),
fused AS (SELECT *, 1.0 / (60 + r) * CASE WHEN collection = 'threads' THEN 0.6 ELSE 1.0 END * CASE WHEN library = 'local' AND collection = 'de' THEN 1.5 ELSE 1.0 END AS s FROM leg WHERE r <= 24)
SELECT library, id, round(s, 5) AS score FROM fused ORDER BY s DESC, library, id LIMIT 8""")
def search_with_focus(t: Tables) -> DataFrame:
    chunks = t.chunks.withColumn("library", F.when(F.col("library") == "src3", "local").otherwise(F.col("library")))
    focus = chunks.filter(F.col("collection") == "de").select("path")
    return rt.search(chunks, QUESTION, mode="bm25", k=8, focus=focus).select("library", "id", "score")


@query("X8 C8", f"""WITH {BM25}, {HYBRID}
SELECT (SELECT count(*) FROM kleg WHERE kr <= 24) AS bm25_hits, (SELECT count(*) FROM vleg WHERE vr <= 24) AS vector_hits, true AS vector_available, false AS vector_degraded,
  (SELECT round(min(distance), 4) FROM vleg) AS best_distance, (SELECT min(distance) > 0.88 FROM vleg) AS weak_match""")
def search_leg_report(t: Tables) -> DataFrame:
    chunks, vectors, vector = _hybrid(t)
    return rt.search_report(chunks, QUESTION, vectors, vector)


LIBRARIES = "libs AS (SELECT CASE source WHEN 'src0' THEN 'local' ELSE source END AS library, count(*) % 2 = 0 OR source = 'src0' AS enabled, count(*) > 2 AS indexed, source IN ('src1', 'src2', 'src3') AS companion FROM documents GROUP BY source)"


def _libraries(t: Tables) -> DataFrame:
    source = F.col("source")
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).select(
        F.when(source == "src0", "local").otherwise(source).alias("library"), ((F.col("n") % 2 == 0) | (source == "src0")).alias("enabled"),
        (F.col("n") > 2).alias("indexed"), source.isin("src1", "src2", "src3").alias("companion"))


@query("F17 S20", f"""WITH {LIBRARIES}, u AS (SELECT * FROM libs WHERE indexed AND (enabled OR library = 'local'))
SELECT 'global' AS scope, library FROM u WHERE library <> 'local' AND companion
UNION ALL SELECT 'global, none named', library FROM u WHERE library <> 'local'
UNION ALL SELECT 'all', library FROM u WHERE library = 'local' OR companion
UNION ALL SELECT 'local', library FROM u WHERE library = 'local'
UNION ALL SELECT 'auto', library FROM u WHERE library = 'local' OR companion
UNION ALL SELECT 'auto, none named', library FROM u WHERE library = 'local'
UNION ALL SELECT 'searchable', library FROM libs WHERE indexed AND enabled AND library <> 'local'
UNION ALL SELECT CASE WHEN NOT indexed THEN 'no index' ELSE 'disabled' END, library FROM libs WHERE NOT indexed OR (NOT enabled AND library <> 'local')""")
def search_scopes(t: Tables) -> DataFrame:
    libs = _libraries(t)
    alone = libs.withColumn("companion", F.lit(False))
    parts = [rt.search_scope(libs, s).select(F.lit(s).alias("scope"), "library") for s in ("global", "all", "local", "auto")]
    parts += [rt.search_scope(alone, s).select(F.lit(f"{s}, none named").alias("scope"), "library") for s in ("global", "auto")]
    parts.append(rt.searchable_libraries(libs, "local").select(F.lit("searchable").alias("scope"), "library"))
    parts.append(rt.skipped_libraries(libs).select(F.col("reason").alias("scope"), "library"))
    return reduce(DataFrame.unionByName, parts)


@query("F19", "SELECT source AS library, doc_id AS id FROM documents WHERE false")
def nothing_to_search(t: Tables) -> DataFrame:
    return rt.search(t.chunks.filter(F.col("library") == "no such library"), "", mode="vector").select("library", "id")


@query("F6", """WITH l AS (SELECT path, generate_subscripts(lines, 1) AS line, unnest(lines) AS line_text FROM (SELECT path, string_split(text, chr(10)) AS lines FROM chunk_rows)),
h AS (SELECT * FROM l WHERE regexp_matches(line_text, '(?i)the\\w+ (edst|erti|nicht)') ORDER BY path, line LIMIT 200)
SELECT path, line, line_text, (SELECT count(*) FROM h) >= 200 AS truncated FROM h""")
def grep_lines(t: Tables) -> DataFrame:
    return rt.grep(t.chunk_rows.select("path", "text"), r"the\w+ (edst|erti|nicht)", ignore_case=True).select("path", F.col("line").cast("bigint").alias("line"), "line_text", "truncated")


@query("T8", f"""WITH {PIECES},
l AS (SELECT path, start_line, unnest(string_split(content, chr(10))) AS line FROM pieces)
SELECT path, count(*) AS match_count FROM l WHERE contains(replace(lower(line), 'ß', 'ss'), 'nicht er') GROUP BY path, start_line ORDER BY match_count DESC, path, start_line LIMIT 8""")
def sections_by_matches(t: Tables) -> DataFrame:
    return rt.sections_by_matches(t.chunks, " NICHT er ").select("path", F.col("match_count").cast("bigint").alias("match_count"))


# ------------------------------------------------------------------ similarity

COS = "list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)))"


@query("J10", f"""WITH d AS (SELECT embedding, min(vec_id) AS rep, count(*) AS n, sqrt(list_inner_product(list_transform(any_value(embedding), lambda x: CAST(x AS DOUBLE)), list_transform(any_value(embedding), lambda x: CAST(x AS DOUBLE)))) AS size
  FROM embeddings GROUP BY embedding)
SELECT a.rep AS a, b.rep AS b, round({COS} / (a.size * b.size), 5) AS cosine, a.n * b.n AS pairs FROM d a JOIN d b ON a.rep < b.rep WHERE {COS} / (a.size * b.size) >= 0.35
UNION ALL SELECT rep, rep, 1.0, CAST(n * (n - 1) / 2 AS BIGINT) FROM d WHERE n > 1""")
def similar_pairs(t: Tables) -> DataFrame:
    cards = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return sm.similar_groups(cards, threshold=0.35).select("a", "b", F.round("cosine", 5).alias("cosine"), "pairs")


def _tagged(t: Tables) -> DataFrame:
    label, alias = F.col("label").cast("string"), F.concat(F.lit("Card "), (F.col("vec_id") % 50).cast("string"))
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("card-"), F.col("vec_id").cast("string")).alias("name"),
                               F.array(F.concat(F.lit("T"), label), F.concat(F.lit("m"), (F.col("label") % 3).cast("string"))).alias("tags"),
                               F.when(F.col("vec_id") % 7 == 0, F.array(alias)).otherwise(F.array().cast("array<string>")).alias("aliases"))


BOOSTED = f"""e AS (SELECT vec_id AS id, embedding, 'card ' || CAST(vec_id AS STRING) AS title, 'T' || CAST(label AS STRING) AS t1, 'm' || CAST(label % 3 AS STRING) AS t2,
    CASE WHEN vec_id % 7 = 0 THEN 'card ' || CAST(vec_id % 50 AS STRING) END AS alias FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, {COS} / sqrt(list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)))
      * list_inner_product(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)))) AS cosine,
    CASE WHEN a.alias = b.alias OR a.title = b.alias OR b.title = a.alias THEN 0.10 ELSE 0.05 * ((a.t1 = b.t1)::INT + (a.t2 = b.t2)::INT) END AS boost FROM e a JOIN e b ON a.id < b.id),
s AS (SELECT a, b, least(1.0, cosine + boost) AS score, boost FROM p)"""


@query("J10", f"WITH {BOOSTED} SELECT a, b, round(score, 5) AS score, CAST(round(boost, 2) AS DOUBLE) AS boost FROM s WHERE score >= 0.40")
def similar_cards_with_boosts(t: Tables) -> DataFrame:
    return sm.similar_pairs(_tagged(t), threshold=0.40, pivots=16).select("a", "b", F.round("score", 5).alias("score"), F.round("boost", 2).alias("boost"))


@query("U10")
def merge_plan(t: Tables) -> DataFrame:
    cards = _tagged(t)
    pairs = sm.similar_pairs(cards, threshold=0.45, pivots=16)
    return sm.merge_plan(pairs, cards, threshold=0.45).select("survivor", "merged", F.round("score", 5).alias("score"))


MEANS = """
m AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM embeddings) GROUP BY label, pos),
c AS (SELECT pos, avg(v) AS v FROM m GROUP BY pos), n AS (SELECT sqrt(sum(v * v)) AS size FROM c)"""


@query("A18 X6", f"""WITH {MEANS},
x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(sum(x.v * c.v / n.size) / sqrt(sum(x.v * x.v)), 3) AS score FROM x JOIN c USING (pos), n GROUP BY vec_id""")
def centroid_relevance(t: Tables) -> DataFrame:
    return sm.score_candidates(t.embeddings, t.embeddings.withColumn("path", F.col("label").cast("string"))).select("vec_id", "score")


@query("X6", f"WITH {MEANS} SELECT label, pos, round(v, 6) AS v FROM m")
def mean_vectors(t: Tables) -> DataFrame:
    return sm.mean_vector(t.embeddings, ["label"]).select("label", F.posexplode("embedding").alias("p", "v")) \
        .select("label", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("v", 6).alias("v"))


@query("U3", """WITH a AS (SELECT l_suppkey AS doc, l_partkey AS link FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_suppkey AS doc, l_partkey AS link FROM lineitem WHERE l_returnflag = 'A')
SELECT doc, link, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT doc, link, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def link_changes(t: Tables) -> DataFrame:
    pick = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("link"))
    return sm.link_changes(pick("R"), pick("A"))


@query("C21", """SELECT path, md5(CASE WHEN tags_csv <> '' OR aliases_csv <> '' THEN b || chr(10) || chr(10) || '[Metadata Context: ' ||
  array_to_string(list_filter(['Tags include ' || replace(tags_csv, ';', ', ') || '.', CASE WHEN aliases_csv <> '' THEN 'Known aliases: ' || aliases_csv || '.' END], lambda x: x IS NOT NULL), ' ') || ']' ELSE b END) AS hash
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\\[\\[(.*?)\\]\\]', '\\1', 'g'), '\\[(.*?)\\]\\(.*?\\)', '\\1', 'g'), '#+\\s*', '', 'g'), '^\\s+|\\s+$', '', 'g') AS b FROM card_rows)""")
def embedding_texts(t: Tables) -> DataFrame:
    return t.cards.select("path", F.md5(sm.embedding_text(F.col("body"), F.col("tags"), F.col("aliases"))).alias("hash"))


@query("X5 ST11")
def embedding_cache(t: Tables) -> DataFrame:
    cards = t.cards.select(F.col("path").alias("name"), F.col("body").alias("text"))
    held = sm.embed_texts(cards.withColumn("text", F.when(F.length("text") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" old")))), "text", sm.hashed_embedding(16)) \
        .select("name", F.md5("text").alias("hash"), "embedding")
    return sm.embedding_cache(cards, held, sm.hashed_embedding(16)).select("name", "hash", "cached", F.round(F.element_at("embedding", 1), 6).alias("first"))


@query("U5", """WITH c AS (SELECT *, doc_id - doc_id % 2 AS pair FROM card_rows), l AS (SELECT * FROM c WHERE doc_id % 2 = 0), r AS (SELECT * FROM c WHERE doc_id % 2 = 1)
SELECT l.pair, coalesce(l.updated, r.updated) AS updated, list_sort(list_distinct(list_concat(string_split(l.tags_csv, ';'), string_split(r.tags_csv, ';')))).array_to_string(';') AS tags FROM l JOIN r USING (pair)""")
def merged_card_fields(t: Tables) -> DataFrame:
    cards = t.cards.withColumn("pair", F.col("doc_id") - F.col("doc_id") % 2)
    pick = lambda n: cards.filter(F.col("doc_id") % 2 == n).select("pair", "updated", "tags")
    return sm.merged_fields(pick(0), pick(1), "pair").select("pair", "updated", F.array_join(F.array_sort("tags"), ";").alias("tags"))


# ------------------------------------------------------------------ claims

LOOSE = "replace(lower(regexp_replace(replace({0}, chr(173), ''), '[\\s\\-]+', '', 'g')), 'ß', 'ss')"
WS = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
VERIFIED = f"""
j AS (SELECT c.*, d.text, c.source LIKE '../%' AS outside FROM claim_rows c LEFT JOIN documents d ON c.source_type = 'local_wiki' AND c.source = 'raw/doc-' || CAST(d.doc_id AS STRING) || '.md'),
v AS (SELECT *, CASE WHEN evidence = '' THEN 'malformed block' WHEN source_type = 'local_wiki' AND outside THEN 'outside the project' WHEN source_type = 'local_wiki' AND text IS NULL THEN 'file not found'
  WHEN source_type = 'local_wiki' AND contains(text, evidence) THEN 'exact match' WHEN source_type = 'local_wiki' AND {WS.format('evidence')} <> '' AND contains({WS.format('text')}, {WS.format('evidence')}) THEN 'whitespace-normalized match'
  WHEN source_type = 'local_wiki' AND {LOOSE.format('evidence')} <> '' AND contains({LOOSE.format('text')}, {LOOSE.format('evidence')}) THEN 'loose match' WHEN source_type = 'local_wiki' THEN 'not found in source'
  WHEN source_type = 'web' THEN 'URL format valid' ELSE 'unknown source type' END AS reason FROM j)"""


def _verified(t: Tables) -> DataFrame:
    sources = t.documents.select(F.concat(F.lit("raw/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return cl.verify_quotes(t.claim_rows, sources)


@query("J22 C17 C18", f"""WITH {VERIFIED} SELECT doc_id, reason, CASE WHEN reason IN ('exact match', 'whitespace-normalized match', 'loose match') THEN 'verified' WHEN reason = 'URL format valid' THEN 'url-format-ok' ELSE 'unverified' END AS verdict FROM v""")
def quote_verification(t: Tables) -> DataFrame:
    return _verified(t).select("doc_id", "reason", "verdict")


@query("A20", f"""WITH {VERIFIED} SELECT CASE WHEN reason IN ('exact match', 'whitespace-normalized match', 'loose match') THEN 'verified' WHEN reason = 'URL format valid' THEN 'url-format-ok' ELSE 'unverified' END AS verdict, count(*) AS claims,
  bool_or(reason IN ('exact match', 'whitespace-normalized match', 'loose match')) AS counts_as_verified FROM v GROUP BY 1""")
def verdict_counts(t: Tables) -> DataFrame:
    return cl.verdict_counts(_verified(t))


@query("A19 J36", """SELECT doc_path, count(*) AS claims, count(*) FILTER (source_type = 'local_wiki' AND source LIKE 'raw/%') AS cold,
  round(count(*) FILTER (source_type = 'local_wiki' AND source LIKE 'raw/%') / count(*), 4) AS rate, count(*) FILTER (source LIKE 'wiki/references/%') AS derived FROM claim_rows GROUP BY doc_path""")
def claim_backing(t: Tables) -> DataFrame:
    derived = cl.derived_citations(t.claim_rows).groupBy("doc_path").agg(F.count("*").alias("derived"))
    return cl.backing_rate(t.claim_rows).join(derived, "doc_path", "left").na.fill(0, ["derived"]).withColumn("rate", F.round("rate", 4))


@query("C26 C23 X7", """SELECT doc_id, claim, 'x' || replace(replace(evidence, chr(10), ' '), '"', '') || 'x' AS evidence, source_type, source, substr(sha1(doc_path || '|' || claim), 1, 12) AS claim_id FROM claim_rows""")
def claim_block_extraction(t: Tables) -> DataFrame:
    quote = F.concat(F.lit("x"), F.replace(F.replace("evidence", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("")), F.lit("x"))
    rows = t.claim_rows.withColumn("evidence", quote)
    text = F.concat(F.lit("Some prose.\n\nCLAIM: "), "claim", F.lit('\nEVIDENCE: "'), "evidence", F.lit('"\nSOURCE_TYPE: '), "source_type", F.lit("\nSOURCE: "), "source", F.lit("\n"))
    blocks = cl.claim_blocks(rows.select("doc_id", "doc_path", text.alias("text")))
    return blocks.select("doc_id", "claim", "evidence", "source_type", "source", F.substring(F.sha1(F.concat_ws("|", "doc_path", "claim")), 1, 12).alias("claim_id"))
