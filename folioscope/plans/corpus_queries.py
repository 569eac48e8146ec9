"""Corpus table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import markup as md, text as tx
from ..operators import corpus as co, graph as gr
from .registry import query
from .search_queries import PIECES
from .tables import Tables

COLLECTION = "CASE WHEN path LIKE 'raw/%' THEN 'raw' WHEN path LIKE 'drafts/%' THEN 'drafts' ELSE string_split(path, '/')[2] END"


@query("F1 S2", f"SELECT path, {COLLECTION} AS collection FROM card_rows WHERE path LIKE 'wiki/%' OR path LIKE 'drafts/%' OR path LIKE 'raw/%'")
def card_collections(t: Tables) -> DataFrame:
    return co.in_role(t.card_rows, "documents").select("path", co.collection_of(F.col("path")).alias("collection"))


@query("W12 X7", f"WITH {PIECES} SELECT library, id, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, md5(content) AS hash FROM chunks")
def section_pieces(t: Tables) -> DataFrame:
    return t.chunks.select("library", "id", "start_line", "end_line", F.md5("content").alias("hash"))


@query("F3 W12", """WITH l AS (SELECT doc_id, path, list_prepend('## Part ' || CAST(doc_id AS STRING), string_split(body, chr(10))) AS l FROM card_rows WHERE body IS NOT NULL),
p AS (SELECT doc_id, l, unnest(range(1, len(l) + 1, 250)) AS p FROM l)
SELECT doc_id, regexp_extract(l[p], '^#{1,3} (.+)$', 1) AS heading, CAST(p + 2 AS INT) AS start_line FROM p WHERE regexp_replace(array_to_string(l[p : p + 249], chr(10)), '^\\s+|\\s+$', '', 'g') <> ''
UNION ALL SELECT doc_id, 'See also', 1 FROM card_rows WHERE path LIKE 'raw/%' AND body IS NOT NULL""")
def sections_without_boilerplate(t: Tables) -> DataFrame:
    text = F.concat(F.lit("## See also\nother pages\n## Part "), F.col("doc_id").cast("string"), F.lit("\n"), "body")
    return co.drop_boilerplate(co.sections(t.cards.select("doc_id", "collection", text.alias("text")))).select("doc_id", "heading", "start_line")


@query("W13")
def length_pieces(t: Tables) -> DataFrame:
    return co.length_pieces(t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), 20).select("doc_id", "piece", "start_line", F.md5("content").alias("hash"))


@query("C22 ST1 A37", """SELECT CASE WHEN doc_id % 10 = 3 THEN 'new' WHEN doc_id % 10 = 4 THEN 'deleted' WHEN doc_id % 10 = 5 THEN 'changed' ELSE 'unchanged' END AS change, source AS library, count(*) AS n FROM documents GROUP BY ALL""")
def index_changes(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("library"), F.col("doc_id").alias("path"), "text")
    old = rows.filter("path % 10 <> 3").select("library", "path", tx.content_hash(F.when(F.col("path") % 10 == 5, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("hash"))
    new = rows.filter("path % 10 <> 4").select("library", "path", tx.content_hash(F.col("text")).alias("hash"))
    return co.file_changes(old, new).groupBy("library", "change").agg(F.count("*").alias("n"))


@query("A37", f"""WITH {PIECES}, c AS (SELECT library, count(*) AS chunks FROM chunks GROUP BY library), v AS (SELECT source AS library, count(*) AS vectors FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT library, chunks, coalesce(vectors, 0) AS vectors, (SELECT count(*) FROM documents d WHERE d.source = c.library) AS unchanged FROM c LEFT JOIN v USING (library)""")
def index_totals(t: Tables) -> DataFrame:
    vectors = t.documents.join(t.labels, "doc_id").select(F.col("source").alias("library"))
    changes = t.documents.select(F.col("source").alias("library"), F.lit("unchanged").alias("change"))
    return co.index_totals(t.chunks, vectors, changes).select("library", "chunks", "vectors", "unchanged")


SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), '_', '-'), '\\s+', '-', 'g'), '[^\\p{{L}}\\p{{N}}\\-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("C9 C10", f"""WITH s AS (SELECT doc_id, {SLUG.format("text")} AS slug_full FROM documents), c AS (SELECT *, substr(slug_full, 1, 80) AS cut FROM s)
SELECT doc_id, md5(slug_full) AS slug_full, CASE WHEN length(slug_full) > 80 THEN regexp_replace(CASE WHEN length(regexp_extract(cut, '^(.*)-[^-]*$', 1)) >= 40 THEN regexp_extract(cut, '^(.*)-[^-]*$', 1) ELSE cut END, '^-+|-+$', '', 'g') ELSE slug_full END AS slug FROM c""")
def slugs(t: Tables) -> DataFrame:
    return co.with_slugs(t.documents.select("doc_id", F.col("text").alias("head")), "head").select("doc_id", "slug", F.md5("slug_full").alias("slug_full"))


@query("C12 A30", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def page_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(md.html_links(F.col("html"))).alias("link"))


@query("C12", f"""WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, '') || ' [one](<a b ' || source || '.md>) and [two](https://e.org/' || lang || ')', '{md.MD_LINK}', 1) AS l FROM documents)
SELECT doc_id, regexp_replace(x, '^<([^>]+)>$', '\\1') AS link, CAST(i - 1 AS INT) AS pos FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l)""")
def markdown_links(t: Tables) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" [one](<a b "), "source", F.lit(".md>) and [two](https://e.org/"), "lang", F.lit(")"))
    return co.markdown_links(t.documents.select("doc_id", text.alias("text"))).select("doc_id", "pos", "link")


@query("C11", "SELECT doc_id, unnest([source, lang || ' page']) AS link FROM documents")
def wikilinks(t: Tables) -> DataFrame:
    return co.wikilinks(t.documents.select("doc_id", F.concat(F.lit("[["), "source", F.lit("|shown]] [["), "lang", F.lit(" page]] "), F.replace("text", F.lit("[["), F.lit(""))).alias("text"))).select("doc_id", "link")


@query("A30 C13", "SELECT DISTINCT 'arxiv' AS kind, '2301.' || lpad(CAST(p_size * 37 AS STRING), 5, '0') AS value FROM part UNION SELECT DISTINCT 'doi', '10.1000/' || lower(p_brand) FROM part")
def corpus_identifiers(t: Tables) -> DataFrame:
    text = F.concat(F.lit("arXiv:2301."), F.lpad((F.col("p_size") * 37).cast("string"), 5, "0"), F.lit("v4 and doi 10.1000/"), "p_brand", F.lit("."))
    return co.identifiers_in(t.part.select(text.alias("text")))


@query("A31", "SELECT DISTINCT '2301.' || lpad(CAST(doc_id % 77 AS STRING), 5, '0') AS arxiv_id FROM card_rows WHERE path LIKE 'wiki/references/%'")
def library_arxiv_ids(t: Tables) -> DataFrame:
    cards = t.cards.select("collection", F.lit(None).cast("string").alias("arxiv_id"), F.concat(F.lit("https://arxiv.org/pdf/2301."), F.lpad((F.col("doc_id") % 77).cast("string"), 5, "0"), F.lit("v2")).alias("source"), F.lit(None).cast("string").alias("url"))
    return co.library_arxiv_ids(cards)


@query("A17", "SELECT string_split(path, '/')[1] AS folder, count(*) AS files, max(doc_id) AS newest FROM card_rows GROUP BY 1")
def corpus_census(t: Tables) -> DataFrame:
    return co.census(t.card_rows.select("path", F.col("doc_id").alias("mtime")))


@query("S19", "SELECT 'all/in/' AS base, string_split(path, '/')[1] AS entry, count(*) AS files, CAST(sum(length(body)) AS BIGINT) AS bytes FROM card_rows GROUP BY ALL")
def folder_inventory(t: Tables) -> DataFrame:
    files = t.card_rows.select(F.concat(F.lit("all/in/"), "path").alias("path"), F.length("body").cast("bigint").alias("length"))
    return co.folder_inventory(files).select("base", "entry", "files", "bytes")


@query("F7", """WITH l AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) + CASE WHEN text IS NULL THEN 0 ELSE 1 END AS n, CASE doc_id % 4 WHEN 0 THEN '[STUB: Awaiting synthesis] x' WHEN 1 THEN 'No explicit thing' WHEN 2 THEN ' * **Energy** : ' ELSE 'plain' END AS line FROM documents)
SELECT doc_id, CAST(n AS INT) AS line, CASE doc_id % 4 WHEN 0 THEN 'stub_tag' WHEN 1 THEN 'no_explicit_text' ELSE 'empty_bullet' END AS type, CASE doc_id % 4 WHEN 0 THEN '[STUB: Awaiting synthesis]' WHEN 1 THEN 'No explicit thing' ELSE 'Energy' END AS context_hint FROM l WHERE doc_id % 4 < 3""")
def placeholder_lines(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    line = F.when(k == 0, "[STUB: Awaiting synthesis] x").when(k == 1, "No explicit thing").when(k == 2, " * **Energy** : ").otherwise("plain")
    return co.placeholders(t.documents.select("doc_id", F.concat_ws("\n", "text", line).alias("text"))).select("doc_id", "line", "type", "context_hint")


@query("A7", """SELECT path, CAST(len(string_split(body, chr(10))) AS INT) AS lines, CAST(0 AS INT) AS sections, CAST(len(regexp_extract_all(body, '(?s)\\$\\$(.*?)\\$\\$')) AS INT) AS block_math FROM card_rows""")
def structure_map(t: Tables) -> DataFrame:
    return co.structure_map(t.cards.select("path", F.col("body").alias("text"))).select("path", "lines", "sections", "block_math")


@query("A6", f"""WITH w AS (SELECT *, len(regexp_extract_all(coalesce(body, '') || '[[' || path || ']]', '{md.WIKILINK}')) AS n FROM card_rows)
SELECT {COLLECTION} AS collection, count(*) AS files, CAST(sum(n) AS BIGINT) AS wikilinks, count(*) FILTER (sources_csv = '') AS without_sources, round(sum(n) / count(*), 1)::DOUBLE AS avg_links FROM w GROUP BY 1""")
def collection_summary(t: Tables) -> DataFrame:
    cards = t.cards.withColumn("body", F.concat(F.coalesce("body", F.lit("")), F.lit("[["), "path", F.lit("]]")))
    return co.collection_summary(cards).select("collection", "files", "wikilinks", "without_sources", "avg_links")


@query("A6", """SELECT doc_id, CAST(1 AS INT) AS links, CAST(len(list_filter(string_split_regex(replace(replace(text, '$', ''), chr(92), ''), '\\s+'), lambda x: x <> '')) + 3 AS INT) AS words FROM documents""")
def link_density(t: Tables) -> DataFrame:
    clean = F.regexp_replace("text", r"[$\\]", "")
    return co.link_density(t.documents.select("doc_id", F.concat(clean, F.lit(" [[a b]] $x y z$ $$q r$$ end")).alias("text"))).select("doc_id", "links", "words")


@query("J30", """WITH names AS (SELECT DISTINCT regexp_extract(path, '([^/]*)\\.md$', 1) AS name FROM card_rows WHERE path LIKE 'wiki/concepts/%' OR path LIKE 'wiki/references/%'),
l AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, '') || ' see [[C ' || CAST(doc_id AS STRING) || ']]', '%WIKILINK%', 1))) AS link FROM documents)
SELECT doc_id, link, trim(regexp_replace(lower(link), '[^a-z0-9]+', '-', 'g'), '-') IN (SELECT name FROM names) OR replace(link, ' ', '_') IN (SELECT name FROM names) OR link IN (SELECT name FROM names) AS valid FROM l""".replace("%WIKILINK%", md.WIKILINK))
def reference_check(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit(" see [[C "), F.col("doc_id").cast("string"), F.lit("]]")).alias("text"))
    return gr.card_reference_check(docs, t.cards).select(F.col("path").alias("doc_id"), "link", "valid")


@query("J23", """WITH l AS (SELECT path, doc_id, 'alias_' || CAST(doc_id % 97 AS STRING) || '.md' AS link FROM card_rows WHERE path LIKE 'wiki/%' OR path LIKE 'drafts/%'),
a AS (SELECT 'alias_' || CAST(doc_id % 97 AS STRING) AS key, max('c-' || CAST(doc_id AS STRING) || '.md') AS name FROM card_rows WHERE path LIKE 'wiki/concepts/%' AND aliases_csv <> '' GROUP BY 1)
SELECT path, link, CASE WHEN name IS NULL THEN 'missing' ELSE 'alias' END AS problem, name AS suggestion FROM l LEFT JOIN a ON key || '.md' = link""")
def link_repairs(t: Tables) -> DataFrame:
    docs = t.card_rows.select("path", F.concat(F.coalesce("body", F.lit("")), F.lit(" [x](alias_"), (F.col("doc_id") % 97).cast("string"), F.lit(".md) [ok](../"), F.substring_index("path", "/", -2), F.lit(")")).alias("text"))
    ok_only = docs.filter(F.col("path").startswith("wiki/")).unionByName(docs.filter(F.col("path").startswith("drafts/")).withColumn("text", F.regexp_replace("text", r" \[ok\].*$", "")))
    return gr.repair_links(ok_only, t.cards, t.card_rows.select("path"))


@query("J32", """SELECT path AS file, CASE WHEN path LIKE 'raw/%' THEN 'library/' || substr(path, 5) ELSE path END AS moves_to, CASE WHEN path LIKE 'drafts/%' THEN '../' WHEN path LIKE 'wiki/%' THEN '../../' END || 'raw/papers/p-3.md#top' AS old,
 CASE WHEN path LIKE 'drafts/%' THEN '../' WHEN path LIKE 'wiki/%' THEN '../../' END || 'library/papers/p-3.md#top' AS new FROM card_rows WHERE path NOT LIKE 'raw/%'""")
def link_retargets(t: Tables) -> DataFrame:
    up = F.when(F.col("path").startswith("drafts/"), "../").when(F.col("path").startswith("wiki/"), "../../").otherwise("../../raw/")
    target = F.when(F.col("path").startswith("raw/"), F.lit("../papers/p-3.md#top")).otherwise(F.concat(up, F.lit("raw/papers/p-3.md#top")))
    return co.retarget_links(t.card_rows.select("path", F.concat(F.coalesce("body", F.lit("")), F.lit(" [a]("), target, F.lit(") [b](https://e.org/raw/x.md)")).alias("text")), [("raw", "library")])


@query("F31", "SELECT DISTINCT props AS line FROM events WHERE event_id % 4 = 1")
def unfiled_lines(t: Tables) -> DataFrame:
    from ..operators.state import unfiled
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("# "), "props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("  "), "props")).when(F.col("event_id") % 4 == 2, F.lit("starter text")).otherwise(F.lit(" "))
    return unfiled(t.events.select(line.alias("text")), t.spark.createDataFrame([("starter text",)], "line string")).select("line").distinct()


@query("T11", "SELECT path, CASE WHEN title = '' THEN 'Heading of ' || CAST(doc_id AS STRING) ELSE title END AS title FROM card_rows WHERE path LIKE 'drafts/%'")
def draft_list(t: Tables) -> DataFrame:
    from ..operators.state import drafts
    docs = t.card_rows.select("path", "title", F.concat(F.lit("intro\n# Heading of "), F.col("doc_id").cast("string"), F.lit("\n"), "body").alias("text"), F.col("doc_id").alias("mtime"))
    return drafts(docs).select("path", "title")


@query("J19", "SELECT 'threads/' || slug || '.md' AS path FROM note_rows WHERE slug = 'n-9' OR list_contains(string_split(lines_csv, ';'), 'n-9') UNION SELECT path FROM draft_rows WHERE path IN (SELECT string_split(derivation_csv, ';')[1] || '.md' FROM note_rows WHERE slug = 'n-9' OR list_contains(string_split(lines_csv, ';'), 'n-9'))")
def line_focus(t: Tables) -> DataFrame:
    from ..operators.state import line_focus as focus
    return focus(t.notes.withColumn("body", F.lit("")), t.drafts, "n-9")
