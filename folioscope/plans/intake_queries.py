"""Bibliographic intake queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import identifiers as ids, markup as md
from ..operators import intake as it
from .registry import query
from .tables import Tables

ITEMS = """kept AS (SELECT * FROM item_rows WHERE itemTypeID NOT IN (2, 3)),
wide AS (SELECT k.itemID, k.key, max(value) FILTER (fieldID = 1) AS title, max(value) FILTER (fieldID = 2) AS doi, max(value) FILTER (fieldID = 3) AS url, max(value) FILTER (fieldID = 6) AS date FROM kept k LEFT JOIN value_rows USING (itemID) GROUP BY ALL),
pdf AS (SELECT parentItemID AS itemID, arg_min('storage/K' || CAST(itemID AS STRING) || '/' || substr(path, 9), itemID) AS pdf_path FROM attachment_rows WHERE contentType = 'application/pdf' AND path LIKE 'storage:%' AND path <> 'storage:undefined' GROUP BY parentItemID),
full_items AS (SELECT w.*, pdf_path, CASE WHEN url IS NOT NULL THEN '2301.' || lpad(CAST(w.itemID % 90000 AS STRING), 5, '0') WHEN doi LIKE '%arXiv%' THEN '2405.' || lpad(CAST(w.itemID % 90000 AS STRING), 5, '0') END AS arxiv_id FROM wide w LEFT JOIN pdf USING (itemID))"""


def _items(t: Tables) -> DataFrame:
    keyed = t.attachment_rows.select("itemID", F.concat(F.lit("K"), F.col("itemID").cast("string")).alias("key"))
    files = it.attachments(t.attachment_rows, keyed).select(F.col("parentItemID").alias("itemID"), "pdf_path")
    wide = it.items(t.item_tables).join(files, "itemID", "left")
    return wide.select("itemID", "key", "title", F.col("DOI").alias("doi"), "url", "date", "pdf_path",
                       it.item_arxiv_id(F.col("archiveID"), F.col("extra"), F.col("url"), F.col("DOI")).alias("arxiv_id"))


@query("S9", f"WITH {ITEMS} SELECT itemID, key, title, doi, url, date FROM wide")
def bibliographic_items(t: Tables) -> DataFrame:
    return it.items(t.item_tables).select("itemID", "key", "title", F.col("DOI").alias("doi"), "url", "date")


@query("S10", f"WITH {ITEMS} SELECT itemID AS parentItemID, pdf_path FROM pdf")
def stored_pdfs(t: Tables) -> DataFrame:
    keyed = t.attachment_rows.select("itemID", F.concat(F.lit("K"), F.col("itemID").cast("string")).alias("key"))
    return it.attachments(t.attachment_rows, keyed)


@query("A12", f"""WITH {ITEMS} SELECT count(*) AS total, count(arxiv_id) AS arxiv, count(pdf_path) AS pdf, count(*) FILTER (arxiv_id IS NOT NULL AND pdf_path IS NOT NULL) AS both, count(*) FILTER (arxiv_id IS NULL AND pdf_path IS NOT NULL) AS pdf_only,
count(*) FILTER (arxiv_id IS NULL AND doi IS NOT NULL) AS doi_only, count(*) FILTER (arxiv_id IS NULL AND doi IS NULL AND pdf_path IS NULL) AS nothing FROM full_items""")
def source_coverage(t: Tables) -> DataFrame:
    return it.coverage(_items(t))


@query("C32", f"""WITH {ITEMS} SELECT itemID, CASE WHEN arxiv_id IS NOT NULL THEN 'arxiv' WHEN pdf_path IS NOT NULL THEN 'file' WHEN doi IS NOT NULL THEN 'doi' END AS source_type, coalesce(arxiv_id, pdf_path, doi) AS value FROM full_items""")
def acquisition_plan(t: Tables) -> DataFrame:
    return it.plan_routes(_items(t)).select("itemID", "source_type", "value")


@query("J25", f"""WITH {ITEMS}, tree AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 1), mem AS (SELECT DISTINCT l_partkey AS itemID FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IN (SELECT id FROM tree))
SELECT itemID, key FROM wide WHERE itemID IN (SELECT itemID FROM mem) AND itemID IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4')""")
def selected_items(t: Tables) -> DataFrame:
    collections = t.nation.select(F.col("n_nationkey").alias("collectionID"), (F.col("n_regionkey") + 1000).alias("parentCollectionID"), F.col("n_name").alias("collectionName")) \
        .unionByName(t.region.select((F.col("r_regionkey") + 1000).alias("collectionID"), F.lit(None).cast("int").alias("parentCollectionID"), F.col("r_name").alias("collectionName")))
    members = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("collectionID"), F.col("l_partkey").alias("itemID"))
    item_tags = t.part.select(F.col("p_partkey").alias("itemID"), F.col("p_brand").alias("tagID"))
    tags = t.part.select(F.col("p_brand").alias("tagID"), F.col("p_brand").alias("name")).distinct()
    return it.select_items(it.items(t.item_tables), collections, members, collection_id=1001, item_tags=item_tags, tags=tags, tag="Brand#4").select("itemID", "key")


@query("A42", "SELECT 'items' AS measure, CAST(count(*) AS STRING) AS value FROM item_rows WHERE itemTypeID NOT IN (2, 3) UNION ALL SELECT 'collections', CAST(count(*) AS STRING) FROM nation UNION ALL SELECT 'latest', CAST(max(added) AS STRING) FROM item_rows")
def library_profile(t: Tables) -> DataFrame:
    return it.library_profile(t.item_rows.withColumn("dateAdded", F.col("added")), t.item_tables["itemTypes"], t.nation)


@query("A43", "SELECT n_nationkey AS collectionID, n_name AS collectionName, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def collection_counts(t: Tables) -> DataFrame:
    return it.collection_counts(t.nation.select(F.col("n_nationkey").alias("collectionID"), F.col("n_name").alias("collectionName")), t.customer.select(F.col("c_nationkey").alias("collectionID")))


@query("C31", """SELECT CASE WHEN page_id % 4 = 0 THEN 'url' WHEN page_id % 4 = 1 THEN 'doi' WHEN page_id % 4 = 2 THEN 'arxiv' ELSE 'file' END AS source_type, CASE WHEN page_id % 4 < 3 THEN 'arxiv-html' ELSE 'textlayer' END AS route, count(*) AS n FROM pages GROUP BY ALL""")
def route_summary(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    value = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("10.1234/"), "url")).when(k == 2, F.lit("2401.00506")).otherwise(F.concat(F.lit("papers/"), F.col("page_id").cast("string"), F.lit(".pdf")))
    return it.route_summary(t.pages.select(value.alias("value")))


@query("C33", "SELECT doc_id, CASE route WHEN 'tex' THEN 'textlayer' WHEN 'textlayer' THEN 'mineru' END AS next FROM conversion_rows")
def next_rungs(t: Tables) -> DataFrame:
    return t.conversion_rows.select("doc_id", it.next_rung(F.col("route")).alias("next"))


PENDING = "waiting AS (SELECT * FROM queue_rows WHERE req_id NOT IN (SELECT req_id FROM batch_rows WHERE kind = 'item'))"


@query("J16 A44", f"WITH {PENDING} SELECT req_id, source_type, value FROM waiting")
def pending_requests(t: Tables) -> DataFrame:
    return it.pending(t.queue_rows, t.batch_rows).select("req_id", "source_type", "value")


@query("J17", f"WITH {PENDING} SELECT req_id FROM queue_rows q WHERE retry_of IS NULL AND EXISTS (SELECT 1 FROM waiting w WHERE w.retry_of IS NULL AND w.source_type = q.source_type AND w.value = q.value)")
def repeated_requests(t: Tables) -> DataFrame:
    return it.repeat_requests(t.queue_rows, t.queue_rows, t.batch_rows).select("req_id")


@query("ST12", f"""WITH waiting AS (SELECT * FROM queue_rows WHERE req_id NOT IN (SELECT req_id FROM batch_rows WHERE kind = 'item')), inc AS (SELECT *, row_number() OVER (PARTITION BY source_type, value, retry_of IS NULL ORDER BY seq) AS r FROM queue_rows)
SELECT req_id FROM inc WHERE retry_of IS NOT NULL OR (r = 1 AND NOT EXISTS (SELECT 1 FROM waiting w WHERE w.retry_of IS NULL AND w.source_type = inc.source_type AND w.value = inc.value))""")
def admitted_requests(t: Tables) -> DataFrame:
    return it.admit_requests(t.queue_rows, t.queue_rows, t.batch_rows).select("req_id")


BATCH = """folded AS (SELECT batch, item_id, arg_max(req_id, seq) FILTER (kind = 'item') AS req_id, arg_max(CASE WHEN error IS NULL THEN '' ELSE error END, seq) FILTER (kind = 'item') AS error, arg_max(n_flags, seq) FILTER (kind = 'item') AS n_flags,
  arg_max(decision, seq) FILTER (kind = 'decision') AS d, arg_max(committed_path, seq) FILTER (kind = 'commit') AS committed_path FROM batch_rows GROUP BY ALL HAVING count(*) FILTER (kind = 'item') > 0),
b AS (SELECT *, CASE WHEN d <> 'reset' THEN d END AS decision FROM folded)"""


@query("A25 Q18 T5", f"WITH {BATCH} SELECT batch, item_id, req_id, decision, committed_path, CAST(n_flags AS INT) AS loud, coalesce(decision IN ('approve', 'reject'), false) AS decided FROM b")
def batch_review(t: Tables) -> DataFrame:
    return it.review_order(it.batch_items(t.batch_events)).select("batch", "item_id", "req_id", "decision", "committed_path", "loud", "decided")


@query("A41 A39", f"WITH {BATCH} SELECT batch, count(*) AS items, count(*) FILTER (decision IS NULL) AS undecided, count(committed_path) AS committed, count(*) FILTER (error <> '') AS failed, count(*) FILTER (decision IS NULL AND committed_path IS NULL) AS blocking FROM b GROUP BY batch")
def batch_summary(t: Tables) -> DataFrame:
    return it.batch_summary(it.batch_items(t.batch_events))


@query("J18", """WITH said AS (SELECT 'a' || CAST(l_partkey AS STRING) AS arxiv_id, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS extracted FROM lineitem GROUP BY 1)
SELECT p_partkey AS path, extracted FROM part JOIN said ON arxiv_id = 'a' || CAST(p_partkey AS STRING) WHERE extracted <> 'R'""")
def title_audit(t: Tables) -> DataFrame:
    said = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("batch"), F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("arxiv_id"), F.col("l_returnflag").alias("title"))
    cards = t.part.select(F.col("p_partkey").alias("path"), F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("arxiv_id"), F.lit(" \"R\" ").alias("title"))
    return it.title_audit(said, cards).select("path", "extracted")


@query("J39", "SELECT path, '[lib] Compile raw source: ' || path AS title FROM card_rows WHERE path LIKE 'raw/%' AND doc_id % 4 <> 0 AND doc_id % 6 <> 1")
def compile_backlog(t: Tables) -> DataFrame:
    raw = t.card_rows.filter(F.col("path").startswith("raw/"))
    tracked = raw.filter("doc_id % 4 = 0").select(F.concat(F.lit("[lib] Compile raw source: "), "path").alias("title")) \
        .unionByName(raw.filter("doc_id % 6 = 1").select(F.concat(F.lit("Compile raw source: "), "path").alias("title")))
    return it.backlog(raw.select("path"), tracked, "lib")


@query("S18", """SELECT path, md5('@' || CASE WHEN doc_id % 2 = 0 THEN 'article' ELSE 'misc' END || '{' || source || CAST(2000 + doc_id % 20 AS STRING) || ',' || chr(10) || '  title = {Card ' || CAST(doc_id AS STRING) || '},' || chr(10) || '  author = {Ann ' || upper(source) || ' and Bob},' || chr(10) || '  year = {' || CAST(2000 + doc_id % 20 AS STRING) || '}'
 || CASE WHEN doc_id % 2 = 0 THEN ',' || chr(10) || '  journal = {J \\{x\\}}' ELSE '' END || ',' || chr(10) || '  url = {https://e.org/' || CAST(doc_id AS STRING) || '}' || chr(10) || '}') AS entry FROM (SELECT c.path, c.doc_id, d.source FROM card_rows c JOIN documents d USING (doc_id) WHERE c.path LIKE 'wiki/references/%' AND c.title <> '')""")
def bibliography(t: Tables) -> DataFrame:
    rows = t.cards.filter((F.col("collection") == "references") & (F.col("title") != "")).join(t.documents.select("doc_id", "source"), "doc_id")
    cards = rows.select("path", "title", F.array(F.concat(F.lit("Ann "), F.upper("source")), F.lit("Bob")).alias("authors"), (2000 + F.col("doc_id") % 20).alias("year"), F.when(F.col("doc_id") % 2 == 0, "J {x}").alias("venue"),
                        F.lit(None).cast("string").alias("journal"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("string").alias("url"),
                        F.concat(F.lit("https://e.org/"), F.col("doc_id").cast("string")).alias("source"))
    return it.bib_entries(cards).select("path", F.md5("entry").alias("entry"))


@query("J27")
def similar_names(t: Tables) -> DataFrame:
    names = t.part.select(F.concat_ws("-", "p_name", F.lower("p_type")).alias("name")).select(F.replace("name", F.lit(" "), F.lit("-")).alias("name"))
    return it.similar_names(names, ["red-widgets-small", "blue-bolt", "small-ring-economy-x"])
