"""Link graph and discovery queries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..functions import identifiers as ids, text as tx
from ..operators import graph as gr, radar as rd
from ..sources import sinks
from ..streaming.jobs import new_root
from .registry import query
from .tables import DERIVED, Tables

DEGREE = "deg AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edge_rows WHERE type = 'wikilink' UNION ALL SELECT target_id FROM edge_rows WHERE type = 'wikilink' AND target_id <> source_id) GROUP BY id)"
BROKEN = "broken AS (SELECT e.source_id, s.title AS source_title, e.target_id AS target_text, e.type FROM edge_rows e LEFT JOIN node_rows n ON n.id = e.target_id LEFT JOIN node_rows s ON s.id = e.source_id WHERE n.id IS NULL AND e.type IN ('wikilink', 'supported_by'))"


@query("A1", f"""WITH {BROKEN} SELECT 'nodes' AS measure, type AS name, count(*) AS n FROM node_rows GROUP BY type UNION ALL SELECT 'edges', type, count(*) FROM edge_rows GROUP BY type
UNION ALL SELECT 'claims', status, count(*) FROM stated_rows GROUP BY status UNION ALL SELECT 'tags', '', count(DISTINCT tag) FROM tag_rows UNION ALL SELECT 'broken', '', count(*) FROM broken""")
def graph_overview(t: Tables) -> DataFrame:
    return gr.overview(t.nodes, t.edge_rows, t.tag_rows, t.stated_rows)


@query("A2", f"WITH {DEGREE} SELECT id, coalesce(degree, 0) AS degree FROM node_rows LEFT JOIN deg USING (id)")
def node_degrees(t: Tables) -> DataFrame:
    return gr.with_degree(t.nodes, t.edge_rows).select("id", "degree")


@query("T2", f"WITH {DEGREE} SELECT id, title, type, coalesce(degree, 0) AS degree FROM node_rows LEFT JOIN deg USING (id) ORDER BY degree DESC, id LIMIT 20")
def graph_hubs(t: Tables) -> DataFrame:
    return gr.hubs(t.nodes, t.edge_rows, 20)


@query("J2", f"WITH {BROKEN} SELECT * FROM broken")
def broken_links(t: Tables) -> DataFrame:
    return gr.broken_links(t.nodes, t.edge_rows)


@query("F4", f"WITH {DEGREE} SELECT id, title, type, coalesce(degree, 0) AS degree FROM node_rows LEFT JOIN deg USING (id) WHERE type = 'reference' AND (contains(lower(title), 'er#000000001') OR contains(lower(id), 'er#000000001'))")
def browse_nodes(t: Tables) -> DataFrame:
    return gr.browse_nodes(t.nodes, t.edge_rows, "reference", "ER#000000001").select("id", "title", "type", "degree")


@query("F5", "SELECT id, doc_id, status, text FROM stated_rows WHERE status = 'verified' AND contains(lower(text), 'urgent of 1')")
def browse_claims(t: Tables) -> DataFrame:
    return gr.browse_claims(t.stated_rows, "verified", "URGENT of 1")


@query("A3", "SELECT tag, count(*) AS count FROM tag_rows WHERE contains(lower(tag), 'b') GROUP BY tag")
def tag_counts(t: Tables) -> DataFrame:
    return gr.tag_counts(t.tag_rows, "B")


@query("J3", """SELECT 'outgoing' AS direction, target_id AS other_id, title, e.type FROM edge_rows e LEFT JOIN node_rows n ON n.id = e.target_id WHERE source_id = 'nation/NATION_3' AND e.type IN ('wikilink', 'supported_by', 'has_claim')
UNION ALL SELECT 'incoming', source_id, title, e.type FROM edge_rows e LEFT JOIN node_rows n ON n.id = e.source_id WHERE target_id = 'nation/NATION_3' AND e.type IN ('wikilink', 'supported_by', 'has_claim')""")
def node_links(t: Tables) -> DataFrame:
    return gr.node_links(t.nodes, t.edge_rows, "nation/NATION_3")


@query("J4 C37", "SELECT id FROM node_rows WHERE title = 'Customer#000000007' ORDER BY id LIMIT 1")
def find_node(t: Tables) -> DataFrame:
    return gr.find_node(t.nodes, t.alias_rows, " customer#000000007 ").select("id")


KEYS = """names AS (SELECT id, 0 AS o, title AS name FROM node_rows UNION ALL SELECT id, 1, regexp_extract(id, '[^/]*$') FROM node_rows UNION ALL SELECT node_id, 2, alias FROM alias_rows JOIN node_rows ON id = node_id),
keys AS (SELECT replace(lower(trim(name)), '_', ' ') AS key, arg_min(id, {'p': id || '.md', 'o': o}) AS id FROM names WHERE trim(name) <> '' GROUP BY 1)"""


@query("J1 C37", f"""WITH {KEYS}, l AS (SELECT 'order/' || CAST(l_orderkey AS STRING) AS source_id, CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_type || '_' || CAST(p_size AS STRING) ELSE 'ghost ' || p_name END AS link FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT DISTINCT source_id, coalesce(id, link) AS target_id, 'wikilink' AS type FROM l LEFT JOIN keys ON key = replace(lower(trim(link)), '_', ' ')""")
def resolved_links(t: Tables) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    link = F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.concat_ws("_", "p_type", F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("ghost "), "p_name"))
    links = t.lineitem.join(t.part.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("source_id"), link.alias("link"))
    return gr.resolve_links(links, gr.key_table(t.nodes, t.alias_rows))


MAP = f"""real AS (SELECT * FROM node_rows), live AS (SELECT e.* FROM edge_rows e JOIN real ON id = source_id WHERE e.type IN ('wikilink', 'supported_by', 'has_claim')),
ghosts AS (SELECT DISTINCT target_id AS id FROM live WHERE target_id NOT IN (SELECT id FROM real) AND type IN ('wikilink', 'supported_by')),
ends AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM live UNION ALL SELECT target_id FROM live) GROUP BY id),
pins AS (SELECT DISTINCT node_id AS id FROM tag_rows WHERE tag = 'skeleton'),
points AS (SELECT id, title, type FROM real UNION ALL SELECT id, id, 'ghost' FROM ghosts),
ranked AS (SELECT p.*, coalesce(degree, 0) AS degree, pins.id IS NOT NULL AS pinned FROM points p LEFT JOIN ends USING (id) LEFT JOIN pins USING (id)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY pinned DESC, degree DESC, (type = 'ghost')::INT, id) AS r FROM ranked) WHERE r <= 300 OR pinned)"""


@query("T3", f"WITH {MAP} SELECT id, title, type, degree FROM kept")
def graph_map_nodes(t: Tables) -> DataFrame:
    return gr.graph_map(t.nodes, t.edge_rows, t.tag_rows, limit=300)["nodes"].select("id", "title", "type", "degree")


@query("T3", f"WITH {MAP} SELECT DISTINCT source_id, target_id, type FROM live WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept)")
def graph_map_edges(t: Tables) -> DataFrame:
    return gr.graph_map(t.nodes, t.edge_rows, t.tag_rows, limit=300)["edges"]


@query("T4", f"""WITH real AS (SELECT * FROM node_rows), live AS (SELECT e.* FROM edge_rows e JOIN real a ON a.id = source_id JOIN real b ON b.id = target_id WHERE e.type IN ('wikilink', 'supported_by', 'has_claim')),
ends AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM live UNION ALL SELECT target_id FROM live) GROUP BY id), pins AS (SELECT DISTINCT node_id AS id FROM tag_rows WHERE tag = 'skeleton'),
ranked AS (SELECT p.id, coalesce(degree, 0) AS degree, pins.id IS NOT NULL AS pinned FROM real p LEFT JOIN ends USING (id) LEFT JOIN pins USING (id))
SELECT id, degree, pinned FROM (SELECT *, row_number() OVER (ORDER BY pinned DESC, degree DESC, id) AS r FROM ranked) WHERE r <= 60 OR pinned""")
def graph_skeleton(t: Tables) -> DataFrame:
    return gr.graph_map(t.nodes, t.edge_rows, t.tag_rows, skeleton=True)["nodes"].select("id", "degree", "pinned")


@query("U6", "SELECT 'n' || CAST(l_partkey AS STRING) AS id, arg_max(l_comment, l_orderkey * 10 + l_linenumber) AS title FROM (SELECT *, CAST(l_orderkey AS STRING) || '/' || l_returnflag AS l_comment FROM lineitem) GROUP BY l_partkey")
def upserted_nodes(t: Tables) -> DataFrame:
    writes = t.lineitem.select(F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("id"), F.concat_ws("/", F.col("l_orderkey").cast("string"), "l_returnflag").alias("title"),
                               (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return gr.upsert_nodes(writes)


@query("J24", """WITH RECURSIVE tree AS (SELECT 'r' || CAST(r_regionkey AS STRING) AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), n_name FROM nation
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), c_name FROM customer),
down AS (SELECT id, 0 AS depth FROM tree WHERE name = 'ASIA' UNION ALL SELECT tree.id, depth + 1 FROM tree JOIN down ON tree.parent = down.id) SELECT id, CAST(depth AS INT) AS depth FROM down""")
def collection_subtree(t: Tables) -> DataFrame:
    row = lambda df, i, p, n: df.select(i.alias("collectionID"), p.alias("parentCollectionID"), F.col(n).alias("collectionName"))
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    tree = row(t.region, key("r", "r_regionkey"), F.lit(None).cast("string"), "r_name").unionByName(row(t.nation, key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name")) \
        .unionByName(row(t.customer, key("c", "c_custkey"), key("n", "c_nationkey"), "c_name"))
    return gr.subtree(tree, "ASIA").select("id", "depth")


@query("X1 X2", "SELECT type, count(*) AS n FROM edge_rows WHERE lower(target_id) LIKE 'region/%' GROUP BY type")
def graph_sql(t: Tables) -> DataFrame:
    from ..functions.tables import register_functions
    register_functions(t.spark)
    return gr.read_only_sql(t.spark, {"nodes": t.nodes, "edges": t.edge_rows, "tags": t.tag_rows},
                            "SELECT type, count(*) AS n FROM edges WHERE ulower(target_id) LIKE 'region/%' GROUP BY type")


@query("J15", "SELECT s.id, status, coalesce(n, 0) AS n_evidence, md5(e) AS hash FROM stated_rows s LEFT JOIN (SELECT 'claim-' || CAST(l_orderkey AS STRING) AS id, count(*) AS n, string_agg(l_shipmode, chr(10) ORDER BY l_shipmode) AS e FROM (SELECT *, 'raw/' || CAST(l_partkey AS STRING) || ': quote ' || l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1) e USING (id)")
def claims_with_evidence(t: Tables) -> DataFrame:
    evidence = t.lineitem.select(F.concat(F.lit("claim-"), F.col("l_orderkey").cast("string")).alias("claim_id"), F.concat(F.lit("raw/"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("quote "), "l_returnflag").alias("quote"))
    return gr.claims_with_evidence(t.stated_rows, evidence).select("id", "status", "n_evidence", F.md5("evidence").alias("hash"))


@query("S15 C11", """WITH c AS (SELECT * FROM card_rows WHERE path LIKE 'wiki/%'), tags AS (SELECT DISTINCT path, unnest(string_split(tags_csv, ';')) AS tag FROM c)
SELECT 'nodes' AS tab, type, count(*) AS n FROM (SELECT CASE WHEN path LIKE 'wiki/concepts/%' THEN 'concept' WHEN path LIKE 'wiki/references/%' THEN 'reference' ELSE 'topic' END AS type FROM c UNION ALL SELECT 'tag' FROM (SELECT DISTINCT tag FROM tags)) GROUP BY type
UNION ALL SELECT 'edges', 'has_tag', count(*) FROM tags UNION ALL SELECT 'edges', 'wikilink', count(*) FROM c""")
def built_graph(t: Tables) -> DataFrame:
    cards = t.cards.filter(F.col("path").startswith("wiki/")).withColumn("body", F.concat(F.lit("[[no page "), F.col("doc_id").cast("string"), F.lit("|x]] "), "body"))
    graph = gr.build_graph(cards)
    return graph["nodes"].groupBy("type").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("tab"), "type", "n") \
        .unionByName(graph["edges"].groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edges").alias("tab"), "type", "n"))


@query("S15", "SELECT id AS source, title AS target, type FROM node_rows UNION ALL SELECT source_id, target_id, type FROM edge_rows")
def graph_across_failed_rebuild(t: Tables) -> DataFrame:
    """The newest whole version is read: a rebuild that fails in its last table leaves the one before it."""
    root = new_root(t.spark, "graph")
    sinks.publish({"nodes": t.nodes.limit(0), "edges": t.edge_rows.limit(0)}, root)
    sinks.publish({"nodes": t.nodes, "edges": t.edge_rows}, root)
    try:  # a column named twice cannot be written
        sinks.publish({"nodes": t.nodes.withColumn("title", F.lit("half done")), "edges": t.edge_rows.select("*", "type")}, root)
        raise AssertionError("the third rebuild has to fail")
    except AnalysisException as error:
        if error.getCondition() != "COLUMN_ALREADY_EXISTS":
            raise
    held = sinks.published(t.spark, root, ["nodes", "edges"])
    return held["nodes"].select(F.col("id").alias("source"), F.col("title").alias("target"), "type") \
        .unionByName(held["edges"].select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type"))


@query("F29", "SELECT max(us) AS newest_us, CASE WHEN max(us) > 1706400000000000 THEN 'stale' ELSE 'fresh' END AS state FROM ev")
def graph_staleness(t: Tables) -> DataFrame:
    return gr.stale(t.ev.select(F.timestamp_micros("us").alias("mtime")), "2024-01-28 00:00:00").select(F.unix_micros("newest").alias("newest_us"), "state")


# ------------------------------------------------------------------ discovery

@query("J9 U2", """WITH s AS (SELECT DISTINCT 'o-' || CAST(user_id AS STRING) AS id FROM events), c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY feed, pos) AS r FROM candidate_rows WHERE id NOT IN (SELECT id FROM s)
  AND coalesce(arxiv_id, '') NOT IN (SELECT '2401.' || lpad(CAST(p_partkey AS STRING), 5, '0') FROM part)) SELECT id, pos, source FROM c WHERE r = 1""")
def unseen_candidates(t: Tables) -> DataFrame:
    seen = t.events.select(F.concat(F.lit("o-"), F.col("user_id").cast("string")).alias("id"))
    held = t.part.select(F.concat(F.lit("2401."), F.lpad(F.col("p_partkey").cast("string"), 5, "0")).alias("arxiv_id"))
    return rd.unseen(t.candidate_rows, seen, held, order=("feed", "pos")).select("id", "pos", "source")


@query("F8", "SELECT pos, id FROM candidate_rows WHERE score IS NULL OR score >= 250000")
def relevant_candidates(t: Tables) -> DataFrame:
    return rd.relevant(t.candidate_rows, 250000.0).select("pos", "id")


@query("W2", """WITH r AS (SELECT pos, source, row_number() OVER (PARTITION BY source ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY source) AS opened FROM candidate_rows WHERE source LIKE 'arxiv-new%'),
s AS (SELECT pos FROM r ORDER BY turn, opened LIMIT 20), o AS (SELECT pos FROM candidate_rows WHERE pos NOT IN (SELECT pos FROM s) ORDER BY pos LIMIT 20)
SELECT pos, id, source FROM candidate_rows WHERE pos IN (SELECT pos FROM s) OR pos IN (SELECT pos FROM o)""")
def fair_budget(t: Tables) -> DataFrame:
    return rd.apply_budget(t.candidate_rows).select("pos", "id", "source")


@query("T7", "WITH l AS (SELECT DISTINCT arxiv_id FROM candidate_rows WHERE arxiv_id IS NOT NULL) SELECT arxiv_id FROM (SELECT '2401.00009' AS arxiv_id, 0 AS k UNION ALL SELECT '2312.00001', 0 UNION ALL SELECT arxiv_id, 1 FROM l WHERE arxiv_id NOT IN ('2401.00009', '2312.00001')) ORDER BY k, arxiv_id LIMIT 50")
def seed_list(t: Tables) -> DataFrame:
    return rd.seeds(["2401.00009", "2312.00001", "2401.00009"], t.candidate_rows.filter("arxiv_id IS NOT NULL").select("arxiv_id").distinct())


TRIAGE = "st AS (SELECT report, id, arg_max(decision, seq) AS decision FROM triage_rows GROUP BY report, id HAVING arg_max(decision, seq) <> 'reset')"


@query("A23 ST3", f"WITH {TRIAGE} SELECT * FROM st")
def triage_state(t: Tables) -> DataFrame:
    return rd.triage_state(t.triage_rows)


@query("A24", f"WITH {TRIAGE} SELECT id, arg_min(decision, report) AS decision, min(report) AS report FROM st GROUP BY id")
def decisions_across_reports(t: Tables) -> DataFrame:
    return rd.decisions_so_far(t.triage_rows.withColumn("report", F.col("report")))


@query("A40", f"WITH {TRIAGE} SELECT report, count(*) AS candidates, count(decision) AS decided, count(*) - count(decision) AS undecided FROM (SELECT DISTINCT report, id FROM triage_rows) LEFT JOIN st USING (report, id) GROUP BY report")
def triage_progress(t: Tables) -> DataFrame:
    return rd.triage_progress(t.triage_rows.select("report", "id"), t.triage_rows)


def _reports(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "O", "pending-review").otherwise("done").alias("status"), F.col("o_orderkey").alias("name"))


@query("A29 A36", """SELECT 'seen' AS measure, count(*) AS value FROM events UNION ALL SELECT 'pending ' || o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority
UNION ALL SELECT 'days since harvest', date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-05') FROM events""")
def radar_status(t: Tables) -> DataFrame:
    seen = t.events.select(F.to_date("ts").alias("first_seen"))
    return rd.radar_status(seen, _reports(t), "2024-02-05")


def _gap_inputs(t: Tables, name: str):
    """own, neighbours, citations and, by the name of their table, references."""
    # A paper's neighbours are made where its references and citations meet them: dealt as keys, before there are thirty of each.
    keys = t.orders.select("o_orderkey").repartition("o_orderkey")
    own = keys.select(F.col("o_orderkey").alias("paper_id"))
    papers = t.orders.agg(F.max("o_orderkey") + 1).scalar()
    near = F.explode(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.struct(i.alias("pos"), ((F.col("o_orderkey") * 13 + i * 101) % F.col("_papers")).alias("candidate_id"))))
    neighbours = keys.withColumn("_papers", F.lit(papers)).select(F.col("o_orderkey").alias("paper_id"), near.alias("n")).select("paper_id", "n.candidate_id", "n.pos", (2015 + F.col("n.candidate_id") % 10).alias("year"), F.lit("t").alias("title"))
    citations = neighbours.filter("pos % 11 = 0").select("paper_id", F.col("candidate_id").alias("citing_id"))
    lines = t.lineitem.select("l_orderkey", "l_partkey").repartition("l_orderkey")
    references = t._derived(DERIVED[name], name, lineitem=lines).withColumn("cited_title", F.concat(F.lit("Title "), F.col("cited_id").cast("string")))
    return own, neighbours.filter("candidate_id <> paper_id"), citations, references


GAPS = """own AS (SELECT o_orderkey AS paper_id FROM orders),
nb0 AS (SELECT paper_id, i AS pos, (paper_id * 13 + i * 101) % (SELECT max(o_orderkey) + 1 FROM orders) AS candidate_id FROM own, (SELECT unnest(range(1, 31)) AS i)),
el AS (SELECT * FROM nb0 a WHERE candidate_id <> paper_id AND 2015 + candidate_id % 10 >= 2018
  AND NOT EXISTS (SELECT 1 FROM nb0 c WHERE c.paper_id = a.paper_id AND c.candidate_id = a.candidate_id AND c.pos % 11 = 0)),
gaps AS (SELECT el.paper_id, el.candidate_id, count(*) AS shared FROM el JOIN reference_rows a ON a.paper_id = el.candidate_id JOIN reference_rows b ON b.paper_id = el.paper_id AND b.cited_id = a.cited_id GROUP BY ALL HAVING count(*) >= 2)"""
CITED_GAPS = GAPS.replace("reference_rows", "cited_rows")


@query("J11 U4", f"WITH {GAPS} SELECT * FROM gaps")
def citation_gaps(t: Tables) -> DataFrame:
    return rd.citation_gaps(*_gap_inputs(t, "reference_rows"), since_year=2018, min_shared=2).select("paper_id", "candidate_id", "shared")


@query("A28", f"WITH {CITED_GAPS} SELECT candidate_id, count(*) AS pairs, max(shared) AS best, arg_min(paper_id, {{'s': -shared, 'p': paper_id}}) AS anchor FROM gaps GROUP BY candidate_id")
def gap_groups(t: Tables) -> DataFrame:
    return rd.gap_groups(rd.citation_gaps(*_gap_inputs(t, "cited_rows"), since_year=2018, min_shared=2))


@query("U4", "SELECT a, b, count(*) AS shared FROM (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders) p JOIN cited_rows x ON x.paper_id = a JOIN cited_rows y ON y.paper_id = b AND x.cited_id = y.cited_id GROUP BY a, b")
def shared_references(t: Tables) -> DataFrame:
    pairs = t.orders.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return rd.shared_references(t.cited_rows, pairs)


def _landed(t: Tables) -> DataFrame:
    """Feed records from the documents; every sixth has no title."""
    d = F.col("doc_id")
    return t.documents.select(F.col("lang").alias("query"), d.alias("pos"), F.when(d % 6 != 0, F.col("text")).alias("title"), (1990 + d % 40).alias("year"), F.col("text").alias("abstract"),
                              F.lit("u").alias("url"), d.cast("string").alias("paperId"), F.struct(F.when(d % 3 == 0, F.concat(F.lit("2401."), F.lpad((d % 90000).cast("string"), 5, "0"))).alias("ArXiv"),
                              F.concat(F.lit("10.1/"), d.cast("string")).alias("DOI")).alias("externalIds"), F.array(F.struct(F.lit("A").alias("name"))).alias("authors"))


@query("S12", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title FROM documents WHERE doc_id % 6 <> 0 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND 1990 + doc_id % 40 BETWEEN 2000 AND 2020)
SELECT CASE WHEN doc_id % 3 = 0 THEN '2401.' || lpad(CAST(doc_id % 90000 AS STRING), 5, '0') ELSE '10.1/' || CAST(doc_id AS STRING) END AS id, md5(title) AS title, CAST(1990 + doc_id % 40 AS INT) AS year, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS abstract FROM l WHERE k <= 15""")
def keyword_feed(t: Tables) -> DataFrame:
    return rd.keyword_feed(_landed(t), limit=60, queries=4, first_year=2000, last_year=2020).select("id", F.md5("title").alias("title"), "year", F.md5("abstract").alias("abstract"))


def _entries(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.ev.select(F.col("event_type").alias("category"), F.concat(F.lit("http://arxiv.org/abs/2401."), F.lpad((e % 90000).cast("string"), 5, "0"), F.lit("v3")).alias("id"), F.lit("A  title").alias("title"),
                          F.when(e % 9 == 0, "soon").otherwise(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("published"), F.col("props").alias("summary"), F.array(F.lit("A")).alias("authors"))


@query("S13", "SELECT '2401.' || lpad(CAST(event_id % 90000 AS STRING), 5, '0') AS id, 'arxiv-new:' || event_type AS source FROM ev WHERE event_id % 9 <> 0 AND us >= 1705881600000000")
def new_listings(t: Tables) -> DataFrame:
    return rd.new_listings(_entries(t), "2024-02-05 00:00:00", 14).select("id", "source")


@query("S11 U2", """SELECT CAST(0 AS INT) AS feed, 's2-recommendation' AS source, CASE WHEN doc_id % 3 = 0 THEN '2401.' || lpad(CAST(doc_id % 90000 AS STRING), 5, '0') ELSE '10.1/' || CAST(doc_id AS STRING) END AS id
FROM documents WHERE doc_id % 6 <> 0 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''
UNION ALL SELECT 1, 'arxiv-new:' || event_type, '2401.' || lpad(CAST(event_id % 90000 AS STRING), 5, '0') FROM ev WHERE event_id % 9 <> 0 AND us >= 1705881600000000""")
def united_candidates(t: Tables) -> DataFrame:
    recommended = rd.recommendations(_landed(t).drop("query", "pos"))
    return rd.candidate_union(recommended, rd.new_listings(_entries(t), "2024-02-05 00:00:00", 14)).select("feed", "source", "id")


@query("T9", "SELECT o_orderkey AS name, o_orderpriority AS kind FROM orders WHERE o_orderstatus = 'O'")
def pending_reports(t: Tables) -> DataFrame:
    return rd.pending_reports(_reports(t)).select("name", "kind")


@query("J21 C19", """SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN '2405.' || lpad(CAST(p_partkey % 90000 AS STRING), 5, '0') END AS resolved_arxiv FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 2 = 1""".replace("p_partkey % 4 < 3", "p_partkey % 4 = 0"))
def resolved_dois(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    items = t.part.select("p_partkey", F.concat(F.lit("10.1/P"), k.cast("string")).alias("doi"), F.col("p_name").alias("title"))
    lookup = t.part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("10.1/p"), k.cast("string")).alias("doi"), F.concat(F.lit("arXiv:2405."), F.lpad((k % 90000).cast("string"), 5, "0"), F.lit("v1")).alias("arxiv_id"),
                                                      F.when(k % 4 == 0, F.upper("p_name")).otherwise("quite another paper").alias("title"))
    return rd.enrich_dois(items, lookup).select("p_partkey", "resolved_arxiv")


@query("C28 X7", "SELECT doc_id, CAST(0 AS INT) AS idx, 'd-' || CAST(doc_id AS STRING) AS id, round(doc_id / 1000.0, 3)::DOUBLE AS relevance, 'https://arxiv.org/abs/2401.00001v2' AS url, '2401.00001' AS arxiv_id, md5('About ' || source || ' and ' || lang) AS abstract FROM documents")
def report_candidates(t: Tables) -> DataFrame:
    d = F.col("doc_id").cast("string")
    report = F.concat(F.lit("# Digest\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n## A paper "), d, F.lit("\n- id: `d-"), d, F.lit("` · relevance: "), F.format_string("%.3f", F.col("doc_id") / 1000), F.lit("\n- authors: A, B, et al.\n- abstract: About "), F.col("source"),
                      F.lit(" and "), F.col("lang"), F.lit("\n- https://arxiv.org/abs/2401.00001v2\n"))
    rows = rd.report_candidates(t.documents.select("doc_id", report.alias("text")))
    return rows.select("doc_id", F.col("index").alias("idx"), "id", "relevance", "url", "arxiv_id", F.md5("abstract").alias("abstract"))


@query("C13 C14 C15 C16", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '2301.' || lpad(CAST(p_partkey % 90000 AS STRING), 5, '0') WHEN 1 THEN 'math.AG/0601001' WHEN 2 THEN '2405.00208' END AS arxiv_id,
 CASE p_partkey % 5 WHEN 2 THEN '10.48550/arxiv.2405.00208' WHEN 3 THEN '10.1000/abc' || CAST(p_partkey AS STRING) END AS doi, CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'text' ELSE '' END AS source FROM part""")
def identities(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("see https://arxiv.org/abs/2301."), F.lpad((F.col("p_partkey") % 90000).cast("string"), 5, "0"), F.lit("v2, figures/1234567"))) \
        .when(k == 1, F.lit("arXiv:MATH.ag/0601001 [math]")).when(k == 2, F.lit("doi:10.48550/arXiv.2405.00208.")) \
        .when(k == 3, F.concat(F.lit("(10.1000/ABC"), n, F.lit(").,"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", ids.identity(text).alias("i")).select("p_partkey", "i.arxiv_id", "i.doi", "i.source")


@query("C40 C20", "SELECT p_partkey, p_name AS cleaned, contains(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), 'red w') AS remembered FROM part")
def cleaned_titles(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("[2301.00001v2] "), "p_name", F.lit(" - arXiv.org"))).otherwise(F.concat(F.lit("[math.AG/0601001] "), "p_name"))
    clean = ids.clean_title(raw)
    return t.part.select("p_partkey", clean.alias("cleaned"), ids.title_contains(F.lit("RED-w"), clean).alias("remembered"))
