"""Link graph: build, browse, map, SQL.

Tables: nodes(id, path, title, type, category, summary, created, updated),
edges(source_id, target_id, type), tags(node_id, tag), aliases(node_id, alias),
claims(id, doc_id, text, status), evidence(claim_id, source_type, source, quote).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import markup as md, text as tx, vocab
from ..session import cut_lineage
from .claims import claim_blocks

LINK_TYPES = ("wikilink", "supported_by", "has_claim")
BROKEN_TYPES = ("wikilink", "supported_by")
NODE_TYPES = ("concept", "reference", "topic", "thesis", "claim", "tag", "proposition", "question", "line")
DIR_TYPES = {"concepts": "concept", "references": "reference", "theses": "thesis", "topics": "topic"}
MAP_LIMIT, SKELETON_LIMIT = 800, 60
PIN = "skeleton"


# ------------------------------------------------------------------ building

def key_table(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """key → id: title, stem, then alias; compiled cards before notes, then path order."""
    area = F.when(F.col("path").startswith("threads/"), 1).otherwise(0)
    named = nodes.select("id", "path", area.alias("area"), F.explode(F.array(
        F.struct(F.lit(0).alias("o"), F.col("title").alias("name")),
        F.struct(F.lit(1).alias("o"), md.stem(F.col("path")).alias("name")))).alias("c")).select("id", "path", "area", "c.o", "c.name")
    aka = aliases.join(nodes.select(F.col("id").alias("node_id"), "path", area.alias("area")).hint("merge"), "node_id") \
        .select(F.col("node_id").alias("id"), "path", "area", F.lit(2).alias("o"), F.col("alias").alias("name"))
    return named.unionByName(aka).withColumn("key", tx.link_key(F.col("name"))).filter(F.col("key") != "") \
        .groupBy("key").agg(F.min(F.struct("area", "path", "o", "id"))["id"].alias("id"))


def resolve_links(links: DataFrame, keys: DataFrame) -> DataFrame:
    """Wikilink edges; an unresolved target keeps its raw text. `links`: source_id, link."""
    keyed = links.withColumn("key", tx.link_key(F.col("link")))
    return keyed.join(keys.hint("merge"), "key", "left").select(
        "source_id", F.coalesce("id", "link").alias("target_id"), F.lit("wikilink").alias("type")).distinct()


def card_nodes(cards: DataFrame) -> DataFrame:
    """Nodes of compiled cards. The folder decides the type unless front matter names a graph type."""
    parent = F.element_at(F.split("path", "/"), -2)
    from_dir = F.lit(None).cast("string")
    for folder, name in DIR_TYPES.items():
        from_dir = F.when(parent == folder, F.lit(name)).otherwise(from_dir)
    declared = F.nullif(F.lower(F.trim(F.coalesce("type", F.lit("")))), F.lit(""))
    kind = F.when(from_dir.isNotNull(), F.when(declared.isin(*NODE_TYPES), declared).otherwise(from_dir)) \
        .otherwise(F.coalesce(declared, parent))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return cards.select(F.regexp_replace("path", r"\.md$", "").alias("id"), "path",
                        F.coalesce(F.nullif("title", F.lit("")), md.stem(F.col("path"))).alias("title"), kind.alias("type"),
                        F.coalesce(F.nullif("category", F.lit("")), from_dir, F.lit("")).alias("category"),
                        text("summary").alias("summary"), text("created").alias("created"), text("updated").alias("updated"))


def build_graph(cards: DataFrame, notes: DataFrame | None = None, last_posts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six tables from cards and notes.

    `cards`: path, title, type, category, summary, created, updated, tags,
    aliases, pinned, body. `notes`: slug, kind, status, title, purpose, created,
    lines, tags, depends_on, answers, derivation, body.
    """
    cards = cards.filter((md.basename(F.col("path")) != "_index.md") & ~F.array_contains(F.split("path", "/"), ".backup"))
    base = card_nodes(cards)
    none = F.array().cast("array<string>")
    tagged = cards.select(F.regexp_replace("path", r"\.md$", "").alias("node_id"), F.explode(F.concat(
        F.coalesce("tags", none), F.when(F.col("pinned"), F.array(F.lit(PIN))).otherwise(none))).alias("tag"))
    aliases = cards.select(F.regexp_replace("path", r"\.md$", "").alias("node_id"), F.explode("aliases").alias("alias")).distinct()
    links = cards.select(F.regexp_replace("path", r"\.md$", "").alias("source_id"), F.explode(md.wikilinks(F.col("body"))).alias("link"))
    blocks = claim_blocks(cards.select(F.regexp_replace("path", r"\.md$", "").alias("doc_id"), "path", F.col("body").alias("text")), embedded=True) \
        .filter(F.coalesce(F.length("claim"), F.lit(0)) > 0) \
        .withColumn("id", claim_id(F.col("doc_id"), F.col("claim")))
    claims = blocks.groupBy("id").agg(F.max_by(F.struct("doc_id", "claim", "path", F.lower(F.coalesce(
        F.nullif("status", F.lit("")), F.lit("unverified"))).alias("status")), "seq").alias("c")) \
        .select("id", "c.doc_id", F.col("c.claim").alias("text"), "c.status", "c.path")
    evidence = blocks.filter(F.coalesce(F.length("source"), F.lit(0)) > 0).select(
        F.col("id").alias("claim_id"), F.lower(F.coalesce("source_type", F.lit(""))).alias("source_type"), "source",
        F.coalesce("evidence", F.lit("")).alias("quote")).distinct()
    claim_nodes = claims.select("id", "path", F.substring("text", 1, 120).alias("title"), F.lit("claim").alias("type"),
                                F.lit("claim").alias("category"), F.col("text").alias("summary"), F.lit("").alias("created"), F.lit("").alias("updated"))
    supported = evidence.filter(F.col("source_type") == "local_wiki").select(
        F.col("claim_id").alias("source_id"), F.regexp_replace(F.replace("source", F.lit("\\"), F.lit("/")), r"\.md$", "").alias("target_id"),
        F.lit("supported_by").alias("type"))
    has_claim = claims.select(F.col("doc_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("has_claim").alias("type"))
    if notes is not None:
        node_id = F.concat(F.lit("threads/"), F.col("slug"))
        kind = F.lower(F.trim(F.coalesce("kind", F.lit(""))))
        updated = F.lit("")
        source = notes
        if last_posts is not None:
            source = notes.join(last_posts.select("slug", F.date_format("last_at", "yyyy-MM-dd").alias("_upd")), "slug", "left")
            updated = F.coalesce("_upd", F.lit(""))
        note_nodes = source.select(node_id.alias("id"), F.concat(node_id, F.lit(".md")).alias("path"),
                                   F.coalesce(F.nullif("title", F.lit("")), F.col("slug")).alias("title"),
                                   F.when(kind.isin(*NODE_TYPES), kind).otherwise("other").alias("type"),
                                   F.coalesce("status", F.lit("")).alias("category"), F.coalesce("purpose", F.lit("")).alias("summary"),
                                   F.coalesce(F.col("created").cast("string"), F.lit("")).alias("created"), updated.alias("updated"))
        base = base.unionByName(note_nodes)
        tier = vocab.tier_of(F.lit("threads/x.md"), F.col("status"))
        note_tags = notes.select(node_id.alias("node_id"), F.explode(F.concat(
            F.array(F.concat(F.lit("tier:"), tier)), F.transform(F.coalesce("lines", none), lambda l: F.concat(F.lit("line:"), l)),
            F.coalesce("tags", none))).alias("tag"))
        tagged = tagged.unionByName(note_tags)
        fields = F.concat(*[F.coalesce(F.col(c), none) for c in ("depends_on", "answers", "derivation")])
        cleaned = F.filter(F.transform(fields, lambda l: F.regexp_replace(F.trim(l), r"^[\[\]]+|[\[\]]+$", "")), lambda l: l != "")
        links = links.unionByName(notes.select(node_id.alias("source_id"), F.explode(F.concat(cleaned, md.wikilinks(F.col("body")))).alias("link")))
    tags = tagged.filter(F.col("tag").isNotNull()).distinct()
    keys = key_table(base, aliases)
    tag_nodes = tags.select(F.concat(F.lit("tag:"), "tag").alias("id"), F.lit("").alias("path"), F.col("tag").alias("title"),
                            F.lit("tag").alias("type"), F.lit("tag").alias("category"), F.lit("").alias("summary"),
                            F.lit("").alias("created"), F.lit("").alias("updated")).distinct()
    has_tag = tags.select(F.col("node_id").alias("source_id"), F.concat(F.lit("tag:"), "tag").alias("target_id"), F.lit("has_tag").alias("type"))
    edges = resolve_links(links, keys).unionByName(supported).unionByName(has_claim).unionByName(has_tag).distinct()
    nodes = base.unionByName(claim_nodes).unionByName(tag_nodes)
    return {"nodes": nodes, "edges": edges, "tags": tags, "aliases": aliases,
            "claims": claims.select("id", "doc_id", "text", "status"), "evidence": evidence}


def claim_id(node: Column, claim: Column) -> Column:
    return F.concat(F.lit("claim:"), F.substring(F.sha1(F.concat_ws("|", node, claim)), 1, 12))


def upsert_nodes(writes: DataFrame, order: str = "seq") -> DataFrame:
    """Last write per id wins. The other tables only need `distinct`."""
    rest = [c for c in writes.columns if c not in ("id", order)]
    return writes.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("id", *[f"_r.{c}" for c in rest])


def stale(sources: DataFrame, built_at) -> DataFrame:
    """One row: newest source, and whether the derived table is fresh, stale, missing or has nothing to hold."""
    built = F.lit(built_at).cast("timestamp")
    newest = F.max("mtime")
    state = F.when(newest.isNull(), "empty").when(built.isNull(), "missing").when(built < newest, "stale").otherwise("fresh")
    return sources.agg(newest.alias("newest"), state.alias("state"))


# ------------------------------------------------------------------ browsing

def degrees(edges: DataFrame) -> DataFrame:
    """Wikilink edges touching a node; a self link counts once."""
    ends = edges.filter(F.col("type") == "wikilink").select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left").na.fill(0, ["degree"])


def broken_links(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Wikilink or supported_by edges whose target is no node, with the source's title."""
    ids = nodes.select(F.col("id").alias("target_id"))
    lost = edges.filter(F.col("type").isin(*BROKEN_TYPES)).join(ids, "target_id", "left_anti")
    named = lost.join(nodes.select(F.col("id").alias("source_id"), F.col("title").alias("source_title")), "source_id", "left") \
        .select("source_id", "source_title", F.col("target_id").alias("target_text"), "type")
    return named.orderBy("source_id", "target_text").limit(limit) if limit is not None else named


def overview(nodes: DataFrame, edges: DataFrame, tags: DataFrame, claims: DataFrame) -> DataFrame:
    """Counts as rows (measure, name, n): nodes and edges by type, claims by status, distinct tags, broken links."""
    by = lambda df, col, name: df.groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "name", "n")
    one = lambda df, expr, name: df.agg(expr.alias("n")).select(F.lit(name).alias("measure"), F.lit("").alias("name"), "n")
    return by(nodes, "type", "nodes").unionByName(by(edges, "type", "edges")).unionByName(by(claims, "status", "claims")) \
        .unionByName(one(tags, F.count_distinct("tag"), "tags")) \
        .unionByName(one(broken_links(nodes, edges, None), F.count("*"), "broken"))


def browse_nodes(nodes: DataFrame, edges: DataFrame, node_type: str | None = None, q: str | None = None, limit: int | None = None) -> DataFrame:
    """By type and substring of title or id; with a limit, the most linked. The substring is literal."""
    picked = nodes.filter(F.col("type") == node_type) if node_type else nodes
    if q:
        wanted = tx.fold_case(F.lit(q))
        picked = picked.filter(F.contains(tx.fold_case(F.col("title")), wanted) | F.contains(tx.fold_case(F.col("id")), wanted))
    found = with_degree(picked, edges).select("id", "title", "type", "category", "updated", "degree")
    return found.orderBy(F.col("degree").desc(), "id").limit(limit) if limit is not None else found


def browse_claims(claims: DataFrame, status: str | None = None, q: str | None = None, limit: int | None = None) -> DataFrame:
    picked = claims.filter(F.col("status") == status) if status else claims
    if q:
        picked = picked.filter(F.contains(tx.fold_case(F.col("text")), tx.fold_case(F.lit(q))))
    found = picked.select("id", "doc_id", "status", "text")
    return found.orderBy("id").limit(limit) if limit is not None else found


def claims_with_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim with its sources and quotes in one text, in source order."""
    line = F.concat_ws(": ", "source", "quote")
    said = evidence.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("evidence"), F.count("*").alias("n_evidence"))
    return claims.join(said, claims["id"] == said["claim_id"], "left").drop("claim_id").na.fill(0, ["n_evidence"])


def tag_counts(tags: DataFrame, q: str | None = None, limit: int | None = None) -> DataFrame:
    picked = tags.filter(F.contains(tx.fold_case(F.col("tag")), tx.fold_case(F.lit(q)))) if q else tags
    counted = picked.groupBy("tag").agg(F.count("*").alias("count"))
    return counted.orderBy(F.col("count").desc(), "tag").limit(limit) if limit is not None else counted


def hubs(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    return with_degree(nodes, edges).select("id", "title", "type", "degree").orderBy(F.col("degree").desc(), "id").limit(limit)


def find_node(nodes: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """Node by id, else title, stem or alias, case-folded; smallest id first, aliases last."""
    wanted = tx.lookup_key(F.lit(text))
    exact = nodes.filter(F.col("id") == text).select(F.lit(0).alias("tier"), "id")
    stem = md.stem(F.coalesce(F.nullif("path", F.lit("")), F.col("id")))
    named = nodes.filter((tx.lookup_key(F.col("title")) == wanted) | (tx.lookup_key(stem) == wanted)).select(F.lit(1).alias("tier"), "id")
    aka = aliases.filter(tx.lookup_key(F.col("alias")) == wanted).select(F.lit(2).alias("tier"), F.col("node_id").alias("id"))
    best = exact.unionByName(named).unionByName(aka).orderBy("tier", "id").limit(1).select("id")
    return nodes.join(best, "id", "left_semi")


def node_links(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Outgoing and incoming links of one node with the other end's title."""
    titles = nodes.select(F.col("id").alias("other_id"), "title")
    kept = edges.filter(F.col("type").isin(*LINK_TYPES))
    out = kept.filter(F.col("source_id") == node_id).select(F.lit("outgoing").alias("direction"), F.col("target_id").alias("other_id"), "type")
    back = kept.filter(F.col("target_id") == node_id).select(F.lit("incoming").alias("direction"), F.col("source_id").alias("other_id"), "type")
    return out.unionByName(back).join(titles, "other_id", "left").select("direction", "other_id", "title", "type")


def graph_map(nodes: DataFrame, edges: DataFrame, tags: DataFrame, include_tags: bool = False, limit: int = MAP_LIMIT,
              kinds: Sequence[str] | None = None, skeleton: bool = False) -> dict[str, DataFrame]:
    """Nodes and edges of the whole-graph view, plus one summary row with `truncated`.

    Unresolved targets become ghosts, which lose degree ties. A self link adds
    two. The skeleton drops ghosts, recounts and keeps 60; pinned nodes always
    stay, even over the limit.
    """
    limit = min(limit, SKELETON_LIMIT) if skeleton else limit
    real = nodes.select("id", "title", "type", "category")
    shown = real if kinds is None else real.filter(F.col("type").isin(*kinds) | (F.col("type") == "tag"))
    shown = shown if include_tags else shown.filter(F.col("type") != "tag")
    # Ids are as many as nodes: files of a few MB would pass as small, and every task would hold them all.
    ids = shown.select("id").hint("merge")
    live = edges.filter(F.col("type").isin(*LINK_TYPES)).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    hit = live.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    lost = live.filter(F.col("type").isin(*BROKEN_TYPES)).join(real.select(F.col("id").alias("target_id")).hint("merge"), "target_id", "left_anti")
    points, lines = shown, hit.select("source_id", "target_id", "type")
    if not skeleton:
        ghosts = lost.select(F.col("target_id").alias("id")).distinct().select(
            "id", F.col("id").alias("title"), F.lit("ghost").alias("type"), F.lit("").alias("category"))
        points, lines = points.unionByName(ghosts), lines.unionByName(lost.select("source_id", "target_id", "type"))
    ends = lines.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("d"))
    if include_tags:
        tagging = edges.filter(F.col("type") == "has_tag") \
            .join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi") \
            .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "type")
        lines = lines.unionByName(tagging)
        per_tag = tagging.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("dt"))
        degree = degree.join(per_tag, "id", "full_outer")
    else:
        degree = degree.withColumn("dt", F.lit(None).cast("bigint"))
    is_tag = F.col("type") == "tag"
    ranked = points.join(degree.hint("merge"), "id", "left").withColumn("degree", F.coalesce(F.when(is_tag, F.col("dt")).otherwise(F.col("d")), F.lit(0))).drop("d", "dt")
    pins = tags.filter(F.col("tag") == PIN).select(F.col("node_id").alias("id")).distinct().withColumn("pinned", F.lit(True))
    ranked = ranked.join(pins, "id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    top = ranked.orderBy(F.col("pinned").desc(), F.col("degree").desc(), (F.col("type") == "ghost"), "id").limit(limit)
    # At most `limit` rows and the pins: stored once, then read by nodes and edges.
    kept = cut_lineage(top.unionByName(ranked.filter("pinned")).distinct())
    inside = kept.select("id")
    kept_lines = lines.join(inside.withColumnRenamed("id", "source_id"), "source_id", "left_semi") \
        .join(inside.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "type").distinct()
    summary = points.agg(F.count("*").alias("nodes"), (F.count("*") > limit).alias("truncated"))
    return {"nodes": kept, "edges": kept_lines, "summary": summary}


# ------------------------------------------------------------------ trees, SQL

def subtree(collections: DataFrame, name: str | None = None, root_id: int | None = None) -> DataFrame:
    """Collections under the roots, roots included: id, depth, roots.

    All same-named roots count; `roots` > 1 is the caller's warning. One join
    per level, so the work follows the depth of the tree.
    """
    tree = collections.select(F.col("collectionID").alias("id"), F.col("parentCollectionID").alias("parent"), F.col("collectionName").alias("name"))
    start = tree.filter(F.col("id") == root_id) if root_id is not None else tree.filter(F.col("name") == name)
    frontier = cut_lineage(start.select("id", F.lit(0).alias("depth")))
    roots = frontier.count()
    found, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        below = tree.join(frontier.select(F.col("id").alias("parent")), "parent").select("id").distinct()
        frontier = cut_lineage(below.join(found.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(frontier)
    return found.withColumn("roots", F.lit(roots))


# Classes of parsed statements that are no queries.
NO_QUERY = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
# Functions that call arbitrary JVM code.
CALLS_OUT = ("reflect", "java_method", "try_reflect")


def read_only_sql(spark: SparkSession, tables: dict[str, DataFrame], query: str) -> DataFrame:
    """User SQL over the graph tables. Anything but a query is refused before it runs.

    The text must parse by itself, its root must be no statement, and it runs
    as a subquery, where the grammar admits queries only. Tables are visible to
    it alone: they stand under names of their own while it is analysed, so the
    session's views of the same names stay as they are and do not show through.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except ParseException as error:
        raise ValueError("no valid SQL") from error
    kinds = [spark._jvm.java.lang.Class.forName(name) for name in NO_QUERY]
    if any(kind.isInstance(plan) for kind in kinds) or re.search(rf"'({'|'.join(CALLS_OUT)})\(", plan.toString(), re.I):
        raise ValueError("only queries are allowed here")
    names = {name: f"{name}_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(names[name])
        given = ", ".join(f"`{name}` AS (SELECT * FROM `{view}`)" for name, view in names.items())
        return spark.sql(f"WITH {given} SELECT * FROM (\n{query.strip().rstrip(';')}\n)")
    except ParseException as error:
        raise ValueError("only queries are allowed here") from error
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def repair_links(docs: DataFrame, cards: DataFrame, files: DataFrame, text: str = "text") -> DataFrame:
    """Broken Markdown links: path, link, problem (alias or missing), suggestion by alias."""
    links = docs.filter(F.substring_index("path", "/", 1).isin("wiki", "drafts")) \
        .select("path", F.explode(F.array_distinct(md.markdown_links(F.col(text)))).alias("link")).filter(md.is_local_markdown_link(F.col("link")))
    target = md.resolve_relative(md.dirname(F.col("path")), F.substring_index("link", "#", 1))
    broken = links.withColumn("target", target).join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti")
    alias_key = F.regexp_replace(F.lower("alias"), "[ -]", "_")
    aka = cards.filter(F.element_at(F.split("path", "/"), -2) == "concepts") \
        .select(md.basename(F.col("path")).alias("new_name"), F.explode("aliases").alias("alias")) \
        .groupBy(alias_key.alias("key")).agg(F.max("new_name").alias("new_name"))
    fixed = broken.withColumn("key", md.stem(F.col("target"))).join(aka, "key", "left")
    new = F.replace(F.col("link"), md.basename(F.col("target")), F.col("new_name"))
    return fixed.select("path", "link", F.when(F.col("new_name").isNotNull(), "alias").otherwise("missing").alias("problem"), new.alias("suggestion"))


def card_reference_check(docs: DataFrame, cards: DataFrame, text: str = "text") -> DataFrame:
    """Wikilinks per document, valid or not: a concept or reference under any of three spellings."""
    names = cards.filter(F.col("path").rlike(r"^wiki/(concepts|references)/[^/]+\.md$")).select(md.stem(F.col("path")).alias("name")).distinct()
    links = docs.select("path", F.explode(F.array_distinct(md.wikilinks(F.col(text)))).alias("link"))
    spelled = links.withColumn("name", F.explode(F.array_distinct(F.array(
        tx.slug_uncapped(F.col("link")), F.replace("link", F.lit(" "), F.lit("_")), F.col("link")))))
    hit = spelled.join(names.withColumn("_ok", F.lit(True)), "name", "left")
    return hit.groupBy("path", "link").agg(F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("valid"))
