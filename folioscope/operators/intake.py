"""Bibliographic intake: items, routes, queue, batches, exports, audits."""

from __future__ import annotations

from collections.abc import Sequence

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import identifiers as ids, markup as md, text as tx
from .graph import subtree
from .quality import loud_findings

# Item fields, excluded item types, the fallback ladder.
FIELDS = ("title", "DOI", "url", "extra", "archiveID", "date")
NOT_ITEMS = ("attachment", "note", "annotation")
LADDER = ("arxiv-html", "tex", "textlayer", "mineru", "ocr")
DECISIONS = ("approve", "reject")


# ------------------------------------------------------------------ items

def items(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per bibliographic item with its fields side by side.

    `tables`: items, itemTypes, itemData, fieldsCombined, itemDataValues. The
    field list is fixed, so the pivot is one aggregate without a pre-pass.
    """
    kept = tables["items"].join(tables["itemTypes"].filter(~F.col("typeName").isin(*NOT_ITEMS)), "itemTypeID")
    wanted = tables["fieldsCombined"].filter(F.col("fieldName").isin(*FIELDS))
    values = tables["itemData"].join(wanted, "fieldID").join(tables["itemDataValues"], "valueID").select("itemID", "fieldName", "value")
    wide = values.groupBy("itemID").pivot("fieldName", list(FIELDS)).agg(F.max("value"))
    return kept.select("itemID", "key", "typeName").join(wide, "itemID", "left")


def attachments(item_attachments: DataFrame, items_table: DataFrame) -> DataFrame:
    """First stored PDF per parent: parentItemID, pdf_path."""
    name = F.substring(F.col("path"), len("storage:") + 1, 100000)
    kind = F.lower(F.coalesce("contentType", F.lit("")))
    stored = item_attachments.filter(F.col("parentItemID").isNotNull() & F.col("path").startswith("storage:") & kind.isin("application/pdf", "")) \
        .withColumn("_name", name).filter((F.col("_name") != "") & (F.col("_name") != "undefined")).join(items_table.select("itemID", "key"), "itemID")
    path = F.concat_ws("/", F.lit("storage"), "key", "_name")
    return stored.groupBy("parentItemID").agg(F.min_by(path, "itemID").alias("pdf_path"))


def item_arxiv_id(archive: Column, extra: Column, url: Column, doi: Column) -> Column:
    """Archive field, then extra, then address, then an arXiv DOI."""
    return F.coalesce(ids.normalize_arxiv_id(archive), ids.normalize_arxiv_id(extra), ids.normalize_arxiv_id(url),
                      F.when(F.lower(doi).contains("arxiv"), ids.normalize_arxiv_id(doi)))


def select_items(items_df: DataFrame, collections: DataFrame | None = None, members: DataFrame | None = None, name: str | None = None,
                 collection_id: int | None = None, item_tags: DataFrame | None = None, tags: DataFrame | None = None,
                 tag: str | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Collection subtree AND tag AND keys, as chained semi joins."""
    out = items_df
    if name is not None or collection_id is not None:
        tree = subtree(collections, name, collection_id).select(F.col("id").alias("collectionID"))
        out = out.join(members.join(tree, "collectionID", "left_semi").select("itemID"), "itemID", "left_semi")
    if tag is not None:
        out = out.join(item_tags.join(tags.filter(F.col("name") == tag), "tagID", "left_semi").select("itemID"), "itemID", "left_semi")
    if keys is not None:
        out = out.filter(F.col("key").isin(*keys))
    return out


def coverage(items_df: DataFrame) -> DataFrame:
    """What can be fetched, in one row. `items_df`: arxiv_id, doi, pdf_path."""
    a, d, p = (F.coalesce(F.length(c), F.lit(0)) > 0 for c in ("arxiv_id", "doi", "pdf_path"))
    return items_df.agg(F.count("*").alias("total"), F.count_if(a).alias("arxiv"), F.count_if(p).alias("pdf"), F.count_if(a & p).alias("both"),
                        F.count_if(p & ~a).alias("pdf_only"), F.count_if(d & ~a).alias("doi_only"), F.count_if(~a & ~d & ~p).alias("nothing"))


def library_profile(items_table: DataFrame, item_types: DataFrame, collections: DataFrame) -> DataFrame:
    """Items, collections and the newest date added."""
    kept = items_table.join(item_types.filter(~F.col("typeName").isin(*NOT_ITEMS)), "itemTypeID", "left_semi").agg(F.count("*").cast("string").alias("value"))
    n = collections.agg(F.count("*").cast("string").alias("value"))
    newest = items_table.agg(F.max("dateAdded").cast("string").alias("value"))
    name = lambda df, label: df.select(F.lit(label).alias("measure"), "value")
    return name(kept, "items").unionByName(name(n, "collections")).unionByName(name(newest, "latest"))


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Direct members per collection."""
    counted = members.groupBy("collectionID").agg(F.count("*").alias("n"))
    return collections.join(counted, "collectionID", "left").na.fill(0, ["n"]).orderBy("collectionName", "collectionID")


# ------------------------------------------------------------------ routes

def source_type(value: Column) -> Column:
    """url, doi, arxiv or file."""
    return (F.when(value.rlike("(?i)^https?://"), "url").when(value.rlike(r"(?i)^(?:doi:)?10\.\d{4,9}/"), "doi")
            .when(ids.normalize_arxiv_id(value).isNotNull(), "arxiv").otherwise("file"))


def starting_route(value: Column) -> Column:
    """First rung for a source: rendered paper for identities, source for TeX, text layer for PDFs; text needs none."""
    kind, low = source_type(value), F.lower(value)
    return (F.when(kind.isin("url", "doi", "arxiv"), "arxiv-html").when(low.rlike(r"\.(tex|tar\.gz|tgz)$"), "tex")
            .when(low.rlike(r"\.(md|markdown|txt)$"), None).otherwise("textlayer"))


def plan_routes(items_df: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """How each item is acquired: arXiv, else stored PDF, else DOI, else skipped."""
    df = items_df
    found = F.lit(None).cast("string")
    if resolved is not None:
        df = df.withColumn("_doi", F.lower("doi")).join(resolved.groupBy(F.lower("doi").alias("_doi")).agg(F.max("arxiv_id").alias("_found")), "_doi", "left")
        found = F.col("_found")
    full = lambda c: F.nullif(c, F.lit(""))
    arxiv, pdf, doi = full(F.coalesce(full(F.col("arxiv_id")), found)), full(F.col("pdf_path")), full(F.col("doi"))
    kind = F.when(arxiv.isNotNull(), "arxiv").when(pdf.isNotNull(), "file").when(doi.isNotNull(), "doi")
    return df.select(*[c for c in items_df.columns if c not in ("source_type", "value")], kind.alias("source_type"), F.coalesce(arxiv, pdf, doi).alias("value"))


def next_rung(route: Column) -> Column:
    out = F.lit(None).cast("string")
    for here, below in zip(LADDER, LADDER[1:]):
        out = F.when(route == here, F.lit(below)).otherwise(out)
    return out


def route_summary(pages: DataFrame, value: str = "value") -> DataFrame:
    return pages.groupBy(source_type(F.col(value)).alias("source_type"), F.coalesce(starting_route(F.col(value)), F.lit("none")).alias("route")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ queue and batches

def pending(queue: DataFrame, batch_events: DataFrame) -> DataFrame:
    """Requests no batch has claimed."""
    claimed = batch_events.filter((F.col("kind") == "item") & F.col("req_id").isNotNull()).select("req_id").distinct()
    return queue.join(claimed, "req_id", "left_anti")


def admit_requests(incoming: DataFrame, queue: DataFrame, batch_events: DataFrame) -> DataFrame:
    """Requests to append: the first per source that is not already waiting; retries always pass.

    `incoming` and `queue`: seq, req_id, source_type, value, retry_of.
    """
    key = ["source_type", "value"]
    waiting = pending(queue, batch_events).filter(F.col("retry_of").isNull()).select(*key).distinct()
    plain = incoming.filter(F.col("retry_of").isNull())
    first = plain.groupBy(*key).agg(F.min("seq").alias("seq"))
    fresh = plain.join(first, [*key, "seq"], "left_semi").join(waiting, key, "left_anti")
    return fresh.unionByName(incoming.filter(F.col("retry_of").isNotNull()))


def repeat_requests(incoming: DataFrame, queue: DataFrame, batch_events: DataFrame) -> DataFrame:
    """Requests whose source is still waiting; retries are exempt."""
    waiting = pending(queue, batch_events).filter(F.col("retry_of").isNull()).select("source_type", "value").distinct()
    return incoming.filter(F.col("retry_of").isNull()).join(waiting, ["source_type", "value"], "left_semi")


def batch_items(events: DataFrame) -> DataFrame:
    """Items of every batch with the latest decision and commit. One aggregate over the log."""
    kind = F.col("kind")
    facts = [c for c in ("req_id", "route", "source_type", "source_value", "title", "arxiv_id", "findings", "error", "retry_of") if c in events.columns]
    pick = lambda name, value: F.max_by(F.when(kind == name, value), F.when(kind == name, F.col("seq")))
    folded = events.groupBy("batch", "item_id").agg(
        pick("item", F.struct(*facts)).alias("_item"), pick("decision", F.col("decision")).alias("decision"),
        pick("commit", F.col("committed_path")).alias("committed_path"), F.count_if(kind == "item").alias("_n"))
    decision = F.when(F.col("decision") != "reset", F.col("decision"))
    return folded.filter(F.col("_n") > 0).select("batch", "item_id", *[F.col("_item")[c].alias(c) for c in facts], decision.alias("decision"), "committed_path")


def is_decided(decision: Column) -> Column:
    return F.coalesce(decision.isin(*DECISIONS), F.lit(False))


def review_order(batch: DataFrame) -> DataFrame:
    """Undecided first, more loud findings first, then id."""
    return batch.withColumn("loud", loud_findings(F.col("findings"))).withColumn("decided", is_decided(F.col("decision"))) \
        .orderBy("decided", F.col("loud").desc(), "item_id")


def batch_summary(batch: DataFrame) -> DataFrame:
    """Items, undecided, committed, failed and commit-blocking per batch."""
    decided, done = is_decided(F.col("decision")), F.coalesce(F.length("committed_path"), F.lit(0)) > 0
    return batch.groupBy("batch").agg(F.count("*").alias("items"), F.count_if(~decided).alias("undecided"), F.count_if(done).alias("committed"),
                                      F.count_if(F.coalesce(F.length("error"), F.lit(0)) > 0).alias("failed"), F.count_if(~decided & ~done).alias("blocking"))


def spawn_counts(spawns: DataFrame, every: int = 25) -> DataFrame:
    """Spawns per session and how many alerts that made."""
    return spawns.groupBy("session").agg(F.count("*").alias("spawns")).withColumn("alerts", F.floor(F.col("spawns") / every))


def retained(rows: DataFrame, now, days: int = 7) -> DataFrame:
    """Rows young enough to keep; undated rows stay."""
    return rows.filter(F.col("at").isNull() | (F.col("at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))))


def weekly_spend(calls: DataFrame) -> DataFrame:
    """Calls per ISO week, kind and tier; failed calls count too."""
    from ..functions.dates import week_of
    return calls.filter(F.col("at").isNotNull()).groupBy(week_of(F.col("at")).alias("week"), "kind", "tier").agg(
        F.count("*").alias("spent"), F.count_if(~F.coalesce(F.col("ok"), F.lit(True))).alias("failed"))


def calls_in_week(calls: DataFrame, week: str, kind: str | None = None) -> DataFrame:
    from ..functions.dates import week_of
    picked = calls.filter(F.col("at").isNotNull() & (week_of(F.col("at")) == week))
    return (picked.filter(F.col("kind") == kind) if kind else picked).agg(F.count("*").alias("spent"))


# ------------------------------------------------------------------ audits and exports

def title_audit(extracted: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards whose title differs from the one last extracted for their arXiv id.

    `extracted`: batch, arxiv_id, title. `cards`: path, arxiv_id, title.
    """
    said = extracted.filter(F.col("title").isNotNull()).groupBy("arxiv_id").agg(F.max_by("title", "batch").alias("extracted"))
    return cards.select("path", "arxiv_id", "title").join(said, "arxiv_id").filter(~ids.same_title(F.col("title"), F.col("extracted")))


def backlog(uncompiled: DataFrame, tracked: DataFrame, topic: str) -> DataFrame:
    """Uncompiled sources no tracked title names, current or legacy form, closed ones included."""
    legacy = F.concat(F.lit("Compile raw source: "), F.col("path"))
    titled = uncompiled.withColumn("legacy", legacy).withColumn("title", F.concat(F.lit(f"[{topic}] "), legacy))
    known = tracked.select("title").distinct()
    return titled.join(known, "title", "left_anti").join(known.withColumnRenamed("title", "legacy"), "legacy", "left_anti").select("path", "title")


def bib_entries(cards: DataFrame) -> DataFrame:
    """Bibliography text per reference card: path, entry. `authors` is a list."""
    safe = lambda c: F.trim(F.regexp_replace(F.col(c).cast("string"), r"([{}])", r"\\$1"))
    venue = F.coalesce(F.nullif("venue", F.lit("")), F.nullif("journal", F.lit("")))
    with_venue = cards.withColumn("_venue", venue)
    slug = F.regexp_replace(md.stem(F.col("path")), r"[^\p{L}\p{N}_-]", "-")
    last = F.lower(F.regexp_replace(F.element_at(F.split(F.trim(F.element_at("authors", 1)), r"\s+"), -1), "[^A-Za-z0-9]", ""))
    has_authors = F.coalesce(F.size("authors"), F.lit(0)) > 0
    key = F.when(has_authors, F.concat(F.coalesce(F.nullif(last, F.lit("")), slug), F.coalesce(F.col("year").cast("string"), F.lit("")))).otherwise(slug)
    line = lambda name, value, cond: F.when(cond, F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    full = lambda c: F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) > 0
    address = F.coalesce(F.nullif("url", F.lit("")), F.when(F.col("source").rlike("^https?://"), F.col("source")))
    fields = F.filter(F.array(
        line("title", safe("title"), full("title")),
        line("author", F.array_join(F.transform("authors", lambda a: F.trim(F.regexp_replace(a, r"([{}])", r"\\$1"))), " and "), has_authors),
        line("year", safe("year"), full("year")), line("journal", safe("_venue"), full("_venue")), line("doi", safe("doi"), full("doi")),
        line("eprint", safe("arxiv_id"), full("arxiv_id")), F.when(full("arxiv_id"), F.lit("  archivePrefix = {arXiv}")),
        F.when(full("arxiv_id"), F.concat(F.lit("  url = {https://arxiv.org/abs/"), safe("arxiv_id"), F.lit("}")))
        .otherwise(line("url", address, address.isNotNull()))), lambda x: x.isNotNull())
    entry = F.concat(F.lit("@"), F.when(full("_venue"), "article").otherwise("misc"), F.lit("{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))
    return with_venue.select("path", F.when(F.size(fields) > 0, entry).alias("entry")).filter(F.col("entry").isNotNull())


def similar_names(names: DataFrame, probes: Sequence[str], ratio: float = 0.82, share: float = 0.65) -> DataFrame:
    """(probe, name) pairs: equal, ratio ≥ 0.82, or a prefix or suffix of at least 0.65 of the longer.

    Probes are the caller's few new names; each stored name is compared where it
    lies, and cheap upper bounds come before the exact ratio.
    """
    probes = list(probes)

    def alike(a: str, b: str, matcher: difflib.SequenceMatcher) -> bool:
        short, long = sorted((a, b), key=len)
        if a == b or (long and len(short) / len(long) >= share and (long.startswith(short) or long.endswith(short))):
            return True
        return matcher.real_quick_ratio() >= ratio and matcher.quick_ratio() >= ratio and matcher.ratio() >= ratio

    def run(series: pd.Series) -> pd.Series:
        out = []
        for name in series:
            matcher = difflib.SequenceMatcher(None, "", name)
            found = []
            for i, probe in enumerate(probes):
                matcher.set_seq1(probe)
                if alike(probe, name, matcher):
                    found.append(i)
            out.append(found)
        return pd.Series(out)

    hits = names.select("name").distinct().withColumn("_i", F.explode(F.pandas_udf(run, "array<int>")("name")))
    return hits.select(F.element_at(F.lit(probes), F.col("_i") + 1).alias("probe"), "name")
