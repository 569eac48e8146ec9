"""Discovery: feeds to candidates, unseen and relevant ones, budget, triage, citation gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import identifiers as ids, text as tx

CANDIDATE_CAP, SEED_CAP = 40, 50


# ------------------------------------------------------------------ feeds

def _paper(df: DataFrame, source: str) -> DataFrame:
    """Common shape of a paper record: title, year, abstract, url, paperId, externalIds, authors."""
    title = tx.squash(F.coalesce("title", F.lit("")))
    arxiv, doi = F.col("externalIds.ArXiv"), F.col("externalIds.DOI")
    bare = F.col("year").isNull() & (F.coalesce(F.length("abstract"), F.lit(0)) == 0) & (F.col("externalIds").isNull() | (arxiv.isNull() & doi.isNull()))
    return df.filter((title != "") & ~bare).select(
        *[c for c in ("query", "pos") if c in df.columns],
        F.coalesce(arxiv, doi, F.col("paperId")).alias("id"), arxiv.alias("arxiv_id"), doi.alias("doi"), title.alias("title"),
        F.col("year").cast("int").alias("year"), tx.squash(F.coalesce("abstract", F.lit(""))).alias("abstract"),
        "url", F.lit(source).alias("source"), F.lit(None).cast("date").alias("published"),
        F.filter(F.transform(F.coalesce("authors", F.array()), lambda a: a["name"]), lambda n: F.length(n) > 0).alias("authors"))


def recommendations(landed: DataFrame) -> DataFrame:
    """Recommendation feed; records nobody could triage are dropped."""
    return _paper(landed, "s2-recommendation")


def keyword_feed(landed: DataFrame, limit: int, queries: int, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Keyword feed: each query gets limit ÷ queries records, in answer order. `landed` has query and pos."""
    per_query = max(1, limit // max(1, queries))
    shaped = _paper(landed, "s2-keyword")
    if first_year is not None:
        shaped = shaped.filter(F.col("year") >= first_year)
    if last_year is not None:
        shaped = shaped.filter(F.col("year") <= last_year)
    rank = F.row_number().over(W.partitionBy("query").orderBy("pos"))
    return shaped.withColumn("_r", rank).filter(F.col("_r") <= per_query).drop("_r", "query", "pos")


def new_listings(entries: DataFrame, now, days: int) -> DataFrame:
    """New-listing feed: unreadable or old dates dropped, version suffix off. `entries`: category, id, title, published, summary, authors."""
    at = F.try_to_timestamp(F.col("published"))
    arxiv = F.regexp_replace(F.regexp_extract("id", r"arxiv\.org/abs/(.+)$", 1), r"v\d+$", "")
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return entries.withColumn("_at", at).withColumn("_id", arxiv) \
        .filter((F.col("_id") != "") & F.col("title").isNotNull() & (F.col("_at") >= cutoff)).select(
            F.col("_id").alias("id"), F.col("_id").alias("arxiv_id"), F.lit(None).cast("string").alias("doi"), tx.squash(F.col("title")).alias("title"),
            F.year("_at").alias("year"), tx.squash(F.coalesce("summary", F.lit(""))).alias("abstract"),
            F.concat(F.lit("https://arxiv.org/abs/"), "_id").alias("url"), F.concat(F.lit("arxiv-new:"), "category").alias("source"),
            F.to_date("_at").alias("published"), "authors")


def candidate_union(*feeds: DataFrame) -> DataFrame:
    """Feeds in order, with the feed's rank."""
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn("feed", F.lit(i)) for i, f in enumerate(feeds)])


# ------------------------------------------------------------------ choosing

def unseen(candidates: DataFrame, seen: DataFrame, held: DataFrame | None = None, order: Sequence[str] = ("feed",)) -> DataFrame:
    """First record per id that is neither in the seen log nor, by arXiv id, in the library."""
    rest = [c for c in candidates.columns if c != "id"]
    fresh = candidates.filter(F.col("id").isNotNull()).join(seen.select("id").distinct(), "id", "left_anti")
    if held is not None:
        fresh = fresh.join(held.select("arxiv_id").distinct(), "arxiv_id", "left_anti")
    first = fresh.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select("id", *[f"_r.{c}" for c in rest])


def relevant(candidates: DataFrame, floor: float | None = None) -> DataFrame:
    """Relevance floor; unset keeps all, and a candidate without a score stays."""
    return candidates if floor is None else candidates.filter(F.col("score").isNull() | (F.col("score") >= floor))


def apply_budget(candidates: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    """At most `cap`, with a fair share for new listings; input order (`pos`) kept.

    min(listings, cap ÷ 2) places are filled by turns between categories in the
    order they first appear; the rest go by position. Only tables of at most
    `cap` rows are ordered globally.
    """
    half = cap // 2
    listed = candidates.filter(F.col("source").startswith("arxiv-new"))
    turns = listed.select("pos", "source").withColumn("turn", F.row_number().over(W.partitionBy("source").orderBy("pos"))).filter(F.col("turn") <= half)
    opened = listed.groupBy("source").agg(F.min("pos").alias("first"))
    shared = turns.join(opened, "source").orderBy("turn", "first").limit(half).select("pos")
    rest = candidates.join(shared, "pos", "left_anti").orderBy("pos").limit(cap).select("pos")
    picked = shared.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1))).orderBy("tier", "pos").limit(cap).select("pos")
    return candidates.join(picked, "pos", "left_semi").orderBy("pos")


def seeds(configured: Sequence[str], library: DataFrame, limit: int = SEED_CAP) -> DataFrame:
    """Configured ids first, then the library's in order; distinct, first `limit`."""
    spark = library.sparkSession
    named = spark.createDataFrame([(i, c) for i, c in enumerate(configured)], "pos int, arxiv_id string").select(F.lit(0).alias("rank"), "pos", "arxiv_id")
    held = library.select(F.lit(1).alias("rank"), F.lit(0).alias("pos"), "arxiv_id")
    return named.unionByName(held).groupBy("arxiv_id").agg(F.min(F.struct("rank", "pos")).alias("k")).orderBy("k", "arxiv_id").limit(limit).select("arxiv_id")


# ------------------------------------------------------------------ triage

def triage_state(log: DataFrame) -> DataFrame:
    """Last decision per candidate of a report; a reset clears it."""
    return log.groupBy("report", "id").agg(F.max_by("decision", "seq").alias("decision")).filter(F.col("decision") != "reset")


def decisions_so_far(log: DataFrame) -> DataFrame:
    """Decision per candidate across reports: the oldest report's wins."""
    return triage_state(log).groupBy("id").agg(F.min_by("decision", "report").alias("decision"), F.min("report").alias("report"))


def triage_progress(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates with an id, decided and undecided, per report."""
    rows = candidates.filter(F.col("id").isNotNull()).select("report", "id").distinct().join(triage_state(log), ["report", "id"], "left")
    return rows.groupBy("report").agg(F.count("*").alias("candidates"), F.count("decision").alias("decided"),
                                      F.count_if(F.col("decision").isNull()).alias("undecided"))


def pending_reports(reports: DataFrame) -> DataFrame:
    """Reports still open, newest name first."""
    return reports.filter(F.col("status") == "pending-review").orderBy(F.col("name").desc())


def radar_status(seen: DataFrame, reports: DataFrame, today) -> DataFrame:
    """Counts as rows (measure, value): seen, pending by kind, last harvest age in days."""
    n = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")
    kinds = reports.filter(F.col("status") == "pending-review").groupBy("kind").agg(F.count("*").alias("value")) \
        .select(F.concat(F.lit("pending "), "kind").alias("measure"), "value")
    return n(seen, "seen").unionByName(kinds).unionByName(
        last_harvest(seen, today).select(F.lit("days since harvest").alias("measure"), F.col("days").cast("bigint").alias("value")))


def last_harvest(seen: DataFrame, today) -> DataFrame:
    return seen.agg(F.max("first_seen").alias("last")).withColumn("days", F.datediff(F.lit(today).cast("date"), "last"))


# ------------------------------------------------------------------ citation gaps

def _bit(work: str) -> Column:
    """One of 64 bits by the hash of a work; null for none."""
    return F.expr(f"shiftleft(1L, cast(pmod(xxhash64({work}), 64) as int))")


def _marks(cited: DataFrame) -> DataFrame:
    """paper_id, _mark, _works, _over: the bits of the works it cites, how many those are, and how many of them fell on a bit that was set."""
    marks = cited.groupBy("paper_id").agg(F.bit_or(_bit("cited_id")).alias("_mark"), F.count("*").alias("_works"))
    return marks.withColumn("_over", F.col("_works") - F.bit_count("_mark"))


def citation_gaps(own: DataFrame, neighbours: DataFrame, citations: DataFrame, references: DataFrame, since_year: int,
                  min_shared: int = 3, budget: int | None = None) -> DataFrame:
    """Neighbours of our papers that share references with them and do not cite them.

    `own`: paper_id; `neighbours`: paper_id, candidate_id, pos, year, title;
    `citations`: paper_id, citing_id; `references`: paper_id, cited_id,
    cited_title. The neighbours are fixed first. Two papers share at most as
    many works as their marks have bits in common, and those that fell on one
    bit: a pair is shuffled with its mark, once, and written out by references
    only where that bound is large enough. Neighbours that are dealt by
    paper_id already are not dealt again. Then references meet on (paper,
    cited), and a reference everybody cites pairs nothing up. They meet once;
    counts and titles come from one aggregate. `budget` limits the neighbours
    looked at per paper; by default all are, and then the rows of `own` and
    `citations` meet the gaps instead of the neighbours. Neighbours and
    citations often come from lists, whose rows Spark counts as one each: the
    joins are sort-merge joins, since a broadcast would go by that size.
    """
    facts = [c for c in ("year", "title") if c in neighbours.columns]
    least = max(min_shared, 1)

    def eligible(rows: DataFrame) -> DataFrame:
        # No semi or anti join: the optimiser would move those below the joins that leave few pairs.
        citers = citations.select("paper_id", F.col("citing_id").alias("candidate_id")).distinct().withColumn("_cites", F.lit(True))
        known = rows.join(own.select("paper_id").distinct().hint("merge"), "paper_id")
        return known.join(citers.hint("merge"), ["paper_id", "candidate_id"], "left").filter(F.col("_cites").isNull()).drop("_cites")

    near = neighbours.filter(F.col("year") >= since_year)
    if budget is not None:
        near = eligible(near).withColumn("_r", F.row_number().over(W.partitionBy("paper_id").orderBy("pos"))).filter(F.col("_r") <= budget)
    cited = references.dropna(subset=["paper_id", "cited_id"]).groupBy("paper_id", "cited_id").agg(F.max("cited_title").alias("cited_title"))
    marks = _marks(cited)
    pairs = near.select("paper_id", "candidate_id", *facts).join(marks.select("paper_id", "_mark", "_works").hint("merge"), "paper_id")
    pairs = pairs.groupBy("_mark", "paper_id", "candidate_id", "_works").agg(F.count("*").alias("_times"), *[F.max(c).alias(c) for c in facts])
    pairs = pairs.filter(F.col("_times") * F.col("_works") >= least).drop("_works")
    theirs = marks.select(F.col("paper_id").alias("candidate_id"), F.col("_mark").alias("_theirs"), "_over")
    most = F.col("_times") * (F.bit_count(F.col("_mark").bitwiseAND(F.col("_theirs"))) + F.col("_over"))
    likely = pairs.join(theirs.hint("merge"), "candidate_id").filter(most >= least)
    works = likely.join(cited.select(F.col("paper_id").alias("candidate_id"), "cited_id").hint("merge"), "candidate_id") \
        .filter(F.col("_mark").bitwiseAND(_bit("cited_id")) != 0).select("paper_id", "candidate_id", "cited_id", "_times", *facts)
    title = F.nullif(F.trim("cited_title"), F.lit(""))
    titles = F.flatten(F.collect_list(F.when(title.isNotNull(), F.array_repeat(title, F.col("_times").cast("int")))))
    shared = works.join(cited.hint("merge"), ["paper_id", "cited_id"]).groupBy("paper_id", "candidate_id").agg(
        F.sum("_times").alias("shared"), *[F.max(c).alias(c) for c in facts], F.array_sort(titles).alias("shared_titles"))
    gaps = shared.filter(F.col("shared") >= min_shared)
    return gaps if budget is not None else eligible(gaps)


def shared_references(references: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared reference count for given (a, b) pairs of papers."""
    refs = references.select("paper_id", "cited_id").distinct()
    left = pairs.join(refs.select(F.col("paper_id").alias("a"), "cited_id").hint("merge"), "a")
    return left.join(refs.select(F.col("paper_id").alias("b"), "cited_id").hint("merge"), ["b", "cited_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"))


def gap_groups(gaps: DataFrame) -> DataFrame:
    """Per candidate: pairs, strongest overlap and its anchor. Papers are rows, pairs a column."""
    return gaps.groupBy("candidate_id").agg(F.count("*").alias("pairs"), F.max("shared").alias("best"),
                                            F.min_by("paper_id", F.struct((-F.col("shared")).alias("s"), "paper_id")).alias("anchor"))


def gap_anchors(gaps: DataFrame) -> DataFrame:
    """(candidate, paper) rows with the anchor's rank, strongest first; long rather than one list per candidate."""
    return gaps.select("candidate_id", "paper_id", "shared").orderBy("candidate_id", F.col("shared").desc(), "paper_id")


# ------------------------------------------------------------------ reports

def report_rows_sql(text: str) -> str:
    """SQL expression: array of (index, title, id, arxiv_id, url, relevance, authors, abstract) of a report's sections.

    A section goes from its heading to the next. The last line of a kind holds, of the addresses the first.
    """
    def every(pattern: str) -> str:
        return f"regexp_extract_all(s, r'{pattern}', 1)"

    def last(pattern: str) -> str:
        return f"get(reverse({every(pattern)}), 0)"

    def unversioned(x: str) -> str:
        return rf"regexp_replace({x}, r'v\d+$', '')"

    named = r"(?m)^- id: `([^`\n]+)`"
    candidate = unversioned(f"get({every(r'(?m)^- candidate: [^\n]*?arXiv:([\w.-]+)')}, 0)")
    page = unversioned(f"get({every(r'(?m)^- https?://\S*?arxiv[.]org/abs/([\w.-]+)\S*\s*$')}, 0)")
    names = f"split(coalesce({last('(?m)^- authors: ([^\\n]+)$')}, ''), ', ')"
    fields = {
        "index": "i", "title": r"regexp_extract(s, r'^##\s+([^\n]+?)\s*(?:\n|$)', 1)",
        "id": f"coalesce({last(named)}, {candidate})", "arxiv_id": f"coalesce(if(array_size({every(named)}) = 0, {candidate}, null), {page})",
        "url": f"get({every(r'(?m)^- (https?://\S+)\s*$')}, 0)",
        "relevance": f"cast({last(r'(?m)^- id: `[^`\n]+`[^\n]*?relevance: (-?\d+(?:[.]\d+)?)')} as double)",
        "authors": f"transform(array({names}), a -> filter(if(get(a, array_size(a) - 1) = 'et al.', slice(a, 1, array_size(a) - 1), a), n -> n <> ''))[0]",
        "abstract": f"trim({last('(?m)^- abstract: ([^\\n]+)$')})"}
    sections = rf"filter(split({text}, r'(?m)^(?=##[^\S\n]+\S)', -1), s -> s rlike r'^##[^\S\n]+\S')"
    return f"transform({sections}, (s, i) -> named_struct({', '.join(f"'{n}', {x}" for n, x in fields.items())}))"


def report_candidates(reports: DataFrame, text: str = "text") -> DataFrame:
    """Candidate rows of every report, in report order."""
    return reports.select(*[c for c in reports.columns if c != text], F.inline(F.expr(report_rows_sql(f"`{text}`"))))


def enrich_dois(items: DataFrame, lookup: DataFrame) -> DataFrame:
    """arXiv id by DOI with a title guard. `items`: doi, title; `lookup`: doi, arxiv_id, title."""
    table = lookup.groupBy(F.lower("doi").alias("_doi")).agg(F.max_by(F.struct("arxiv_id", "title"), "arxiv_id").alias("_l"))
    joined = items.withColumn("_doi", F.lower("doi")).join(table, "_doi", "left")
    ok = F.col("_l").isNotNull() & ids.titles_match(F.col("title"), F.col("_l.title"))
    return joined.withColumn("resolved_arxiv", F.when(ok, ids.normalize_arxiv_id(F.col("_l.arxiv_id")))).drop("_doi", "_l")
