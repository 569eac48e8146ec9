"""Corpus tables: collections, sections, pieces, identifiers, censuses, renames.

Everything that concerns one document is an array expression over that row, so
none of it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import identifiers as ids, markup as md, text as tx, vocab
from ..functions.staging import let

# Navigation and back-matter headings that hold no passage of their own.
BOILERPLATE = ("see also", "sources", "references", "related", "further reading", "参考文献", "相关条目",
               "另见", "来源", "语义关联 (semantic links)", "语义关联", "semantic links")
COMPILED = ("concepts", "references", "topics", "theses")
PIECE_LINES = 250


def collection_of(path: Column) -> Column:
    """raw, drafts, threads, a compiled sub-folder, or other."""
    parts = F.split(path, "/")
    top, second = F.element_at(parts, 1), F.get(parts, F.lit(1))
    return (F.when(top.isin("raw", "drafts", "threads"), top)
            .when((top == "wiki") & second.isin(*COMPILED), second)
            .otherwise("other"))


def in_role(df: DataFrame, role: str, path: str = "path") -> DataFrame:
    """Rows whose top directory has the role searchable, graphed, rewritten or documents."""
    tops = vocab.layout(df.sparkSession).filter(F.col(role)).select("top")
    return df.withColumn("top", F.substring_index(F.col(path), "/", 1)) \
        .join(F.broadcast(tops), "top", "left_semi").drop("top")


def _section_ranges(lines: Column) -> Column:
    """(start, stop) line offsets: a boundary at every heading, then pieces of at most 250 lines."""
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), n - 1),
                      lambda i: (i == 0) | F.element_at(lines, i + 1).rlike("^#{1,3} "))
    stops = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    sections = F.arrays_zip(starts.alias("a"), stops.alias("b"))
    return F.flatten(F.transform(sections, lambda s: F.transform(
        F.sequence(s["a"], s["b"] - 1, F.lit(PIECE_LINES)),
        lambda p: F.struct(p.alias("start"), F.least(p + PIECE_LINES, s["b"]).alias("stop")))))


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per section piece: heading, start_line, end_line, content. Empty pieces are dropped."""
    cut = docs.withColumn("_lines", F.split(F.col(text), "\n")) \
        .withColumn("_range", F.explode(_section_ranges(F.col("_lines"))))
    first = F.element_at(F.col("_lines"), F.col("_range.start") + 1)
    body = F.array_join(F.slice(F.col("_lines"), F.col("_range.start") + 1,
                                F.col("_range.stop") - F.col("_range.start")), "\n")
    return (cut.withColumn("heading", tx.strip(F.regexp_extract(first, r"^#{1,3} (.+)$", 1)))
            .withColumn("start_line", F.col("_range.start") + 1)
            .withColumn("end_line", F.col("_range.stop"))
            .withColumn("content", tx.strip(body))
            .filter(F.col("content") != "")
            .drop("_lines", "_range"))


def drop_boilerplate(chunks: DataFrame) -> DataFrame:
    """Leave out non-raw chunks that are navigation."""
    heading = F.lower(tx.strip(F.regexp_replace(tx.strip(F.col("heading")), ":+$", "")))
    return chunks.filter((F.col("collection") == "raw") | ~heading.isin(*BOILERPLATE))


#: Characters that end a line, CR LF being one end, and the blanks of a line.
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
ENDED_LINE = rf"[^{LINE_ENDS}]*(?:\r\n|[{LINE_ENDS}])|[^{LINE_ENDS}]+"
BLANKS = r"(?U)^[\s\x1c-\x1f]*"


def _length_cuts(lines: Column, max_lines: int) -> Column:
    """(start, stop) of each piece but the last, and where the last one starts: one pass that keeps the open piece and the fence."""
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(False).alias("fenced"), F.array().cast("array<struct<start:int,stop:int>>").alias("cuts"))

    def step(state: Column, line: Column) -> Column:
        at = state["at"] + 1
        fenced = state["fenced"] != line.rlike(BLANKS + "```")
        ends = (at - state["start"] >= max_lines) & ~fenced & line.rlike(BLANKS + r"\z")
        return F.struct(at.alias("at"), F.when(ends, at).otherwise(state["start"]).alias("start"), fenced.alias("fenced"),
                        F.when(ends, F.concat(state["cuts"], F.array(F.struct(state["start"].alias("start"), at.alias("stop"))))).otherwise(state["cuts"]).alias("cuts"))

    return F.aggregate(lines, begin, step)


def length_pieces(docs: DataFrame, max_lines: int = 500, text: str = "text") -> DataFrame:
    """Pieces that end at the first blank line at or after `max_lines`, never inside a fence.

    piece and start_line count from 1; the contents of a text's pieces make up
    the text. Null and empty texts have no pieces.
    """
    def pieces(lines: Column) -> Column:
        def whole(state: Column) -> Column:
            last = F.when(state["start"] < state["at"], F.array(F.struct(state["start"].alias("start"), state["at"].alias("stop")))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
            return F.transform(F.concat(state["cuts"], last), lambda c, i: F.struct(
                (i + 1).alias("piece"), (c["start"] + 1).alias("start_line"), F.array_join(F.slice(lines, c["start"] + 1, c["stop"] - c["start"]), "").alias("content")))
        return let(_length_cuts(lines, max_lines), whole)

    rows = let(F.regexp_extract_all(F.col(text), F.lit(ENDED_LINE), F.lit(0)), pieces)
    return docs.select(*[c for c in docs.columns if c != text], F.inline(rows))


def with_slugs(df: DataFrame, column: str, max_length: int = tx.SLUG_MAX) -> DataFrame:
    return df.withColumn("slug", tx.slug(F.col(column), max_length)) \
        .withColumn("slug_full", tx.slug_uncapped(F.col(column)))


def markdown_links(docs: DataFrame, text: str = "text") -> DataFrame:
    """Long table of Markdown link targets with their position."""
    return docs.select("*", F.posexplode(md.markdown_links(F.col(text))).alias("pos", "link"))


def wikilinks(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("*", F.posexplode(md.wikilinks(F.col(text))).alias("pos", "link"))


def identifiers_in(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct identifiers of a corpus: kind (arxiv or doi) and value."""
    arxiv = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(ids.BARE), F.lit(1))).alias("raw")) \
        .select(F.lit("arxiv").alias("kind"), ids.normalize_arxiv_id(F.col("raw")).alias("value"))
    doi = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(ids.DOI), F.lit(1))).alias("raw")) \
        .select(F.lit("doi").alias("kind"), F.lower(F.regexp_replace("raw", r"[.,;)\]}]+$", "")).alias("value"))
    return arxiv.unionByName(doi).filter(F.col("value").isNotNull()).distinct()


def library_arxiv_ids(cards: DataFrame) -> DataFrame:
    """Distinct arXiv ids named by reference cards."""
    named = ids.normalize_arxiv_id(F.coalesce(F.col("arxiv_id"), F.col("source"), F.col("url")))
    return cards.filter(F.col("collection") == "references").select(named.alias("arxiv_id")) \
        .filter(F.col("arxiv_id").isNotNull()).distinct()


def census(files: DataFrame) -> DataFrame:
    """Files and newest change by first directory."""
    return files.filter((md.basename(F.col("path")) != "_index.md") & ~F.array_contains(F.split("path", "/"), ".backup")) \
        .withColumn("folder", F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")) \
        .groupBy("folder").agg(F.count("*").alias("files"), F.max("mtime").alias("newest"))


def folder_inventory(files: DataFrame, depth: int = 1) -> DataFrame:
    """Files, bytes, kinds and depth by entry, below any lone wrapper folder.

    `files`: path, length. The wrapper is found with one aggregate of the first
    path segments, not by listing.
    """
    base = ""
    while True:
        rest = F.substring(F.col("path"), len(base) + 1, 100000)
        head = files.filter(F.col("path").startswith(base)).select(
            F.substring_index(rest, "/", 1).alias("head"), rest.contains("/").alias("folder"))
        seen = head.agg(F.min("head"), F.max("head"), F.bool_and("folder")).first()
        if seen[0] is None or seen[0] != seen[1] or not seen[2]:
            break
        base += seen[0] + "/"
    rest = F.substring(F.col("path"), len(base) + 1, 100000)
    below = files.filter(F.col("path").startswith(base)).withColumn("_parts", F.split(rest, "/"))
    levels = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("_parts"))),
                         lambda d: F.struct(d.alias("level"), F.array_join(F.slice("_parts", 1, d), "/").alias("entry")))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    flat = below.select(F.explode(levels).alias("e"), "length", kind.alias("kind"), F.size("_parts").alias("parts"))
    per_kind = flat.groupBy("e.entry", "e.level", "kind").agg(
        F.count("*").alias("n"), F.sum("length").alias("bytes"), F.max(F.col("parts") - F.col("e.level")).alias("below"))
    return per_kind.groupBy("entry", "level").agg(
        F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.max("below").alias("depth"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds")) \
        .withColumn("base", F.lit(base))


def index_totals(chunks: DataFrame, vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """chunks, vectors, and changed, unchanged and pruned files of an index run, by library."""
    sized = chunks.groupBy("library").agg(F.count("*").alias("chunks"))
    held = vectors.groupBy("library").agg(F.count("*").alias("vectors"))
    moved = changes.groupBy("library").agg(
        F.count_if(F.col("change").isin("new", "changed")).alias("updated"),
        F.count_if(F.col("change") == "unchanged").alias("unchanged"),
        F.count_if(F.col("change") == "deleted").alias("pruned"))
    out = sized.join(held, "library", "full_outer").join(moved, "library", "full_outer")
    return out.na.fill(0, ["chunks", "vectors", "updated", "unchanged", "pruned"])


def file_changes(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("library", "path")) -> DataFrame:
    """new, changed, unchanged or deleted for every file of two versions, by hash."""
    keys = list(keys)
    before = old.select(*keys, F.col("hash").alias("_old"))
    after = new.select(*keys, F.col("hash").alias("_new"))
    change = (F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted")
              .when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed"))
    return before.join(after, keys, "full_outer").select(*keys, change.alias("change"))


def placeholders(docs: DataFrame, text: str = "text") -> DataFrame:
    """Placeholder lines: the first of three patterns that matches a line."""
    rows = docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_line"))
    line = F.col("_line")
    bullet = r"^\s*\*\s+\*\*(.*?)\*\*\s*:\s*$"
    kind = (F.when(line.contains("[STUB: Awaiting synthesis]"), "stub_tag")
            .when(line.contains("No explicit"), "no_explicit_text")
            .when(line.rlike(bullet), "empty_bullet"))
    hint = (F.when(kind == "stub_tag", F.lit("[STUB: Awaiting synthesis]"))
            .when(kind == "no_explicit_text", F.regexp_extract(line, "(No explicit.*)", 1))
            .otherwise(F.regexp_extract(line, bullet, 1)))
    return rows.withColumn("type", kind).filter(F.col("type").isNotNull()).select(
        *[c for c in docs.columns if c != text], (F.col("_i") + 1).alias("line"), "type",
        tx.strip(line).alias("text"), tx.strip(hint).alias("context_hint"))


def _moved(path: Column, moves: Sequence[tuple[str, str]]) -> Column:
    """The path after the move plan; the longest matching source wins."""
    out = None
    for src, dst in sorted(moves, key=lambda m: -len(m[0])):
        src, dst = src.rstrip("/"), dst.rstrip("/")
        hit = (path == src) | path.startswith(src + "/")
        new = F.concat(F.lit(dst), F.substring(path, len(src) + 1, 100000))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return path if out is None else out.otherwise(path)


def _relative_to(target: Column, folder: Column) -> Column:
    """`target` written relative to `folder`."""
    a = F.filter(F.split(folder, "/"), lambda p: p != "")
    b = F.split(target, "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b) - 1), F.lit(1))),
                             lambda n: (n <= F.size(a)) & (n <= F.size(b) - 1) & (F.slice(a, 1, n) == F.slice(b, 1, n))))
    up = F.array_repeat(F.lit(".."), F.size(a) - shared)
    down = F.slice(b, shared + 1, F.size(b) - shared)
    return F.array_join(F.concat(up, down), "/")


def retarget_links(docs: DataFrame, moves: Sequence[tuple[str, str]], text: str = "text") -> DataFrame:
    """Link edits a move plan makes necessary: file, moves_to, old, new.

    The plan is the caller's argument, so it becomes a column expression and
    nothing is joined. External and anchor-only links are left alone.
    """
    links = docs.select("path", F.explode(F.array_distinct(md.markdown_links(F.col(text)))).alias("old"))
    local = links.filter(~F.col("old").rlike(r"^[a-zA-Z][\w+.-]*:") & ~F.col("old").startswith("#"))
    target = F.substring_index("old", "#", 1)
    anchor = F.when(F.col("old").contains("#"), F.concat(F.lit("#"), F.substring_index("old", "#", -1))).otherwise("")
    before = md.resolve_relative(md.dirname(F.col("path")), target)
    staged = local.withColumn("_to", _moved(before, moves)).withColumn("moves_to", _moved(F.col("path"), moves)) \
        .withColumn("_after", md.resolve_relative(md.dirname(F.col("moves_to")), target))
    new = F.when(F.col("old").startswith("/"), F.concat(F.lit("/"), F.col("_to"))) \
        .otherwise(_relative_to(F.col("_to"), md.dirname(F.col("moves_to"))))
    touched = F.col("_to") != F.col("_after")
    return staged.filter(touched).withColumn("new", F.concat(new, anchor)) \
        .filter(F.col("new") != F.col("old")).select(F.col("path").alias("file"), "moves_to", "old", "new")


def structure_map(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines, sections, display and inline maths per file."""
    body = F.col(text)
    heads = F.size(F.filter(F.split(body, "\n"), lambda l: tx.strip(l).rlike(r"^#{1,6}\s+")))
    return docs.select(*[c for c in docs.columns if c != text],
                       F.size(F.split(body, "\n")).alias("lines"), heads.alias("sections"),
                       F.size(F.regexp_extract_all(body, F.lit(r"(?s)\$\$(.*?)\$\$"), F.lit(1))).alias("block_math"),
                       F.size(F.regexp_extract_all(body, F.lit(r"(?s)(?<!\$)\$(?!\$)(.*?)(?<!\$)\$(?!\$)"), F.lit(1))).alias("inline_math"))


def link_density(docs: DataFrame, text: str = "text") -> DataFrame:
    """Links, distinct links, words outside maths, links per thousand words."""
    links = md.wikilinks(F.col(text))
    n_words = tx.word_count(md.drop_math(F.col(text)))
    return docs.select(*[c for c in docs.columns if c != text], F.size(links).alias("links"),
                       F.size(F.array_distinct(links)).alias("concepts"), n_words.alias("words"),
                       F.round(F.size(links) / F.greatest(n_words, F.lit(1)) * 1000, 2).alias("per_thousand"))


def collection_summary(cards: DataFrame) -> DataFrame:
    """By folder: files, wikilinks, average links per file, files without sources."""
    return cards.groupBy("collection").agg(
        F.count("*").alias("files"), F.sum(F.size(md.wikilinks(F.col("body")))).alias("wikilinks"),
        F.count_if(F.coalesce(F.size("sources"), F.lit(0)) <= 0).alias("without_sources")) \
        .withColumn("avg_links", F.round(F.col("wikilinks") / F.col("files"), 1))
