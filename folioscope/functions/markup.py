"""Markdown structure as array expressions: links, fences, images, tables, front matter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip, words

WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
MD_LINK = r"\]\((<[^>\n]+>|[^)\n]+)\)"
MD_IMAGE = r"""!\[(?:\\.|[^\]\\])*\]\(\s*(<[^>]*>|[^)\s]+)(?:\s+["'][^"']*["'])?\s*\)"""
HTML_IMAGE = r"""(?i)<(?:img|embed)\b[^>]*?\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)')"""
HREF = r"""(?i)href\s*=\s*["']([^"']+)["']"""
IMAGE_DIR = "images"


def lines_of(text: Column) -> Column:
    """Lines with CRLF and lone CR read as LF."""
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def split_front_matter(text: Column) -> Column:
    """struct(front, body); no fence pair means no front matter."""
    pattern = r"(?s)^---[ \t]*\r?\n(.*?\n)?---[ \t]*(?:\r?\n(.*))?$"
    found = text.rlike(pattern)
    front = F.when(found, F.regexp_extract(text, pattern, 1))
    body = F.when(found, F.regexp_extract(text, pattern, 2)).otherwise(text)
    return F.struct(front.alias("front"), body.alias("body"))


def body_of(md: Column) -> Column:
    """Everything after the front matter, as the quality checks read it."""
    fence = F.locate("\n---", md, 4)
    return F.when(md.startswith("---") & (fence > 0), F.substring(md, fence + F.lit(4), F.length(md))).otherwise(md)


def wikilinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1))


def markdown_links(text: Column) -> Column:
    """Link targets; the angle-bracket form without its brackets."""
    raw = F.regexp_extract_all(text, F.lit(MD_LINK), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.rlike(r"^<[^>\n]+>$"), F.regexp_replace(x, "^<|>$", "")).otherwise(x))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def is_local_markdown_link(link: Column) -> Column:
    return ~link.contains("://") & ~link.startswith("mailto:") & F.substring_index(link, "#", 1).endswith(".md")


def image_targets(md: Column) -> Column:
    """Every image target, Markdown ones first, duplicates kept."""
    plain = F.transform(F.regexp_extract_all(md, F.lit(MD_IMAGE), F.lit(1)),
                        lambda x: F.when(x.rlike(r"^<[^>]*>$"), F.regexp_replace(x, "^<|>$", "")).otherwise(x))
    double = F.regexp_extract_all(md, F.lit(HTML_IMAGE), F.lit(1))
    single = F.regexp_extract_all(md, F.lit(HTML_IMAGE), F.lit(2))
    return F.concat(plain, F.zip_with(double, single, lambda a, b: F.when(F.length(a) > 0, a).otherwise(b)))


def image_class(target: Column) -> Column:
    """external, absolute, backslash, escaping, bare, elsewhere, nested or portable."""
    parts = F.split(target, "/")
    return (F.when(target.rlike(r"^(http://|https://|data:|//)"), "external")
            .when(target.rlike(r"^[A-Za-z]:[\\/]") | target.rlike(r"^[/\\]"), "absolute")
            .when(target.contains("\\"), "backslash")
            .when(F.array_contains(parts, ".."), "escaping")
            .when(F.size(parts) == 1, "bare")
            .when(F.element_at(parts, 1) != IMAGE_DIR, "elsewhere")
            .when(F.size(parts) > 2, "nested")
            .otherwise("portable"))


def table_rows(text: Column) -> Column:
    """Data rows, Markdown and HTML alike."""
    pipes = F.size(F.filter(F.split(text, r"\r\n|\r|\n"), lambda l: strip(l).startswith("|")
                            & ~strip(l).rlike(r"^\|[\s\-:|]+\|$")))
    return pipes + F.regexp_count(text, F.lit(r"(?i)<tr\b"))


def fence_left_open(text: Column) -> Column:
    """Whether a code fence is opened and never closed."""
    marks = F.filter(lines_of(text), lambda l: l.rlike(r"^\s*(`{3,}|~{3,})"))

    def step(state: Column, line: Column) -> Column:
        marker = F.regexp_extract(line, r"^\s*(`{3,}|~{3,})(.*)$", 1)
        rest = F.trim(F.regexp_extract(line, r"^\s*(`{3,}|~{3,})(.*)$", 2))
        closes = (F.substring(marker, 1, 1) == F.substring(state, 1, 1)) \
            & (F.length(marker) >= F.length(state)) & (rest == "")
        return F.when(state == "", marker).when(closes, F.lit("")).otherwise(state)

    return F.aggregate(marks, F.lit(""), step) != ""


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n\s*\n")


def drop_math(text: Column) -> Column:
    """Display, inline and environment maths removed."""
    out = F.regexp_replace(text, r"(?s)\$\$.*?\$\$", "")
    out = F.regexp_replace(out, r"(?<!\\)\$.*?(?<!\\)\$", "")
    return F.regexp_replace(out, r"(?s)\\begin\{.*?\}.*?\\end\{.*?\}", "")


def longest_plain_run(body: Column) -> Column:
    """Longest run of consecutive plain words carrying no mathematics."""
    textish = r"\\(?:text|mbox|textrm|textit|textbf|textsf|textnormal|operatorname|mathrm)\s*\{[^{}]*\}"
    tokens = words(F.regexp_replace(body, textish, " "))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, token: Column) -> Column:
        run = F.when(token.rlike(r"^\p{L}{2,}$"), state["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(tokens, start, step)["best"]


def resolve_relative(base_dir: Column, target: Column) -> Column:
    """Join a relative path to a folder and fold `.` and `..`; a leading `/` means the root."""
    joined = F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", base_dir, target))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))

    def step(stack: Column, part: Column) -> Column:
        pop = (part == "..") & (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
        return F.when(pop, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))) \
            .otherwise(F.concat(stack, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.(md|markdown)$", "")
