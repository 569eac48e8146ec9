"""Notes and posts from threads files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import markup as md
from ..functions.dates import parse_at, parse_date

# The signature, status and field lines of a post, and the heading that opens the discussion.
SIGNATURE = r"###[ \t]+(\S+)[ \t]*·[ \t]*([^/\s·]+)(?:/([^\s·]+))?(?:[ \t]*·[ \t]*via[ \t]+([A-Za-z0-9._-]+))?[ \t]*$"
STATUS_LINE = r"[^\S\n]*status:[ \t]*([a-z-]+)[ \t]*(?:->|→|=>)[ \t]*([a-z-]+)[^\S\n]*$"
FIELD_LINE = r"[^\S\n]*set:[ \t]*([a-z_]+)[ \t]*=[ \t]*(\S(?:[^\n]*\S)?)[^\S\n]*$"
DISCUSSION = r"##[ \t]+Discussion[ \t]*$"

#: Every line is judged alone: `^` and `$` at LF only, white space of all scripts.
LINES = "(?mdU)"
CODE = "\\u0001"


def fenced(mark: str) -> str:
    """A code block of one fence character: to a bare fence at least as long, else to the end of the text."""
    return rf"({mark}{{3,}}+)[^\n]*+(?:[\s\S]*?\n[^\S\n]*\k<{{name}}>{mark}*[^\S\n]*$|[\s\S]*)"


BLOCK = LINES + r"^[^\S\n]*(?:" + "|".join(fenced(m).replace("(", f"(?<{n}>", 1).replace("{name}", n) for m, n in (("`", "tick"), ("~", "wave"))) + ")"


def posts_sql(text: str) -> str:
    """SQL expression: array of (seq, stamp, host, line, via, src, dst, field, value, text) of the text `text`.

    Lines of code blocks get a mark in front, so that no pattern of a line can
    meet them. What follows the first discussion heading is cut before each
    signature. In a post the first status line counts, and a field line before
    any text; both leave the text, and so do the marks. The character U+0001 is
    dropped from texts, since it is the mark. Null texts give null.
    """
    def line(pattern: str) -> str:
        return f"{LINES}^{pattern}"

    def whole(pattern: str) -> str:
        return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)

    def group(x: str, pattern: str, n: int) -> str:
        return f"nullif(regexp_extract({x}, r'{pattern}', {n}), '')"

    clean = rf"replace(regexp_replace({text}, r'\r\n?', '\n'), '{CODE}', '')"
    marked = f"array_join(zip_with(split(t, r'{BLOCK}', -1), regexp_extract_all(t, r'{BLOCK}', 0), (plain, code) -> concat(plain, coalesce(regexp_replace(code, r'{LINES}^', '{CODE}'), ''))), '')"
    thread = f"get(split({marked}, r'{line(DISCUSSION)}', 2), 1)"
    signed = f"filter(split({thread}, r'{LINES}^(?={whole(SIGNATURE)})', -1), p -> p rlike r'(?mdU)\\A{whole(SIGNATURE)}')"
    parts = r"transform({0}, p -> named_struct('head', substring_index(p, '\n', 1), 'body', substring(p, length(substring_index(p, '\n', 1)) + 2)))".format(signed)
    opening = rf"(?mdU)\A({whole(STATUS_LINE)}\n)?{FIELD_LINE}"
    without_field = rf"regexp_replace(p.body, r'{whole(opening).replace('(?:', '(', 1)}(?:\n|\z)', '$1')"
    without_status = rf"regexp_replace({without_field}, r'(?mdU)\A([\s\S]*?)^{whole(STATUS_LINE)}(?:\n|\z)', '$1')"
    fields = {"stamp": group("p.head", line(SIGNATURE), 1), "host": group("p.head", line(SIGNATURE), 2), "line": group("p.head", line(SIGNATURE), 3), "via": group("p.head", line(SIGNATURE), 4),
              "src": group("p.body", line(STATUS_LINE), 1), "dst": group("p.body", line(STATUS_LINE), 2), "field": group("p.body", opening, 2), "value": group("p.body", opening, 3),
              "text": rf"regexp_replace(replace({without_status}, '{CODE}', ''), r'(?U)^\s+|\s+$', '')"}
    rows = f"transform({parts}, (p, i) -> named_struct('seq', cast(i as bigint), {', '.join(f"'{n}', {x}" for n, x in fields.items())}))"
    return f"flatten(transform(array({clean}), t -> {rows}))"


def posts(cards: DataFrame, text: str = "body") -> DataFrame:
    """Long table of posts: slug, path, seq, at, host, line, via, src, dst, field, value, text. A pattern gate comes first."""
    held = cards.filter(F.col(text).rlike(r"(?m)^##[ \t]+Discussion") & F.col(text).rlike(r"(?m)^###[ \t]+\S+[ \t]*·"))
    return held.select("path", F.inline(F.expr(posts_sql(f"`{text}`")))).select(
        md.stem(F.col("path")).alias("slug"), "path", "seq", parse_at(F.col("stamp")).alias("at"), "host", "line", "via", "src", "dst", "field", "value", "text")


def notes(cards: DataFrame) -> DataFrame:
    """Note columns from the cards under threads/."""
    own = cards.filter(F.substring_index("path", "/", 1) == "threads")
    return own.select(md.stem(F.col("path")).alias("slug"), "path", "kind", "status", parse_date(F.col("created")).alias("created"), "purpose",
                      F.coalesce("line", F.array().cast("array<string>")).alias("lines"), "tags", "title", "bet", "found", "claim", "key_move",
                      "depends_on", "answers", "derivation", "evidence", "mtime", "body")
