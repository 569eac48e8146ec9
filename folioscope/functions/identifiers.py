"""Paper identifiers and titles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .staging import let
from .text import squash, strip

# The closed list of archives that issued ids before April 2007.
LEGACY_ARCHIVES = (
    "acc-phys", "adap-org", "alg-geom", "ao-sci", "astro-ph", "atom-ph", "bayes-an", "chao-dyn",
    "chem-ph", "cmp-lg", "comp-gas", "cond-mat", "cs", "dg-ga", "funct-an", "gr-qc", "hep-ex",
    "hep-lat", "hep-ph", "hep-th", "math", "math-ph", "mtrl-th", "nlin", "nucl-ex", "nucl-th",
    "patt-sol", "physics", "plasm-ph", "q-alg", "q-bio", "quant-ph", "solv-int", "supr-con",
)
MODERN = r"\d{4}\.\d{4,5}"
LEGACY = "(?i:" + "|".join(sorted(LEGACY_ARCHIVES, key=len, reverse=True)) + r")(?:\.[A-Za-z]{2})?/\d{7}"
LABELLED = rf"(?i)(?:arxiv[:.\s/]*|abs/|pdf/|e-print/)({MODERN}|{LEGACY})(v\d+)?"
BARE = rf"\b({MODERN}|{LEGACY})(v\d+)?\b"
DOI = r"""(?i)\b(10\.\d{4,9}/[^\s"'<>,]+)"""
ARXIV_DOI = r"(?i)10\.48550/arxiv\.(.+)$"

# What a browser tab adds to a paper title.
TITLE_NOISE = (
    r"(?i)^\s*\[\s*(?:arXiv[:\s]*)?[0-9]{4}\.[0-9]{4,5}(?:v\d+)?\s*\]\s*",
    r"(?i)^\s*\[\s*[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v\d+)?\s*\]\s*",
    r"(?i)\s*[-|–—]\s*arXiv(?:\.org)?\s*$",
)


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def find_arxiv_id(text: Column, keep_version: bool = False) -> Column:
    """First id: labelled forms before bare ones."""
    found = F.coalesce(_first(text, LABELLED, 1), _first(text, BARE, 1))
    if not keep_version:
        return found
    whole = F.coalesce(_first(text, LABELLED, 0), _first(text, BARE, 0))
    version = F.when(_first(text, LABELLED, 1).isNotNull(), _first(text, LABELLED, 2)).otherwise(_first(text, BARE, 2))
    return F.when(version.isNotNull(), whole).otherwise(found)


def normalize_arxiv_id(text: Column) -> Column:
    """Version off; legacy archive lower case, subject class upper case."""
    def canonical(found: Column) -> Column:
        archive = F.substring_index(found, "/", 1)
        subject = F.concat(F.lower(F.substring_index(archive, ".", 1)), F.lit("."), F.upper(F.substring_index(archive, ".", -1)))
        legacy = F.concat(F.when(archive.contains("."), subject).otherwise(F.lower(archive)), F.lit("/"), F.substring_index(found, "/", -1))
        return F.when(found.contains("/"), legacy).otherwise(found)

    return let(find_arxiv_id(text), canonical)


def find_doi(text: Column) -> Column:
    return F.lower(F.regexp_replace(_first(text, DOI, 1), r"[.,;)\]}]+$", ""))


def arxiv_from_doi(doi: Column) -> Column:
    return let(doi, lambda d: F.coalesce(normalize_arxiv_id(_first(d, ARXIV_DOI, 1)),
                                         F.when(F.lower(d).contains("arxiv"), normalize_arxiv_id(d))))


def identity(text: Column) -> Column:
    """struct(arxiv_id, doi, source): arXiv id, else one inside the DOI, else the DOI."""
    def named(p: Column) -> Column:
        embedded = F.when(p["direct"].isNull(), arxiv_from_doi(p["doi"]))
        return let(F.struct(p["direct"].alias("direct"), p["doi"].alias("doi"), embedded.alias("embedded")), lambda q: F.struct(
            F.coalesce(q["direct"], q["embedded"]).alias("arxiv_id"), q["doi"].alias("doi"),
            F.when(q["direct"].isNotNull(), "text").when(q["embedded"].isNotNull(), "doi-text").otherwise("").alias("source")))

    return let(F.struct(normalize_arxiv_id(text).alias("direct"), find_doi(text).alias("doi")), named)


def title_words(title: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9 ]+", " "))
    return F.array_distinct(F.filter(F.split(flat, r"\s+"), lambda w: w != ""))


def titles_match(ours: Column, theirs: Column, share: float = 0.6) -> Column:
    """Shared words over the shorter title; a missing title contradicts nothing."""
    a, b = title_words(F.coalesce(ours, F.lit(""))), title_words(F.coalesce(theirs, F.lit("")))
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter == 0, F.lit(True)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(shorter, F.lit(1)) >= share)


def title_contains(expect: Column, title: Column) -> Column:
    """Whether a remembered fragment is in the title, punctuation and case aside."""
    def norm(col: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+", " "))
    return (norm(expect) != "") & F.contains(norm(title), norm(expect))


def clean_title(title: Column) -> Column:
    """Browser noise off; the original when nothing would be left."""
    cleaned = title
    for pattern in TITLE_NOISE:
        cleaned = F.regexp_replace(cleaned, pattern, "")
    cleaned = strip(cleaned)
    return F.when(F.length(title) > 0, F.when(cleaned != "", cleaned).otherwise(strip(title)))


def same_title(a: Column, b: Column) -> Column:
    def norm(col: Column) -> Column:
        return F.trim(F.regexp_replace(squash(col), "^['\"]+|['\"]+$", ""))
    return norm(a) == norm(b)
