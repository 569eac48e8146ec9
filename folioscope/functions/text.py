"""Text columns: whitespace, case, slugs, link keys, tokens."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The diacritics the search tokenizer folds. The DuckDB oracles repeat them.
DIACRITICS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# CJK ranges segmented into bigrams.
CJK = "[\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\u3040-\\u30FF]"

# Punctuation that compatibility normalisation leaves alone.
LOOSE_PUNCT = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-",
                             "−": "-", "、": ",", "。": "."})

SLUG_MAX = 80


def strip(col: Column) -> Column:
    """Unicode-aware trim."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def squash(col: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def words(col: Column) -> Column:
    """Whitespace-separated words, none for blank text."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


@cache
def folding() -> dict[str, str]:
    """Characters whose full case folding is not their lower case, by the Unicode tables at hand."""
    letters = map(chr, range(sys.maxunicode + 1))
    return {c: c.casefold() for c in letters if c.casefold() != c.lower()}


@cache
def _folds_apart() -> str:
    """Character class of texts that `lower` alone does not fold, by ranges. A capital sigma may lower to its final form."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, {"Σ", *folding()})):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


def fold_case(col: Column) -> Column:
    """Full case folding. Texts without a letter that folds apart from its lower case, all of ASCII among them, take the short way."""
    table = F.create_map(*[F.lit(x) for pair in folding().items() for x in pair])
    by_letter = F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c)))
    return F.when(~is_ascii(col) & col.rlike(_folds_apart()), F.array_join(by_letter, "")).otherwise(F.lower(col))


def fold_case_sql(text: str) -> str:
    """`fold_case` as an SQL expression."""
    table = ", ".join(f"'{c}', '{folded}'" for c, folded in folding().items())
    by_letter = f"transform(split({text}, ''), c -> coalesce(try_element_at(map({table}), c), lower(c)))"
    return f"if(octet_length({text}) <> length({text}) and {text} rlike '{_folds_apart()}', array_join({by_letter}, ''), lower({text}))"


def slug_uncapped(col: Column) -> Column:
    """Lower case, separators to `-`, other punctuation dropped, Unicode kept."""
    out = F.replace(F.lower(col), F.lit("_"), F.lit("-"))
    out = F.regexp_replace(out, r"(?U)\s+", "-")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\-]", "")
    out = F.regexp_replace(out, r"-+", "-")
    return F.regexp_replace(out, r"^-+|-+$", "")


def slug(col: Column, max_length: int = SLUG_MAX) -> Column:
    """`slug_uncapped`, cut at `max_length` on a word boundary when one is near."""
    full = slug_uncapped(col)
    cut = F.substring(full, 1, max_length)
    head = F.regexp_extract(cut, r"^(.*)-[^-]*$", 1)
    short = F.when(F.length(head) >= max_length // 2, head).otherwise(cut)
    return F.when(F.length(full) > max_length, F.regexp_replace(short, r"^-+|-+$", "")).otherwise(full)


def link_key(col: Column) -> Column:
    """How a link target and a title are matched by the graph builder."""
    return F.replace(F.lower(strip(col)), F.lit("_"), F.lit(" "))


def lookup_key(col: Column) -> Column:
    """The browser's form of `link_key`, with case folding."""
    return F.replace(fold_case(strip(col)), F.lit("_"), F.lit(" "))


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def cjk_bigrams(col: Column) -> Column:
    """CJK runs become overlapping two-character words; one-character runs stay."""
    spaced = F.regexp_replace(col, f"({CJK}+)", " $1 ")
    paired = F.regexp_replace(spaced, f"({CJK})(?=({CJK}))", "$1$2 ")
    cut = F.regexp_replace(paired, f"{CJK}(?= )(?<={CJK}{{2}} {CJK})", "")
    return F.when(~is_ascii(col) & col.rlike(CJK), cut).otherwise(col)


def search_text(col: Column) -> Column:
    """Index form of a text: bigrams, lower case, folded diacritics, terms with one space around each."""
    plain = F.when(is_ascii(col), F.lower(col)).otherwise(F.translate(F.lower(cjk_bigrams(col)), DIACRITICS, PLAIN))
    return F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def search_tokens(col: Column) -> Column:
    """Index terms in order."""
    return F.filter(F.split(search_text(col), " "), lambda w: w != "")


def glob_to_regex(pattern: str) -> str:
    """A GLOB whose `*` crosses `/`, as an anchored regular expression."""
    out = []
    for ch in pattern:
        out.append(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if ch in r"\.^$+{}()|" else ch)
    return "^" + "".join(out) + "$"


def content_hash(col: Column) -> Column:
    return F.sha1(col)


def first_line(col: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(col, r"(?U)^\s+", ""), "\n"), 1)


def loose_text(value: str | None) -> str | None:
    """Compatibility form without quotes variety, hyphens, whitespace or case."""
    if value is None:
        return None
    folded = unicodedata.normalize("NFKC", value).translate(LOOSE_PUNCT).replace("\u00ad", "")
    return "".join(folded.replace("-", " ").split()).casefold()


@F.pandas_udf(T.StringType())
def loose(values: pd.Series) -> pd.Series:
    """`loose_text` by Arrow batch: Spark has no compatibility normalisation."""
    return values.map(loose_text, na_action="ignore")
