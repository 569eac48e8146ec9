"""Line dedup by a log-template tree of fixed depth.

A line's tokens stand between ASCII blanks; tokens with a digit or an at sign
are variable (`<*>`). The tree's first level is the token count, the next DEPTH
are the leading tokens, all of them where a line has no more; a leaf is one
template. A line of variable tokens alone has no template: it recurs or stays by
its own text. In a leaf, a position is
constant where one token holds more than half of the leaf's texts; a line
belongs to the template if at least AGREE of its positions agree with it, one of
them in a token that is not variable. A
template that belongs to MIN_DOCS or more different texts recurs: its lines are
dropped everywhere but in its first document. Lines that fit no template recur
or stay by their own masked form. Equal texts count once.

All steps are sums by key; no leaf is ever gathered. Defined results: null text
stays null, a text without recurring lines is unchanged, blank lines always
stay, lines of at most DEPTH tokens go by the same rule with `every_line` (as in
the queries) and stay without it, order and other lines are kept. "First" is
the smallest doc_id, null last; rows with that id and equal text all keep the
line. Empty tables give no rows. Other columns pass through; a column named
`n_lines` or `n_dropped` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.staging import let
from .common import batches, stored, texts

DEPTH = 3
AGREE = 0.7
MIN_DOCS = 5
VARIABLE = re.compile(rb"[0-9@]")
BLANKS = r"[ \t\x0B\f\r]+"

PARSED = {"doc_id": pa.int64(), "text_hash": pa.int64(), "line": pa.int32(), "leaf": pa.int64(), "form": pa.int64()}


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def masked(line: bytes) -> list[bytes]:
    tokens = line.split()
    return [b"<*>" if VARIABLE.search(t) else t for t in tokens] if VARIABLE.search(line) else tokens


def parsed_lines(docs: DataFrame, every_line: bool = False) -> DataFrame:
    """(doc_id, text_hash, line, leaf, form) of every line with tokens, or with more than DEPTH tokens."""
    least = 1 if every_line else DEPTH + 1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in parts:
                for doc_id, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b)):
                    for i, line in enumerate(text.split(b"\n")):
                        tokens = masked(line)
                        if len(tokens) >= least:
                            if all(t == b"<*>" for t in tokens):
                                leaf = b"= " + b" ".join(tokens := line.split())
                            else:
                                leaf = b"%d " % len(tokens) + b" ".join(tokens[:DEPTH])
                            yield doc_id, h, i, signed(xxhash.xxh3_64_intdigest(leaf)), signed(xxhash.xxh3_64_intdigest(b" ".join(tokens)))
        yield from batches(PARSED, rows(), 8192)

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string")).where("text is not null")
    return source.mapInArrow(run, "doc_id bigint, text_hash bigint, line int, leaf bigint, form bigint")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, every_line: bool = False) -> DataFrame:
    """(doc_id, text_hash, lines): numbers of the lines to drop, for texts that have some."""
    lines = stored(parsed_lines(docs, every_line), "lines-parsed")
    often = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    lines = stored(lines.join(often, "leaf"), "lines-often")
    forms_in_texts = lines.groupBy("leaf", "form", "text_hash").agg(F.min(F.struct("doc_id", "line")).alias("at"))
    forms = forms_in_texts.groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("texts"), F.min_by(F.struct("text_hash", "at.doc_id", "at.line"), "text_hash").alias("at"))
    forms = stored(forms.select("leaf", "form", "texts", "at.*"), "lines-forms")
    leaves = forms.groupBy("leaf").agg(F.count(F.lit(1)).alias("forms"), F.sum("texts").alias("leaf_texts")).where("forms > 1").where(F.col("leaf_texts") >= min_docs)
    mixed = forms.join(leaves, "leaf")
    # Tokens of one line for each form; the texts are read again for those alone.
    source = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    # Both reads of the texts are merge joins at every size, so that a plan seen on little data is the one that runs on much.
    read = mixed.hint("merge").join(source.where("text is not null"), F.expr("doc_id <=> d and text_hash = t")).select("leaf", "form", "texts", "leaf_texts", F.get(F.split("text", "\n"), F.col("line")).alias("text"))
    tokens = read.distinct().select("leaf", "form", "texts", "leaf_texts", F.posexplode(F.filter(F.split("text", BLANKS), lambda t: t != "")).alias("place", "token"))
    tokens = stored(tokens.withColumn("token", F.when(F.col("token").rlike("[0-9@]"), "<*>").otherwise(F.col("token"))), "lines-tokens")
    constant = tokens.groupBy("leaf", "place", "token").agg(F.sum("texts").alias("s"), F.first("leaf_texts").alias("all")).where("2 * s > all").select("leaf", "place", "token")
    agreed = tokens.join(constant.withColumn("same", F.lit(1)), ["leaf", "place", "token"], "left").groupBy("leaf", "form").agg(F.sum(F.coalesce("same", F.lit(0))).alias("same"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("token") != "<*>", F.col("same"))).alias("firm"))
    fitting = agreed.where((F.col("same") >= F.lit(AGREE) * F.col("n")) & (F.col("firm") == 1)).select("leaf", "form", F.lit(True).alias("fits"))
    # A unit is a leaf's template, or one form that fits none.
    unit = F.when(F.col("fits"), F.lit(0)).otherwise(F.col("form"))
    units = lines.join(fitting, ["leaf", "form"], "left").select("doc_id", "text_hash", "line", "leaf", unit.alias("unit"), F.coalesce("fits", F.lit(False)).alias("fits"))
    by_text = units.groupBy("leaf", "fits", "unit", "text_hash").agg(F.min("doc_id").alias("first"))
    recurring = by_text.groupBy("leaf", "fits", "unit").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).where(F.col("texts") >= min_docs).select("leaf", "fits", "unit", "first")
    dropped = units.join(recurring, ["leaf", "fits", "unit"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return dropped.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, every_line: bool = False) -> DataFrame:
    """The rows with `text` without its recurring lines, and `n_lines`, `n_dropped`."""
    drops = recurring_lines(docs, min_docs, every_line).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.col("lines").alias("__lines"))
    kept = docs.drop("n_lines", "n_dropped")
    # The row travels whole, so that no column of it can clash.
    whole = kept.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("whole"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__t"))
    out = whole.join(drops.hint("merge"), same, "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    numbers = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lines")))
    rest = let(lines, lambda own: F.array_join(F.transform(numbers, lambda i: F.get(own, i)), "\n"))
    text = F.when(F.col("__lines").isNull(), F.col("text")).otherwise(rest)
    return out.select(*[text.alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in kept.columns],
                      F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).alias("n_dropped"))
