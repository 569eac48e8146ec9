r"""License scans: an exact set-similarity join of text blocks with license templates.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A
template is a set of words; a block meets it if at least THRESHOLD of the set
stands in the block. Blocks of a template are the windows of 2 m words at every
multiple of m, where m is the template's length rounded up to a power of two:
each run of m words lies whole in one of them.

Template words are ordered by the number of documents that hold them, rarest
first (one pass over the corpus). Of a template of n words that needs k of them,
the n - k + 1 rarest are its prefix: a block without any of these cannot reach
k. Prefix words found in a document meet the index of prefixes in a join. A
block's words that no template has cannot count, so a block is its template
words in the same order; it must have k of them (length filter), and at the
first common word, i-th of the template and j-th of the block, 1 + min(n - i,
|block| - j) words must still be in reach (positional filter). Survivors are
counted whole, so nothing above the threshold is missed.

A phrase is a template that must stand whole and with its words consecutive;
its places are counted where it starts, in one block each.

Texts are cut into overlapping segments first, so the work of a block never
depends on its document's length. Defined results: a null text is empty; an
empty text has no words, no labels and score 0; a phrase that repeats counts at
every place; equal texts and repeated rows are rows like others; a null doc_id
is kept; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.staging import computed_once
from .common import stored

#: Fixed patterns: what separates words, and what is lower-cased.
BLANK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

THRESHOLD = 0.8
#: Words of a segment; a power of two, at least as long as the longest template rounded up.
SEGMENT = 512


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))

#: Notices and opening statements of common licenses, as their authors give them.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
             "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache-notice", "Licensed under the Apache License, Version 2.0"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
             "either version 3 of the License, or (at your option) any later version"),
    Template("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    Template("mit-notice", "Released under the MIT License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
TEMPLATES = PHRASES + NOTICES


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BLANK), lambda w: w != "")


def template_words(text: str) -> list[str]:
    """The same for a template: letters and digits are all it has."""
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(str.maketrans(UPPER, LOWER)))


def rarity(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first: by documents that hold the word, then by the word."""
    held = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    docs = dict(words.select(F.explode(held).alias("w")).groupBy("w").count().collect())
    return sorted(vocabulary, key=lambda w: (docs.get(w, 0), w))


def prefix_index(templates: tuple[Template, ...], order: list[str], threshold: float) -> list[tuple]:
    """(rank, label, phrase, half, needed, place, tokens, sequence) of each prefix word of each template."""
    rank, out = {w: i for i, w in enumerate(order)}, []
    for t in templates:
        sequence = [rank[w] for w in template_words(t.text)]
        tokens = sorted(set(sequence))
        needed = len(tokens) if t.phrase else ceil(threshold * len(tokens))
        half = 1 << (len(sequence) - 1).bit_length()
        for place, r in enumerate(tokens[:len(tokens) - needed + 1]):
            out.append((r, t.label, t.phrase, half, needed, place, tokens, sequence))
    return out


INDEX = "rank int, label string, phrase boolean, half int, needed int, place int, tokens array<int>, sequence array<int>"


def segments(words: Column, order: list[str], prefix: list[str], margin: int) -> Column:
    """The segments that hold a prefix word: their number and their template words (at, rank)."""
    vocabulary = F.array(*[F.lit(w) for w in order])

    def of(s: Column) -> Column:
        start = s * SEGMENT
        placed = F.transform(F.slice(words, start + 1, F.lit(SEGMENT + margin)), lambda w, i: F.struct((start + i).alias("at"), w.alias("w")))
        known = F.filter(placed, lambda p: p.w.isin(order))
        return F.struct(s.alias("segment"), F.transform(known, lambda p: F.struct(p["at"].alias("at"), (F.array_position(vocabulary, p.w) - 1).cast("int").alias("rank"))).alias("places"))

    def wanted(s: Column) -> Column:
        return F.exists(F.slice(words, s * SEGMENT + 1, F.lit(SEGMENT + margin)), lambda w: w.isin(prefix))

    return F.transform(F.filter(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / SEGMENT).cast("int")), wanted), of)


def blocks_found(read: DataFrame, index: DataFrame, prefix: list[int]) -> DataFrame:
    """(row, label, phrase, share, block, words, starts): every block and the template that it meets."""
    cut = read.select("row", F.explode("segments").alias("s")).select("row", "s.*")
    marks = cut.select("row", "segment", "places", F.explode(F.filter("places", lambda p: p.rank.isin(prefix))).alias("p"))
    met = marks.join(index, F.col("p.rank") == F.col("rank"))
    # A word stands in two blocks; each belongs to the segment where it starts.
    block = F.explode(F.array(F.expr("p.at div half"), F.expr("p.at div half") - 1)).alias("block")
    own = met.select("*", block).where((F.col("block") >= 0) & F.expr(f"(block * half) div {SEGMENT} = segment"))
    low, high = F.col("block") * F.col("half"), (F.col("block") + 2) * F.col("half")
    own = own.withColumn("inside", F.filter("places", lambda p: (p["at"] >= low) & (p["at"] < high)))
    # The mark stands for its block if it is the word's first there and no earlier prefix word is there too.
    own = own.where(F.get(F.filter("inside", lambda p: p.rank == F.col("rank")), F.lit(0))["at"] == F.col("p.at"))
    own = own.withColumn("block_tokens", F.array_sort(F.array_distinct(F.transform("inside", lambda p: p.rank))))
    own = own.where(~F.arrays_overlap("block_tokens", F.slice("tokens", F.lit(1), F.col("place"))))
    left = F.least(F.size("tokens") - F.col("place") - 1, F.size("block_tokens") - F.array_position("block_tokens", F.col("rank")))
    own = own.where((F.size("block_tokens") >= F.col("needed")) & (left + 1 >= F.col("needed")))
    own = own.withColumn("common", F.size(F.array_intersect("tokens", "block_tokens"))).where(F.col("common") >= F.col("needed"))
    stands = lambda at: F.forall(F.transform("sequence", lambda r, i: F.struct((at + i).cast("bigint").alias("at"), r.alias("rank"))), lambda x: F.array_contains("inside", x))
    starts = F.filter(F.transform(F.filter("inside", lambda p: (p.rank == F.get("sequence", F.lit(0))) & (p["at"] < low + F.col("half"))), lambda p: p["at"]), stands)
    out = own.select("row", "label", "phrase", (F.col("common") / F.size("tokens")).alias("share"), "block", (2 * F.col("half")).alias("words"), F.when(F.col("phrase"), starts).otherwise(F.array().cast("array<bigint>")).alias("starts"))
    return out.where(~F.col("phrase") | (F.size("starts") > 0))


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, n_words), and the blocks found in them."""
    vocabulary = sorted({w for t in templates for w in template_words(t.text)})
    words = computed_once(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), words=words_of(F.col("text")))
    order = rarity(words, vocabulary)
    index = prefix_index(templates, order, threshold)
    margin = 2 * max(half for _, _, _, half, *_ in index)
    if margin > SEGMENT:
        raise ValueError(f"templates of more than {SEGMENT // 2} words")
    prefix = sorted({r for r, *_ in index})
    rare = [order[r] for r in prefix]
    some = F.when(F.exists("words", lambda w: w.isin(rare)), segments(F.col("words"), order, rare, margin))
    read = stored(words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), some.alias("segments")), "license-read")
    # The index has a row for each prefix word of each template; its size is known when the plan is made.
    known = docs.sparkSession.createDataFrame(index, INDEX)
    return read.drop("segments"), blocks_found(read, known, prefix)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and best_label of every row.

    The score is the largest share of a template that a block holds, 1 for a
    phrase, 0 where nothing is found.
    """
    rows, found = scanned(docs, templates, threshold)
    base = F.when(F.col("phrase"), F.col("label"))
    by_row = found.groupBy("row").agg(
        F.sum(F.size("starts")).alias("n"), F.min(F.array_min("starts")).alias("first"), F.max(F.array_max("starts")).alias("last"), F.collect_set(base).alias("base"),
        F.collect_set("label").alias("all"), F.max("share").alias("score"), F.max_by("label", F.struct("share", "phrase", "label")).alias("best_label"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return rows.join(by_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n", F.lit(0)).alias("n_base"), F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("last_word"),
        joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "best_label")
