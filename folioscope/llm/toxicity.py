"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct words, pairs of neighbours and pairs with
one word between, hashed into 2^BITS coordinates. Tasks turn the bounded sample
into coordinates; one task then runs FTRL-proximal (per-coordinate rates, L1 and
L2) over those, since its updates follow one another. L1 leaves a few hundred
weights: they are the only thing that is broadcast.

A null or empty text has no features and scores by the bias alone. A null id is
scored too (its fold is that of the empty text). Repeated rows score alike;
without labelled rows of both kinds all scores are the prior, 0.5 if there are
no labels at all. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, batches, fold, mixed, texts
from .fitting import training_sample

BITS = 20
ALPHA, BETA, L1, L2 = 3.0, 1.0, 8.0, 0.1
EPOCHS = 3
#: ASCII that parts words besides blanks.
PARTS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def features(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Coordinates of words, neighbours and skip pairs, in order, with repetitions."""
    h = hashes.of(text.lower().translate(PARTS))
    m, s = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    return np.concatenate([mixed(h) >> s, mixed(h[:-1] * m + h[1:]) >> s, mixed((h[:-2] ^ m) * m + h[2:]) >> s]).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Bias and weights after `epochs` passes; the bias has no L1."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    order = np.random.default_rng(5)

    def weights(idx):
        zi = z[idx]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[idx])) / ALPHA + L2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            idx, label = rows[r]
            w = weights(idx)
            bias = -zb / ((BETA + nb**0.5) / ALPHA + L2)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
            ni = n[idx]
            grown = ni + g * g
            z[idx] += g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[idx] = grown
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * bias
            nb += g * g
    return -zb / ((BETA + nb**0.5) / ALPHA + L2), weights(np.arange(1 << BITS))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, coordinates and weights other than zero."""
    sample = training_sample(docs, labels, "toxic")

    def coordinates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in parts:
            rows = pa.array([np.unique(features(t, hashes)) for t in texts(b)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), rows], ["doc_id", "label", "at"])

    def train(table):
        table = table.sort_by("doc_id")
        at = table.column("at").combine_chunks()
        ends, flat = at.offsets.to_numpy(), at.values.to_numpy()
        bias, w = ftrl([(flat[i:j], y) for i, j, y in zip(ends, ends[1:], table.column("label").to_pylist())])
        kept = np.flatnonzero(w)
        return pa.table({"at": pa.array(np.append(kept, -1), pa.int64()), "w": pa.array(np.append(w[kept], bias), pa.float64())})

    rows = sample.select("doc_id", "label", "text").mapInArrow(coordinates, "doc_id long, label int, at array<int>")
    model = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "at long, w double").collect()
    kept = sorted((r.at, r.w) for r in model if r.at >= 0)
    return next((r.w for r in model if r.at < 0), 0.0), np.array([a for a, _ in kept], np.int64), np.array([w for _, w in kept])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    bias, at, w = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((bias, at, w))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, w = sent.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        hashes = WordHashes()

        def rows() -> Iterator[tuple]:
            for b in parts:
                for doc_id, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b)):
                    idx = features(text, hashes)
                    hit = np.unique(idx[dense[idx] != 0])
                    score = float(1 / (1 + np.exp(-np.clip(bias + dense[hit].sum(), -35, 35))))
                    yield doc_id, held, score, int(score >= 0.5)
        yield from batches({"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()}, rows())

    return docs.select(F.col("doc_id").cast("long"), (fold("doc_id") == 0).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
