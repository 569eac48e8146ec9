"""Quality: a factorisation machine over hashed words, structure statistics and sizes.

score = sigmoid(b + w.x + (sum_f (sum_i v_if x_i)^2 - v_if^2 x_i^2) / 2), in time
linear in the distinct words. Words are hashed into 2^BITS coordinates with
damped counts of unit length; statistics are standardised by the sample's mean
and deviation. The bounded sample is dealt into shards; all start from one
seeded point, and after every round the shards' parameters are averaged.

A null or empty text has no words and statistics of an empty text; it is scored
like any other. A null id is scored too. Repeated rows score alike. Without
labelled rows every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WordHashes, batches, fold, mixed, texts
from .fitting import training_sample

BITS, RANK = 16, 8
ROUNDS, RATE, DECAY = 4, 0.1, 1e-5
THRESHOLD = 0.3

#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence mark, 6 symbol, 7 beyond ASCII.
CLASSES = np.zeros(256, np.uint8)
for _set, _class in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:?'\"", 5), (b"!#$%&()*+-/<=>@[\\]^_`{|}~", 6), (bytes(range(128, 256)), 7)):
    CLASSES[list(_set)] = _class
STATISTICS = ("log_bytes", "log_words", "mean_word", "longest_word", "upper", "digit", "mark", "symbol", "beyond_ascii", "distinct", "top_word", "runs", "log_lines", "repeated_lines", "plain_words", "short_words")


def described(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct coordinates, their values, and the statistics in STATISTICS' order."""
    words = text.split()
    h = hashes.of(text)
    n = max(len(words), 1)
    kinds = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=8)
    inked = max(len(text) - int(kinds[4]), 1)
    distinct, counts = np.unique(h, return_counts=True)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x]
    stats = np.array([np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), np.log1p(lengths.max()),
                      kinds[2] / inked, kinds[3] / inked, kinds[5] / inked, kinds[6] / inked, kinds[7] / inked,
                      len(distinct) / n, counts.max(initial=0) / n, np.count_nonzero(h[1:] == h[:-1]) / n,
                      np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), sum(map(bytes.isalpha, words)) / n, np.count_nonzero(lengths <= 3) / n])
    idx, where = np.unique((mixed(distinct) >> np.uint64(64 - BITS)).astype(np.int64), return_inverse=True)
    x = np.log1p(np.bincount(where, counts, len(idx)) if len(idx) else np.zeros(0))
    return idx, x / max(np.sqrt((x**2).sum()), 1e-9), stats


class Machine:
    """Parameters in one array: a row for each word and statistic, column 0 linear, the rest the factors."""

    def __init__(self, p: np.ndarray, bias: float, mean: np.ndarray, deviation: np.ndarray) -> None:
        self.p, self.bias, self.mean, self.deviation = p, bias, mean, deviation

    @classmethod
    def fresh(cls, mean: np.ndarray, deviation: np.ndarray) -> Machine:
        p = np.random.default_rng(11).normal(0, 0.02, ((1 << BITS) + len(STATISTICS), 1 + RANK))
        p[:, 0] = 0
        return cls(p, 0.0, mean, deviation)

    def row(self, idx: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.clip((stats - self.mean) / self.deviation, -6, 6)
        return np.concatenate([idx, np.arange(len(stats)) + (1 << BITS)]), np.concatenate([x, scaled])

    def score(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        own = self.p[at]
        sums = x @ own[:, 1:]
        y = self.bias + x @ own[:, 0] + 0.5 * float((sums**2).sum() - ((x**2) @ (own[:, 1:] ** 2)).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -35, 35)))), own, sums

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray, int]], squares: np.ndarray, order: np.random.Generator) -> None:
        for r in order.permutation(len(rows)):
            at, x, label = rows[r]
            y, own, sums = self.score(at, x)
            g = y - label
            step = np.empty_like(own)
            step[:, 0] = g * x
            step[:, 1:] = g * (x[:, None] * sums[None, :] - own[:, 1:] * (x**2)[:, None])
            step += DECAY * own
            squares[at] += step**2
            self.p[at] -= RATE * step / np.sqrt(squares[at])
            self.bias -= 0.05 * g


def trainer(sent, turn: int):
    """One round of learning over a shard from the parameters `sent`."""

    def train(table):
        p, bias, mean, deviation = sent.value
        own, hashes, table = Machine(p.astype(np.float64), bias, mean, deviation), WordHashes(), table.sort_by("doc_id")
        rows = [(*own.row(*described(t, hashes)), y) for t, y in zip(table.column("text").cast(pa.binary()).to_pylist(), table.column("label").to_pylist())]
        own.learn(rows, np.full_like(own.p, 1.0), np.random.default_rng(turn))
        return pa.table({"p": [own.p.astype(np.float32).tobytes()], "bias": [own.bias]})

    return train


def averaged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the mean of all shards' parameters, none without rows."""
    total, bias, n = 0.0, 0.0, 0
    for b in parts:
        for p, own in zip(b.column("p").to_pylist(), b.column("bias").to_pylist()):
            total, bias, n = total + np.frombuffer(p, np.float32).astype(np.float64), bias + own, n + 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([bias / n])], ["p", "bias"])


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """The averaged machine of all shards."""
    sample = training_sample(docs, labels, "quality")
    context = docs.sparkSession.sparkContext

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n, a, b = WordHashes(), 0, np.zeros(len(STATISTICS)), np.zeros(len(STATISTICS))
        for batch in parts:
            for text in texts(batch):
                s = described(text, hashes)[2]
                n, a, b = n + 1, a + s, b + s**2
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([a.tolist()]), pa.array([b.tolist()])], ["n", "a", "b"])

    sums = sample.select("text").mapInArrow(measure, "n bigint, a array<double>, b array<double>").collect()
    n = max(sum(r.n for r in sums), 1)
    mean = np.sum([r.a for r in sums], axis=0) / n if sums else np.zeros(len(STATISTICS))
    deviation = np.sqrt(np.maximum((np.sum([r.b for r in sums], axis=0) / n if sums else np.zeros(len(STATISTICS))) - mean**2, 1e-6))
    machine = Machine.fresh(mean, deviation)
    for turn in range(ROUNDS):
        sent = context.broadcast((machine.p.astype(np.float32), machine.bias, mean, deviation))

        # The shards' mean is taken in a task: the driver gets one machine, not one of each shard.
        shards = sample.groupBy("shard").applyInArrow(trainer(sent, turn), "p binary, bias double")
        mean_of_all = shards.repartition(1).mapInArrow(averaged, "p binary, bias double").first()
        if not mean_of_all:
            break
        machine = Machine(np.frombuffer(mean_of_all.p, np.float32).reshape(machine.p.shape), mean_of_all.bias, mean, deviation)
        sent.unpersist()
    return machine


def scored(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """Columns `keep` of every row and its `score`; `score` must not be among them."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.p.astype(np.float32), machine.bias, machine.mean, machine.deviation))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = Machine(*sent.value), WordHashes()
        for b in parts:
            scores = [own.score(*own.row(*described(t, hashes)))[0] for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    return source.mapInArrow(run, T.StructType().add(source.schema["row"]).add("score", "double")).select("row.*", "score")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = scored(ids, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
