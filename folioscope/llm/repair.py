r"""Conversation structure repair: Hirschberg's divide and conquer over four states.

A repaired conversation reads `(s?(ua)+)?` in role initials. States are what was
written last: nothing, s, u, a. A row is kept (free), given another role
(REROLE) or deleted (DELETE, required of a blank or repeated row), rows without
text are inserted (INSERT), and a truncated row that stays costs TRUNCATED. Of
all cheapest edits the one whose initials are ASCII-least is the answer.

Between any two rows, the cost vector of the part before (by state) and that of
the part behind meet; the optimal crossing state whose part before reads least
splits the problem in two, until single rows are left: memory is linear in the
rows. To compare readings, the forward vector carries with each state's cost the
rank of its best reading among the four. Readings of one row count that end in a
row's own edit are never prefixes of each other, so ranks decide whatever
follows, and crossings are taken right after a row, before any insertion.

A conversation has no task of its own. Rows are dealt by range of (conversation,
turn, role, text), so a long one is spread over many chunks. A chunk is summed
up by its vectors from each of the four states; the chunks of a conversation, at
most one for each partition, meet in these sums alone, which gives every chunk
the states where it starts and ends. Chunks are then solved apart.

Defined results: null role or text is one space, a null conv_id is one
conversation, null turns come first, ties of turn are ordered by role, then text,
by START characters of each and a hash of the whole (Spark samples these keys, so
they are short). Equal rows are repeated rows: all but the first are deleted.
Equality of (role, text) is that of 128-bit hashes. Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import batches, stored

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
NEVER = 1 << 60
START = 64
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Fixed value: conversation key of a null conv_id.
NULL = " "

#: States: nothing, s, u, a. What each role initial leads to, and the role that may be inserted or given.
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
WRITES = ("u", "u", "a", "u")
CLASSES = "_sua"
#: Faults of a row: none, truncated, blank, repeated.
FINE, CUT, BLANK, TWICE = range(4)
#: Cost and edits from a state to the end of the conversation.
TAIL = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

Vector = tuple[tuple[int, int], ...]  # (cost, rank of the reading) by state


def code_of(role: str, fault: int) -> int:
    return 4 * max(CLASSES.find(role[:1] or "_"), 0) + fault


@lru_cache(maxsize=None)
def moves(code: int) -> tuple[dict[int, tuple[int, str]], ...]:
    """By state before a row: state after it -> (cost, edits) of the cheapest, ASCII-least way."""
    initial, fault = CLASSES[code // 4], code % 4
    stay = TRUNCATED if fault == CUT else 0
    out = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, before = start, 0
        for inserted in range(3):
            ways = [(DELETE, "D", state)]
            if fault in (FINE, CUT):
                ways.append((REROLE + stay, "R", STEP[WRITES[state], state]))
                if (initial, state) in STEP:
                    ways.append((stay, "K", STEP[initial, state]))
            for cost, edit, after in ways:
                best[after] = min(best.get(after, (NEVER, "")), (before + cost, "I" * inserted + edit))
            state, before = STEP[WRITES[state], state], before + INSERT
        out.append(best)
    return tuple(out)


def ranked(best: list[tuple]) -> Vector:
    """(cost, reading...) by state as (cost, rank of the reading)."""
    order = sorted(range(4), key=lambda t: best[t][1:])
    return tuple((best[t][0], order.index(t)) for t in range(4))


@lru_cache(maxsize=1 << 16)
def step(code: int, vector: Vector) -> Vector:
    ways = moves(code)
    return ranked([min(((cost + ways[s][t][0], rank, ways[s][t][1]) for s, (cost, rank) in enumerate(vector) if cost < NEVER and t in ways[s]), default=(NEVER, 4, "")) for t in range(4)])


def at(state: int) -> Vector:
    return tuple((0 if s == state else NEVER, s) for s in range(4))


def forward(codes: bytes, low: int, high: int, start: int) -> Vector:
    vector, paid = at(start), 0
    for i in range(low, high):
        vector = step(codes[i], vector)
        least = min(c for c, _ in vector)
        paid += least
        vector = tuple((c - least if c < NEVER else NEVER, r) for c, r in vector)
    return tuple((c + paid if c < NEVER else NEVER, r) for c, r in vector)


def backward(codes: bytes, low: int, high: int, ends: tuple[int, ...]) -> tuple[int, ...]:
    """Cost from each state before row `low` to the ends, by state after row `high`."""
    for i in range(high - 1, low - 1, -1):
        ends = tuple(min((cost + ends[t] for t, (cost, _) in way.items()), default=NEVER) for way in moves(codes[i]))
    return ends


def hirschberg(codes: bytes, low: int, high: int, start: int, ends: tuple[int, ...]) -> Iterator[str]:
    """Edits at each of the rows from `low`: inserted rows, then the row's own edit."""
    if high - low == 1:
        yield min((cost + ends[t], edits) for t, (cost, edits) in moves(codes[low])[start].items())[1]
    elif high > low:
        middle = (low + high) // 2
        before, behind = forward(codes, low, middle, start), backward(codes, middle, high, ends)
        crossing = min(range(4), key=lambda s: (before[s][0] + behind[s], before[s][1]))
        yield from hirschberg(codes, low, middle, start, tuple(0 if s == crossing else NEVER for s in range(4)))
        yield from hirschberg(codes, middle, high, crossing, ends)


def written(edits: str, role: str, state: int) -> tuple[str, int]:
    """Role of each edit ('-': the row's own) and the state after them."""
    out = ""
    for e in edits:
        own = role if e == "K" else WRITES[state]
        out += "-" if e in "KD" else own
        state = state if e == "D" else STEP[own, state]
    return out, state


PLACED = {"conv": pa.string(), "chunk": pa.int32(), "seq": pa.int64(), "role": pa.string(), "text": pa.string(), "turn": pa.int64(), "code": pa.int32(), "same": pa.string()}
SUMS = {"conv": pa.string(), "chunk": pa.int32(), "codes": pa.binary(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int32()), "ends": pa.string(),
        "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64()}
CROSSED = {"conv": pa.string(), "chunk": pa.int32(), "start": pa.int32(), "ends": pa.list_(pa.int64()), "last": pa.bool_(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
           "illegal": pa.int64(), "cost": pa.int64()}
EDITS = {"conv": pa.string(), "chunk": pa.int32(), "seq": pa.int64(), "k": pa.int32(), "edit": pa.string(), "given": pa.string()}
SPARK = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.int32()): "array<int>"}


def mapped(df: DataFrame, columns: dict[str, pa.DataType], each) -> DataFrame:
    """`each` turns the rows of a partition, one after another, into rows of `columns`."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in parts for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from batches(columns, each(rows), 1024)

    return df.mapInArrow(run, ", ".join(f"{c} {SPARK[t]}" for c, t in columns.items()))


def placed(rows: DataFrame) -> DataFrame:
    """PLACED: rows in order, dealt to chunks by range, with their faults inside the chunk."""
    keys = ["conv", "turn", "role_start", "text_start", "hash", "salt"]
    source = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL)).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # Rows that are equal in all columns are exchangeable; the salt lets even those be split.
    source = source.withColumns({"role_start": F.substring("role", 1, START), "text_start": F.substring("text", 1, START), "hash": F.xxhash64("role", "text"), "salt": F.monotonically_increasing_id()})
    ordered = source.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text")

    def each(source: Iterator[tuple]) -> Iterator[tuple]:
        chunk = TaskContext.get().partitionId()
        for conv, own in groupby(source, lambda r: r[0]):
            seen: set[bytes] = set()
            for seq, (_, turn, role, text) in enumerate(own):
                plain = text.rstrip(BLANKS)
                same = xxhash.xxh3_128(f"{len(role)} {role}{text}".encode()).digest()
                fault = BLANK if not plain else TWICE if same in seen else FINE if plain.endswith(ENDS) else CUT
                seen.add(same)
                yield conv, chunk, seq, role, text, turn, code_of(role, fault), same.hex()

    return mapped(ordered, PLACED, each)


def summed(rows: DataFrame) -> DataFrame:
    """SUMS: one row for each chunk, with faults across chunks settled."""
    narrow = rows.select("conv", "chunk", "seq", "code", "same")
    # Conversations in several chunks: fewer than there are partitions.
    spread = F.broadcast(rows.groupBy("conv").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").select("conv"))
    over = narrow.where(F.col("code") % 4 <= CUT).join(spread, "conv")
    first = over.groupBy("conv", "same").agg(F.min("chunk").alias("first"))
    again = over.join(first, ["conv", "same"]).where("chunk > first").select("conv", "chunk", "seq", F.lit(True).alias("again"))
    settled = narrow.join(again, ["conv", "chunk", "seq"], "left").withColumn("code", F.when(F.col("again"), F.floor(F.col("code") / 4) * 4 + TWICE).otherwise(F.col("code")).cast("int"))
    # A chunk's rows come from one range partition, so its codes are bounded like that.
    chunks = settled.groupBy("conv", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x.code).alias("codes"))

    def each(source: Iterator[tuple]) -> Iterator[tuple]:
        for conv, chunk, own in source:
            codes = bytes(own)
            vectors = [forward(codes, 0, len(codes), s) for s in range(4)]
            initials = "".join(CLASSES[c // 4] for c in codes)
            illegal = sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
            count = [sum(c % 4 == fault for c in codes) for fault in (BLANK, TWICE, CUT)]
            yield conv, chunk, codes, [c for v in vectors for c, _ in v], [r for v in vectors for _, r in v], initials[0] + initials[-1], *count, illegal

    return mapped(chunks, SUMS, each)


def crossed(sums: DataFrame) -> DataFrame:
    """CROSSED: where each chunk starts and may end; the conversation's figures with its last chunk."""
    ordered = sums.select("conv", "chunk", "costs", "ranks", "ends", "blank", "duplicate", "truncated", "illegal").repartition("conv").sortWithinPartitions("conv", "chunk")

    def each(source: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(source, lambda r: r[0]):
            chunks = list(own)
            vectors = [at(0)]
            for _, _, costs, ranks, *_ in chunks:
                ways = [min(((c + costs[4 * s + t], r, ranks[4 * s + t]) for s, (c, r) in enumerate(vectors[-1]) if c < NEVER and costs[4 * s + t] < NEVER), default=(NEVER, 4, 4)) for t in range(4)]
                vectors.append(ranked(ways))
            behind = [tuple(c for c, _ in TAIL)]
            for _, _, costs, *_ in reversed(chunks):
                behind.append(tuple(min(min(costs[4 * s + t] + behind[-1][t], NEVER) for t in range(4)) for s in range(4)))
            behind.reverse()
            crossings = [min(range(4), key=lambda s: (v[s][0] + b[s], v[s][1])) for v, b in zip(vectors, behind)]
            joints = sum(a[4][1] + b[4][0] not in ("su", "ua", "au") for a, b in zip(chunks, chunks[1:]))
            figures = [sum(c[i] for c in chunks) for i in (5, 6, 7, 8)]
            figures[3] += joints
            for n, (_, chunk, *_) in enumerate(chunks):
                last = n == len(chunks) - 1
                ends = [c for c, _ in TAIL] if last else [0 if s == crossings[n + 1] else NEVER for s in range(4)]
                yield conv, chunk, crossings[n], ends, last, *(figures if last else [None] * 4), behind[0][0] if last else None

    return mapped(ordered, CROSSED, each)


def edited(sums: DataFrame, crossings: DataFrame) -> DataFrame:
    """EDITS: every edit, k-th at its row; those behind the last row stand at its seq + 1."""
    chunks = sums.select("conv", "chunk", "codes").join(crossings.select("conv", "chunk", "start", F.col("ends").alias("to"), "last"), ["conv", "chunk"])

    def each(source: Iterator[tuple]) -> Iterator[tuple]:
        for conv, chunk, codes, state, ends, last in source:
            for seq, edits in enumerate(hirschberg(codes, 0, len(codes), state, tuple(ends))):
                given, state = written(edits, CLASSES[codes[seq] // 4], state)
                for k, pair in enumerate(zip(edits, given)):
                    yield conv, chunk, seq, k, *pair
            if last:
                tail = TAIL[state][1]
                for k, pair in enumerate(zip(tail, written(tail, "", state)[0])):
                    yield conv, chunk, len(codes), k, *pair

    return mapped(chunks, EDITS, each)


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every edit with its row, and one row of figures for each conversation that has rows.

    The first has conv, (chunk, seq, k) in whose order edits stand, edit (D, I,
    K or R), role and text; rows of edit D are not part of the repaired
    conversation. The second has conv, blank, duplicate, truncated, illegal, cost.
    """
    rows = stored(placed(conversations), "repair-rows")
    sums = stored(summed(rows), "repair-chunks")
    crossings = stored(crossed(sums), "repair-crossings")
    edits = edited(sums, crossings).join(rows.select("conv", "chunk", "seq", "role", "text"), ["conv", "chunk", "seq"], "left")
    role = F.when(F.col("given") == "u", "user").when(F.col("given") == "a", "assistant").otherwise(F.col("role"))
    text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    return edits.select("conv", "chunk", "seq", "k", "edit", role.alias("role"), text.alias("text")), crossings.where("last").select("conv", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of `conv_id:turn` modulo 20; a null counts as one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    out = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), c.alias("__damage"), role.alias("role"), text.alias("text")).where("__damage <> 0")
    return out.select("conv_id", "turn", F.when(F.col("__damage") == 4, "user").otherwise(F.col("role")).alias("role"),
                      F.when(F.col("__damage") == 1, "").when(F.col("__damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                      F.explode(F.array_repeat(F.lit(0), F.when(F.col("__damage") == 3, 2).otherwise(1))).alias("__copy")).drop("__copy")


def digests(edits: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256: one digest runs over a whole conversation, so each is
    read by one task, in order, holding the audit and one row."""
    import hashlib

    columns = {"conv": pa.string(), "audit": pa.string(), "repaired_sha256": pa.string()}
    ordered = edits.repartition("conv").sortWithinPartitions("conv", "chunk", "seq", "k").select("conv", "edit", "role", "text")

    def each(source: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(source, lambda r: r[0]):
            audit, digest, first = [], hashlib.sha256(), True
            for _, edit, role, text in own:
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            yield conv, "".join(audit), digest.hexdigest()

    return mapped(ordered, columns, each)


def repair_figures(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `original` on the repair of `rows`."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL)).alias("conv")
    edits, figures = repaired(rows)
    turns = rows.select(key, F.col("turn").cast("long").alias("turn")).where("turn is not null").distinct()
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    every = original.select(key, F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(gaps, "conv", "left").join(figures, "conv", "left").join(digests(edits), "conv", "left")
    none = F.sha2(F.lit(""), 256)
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
