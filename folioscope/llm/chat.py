"""Chat formatting: a finite-state machine over roles and a declarative template.

`segments` turns conversation rows into text segments with a loss flag each;
`read_back` parses the joined segments again. Rows of one conversation meet in
one sorted stream and are never gathered, so a conversation of any length needs
the memory of one turn. Ties of `turn` are ordered by role, then text; null
turns come first. A null role or text is empty; a null conv_id is one
conversation of its own; repeated rows are turns like others; an empty table
gives no segments. A turn order that the machine refuses is still formatted;
its first refused turn is reported as `refused_at`. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches

#: Template: what opens and closes a conversation and a turn, and the roles that are learned.
TEMPLATE = {
    "begin": "<s>",
    "turn": ("<|im_start|>{role}\n", "<|im_end|>\n"),
    "end": "</s>",
    "learned": ("assistant",),
    "control": ("<s>", "</s>", "<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"),
}

#: Turn order: state -> role -> next state; None refuses.
MACHINE = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}

SEGMENTS = {"conv_id": pa.int64(), "turn_no": pa.int64(), "role": pa.string(), "part": pa.string(), "text": pa.string(), "loss": pa.bool_(), "refused": pa.bool_()}
READ = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "refused_at": pa.int64()}
SPARK = {pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean"}


def ddl(columns: dict) -> str:
    return ", ".join(f"{c} {SPARK[t]}" for c, t in columns.items())


def escape(text: str, control: re.Pattern) -> str:
    """Break every control string by a backslash after its first character; double backslashes."""
    return control.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def control_pattern(template: dict) -> re.Pattern:
    return re.compile("|".join([r"\\", *map(re.escape, sorted(template["control"], key=len, reverse=True))]))


def emitter(template: dict, machine: dict):
    control = control_pattern(template)
    opening, closing = template["turn"]

    def emit(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, state, n, refused = object(), "start", 0, False
        for conv, role, text in rows:
            if conv != now:
                if n:
                    yield now, n, None, "end", template["end"], False, refused
                now, state, n, refused = conv, "start", 0, False
                yield conv, 0, None, "begin", template["begin"], False, False
            state = machine.get(state, {}).get(role)
            refused = refused or state is None
            learned = role in template["learned"]
            name = escape(role, control).replace("\n", "\\\n")
            yield conv, n, role, "open", opening.format(role=name), False, refused
            yield conv, n, role, "text", escape(text, control), learned, refused
            yield conv, n, role, "close", closing, False, refused
            n += 1
        if n:
            yield now, n, None, "end", template["end"], False, refused

    return emit


def segments(conversations: DataFrame, template: dict = TEMPLATE, machine: dict = MACHINE) -> DataFrame:
    """Segments in order within (conv_id): begin, then open, text, close for each turn, then end."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    emit = emitter(template, machine)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in parts for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from batches(SEGMENTS, emit(rows))

    return ordered.mapInArrow(run, ddl(SEGMENTS))


def read_back(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Digests of what the formatted text and its loss mask say, one row per conversation.

    Takes `segments` in its own partitions and order. Turns are found in the
    text alone: marks that no backslash breaks, role up to the line's end.
    """
    marks = re.compile("|".join(map(re.escape, template["control"])))
    head, tail = template["turn"][0].split("{role}")
    close = template["turn"][1]

    def parse(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, held = object(), None
        for conv, no, _role, part, text, loss, refused in rows:
            if part == "begin":
                now, held = conv, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "at": None, "turn": ""}
            held["all"] += len(text)
            if refused and held["at"] is None:
                held["at"] = no
            if loss:
                plain = unescape(text)
                held["chars"] += len(plain)
                held["loss"].update(plain.encode())
            if part == "end":
                yield now, held["n"], held["turns"].hexdigest(), held["chars"], held["loss"].hexdigest(), held["all"], held["at"]
            elif part != "begin":
                held["turn"] += text
                if part == "close":
                    body = held["turn"].removeprefix(head).removesuffix(close)
                    if marks.search(body):
                        raise ValueError(f"a control string stands in a text of conversation {conv}")
                    role, said = re.match(rf"((?:[^\\\n]|\\.)*){re.escape(tail)}(.*)\Z", body, re.S).groups()
                    held["turns"].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                    held["n"] += 1
                    held["turn"] = ""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in parts for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from batches(READ, parse(rows))

    return formatted.mapInArrow(run, ddl(READ))
