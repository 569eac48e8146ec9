"""Fixed vocabulary of notes: kinds, statuses, transitions, tiers, path classes.

All tables here are fixed values the results depend on. As DataFrames they have
a constant size, which is why the operators may broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Statuses by kind, the first one being the initial status.
STATUSES = {
    "proposition": ("open", "conjectured", "testing", "supported", "refuted", "superseded", "disputed", "conflict"),
    "question": ("open", "answered", "abandoned", "conflict"),
    "line": ("exploring", "active", "writing", "dormant", "closed", "conflict"),
}
INITIAL = {kind: names[0] for kind, names in STATUSES.items()}

# Where each status may go; `conflict` is always added.
MOVES = {
    "proposition": {
        "open": ("conjectured", "testing", "supported", "refuted", "superseded"),
        "conjectured": ("testing", "supported", "refuted", "superseded"),
        "testing": ("conjectured", "supported", "refuted", "superseded"),
        "supported": ("testing", "refuted", "disputed", "superseded"),
        "refuted": ("testing", "disputed", "superseded"),
        "disputed": ("testing", "supported", "refuted", "superseded"),
        "superseded": (),
        "conflict": ("open", "conjectured", "testing", "supported", "refuted", "disputed", "superseded"),
    },
    "question": {
        "open": ("answered", "abandoned"),
        "answered": ("open", "abandoned"),
        "abandoned": ("open",),
        "conflict": ("open", "answered", "abandoned"),
    },
    "line": {
        "exploring": ("active", "writing", "dormant", "closed"),
        "active": ("exploring", "writing", "dormant", "closed"),
        "writing": ("active", "dormant", "closed"),
        "dormant": ("exploring", "active", "writing", "closed"),
        "closed": ("active", "dormant"),
        "conflict": ("exploring", "active", "writing", "dormant", "closed"),
    },
}

# Who decides, which statuses are open, settled or queued.
HUMAN_SOURCES = ("conflict", "disputed", "closed")
HUMAN_TARGETS = (("line", "closed"),)
OPEN = ("open", "conjectured", "testing")
SETTLED = ("supported", "refuted")
CLOSED_PROPOSITION = ("supported", "refuted", "superseded")
COOL = ("supported", "refuted", "superseded", "answered", "abandoned", "dormant", "closed")
BETS = ("supported", "refuted", "unknown")
KEY_MOVES = ("new-method", "known-method-new-setting", "reduction-to-known", "brute-force", "lucky-observation")
LIST_FIELDS = ("line", "tags", "depends_on", "answers", "derivation", "evidence")
UNLINED = "(unlined)"
REVIEWER, HUMAN, CLI = "reviewer", "human", "cli"
WIP_LIMIT, STALL_DAYS = 7, 21

# Temperature by path prefix.
TIERS = (("raw/", "cold"), ("wiki/references/", "cold-derived"), ("wiki/concepts/", "warm-shared"),
         ("wiki/topics/", "warm-shared"), ("drafts/", "warm-line"), ("inbox/", "hot"), ("scratch/", "hot"))

# Durability classes, most specific class first.
DURABILITY = (
    ("transactional", ("output/ingest/", "output/radar/", "output/reflect/ledger.jsonl", "output/llm-ledger.jsonl")),
    ("derived", ("output/graph.db", "output/index.db", "output/.lint_cache.json", "output/.locks/",
                 "output/MAP.md", "output/fanout.jsonl", "scratch/")),
    ("original", ("raw/", "wiki/", "inbox/", "threads/", "drafts/", "output/reflect/patterns/",
                  "decisions.md", "config.yaml", "config.md")),
)

# What each top directory is for.
LAYOUT = (
    ("raw", True, True, True, False, None),
    ("wiki", True, True, True, True, 3),
    ("drafts", True, True, True, False, 1),
    ("threads", False, True, False, True, 2),
    ("tools", False, False, False, False, None),
    ("inbox", False, False, False, False, None),
    ("output", False, False, False, False, None),
    ("scratch", False, False, False, False, None),
)


def transitions(spark: SparkSession) -> DataFrame:
    """Every legal move: kind, src, dst, writer, human_only."""
    rows = []
    for kind, table in MOVES.items():
        for src, targets in table.items():
            for dst in targets + ("conflict",):
                human = dst != "conflict" and (src in HUMAN_SOURCES or (kind, dst) in HUMAN_TARGETS)
                writer = "cli" if dst == "conflict" else "human" if human else "anyone"
                rows.append((kind, src, dst, writer, human))
    return spark.createDataFrame(rows, "kind string, src string, dst string, writer string, human_only boolean") \
        .dropDuplicates(["kind", "src", "dst"])


def layout(spark: SparkSession) -> DataFrame:
    """Directories by role."""
    return spark.createDataFrame(list(LAYOUT), "top string, rewritten boolean, searchable boolean, "
                                 "documents boolean, graphed boolean, wikilink int")


def initial_status(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, status in INITIAL.items():
        out = F.when(kind == name, F.lit(status)).otherwise(out)
    return out


def is_status(kind: Column, status: Column) -> Column:
    ok = F.lit(False)
    for name, names in STATUSES.items():
        ok = ok | ((kind == name) & status.isin(*names))
    return ok


def clean_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def tier_of(path: Column, status: Column | None = None) -> Column:
    """Temperature of a path; for notes, of the status. Longest prefix first."""
    p = clean_path(path)
    known = status if status is not None else F.lit(None).cast("string")
    out = F.when(p.startswith("threads/"),
                 F.when(known.isin(*COOL), "warm-line").otherwise("hot"))
    for prefix, tier in sorted(TIERS, key=lambda t: -len(t[0])):
        out = out.when(p.startswith(prefix), tier)
    return out


def durability_of(path: Column) -> Column:
    """original, derived, transactional or unknown."""
    p = clean_path(path)
    out = None
    for name, entries in DURABILITY:
        hit = F.lit(False)
        for entry in entries:
            if entry.endswith("/"):
                hit = hit | p.startswith(entry) | (p == entry.rstrip("/"))
            else:
                hit = hit | (p == entry) | p.endswith("/" + entry)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")
