"""The pipeline's stages, one after another, against brute force on a small fixture."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import decontaminate, lines, minhash, quality_fm
from folioscope.llm.common import WordHashes
from folioscope.llm.queries import ranks_path

from .test_operators import brute_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_dropped int, n_lines string, kept string, `a.b` string, __text string, __id string, whole string, __d string"
ITEM = [f"q{i}" for i in range(20)]


def brute_lines(rows):
    """(doc_id, text) rows without recurring lines, by gathering every leaf."""
    mask = lambda t: "<*>" if re.search("[0-9@]", t) else t

    def form_of(line):
        """A line's leaf and form; variables alone stand for themselves."""
        raw = tuple(line.split())
        form = tuple(map(mask, raw))
        return (raw, raw) if set(form) == {"<*>"} else ((len(form), form[:3]), form)

    leaves = defaultdict(lambda: defaultdict(dict))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if line.split():
                leaf, form = form_of(line)
                leaves[leaf][form].setdefault(t, set()).add(i)
    drop = {}
    for forms in leaves.values():
        total, votes = sum(map(len, forms.values())), defaultdict(Counter)
        for form, own in forms.items():
            for k, token in enumerate(form):
                votes[k][token] += len(own)
        fits = {f for f in forms if len(forms) > 1 and total >= lines.MIN_DOCS and sum(2 * votes[k][t] > total for k, t in enumerate(f)) >= lines.AGREE * len(f)
                and any(2 * votes[k][t] > total and t != "<*>" for k, t in enumerate(f))}
        for unit in [fits, *[{f} for f in forms if f not in fits]]:
            own = defaultdict(set)
            for f in unit:
                for t, ids in forms[f].items():
                    own[t] |= ids
            if len(own) >= lines.MIN_DOCS:
                first = min(i for ids in own.values() for i in ids)
                drop |= {f: first for f in unit}

    def rest(i, t):
        return "\n".join(x for x in t.split("\n") if drop.get(form_of(x)[1], i) == i)
    return [(i, t if t is None else rest(i, t)) for i, t in rows]


def brute_items(text, item, share=0.7):
    """Whether any diagonal agrees on enough of the item's words, seeds or none."""
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return any(sum(0 <= d + j < len(w) and w[d + j] == x for j, x in enumerate(item)) >= share * len(item) - 1e-9 for d in range(-len(item), len(w)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "so", "ti", "ve", "zu", "den", "mor", "lin")]
    text = lambda n: " ".join(rng.choices(words, k=n)) + "."
    good = [text(rng.randint(30, 60)) for _ in range(40)]
    for k in range(8):
        good[k] += f"\nread release {k} of this shared notice {rng.choice(words)} now\n{text(20)}"
    changed = list(ITEM)
    changed[4] = changed[13] = "other"
    good[20] += " " + " ".join(ITEM)
    good[21] = " ".join(changed).upper() + ", " + good[21]
    texts = [*good, *good[10:14], good[15] + " end", "a\nb " + good[16], *["!!!! #### " * rng.randint(5, 20) for _ in range(20)], None, "", " \n", text(5000), good[0]]
    rows = [(i, t, None, "s", len(t or ""), 0.5, 3, "x", "y", "z", "p", "q", "r", "s") for i, t in enumerate(texts)]
    rows += [rows[3], rows[30], (None, text(40), *[None] * 12)]
    out = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(out / "documents.parquet"))
    labels = [(i, int("#" not in (t or "#"))) for i, t in enumerate(texts)]
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(ITEM)), (2, None)], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def test_every_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    start = docs.collect()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            docs = corpus_pipeline.stored(out, f"test-{name}")
        seen[name] = (before, out.collect() if name == "packing" else docs.collect())
    key = lambda rows: sorted(map(str, rows))

    before, after = seen["quality"]
    machine, hashes = quality_fm.fit(spark.createDataFrame(start, SCHEMA).repartition(2), spark.read.parquet(f"{folder}/labels.parquet")), WordHashes()
    sure = lambda r: machine.score(*machine.row(*quality_fm.described((r.text or "").encode(), hashes)))[0]
    assert key(after) == key(r for r in before if sure(r) >= quality_fm.THRESHOLD) and 40 <= len(after) < len(before)

    before, after = seen["lines"]
    last = 1 << 62
    want = brute_lines([(last if r.doc_id is None else r.doc_id, r.text) for r in before])
    assert key((r.doc_id, r.text) for r in after) == key((None if i == last else i, t) for i, t in want)
    assert {r.doc_id for r in after if r.text and "shared notice" in r.text} == {0} and all(r.n_dropped in (3, None) and r.score in (0.5, None) for r in after)
    assert all(r.n_chars == len(r.text) for r in after if r.doc_id is not None and r.text is not None)

    before, after = seen["near"]
    kept = {i for i, _, _, k in brute_near([(r.doc_id, r.text) for r in before]) if k}
    assert key(after) == key([*{r for r in before if r.doc_id in kept}, *[r for r in before if r.doc_id is None]]) and len(after) < len(before)

    before, after = seen["decontamination"]
    assert key(after) == key(r for r in before if not brute_items(r.text, ITEM)) and {20, 21} == {r.doc_id for r in before} - {r.doc_id for r in after}

    before, after = seen["packing"]
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in before}
    pieces = defaultdict(list)
    for r in after:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        own.sort()
        assert [s for s, _, _ in own] == np.cumsum([0, *[n for _, n, _ in own]])[:-1].tolist() and sum(n for _, n, _ in own) == len(want[i])
        assert all(zlib.crc32(want[i][s:s + n].tobytes()) == c for s, n, c in own)


def test_run_is_the_stages_and_takes_empty_tables(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder)
    assert got.select(F.sum("length")).first()[0] > 1000 and got.where("offset + length > 1024").count() == 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_documents_of_two_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == ["doc_id", "text"] and 0 < out.count() <= docs.count()


def test_every_allowed_change_leaves_a_spaced_seed(spark):
    """All patterns of changes that the share allows, up to 20 words; most masks have a gap."""
    from itertools import combinations
    from math import ceil

    assert sum(m != tuple(range(len(m))) for m in decontaminate.MASKS) == 3
    items = spark.createDataFrame([(n, [100 * n + i for i in range(n)]) for n in range(1, 61)], "item_id long, h array<long>").withColumn("item_hash", F.xxhash64("h"))
    held = defaultdict(list)
    for r in decontaminate.item_seeds(items, 0.7).collect():
        held[r.item_id].append({r.item_place + o for o in (decontaminate.MASKS[r.mask - 1] if r.mask > 0 else range(-r.mask))})
    rng = random.Random(2)
    for n in range(1, 61):
        k = n - ceil(0.7 * n)
        patterns = combinations(range(n), k) if n <= 20 else (rng.sample(range(n), k) for _ in range(3000))
        assert all(any(seed.isdisjoint(p) for seed in held[n]) for p in map(set, patterns)), n
        assert n < 8 or all(len(seed) == 4 for seed in held[n])


def test_changed_items_are_found_at_any_length(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["of", "the", "in", *[f"w{i}" for i in range(40)]])
    items = [[word() for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 15, 20, 33) for _ in range(2)]
    rows = []
    for i in range(300):
        item = list(rng.choice(items))
        for j in rng.sample(range(len(item)), rng.randint(0, (len(item) * 4) // 10)):
            item[j] = "other"
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 9))] + item + [word() for _ in range(rng.randint(0, 9))])))
    test = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[1][1])], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, test).collect()}
    assert got == {(d, i) for d, t in [*rows, (None, rows[1][1])] for i, item in enumerate(items) if brute_items(t, item)}
