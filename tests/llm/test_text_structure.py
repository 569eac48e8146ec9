"""Alignment, license scans and conversation repair against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import alignment, licenses, repair
from folioscope.llm.packing import tokenizer
from folioscope.llm.queries import pieces_path, ranks_path

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()]


# Alignment

ODD = ["", " ", "a", "  two  blanks\n\n\ttab", "<|endoftext|> <s> </s> <unk> [INST]", "naïve café ﬁ ½ Ａ", "日本語のテキスト and 한국어", "👩‍👩‍👧 ​ é", "▁under", "x" * 3000, "<0x41>", "\x00\x01", "a\r\nb\r"]


def brute_alignment(texts):
    """Rows by intervals of all byte offsets, without dictionaries of ends."""
    own = alignment.Tokenizers(ranks_path(), pieces_path())
    rows, held = [], []
    for doc_id, text in texts:
        a, b = own.ids(text or "")
        spans_a, spans_b = [], []
        for ids, spelled, spans in ((a, own.a, spans_a), (b, own.b, spans_b)):
            at = 0
            for i in ids:
                spans.append((at, at + len(spelled[i]), i))
                at += len(spelled[i])
        linked = [(x, y) for s, e, x in spans_a for t, f, y in spans_b if s < f and t < e]
        common = sorted({e for _, e, _ in spans_a} & {e for _, e, _ in spans_b})
        said = ";".join(",".join(str(i) for s, e, i in spans_a if low < e <= high) + "|" + ",".join(str(i) for s, e, i in spans_b if low < e <= high) for low, high in zip([0, *common], common))
        held.append(Counter(linked))
        rows.append((doc_id, len(a), len(b), len(common), len(linked), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    docs = Counter(p for h in held for p in h)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    return sorted(((*row[:5], sum(n for p, n in h.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in h.items()), row[5]) for row, h in zip(rows, held)), key=str)


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_alignment_equals_brute_force(spark, given, head, monkeypatch):
    monkeypatch.setattr(alignment, "SUMMED", 500)
    short = sorted(given, key=lambda r: len(r[1]))[:20]
    texts = [*short, *[(500 + i, t) for i, t in enumerate(ODD)], (7, None), (None, "null id"), short[3], short[3]]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, pairs string, row int").repartition(3)
    got = alignment.alignment(docs, ranks_path(), pieces_path(), head)
    assert sorted(map(tuple, got.collect()), key=str) == brute_alignment(texts)
    assert alignment.alignment(docs.limit(0), ranks_path(), pieces_path(), head).count() == 0


def test_ids_are_those_of_the_named_vocabulary(spark):
    """The rank file gives the ids of the JSON file, on a whole table and odd texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    named.encode_special_tokens = True
    encode = tokenizer(ranks_path())
    texts = [r.text or "" for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("text").collect()] + ODD
    assert [encode(" " + t) for t in texts] == [e.ids for e in named.encode_batch([" " + t for t in texts], add_special_tokens=False)]


# License scans

def brute_licenses(texts, templates, threshold):
    out = []
    for doc_id, text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places, labels, base, score = [], set(), set(), 0.0
        for t in templates:
            own = licenses.template_words(t.text)
            if t.phrase:
                found = [i for i in range(len(words)) if words[i:i + len(own)] == own]
                places += found
                share = float(bool(found))
                base |= {t.label} if found else set()
            else:
                half = 2 ** math.ceil(math.log2(len(own)))
                share = max((len(set(own) & set(words[k:k + 2 * half])) / len(set(own)) for k in range(0, len(words), half)), default=0.0)
                share = share if share * len(set(own)) >= math.ceil(threshold * len(set(own))) - 1e-9 else 0.0
            labels |= {t.label} if share else set()
            score = max(score, share)
        out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [128, 512])
def test_license_scan_equals_brute_force(spark, given, segment, monkeypatch):
    monkeypatch.setattr(licenses, "SEGMENT", segment)
    rng = random.Random(3)
    filler = [t for _, t in given]
    texts = list(given)
    for i, t in enumerate(licenses.TEMPLATES * 3):
        own = licenses.template_words(t.text)
        for _ in range(rng.choice([0, 0, 1, 2, len(own) // 5, len(own) // 4])):
            own[rng.randrange(len(own))] = "other"
        texts.append((1000 + i, f"{rng.choice(filler)} {' '.join(own).upper()}, {rng.choice(filler)}"))
    texts += [(1, None), (2, ""), (3, "\n .,"), (None, "MIT  License"), (4, "mit-license mit license. MIT\nLICENSE " * 400), (5, "é mit licensé license"), (6, "mit " * 300 + "license"), texts[-1], texts[3], texts[3]]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, row int, label string").repartition(3)
    got = [(*tuple(r)[:7], round(r.score, 9)) for r in licenses.license_scan(docs).collect()]
    assert sorted(got, key=str) == brute_licenses(texts, licenses.TEMPLATES, licenses.THRESHOLD)
    assert sum(bool(r[6]) for r in got) > 30 and licenses.license_scan(docs.limit(0)).count() == 0


# Conversation repair

def cheapest(codes):
    """Dijkstra over (cost, edits): independent of forward, backward and moves."""
    inserted = {0: 2, 1: 2, 2: 3, 3: 2}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, said, i, state = heapq.heappop(heap)
        if i == len(codes) and state in (0, 3):
            return cost, said
        if (i, state) in seen:
            continue
        seen.add((i, state))
        heapq.heappush(heap, (cost + 2, said + "I", i, inserted[state]))
        if i < len(codes):
            kind, fault = repair.CLASSES[codes[i] // 4], codes[i] % 4
            heapq.heappush(heap, (cost + 3, said + "D", i + 1, state))
            if fault < 2:
                heapq.heappush(heap, (cost + 2 + fault, said + "R", i + 1, inserted[state]))
                if (kind, state) in repair.STEP:
                    heapq.heappush(heap, (cost + fault, said + "K", i + 1, repair.STEP[kind, state]))


def hirschberg_audit(codes):
    said, state = "", 0
    for c, edits in zip(codes, repair.hirschberg(codes, 0, len(codes), 0, tuple(c for c, _ in repair.TAIL))):
        said += edits
        state = repair.written(edits, repair.CLASSES[c // 4], state)[1]
    return said + repair.TAIL[state][1]


def test_hirschberg_gives_the_least_of_the_cheapest():
    rng = random.Random(1)
    for _ in range(1500):
        codes = bytes(rng.choices(range(16), weights=[1, 1, 1, 1, 2, 1, 1, 1, 6, 1, 1, 1, 6, 1, 1, 1], k=rng.randint(0, 14)))
        assert (repair.backward(codes, 0, len(codes), tuple(c for c, _ in repair.TAIL))[0], hirschberg_audit(codes)) == cheapest(codes)


def brute_repair(rows):
    """conv_id -> figures, from the rows (conv_id, turn, role, text) as they are; one conversation at a time."""
    out, convs = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in convs.items():
        seen, codes, faults = set(), [], Counter()
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for _, role, text in own:
            plain = text.strip(" \t\n\x0b\x0c\r")
            fault = 2 if not plain else 3 if (role, text) in seen else 0 if plain[-1] in ".!?" else 1
            seen.add((role, text))
            faults[fault] += 1
            codes.append(repair.code_of(role, fault))
        cost, audit = cheapest(codes)
        state, said, i = 0, [], 0
        for e in audit:
            role, text = own[i][1:] if e != "I" else ("", "")
            i += e != "I"
            if e != "D":
                role = role if e == "K" else "assistant" if state == 2 else "user"
                said.append(f"{role}:{text}")
                state = repair.STEP[role[0], state]
        turns = [t for t, _, _ in own if t is not None]
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults[2], faults[3], faults[1], pairs, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_repair_equals_brute_force_over_chunks(spark, coalesce):
    """One conversation holds most rows and is spread over several chunks, repeated rows over all of them."""
    rng = random.Random(5)
    rows = []
    for conv, n in ((1, 600), (2, 6), (3, 1), (None, 9), (4, 40), (5, 12)):
        for t in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice([f"said {conv} {t}.", f"said {conv} {t}", "", " \n", "again.", "again?", None, f"long {t}! " * 20])
            rows.append((conv, None if rng.random() < 0.03 else t * 3 - 5, role, text))
    rows += [(6, 0, "user", None), (7, 1, "system", "only."), (7, None, "assistant", "x!"), (8, 2, "user", "same."), (8, 2, "user", "same."), (8, 2, "user", "same.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, chunk int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = {r.conv_id: tuple(r)[1:] for r in repair.repair_figures(df, df).collect()}
        chunks = repair.placed(df).where("conv = '1'").select(F.count_distinct("chunk")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_repair(rows)
    assert chunks > 1 or coalesce == "true"
    assert repair.repair_figures(df.limit(0), df.limit(0)).count() == 0


def test_damage_follows_the_key(spark):
    rows = [(i, t, "assistant", "One. Two! Three?") for i in range(40) for t in range(4)] + [(None, None, None, None), (99, None, "user", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, __copy int")
    want = []
    for conv, turn, role, text in rows:
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        want += [(conv, turn, "user" if c == 4 else " " if role is None else role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    assert Counter(map(tuple, repair.damaged(df).collect())) == Counter(want) and len(want) != len(rows)


def test_conversations_without_rows_are_reported(spark):
    df = spark.createDataFrame([(1, 0, "user", "a."), (2, 0, "user", "b.")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_figures(df, df.where("conv_id = 1")).collect()}
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[1][5:7] == (2, "KI")


def test_slices_of_id_lists_are_arrays():
    """Groups of one token each come out of array work; the others are said and linked one by one."""
    aligner = alignment.Aligner([b"", b"a", b"bc", b"def"], [b"", b"ab", b"c", b"de", b"f"])
    p, q = aligner.slices(np.array([1, 2, 3, 1, 2]), np.array([1, 2, 3, 4, 1, 2]))
    assert (p.tolist(), q.tolist()) == ([2, 3, 5], [2, 4, 6])
    said, keys = aligner.read([1, 2, 3, 1, 2], [1, 2, 3, 4, 1, 2])
    links = [(1, 1), (2, 1), (2, 2), (3, 3), (3, 4), (1, 1), (2, 1), (2, 2)]
    assert said == ["1,2|1,2", "3|3,4", "1,2|1,2"] and sorted(keys.tolist()) == sorted(a * alignment.SECOND + b for a, b in links)
    said, keys = aligner.read([], [])
    assert said == [] and keys.tolist() == []


def test_groups_and_links_are_written_by_arrays():
    """All groups as one text, and a link for each place where a token of either list ends."""
    aligner = alignment.Aligner([b"", b"a", b"bc", b"def"], [b"", b"ab", b"c", b"de", b"f"])
    text, groups, keys = aligner.joined([1, 2, 3, 1, 2], [1, 2, 3, 4, 1, 2])
    assert (text, groups) == ("1,2|1,2;3|3,4;1,2|1,2", 3)
    assert [divmod(k, alignment.SECOND) for k in keys.tolist()] == [(1, 1), (2, 1), (2, 2), (3, 3), (3, 4), (1, 1), (2, 1), (2, 2)]
    assert aligner.joined([], [])[:2] == ("", 0)
