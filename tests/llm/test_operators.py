"""Operators against brute force, round trips and held-out accuracy on small tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import chat, decontaminate, lines, minhash, packing, quality_fm, sharding, substrings, topk, toxicity
from folioscope.llm.common import WordHashes
from folioscope.llm.queries import ORACLES, QUERIES, ranks_path

ROOT = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score string, key string"


@pytest.fixture(scope="module")
def base():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(30, 80))) for _ in range(20)]


@pytest.fixture(scope="module")
def rows(base):
    """Copies, near copies, nulls, empty and long texts, repeated rows, clashing columns."""
    texts = [*base, *base[:4], *[t.replace(" ", "  ", 3) + " tail" for t in base[:6]], None, "", " \n ", "a b", "A  b", "short one here", " ".join(base * 3), "Ünï çödé   x" * 9]
    out = [(i, t, None, "s", "k") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, base[0], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_agree_with_words():
    h = WordHashes()
    text = b"b  a\tb\na \x0bc" + b" b" * 5
    words = text.split()
    own = h.of(text)
    assert len(own) == len(words) and len({(w, int(x)) for w, x in zip(words, own)}) == 3
    h.LONGEST = 8
    assert h.of(b"abc d abc").tolist() == WordHashes().of(b"abc d abc").tolist()
    assert len(h.of(b"")) == 0 and len(h.of(b" \n")) == 0


def brute_near(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, docs, rows):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got if r.doc_id is not None} == brute_near(rows)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_open_buckets_find_chains_without_heads(spark, monkeypatch):
    """Links that no head sees are still found, among many close texts that are not linked."""
    rng = random.Random(9)
    stem = [f"s{i}" for i in range(120)]
    out = []
    for i in range(60):
        w = list(stem)
        for j in rng.sample(range(120), 3 if i % 3 else 5):
            w[j] = f"x{i // 2}-{j}" if i % 4 == 0 else f"x{i}-{j}"
        out.append((i, " ".join(w), None, None, None))
    monkeypatch.setattr(minhash, "BLOCK", 500)
    got = {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(out, DOCS)).collect()}
    assert got == brute_near(out)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40, 2)] + [(i, i + 2) for i in range(0, 20, 2)] + [(100, 100), (7, 90)]
    got = dict(minhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(1, 22)) and got[90] == 0 and got[31] == 30 and not {0, 30, 100} & set(got)


def brute_substrings(rows):
    seen, out = {}, []
    place = sorted((i if i is not None else substrings.LAST_ID, s, i, t) for i, t, *_ in rows for s in range(max(len((t or "").encode().split()) - 19, 0)))
    for i, s, _, t in place:
        seen.setdefault(tuple(t.encode().split()[s:s + 20]), (i, s))
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            if seen[tuple(w[s:s + 20])] != (i if i is not None else substrings.LAST_ID, s):
                gone |= set(range(s, s + 20))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [substrings.GROUP, 2])
def test_substrings_equal_brute_force(docs, rows, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    got = substrings.without_repeats(docs).drop("text").collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows)


def test_substrings_of_runs_and_nothing(spark):
    rows = [(1, "a " * 70, None, None, None), (2, "a " * 25 + "b", None, None, None)]
    assert sorted(map(tuple, substrings.without_repeats(spark.createDataFrame(rows, DOCS)).drop("text").collect()), key=str) == brute_substrings(rows)
    assert substrings.without_repeats(empty(spark)).count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.integers(-40, 40, 8)]) for i in range(400)] + [(1000 + i, [5.0] * 8) for i in range(90)]
    odd = [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (None, [1.0] * 8), vectors[0]]
    df = spark.createDataFrame(vectors + odd, "id long, vector array<double>")
    monkeypatch.setattr(topk, "LEAF", 16)
    got = [tuple(r) for r in topk.top_k(df, df.where("id % 20 = 0"), 7, shard_rows=100).collect()]
    want = []
    for q, v in vectors:
        if q % 20 == 0:
            best = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q)[:7]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0), 7).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [])], "id long, vector array<double>")
    with pytest.raises(ValueError, match="components"):
        topk.top_k(mixed, mixed, 7)
    alike = mixed.where("id <> 2")
    assert topk.top_k(alike, alike, 7).count() == 0


def exact_best(vectors, asked, k):
    top = 2**63 - 1
    want = []
    for q, v in vectors:
        if asked(q):
            scores = [(max(-top, min(top, sum(int(x) * int(y) for x, y in zip(v, w)))), i) for i, w in vectors if i != q]
            want += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(want)


def test_top_k_of_large_components_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = []
    for i in range(160):
        size = (40, 2**27, 2**31, 6.4e10, 1e300)[(i // 20 + i % 20) % 5]
        vectors.append((i, [float(np.floor(x * size)) for x in rng.uniform(-1, 1, 6)]))
    vectors += [(1000 + i, [float(2**30 + i % 3)] * 6) for i in range(60)]
    monkeypatch.setattr(topk, "LEAF", 8)
    df = spark.createDataFrame(vectors, "id long, vector array<double>")
    got = topk.top_k(df.selectExpr("*", "1 AS shard", "'x' AS known"), df.where("id % 20 = 0"), 9, shard_rows=20)
    assert sorted(tuple(r) for r in got.collect()) == exact_best(vectors, lambda q: q % 20 == 0, 9)


def test_top_k_leaves_out_shards_that_cannot_help(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = np.floor(rng.normal(0, 300, (24, 16)))
    vectors = [(i, (centres[i % 24] + np.floor(rng.normal(0, 4, 16))).tolist()) for i in range(2400)]
    df = spark.createDataFrame(vectors, "id long, vector array<double>")
    visits, keep = [], topk.searched
    monkeypatch.setattr(topk, "searched", lambda pairs, *rest: visits.append(pairs.select("block", "shard")) or keep(pairs, *rest))
    got = topk.top_k(df, df.where("id % 20 = 0"), 10, shard_rows=60)
    assert sorted(tuple(r) for r in got.collect()) == exact_best(vectors, lambda q: q % 20 == 0, 10)
    seen = [tuple(r) for v in visits for r in v.collect()]
    assert len(visits) == 3 and len(seen) == len(set(seen))
    blocks, shards = len({b for b, _ in seen}), 2400 // 60
    assert len(seen) < 0.5 * blocks * shards


def test_packing_is_whole_and_tight(docs, rows, spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, ranks_path(), 64).collect()
    pieces, sequences = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 3:
            pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids))
    for s in sequences.values():
        ends = [0, *[o + n for o, n in sorted(s)]]
        assert [o for o, _ in sorted(s)] == ends[:-1] and ends[-1] <= 64
    for i, text, *_ in rows:
        if i in pieces:
            ids = b"".join(p[2] for p in sorted(pieces[i]))
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids + [0]
    tokens = sum(r.length for r in got)
    padded = sum(0 if n & (n - 1) == 0 else 64 - n for n in (sum(x for _, x in s) for s in sequences.values()))
    assert padded < 0.15 * tokens
    assert packing.pack(empty(spark), ranks_path()).count() == 0


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(8)
    for _ in range(60):
        ends = np.cumsum(rng.integers(1, 7, rng.integers(1, 12)))
        price = rng.choice([0.0, 2.0, 24.0], len(ends))
        price[-1] = 0
        width = 9

        def cost(found):
            at = [0, *found]
            return sum(width - (b - a) for a, b in zip(at, at[1:])) + sum(price[list(ends).index(c)] for c in found)

        best = min((cost([e for k, e in enumerate(ends) if m >> k & 1]) for m in range(1 << len(ends)) if m >> (len(ends) - 1) and all(
            b - a <= width for a, b in zip([0, *[e for k, e in enumerate(ends) if m >> k & 1]], [e for k, e in enumerate(ends) if m >> k & 1]))), default=math.inf)
        assert cost(packing.cuts(ends, price, width, False)) == best


def test_sharding_law(spark, docs, tmp_path):
    for n in (0, 1, 2, 3, 97, 1000):
        path = str(tmp_path / f"t{n}")
        spark.range(n).selectExpr("id doc_id", "'x' text", "1 score").repartition(3).write.parquet(path)
        got = sharding.shuffle_to_shards(spark, path, 7).collect()
        assert sorted(r.permuted for r in got) == list(range(n)) == sorted(r.row_number for r in got)
        sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(7)]
        assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
        assert got == sharding.shuffle_to_shards(spark, path, 7).collect()
    spark.createDataFrame([(i, "y", i) for i in range(5)], "Slot long, __file string, index long").repartition(2).write.parquet(str(tmp_path / "clash"))
    got = sharding.shuffle_to_shards(spark, str(tmp_path / "clash"), 2)
    assert got.columns == ["__file", "index", *sharding.ADDED] and sorted(r.permuted for r in got.collect()) == list(range(5))


def plain_permutation(n, rows, hashes):
    """The network and its walk in plain Python; the hash alone is Spark's."""
    a, b = sharding.sides(rows)
    while True:
        left, right, sizes = n // b, n % b, (a, b)
        for r in range(sharding.ROUNDS):
            left, right = right, (left + hashes[r, right] % sizes[0]) % sizes[0]
            sizes = sizes[::-1]
        n = left * b + right
        if n < rows:
            return n


def test_permutation_equals_plain_python_and_files_are_not_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    path, rows, key = str(tmp_path / "p"), 60, 20240229
    spark.createDataFrame([(i if i % 7 else None, None if i % 5 == 0 else f"t{i % 3}") for i in range(rows)], "doc_id long, text string").repartition(4).write.parquet(path)
    got = sharding.shuffle_to_shards(spark, path, 7).collect()
    a, b = sharding.sides(rows)
    grid = spark.range(sharding.ROUNDS).crossJoin(spark.range(max(a, b)).toDF("x")).select("id", "x", F.xxhash64(F.lit(key), F.col("id").cast("int"), "x").alias("h")).collect()
    hashes = {(r.id, r.x): r.h for r in grid}
    assert [r.permuted for r in got] == [plain_permutation(r.row_number, rows, hashes) for r in got]
    monkeypatch.setattr(sharding, "BROADCAST_FILES", 0)
    monkeypatch.setattr(sharding, "STRETCH", 4)
    assert sorted(map(str, sharding.shuffle_to_shards(spark, path, 7).collect())) == sorted(map(str, got))


def test_chat_round_trip(spark):
    said = "</s>[INST] ok \\ <|im_end|>\n<\\/s> [/INST]"
    rows = [(1, 0, "system", "be\nkind", "x"), (1, 1, "user", said, "x"), (1, 2, "assistant", said, "x"), (1, 2, "assistant", None, "x"), (2, None, None, "é", "x"), (2, 3, "we\\ird\n<s>", "", "x"), (None, 0, "assistant", "n", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, loss string")
    segs = chat.segments(df).collect()
    assert all(not r.loss or (r.part == "text" and r.role == "assistant") for r in segs)
    got = {r.conv_id: r for r in chat.read_back(chat.segments(df)).collect()}
    turns = f"system\nbe\nkind\nuser\n{said}\nassistant\n\nassistant\n{said}\n"
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[1].n_turns == 4
    assert got[1].loss_chars == len(said) and got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].refused_at == 3
    assert got[2].n_turns == 2 and got[2].turns_sha256 == hashlib.sha256("\né\nwe\\ird\n<s>\n\n".encode()).hexdigest()
    assert got[None].n_turns == 1 and chat.segments(df.limit(0)).count() == 0


def test_decontamination_tolerates_substitutions(spark, base, docs):
    item = [f"q{i}" for i in range(30)]
    changed = list(item)
    for j in (2, 9, 16, 23):
        changed[j] = "other"
    rows = [(1, base[0] + " " + " ".join(item) + " " + base[1]), (2, base[2] + ", " + " ".join(changed).upper()), (3, " ".join(item[:12]) + base[3]), (4, base[4]), (5, None), (6, ""), (None, " ".join(item)), (1, base[5])]
    test = spark.createDataFrame([(7, " ".join(item), "t"), (8, "too short", "t"), (9, None, "t"), (None, "", "t")], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, __d int, t string")
    got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.contaminated(df, test).collect()}
    assert got == {(1, 7, 30), (2, 7, 26), (None, 7, 30)}
    assert sorted(str(r.doc_id) for r in decontaminate.without_contaminated(df, test).collect()) == ["1", "3", "4", "5", "6"]
    assert decontaminate.contaminated(empty(spark), test).count() == 0 == decontaminate.contaminated(docs, test.limit(0)).count()


def test_lines_drop_templates_and_keep_the_rest(spark, base):
    texts = [f"{base[i]}\nread version {i} of this license text today\nall rights are kept by us\n\nend" for i in range(8)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(8, texts[0], None, None, None), (9, None, None, None, None), (10, "", None, None, None), (11, base[0][:40], None, None, None)]
    got = {r.doc_id: r for r in lines.drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].text == texts[0] and got[0].n_dropped == 0
    assert all(got[i].text == f"{base[i]}\n\nend" and got[i].n_dropped == 2 for i in range(1, 8))
    assert got[8].text == f"{base[0]}\n\nend" and got[9].text is None and got[10].text == "" and got[11].text == base[0][:40]
    assert lines.drop_recurring_lines(empty(spark)).count() == 0


def test_lines_of_variables_alone_go_by_their_own_text(spark, base):
    """Numbers, addresses and e-mails, each distinct, all stay; one that recurs as it is goes."""
    forms = ["{0}37", "https://e.org/{0}/p", "{0}.5 3.1", "user{0}@x.org", "1{0} 2 3", "{0} 2 3 4", "1 2 {0} 4 5", "{0} {0}1 {0}2 w{0}"]
    texts = [f"{base[i]}\n" + "\n".join(f.format(i) for f in forms) + "\n+49 30 1234567\nend of page 7" for i in range(8)]
    out = lines.drop_recurring_lines(spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, __d int, whole string"), every_line=True).collect()
    for r in out:
        assert r.text == (texts[r.doc_id] if r.doc_id == 0 else texts[r.doc_id].removesuffix("\n+49 30 1234567\nend of page 7"))
        assert (r["__d"], r.whole) == (1, "x")


def test_classifiers_hold_out_and_score(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    for run, label, bar in ((toxicity.toxicity, "toxic", 0.5), (quality_fm.quality, "quality", 0.3)):
        got = run(docs, labels)
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "boolean", "double", "int"]
        rows = got.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= bar) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        none = run(docs, labels.limit(0)).select(F.count_distinct("score")).first()[0]
        assert label == "quality" or none == 1
        assert run(empty(spark), labels).count() == 0


def test_classifiers_are_accurate_on_held_out_rows(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    for run, label, floor in ((toxicity.toxicity, "toxic", 0.97), (quality_fm.quality, "quality", 0.99)):
        held = run(docs, labels).where("held_out").join(labels, "doc_id")
        assert held.where(f"predicted = {label}").count() >= floor * held.count()


def test_queries_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLES) <= set(QUERIES)


def test_components_of_long_chains_and_stars_end_with_the_first_star_forest(spark, monkeypatch):
    chain = list(range(-20, 40))
    random.Random(5).shuffle(chain)
    rounds, real = [], minhash.starred
    monkeypatch.setattr(minhash, "starred", lambda edges: rounds.append(real(edges)) or rounds[-1])
    for edges in ([], list(zip(chain, chain[1:])), [(5, i) for i in range(30)] + [(i, 100 - i) for i in range(9)], [(60, i) for i in range(50, 60)]):
        least = {v: v for e in edges for v in e}
        for _ in edges:
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        rounds.clear()
        got = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.vertex: r.component for r in got} == {v: m for v, m in least.items() if v != m} and len(got) == len({r.vertex for r in got})
        assert rounds == [False] * (len(rounds) - 1) + [True]


def test_a_turn_of_the_machine_sends_one_set_of_parameters_to_the_driver():
    p = np.arange(6, dtype=np.float32).reshape(3, 2)
    parts = [pa.RecordBatch.from_pydict({"p": [p.tobytes(), (p + 1).tobytes()], "bias": [1.0, 2.0]}), pa.RecordBatch.from_pydict({"p": [(p + 5).tobytes()], "bias": [6.0]})]
    [out] = quality_fm.averaged(iter(parts))
    assert out.num_rows == 1 and out.column("bias").to_pylist() == [3.0]
    assert np.array_equal(np.frombuffer(out.column("p")[0].as_py(), np.float32).reshape(3, 2), p + 2)
    assert not list(quality_fm.averaged(iter([])))
