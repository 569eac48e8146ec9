
import random
import re
from collections import defaultdict


import corpus_pipeline
from folioscope.llm import decontaminate
from folioscope.llm.queries import op8_line_dedup


def test_short_lines_that_recur_go_too(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "so", "ti", "ve", "zu", "den", "mor", "lin")]
    own = lambda: " ".join(rng.choices(words, k=12))
    rows = [(i, f"{own()}\nAll rights reserved.\n\nShare\n  page {i}\n{'Rare' if i < 4 else own()}\n{own()}", 0) for i in range(7)] + [(7, None, 0), (8, "\n \n", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    mask = lambda line: " ".join("<*>" if re.search("[0-9@]", t) else t for t in line.split())
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            holders[mask(line)].add(i)
    stays = lambda i, line: mask(line) == "" or len(holders[mask(line)]) < 5 or i == min(holders[mask(line)])
    want = {i: t and "\n".join(x for x in t.split("\n") if stays(i, x)) for i, t, _ in rows}
    assert want[3].count("\n") == 3 and "Rare" in want[3] and "Share" in want[0]
    assert {r.doc_id: r.text for r in op8_line_dedup(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()} == want


def brute_found(text, item):
    """Whether any diagonal agrees on 70 % of the item's words."""
    w, v = [[x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x] for t in (text, item)]
    return bool(v) and any(10 * sum(0 <= d + j < len(w) and w[d + j] == x for j, x in enumerate(v)) >= 7 * len(v) for d in range(-len(v), len(w)))


def test_every_pattern_of_changes_that_the_share_allows_is_found(spark, tmp_path):
    rng = random.Random(8)
    lengths = [1, 2, 3, 4, 5, 7, 8, 10, 15, 17, 20, 23, 31, 59]
    items = {n: [f"w{n}x{i}" if n != 5 else f"w{i % 2}" for i in range(n)] for n in lengths}
    rows = [(0, None), (1, ""), (2, "one two three"), (3, " ".join(items[8][2:])), (4, " ".join(items[20][:-6])), (5, " ".join(items[20][7:]) + " end")]

    def add(n, changed):
        copy = [f"c{rng.randint(0, 10**6)}" if i in changed else x for i, x in enumerate(items[n])]
        rows.append((len(rows), " ".join([f"b{i}" for i in range(rng.randint(0, 3))] + copy + ["e"] * rng.randint(0, 2))))

    add(15, {1, 7, 9})
    for n in lengths:
        for k in range(3 * n // 10 + 2):
            for _ in range(6):
                add(n, set(rng.sample(range(n), k)))
        add(n, set(range(2, n, 3)))  # runs of two words alone
    want = {(i, n) for i, t in rows for n in lengths if brute_found(t, " ".join(items[n]))}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    test = spark.createDataFrame([*[(n, " ".join(v)) for n, v in items.items()], (99, ""), (98, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, test).collect()} == want and (6, 15) in want and {n for _, n in want} == set(lengths)
    test.write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == [i for i, _ in rows if i not in {d for d, _ in want}]


def test_an_id_that_stands_for_two_texts_loses_neither(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 400)}" for _ in range(60)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, d), (7, d), (6, c + " end"), (9, None), (None, a)]
    out = [tuple(r) for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "").collect()]
    assert (5, b) in out and out.count((7, d)) == 1 and (9, None) in out and (None, a) in out and len(out) == 6
    assert len({(3, a), (5, a)} & {*out}) == 1 and len({(7, c), (6, c + " end")} & {*out}) == 1
