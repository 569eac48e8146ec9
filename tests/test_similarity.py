import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import similarity as sm


def cards(spark, vectors, **extra):
    rows = [(i, [float(x) for x in v], f"card-{i}", extra.get("tags", {}).get(i, []), extra.get("aliases", {}).get(i, [])) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, name string, tags array<string>, aliases array<string>")


def clustered(n, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [centres[i % 5] + rng.normal(scale=0.15 if i % 3 else 0.9, size=dims) for i in range(n)]


def test_pairs_equal_brute_force_with_pruning_and_blocks(spark):
    vectors = clustered(160)
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    wanted = {(i, j) for i in range(160) for j in range(i + 1, 160) if unit[i] @ unit[j] >= 0.9}
    sm.CELL_ROWS, before = 12, sm.CELL_ROWS
    try:
        got = sm.similar_pairs(cards(spark, vectors), 0.9, boosts=False, block_rows=7).select("a", "b").collect()
    finally:
        sm.CELL_ROWS = before
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_boosts_lift_pairs_over_the_threshold(spark):
    base, near = [1.0, 0.0, 0.0], [0.78, 0.6257795, 0.0]
    df = cards(spark, [base, near, [0.0, 0.0, 1.0]], tags={0: ["X", "y"], 1: ["x", "Y"]}, aliases={2: ["Card 0"]})
    assert [tuple(r)[:2] for r in sm.similar_pairs(df, 0.85).collect()] == [(0, 1)]
    assert round(sm.similar_pairs(df, 0.85).first()["score"], 2) == 0.88
    lifted = sm.similar_pairs(df, 0.1).filter("a = 0 AND b = 2").first()
    assert round(lifted["score"], 2) == 0.10


def test_copies_are_one_group(spark):
    df = cards(spark, [[1.0, 0.0]] * 30 + [[0.0, 1.0]])
    got = sm.similar_groups(df, 0.9).collect()
    assert [(r["a"], r["b"], r["pairs"]) for r in got] == [(0, 0, 435)]


def sequential(pairs, names):
    gone, plan = set(), []
    for score, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a in gone or b in gone:
            continue
        keep, drop = (a, b) if len(names[a]) <= len(names[b]) else (b, a)
        gone.add(drop)
        plan.append((keep, drop, score))
    return sorted(plan)


def test_merge_plan_equals_the_sequential_one(spark):
    rng = random.Random(5)
    for _ in range(3):
        n = 25
        names = {i: "n" * rng.randint(1, 6) for i in range(n)}
        pairs = [(rng.choice([0.95, 0.96, 0.97, 1.0]), a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25]
        got = sm.merge_plan(spark.createDataFrame(pairs, "score double, a bigint, b bigint"), spark.createDataFrame(list(names.items()), "id bigint, name string"))
        assert sorted(tuple(r) for r in got.collect()) == sequential(pairs, names)


def test_clique_of_copies_merges_in_few_rounds(spark, monkeypatch):
    n, steps = 40, []
    pairs = [(1.0, a, b) for a in range(n) for b in range(a + 1, n)]
    real = sm.cut_lineage
    monkeypatch.setattr(sm, "cut_lineage", lambda df, eager=True: steps.append(1) or real(df, eager))
    got = sm.merge_plan(spark.createDataFrame(pairs, "score double, a bigint, b bigint"), spark.range(n).select("id", F.lit("same").alias("name")))
    assert got.count() == n - 1 and got.select("survivor").distinct().count() == 1 and len(steps) <= 5


def test_centroid_gives_one_vote_per_document(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0])] * 9 + [("b", [0.0, 1.0])], "path string, embedding array<double>")
    scored = sm.score_candidates(spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [1.0])], "k int, embedding array<double>"), df)
    assert {r["k"]: r["score"] for r in scored.collect()} == {1: 1.0, 2: None, 3: None}


def test_embedding_batches_fail_as_a_whole(spark):
    calls = lambda texts: None if any(t == "bad" for t in texts) else [[1.0]] * len(texts)
    df = spark.createDataFrame([(t,) for t in ["a", "b", "bad", "c"]], "t string").coalesce(1)
    got = [r["embedding"] for r in sm.embed_texts(df, "t", calls, batch=2).collect()]
    assert got == [[1.0], [1.0], None, None]


def boosted(cards, threshold):
    """Every pair by plain loops."""
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1.0) for i, v, *_ in cards}
    fold = lambda values: {v.lower() for v in values or [] if v}
    out = {}
    for i, _, name_i, tags_i, aliases_i in cards:
        for j, _, name_j, tags_j, aliases_j in cards:
            if i < j:
                title = lambda n: {n.replace("-", " ").replace("_", " ").lower()} if n else set()
                clash = fold(aliases_i) & fold(aliases_j) or title(name_i) & fold(aliases_j) or title(name_j) & fold(aliases_i)
                boost = 0.10 if clash else 0.05 * len(fold(tags_i) & fold(tags_j))
                if min(1.0, unit[i] @ unit[j] + boost) >= threshold:
                    out[(i, j)] = round(boost, 2)
    return out


@pytest.mark.parametrize("rare,threshold", [(256, 0.7), (6, 0.7), (1, 0.75), (6, 0.04)])
def test_boosted_pairs_equal_brute_force_whether_keys_are_rare_or_common(spark, monkeypatch, rare, threshold):
    rng = random.Random(rare)
    vectors = clustered(120, seed=rare)
    rows = []
    for i, v in enumerate(vectors):
        tags = ["Hot"] * (i % 3 == 0) + [f"t{rng.randrange(40)}" for _ in range(rng.randrange(4))] + [None] * (i % 11 == 0)
        tags += [f"many{k}" for k in range(18)] if i in (6, 51) else []  # one pair in reach by tags alone
        aliases = [f"Card {rng.randrange(120)}"] * (i % 4 == 0) + ["everyone"] * (i % 5 == 0)
        vector = [0.0] * 8 if i in (51, 70) else [float(x) for x in v]
        rows.append((i, vector, None if i == 9 else f"card-{i}", None if i == 8 else tags, None if i == 7 else aliases))
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>, name string, tags array<string>, aliases array<string>")
    monkeypatch.setattr(sm, "RARE_KEY", rare)
    monkeypatch.setattr(sm, "CELL_ROWS", 12)
    got = sm.similar_pairs(df, threshold, block_rows=17).collect()
    wanted = boosted(rows, threshold)
    assert {(r["a"], r["b"]): round(r["boost"], 2) for r in got} == wanted and len(got) == len(wanted)
    assert (6, 51) in wanted


def test_one_card_with_many_tags_does_not_widen_the_search(spark, monkeypatch):
    """Its tags are its own: the homes that cards visit are the same with and without them."""
    vectors, seen = clustered(300), []
    real = sm._visits
    monkeypatch.setattr(sm, "_visits", lambda pivots, homes, threshold: seen.append(len(homes)) or real(pivots, homes, threshold))
    monkeypatch.setattr(sm, "CELL_ROWS", 12)
    plain = {tuple(r) for r in sm.similar_pairs(cards(spark, vectors), 0.95).select("a", "b").collect()}
    rich = {tuple(r) for r in sm.similar_pairs(cards(spark, vectors, tags={0: [f"t{k}" for k in range(40)]}), 0.95).select("a", "b").collect()}
    assert plain == rich and seen[0] == seen[1]


def test_pairs_of_no_cards_and_of_zero_vectors(spark):
    assert sm.similar_pairs(cards(spark, []), 0.5).count() == 0
    assert sm.similar_pairs(cards(spark, [[0.0, 0.0], [0.0, 0.0]]), 0.5).count() == 0
    assert sm.similar_pairs(cards(spark, [[0.0, 0.0], [0.0, 0.0]], tags={0: ["a"], 1: ["A"]}), 0.05).count() == 1


def test_stubs_and_empty_cards_are_left_out(spark):
    df = spark.createDataFrame([(1, "draft", "text"), (2, "stub", "text"), (3, None, "text"), (4, "draft", " \n"), (5, "draft", None)], "id int, status string, text string")
    assert [r["id"] for r in sm.analysed_cards(df).collect()] == [1]


def test_small_homes_share_a_block_and_tiles_lose_no_pair(spark, monkeypatch):
    import pandas as pd
    assert sm._blocks(pd.DataFrame({"rows": [3, 4, 9, 1, 1, 20, 2]}), 8).tolist() == [0, 0, 1, 2, 2, 3, 4]
    vectors = [*clustered(90), [0.0] * 8, [float("nan")] + [1.0] * 7]
    tags = {i: [f"t{i % 4}"] * (i % 3 > 0) + ["all"] for i in range(92)}
    aliases = {i: ["card 5"] for i in range(0, 92, 9)}
    wide = {tuple(r) for r in sm.similar_pairs(cards(spark, vectors, tags=tags, aliases=aliases), 0.8).collect()}
    monkeypatch.setattr(sm, "CELL_ROWS", 12)
    monkeypatch.setattr(sm, "_passing", lambda *given, real=sm._passing: narrow(real, *given))

    def narrow(real, left, right, once, threshold, boosts):
        real.__globals__.update(TILE=100, CONFIRMED=7)
        return real(left, right, once, threshold, boosts)

    cut = {tuple(r) for r in sm.similar_pairs(cards(spark, vectors, tags=tags, aliases=aliases), 0.8, block_rows=40).collect()}
    rounded = lambda rows: {(a, b, *(round(x, 9) for x in rest)) for a, b, *rest in rows}
    assert rounded(cut) == rounded(wide) and len(wide) > 50
