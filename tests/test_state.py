import datetime as dt
import random

from pyspark.sql import functions as F

from folioscope.functions.ordered import with_previous
from folioscope.operators import reflect as rf, state as st

POST = "slug string, seq bigint, at timestamp, host string, line string, src string, dst string, field string, text string"
NOTE = ("slug string, kind string, status string, created date, purpose string, lines array<string>, bet string, found string, claim string, key_move string, "
        "depends_on array<string>, answers array<string>, derivation array<string>, evidence array<string>, mtime timestamp")
T0 = dt.datetime(2026, 1, 1, 12)


def posts(spark, *rows):
    full = [(s, q, T0 + dt.timedelta(seconds=at) if at is not None else None, h, None, a, b, f, t) for s, q, at, h, a, b, f, t in rows]
    return spark.createDataFrame(full, POST)


def notes(spark, *rows):
    out = []
    for r in rows:
        n = {"slug": "", "kind": "proposition", "status": "open", "created": dt.date(2026, 1, 1), "purpose": "p", "lines": [], "bet": None, "found": None, "claim": None,
             "key_move": None, "depends_on": [], "answers": [], "derivation": [], "evidence": [], "mtime": T0, **r}
        out.append(tuple(n.values()))
    return spark.createDataFrame(out, NOTE)


def test_previous_row_across_ranges(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 4)}", i, rng.randint(0, 9)) for i in range(300)]
    got = {r["seq"]: r["prev_v"] for r in with_previous(spark.createDataFrame(rows, "k string, seq bigint, v int"), ["k"], "seq", ["v"], width=7).collect()}
    last, wanted = {}, {}
    for k, i, v in rows:
        wanted[i] = last.get(k)
        last[k] = v
    assert got == wanted


def test_conflict_cases(spark):
    p = posts(spark,
              ("a", 0, 0, "x", "open", "testing", None, ""), ("a", 1, 60, "y", "open", "refuted", None, ""),
              ("b", 2, 0, "x", "open", "testing", None, ""), ("b", 3, 60, "y", "open", "refuted", None, ""), ("b", 4, 120, "human", "conflict", "testing", None, ""),
              ("c", 5, 0, "x", "testing", "supported", None, ""), ("c", 6, 60, "reviewer", "supported", "disputed", None, ""),
              ("d", 7, 0, "x", "open", "testing", None, ""), ("d", 8, 301, "y", "open", "refuted", None, ""))
    n = notes(spark, *[{"slug": s} for s in "abcd"])
    assert [(r["slug"], r["first_seq"], r["second_seq"]) for r in st.conflicts(n, p).collect()] == [("a", 0, 1)]


def test_chain_breaks_and_illegal_moves(spark):
    p = posts(spark, ("a", 0, 0, "x", "testing", "supported", None, ""), ("a", 1, 1, "x", "refuted", "testing", None, ""), ("a", 2, 2, "x", "testing", "open", None, ""))
    got = {(r["slug"], r["issue"], r["seq"]) for r in st.chain_issues(notes(spark, {"slug": "a", "status": "testing"}, {"slug": "z", "status": "supported"}), p).collect()}
    assert got == {("a", "starts elsewhere", 1), ("a", "illegal transition", 2), ("a", "status differs from history", None), ("z", "no post records the status", None)}


def test_review_questions_follow_file_order(spark):
    p = posts(spark,
              ("old", 0, 0, "reviewer", None, None, None, "VERDICT: stands"), ("old", 1, 0, "x", "testing", "supported", None, ""),
              ("weak", 2, 0, "x", "testing", "supported", None, ""), ("weak", 3, 0, "reviewer", None, None, None, "VERDICT: stands\n· cheap tier"),
              ("unclear", 4, 0, "x", "testing", "supported", None, ""), ("unclear", 5, 0, "reviewer", None, None, None, "VERDICT: unclear\nVERDICT: stands"))
    n = notes(spark, *[{"slug": s, "status": "supported"} for s in ("old", "weak", "unclear")])
    assert sorted(r[0] for r in st.awaiting_review(n, p).collect()) == ["old", "unclear"]
    assert [r[0] for r in st.weakly_reviewed(n, p).collect()] == ["weak"]


def test_a_bet_after_the_answer_is_late(spark):
    p = posts(spark, ("late", 0, 0, "x", "testing", "supported", None, ""), ("late", 1, 1, "human", None, None, "bet", ""),
              ("hit", 2, 0, "human", None, None, "bet", ""), ("hit", 3, 1, "x", "testing", "supported", None, ""))
    n = notes(spark, *[{"slug": s, "status": "supported", "bet": b} for s, b in (("late", "supported"), ("hit", "supported"), ("dunno", "unknown"))])
    s = st.score_summary(st.scoreboard(n, p)).first()
    assert (s["hits"], s["scored"], s["unknown"], s["late"], s["rate"]) == (1, 1, 1, 1, 1.0)


def test_a_human_post_just_before_the_move_counts(spark):
    p = posts(spark, ("ok", 0, 0, "human", None, None, None, "do it"), ("ok", 1, 1, "x", "disputed", "testing", None, ""), ("bad", 2, 0, "human", None, None, None, ""),
              ("bad", 3, 1, "x", None, None, None, ""), ("bad", 4, 2, "x", "disputed", "testing", None, ""))
    n = notes(spark, {"slug": "ok"}, {"slug": "bad"})
    assert [r["slug"] for r in st.unrecorded_decisions(n, p).collect()] == ["bad"]
    log = spark.createDataFrame([("see bad-1 and bad.",)], "text string")
    assert st.unrecorded_decisions(n, p, st.mentioned_slugs(log)).isEmpty()
    assert [r["slug"] for r in st.unrecorded_decisions(n, p, st.mentioned_slugs(spark.createDataFrame([("see bad-1",)], "text string"))).collect()] == ["bad"]


def test_rules_refuse_what_they_do_not_know(spark):
    import pytest
    with pytest.raises(ValueError):
        st.rules_table(spark, [{"rule": "be-nice"}])
    with pytest.raises(ValueError):
        st.rules_table(spark, [{"rule": "require-field", "kind": "proposition"}])


def test_next_actions_are_most_owed_first(spark):
    n = notes(spark, {"slug": "p1", "status": "testing", "lines": ["l1"]}, {"slug": "p2", "status": "disputed"}, {"slug": "l1", "kind": "line", "status": "active"})
    p = posts(spark, ("p1", 0, 0, "x", "open", "testing", None, ""), ("p2", 1, 0, "x", "supported", "disputed", None, ""))
    inbox = spark.createDataFrame([("# notes\nan idea\n",)], "text string")
    got = [r["key"] for r in st.next_actions(n, p, "2026-01-02 00:00:00", inbox=inbox).collect()]
    assert got[0] == "inbox" and got.index("disputed") < got.index("bets")


def test_close_names(spark):
    n = notes(spark, {"slug": "p-gap"}, {"slug": "line-a", "kind": "line", "status": "active"})
    got = {r["slug"]: (r["why"], list(r["close"])) for r in st.unreviewable(n, ["p-gapp", "line-a", "p-gap"]).collect()}
    assert got == {"p-gapp": ("no such note", ["p-gap"]), "line-a": ("is a line", [])}


def test_nearest_session_equals_brute_force(spark):
    rng = random.Random(11)
    base = dt.datetime(2026, 1, 1)
    ses = []
    for i in range(40):
        start = rng.randint(0, 90_000)
        ses.append((f"h{i % 3}", f"s{i}", start, start + rng.choice([0, 40, 600, 9000])))
    ses += [("h9", "years", 100_000, 100_000 + 3 * 10**8), ("h8", "later", 2 * 10**8, 4 * 10**8)]
    events = [(i, rng.randint(0, 120_000)) for i in range(400)] + [(400 + i, rng.randint(0, 5 * 10**8)) for i in range(50)]
    at = lambda s: base + dt.timedelta(seconds=s)
    got = rf.nearest_session(spark.createDataFrame([(i, at(t)) for i, t in events], "e int, at timestamp"),
                             spark.createDataFrame([(h, s, at(a), at(b)) for h, s, a, b in ses], "host string, session_id string, started timestamp, ended timestamp"))
    wanted = set()
    for i, t in events:
        best = min(((0 if a <= t <= b else (a - t if t < a else t - b)), b, h, s) for h, s, a, b in ses)
        if best[0] <= 7200:
            wanted.add((i, best[2], best[3], best[0]))
    assert {(r["e"], r["host"], r["session_id"], r["gap"]) for r in got.collect()} == wanted


def test_time_blocks_hold_each_second_once(spark):
    rng = random.Random(12)
    spans = [(0, 0), (-1, 0), (-300, 5000), (15, 16), (16, 31), (-(10**11), 3 * 10**11)]
    spans += [(a, a + rng.choice([0, 3, 200, 70_000])) for a in (rng.randint(-10**6, 10**6) for _ in range(60))]
    for lo, hi, blocks in spark.createDataFrame(spans, "lo bigint, hi bigint").select("lo", "hi", rf.time_blocks(F.col("lo"), F.col("hi"))).collect():
        held = sorted((b["block"] * 16 ** b["level"], (b["block"] + 1) * 16 ** b["level"]) for b in blocks)
        assert held[0][0] == lo and held[-1][1] == hi + 1 and all(x[1] == y[0] for x, y in zip(held, held[1:]))
        assert len(held) < 32 * rf.LEVELS


def test_excerpt_is_the_tail(spark):
    rng = random.Random(2)
    turns = [("h", f"s{s}", i, "user", "w" * rng.randint(1, 30)) for s in range(3) for i in range([5, 60, 1][s])]
    df = spark.createDataFrame(turns, "host string, session_id string, seq bigint, role string, text string")
    got = {r["session_id"]: r["excerpt"] for r in rf.excerpts(df, 100, fan=4).collect()}
    for s in range(3):
        body = "\n\n".join(f"{r}: {t}" for _, sid, _, r, t in turns if sid == f"s{s}")
        assert got[f"s{s}"] == (body if len(body) <= 100 else "…\n\n" + body[-100:])


def test_recent_decisions(spark):
    log = spark.createDataFrame([("# log\n## one\ntext\n## two\n### no\n## three\n",)], "text string")
    assert [r["entry"] for r in st.recent_decisions(st.log_lines(log), 2).collect()] == ["three", "two"]
