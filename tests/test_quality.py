import itertools
import random

from pyspark.sql import functions as F

from folioscope.operators import claims as cl, corpus as co, intake as it, quality as qu, radar as rd


def slow_repeats(body):
    def period(s):
        return next(p for p in range(1, len(s) + 1) if all(s[i] == s[i + p] for i in range(len(s) - p)))
    if len(body) < 400:
        return 1
    worst = 1
    for at in range(0, len(body) - 200, 25):
        w = body[at:at + 200]
        if sum(c.isalnum() for c in w) / 200 >= 0.25 and period(w) >= 40:
            worst = max(worst, body.count(w))
    return worst


def test_repetition_equals_brute_force():
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcde fgh ij.") for _ in range(n))
    para = prose(450)
    for text in (prose(1500), para * 3, para + prose(300) + para, "ab" * 900, "=" * 2000, "abcdefg" * 200, prose(41) * 40, prose(150) * 30, prose(39) * 30, prose(50) + para + "é☃" + para, prose(100)):
        assert qu.repeat_count(text) == slow_repeats(text)


def test_embedded_images_are_not_repetition(spark):
    blob = "data:image/png;base64," + "QWxwaGE" * 400
    got = spark.createDataFrame([(f"![a]({blob}) text ![b]({blob})",)], "md string").select(qu.repetition(F.col("md"))).first()[0]
    assert got == 1


def test_recognition_routes_only(spark):
    rng = random.Random(9)
    para = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120))
    df = spark.createDataFrame([(1, "ocr", para + "\n" + para), (2, "tex", para + "\n" + para)], "doc_id int, route string, md string")
    assert [(r["doc_id"], r["code"]) for r in qu.conversion_findings(df).collect()] == [(1, "repetition-loop")]


def test_text_layer_reasons(spark):
    rows = [(1, i, "word " * 60, False) for i in range(30)] + [(2, i, "", True) for i in range(4)] + [(3, 0, "/31 /8 /18 " * 40, False)] + [(4, 0, "\x01\x02ab" * 90, False)]
    got = {r["doc_id"]: r["reason"] for r in qu.text_layer(spark.createDataFrame(rows, "doc_id int, page int, text string, full_page_image boolean")).collect()}
    assert got == {1: "usable", 2: "scan", 3: "unmapped codes", 4: "unprintable"}


def test_claim_blocks_are_quote_aware(spark):
    text = 'intro\nCLAIM: one\nEVIDENCE: "first line\nCLAIM: not a block\nlast"\nSOURCE_TYPE: local_wiki\nSOURCE: raw/a.md\nFINDING: two\nEVIDENCE: "x"\nSTATUS: Verified\n'
    open_ = 'finding: three\r\nevidence: bare words\non two lines\nSOURCE: s\nClaim: four\nEVIDENCE: "never closed\nCLAIM: inside'
    got = cl.claim_blocks(spark.createDataFrame([(1, text), (2, open_), (3, "no blocks"), (4, None)], "n int, text string")).orderBy("n", "seq").collect()
    assert [(b.n, b.seq, b.claim, b.evidence, b.source, b.status) for b in got] == [
        (1, 0, "one", "first line\nCLAIM: not a block\nlast", "raw/a.md", None), (1, 1, "two", "x", None, "Verified"),
        (2, 0, "three", "bare words\non two lines", "s", None), (2, 1, "four", '"never closed', None, None)]


def test_report_rows(spark):
    text = "# D\n\n## One  \n- id: `a-1` · relevance: 0.5\n- authors: A, B, et al.\n- abstract:  x y \n- https://arxiv.org/abs/2401.00001v2\n##nothing\n## Two\n- candidate: arXiv:2402.00002v3\n- https://e.org/q\n- https://e.org/r"
    got = [tuple(r) for r in rd.report_candidates(spark.createDataFrame([(text,), (None,), ("",)], "text string")).collect()]
    assert got == [(0, "One", "a-1", "2401.00001", "https://arxiv.org/abs/2401.00001v2", 0.5, ["A", "B"], "x y"), (1, "Two", "2402.00002", "2402.00002", "https://e.org/q", None, [], None)]


def test_quotes_in_three_forms_and_from_pages(spark):
    claims = [("a", "plain text", "local_wiki", "raw/s.md"), ("b", "Two   words", "local_wiki", "raw/s.md"), ("c", "eﬃcient-ly", "local_wiki", "raw/s.md"),
              ("d", "made up", "local_wiki", "raw/s.md"), ("e", "x", "local_wiki", "../s.md"), ("f", "x", "local_wiki", "raw/t.md"), ("g", "on the page", "web", "https://e.org/p"),
              ("h", "x", "web", "https://e.org/q"), ("i", "", "local_wiki", "raw/s.md"), ("j", "x", "web", "ftp://e")]
    sources = spark.createDataFrame([("raw/s.md", "some plain text. Two words. effi-\nciently")], "path string, text string")
    pages = spark.createDataFrame([("https://e.org/p", "<p>on <b>the</b> page</p><script>x</script>")], "url string, text string")
    got = cl.verify_quotes(spark.createDataFrame(claims, "claim string, evidence string, source_type string, source string"), sources, pages)
    assert {r["claim"]: r["reason"] for r in got.collect()} == {
        "a": "exact match", "b": "whitespace-normalized match", "c": "loose match", "d": "not found in source", "e": "outside the project", "f": "file not found",
        "g": "quote found in page", "h": "URL format valid", "i": "malformed block", "j": "invalid URL"}


def test_length_pieces_keep_fences_whole(spark):
    text = "a\nb\n\n```\nc\n\nd\n```\n\ne\n"
    got = co.length_pieces(spark.createDataFrame([(text,)], "text string"), 3).collect()
    assert [r["content"] for r in got] == ["a\nb\n\n", "```\nc\n\nd\n```\n\n", "e\n"] and [r["start_line"] for r in got] == [1, 4, 10]


def test_length_pieces_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["word", "", " ", "```", "  ``` py", "\t", "a ``` b", "é\x1c", "\u2003"]
    ends = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\u2028", "\n\n", "\x1d"]
    texts = ["".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.randint(0, 40))) + rng.choice(["", "tail", "```"]) for _ in range(300)]
    texts += [None, "", "x\n" * 50_000 + "\n" + "y"]
    want = set()
    for i, text in enumerate(texts):
        lines, piece = (text or "").splitlines(keepends=True), 0
        while lines:
            fences = [n % 2 for n in itertools.accumulate(x.strip().startswith("```") for x in lines)]
            stop = next((n + 1 for n, x in enumerate(lines) if n + 1 >= 4 and not x.strip() and not fences[n]), len(lines))
            piece += 1
            want.add((i, piece, 1 + len("".join(texts[i]).splitlines()) - len(lines), "".join(lines[:stop])))
            lines = lines[stop:]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert {tuple(r) for r in co.length_pieces(df, 4).collect()} == want


def test_sections(spark):
    text = "lead\n# One \nx\n#### not a break\n## Two\n" + "\n".join(str(i) for i in range(260)) + "\n# Empty"
    got = [(r["heading"], r["start_line"], r["end_line"]) for r in co.sections(spark.createDataFrame([(text,)], "text string")).collect()]
    assert got == [("", 1, 1), ("One", 2, 4), ("Two", 5, 254), ("", 255, 265), ("Empty", 266, 266)]


def test_containment_equals_brute_force(spark):
    rng = random.Random(8)
    stems = sorted({"-".join(rng.choice(["quantum", "toric", "code", "a", "hall"]) for _ in range(rng.randint(1, 5))) for _ in range(60)})
    files = spark.createDataFrame([(f"raw/papers/{s}.md",) for s in stems], "path string")
    asks = ["quantum-code-x", "xquantum-toric-code-hall", "toric-code", "hall-quantum", "quantum-q"]
    cards = spark.createDataFrame([], "path string, title string, aliases array<string>")
    got = {r["ref"]: (r["tier"], r["matches"]) for r in qu.resolve_sources(spark.createDataFrame([("wiki/o.md", a) for a in asks], "owner string, ref string"), files, cards).collect()}
    for a in asks:
        if a in stems:
            assert got[a] == ("raw slug", 1)
        else:
            n = sum(1 for s in stems if len(a) >= 8 and (a in s or s in a))
            assert got[a] == (("raw containment", n) if n else ("none", 0))


def test_similar_names(spark):
    names = spark.createDataFrame([(n,) for n in ["twisted-gauging", "map", "toric-code", "toric-codes"]], "name string")
    got = {(r["probe"], r["name"]) for r in it.similar_names(names, ["lattice-twisted-gauging", "mapping", "toric-code"]).collect()}
    assert got == {("lattice-twisted-gauging", "twisted-gauging"), ("toric-code", "toric-code"), ("toric-code", "toric-codes")}


def test_retarget(spark):
    docs = spark.createDataFrame([("notes/a.md", "[x](../plans/i.md) [y](b.md) [z](https://e.org)"), ("plans/i.md", "[back](../notes/a.md)"), ("notes/b.md", "[s](a.md)")], "path string, text string")
    got = {(r["file"], r["old"], r["new"]) for r in co.retarget_links(docs, [("plans", "drafts/plans"), ("notes/b.md", "drafts/b.md")]).collect()}
    assert got == {("notes/a.md", "../plans/i.md", "../drafts/plans/i.md"), ("notes/a.md", "b.md", "../drafts/b.md"), ("plans/i.md", "../notes/a.md", "../../notes/a.md"), ("notes/b.md", "a.md", "../notes/a.md")}


def test_containment_of_names_equals_all_pairs(spark):
    """Names short and long, inside slugs and around them, repeated, empty, with common openings."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
    slugs = {"-".join(word() for _ in range(rng.randrange(2, 6))) for _ in range(60)} | {"abababababab"}
    slugs = {s for s in slugs if len(s) >= qu.GRAM}
    names = [("-".join(word() for _ in range(rng.randrange(1, 7))), f"raw/{i}") for i in range(90)]
    names += [("", "raw/none")] + [(s[2:-1], f"raw/part-{s}") for s in list(sorted(slugs))[:20]] + [("x-" + s + "-y", f"raw/around-{s}") for s in list(sorted(slugs))[::2]]
    held = spark.createDataFrame(names, "bare string, path string").groupBy("bare").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    got = {r["slug"]: (r["matches"], r["path"]) for r in qu._contained(spark.createDataFrame([(s,) for s in slugs], "slug string"), held).collect()}
    hits = {s: [p for n, p in names if n in s or s in n] for s in slugs}
    assert got == {s: (len(h), min(h)) for s, h in hits.items() if h}


def test_gaps_of_many_neighbours_broadcast_nothing(spark):
    """Neighbours from lists are many more than Spark takes them for."""
    own = spark.range(40).select(F.col("id").alias("paper_id"))
    near = own.select("paper_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("candidate_id")).select("*", F.col("candidate_id").alias("pos"), F.lit(2020).alias("year"))
    citations = near.filter("pos % 5 = 0").select("paper_id", F.col("candidate_id").alias("citing_id"))
    references = own.select("paper_id", F.explode(F.array(F.col("paper_id") % 3, F.col("paper_id") % 4 + 10)).alias("cited_id")).withColumn("cited_title", F.lit(" t "))
    gaps = rd.citation_gaps(own, near.filter("paper_id <> candidate_id"), citations, references, 2018, min_shared=2)
    assert "Broadcast" not in gaps._jdf.queryExecution().executedPlan().toString()
    wanted = {(a, b, 2) for a in range(40) for b in range(40) if a != b and b % 5 and a % 3 == b % 3 and a % 4 == b % 4}
    assert {(r.paper_id, r.candidate_id, r.shared) for r in gaps.collect()} == wanted


def test_gaps_shuffle_pairs_once_and_count_as_before(spark):
    """Pairs whose marks rule them out end before their references; repeated neighbours, nulls and titles count as in a plain join."""
    rng = random.Random(4)
    ids = [*range(30), None]
    own = [(rng.choice(ids),) for _ in range(40)]
    near = [(rng.choice(ids), rng.choice(ids), i, rng.choice([2016, 2018, 2020, None]), "t") for i in range(900)]
    cites = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)]
    refs = [(rng.choice(ids), rng.choice([*range(p), None]), rng.choice([None, " ", " a ", "b"])) for p in (4, 40, 200) for _ in range(260)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        (own, "paper_id long"), (near, "paper_id long, candidate_id long, pos int, year int, title string"), (cites, "paper_id long, citing_id long"), (refs, "paper_id long, cited_id long, cited_title string"))]
    best = {}
    for p, w, title in refs:
        if p is not None and w is not None:
            best[p, w] = max(best.get((p, w)) or "", title or "")
    for budget, least in ((None, 3), (5, 1), (None, 0)):
        left = [n for n in near if (n[0],) in own and n[0] is not None and n[3] is not None and n[3] >= 2018 and (n[1] is None or (n[0], n[1]) not in cites)]
        if budget:
            left = [n for n in left if sum(m[0] == n[0] and m[2] < n[2] for m in left) < budget]
        wanted = {}
        for p, c, _, year, _ in left:
            for w in {w for q, w in best if q == p} & {w for q, w in best if q == c}:
                old = wanted.setdefault((p, c), [0, 0, []])
                old[0] += 1
                old[1] = max(old[1], year)
                old[2] += [t for t in [best[p, w].strip(" ")] if t]
        gaps = rd.citation_gaps(*frames, 2018, min_shared=least, budget=budget)
        got = {(r.paper_id, r.candidate_id): (r.shared, r.year, list(r.shared_titles)) for r in gaps.collect()}
        assert got == {k: (n, year, sorted(ts)) for k, (n, year, ts) in wanted.items() if n >= least} and got
    dealt = [frames[0].repartition("paper_id"), frames[1].repartition("paper_id"), *frames[2:]]
    plan = rd.citation_gaps(*dealt, 2018)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "bit_count" in plan and "Broadcast" not in plan


def test_containment_broadcasts_no_names(spark):
    """Pieces of names are many more than the planner takes them for."""
    names = spark.range(60).select(F.format_string("name-of-%03d", "id").alias("s"))
    refs = names.select(F.lit("wiki/o.md").alias("owner"), F.concat("s", F.lit("-more")).alias("ref"))
    files = names.select(F.concat(F.lit("raw/papers/"), "s", F.lit(".md")).alias("path"))
    got = qu.resolve_sources(refs, files, spark.createDataFrame([], "path string, title string, aliases array<string>"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.ref, r.path, r.tier) for r in got.collect()} == {(f"name-of-{i:03d}-more", f"raw/papers/name-of-{i:03d}.md", "raw containment") for i in range(60)}
