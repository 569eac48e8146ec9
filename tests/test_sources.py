import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import tables, text as tx
from folioscope.operators import graph as gr, retrieval as rt
from folioscope.plans.registry import catalog
from folioscope.session import work_dir
from folioscope.sources import notes as sn, readers as rd, search_index as si, sinks as sk

CONCEPT = "---\ntitle: Toric Code\ntags: [topology, codes]\naliases: [TC]\nskeleton: true\n---\n# Toric Code\nsee [[Anyons]] and [[toric_code]] and [[Missing Page]]\n"
NOTE = ("---\nkind: proposition\nstatus: testing\nline: [qec]\ncreated: 2026-01-01\n---\nbody [[TC]]\n\n## Discussion\n\n### 2026-01-02T00:00:00Z · codex/qec · via cli\nstatus: open -> testing\nset: bet = supported\nwords\n"
        "```\n### 2026-01-03T00:00:00Z · fake\n```\n### not a post\nmore\n### 2026-01-04T00:00:00Z · human\nstatus: testing → supported\n")


@pytest.fixture()
def root(tmp_path):
    for path, text in {"wiki/concepts/toric-code.md": CONCEPT, "wiki/concepts/anyons.md": "---\ntitle: Anyons\ntags: [topology]\n---\n<!-- x:claims\nCLAIM: they braid\nEVIDENCE: \"q\"\nSOURCE_TYPE: local_wiki\nSOURCE: raw/gone.md\n-->\n",
                       "wiki/concepts/_index.md": "x", "wiki/.backup/old.md": "x", "raw/papers/p q.md": "no front matter", "raw/papers/bad.md": "---\n: [\n---\nx", "threads/p-1.md": NOTE}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_corpus_and_cards(spark, root):
    files = rd.corpus(spark, root)
    assert sorted(r["path"] for r in files.collect()) == ["raw/papers/bad.md", "raw/papers/p q.md", "threads/p-1.md", "wiki/concepts/anyons.md", "wiki/concepts/toric-code.md"]
    cards = {r["path"]: r for r in rd.cards(files).collect()}
    assert cards["wiki/concepts/toric-code.md"]["tags"] == ["topology", "codes"] and cards["wiki/concepts/toric-code.md"]["pinned"]
    assert cards["raw/papers/bad.md"]["fields"] == {} and cards["threads/p-1.md"]["collection"] == "threads"
    # Spark leaves out names that start with an underscore or a dot by itself.
    assert rd.file_listing(spark, root).count() == 5


def test_bundled_corpus_is_the_corpus(spark, root, tmp_path_factory):
    """The same files, stored one by one and as bundles, in any number of tasks."""
    loose = rd.corpus(spark, root)
    names = ["wiki/concepts/_index.md", "wiki/.backup/old.md", "wiki/other.txt"]
    extra = spark.createDataFrame([(n, "x") for n in names], "path string, text string")
    at = str(tmp_path_factory.mktemp("bundles") / "corpus")
    sk.write_corpus(loose.select("path", F.regexp_replace("text", r"\n\z", "").alias("text")).unionByName(extra).repartition(3), at)
    bundled = rd.corpus(spark, at, bundled=True)
    ended = lambda df: sorted((r["path"], r["text"].rstrip("\n"), r["collection"]) for r in df.collect())
    assert bundled.columns == loose.columns and ended(bundled) == ended(loose)
    front = lambda df: sorted((r["path"], r["title"], tuple(r["tags"] or ()), r["pinned"]) for r in rd.cards(df).collect())
    assert front(bundled) == front(loose)
    assert [r["path"] for r in rd.corpus(spark, at, "*.txt", bundled=True).collect()] == ["wiki/other.txt"]


def test_card_scan_stores_bundles(spark, tmp_path):
    """Odd texts come back as they were, and far fewer files than documents are stored."""
    odd = ["", "---\n", "a\r\nb\u2028c\x00\x1f", "\u00e4 \U0001f600 \\ \" {}", "x" * 70000, None]
    rows = [(i, odd[i % len(odd)], "de", "web") for i in range(300)] + [(7, "again", "en", "web"), (-3, "minus", "en", "web")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    before = set(os.listdir(work_dir(spark)))
    got = catalog()["card_scan"](spark, str(tmp_path)).collect()
    digest = lambda text: hashlib.md5(((text or "") + "\n").encode()).hexdigest()
    assert sorted((r["doc_id"], r["title"], r["tags"], r["body"]) for r in got if r["title"]) == sorted((i, f"Doc {i}", f"{lang},{source}", digest(t)) for i, t, lang, source in rows if t is not None)
    assert sum(r["title"] is None for r in got) == 50
    made = [d for d in set(os.listdir(work_dir(spark))) - before if d.startswith("corpus-")]
    assert sum(len(files) for _, _, files in os.walk(os.path.join(work_dir(spark), made[0]))) < 100


def test_posts_and_notes(spark, root):
    cards = rd.cards(rd.corpus(spark, root))
    got = [(r["seq"], r["host"], r["line"], r["via"], r["src"], r["dst"], r["field"], r["value"]) for r in sn.posts(cards).orderBy("seq").collect()]
    assert got == [(0, "codex", "qec", "cli", "open", "testing", "bet", "supported"), (1, "human", None, None, "testing", "supported", None, None)]
    note = sn.notes(cards).first()
    assert (note["slug"], note["kind"], note["lines"]) == ("p-1", "proposition", ["qec"])


def test_graph_from_files(spark, root):
    cards = rd.cards(rd.corpus(spark, root))
    wiki = cards.filter(F.col("path").startswith("wiki/"))
    g = gr.build_graph(wiki, sn.notes(cards))
    edges = {(r["source_id"], r["target_id"], r["type"]) for r in g["edges"].collect()}
    me = "wiki/concepts/toric-code"
    assert {(me, "wiki/concepts/anyons", "wikilink"), (me, me, "wikilink"), (me, "Missing Page", "wikilink"), ("threads/p-1", me, "wikilink"), (me, "tag:topology", "has_tag")} <= edges
    assert {r["target_text"] for r in gr.broken_links(g["nodes"], g["edges"]).collect()} == {"Missing Page", "raw/gone"}
    degree = {r["id"]: r["degree"] for r in gr.with_degree(g["nodes"], g["edges"]).collect()}
    assert degree[me] == 4 and degree["wiki/concepts/anyons"] == 1
    m = gr.graph_map(g["nodes"], g["edges"], g["tags"])
    assert {r["id"]: r["degree"] for r in m["nodes"].collect()}[me] == 5
    assert gr.graph_map(g["nodes"], g["edges"], g["tags"], skeleton=True)["nodes"].filter("type = 'ghost'").isEmpty()
    assert gr.find_node(g["nodes"], g["aliases"], "tc").first()["id"] == me
    assert gr.read_only_sql(spark, g, "WITH t AS (SELECT * FROM tags) SELECT count(*) FROM t").first()[0] > 0
    for bad in ("DROP VIEW nodes", "INSERT INTO nodes SELECT * FROM nodes", "CREATE TABLE x AS SELECT 1", "SET a = b"):
        with pytest.raises(ValueError):
            gr.read_only_sql(spark, g, bad)


def test_a_failed_rebuild_keeps_the_old_version(spark, tmp_path):
    root = str(tmp_path / "graph")
    sk.publish({"nodes": spark.range(3)}, root)
    boom = F.udf(lambda x: 1 // 0, "int")
    with pytest.raises(Exception):
        sk.publish({"nodes": spark.range(9), "edges": spark.range(2).select(boom("id").alias("x"))}, root)
    assert sk.published(spark, root, ["nodes"])["nodes"].count() == 3


def test_logs_skip_torn_lines(spark, tmp_path):
    log = tmp_path / "calls.jsonl"
    log.write_text(json.dumps({"at": "2026-01-01T00:00:00Z", "kind": "review", "ok": False}) + "\n\nnot json\n" + json.dumps({"kind": "x"}) + "\n{\"at\": \"20", encoding="utf-8")
    got = rd.call_log(spark, str(log)).orderBy("seq").collect()
    assert [(r["kind"], r["ok"], r["at"] is None) for r in got] == [("review", False, False), ("x", None, True)]
    sk.append_log(spark.range(1).select(F.lit("a").alias("id")), str(tmp_path / "seen"))
    sk.append_log(spark.range(1).select(F.lit("b").alias("id")), str(tmp_path / "seen"))
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 2


def test_empty_result_keeps_the_last(spark, tmp_path):
    path = str(tmp_path / "gaps")
    assert sk.write_if_any(spark.range(2), path) and not sk.write_if_any(spark.range(0), path)
    assert spark.read.json(path).count() == 2


def test_postings_are_made_once_for_a_query(spark):
    seen = spark.sparkContext.accumulator(0)
    chunks = spark.createDataFrame([(i, "lib", "the red ring it's" if i % 2 else "it's a bolt") for i in range(6)], "id bigint, library string, content string")

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    index = rt.postings(chunks.select("id", "library", read("content").alias("content")))
    index.count()
    once = seen.value
    got = {r.id for r in rt.postings_scores(index, rt.library_stats(chunks), "it's red ring none").collect()}
    assert got == set(range(6)) and seen.value == 2 * once


INDEXED = "id bigint, library string, collection string, path string, heading string, start_line int, end_line int, content string"


def scanned(chunks, q, n, **scope):
    leg = rt.keyword_scores(chunks, q)
    return sorted((r.library, r.bm25_rank, r.id, round(r.score, 9)) for r in rt.ranked(rt.scope_filter(leg, **scope), n, [F.col("score").desc()], "bm25_rank").collect())


def from_index(index, q, n, **scope):
    return sorted((r.library, r.bm25_rank, r.id, round(r.score, 9)) for r in rt.indexed_leg(index, q, n, **scope).collect())


def test_stored_index_answers_like_the_scan(spark, tmp_path):
    docs = [(i, "lib", "c", f"p{i}", "", 1, 1, t) for i, t in enumerate(["the red ring", "a red red bolt", "blue bolt red ring", "的红 注意力", "nothing"])]
    chunks = spark.createDataFrame(docs, INDEXED)
    index, stats = rt.postings(chunks), rt.library_stats(chunks)
    si.write_index(chunks, str(tmp_path / "ix"), buckets=4)
    stored = si.read_index(spark, str(tmp_path / "ix"))
    for q in ('"red-ring" bolt red red', "注意力 none"):
        a = scanned(chunks, q, 9)
        b = {(r["id"], round(r["score"], 9)) for r in rt.postings_scores(index, stats, q).collect()}
        assert {(i, s) for _, _, i, s in a} == b and a == from_index(stored, q, 9) and a
    assert stored.postings(["red"]).select(F.sum("n")).first()[0] == 3
    assert rt.search(chunks, "").count() == 0 == rt.search_index(stored, "").count() == rt.search_index(stored, "absent").count()


def test_index_prunes_zones_and_stays_exact_after_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(si, "ZONE", 4)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["red", "ring"]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)] + [0.05, 0.05], k=rng.randint(3, 80)))
    rows = [(i, f"lib{i % 3}", ["raw", "threads"][i % 2], f"p{i // 2}.md", "", 1, 1, text()) for i in range(240)]
    chunks = spark.createDataFrame(rows, INDEXED).repartition(3)
    index = si.write_index(chunks, str(tmp_path / "ix"), buckets=3)
    queries = ("red w50", "w0 w1 red-ring", "w3", "w0-w0 w59")
    for q in queries:
        assert from_index(index, q, 5) == scanned(chunks, q, 5)
    assert from_index(index, queries[0], 3, collection="threads", path="p*1.md") == scanned(chunks, queries[0], 3, collection="threads", path="p*1.md")
    whole = rt.search(chunks, "red w50 w3", k=7).collect()
    assert rt.search_index(index, "red w50 w3", k=7).collect() == whole and len(whole) == 7
    plan = rt.search_index(index, "red w50 w3", k=7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("content#") > 0 and all("In(zone" in scan for scan in plan.split("FileScan") if "content:string" in scan)

    now = {r[0]: r for r in rows}
    for step in range(2):
        paths = {f"p{rng.randrange(130)}.md" for _ in range(12)}
        now = {i: r for i, r in now.items() if r[3] not in paths}
        new = [(1000 * (step + 1) + i, f"lib{i % 3}", "raw", p, "", 1, 1, text()) for i, p in enumerate(sorted(paths)) if i % 4]
        new += [(r[0], *r[1:7], text()) for r in rows if r[3] in paths and r[0] % 5 == 0]  # an id comes back with another text
        now |= {r[0]: r for r in new}
        gone = spark.createDataFrame([(lib, p) for lib in ("lib0", "lib1", "lib2") for p in paths], "library string, path string")
        index = si.add_segment(index, spark.createDataFrame(new, INDEXED), gone)
        live = spark.createDataFrame(list(now.values()), INDEXED)
        assert from_index(index, queries[1], 5) == scanned(live, queries[1], 5)
    assert len(si.read_index(spark, str(tmp_path / "ix")).segments) == 3
    merged = si.merge(index)
    assert len(merged.segments) == 1 and from_index(merged, queries[1], 6) == scanned(live, queries[1], 6)


def test_session_sweep_names_what_failed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"sessionId": "s", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z", "role": "user", "text": "hi"}) + "\n", encoding="utf-8")
    flat = "sessionId string, cwd string, timestamp string, role string, text string"
    turns, failed = rd.sweep({"one": lambda: rd.flat_turns(spark.read.schema(flat).json(str(tmp_path / "a.jsonl")), "one"),
                              "two": lambda: rd.flat_turns(spark.read.schema(flat).json(str(tmp_path / "none.jsonl")), "two")})
    assert turns.count() == 1 and list(failed) == ["two"]


def test_atom_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A\n B</title><published>2026-01-01T00:00:00Z</published><summary>s</summary><author><name>N</name></author></entry></feed>", encoding="utf-8")
    from folioscope.operators.radar import new_listings
    row = new_listings(rd.atom_feed(spark, str(tmp_path / "f.xml"), "quant-ph"), "2026-01-05 00:00:00", 7).first()
    assert (row["id"], row["title"], row["authors"], row["source"]) == ("2401.00001", "A B", ["N"], "arxiv-new:quant-ph")


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([("# A\nx\n# B\ny",)], "text string").createOrReplaceTempView("tf_docs")
    got = spark.sql("SELECT s.heading FROM tf_docs, LATERAL section_rows(text) s").collect()
    assert [r[0] for r in got] == ["A", "B"]
    spark.createDataFrame([("## P\n- id: `p`\nCLAIM: c\nSOURCE: s",)], "text string").createOrReplaceTempView("tf_reports")
    assert [tuple(r) for r in spark.sql("SELECT c.claim, c.source FROM tf_reports, LATERAL claim_rows(text) c").collect()] == [("c", "s")]
    assert [tuple(r) for r in spark.sql("SELECT r.title, r.id FROM tf_reports, LATERAL report_rows(text) r").collect()] == [("P", "p")]
    spark.createDataFrame([("## Discussion\n### t · h\nhello",)], "text string").createOrReplaceTempView("tf_threads")
    assert [tuple(r) for r in spark.sql("SELECT p.seq, p.host, p.text FROM tf_threads, LATERAL post_rows(text) p").collect()] == [(0, "h", "hello")]


THREAD = """### 2026-01-01T00:00:00Z · early
~~~
## Discussion
~~~~
## Discussion
before any signature
### t1 · codex/qec · via cli
status: open -> testing
set: bet = holds now  
status: testing -> refuted
````
### t2 · fake
```
status: a -> b
````
end

### t3 · human
first
set: bet = too late
status: supported => disputed
### not a signature
### t4 · xy
~~~
### t5 · in a block that never ends"""


def test_posts_by_line_state(spark):
    want = [(0, "t1", "codex", "qec", "cli", "open", "testing", "bet", "holds now", "status: testing -> refuted\n````\n### t2 · fake\n```\nstatus: a -> b\n````\nend"),
            (1, "t3", "human", None, None, "supported", "disputed", None, None, "first\nset: bet = too late\n### not a signature"),
            (2, "t4", "xy", None, None, None, None, None, None, "~~~\n### t5 · in a block that never ends")]
    bodies = [(THREAD,), (THREAD.replace("\n", "\r\n"),), (None,), ("",), ("## Discussion",), ("### t · h\n",)]
    df = spark.createDataFrame(bodies, "body string")
    got = [[tuple(p) for p in r[0] or []] for r in df.select(F.expr(sn.posts_sql("body"))).collect()]
    assert got == [want, want, [], [], [], []]
    long = "## Discussion\n### a · b\n```\n" + "### t · h\n" * 200_000 + "```\nstatus: a -> b"
    row = spark.createDataFrame([(long,)], "body string").select(F.inline(F.expr(sn.posts_sql("body")))).select("src", F.length("text")).collect()
    assert [tuple(r) for r in row] == [("a", len("```\n" + "### t · h\n" * 200_000 + "```"))]
    assert "ArrowEval" not in df.select(F.expr(sn.posts_sql("body")))._jdf.queryExecution().toString()


def test_places_follow_the_files_whatever_their_size(spark, tmp_path):
    sizes = [3, 4000, 1, 700, 0, 90]
    want = []
    for n, size in enumerate(sizes):
        rows = [json.dumps({"id": f"{n}-{i}", "pad": "x" * (i % 50)}) for i in range(size)]
        (tmp_path / f"log-{n}.jsonl").write_text("".join(r + "\n" for r in rows), encoding="utf-8")
        want += [f"{n}-{i}" for i in range(size)]
    (tmp_path / "log-6.jsonl").write_text('{"id": "torn\n\n{"id": "end"}\n', encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = rd.json_log(spark, str(tmp_path), "id string").orderBy("seq").collect()
        assert [r["id"] for r in got] == [*want, "end"] and got[-1]["seq"] == len(want) + 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("root, path, want", [
    ("hdfs:///library", "hdfs://name:8020/library/wiki/a.md", "wiki/a.md"), ("hdfs://other/library/", "hdfs://name/library/raw/b c.md", "raw/b c.md"), ("s3a://bucket/lib.x", "s3a://bucket/lib.x/lib.x/a.md", "lib.x/a.md"),
    ("/data/library", "file:/data/library/wiki/a.md", "wiki/a.md"), ("file:///data/library", "file:///data/library/a.md", "a.md"), ("library", "file:/home/u/library/raw/a.md", "raw/a.md")])
def test_paths_are_relative_to_roots_of_any_store(spark, root, path, want):
    assert spark.range(1).select(rd.relative_to(F.lit(path), root)).first()[0] == want


def test_corpus_by_uri(spark, root):
    assert sorted(r[0] for r in rd.corpus(spark, f"file://{root}").select("path").collect()) == sorted(r[0] for r in rd.corpus(spark, root).select("path").collect())


def test_user_sql_leaves_the_session_alone_and_runs_queries_only(spark):
    spark.range(7).createOrReplaceTempView("nodes")
    try:
        own = {"nodes": spark.createDataFrame([("a",)], "id string"), "tags": spark.createDataFrame([("a", "ΟΔΟΣ"), ("a", "Straße"), ("b", None)], "node_id string, tag string")}
        tables = lambda: {v.name for v in spark.catalog.listTables()}
        before = tables()
        run = lambda q: gr.read_only_sql(spark, own, q)
        assert run("SELECT count(*) AS n FROM nodes -- all").first()[0] == 1
        assert [r[0] for r in run("SELECT node_id FROM tags ORDER BY node_id DESC, tag;").collect()] == ["b", "a", "a"]
        assert run("WITH nodes AS (SELECT 5 AS x) SELECT x FROM nodes").first()[0] == 5
        assert run("VALUES (1), (2)").count() == 2
        bad = ("DROP VIEW nodes", "INSERT INTO nodes SELECT * FROM nodes", "WITH t AS (SELECT 1) INSERT INTO nodes SELECT * FROM t", "FROM tags INSERT INTO nodes SELECT node_id",
               "CREATE TABLE x AS SELECT 1", "SET a = b", "CACHE TABLE nodes", "EXPLAIN SELECT 1", "not sql", "SELECT 1) UNION (SELECT 2", "SELECT 1; SELECT 2", "SELECT java_method('java.lang.System', 'nanoTime')",
               "SELECT REFLECT('java.lang.System', 'nanoTime')", "")
        for query in bad:
            with pytest.raises(ValueError):
                run(query)
        assert tables() == before and spark.table("nodes").count() == 7
        # A name of a statement in a text is no statement.
        assert run("SELECT 'InsertInto (Command)' AS s").count() == 1
    finally:
        spark.catalog.dropTempView("nodes")


def test_case_folding_is_that_of_the_unicode_tables(spark):
    from folioscope.functions.tables import register_functions
    register_functions(spark)
    words = ["ΟΔΟΣ", "Straße", "ŉ", "ﬃ", "İI", "Néel", "Ω-Background", "ᏸꭰ", "😀ẞ𐐀", "", "plain", "ϐϑ", "a\nB", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(tx.fold_case(F.col("w")).alias("f"), F.expr("ulower(w)").alias("s")).collect()
    wanted = [w.casefold() if w is not None else None for w in words]
    assert [r["f"] for r in got] == wanted and [r["s"] for r in got] == wanted


def test_versions_are_numbered_and_all_tables_are_of_one(spark, tmp_path):
    root = str(tmp_path / "graph")
    with pytest.raises(LookupError):
        sk.published(spark, root, ["nodes"])
    for n in (3, 5):
        sk.publish({"nodes": spark.range(n), "edges": spark.range(n * 2)}, root)
    held = sk.published(spark, root, ["nodes", "edges"])
    sk.publish({"nodes": spark.range(1), "edges": spark.range(1)}, root)
    assert (held["nodes"].count(), held["edges"].count()) == (5, 10)
    assert sk.published(spark, root, ["edges"])["edges"].count() == 1


def test_a_term_of_a_chunk_is_one_row_before_any_shuffle(spark, tmp_path):
    chunks = [(1, "lib", "a b a"), (1, "lib", "b b"), (2, "lib", ""), (3, "lib", None), (4, "lib", "b c"), (None, None, "c a c"), (None, None, "c")]
    rows = [(i, lib, "c", "p", "", 1, 1, t) for i, lib, t in chunks]
    given = spark.createDataFrame(chunks, "id long, library string, content string").selectExpr("library", "0L as zone", "id", "3L as dl", "split(content, ' ') as tokens")
    seen = given.where("id = 1").mapInArrow(si._term_rows, si.TERM_ROWS)
    assert "Exchange" not in seen._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.term, r.tf, r.positions) for r in seen.collect()) == [("a", 2, [0, 2]), ("b", 1, [1]), ("b", 2, [0, 1])]
    index = si.write_index(spark.createDataFrame(rows, INDEXED), str(tmp_path / "ix"), buckets=2)
    docs = index.table("postings").selectExpr("term", "library", "max_tf", "min_dl", "n", "inline(docs)")
    got = {(r.term, r.library, r.id): (r.tf, r.positions, r.max_tf, r.n) for r in docs.collect()}
    assert got == {("a", "lib", 1): (2, [0, 2], 2, 1), ("b", "lib", 1): (3, sorted([1, 0, 1]), 3, 2), ("b", "lib", 4): (1, [0], 3, 2), ("c", "lib", 4): (1, [1], 1, 1),
                   ("c", None, None): (3, [0, 0, 2], 3, 1), ("a", None, None): (1, [1], 1, 1)}


def test_an_index_is_shuffled_as_blocks_that_do_not_stay(spark, tmp_path, monkeypatch):
    """Blocks hold the postings of whole zones, their hashes are Spark's, and the writer leaves no shuffle files."""
    import random
    import time

    import pyarrow as pa
    rng = random.Random(3)
    words = ["".join(rng.choice("abé注") for _ in range(n)) for n in [*range(1, 70), 3, 4, 5, 9, 17]]
    hashed = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert list(si._hashes(pa.array(["", *words]).slice(1))) == [r[0] for r in hashed]
    plain = [w for w in words if not any(c in "é注" for c in w)] + ["red", "ring", "bolt", "nut"]
    rows = [(i, rng.choice(["x", "y", None]), "c", "p", "", 1, 1, " ".join(rng.choice(plain) for _ in range(rng.randrange(9)))) for i in range(1500)]
    monkeypatch.setattr(si, "BLOCK_ROWS", 700)
    batches = [pa.RecordBatch.from_pydict({"library": ["x"] * 900, "zone": [i // 256 for i in range(n, n + 900)], "id": [*range(n, n + 900)], "dl": [3] * 900, "tokens": [["a", "b", "a"]] * 900}) for n in (0, 900)]
    seen = [r for b in si._posting_rows(si._term_blocks(4)(iter(batches))) for r in b.to_pylist()]
    assert sorted((r["term"], r["zone"], r["n"], len(r["docs"]), r["max_tf"]) for r in seen) == sorted((t, z, n, n, k) for z in range(8) for n in [256 if z < 7 else 8] for t, k in (("a", 2), ("b", 1)))
    chunks = spark.createDataFrame(rows, INDEXED)
    kept = lambda: sum("shuffle_" in str(f) for f in spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").split())
    before = kept()
    index = si.write_index(chunks, str(tmp_path / "ix"), buckets=3)
    for _ in range(40):
        if kept() <= before:
            break
        time.sleep(0.25)
    assert kept() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    got = {(r.term, r.library, r.id): (r.dl, r.tf, r.positions) for r in index.table("postings").selectExpr("term", "library", "inline(docs)").collect()}
    wanted = {}
    for i, library, *_, text in rows:
        tokens = text.split()
        for at, w in enumerate(tokens):
            wanted.setdefault((w, library, i), (len(tokens), tokens.count(w), []))[2].append(at)
    assert got == wanted
    blocks = index.table("postings").groupBy("bucket", "term", "library", "zone").count().where("count > 1")
    assert blocks.isEmpty() and index.postings(["red"]).select(F.sum("n")).first()[0] == sum(k[0] == "red" for k in wanted)


def test_sections_by_matches_fold_case_line_by_line(spark):
    from folioscope.functions import text as tx
    from folioscope.operators import retrieval as rt
    rows = [("a", 1, "Straße nicht er\nNICHT ERST\nΟΔΟΣ nicht er"), ("b", 4, "nicht\ner"), ("c", 9, "x nıcht er"), ("d", 1, "ſtrasse STRASSE"), ("e", 2, None)]
    sections = spark.createDataFrame(rows, "path string, start_line int, content string")
    got = rt.sections_by_matches(sections, " NICHT er ")
    assert [(r["path"], r["match_count"], [tuple(m) for m in r["matches"]]) for r in got.collect()] == [
        ("a", 3, [(1, "Straße nicht er"), (2, "NICHT ERST"), (3, "ΟΔΟΣ nicht er")])]
    assert [(r["path"], r["match_count"]) for r in rt.sections_by_matches(sections, "STRASSE").collect()] == [("a", 1), ("d", 1)]
    # ASCII texts are not searched for letters that fold apart, and those are ranges.
    assert "octet_length" in sections.select(tx.fold_case(F.col("path")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(tx._folds_apart()) < len(tx.folding())
