"""Registered queries against their SQL checks; FULL=1 runs every one of them."""

import os
import re

import duckdb
import pytest

from folioscope.operators import corpus, graph, quality, radar
from folioscope.plans.registry import catalog
from folioscope.plans.tables import BASE
from verify_queries import rows_of

ROOT = "/root/testdata/sf0.001"
SOME = {"keyword_search", "vector_search_filtered_after", "similar_cards_with_boosts", "resolved_links", "graph_skeleton", "quote_verification", "chain_issues",
        "host_conflicts", "nearest_session", "fair_budget", "citation_gaps", "conversion_findings", "sources_by_containment", "batch_review", "slugs"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in BASE:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog() if os.environ.get("FULL") else SOME))
def test_matches_sql(spark, con, name):
    q = catalog()[name]
    df = q(spark, ROOT)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.oracle:
        rel = con.execute(q.oracle)
        assert got == rows_of([d[0] for d in rel.description], rel.fetchall())


def test_every_query_names_inventory_ids():
    for q in catalog().values():
        assert q.ids and all(re.fullmatch(r"(ST|[A-Z])\d+", i) for i in q.ids), q.name


def test_task_functions_travel_with_their_code():
    from pyspark import cloudpickle

    from folioscope.functions.text import loose_text
    assert "folioscope" in cloudpickle.list_registry_pickle_by_value()
    assert b"normalize" in cloudpickle.dumps(loose_text)


@pytest.mark.parametrize("query, module, operator, column", [
    ("markdown_links", corpus, "markdown_links", "text"), ("collection_summary", corpus, "collection_summary", "body"), ("reference_check", graph, "card_reference_check", "text"),
    ("link_repairs", graph, "repair_links", "text"), ("link_retargets", corpus, "retarget_links", "text"), ("report_candidates", radar, "report_candidates", "text"),
    ("missing_images", quality, "missing_images", "md"), ("wikilink_text_issues", quality, "wikilink_text_issues", "body")])
def test_operators_are_given_whole_texts(spark, monkeypatch, query, module, operator, column):
    root, given, own = "/root/testdata/sf0.001", [], getattr(module, operator)
    monkeypatch.setattr(module, operator, lambda df, *rest: given.append(df) or own(df, *rest))
    catalog()[query](spark, root)
    got = [r[0] for r in given[0].select(column).collect()]
    left_out = {3} if query == "link_repairs" else set()  # raw papers
    texts = [r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect() if r.doc_id % 5 not in left_out and len(r.text or "") > 300]
    assert texts and all(any(t in g for g in got) for t in texts)


@pytest.mark.parametrize("name", ["gap_groups", "kept_citation_gaps", "shared_references"])
def test_papers_have_works_in_common(spark, tmp_path, name):
    """Papers that cite different parts of one kind share them, as the SQL says."""
    spark.createDataFrame([(k,) for k in (1, 2, 1328)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 7), (1, 508), (2, 507), (2, 8), (114, 7), (114, 8), (13 + 2 * 101, 1007), (13 + 2 * 101, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalog()[name](spark, str(tmp_path))
    rel = con.execute(catalog()[name].oracle)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of([d[0] for d in rel.description], rel.fetchall()) and got[1]


def graph_folder(spark, root):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")

    put("region", [(0, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(0, "INDIA", 0), (1, None, 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(1, "c one", 0, "AUTO"), (2, None, 1, None)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    put("supplier", [(1, "s one", 0, 5.0), (2, "s two", 1, -5.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    put("part", [(7, "p seven", "T", 1, "B"), (11, "p eleven", "U", 2, "B"), (8, "p eight", "T", 1, None)], "p_partkey long, p_name string, p_type string, p_size int, p_brand string")
    put("lineitem", [(1, 7, 1, 1), (1, 7, 1, 2), (2, 7, 2, 3), (3, 11, None, 1), (3, 11, None, 2), (4, None, 1, 1), (4, None, None, 1), (5, None, None, 2)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    return str(root)


def test_edge_rows_are_those_of_their_sql(spark, tmp_path):
    from folioscope.plans.tables import DERIVED, Tables
    t = Tables(spark, graph_folder(spark, tmp_path))
    plain = t._derived(DERIVED["edge_rows"], "edge_rows")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(t.edge_rows) == rows(plain) and plain.count() == 2 + 2 + 2 + 5 + 1
    dealt = t.edge_rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_id" not in dealt and "hashpartitioning(l_partkey" in dealt


def test_no_task_holds_all_nodes_or_parts(spark, tmp_path):
    """Tables as long as the graph meet by sort-merge joins, however small their files are."""
    from folioscope.operators import graph as gr
    from folioscope.plans import graph_queries as gq
    from folioscope.plans.tables import Tables
    t = Tables(spark, graph_folder(spark, tmp_path))
    kept = gr.graph_map(t.nodes, t.edge_rows, t.tag_rows, limit=300)
    for df in (kept["summary"], gr.resolve_links(spark.createDataFrame([("a", "B")], "source_id string, link string"), gr.key_table(t.nodes, t.alias_rows))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin [id" not in plan and "BroadcastHashJoin [key" not in plan
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m" and spark.conf.get("spark.sql.files.maxPartitionBytes") == "32m"


def test_postings_of_a_chunk_are_counted_where_it_is(spark, tmp_path):
    from folioscope.plans.registry import catalog
    rows = [(1, "x", "en", "one two two"), (2, "x", "en", "two"), (2, "x", "en", "two three"), (3, None, "de", "one"), (None, "y", "de", None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spread = catalog()["term_spread"](spark, str(tmp_path))
    assert {(r["library"], r["term"], r["chunks"], r["occurrences"]) for r in spread.collect()} == {
        ("x", "one", 1, 1), ("x", "two", 2, 4), ("x", "three", 1, 1), (None, "one", 1, 1)}
    assert "hashpartitioning(term" not in spread._jdf.queryExecution().executedPlan().toString()
