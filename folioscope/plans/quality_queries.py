"""Quality check queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import markup as md
from ..operators import quality as qu
from .registry import query
from .tables import Tables

TODAY = "2024-10-01"
WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"
PLAIN = "length(regexp_replace(regexp_replace(text, '\\\\[A-Za-z]+|[${}&\\\\|]', '', 'g'), '\\s+', '', 'g'))"


def _census(t: Tables) -> DataFrame:
    return t.conversion_rows.select("doc_id", F.col("chars").cast("double").alias("chars"), F.col("tables").cast("int").alias("tables"), F.lit(9).alias("table_rows"))


FINDINGS = f"""f AS (SELECT doc_id, route, 'suspiciously-short' AS code FROM c WHERE {WORDS} < 100
UNION ALL SELECT doc_id, route, 'figure-count-mismatch' FROM c WHERE figures_referenced > figures_resolved
UNION ALL SELECT doc_id, route, 'tables-dropped' FROM c WHERE tables > 0 AND NOT regexp_matches(text, '(?im)^\\s*\\|.*\\|\\s*$|<tr\\b')
UNION ALL SELECT doc_id, route, 'output-much-shorter-than-source' FROM c WHERE chars > 0 AND {PLAIN} / chars < 0.8
UNION ALL SELECT doc_id, route, 'output-inflated' FROM c WHERE chars > 0 AND length(regexp_replace(text, '\\s+', '', 'g')) / chars > 4.0)"""


# Occurrences of a passage: what taking it out shortens the text by. Its unit: the least shift at which it matches itself.
REPEATS = r"""r0 AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM ({0})),
r1 AS (SELECT doc_id, b, unnest(list_distinct(list_transform(range(0, length(b) - 200, 25), lambda i: substr(b, i + 1, 200)))) AS p FROM r0 WHERE length(b) >= 400),
r2 AS (SELECT doc_id, p, (length(b) - length(replace(b, p, ''))) // 200 AS n FROM r1),
repeats AS (SELECT doc_id, max(n) AS n FROM r2 WHERE n > 1 AND length(regexp_replace(p, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 50
  AND len(list_filter(range(1, 40), lambda s: starts_with(p, substr(p, s + 1)))) = 0 GROUP BY doc_id)"""
RECOGNISED = "SELECT doc_id, md AS text FROM conversion_rows WHERE route IN ('ocr', 'mineru')"
LOOPS = "UNION ALL SELECT doc_id, route, 'repetition-loop' FROM c JOIN repeats USING (doc_id)"


def _findings(t: Tables) -> DataFrame:
    return qu.conversion_findings(t.conversion_rows.drop("chars", "tables"), _census(t))


@query("Q1 Q3 Q7 Q9 Q10 Q11 Q13", f"WITH c AS (SELECT *, md AS text FROM conversion_rows), {REPEATS.format(RECOGNISED)}, {FINDINGS[:-1]} {LOOPS}) SELECT * FROM f")
def conversion_findings(t: Tables) -> DataFrame:
    return _findings(t).select("doc_id", "route", "code")


@query("Q13 A35", f"WITH c AS (SELECT *, md AS text FROM conversion_rows), {REPEATS.format(RECOGNISED)}, {FINDINGS[:-1]} {LOOPS}) SELECT code, route, count(*) AS n FROM f GROUP BY ALL")
def findings_by_route(t: Tables) -> DataFrame:
    return qu.finding_summary(_findings(t), "route")


FILLED = "SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN repeat('abcdefg', 200) ELSE '' END AS text FROM documents"


@query("Q9", f"WITH {REPEATS.format(FILLED)} SELECT doc_id, CAST(coalesce(n, 1) AS INT) AS repeats FROM documents LEFT JOIN repeats USING (doc_id)")
def repetition(t: Tables) -> DataFrame:
    """Filler of a short unit follows every fourth text and is no loop."""
    filled = F.concat("text", F.when(F.col("doc_id") % 4 == 0, F.repeat(F.lit("abcdefg"), 200)).otherwise(""))
    return t.documents.select("doc_id", qu.repetition(filled).alias("repeats"))


@query("Q2", "SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS INT) AS n FROM documents")
def leftover_tex(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    clean = F.regexp_replace("text", r"[\\$`]", "")
    text = F.when(k == 0, F.concat(clean, F.lit(" \\cite{a} and \\textbf {b}"))).when(k == 1, F.concat(clean, F.lit(" $\\label{x}$ $$\\begin{a}$$\n```\n\\ref{q}\n```\n"))).otherwise(F.concat(F.lit("---\ntitle: \\ref{z}\n---\n"), clean, F.lit("\\footnote[")))
    return t.documents.select("doc_id", F.size(qu.leftover_tex(text)).alias("n"))


@query("Q8", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'align*:1,array:-1' WHEN 1 THEN '' ELSE 'array:2' END AS balance FROM documents")
def environment_balance(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    tail = F.when(k == 0, "\\begin{align*} \\begin{array} \\end{array} \\end {array}").when(k == 1, "\\begin{a}\\end{a}").otherwise("\\begin{array}\\begin {array}")
    return t.documents.select("doc_id", F.array_join(qu.environment_balance(F.concat(F.regexp_replace("text", r"\\", ""), tail)), ",").alias("balance"))


@query("Q4 C29", "SELECT class, count(*) AS n FROM (SELECT CASE doc_id % 8 WHEN 0 THEN 'external' WHEN 1 THEN 'absolute' WHEN 2 THEN 'backslash' WHEN 3 THEN 'escaping' WHEN 4 THEN 'bare' WHEN 5 THEN 'elsewhere' WHEN 6 THEN 'nested' ELSE 'portable' END AS class FROM documents UNION ALL SELECT 'portable' FROM documents) GROUP BY class")
def image_reference_census(t: Tables) -> DataFrame:
    targets = ["https://e.org/a.png", "C:/tmp/a.png", "images\\\\a.png", "images/../a.png", "a.png", "figs/a.png", "images/x/a.png", "<images/a b.png>"]
    pick = F.element_at(F.lit(targets), (F.col("doc_id") % 8 + 1).cast("int"))
    text = F.concat(F.lit("![cap [x\\]]("), pick, F.lit(")\n<figure><img class='q' src=\"images/z.png\"></figure>\n"), F.regexp_replace("text", "[!<]", ""))
    return qu.image_census(t.documents.select(text.alias("md")))


@query("Q5", f"""WITH d AS (SELECT doc_id, coalesce(text, '') || ' ![x](images/f' || CAST(doc_id % 10 AS STRING) || '.png)' AS md FROM documents),
i AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(md, '{md.MD_IMAGE.replace("'", "''")}', 1), regexp_extract_all(md, '{md.HTML_IMAGE.replace("'", "''")}', 1))) AS x FROM d)
SELECT doc_id, substr(x, 8) AS name FROM i WHERE regexp_matches(x, '^images/[^/]+$') AND NOT (doc_id % 10 <= 3 AND x = 'images/f' || CAST(doc_id % 10 AS STRING) || '.png')""")
def missing_images(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" ![x](images/f"), (F.col("doc_id") % 10).cast("string"), F.lit(".png)")).alias("md"))
    held = t.documents.filter("doc_id % 10 <= 3").select("doc_id", F.concat(F.lit("f"), (F.col("doc_id") % 10).cast("string"), F.lit(".png")).alias("name"))
    return qu.missing_images(docs, held).select("doc_id", "name")


@query("Q6 Q12", "SELECT doc_id, 'identity-mismatch' AS code FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 'payload-is-pdf' FROM documents WHERE doc_id % 5 = 0")
def identity_findings(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = t.documents.select("doc_id", F.lit("tex").alias("route"), F.concat(F.lit("---\narxiv_id: '2401.0000"), (d % 3).cast("string"), F.lit("v2'\n---\n"), "text").alias("md"),
                              F.when(d % 3 == 2, None).otherwise(F.lit("arXiv:2401.00000")).alias("expected_arxiv_id"), F.when(d % 5 == 0, "%PDF-").otherwise("\\docu").alias("payload"))
    return qu.conversion_findings(rows).filter(F.col("code").isin("identity-mismatch", "payload-is-pdf")).select("doc_id", "code")


@query("C30", "SELECT doc_id, CAST(3 + doc_id % 2 AS INT) AS n FROM documents")
def table_rows(t: Tables) -> DataFrame:
    clean = F.regexp_replace("text", "[|<]", "")
    return t.documents.select("doc_id", md.table_rows(F.concat(F.lit("| a | b |\n|---|:--|\n | 1 | 2 |\n<TR><td>x</td></tr>"), F.when(F.col("doc_id") % 2 == 1, "\n<tr class='q'>").otherwise(""), F.lit("\n"), clean)).alias("n"))


@query("Q17", "SELECT doc_id, doc_id % 3 = 1 AS open FROM documents")
def unclosed_fences(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    tail = F.when(k == 0, "\n```py\nx\n```\n").when(k == 1, "\n~~~~\nx\n~~~\n```\n").otherwise("\n```\n~~~\n`````  \n")
    return t.documents.select("doc_id", md.fence_left_open(F.concat(F.regexp_replace("text", "[`~]", ""), tail)).alias("open"))


@query("Q14", """WITH p AS (SELECT conv_id AS doc_id, count(*) AS pages, CAST(floor(sum(length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))) / count(*)) AS BIGINT) AS chars_per_page FROM conversations GROUP BY ALL)
SELECT doc_id, pages, chars_per_page, chars_per_page >= 200 AS usable FROM p""")
def text_layers(t: Tables) -> DataFrame:
    pages = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", F.lit(False).alias("full_page_image"))
    return qu.text_layer(pages).select("doc_id", "pages", "chars_per_page", "usable")


@query("Q15 C35", "SELECT doc_id, CAST(7 AS INT) AS run FROM documents WHERE doc_id % 2 = 0")
def prose_in_maths(t: Tables) -> DataFrame:
    body = F.when(F.col("doc_id") % 2 == 0, "x^2 we replace the ground field with ours \\alpha").otherwise("E = mc^2 where \\text{the mass of the whole body is} m")
    return qu.prose_blocks(t.documents.select("doc_id", F.concat(F.regexp_replace("text", "[$`]", ""), F.lit(" $$"), body, F.lit("$$ end")).alias("text")), key="doc_id").select("doc_id", "run")


# ------------------------------------------------------------------ cards

@query("F9", """WITH w AS (SELECT path, volatility, updated, CASE volatility WHEN 'hot' THEN 30 WHEN 'warm' THEN 180 WHEN 'cold' THEN 365 END AS lim, date_diff('day', TRY_CAST(updated AS DATE), DATE '2024-10-01') AS age FROM card_rows WHERE path LIKE 'wiki/%')
SELECT path, CASE WHEN volatility IS NULL THEN 'no volatility' WHEN age IS NULL THEN 'no date' ELSE 'stale' END AS issue, CASE WHEN volatility IS NOT NULL AND age > lim THEN CAST(age AS INT) END AS age FROM w WHERE volatility IS NULL OR age IS NULL OR age > lim""")
def freshness_issues(t: Tables) -> DataFrame:
    return qu.freshness_issues(t.cards, TODAY)


@query("F10", """WITH i AS (SELECT path, unnest(list_filter([CASE WHEN title = '' THEN 'critical|missing title' END, CASE WHEN path LIKE 'raw/%' THEN 'critical|missing source' END, CASE WHEN path LIKE 'raw/%' THEN 'critical|missing ingested' END,
 CASE WHEN path LIKE 'wiki/%' AND updated IS NULL THEN 'critical|missing updated' END, CASE WHEN summary = '' THEN CASE WHEN path LIKE 'raw/%' THEN 'warning|missing summary' ELSE 'critical|missing summary' END END,
 CASE WHEN path LIKE 'wiki/%' AND confidence = 'sure' THEN 'warning|invalid confidence' END], lambda x: x IS NOT NULL)) AS issue FROM card_rows WHERE path LIKE 'raw/%' OR path LIKE 'wiki/%') SELECT path, issue FROM i""")
def front_matter_issues(t: Tables) -> DataFrame:
    return qu.front_matter_issues(t.cards).select("path", F.concat_ws("|", "severity", "issue").alias("issue"))


@query("A35", """SELECT severity, count(*) AS n FROM (SELECT CASE WHEN path LIKE 'raw/%' THEN 'warning' ELSE 'critical' END AS severity FROM card_rows WHERE summary = '' AND path NOT LIKE 'drafts/%' UNION ALL SELECT 'critical' FROM card_rows WHERE title = '' AND path NOT LIKE 'drafts/%'
 UNION ALL SELECT unnest(['critical', 'critical']) FROM card_rows WHERE path LIKE 'raw/%' UNION ALL SELECT 'critical' FROM card_rows WHERE path LIKE 'wiki/%' AND updated IS NULL UNION ALL SELECT 'warning' FROM card_rows WHERE path LIKE 'wiki/%' AND confidence = 'sure') GROUP BY severity""")
def issue_counts(t: Tables) -> DataFrame:
    return qu.issue_counts(qu.front_matter_issues(t.cards))


@query("F11", "SELECT path, unnest(CASE WHEN path LIKE 'wiki/references/%' THEN ['Key Contributions', 'Theoretical Framework'] ELSE ['Mathematical Formalism'] END) AS missing_heading FROM card_rows WHERE path LIKE 'wiki/references/%' OR path LIKE 'wiki/concepts/%'")
def heading_issues(t: Tables) -> DataFrame:
    return qu.heading_issues(t.cards.withColumn("body", F.concat("body", F.lit("\n## 1. core   DEFINITION of it\n"))))


@query("F12", "WITH n AS (SELECT count(*) AS n FROM documents WHERE lang = 'en'), m AS (SELECT count(*) AS n FROM documents WHERE lang = 'de') SELECT CAST(2 AS INT) AS tag_group, 'llm, llms' AS tags FROM n, m WHERE n.n > 0 AND m.n > 0")
def near_duplicate_tags(t: Tables) -> DataFrame:
    tags = t.documents.select(F.when(F.col("lang") == "en", "llm").when(F.col("lang") == "de", "llms").when(F.col("lang") == "fr", "ai").otherwise("ml").alias("tag"))
    return qu.tag_group_issues(tags).select("tag_group", "tags")


@query("F13", f"""WITH l AS (SELECT path, unnest(regexp_extract_all(coalesce(body, '') || ' [[' || CASE doc_id % 3 WHEN 0 THEN 'a/b' WHEN 1 THEN '$x^2$' ELSE 'fine page' END || ']]', '{md.WIKILINK}', 1)) AS link FROM card_rows WHERE path NOT LIKE 'raw/%')
SELECT path, link, CASE WHEN regexp_matches(link, '[\\\\/:*?"<>|]') THEN 'illegal character' ELSE 'raw maths' END AS issue FROM l WHERE regexp_matches(link, '[\\\\/:*?"<>|]|^\\$|\\$$|[{{}}]')""")
def wikilink_text_issues(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    return qu.wikilink_text_issues(t.card_rows.select("path", F.concat(F.coalesce("body", F.lit("")), F.lit(" [["), F.when(k == 0, "a/b").when(k == 1, "$x^2$").otherwise("fine page"), F.lit("]]")).alias("body")))


@query("F15", "SELECT path, 'bet' AS issue FROM card_rows WHERE doc_id % 6 = 0 UNION ALL SELECT path, 'signed posts' FROM card_rows WHERE doc_id % 8 = 0")
def tier_leaks(t: Tables) -> DataFrame:
    cards = t.card_rows.select("path", F.when(F.col("doc_id") % 6 == 0, F.create_map(F.lit("bet"), F.lit("x"), F.lit("title"), F.lit("y"))).otherwise(F.create_map(F.lit("title"), F.lit("y"))).alias("fields"))
    return qu.tier_leaks(cards, t.card_rows.filter("doc_id % 8 = 0").select("path"))


@query("F27", """WITH e AS (SELECT path, CASE WHEN path LIKE 'raw/%' THEN 'raw/' || type WHEN category = 'concept' THEN 'wiki/concepts' WHEN category = 'topic' THEN 'wiki/topics' WHEN category = 'reference' THEN 'wiki/references' END || '/' || regexp_extract(path, '[^/]*$') AS expected FROM card_rows WHERE path LIKE 'raw/%' OR path LIKE 'wiki/%')
SELECT path, expected, expected IN (SELECT path FROM card_rows) AS taken FROM e WHERE expected <> path""")
def misplaced_cards(t: Tables) -> DataFrame:
    return qu.misplaced(t.cards)


@query("F28", "SELECT CASE WHEN doc_id % 7 = 0 THEN 'junk' ELSE 'raw/stray' END AS entry, count(*) AS files FROM documents WHERE doc_id % 7 < 2 GROUP BY 1")
def unexpected_entries(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 7
    return qu.unexpected_entries(t.card_rows.select(F.when(k == 0, F.concat(F.lit("junk/"), "path")).when(k == 1, F.lit("raw/stray/x.md")).otherwise(F.col("path")).alias("path")))


@query("J31", """WITH c AS (SELECT doc_id, 'wiki/topics/' || CAST(doc_id // 100 AS STRING) AS folder FROM card_rows WHERE path LIKE 'wiki/topics/%')
SELECT folder || '/t-' || CAST(doc_id AS STRING) || '.md' AS path, NULL AS link, 'not listed' AS issue FROM c WHERE doc_id % 4 <> 0 UNION ALL SELECT folder || '/gone-' || CAST(doc_id AS STRING) || '.md', 'gone-' || CAST(doc_id AS STRING) || '.md', 'dead link' FROM c WHERE doc_id % 9 = 0""")
def listing_issues(t: Tables) -> DataFrame:
    d = F.col("doc_id").cast("string")
    topics = t.card_rows.filter(F.col("path").startswith("wiki/topics/")).select(
        "doc_id", F.concat(F.lit("wiki/topics/"), F.floor(F.col("doc_id") / 100).cast("string")).alias("folder")).withColumn("path", F.concat("folder", F.lit("/t-"), d, F.lit(".md")))
    row = F.concat_ws(" ", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("[x]("), md.basename(F.col("path")), F.lit(")"))),
                      F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("[g](gone-"), d, F.lit(".md)"))))
    # A folder holds at most a hundred cards, so its listing is a bounded text.
    listings = topics.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("text"))
    return qu.index_consistency(listings, topics.select("path"))


# ------------------------------------------------------------------ sources

def _files(t: Tables) -> DataFrame:
    return t.card_rows.select("path")


RESOLVED = """refs AS (SELECT path AS owner, unnest(list_filter(string_split(sources_csv, ';'), lambda x: x <> '' AND x NOT LIKE 'http%')) AS ref FROM card_rows WHERE path LIKE 'wiki/%'),
res AS (SELECT owner, ref, CASE WHEN ref IN (SELECT path FROM card_rows) THEN ref WHEN 'raw/papers/' || ref || '.md' IN (SELECT path FROM card_rows) THEN 'raw/papers/' || ref || '.md' END AS path, CASE WHEN ref IN (SELECT path FROM card_rows) THEN 'path' WHEN 'raw/papers/' || ref || '.md' IN (SELECT path FROM card_rows) THEN 'raw slug' ELSE 'none' END AS tier FROM refs)"""


@query("J6", f"WITH {RESOLVED} SELECT * FROM res")
def resolved_sources(t: Tables) -> DataFrame:
    from ..operators.quality import resolve_sources
    refs = t.cards.filter(F.col("path").startswith("wiki/")).select(F.col("path").alias("owner"), F.explode("sources").alias("ref"))
    return resolve_sources(refs, _files(t), t.cards).select("owner", "ref", "path", "tier")


@query("J6", """WITH d AS (SELECT p_partkey AS k, 'raw/papers/2024-01-01-' || replace(p_name, ' ', '-') || '-study-' || CAST(p_partkey AS STRING) || '.md' AS path FROM part),
r AS (SELECT p_partkey AS k, replace(p_name, ' ', '-') || '-study-' || CAST(p_partkey AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-extended' ELSE '~' END AS ref FROM part)
SELECT 'wiki/x.md' AS owner, ref, CASE WHEN n = 1 THEN p END AS path, n AS matches FROM (SELECT r.k, r.ref, count(*) AS n, min(d.path) AS p FROM r JOIN d ON (contains(replace(r.ref, '~', ''), substr(d.path, 23, length(d.path) - 25)) OR contains(substr(d.path, 23, length(d.path) - 25), replace(r.ref, '~', ''))) AND (r.k % 3 = 1 OR substr(d.path, 23, length(d.path) - 25) = replace(r.ref, '~', '')) GROUP BY r.k, r.ref)""")
def sources_by_containment(t: Tables) -> DataFrame:
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-study-"), F.col("p_partkey").cast("string"))
    files = t.part.select(F.concat(F.lit("raw/papers/2024-01-01-"), name, F.lit(".md")).alias("path"))
    k = F.col("p_partkey") % 3
    refs = t.part.select(F.lit("wiki/x.md").alias("owner"), F.concat(name, F.when(k == 0, "").when(k == 1, "-extended").otherwise("~")).alias("ref"))
    cards = t.cards.limit(0)
    return qu.resolve_sources(refs, files, cards).select("owner", "ref", "path", "matches")


@query("J8", f"""WITH {RESOLVED} SELECT path, 'no sources' AS issue, NULL AS ref FROM card_rows WHERE path LIKE 'wiki/%' AND sources_csv = '' UNION ALL SELECT owner, 'unresolved source', ref FROM res WHERE path IS NULL""")
def provenance_issues(t: Tables) -> DataFrame:
    return qu.provenance_issues(t.cards, _files(t))


@query("J7", f"WITH {RESOLVED} SELECT path FROM card_rows WHERE path LIKE 'raw/%' AND path NOT IN (SELECT path FROM res WHERE path IS NOT NULL)")
def uncovered_sources(t: Tables) -> DataFrame:
    return qu.uncovered(_files(t), t.cards)


@query("J5", """SELECT path FROM card_rows WHERE path LIKE 'raw/%' AND path NOT IN (SELECT unnest(string_split(sources_csv, ';')) FROM card_rows WHERE path LIKE 'wiki/references/%')""")
def uncompiled_sources(t: Tables) -> DataFrame:
    return qu.uncompiled(_files(t), t.cards)


@query("Q16", """WITH miss AS (SELECT path FROM (SELECT path, unnest(string_split(sources_csv, ';')) AS s FROM card_rows) WHERE s <> '' AND s NOT LIKE 'http%' AND s NOT IN (SELECT path FROM card_rows)) SELECT path, unnest(list_filter([CASE WHEN title = '' THEN 'missing title|1' END, 'no heading|1', 'dangling links|1', CASE WHEN path IN (SELECT path FROM miss) THEN 'missing sources|1' END, 'uncited paragraphs|1'], lambda x: x IS NOT NULL)) AS issue FROM card_rows WHERE path LIKE 'wiki/%'""")
def synthesis_issues(t: Tables) -> DataFrame:
    body = F.concat(F.lit("See [[no such page]] first.\n\nThis paragraph makes a claim at some length without any citation.\n\nProof that this long paragraph of a derivation needs none of them.\n\n<!-- hidden paragraph that is long enough to count if it were seen -->"))
    docs = t.cards.filter(F.col("path").startswith("wiki/")).withColumn("body", body).withColumn("type", F.lit(""))
    return qu.synthesis_issues(docs, _files(t)).select("path", F.concat_ws("|", "issue", F.col("n").cast("string")).alias("issue"))


# Lines of whole texts stand as paragraphs; a hidden copy follows, and every second text cites a page that is none.
SYNTHESIS = r"""c AS (SELECT path, title, sources_csv, doc_id % 2 = 0 AS cites, replace(d.text, chr(10), chr(10) || chr(10)) AS text FROM card_rows c JOIN documents d USING (doc_id) WHERE path LIKE 'wiki/%' AND d.text IS NOT NULL),
para AS (SELECT path, regexp_replace(unnest(regexp_split_to_array(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '\n\n+')), '^\s+|\s+$', '', 'g') AS p FROM c),
bare AS (SELECT path, count(*) AS n FROM para WHERE length(p) >= 50 AND NOT regexp_matches(p, '^(#|\||>|- |\* )') AND NOT (contains(p, '$$') OR contains(p, '\begin{') OR contains(p, '\int') OR contains(p, '\sum')) AND NOT contains(p, '[[') AND NOT contains(p, '](')
  AND regexp_replace(lower(regexp_extract(p, '^\S*')), '^[.,:;()]+|[.,:;()]+$', '', 'g') NOT IN (DERIVATION) GROUP BY path),
lost AS (SELECT path, count(*) AS n FROM (SELECT path, unnest(string_split(sources_csv, ';')) AS s FROM c) WHERE s <> '' AND s NOT LIKE 'http%' AND s NOT IN (SELECT path FROM card_rows) GROUP BY path)
SELECT path, 'missing title|1' AS issue FROM c WHERE title = '' UNION ALL SELECT path, 'no heading|1' FROM c WHERE NOT regexp_matches(text, '(^|\n)# ') UNION ALL SELECT path, CASE WHEN cites THEN 'dangling links|1' ELSE 'no citations|1' END FROM c
UNION ALL SELECT path, 'missing sources|' || CAST(n AS STRING) FROM lost UNION ALL SELECT path, 'uncited paragraphs|' || CAST(n AS STRING) FROM bare"""


@query("Q16", "WITH " + SYNTHESIS.replace("DERIVATION", ", ".join(f"'{w}'" for w in qu.DERIVATION_WORDS)))
def synthesis_of_texts(t: Tables) -> DataFrame:
    """Whole texts as syntheses; what a comment hides counts for nothing."""
    paragraphs = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    cited = F.when(F.col("doc_id") % 2 == 0, "\n\nSee [[no such page]].").otherwise("")
    text = t.documents.filter("text IS NOT NULL").select("doc_id", F.concat(paragraphs, cited, F.lit("\n\n<!-- "), F.replace(paragraphs, F.lit("--"), F.lit("")), F.lit(" -->")).alias("body"))
    docs = t.cards.filter(F.col("path").startswith("wiki/")).drop("body").join(text, "doc_id").withColumn("type", F.lit(""))
    return qu.synthesis_issues(docs, _files(t)).select("path", F.concat_ws("|", "issue", F.col("n").cast("string")).alias("issue"))


@query("J26", """WITH p AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS para FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
h AS (SELECT doc_id, count(*) AS n FROM p WHERE regexp_matches(para, '(?i)(^|[^A-Za-z0-9_])(nicht|elle)($|[^A-Za-z0-9_])') GROUP BY doc_id) SELECT doc_id FROM h""")
def concept_context(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))
    return qu.concept_context(docs, ["elle", "nicht"]).select("doc_id").distinct()


# ------------------------------------------------------------------ tags and listings

@query("A4 S16", "SELECT kind, term, count(*) AS files FROM (SELECT 'tag' AS kind, path, unnest(string_split(tags_csv, ';')) AS term FROM card_rows UNION ALL SELECT 'alias', path, aliases_csv FROM card_rows WHERE aliases_csv <> '') GROUP BY ALL")
def tag_index_counts(t: Tables) -> DataFrame:
    return qu.tag_index_counts(qu.tag_index(t.cards))


@query("A5", "SELECT DISTINCT CASE tag WHEN 'en' THEN 'english' WHEN 'src3' THEN 'english' ELSE tag END AS tag FROM (SELECT unnest(string_split(tags_csv, ';')) AS tag FROM card_rows) WHERE tag <> 'src4'")
def canonical_tags(t: Tables) -> DataFrame:
    mapping = t.spark.createDataFrame([("en", "english"), ("src3", "english"), ("src4", "")], "tag string, canonical string")
    return qu.canonical_tags(t.cards, mapping)


@query("A5", "SELECT path, list_reduce(list_distinct(list_filter(list_transform(string_split(tags_csv, ';'), lambda x: CASE x WHEN 'en' THEN 'english' WHEN 'src3' THEN 'english' ELSE x END), lambda x: x <> 'src4')).list_sort(), lambda a, b: a || ';' || b) AS tags FROM card_rows")
def mapped_tags(t: Tables) -> DataFrame:
    mapping = t.spark.createDataFrame([("en", "english"), ("src3", "english"), ("src4", "")], "tag string, canonical string")
    return qu.mapped_tags(t.cards, mapping).select("path", F.array_join(F.array_sort("tags"), ";").alias("tags"))


@query("A38", "SELECT regexp_replace(path, '/[^/]*$', '') AS folder, CASE WHEN category <> '' THEN category WHEN type <> '' THEN type ELSE 'Uncategorized' END AS category, count(*) AS files, max(coalesce(updated, '2024-01-01')) AS updated FROM card_rows GROUP BY 1, 2")
def folder_digest(t: Tables) -> DataFrame:
    return qu.folder_digest(t.cards)
