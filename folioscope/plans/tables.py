"""Domain tables derived from the shared tables by one SQL text per table.

The same text runs on Spark and, as common table expressions, on DuckDB. Every
derived table is a row-by-row rewriting or a plain aggregate of its base table,
so the work of a registered query grows with the data.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
        "pages", "benchmark", "labels", "conversations")

# Event times as whole microseconds, the one place where the engines differ.
CLOCK = {
    "spark": {"ev": "SELECT *, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events",
              "ord": "SELECT *, unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS us FROM orders"},
    "duckdb": {"ev": "SELECT *, epoch_us(ts) AS us FROM events", "ord": "SELECT *, epoch_us(o_orderdate) AS us FROM orders"},
}

P8 = "CASE {0} WHEN 0 THEN 'open' WHEN 1 THEN 'conjectured' WHEN 2 THEN 'testing' WHEN 3 THEN 'supported' WHEN 4 THEN 'refuted' WHEN 5 THEN 'supported' WHEN 6 THEN 'disputed' ELSE 'conflict' END"
Q4 = "CASE {0} WHEN 0 THEN 'open' WHEN 1 THEN 'answered' WHEN 2 THEN 'abandoned' ELSE 'conflict' END"
L6 = "CASE {0} WHEN 0 THEN 'exploring' WHEN 1 THEN 'active' WHEN 2 THEN 'writing' WHEN 3 THEN 'dormant' WHEN 4 THEN 'closed' ELSE 'conflict' END"


def _status(number: str) -> str:
    return (f"CASE WHEN user_id % 10 = 8 THEN {Q4.format(f'({number}) % 4')} WHEN user_id % 10 = 9 THEN {L6.format(f'({number}) % 6')} "
            f"ELSE {P8.format(f'({number}) % 8')} END")


DERIVED = {
    # ---- notes and posts: a user is a note, an event is a post
    "post_rows": f"""
SELECT event_id AS seq, 'n-' || CAST(user_id AS STRING) AS slug, us - us % 1000000 AS at_us,
  CASE event_type WHEN 'click' THEN 'alpha' WHEN 'view' THEN 'beta' WHEN 'error' THEN 'reviewer' WHEN 'purchase' THEN 'human' ELSE 'gamma' END AS host,
  CASE WHEN user_id % 2 = 0 THEN 'n-9' END AS line,
  CASE WHEN event_id % 3 <> 0 THEN {_status('event_id')} END AS src,
  CASE WHEN event_id % 3 <> 0 THEN {_status('CAST(floor(value) AS BIGINT)')} END AS dst,
  CASE WHEN event_id % 3 = 0 AND event_type = 'purchase' THEN 'bet' WHEN event_id % 3 = 0 AND event_type = 'signup' THEN 'evidence' END AS field,
  CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'VERDICT: stands · cheap tier' WHEN 1 THEN 'VERDICT: refuted · strong tier'
      WHEN 2 THEN 'VERDICT: restate' WHEN 3 THEN 'VERDICT: stands · strong tier' ELSE 'no verdict here' END
    WHEN event_id % 13 = 0 THEN 'see /tmp/run-' || CAST(event_id % 10 AS STRING) || '/out.txt.' WHEN event_id % 17 = 0 THEN 'in my Scratchpad' ELSE 'noted' END AS text
FROM ev""",
    "note_rows": """
SELECT user_id, 'n-' || CAST(user_id AS STRING) AS slug,
  CASE WHEN user_id % 10 = 8 THEN 'question' WHEN user_id % 10 = 9 THEN 'line' ELSE 'proposition' END AS kind,
  CASE WHEN user_id % 10 < 8 AND user_id % 4 = 0 THEN 'supported' WHEN user_id % 10 < 8 AND user_id % 4 = 1 THEN 'testing'
    WHEN user_id % 10 = 9 AND user_id % 4 = 1 THEN 'active' WHEN user_id % 23 = 0 THEN 'bogus'
    ELSE CASE WHEN user_id % 10 = 8 THEN 'open' WHEN user_id % 10 = 9 THEN 'exploring' WHEN user_id % 3 = 0 THEN 'refuted' WHEN user_id % 3 = 1 THEN 'disputed' ELSE 'conjectured' END END AS status,
  CASE WHEN user_id % 31 = 0 THEN '' ELSE 'what note ' || CAST(user_id AS STRING) || ' is for' END AS purpose,
  CASE WHEN user_id % 10 = 9 THEN '' WHEN user_id % 6 = 0 THEN '' WHEN user_id % 6 = 1 THEN 'n-9;n-19' ELSE 'n-' || CAST(user_id - user_id % 10 + 9 AS STRING) END AS lines_csv,
  CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'supported' WHEN 2 THEN 'refuted' WHEN 3 THEN 'unknown' ELSE 'maybe' END AS bet,
  CASE user_id % 7 WHEN 0 THEN '2024-01-15' WHEN 1 THEN 'yes' ELSE NULL END AS found,
  CASE user_id % 9 WHEN 0 THEN 'new-method' WHEN 1 THEN 'magic' ELSE NULL END AS key_move,
  'drafts/d-' || CAST(user_id % 40 AS STRING) || CASE WHEN user_id % 3 = 0 THEN ';tools/check-' || CAST(user_id AS STRING) ELSE '' END AS derivation_csv,
  'tools/run-' || CAST(user_id % 12 AS STRING) || '.py' AS evidence_csv,
  MIN(us) AS first_us, MAX(us) - (user_id % 5) * 86400000000 AS mtime_us
FROM ev GROUP BY user_id""",
    "draft_rows": """
SELECT 'drafts/d-' || CAST(user_id AS STRING) || '.md' AS path, MAX(us) + (user_id % 3 - 1) * 3600000000 AS mtime_us FROM ev GROUP BY user_id""",
    # ---- calls, spawns, sessions
    "call_rows": """
SELECT event_id AS seq, us AS at_us, event_type AS kind, CASE user_id % 3 WHEN 0 THEN 'cheap' WHEN 1 THEN 'strong' ELSE 'default' END AS tier, value > 5 AS ok FROM ev""",
    "session_rows": """
SELECT 'h' || CAST(user_id % 3 AS STRING) AS host, CAST(user_id AS STRING) || '@' || CAST((us - us % 86400000000) AS STRING) AS session_id,
  MIN(us - us % 1000000) AS lo_us, MIN(us - us % 1000000) + (MAX(us - us % 1000000) - MIN(us - us % 1000000)) / 24 - ((MAX(us - us % 1000000) - MIN(us - us % 1000000)) / 24) % 1000000 AS hi_us
FROM ev GROUP BY user_id, us - us % 86400000000""",
    "sighting_rows": """
SELECT event_type || '-' || CAST(user_id % 7 AS STRING) AS pattern, CAST(user_id AS STRING) || '/' || CAST(event_id % 50 AS STRING) AS session,
  'h' || CAST(user_id % 3 AS STRING) AS host, us - us % 86400000000 AS day_us, 'title ' || CAST(event_id AS STRING) AS title, props AS body FROM ev""",
    "proposal_rows": """
SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'proposal' ELSE 'verdict' END AS kind, 'q-' || CAST(user_id AS STRING) || '-' || CAST(event_id % 3 AS STRING) AS id, us AS at_us,
  CASE event_type WHEN 'click' THEN 'rule' WHEN 'view' THEN 'patch' WHEN 'error' THEN 'skill' ELSE 'fact' END AS proposal_kind,
  'docs/' || CAST(user_id % 9 AS STRING) || '.md' AS target, 'Change  the ' || event_type || ' step' || CASE WHEN event_id % 2 = 0 THEN '.' ELSE '' END AS text,
  event_type || '-' || CAST(user_id % 7 AS STRING) AS pattern, CASE event_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'retired' END AS verdict, props AS note FROM ev""",
    # ---- discovery
    "candidate_rows": """
SELECT 'o-' || CAST(o_custkey AS STRING) AS id, CASE WHEN o_orderkey % 3 = 0 THEN '2401.' || lpad(CAST(o_custkey % 90000 AS STRING), 5, '0') END AS arxiv_id, o_orderkey AS pos,
  CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 's2-recommendation' ELSE 'arxiv-new:' || o_orderpriority END AS source,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS score, o_orderkey % 3 AS feed FROM orders""",
    "triage_rows": """
SELECT event_id AS seq, 'report-' || CAST(user_id % 6 AS STRING) AS report, 'c-' || CAST(user_id AS STRING) AS id,
  CASE event_type WHEN 'error' THEN 'reset' WHEN 'click' THEN 'accept' WHEN 'view' THEN 'dismiss' ELSE 'later' END AS decision, us AS at_us FROM ev""",
    "reference_rows": "SELECT DISTINCT l_orderkey AS paper_id, l_partkey AS cited_id FROM lineitem",
    # Papers that cite the same parts are rare; works of 500 kinds give papers with much in common.
    "cited_rows": "SELECT DISTINCT l_orderkey AS paper_id, l_partkey % 500 AS cited_id FROM lineitem",
    # ---- intake
    "item_rows": "SELECT p_partkey AS itemID, p_partkey % 5 AS itemTypeID, 'K' || CAST(p_partkey AS STRING) AS key, p_size AS added FROM part",
    "value_rows": """
SELECT p_partkey * 10 + 1 AS valueID, p_partkey AS itemID, 1 AS fieldID, p_name AS value FROM part
UNION ALL SELECT p_partkey * 10 + 2, p_partkey, 2, CASE WHEN p_partkey % 4 = 0 THEN '10.48550/arXiv.2405.' || lpad(CAST(p_partkey % 90000 AS STRING), 5, '0') ELSE '10.1000/' || p_brand END FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey * 10 + 3, p_partkey, 3, 'https://arxiv.org/abs/2301.' || lpad(CAST(p_partkey % 90000 AS STRING), 5, '0') || 'v2' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey * 10 + 6, p_partkey, 6, CAST(1990 + p_size AS STRING) FROM part""",
    "attachment_rows": """
SELECT l_orderkey * 10 + l_linenumber AS itemID, l_partkey AS parentItemID, CASE l_linenumber % 3 WHEN 0 THEN 'text/html' ELSE 'application/pdf' END AS contentType,
  CASE WHEN l_linenumber % 4 = 0 THEN 'storage:undefined' WHEN l_linenumber % 5 = 0 THEN '/linked/file.pdf' ELSE 'storage:p' || CAST(l_orderkey AS STRING) || '.pdf' END AS path FROM lineitem""",
    "batch_rows": """
SELECT event_id AS seq, 'batch-' || CAST(user_id % 9 AS STRING) AS batch, 'i-' || CAST(user_id AS STRING) AS item_id,
  CASE WHEN event_id % 4 = 0 THEN 'item' WHEN event_id % 4 = 1 THEN 'commit' ELSE 'decision' END AS kind, 'r-' || CAST(event_id AS STRING) AS req_id,
  CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' ELSE 'reset' END AS decision, 'raw/papers/' || CAST(event_id AS STRING) || '.md' AS committed_path,
  CASE WHEN value > 60 THEN 'failed' END AS error, CAST(floor(value) AS BIGINT) % 4 AS n_flags FROM ev""",
    "queue_rows": """
SELECT event_id AS seq, 'r-' || CAST(event_id AS STRING) AS req_id, CASE WHEN user_id % 2 = 0 THEN 'arxiv' ELSE 'doi' END AS source_type, 'v-' || CAST(user_id AS STRING) || '-' || event_type AS value,
  CASE WHEN event_id % 19 = 0 THEN 'r-0' END AS retry_of FROM ev""",
    # ---- corpus
    "card_rows": """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'wiki/concepts/c-' WHEN 1 THEN 'wiki/references/r-' WHEN 2 THEN 'wiki/topics/t-' WHEN 3 THEN 'raw/papers/p-' ELSE 'drafts/d-' END || CAST(doc_id AS STRING) || '.md' AS path,
  CASE WHEN doc_id % 41 = 0 THEN '' ELSE 'Card ' || CAST(doc_id AS STRING) END AS title,
  CASE doc_id % 5 WHEN 0 THEN 'concept' WHEN 1 THEN 'reference' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'concept' ELSE 'topic' END ELSE '' END AS category,
  CASE WHEN doc_id % 5 = 3 THEN CASE WHEN doc_id % 4 = 0 THEN 'articles' ELSE 'papers' END ELSE '' END AS type,
  lang || CASE WHEN doc_id % 3 = 0 THEN ';' || source ELSE '' END AS tags_csv,
  CASE WHEN doc_id % 4 = 0 THEN 'alias ' || CAST(doc_id % 97 AS STRING) ELSE '' END AS aliases_csv,
  CASE WHEN doc_id % 5 = 1 AND doc_id % 3 <> 1 THEN 'raw/papers/p-' || CAST(doc_id + 2 AS STRING) || '.md' WHEN doc_id % 5 = 0 AND doc_id % 4 = 1 THEN 'p-' || CAST(doc_id + 8 AS STRING) || ';https://example.org/x'
    WHEN doc_id % 10 = 2 THEN 'raw/none-' || CAST(doc_id AS STRING) || '.md' ELSE '' END AS sources_csv,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE '2024-0' || CAST(1 + doc_id % 9 AS STRING) || '-1' || CAST(doc_id % 10 AS STRING) END AS updated,
  CASE doc_id % 4 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' WHEN 2 THEN 'cold' ELSE NULL END AS volatility,
  CASE WHEN doc_id % 8 = 0 THEN 'sure' ELSE 'high' END AS confidence, CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END AS summary, text AS body FROM documents""",
    "chunk_rows": """
SELECT source AS library, doc_id AS id, lang || '/doc-' || CAST(doc_id AS STRING) || '.md' AS path, CASE lang WHEN 'fr' THEN 'threads' ELSE lang END AS collection, text FROM documents""",
    "claim_rows": """
SELECT doc_id, 'wiki/concepts/c-' || CAST(doc_id % 50 AS STRING) || '.md' AS doc_path, 'claim ' || CAST(doc_id AS STRING) AS claim,
  CASE doc_id % 4 WHEN 0 THEN substr(text, CAST(floor(length(text) * (doc_id % 7) / 9.0) AS INT) + 1, 60) WHEN 1 THEN replace(replace(substr(text, CAST(floor(length(text) * (doc_id % 7) / 9.0) AS INT) + 1, 60), 'e', 'E'), 'n', 'N') WHEN 2 THEN replace(substr(text, CAST(floor(length(text) * (doc_id % 7) / 9.0) AS INT) + 1, 60), ' ', '  ') ELSE 'made up ' || CAST(doc_id AS STRING) END AS evidence,
  CASE WHEN doc_id % 13 = 0 THEN 'web' WHEN doc_id % 17 = 0 THEN 'other' ELSE 'local_wiki' END AS source_type,
  CASE WHEN doc_id % 13 = 0 THEN 'https://example.org/' || CAST(doc_id AS STRING) WHEN doc_id % 11 = 0 THEN '../secret.md' WHEN doc_id % 7 = 0 THEN 'wiki/references/r-' || CAST(doc_id AS STRING) || '.md' ELSE 'raw/doc-' || CAST(doc_id AS STRING) || '.md' END AS source
FROM documents""",
    "conversion_rows": """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'tex' ELSE 'textlayer' END AS route, source, text AS md, CASE WHEN doc_id % 5 = 0 THEN n_chars * 2 WHEN doc_id % 7 = 0 THEN n_chars / 8 - (n_chars / 8) % 1 ELSE n_chars END AS chars,
  CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 0 END AS tables, doc_id % 4 AS figures_referenced, doc_id % 3 AS figures_resolved FROM documents""",
    # ---- graph
    "node_rows": """
SELECT 'region/' || r_name AS id, r_name AS title, 'topic' AS type FROM region
UNION ALL SELECT 'nation/' || n_name, n_name, 'concept' FROM nation
UNION ALL SELECT 'customer/' || CAST(c_custkey AS STRING), c_name, 'reference' FROM customer
UNION ALL SELECT 'supplier/' || CAST(s_suppkey AS STRING), s_name, 'reference' FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT 'part/' || CAST(p_partkey AS STRING), p_name, 'concept' FROM part""",
    "edge_rows": """
SELECT 'nation/' || n_name AS source_id, 'region/' || r_name AS target_id, 'wikilink' AS type FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'customer/' || CAST(c_custkey AS STRING), 'nation/' || n_name, 'wikilink' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'nation/' || n_name, 'supplier/' || CAST(s_suppkey AS STRING), 'supported_by' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'part/' || CAST(l_partkey AS STRING), 'supplier/' || CAST(l_suppkey AS STRING), 'wikilink' FROM lineitem
UNION ALL SELECT 'part/' || CAST(p_partkey AS STRING), 'part/' || CAST(p_partkey AS STRING), 'wikilink' FROM part WHERE p_partkey % 100 = 7""",
    "tag_rows": """
SELECT 'part/' || CAST(p_partkey AS STRING) AS node_id, p_brand AS tag FROM part UNION ALL SELECT 'customer/' || CAST(c_custkey AS STRING), lower(c_mktsegment) FROM customer
UNION ALL SELECT 'part/' || CAST(p_partkey AS STRING), 'skeleton' FROM part WHERE p_partkey % 500 = 11""",
    "alias_rows": "SELECT 'part/' || CAST(p_partkey AS STRING) AS node_id, p_type || '_' || CAST(p_size AS STRING) AS alias FROM part WHERE p_partkey % 4 = 0",
    "stated_rows": """
SELECT 'claim-' || CAST(o_orderkey AS STRING) AS id, 'customer/' || CAST(o_custkey AS STRING) AS doc_id, 'Order ' || o_orderpriority || ' of ' || CAST(o_custkey AS STRING) AS text,
  CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'unverified' ELSE 'web-verified' END AS status FROM orders""",
}


def _expand(names: set[str], dialect: str) -> dict[str, str]:
    """The named derived tables and what they use, in definition order."""
    every = {**CLOCK[dialect], **DERIVED}
    wanted: set[str] = set()
    todo = set(names)
    while todo:
        name = todo.pop()
        if name in every and name not in wanted:
            wanted.add(name)
            todo |= {w for w in re.findall(r"\b\w+\b", every[name]) if w in every and w not in wanted}
    return {n: sql for n, sql in every.items() if n in wanted}


def with_derived(sql: str) -> str:
    """Oracle SQL with the derived tables it names as leading common table expressions."""
    used = {w for w in re.findall(r"\b\w+\b", sql)}
    ctes = _expand(used, "duckdb")
    if not ctes:
        return sql
    head = ",\n".join(f"{n} AS ({body})" for n, body in ctes.items())
    body = sql.strip()
    if re.match(r"(?i)with recursive\b", body):
        return f"WITH RECURSIVE {head},\n{body[len('with recursive'):]}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {head},\n{body[len('with'):]}"
    return f"WITH {head}\n{body}"


#: What a task reads at most, of files and of a shuffle: its sorts and hash tables follow this, not the table.
PER_TASK = {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}

#: Stored search indexes of this process, by application and data folder.
_INDEXES: dict = {}


class Tables:
    """Base and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for key, value in PER_TASK.items():
            spark.conf.set(key, value)
        self.spark, self.root, self._held = spark, root, {}

    def base(self, name: str) -> DataFrame:
        """A base table; long texts in fewer pieces than there are cores are spread first.

        A table with enough input splits, as any large one has, is not shuffled.
        """
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in ("documents", "pages", "conversations") and df._jdf.rdd().getNumPartitions() < cores:
            df = df.repartition(cores)
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._held:
            if name in BASE:
                self._held[name] = self.base(name)
            else:
                self._held[name] = self._derived({**CLOCK["spark"], **DERIVED}[name], name)
        return self._held[name]

    def _derived(self, sql: str, name: str, **given: DataFrame) -> DataFrame:
        """A derived table from its SQL text, over the tables that it names or the given ones in their place."""
        used = {w for w in re.findall(r"\b\w+\b", sql) if w in BASE or w in DERIVED or w in CLOCK["spark"]} - {name}
        # Names become placeholders so that the views stay private to this query.
        text = re.sub(r"(?i)\b(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)
        inputs = {w: given[w] if w in given else getattr(self, w) for w in used if "{" + w + "}" in text}
        return self.spark.sql(text, **inputs)

    @property
    def edge_rows(self) -> DataFrame:
        """The rows of the SQL text. Parts meet suppliers as numbers, dealt before they are held, so that no task keeps its split as text."""
        if "edge_rows" not in self._held:
            pairs = self.lineitem.select("l_partkey", "l_suppkey").repartition("l_partkey", "l_suppkey").distinct()
            self._held["edge_rows"] = self._derived(DERIVED["edge_rows"].replace("SELECT DISTINCT", "SELECT"), "edge_rows", lineitem=pairs)
        return self._held["edge_rows"]

    # ---- the operators' schemas

    @staticmethod
    def _list(column: str):
        return F.filter(F.split(F.col(column), ";"), lambda x: x != "")

    @property
    def posts(self) -> DataFrame:
        return self.post_rows.withColumn("at", F.timestamp_micros("at_us")).withColumn("via", F.lit(None).cast("string")).withColumn("value", F.lit(None).cast("string"))

    @property
    def notes(self) -> DataFrame:
        return self.note_rows.select(
            "slug", "kind", "status", F.to_date(F.timestamp_micros("first_us")).alias("created"), "purpose", self._list("lines_csv").alias("lines"),
            "bet", "found", F.concat(F.lit("claim of "), "slug").alias("claim"), "key_move", F.array().cast("array<string>").alias("depends_on"),
            F.array().cast("array<string>").alias("answers"), self._list("derivation_csv").alias("derivation"), self._list("evidence_csv").alias("evidence"),
            F.timestamp_micros("mtime_us").alias("mtime"))

    @property
    def drafts(self) -> DataFrame:
        return self.draft_rows.select("path", F.timestamp_micros("mtime_us").alias("mtime"))

    @property
    def calls(self) -> DataFrame:
        return self.call_rows.withColumn("at", F.timestamp_micros("at_us"))

    @property
    def sessions(self) -> DataFrame:
        return self.session_rows.select("host", "session_id", F.timestamp_micros(F.col("lo_us").cast("long")).alias("started"),
                                        F.timestamp_micros(F.col("hi_us").cast("long")).alias("ended"))

    @property
    def sightings(self) -> DataFrame:
        return self.sighting_rows.withColumn("day", F.to_date(F.timestamp_micros("day_us")))

    @property
    def proposals(self) -> DataFrame:
        return self.proposal_rows.withColumn("at", F.timestamp_micros("at_us"))

    @property
    def cards(self) -> DataFrame:
        from ..operators.corpus import collection_of
        return self.card_rows.select(
            "doc_id", "path", "title", "category", "type", self._list("tags_csv").alias("tags"), self._list("aliases_csv").alias("aliases"),
            self._list("sources_csv").alias("sources"), "updated", F.lit(None).cast("string").alias("verified"), F.lit("2024-01-01").alias("created"),
            "volatility", "confidence", "summary", "body", collection_of(F.col("path")).alias("collection"), F.lit(False).alias("pinned"))

    @property
    def chunks(self) -> DataFrame:
        from ..operators.corpus import sections
        cut = sections(self.chunk_rows.withColumnRenamed("id", "doc"), "text")
        return cut.select("library", (F.col("doc") * 1_000_000 + F.col("start_line")).alias("id"), "path", "collection", "heading", "start_line", "end_line", "content")

    @property
    def search_index(self):
        """The stored index of `chunks`, written once for a session and folder."""
        from ..session import work_dir
        from ..sources import search_index
        key = (self.spark.sparkContext.applicationId, self.root)
        if key not in _INDEXES:
            _INDEXES[key] = search_index.write_index(self.chunks, f"{work_dir(self.spark)}/search-{uuid.uuid4().hex}", buckets=16)
        return _INDEXES[key]

    @property
    def nodes(self) -> DataFrame:
        blank = F.lit("")
        return self.node_rows.select("id", F.concat("id", F.lit(".md")).alias("path"), "title", "type", blank.alias("category"), blank.alias("summary"),
                                     blank.alias("created"), blank.alias("updated"))

    @property
    def batch_events(self) -> DataFrame:
        flag = F.struct(F.lit("x").alias("code"), F.lit("").alias("detail"), F.lit("flag").alias("severity"))
        info = F.struct(F.lit("y").alias("code"), F.lit("").alias("detail"), F.lit("info").alias("severity"))
        return self.batch_rows.withColumn("findings", F.concat(F.array_repeat(flag, F.col("n_flags").cast("int")), F.array(info)))

    @property
    def item_tables(self) -> dict[str, DataFrame]:
        types = self.spark.createDataFrame([(0, "journalArticle"), (1, "book"), (2, "attachment"), (3, "note"), (4, "preprint")], "itemTypeID bigint, typeName string")
        fields = self.spark.createDataFrame([(1, "title"), (2, "DOI"), (3, "url"), (4, "extra"), (5, "archiveID"), (6, "date")], "fieldID int, fieldName string")
        return {"items": self.item_rows, "itemTypes": types, "itemData": self.value_rows.select("itemID", "fieldID", "valueID"),
                "fieldsCombined": fields, "itemDataValues": self.value_rows.select("valueID", "value")}
