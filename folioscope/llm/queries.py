"""Registered queries of the operators, each over its whole table, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, chat, decontaminate, licenses, lines, minhash, packing, quality_fm, repair, sharding, substrings, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]

#: Longest run of rows handed to a Python task at once, so that long texts stay within its memory.
ARROW_ROWS = "512"


def ranks_path() -> str:
    """The rank file of the byte-level vocabulary `byte_bpe_50k.json`."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces_path() -> str:
    """The sentence-piece model `piece_bpe_32k.model`."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, root: str) -> DataFrame:
    def whole(x):
        """floor(64 x); from 2^53 on a double is whole, and `floor` would stop at the largest long."""
        y = F.lit(64.0) * x.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    fine = F.transform("embedding", lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), whole(x)))
    vectors = table(spark, root, "embeddings").select(F.col("vec_id").cast("long").alias("id"), fine.alias("vector"))
    return topk.top_k(vectors, vectors.where("id % 20 = 0"), 20)


def op2_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"), ranks_path()).drop("ids")


def op3_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.toxicity(table(spark, root, "documents"), table(spark, root, "labels"))


def op4_minhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, root, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """One row per contaminated document: the items it holds and where the first of them stands."""
    found = decontaminate.contaminated(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count_distinct("item_id").alias("n_items"),
                                       F.min("start").alias("first_start"), F.max(F.round(F.col("matched") / F.col("item_words"), 6)).alias("best_share"))


def op6_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    return quality_fm.quality(table(spark, root, "documents"), table(spark, root, "labels"))


def op7_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    return substrings.without_repeats(table(spark, root, "documents")).drop("text")


def op8_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    return lines.drop_recurring_lines(table(spark, root, "documents"), every_line=True).select("doc_id", "text", "n_lines", "n_dropped")


def op9_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.segments(rows.unionByName(own))).drop("refused_at")


def op10_sharding(spark: SparkSession, root: str) -> DataFrame:
    rows = sharding.shuffle_to_shards(spark, f"{root}/documents.parquet", 40)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_alignment(spark: SparkSession, root: str) -> DataFrame:
    return alignment.alignment(table(spark, root, "documents"), ranks_path(), pieces_path())


def op12_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return licenses.license_scan(table(spark, root, "documents"))


def op13_conversation_repair(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "conversations")
    return repair.repair_figures(rows, repair.damaged(rows))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_exact_topk, op2_packing, op3_toxicity, op4_minhash_near_dedup, op5_benchmark_decontamination, op6_quality_classifier,
    op7_substring_dedup, op8_line_dedup, op9_chat_formatting, op10_sharding, op11_alignment, op12_license_scan, op13_conversation_repair)}

WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op4_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) END) AS s FROM w),
        u AS (SELECT doc_id, unnest(s) AS g FROM s),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op7_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM w WHERE len(w) >= 20),
        k AS (SELECT doc_id, s, sha256(list_aggregate(w[s:s+19], 'string_agg', ' ')) AS k FROM p),
        r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM k),
        g AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 20)))) AS gone FROM r WHERE n > 1 GROUP BY doc_id),
        x AS (SELECT w.doc_id, w.w, coalesce(list_transform(range(1, len(w.w) + 1), lambda i: CASE WHEN list_contains(g.gone, i) THEN NULL ELSE w.w[i] END), []) AS kept, g.gone FROM w LEFT JOIN g USING (doc_id)),
        y AS (SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN gone IS NULL THEN w ELSE list_filter(kept, lambda t: t IS NOT NULL) END AS kept FROM x)
        SELECT doc_id, n_words, n_words - len(kept) AS n_removed, sha256(coalesce(list_aggregate(kept, 'string_agg', ' '), '')) AS kept_sha256 FROM y""",
    "op9_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        p AS (SELECT '(\\|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|\[/INST\]|\[INST\]|<</SYS>>|<<SYS>>|</s>|<s>)' AS p),
        t AS (SELECT *, length(regexp_replace(role, p, '\1x', 'g')) + length(regexp_replace(text, p, '\1x', 'g')) + 24 AS n FROM c, p)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (sum(n) + 7)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op12_license_scan": f"""
        WITH w AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        t AS (SELECT *, list_distinct(s) AS d, (2 ** ceil(log2(len(s))))::BIGINT AS half, CASE WHEN phrase THEN len(list_distinct(s)) ELSE ceil({licenses.THRESHOLD}::DOUBLE * len(list_distinct(s))) END AS needed
              FROM (VALUES {", ".join(f"('{t.label}', {t.phrase}, {licenses.template_words(t.text)})" for t in licenses.TEMPLATES)}) AS v(label, phrase, s)),
        b AS (SELECT id, w, t.*, unnest(range(0, len(w) // half + 1)) AS k FROM w, t WHERE NOT phrase AND len(list_intersect(w, d)) >= needed),
        f AS (SELECT id, label, FALSE AS phrase, len(list_intersect(list_distinct(w[k * half + 1:(k + 2) * half]), d)) / len(d) AS share, []::BIGINT[] AS places
              FROM b WHERE len(list_intersect(list_distinct(w[k * half + 1:(k + 2) * half]), d)) >= needed
              UNION ALL SELECT id, label, TRUE, 1.0, list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(s)] = s) FROM w, t WHERE phrase AND list_has_all(w, s)),
        g AS (SELECT * FROM f WHERE NOT phrase OR len(places) > 0),
        r AS (SELECT id, sum(len(places)) AS n, min(list_min(places)) AS a, max(list_max(places)) AS z, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base, string_agg(DISTINCT label, ',' ORDER BY label) AS every,
                     max(share) AS score, max({{'s': share, 'p': phrase, 'l': label}}).l AS best FROM g GROUP BY id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a AS first_word, z AS last_word, coalesce(base, '') AS base_labels, coalesce(every, '') AS labels, coalesce(score, 0.0) AS score, best AS best_label
        FROM w LEFT JOIN r USING (id)""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        c AS (SELECT *, xor(list_reduce([4294967295] || list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT),
                  lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS c FROM k),
        d AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN c = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE c <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
        e AS (SELECT conv_id, turn, n, role, text, left(role, 1) AS i, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS pair,
                     CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
                          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM o),
        p(a, b, paid, edit, said) AS (VALUES (0, 0, 0, '', NULL), (1, 1, 0, '', NULL), (2, 2, 0, '', NULL), (3, 3, 0, '', NULL), (0, 2, 2, 'I', 'user:'), (1, 2, 2, 'I', 'user:'), (2, 3, 2, 'I', 'assistant:'), (3, 2, 2, 'I', 'user:')),
        q(b, z, i, paid, edit, role) AS (VALUES (0, 1, 's', 0, 'K', NULL), (0, 2, 'u', 0, 'K', NULL), (1, 2, 'u', 0, 'K', NULL), (2, 3, 'a', 0, 'K', NULL), (3, 2, 'u', 0, 'K', NULL),
            (0, 2, NULL, 2, 'R', 'user'), (1, 2, NULL, 2, 'R', 'user'), (2, 3, NULL, 2, 'R', 'assistant'), (3, 2, NULL, 2, 'R', 'user'), (0, 0, NULL, 3, 'D', NULL), (1, 1, NULL, 3, 'D', NULL), (2, 2, NULL, 3, 'D', NULL), (3, 3, NULL, 3, 'D', NULL)),
        r(conv_id, n, z, best) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, {'c': 0, 'a': '', 's': []::VARCHAR[]} FROM o
            UNION ALL SELECT r.conv_id, e.n, q.z, min({'c': (r.best.c + p.paid + q.paid + CASE WHEN e.fault = 't' AND q.edit <> 'D' THEN 1 ELSE 0 END)::INTEGER, 'a': r.best.a || p.edit || q.edit,
                's': r.best.s || CASE WHEN p.said IS NULL THEN [] ELSE [p.said] END || CASE WHEN q.edit = 'D' THEN [] ELSE [coalesce(q.role, e.role) || ':' || e.text] END})
            FROM r JOIN e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.n = r.n + 1 JOIN p ON p.a = r.z JOIN q ON q.b = p.b AND (q.i IS NULL OR q.i = e.i) AND (q.edit = 'D' OR e.fault NOT IN ('b', 'd')) GROUP BY r.conv_id, e.n, q.z),
        l AS (SELECT conv_id, max(n) AS n FROM o GROUP BY conv_id),
        u(z, paid, edit, said) AS (VALUES (0, 0, '', []::VARCHAR[]), (3, 0, '', []), (2, 2, 'I', ['assistant:']), (1, 4, 'II', ['user:', 'assistant:'])),
        v AS (SELECT r.conv_id, min({'c': r.best.c + u.paid, 'a': r.best.a || u.edit, 's': r.best.s || u.said}) AS v FROM r JOIN l ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.n = r.n JOIN u ON u.z = r.z GROUP BY r.conv_id),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                     count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id),
        h AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT h.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(array_to_string(v.s, chr(10)), '')) AS repaired_sha256
        FROM h LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM h.conv_id""",
}
