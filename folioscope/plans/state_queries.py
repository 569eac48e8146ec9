"""Notes, posts, sessions, patterns, proposals, call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab
from ..functions.dates import parse_at, week_of
from ..operators import intake as it, reflect as rf, state as st
from .registry import query
from .tables import Tables

NOW = "2024-02-05 00:00:00"
NOW_US = 1707091200000000
TODAY = "2024-02-05"


def _legal() -> str:
    rows = [f"('{k}', '{s}', '{d}', {'true' if d != 'conflict' and (s in vocab.HUMAN_SOURCES or (k, d) in vocab.HUMAN_TARGETS) else 'false'})"
            for k, table in vocab.MOVES.items() for s, targets in table.items() for d in dict.fromkeys(targets + ("conflict",))]
    return f"(VALUES {', '.join(rows)}) legal(kind, src, dst, human_only)"


def _inlist(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


STATUS = " OR ".join(f"(kind = '{k}' AND {{0}} IN {_inlist(v)})" for k, v in vocab.STATUSES.items())
INITIAL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.INITIAL.items()) + " ELSE '' END"
MOVES = "moves AS (SELECT * FROM post_rows WHERE src IS NOT NULL AND dst IS NOT NULL)"


@query("W4 A24", f"WITH {MOVES} SELECT slug, arg_max(dst, seq) AS status FROM moves GROUP BY slug")
def current_status(t: Tables) -> DataFrame:
    return st.current_status(t.posts)


CHAIN = f"""{MOVES},
s AS (SELECT m.slug, m.seq, m.src, m.dst, n.kind, lag(m.dst) OVER (PARTITION BY m.slug ORDER BY m.seq) AS prev FROM moves m JOIN note_rows n USING (slug)),
j AS (SELECT s.*, legal.kind IS NOT NULL OR (s.src = s.dst AND ({STATUS.format('s.src').replace('kind', 's.kind')})) AS ok FROM s LEFT JOIN {_legal()} ON legal.kind = s.kind AND legal.src = s.src AND legal.dst = s.dst),
e AS (SELECT slug, arg_max(dst, seq) AS fin FROM moves GROUP BY slug),
chain AS (SELECT slug, CASE WHEN prev IS NOT NULL AND prev <> src THEN 'starts elsewhere' ELSE 'illegal transition' END AS issue, seq, src || ' -> ' || dst AS detail FROM j WHERE (prev IS NOT NULL AND prev <> src) OR NOT ok
UNION ALL SELECT slug, 'no post records the status', NULL, status FROM note_rows n LEFT JOIN e USING (slug) WHERE fin IS NULL AND status <> {INITIAL}
UNION ALL SELECT slug, 'status differs from history', NULL, status FROM note_rows JOIN e USING (slug) WHERE fin <> status)"""


@query("W5 C36", f"WITH {CHAIN} SELECT * FROM chain")
def chain_issues(t: Tables) -> DataFrame:
    return st.chain_issues(t.notes, t.posts)


@query("C36", f"SELECT kind, src, dst, human_only FROM {_legal()}, (SELECT count(*) AS n FROM events) e WHERE n > 0 AND EXISTS (SELECT 1 FROM post_rows p JOIN note_rows n USING (slug) WHERE n.kind = legal.kind AND p.src = legal.src AND p.dst = legal.dst)")
def legal_moves_used(t: Tables) -> DataFrame:
    used = st.moves(t.posts).join(t.notes.select("slug", "kind"), "slug").select("kind", "src", "dst").distinct()
    return used.join(F.broadcast(vocab.transitions(t.spark)), ["kind", "src", "dst"]).select("kind", "src", "dst", "human_only")


@query("W3", f"""WITH {MOVES},
x AS (SELECT slug, max(at_us) AS resolved FROM moves WHERE src = 'conflict' GROUP BY slug),
l AS (SELECT m.* FROM moves m JOIN note_rows n USING (slug) LEFT JOIN x USING (slug) WHERE n.status <> 'conflict' AND (resolved IS NULL OR at_us > resolved)),
p AS (SELECT *, lag(seq) OVER w AS first_seq, lag(host) OVER w AS first_host, lag(dst) OVER w AS first_dst, lag(at_us) OVER w AS prev_us FROM l WINDOW w AS (PARTITION BY slug ORDER BY seq)),
c AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY seq) AS r FROM p WHERE first_host <> host AND first_host <> 'reviewer' AND host <> 'reviewer' AND abs(at_us - prev_us) <= 21600000000)
SELECT slug, first_seq, seq AS second_seq, first_host, host AS second_host, first_dst, dst AS second_dst FROM c WHERE r = 1""")
def host_conflicts(t: Tables) -> DataFrame:
    return st.conflicts(t.notes, t.posts, seconds=21600)


MARKS = """m AS (SELECT slug, max(seq) FILTER (src IS NOT NULL AND dst = 'supported') AS claimed, arg_max(host, seq) FILTER (src IS NOT NULL AND dst = 'supported') AS author,
  max(seq) FILTER (host = 'reviewer' AND (text LIKE 'VERDICT: stands%' OR text LIKE 'VERDICT: refuted%')) AS answered,
  max(seq) FILTER (host = 'reviewer' AND (text LIKE 'VERDICT: stands%' OR text LIKE 'VERDICT: refuted%') AND text NOT LIKE '%cheap tier') AS strongly,
  arg_max(host, seq) AS h, arg_max(text, seq) AS x, max(seq) AS last FROM post_rows GROUP BY slug)"""


@query("W6", f"WITH {MARKS} SELECT slug FROM note_rows LEFT JOIN m USING (slug) WHERE kind = 'proposition' AND status = 'supported' AND (answered IS NULL OR answered < claimed)")
def awaiting_review(t: Tables) -> DataFrame:
    return st.awaiting_review(t.notes, t.posts)


@query("W7", f"""WITH {MARKS}, a AS (SELECT p.slug, bool_and(text LIKE '%cheap tier') AS weak FROM post_rows p JOIN m USING (slug)
  WHERE p.seq > coalesce(claimed, -1) AND host = 'reviewer' AND (text LIKE 'VERDICT: stands%' OR text LIKE 'VERDICT: refuted%') GROUP BY p.slug)
SELECT slug FROM note_rows JOIN a USING (slug) WHERE kind = 'proposition' AND status = 'supported' AND weak""")
def weakly_reviewed(t: Tables) -> DataFrame:
    return st.weakly_reviewed(t.notes, t.posts)


@query("W8", f"""WITH {MARKS} SELECT n.slug FROM note_rows n JOIN m USING (slug) JOIN post_rows p ON p.seq = m.last
WHERE kind = 'proposition' AND status = 'testing' AND p.src IS NOT NULL AND p.dst = 'testing' AND p.host = 'reviewer' AND p.text = 'VERDICT: restate'""")
def sent_back(t: Tables) -> DataFrame:
    return st.restating(t.notes, t.posts)


@query("W18", f"WITH {MARKS} SELECT slug, author FROM m WHERE author IN ('alpha', 'beta')")
def claim_authors(t: Tables) -> DataFrame:
    return st.authors(t.posts, ["alpha", "beta"])


@query("W17 W10", """WITH w AS (SELECT slug, max(at_us) AS since FROM post_rows GROUP BY slug),
o AS (SELECT slug, since, unnest(string_split(CASE WHEN lines_csv = '' THEN '(unlined)' ELSE lines_csv END, ';')) AS line FROM note_rows JOIN w USING (slug) WHERE kind = 'proposition' AND status IN ('open', 'conjectured', 'testing'))
SELECT line, arg_min(slug, {'s': since, 'g': slug}) AS slug, min(since) AS since_us FROM o GROUP BY line""")
def oldest_open_work(t: Tables) -> DataFrame:
    return st.oldest_open(t.notes, t.posts).select("line", "slug", F.unix_micros("since").alias("since_us"))


ROLLUP = f"""d AS (SELECT n.*, lp.last FROM note_rows n LEFT JOIN (SELECT slug, max(at_us) AS last FROM post_rows GROUP BY slug) lp USING (slug)),
o AS (SELECT line, CAST(sum(CASE WHEN kind = 'proposition' AND status IN ('open', 'conjectured', 'testing') THEN 1 ELSE 0 END) AS BIGINT) AS open_count, count(*) AS total, max(last) AS last
  FROM (SELECT *, unnest(string_split(CASE WHEN lines_csv = '' THEN '(unlined)' ELSE lines_csv END, ';')) AS line FROM d WHERE kind <> 'line') GROUP BY line),
rollup AS (SELECT coalesce(h.slug, o.line) AS line, coalesce(h.status, 'exploring') AS status, coalesce(open_count, 0) AS open_count, coalesce(total, 0) AS total, greatest(coalesce(h.last, 0), coalesce(o.last, 0)) AS last_us,
  ({NOW_US} - greatest(coalesce(h.last, 0), coalesce(o.last, 0))) >= 6 * 86400000000 AS stalled, coalesce(open_count, 0) > 3 AS over_wip FROM (SELECT * FROM d WHERE kind = 'line') h FULL JOIN o ON h.slug = o.line)"""


def _rollup(t: Tables) -> DataFrame:
    return st.line_rollup(t.notes, t.posts, NOW, stall_days=6, limit=3)


@query("A8", f"WITH {ROLLUP} SELECT line, status, open_count, total, last_us, stalled, over_wip FROM rollup")
def line_rollup(t: Tables) -> DataFrame:
    return _rollup(t).select("line", "status", "open_count", "total", F.unix_micros("last_move").alias("last_us"), "stalled", "over_wip")


BOARD = """k AS (SELECT slug, max(seq) FILTER (src IS NOT NULL AND dst IN ('supported', 'refuted')) AS settled, max(seq) FILTER (field = 'bet') AS bet_at FROM post_rows GROUP BY slug),
board AS (SELECT slug, bet, status AS outcome, CASE WHEN status IN ('open', 'conjectured', 'testing') THEN CASE WHEN bet = 'unknown' THEN 'unknown_open' ELSE 'open' END
  WHEN status = 'superseded' THEN 'superseded' WHEN status IN ('supported', 'refuted') THEN CASE WHEN bet_at > settled THEN 'late' WHEN bet = 'unknown' THEN 'unknown' WHEN bet = status THEN 'hit' ELSE 'miss' END END AS verdict
  FROM note_rows LEFT JOIN k USING (slug) WHERE kind = 'proposition' AND bet IS NOT NULL)"""


@query("A9", f"WITH {BOARD} SELECT * FROM board WHERE verdict IS NOT NULL")
def prediction_scoreboard(t: Tables) -> DataFrame:
    return st.scoreboard(t.notes, t.posts)


@query("A9", f"""WITH {BOARD}, b AS (SELECT * FROM board WHERE verdict IS NOT NULL) SELECT count(*) FILTER (verdict = 'hit') AS hits, count(*) FILTER (verdict IN ('hit', 'miss')) AS scored, count(*) FILTER (verdict = 'unknown') AS unknown,
count(*) FILTER (verdict = 'late') AS late, round(count(*) FILTER (verdict = 'hit') / count(*) FILTER (verdict IN ('hit', 'miss')), 2) AS rate, count(*) FILTER (verdict IN ('open', 'unknown_open')) AS open, count(*) FILTER (verdict = 'superseded') AS superseded FROM b""")
def prediction_summary(t: Tables) -> DataFrame:
    return st.score_summary(st.scoreboard(t.notes, t.posts))


FIRST_LINE = "CASE WHEN lines_csv = '' THEN '(unlined)' ELSE string_split(lines_csv, ';')[1] END"


@query("F24", f"SELECT slug, status, bet, {FIRST_LINE} AS line FROM note_rows WHERE kind = 'proposition' AND found IS NULL AND status IN ('open', 'conjectured', 'testing') AND ((bet IS NULL AND status <> 'open') OR bet = 'unknown')")
def predictions_waiting(t: Tables) -> DataFrame:
    return st.bets_waiting(t.notes).select("slug", "status", "bet", "line")


@query("F25", "SELECT slug FROM note_rows WHERE kind = 'proposition' AND status = 'testing' AND bet IS NULL AND found IS NULL")
def predictions_missing(t: Tables) -> DataFrame:
    return st.missing_bets(t.notes)


@query("F14", f"""SELECT slug, unnest(list_filter([
 CASE WHEN NOT ({STATUS.format('status')}) THEN 'critical|invalid status' END, CASE WHEN purpose = '' THEN 'warning|missing purpose' END,
 CASE WHEN kind = 'line' AND lines_csv <> '' THEN 'warning|a line has no line' END, CASE WHEN bet NOT IN ('supported', 'refuted', 'unknown') THEN 'warning|invalid bet' END,
 CASE WHEN found = 'yes' THEN 'warning|found is not a date' END, CASE WHEN key_move = 'magic' THEN 'warning|invalid key_move' END,
 CASE WHEN key_move = 'new-method' AND status NOT IN ('supported', 'refuted', 'superseded') THEN 'suggestion|key_move before closing' END,
 CASE WHEN key_move IS NULL AND kind = 'proposition' AND status IN ('supported', 'refuted') THEN 'suggestion|closed without key_move' END], lambda x: x IS NOT NULL)) AS issue FROM note_rows""")
def note_issues(t: Tables) -> DataFrame:
    return st.note_issues(t.notes).select("slug", F.concat_ws("|", "severity", "issue").alias("issue"))


@query("F16", f"SELECT slug, seq, host, at_us FROM post_rows JOIN note_rows USING (slug) WHERE (line = 'n-9' OR list_contains(string_split(lines_csv, ';'), 'n-9')) AND host = 'alpha' AND at_us >= 1705276800000000")
def post_feed(t: Tables) -> DataFrame:
    return st.post_feed(t.posts, t.notes, since="2024-01-15 00:00:00", line="n-9", author="alpha").select("slug", "seq", "host", F.unix_micros("at").alias("at_us"))


@query("F26", "SELECT slug, count(*) AS posts, max(at_us) AS last_us FROM note_rows JOIN post_rows USING (slug) WHERE kind = 'proposition' AND status = 'testing' AND list_contains(string_split(lines_csv, ';'), 'n-9') GROUP BY slug")
def note_list(t: Tables) -> DataFrame:
    return st.note_list(t.notes, t.posts, "proposition", "testing", "n-9").select("slug", "posts", F.unix_micros("last_at").alias("last_us"))


DECISIONS = f"""s AS (SELECT *, lag(seq) OVER (PARTITION BY slug ORDER BY seq) AS prev_seq FROM post_rows), h AS (SELECT slug, max(seq) AS human FROM post_rows WHERE host = 'human' GROUP BY slug),
owed AS (SELECT s.slug, s.seq, s.src, s.dst, s.at_us FROM s JOIN note_rows n USING (slug) JOIN {_legal()} ON legal.kind = n.kind AND legal.src = s.src AND legal.dst = s.dst AND human_only LEFT JOIN h USING (slug)
  WHERE (human IS NULL OR human < coalesce(prev_seq, s.seq)) AND NOT regexp_matches(s.slug, '[05]$'))"""


def _mentions(t: Tables) -> DataFrame:
    log = t.notes.filter(F.col("slug").rlike("[05]$")).select(F.concat(F.lit("## decided on "), "slug", F.lit(", at last")).alias("text"))
    return st.mentioned_slugs(log)


@query("J14", f"WITH {DECISIONS} SELECT slug, seq, src, dst FROM owed")
def unrecorded_decisions(t: Tables) -> DataFrame:
    return st.unrecorded_decisions(t.notes, t.posts, _mentions(t)).select("slug", "seq", "src", "dst")


STALE = """lp AS (SELECT slug, max(at_us) AS last FROM post_rows GROUP BY slug),
stale AS (SELECT n.slug, d.path, d.mtime_us AS moved_us FROM note_rows n JOIN draft_rows d ON d.path = string_split(n.derivation_csv, ';')[1] || '.md' JOIN lp USING (slug) WHERE d.mtime_us > last AND d.mtime_us > n.mtime_us + 300000000)"""


@query("J13", f"WITH {STALE} SELECT * FROM stale")
def stale_derivations(t: Tables) -> DataFrame:
    return st.stale_derivations(t.notes, t.posts, t.drafts).select("slug", "path", F.unix_micros("moved").alias("moved_us"))


DEBT = f"""{CHAIN}, {DECISIONS.replace('s AS (SELECT *, lag', 'ds AS (SELECT *, lag').replace('FROM s JOIN', 'FROM ds s JOIN')}, {STALE},
debt AS (SELECT slug, issue AS why, CAST(NULL AS BIGINT) AS when_us, true AS blocks FROM chain UNION ALL SELECT slug, src || ' -> ' || dst, at_us, true FROM owed UNION ALL SELECT slug, path || ' changed', moved_us, false FROM stale)"""


def _debt(t: Tables) -> DataFrame:
    return st.debt(t.notes, t.posts, t.drafts, _mentions(t))


@query("U8", f"WITH {DEBT} SELECT * FROM debt")
def bookkeeping_debt(t: Tables) -> DataFrame:
    return _debt(t).select("slug", "why", F.unix_micros("when").alias("when_us"), "blocks")


@query("ST9 F30", f"""WITH {DEBT}, g AS (SELECT d.*, coalesce(coalesce(when_us, mtime_us) >= {NOW_US} - 8 * 86400000000, true) AS recent FROM debt d LEFT JOIN note_rows USING (slug))
SELECT CASE WHEN recent AND blocks THEN 'blocks' ELSE 'listed' END AS gate, recent, count(*) AS n FROM g GROUP BY ALL""")
def close_gate(t: Tables) -> DataFrame:
    return st.close_gate(_debt(t), t.notes, NOW, hours=192).groupBy("gate", "recent").agg(F.count("*").alias("n"))


QUEUE = f"""{ROLLUP}, queue AS (SELECT status AS kind, slug, {FIRST_LINE} AS line FROM note_rows WHERE status = 'conflict' OR (kind = 'proposition' AND status = 'disputed')
UNION ALL SELECT 'bet', slug, {FIRST_LINE} FROM note_rows WHERE kind = 'proposition' AND status IN ('conjectured', 'testing') AND bet IS NULL AND found IS NULL
UNION ALL SELECT 'wip', line, line FROM rollup WHERE over_wip UNION ALL SELECT 'phase', line, line FROM rollup WHERE stalled AND NOT over_wip AND status NOT IN ('dormant', 'closed'))"""


@query("U7", f"WITH {QUEUE} SELECT * FROM queue")
def human_queue(t: Tables) -> DataFrame:
    return st.human_queue(t.notes, _rollup(t))


@query("T6")
def next_actions(t: Tables) -> DataFrame:
    return st.next_actions(t.notes, t.posts, NOW, files=t.drafts, mentions=_mentions(t))


@query("F18", """WITH p AS (SELECT p.slug, p.seq, p.text, s.last_set FROM post_rows p JOIN note_rows n USING (slug) LEFT JOIN (SELECT slug, max(seq) AS last_set FROM post_rows WHERE field = 'evidence' GROUP BY slug) s USING (slug) WHERE n.kind = 'proposition'),
l AS (SELECT * FROM p WHERE last_set IS NULL OR seq > last_set)
SELECT DISTINCT slug, 'a post cites ' || regexp_replace(regexp_extract(text, '/tmp/\\S+'), '[.]+$', '') AS why FROM l WHERE text LIKE 'see /tmp/%'
UNION ALL SELECT DISTINCT slug, 'a post cites a scratchpad path' FROM l WHERE lower(text) LIKE '%scratchpad%'
UNION ALL SELECT DISTINCT slug, 'derivation names ' || d FROM (SELECT slug, unnest(string_split(derivation_csv, ';')) AS d FROM note_rows WHERE kind = 'proposition') WHERE d || '.md' NOT IN (SELECT path FROM draft_rows)
UNION ALL SELECT DISTINCT slug, 'evidence names ' || evidence_csv FROM note_rows WHERE kind = 'proposition'""")
def evidence_outside(t: Tables) -> DataFrame:
    return st.evidence_outside(t.notes, t.posts, t.drafts)


@query("A33", "SELECT slug, kind, status, CASE WHEN status IN ('open', 'conjectured', 'testing') THEN 'open' ELSE 'settled' END AS state FROM note_rows WHERE slug <> 'n-9' AND list_contains(string_split(lines_csv, ';'), 'n-9')")
def close_survey(t: Tables) -> DataFrame:
    return st.close_survey(t.notes, "n-9")


@query("A34 J37", """SELECT slug, kind, status, CASE WHEN status = 'superseded' THEN 'already' WHEN status = 'disputed' THEN 'disputed' WHEN status IN ('open', 'conjectured', 'testing') THEN 'unfinished' ELSE 'supersede' END AS action
FROM note_rows WHERE kind <> 'line' AND list_has_any(string_split(lines_csv, ';'), ['n-9', 'n-19', 'n-none']) UNION ALL SELECT l, NULL, NULL, 'missing line' FROM (SELECT unnest(['n-9', 'n-19', 'n-none']) AS l) WHERE l NOT IN (SELECT slug FROM note_rows WHERE kind = 'line')""")
def publish_survey(t: Tables) -> DataFrame:
    return st.publish_survey(t.notes, ["n-9", "n-19", "n-none"])


@query("J40")
def unreviewable_names(t: Tables) -> DataFrame:
    return st.unreviewable(t.notes, ["n-1O", "n-18", "n-2", "zzz"]).select("slug", "why", F.array_join("close", ",").alias("close"))


RULES = [{"rule": "require-field", "kind": "proposition", "status": "testing", "field": "found"}, {"rule": "field-points-into", "field": "derivation", "directory": "drafts"},
         {"rule": "forbid-transition", "kind": "proposition", "src": "supported", "dst": "open"}, {"rule": "max-open-per-line", "limit": 2},
         {"rule": "leaving-requires-post-by", "status": "disputed", "host": "human"}]


@query("F20 F21 F22 F23 W9 X3", f"""WITH {ROLLUP}, p AS (SELECT *, lag(seq) OVER (PARTITION BY slug ORDER BY seq) AS prev_seq FROM post_rows),
dep AS (SELECT slug, arg_max(coalesce(prev_seq, seq), seq) AS start FROM p WHERE src = 'disputed' AND dst IS NOT NULL GROUP BY slug), hum AS (SELECT slug, max(seq) AS signed FROM post_rows WHERE host = 'human' GROUP BY slug)
SELECT 'require-field' AS rule, slug, 'no found' AS why FROM note_rows WHERE kind = 'proposition' AND status = 'testing' AND found IS NULL
UNION ALL SELECT 'field-points-into', slug, 'points at ' || d FROM (SELECT slug, unnest(string_split(derivation_csv, ';')) AS d FROM note_rows) WHERE d NOT LIKE 'drafts/%'
UNION ALL SELECT 'forbid-transition', slug, 'post ' || CAST(seq AS STRING) FROM post_rows JOIN note_rows USING (slug) WHERE kind = 'proposition' AND src = 'supported' AND dst = 'open'
UNION ALL SELECT 'max-open-per-line', line, CAST(open_count AS STRING) || ' open' FROM rollup WHERE open_count > 2
UNION ALL SELECT 'leaving-requires-post-by', slug, 'left disputed unsigned' FROM dep LEFT JOIN hum USING (slug) WHERE signed IS NULL OR signed < start""")
def rule_violations(t: Tables) -> DataFrame:
    return st.check_rules(t.notes, t.posts, _rollup(t), RULES)


@query("A13 A14 A15 A16", """WITH k AS (SELECT count(*) AS c, count(*) FILTER (status IN ('verified', 'web-verified')) AS v FROM stated_rows), l AS (SELECT count(*) AS n FROM labels), d AS (SELECT count(*) AS n FROM documents), e AS (SELECT count(*) AS n FROM note_rows WHERE status = 'disputed'), a AS (SELECT count(*) AS n FROM note_rows),
s AS (SELECT round(0.55 * 0.3 + 0.25 * greatest(0, 1.0 - (d.n - l.n) / 10.0) + 0.2 * (v / c), 3) AS knowledge, round(0.7 + 0.3 * (l.n / d.n), 3) AS retrieval, round(greatest(0, 1.0 - e.n / a.n), 3) AS intent FROM k, l, d, e, a)
SELECT CAST(knowledge AS DOUBLE) AS knowledge, CAST(retrieval AS DOUBLE) AS retrieval, CAST(intent AS DOUBLE) AS intent, round(100 * (knowledge + retrieval + intent) / 3, 1) AS sync_ratio FROM s""")
def health_scores(t: Tables) -> DataFrame:
    one = lambda df, expr, name: df.agg(expr.alias("n")).select(F.lit(name).alias("k"), "n")
    counts = one(t.stated_rows, F.count("*"), "claims").unionByName(one(t.stated_rows, F.count_if(F.col("status").isin("verified", "web-verified")), "verified")) \
        .unionByName(one(t.labels, F.count("*"), "vectors")).unionByName(one(t.documents, F.count("*"), "chunks")) \
        .unionByName(one(t.notes, F.count_if(F.col("status") == "disputed"), "debt")).unionByName(one(t.notes, F.count("*"), "notes"))
    wide = counts.groupBy().pivot("k", ["claims", "verified", "vectors", "chunks", "debt", "notes"]).agg(F.max("n"))
    scored = wide.select(
        st.knowledge_health(F.lit(False), F.col("chunks") - F.col("vectors"), F.col("claims"), F.col("verified")).alias("knowledge"),
        st.retrieval_health(F.lit(True), F.col("chunks"), F.col("vectors")).alias("retrieval"), st.intent_health(F.col("debt"), F.col("notes")).alias("intent"))
    long = scored.select("*", F.lit(1.0).alias("weight"), F.explode(F.array("knowledge", "retrieval", "intent")).alias("score"))
    return st.sync_ratio(long, "knowledge", "retrieval", "intent")


# ------------------------------------------------------------------ calls, spawns, retention

WEEK = "printf('%d-W%02d', isoyear(make_timestamp(at_us)), weekofyear(make_timestamp(at_us)))"


@query("A10 C24", f"SELECT {WEEK} AS week, kind, tier, count(*) AS spent, count(*) FILTER (NOT ok) AS failed FROM call_rows GROUP BY ALL")
def weekly_spend(t: Tables) -> DataFrame:
    return it.weekly_spend(t.calls)


@query("A11", f"SELECT count(*) AS spent FROM call_rows WHERE {WEEK} = '2024-W03' AND kind = 'click'")
def calls_in_week(t: Tables) -> DataFrame:
    return it.calls_in_week(t.calls, "2024-W03", "click")


@query("A32 ST5", "SELECT CAST(user_id AS STRING) AS session, count(*) AS spawns, CAST(floor(count(*) / 25) AS BIGINT) AS alerts FROM events GROUP BY user_id")
def spawn_counts(t: Tables) -> DataFrame:
    return it.spawn_counts(t.ev.select(F.col("user_id").cast("string").alias("session")))


@query("ST8", "SELECT seq, kind FROM call_rows WHERE at_us IS NULL OR at_us >= 1706227200000000")
def retained_calls(t: Tables) -> DataFrame:
    return it.retained(t.calls, "2024-02-02 00:00:00", 7).select("seq", "kind")


@query("C25", "SELECT event_id, us - us % 1000 AS at_us FROM ev WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, NULL FROM ev WHERE event_id % 3 = 2")
def parsed_times(t: Tables) -> DataFrame:
    at = F.timestamp_micros("us")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(F.col("event_id") % 3 == 1, F.floor(F.col("us") / 1000).cast("string")).otherwise("soon")
    return t.ev.select("event_id", F.unix_micros(parse_at(text)).alias("at_us"))


# ------------------------------------------------------------------ slow loop

@query("W14 W16 W15 U9", f"""WITH {DEBT},
sig AS (SELECT 'reversal' AS kind, slug, at_us, dst AS why FROM moves JOIN note_rows n USING (slug) WHERE n.kind = 'proposition' AND src = 'supported' AND (dst = 'refuted' OR (dst = 'disputed' AND host <> 'reviewer'))
UNION ALL SELECT 'rejection', slug, at_us, 'reviewer' FROM moves WHERE host = 'reviewer' AND dst = 'disputed'
UNION ALL SELECT 'debt', slug, when_us, why FROM debt
UNION ALL SELECT 'clean', slug, arg_min(at_us, seq), 'stood' FROM post_rows JOIN note_rows n USING (slug) WHERE n.kind = 'proposition' AND status = 'supported' AND host = 'reviewer' AND contains(text, 'VERDICT: stands') AND slug NOT IN (SELECT slug FROM moves WHERE dst = 'disputed') GROUP BY slug)
SELECT kind, slug, at_us, why FROM sig""")
def slow_loop_signals(t: Tables) -> DataFrame:
    return rf.signals(t.notes, t.posts, _debt(t)).select("kind", "slug", F.unix_micros("at").alias("at_us"), "why")


NEAREST = """e AS (SELECT event_id, us - us % 1000000 AS t FROM ev WHERE event_type IN ('purchase', 'error')),
s AS (SELECT host, session_id, CAST(lo_us AS BIGINT) AS lo, CAST(hi_us AS BIGINT) AS hi FROM session_rows),
j AS (SELECT event_id, host, session_id, hi, CAST(CASE WHEN t BETWEEN lo AND hi THEN 0 WHEN t < lo THEN lo - t ELSE t - hi END AS BIGINT) // 1000000 AS gap FROM e JOIN s ON t >= lo - 7200000000 AND t <= hi + 7200000000),
near AS (SELECT event_id, host, session_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, hi, host, session_id) AS r FROM j) WHERE r = 1)"""


@query("J12", f"WITH {NEAREST} SELECT * FROM near")
def nearest_session(t: Tables) -> DataFrame:
    events = t.ev.filter(F.col("event_type").isin("purchase", "error")).select("event_id", F.timestamp_micros("us").alias("at"))
    return rf.nearest_session(events, t.sessions).select("event_id", "host", "session_id", "gap")


@query("W11", f"""WITH {NEAREST}, a AS (SELECT n.host, n.session_id, count(*) AS signals, bool_or(event_type = 'error') AS loss FROM near n JOIN events USING (event_id) GROUP BY ALL),
b AS (SELECT a.*, hi_us FROM a JOIN session_rows s USING (host, session_id)), r AS (SELECT *, row_number() OVER (PARTITION BY loss ORDER BY hi_us DESC, host, session_id) AS k FROM b)
SELECT host, session_id, CASE WHEN loss THEN 'loss' ELSE 'win' END AS kind, signals FROM r WHERE k <= CASE WHEN loss THEN 5 ELSE 3 END""")
def sampled_sessions(t: Tables) -> DataFrame:
    signals = t.ev.filter(F.col("event_type").isin("purchase", "error")).select(
        F.when(F.col("event_type") == "error", "debt").otherwise("clean").alias("kind"), F.timestamp_micros("us").alias("at"))
    return rf.sampled_sessions(signals, t.sessions).select("host", "session_id", "kind", "signals")


@query("A21 A22", """SELECT pattern, epoch_us(min(make_timestamp(day_us))) AS first_us, max(day_us) AS last_us, arg_min(session, {'d': day_us, 's': session}) AS title, count(DISTINCT session) AS sessions, count(DISTINCT host) AS hosts
FROM sighting_rows GROUP BY pattern HAVING count(DISTINCT session) >= 2 AND max(day_us) >= 1706313600000000""")
def ready_patterns(t: Tables) -> DataFrame:
    merged = rf.ready_patterns(rf.patterns(t.sightings.withColumn("title", F.concat("session", F.lit("")))), "2024-02-05", 2, 9)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return merged.select("pattern", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "title", "sessions", "hosts")


FOLD = """made AS (SELECT id, arg_max({'k': proposal_kind, 'g': target, 't': text, 'p': pattern, 'a': at_us}, seq) AS p FROM proposal_rows WHERE kind = 'proposal' GROUP BY id),
ruled AS (SELECT id, arg_max(verdict, seq) AS verdict, arg_max(at_us, seq) AS decided FROM proposal_rows WHERE kind = 'verdict' GROUP BY id),
fold AS (SELECT id, p.k AS proposal_kind, p.g AS target, p.t AS text, p.p AS pattern, p.a AS at_us, coalesce(verdict, 'open') AS verdict, decided FROM made LEFT JOIN ruled USING (id))"""


@query("A26", f"WITH {FOLD} SELECT id, proposal_kind, target, text, verdict FROM fold")
def proposal_states(t: Tables) -> DataFrame:
    return rf.proposals(t.proposals).select("id", "proposal_kind", "target", "text", "verdict")


@query("A27 F32", f"WITH {FOLD} SELECT id, 'live rule' AS state FROM fold WHERE verdict = 'accepted' AND proposal_kind = 'rule' UNION ALL SELECT id, 'rejected' FROM fold WHERE verdict = 'rejected'")
def ruled_proposals(t: Tables) -> DataFrame:
    folded = rf.proposals(t.proposals)
    return rf.live_rules(folded).select("id", F.lit("live rule").alias("state")).unionByName(rf.rejected(folded).select("id", F.lit("rejected").alias("state")))


@query("J33", f"""WITH {FOLD}, silent AS (SELECT pattern FROM sighting_rows GROUP BY pattern HAVING max(day_us) < {NOW_US} - 5 * 86400000000)
SELECT id FROM fold WHERE verdict = 'accepted' AND proposal_kind = 'rule' AND pattern IN (SELECT pattern FROM silent)""")
def quiet_rules(t: Tables) -> DataFrame:
    folded, merged = rf.proposals(t.proposals), rf.patterns(t.sightings)
    return rf.live_rules(folded).join(rf.silent_patterns(merged, TODAY, 5).select("pattern"), "pattern", "left_semi").select("id")


PRINT = "{0}.proposal_kind || '|' || lower(trim({0}.target)) || '|' || regexp_replace(trim(regexp_replace(lower({0}.text), '\\s+', ' ', 'g')), '^[ .;:!?]+|[ .;:!?]+$', '', 'g')"


@query("J34 C39", f"""WITH {FOLD}, d AS (SELECT seq, proposal_kind, target, text FROM proposal_rows)
SELECT seq, {PRINT.format('d')} AS print FROM d WHERE {PRINT.format('d')} NOT IN (SELECT {PRINT.format('fold')} FROM fold WHERE verdict <> 'retired')""")
def new_proposals(t: Tables) -> DataFrame:
    drafts = t.proposals.select("seq", "proposal_kind", "target", "text")
    return rf.new_proposals(drafts, rf.proposals(t.proposals)).select("seq", "print")


@query("J35")
def admitted_proposals(t: Tables) -> DataFrame:
    drafts = t.proposals.select("seq", "proposal_kind", "target", "text", "pattern")
    ready = rf.ready_patterns(rf.patterns(t.sightings), TODAY)
    return rf.admit_proposals(drafts, ready, rf.pattern_members(t.sightings), rf.proposals(t.proposals)).select("seq", "pattern", "kept", "reason")


@query("J38", """WITH s AS (SELECT DISTINCT session FROM sighting_rows WHERE host = 'h1'), r AS (SELECT event_id AS seq, CASE WHEN event_id % 6 = 0 THEN 'Bad Slug' ELSE 'pattern-' || CAST(event_id AS STRING) END AS slug, CAST(user_id AS STRING) || '/' || CAST(event_id % 50 AS STRING) AS session,
  CASE WHEN event_id % 8 = 0 THEN ' ' ELSE props END AS body FROM events),
j AS (SELECT r.*, CASE WHEN slug = 'Bad Slug' THEN 'not a slug' WHEN session NOT IN (SELECT session FROM s) THEN 'names no session from this pass' WHEN trim(body) = '' THEN 'no body' END AS reason FROM r),
k AS (SELECT seq FROM j WHERE reason IS NULL ORDER BY seq LIMIT 8)
SELECT seq, slug, seq IN (SELECT seq FROM k) AS kept, CASE WHEN reason IS NULL AND seq NOT IN (SELECT seq FROM k) THEN 'over the limit' ELSE reason END AS reason FROM j""")
def admitted_observations(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 6 == 0, "Bad Slug").otherwise(F.concat(F.lit("pattern-"), F.col("event_id").cast("string"))).alias("slug"),
                           F.array(F.concat(F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 50).cast("string"))).alias("sessions"),
                           F.when(F.col("event_id") % 8 == 0, " ").otherwise(F.col("props")).alias("body"))
    return rf.admit_observations(rows, t.sightings.filter(F.col("host") == "h1").select("session")).select("seq", "slug", "kept", "reason")


@query("S7 S8 ST7", "SELECT 'h' || CAST(conv_id % 3 AS STRING) AS host, CAST(conv_id AS STRING) AS session_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def session_bounds(t: Tables) -> DataFrame:
    turns = t.conversations.select(F.concat(F.lit("h"), (F.col("conv_id") % 3).cast("string")).alias("host"), F.col("conv_id").cast("string").alias("session_id"), F.lit("/w").alias("cwd"),
                                   F.col("turn").alias("seq"), "role", F.timestamp_seconds("turn").alias("at"), "text")
    return rf.sessions(turns).select("host", "session_id", F.unix_seconds("started").alias("first_turn"), F.unix_seconds("ended").alias("last_turn"), "turns")


@query("C38", """WITH b AS (SELECT conv_id, string_agg(regexp_replace(role || ': ' || text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY turn) AS body FROM conversations WHERE trim(text) <> '' GROUP BY conv_id)
SELECT CAST(conv_id AS STRING) AS session_id, md5(CASE WHEN length(body) > 700 THEN '…' || chr(10) || chr(10) || right(body, 700) ELSE body END) AS hash FROM b""")
def session_excerpts(t: Tables) -> DataFrame:
    turns = t.conversations.select(F.lit("h").alias("host"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", "text")
    return rf.excerpts(turns, 700, 3).select("session_id", F.md5("excerpt").alias("hash"))


@query("C34", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'stands' WHEN 1 THEN 'unclear' WHEN 2 THEN 'refuted' ELSE 'unclear' END AS verdict FROM events")
def reply_verdicts(t: Tables) -> DataFrame:
    reply = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("> **VERDICT: Stands**\nREASON: "), "props")).when(F.col("event_id") % 4 == 1, F.lit("VERDICT: stands\nlater\nVERDICT: refuted")) \
        .when(F.col("event_id") % 4 == 2, F.lit("- VERDICT refuted\nVERDICT: refuted")).otherwise(F.col("props"))
    return t.events.select("event_id", rf.reply_verdict(reply).alias("verdict"))


@query("J28 J29", """SELECT path, CASE WHEN path LIKE 'raw/%' THEN 'cold' WHEN path LIKE 'wiki/references/%' THEN 'cold-derived' WHEN path LIKE 'wiki/%' THEN 'warm-shared' ELSE 'warm-line' END AS tier, 'original' AS class FROM card_rows
UNION ALL SELECT 'threads/' || slug || '.md', CASE WHEN status IN ('supported', 'refuted', 'superseded', 'answered', 'abandoned', 'dormant', 'closed') THEN 'warm-line' ELSE 'hot' END, 'original' FROM note_rows""")
def path_tiers(t: Tables) -> DataFrame:
    rows = t.card_rows.select("path", F.lit(None).cast("string").alias("status")).unionByName(t.note_rows.select(F.concat(F.lit("threads/"), "slug", F.lit(".md")).alias("path"), "status"))
    return rows.select("path", vocab.tier_of(F.col("path"), F.col("status")).alias("tier"), vocab.durability_of(F.col("path")).alias("class"))
