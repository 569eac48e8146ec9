"""Slow loop: sessions, signals, sampling, patterns, proposals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx, vocab
from .state import moves

NEAR_SECONDS = 7200
MAX_LOSS, MAX_WIN = 5, 3
READY, EXPIRY_DAYS = 2, 90
MAX_PROPOSALS, MAX_PATTERNS = 5, 8
KINDS = ("rule", "patch", "skill", "fact")
FORBIDDEN = "output/reflect"
EXCERPT = 15_000
VERDICTS = ("stands", "refuted", "restate", "unclear")


# ------------------------------------------------------------------ sessions

def sessions(turns: DataFrame) -> DataFrame:
    """Session bounds from turns: host, session_id, cwd, started, ended, turns."""
    spoken = turns.filter(F.length(F.trim("text")) > 0)
    return spoken.groupBy("host", "session_id").agg(F.min("cwd").alias("cwd"), F.min("at").alias("started"), F.max("at").alias("ended"),
                                                    F.count("*").alias("turns"))


def prompt_turns(log: DataFrame) -> DataFrame:
    """Typed prompts as turns; without a conversation id the workspace and day identify the session."""
    key = F.coalesce(F.nullif("conversation", F.lit("")), F.concat_ws("@", "workspace", F.date_format("at", "yyyy-MM-dd")))
    return log.filter(F.length(F.trim("text")) > 0).select(
        F.col("host"), key.alias("session_id"), F.col("workspace").alias("cwd"), F.col("seq"), F.lit("user").alias("role"), "at", "text")


def excerpts(turns: DataFrame, limit: int = EXCERPT, fan: int = 500) -> DataFrame:
    """Last `limit` characters of each session, turns tagged by role.

    The tail of a text is the tail of its parts' tails, so turns are folded by
    ranges of `fan` positions, level by level: no group holds more than `fan`
    tails, however long the session is.
    """
    spoken = turns.filter(F.length(F.trim("text")) > 0)
    said = tx.strip(F.concat("role", F.lit(": "), "text"))
    level = spoken.select("host", "session_id", F.col("seq").cast("long").alias("n"),
                          F.right(said, F.lit(limit)).alias("tail"), F.length(said).cast("long").alias("size"))
    for _ in range(3):
        folded = level.groupBy("host", "session_id", F.floor(F.col("n") / fan).alias("n")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "tail"))), lambda s: s["tail"]), "\n\n").alias("tail"),
            (F.sum("size") + 2 * (F.count("*") - 1)).alias("size"))
        level = folded.withColumn("tail", F.right("tail", F.lit(limit)))
    top = level.groupBy("host", "session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "tail"))), lambda s: s["tail"]), "\n\n").alias("tail"),
        (F.sum("size") + 2 * (F.count("*") - 1)).alias("size"))
    return top.select("host", "session_id", F.when(F.col("size") > limit, F.concat(F.lit("…\n\n"), F.right("tail", F.lit(limit))))
                      .otherwise(F.col("tail")).alias("excerpt"))


# ------------------------------------------------------------------ signals

def reversals(notes: DataFrame, posts: DataFrame) -> DataFrame:
    """Propositions leaving supported for refuted, or for disputed by anyone but a reviewer."""
    left = moves(posts).filter((F.col("src") == "supported") & ((F.col("dst") == "refuted") | (
        (F.col("dst") == "disputed") & (F.col("host") != vocab.REVIEWER))))
    return left.join(notes.filter(F.col("kind") == "proposition").select("slug"), "slug", "left_semi") \
        .select(F.lit("reversal").alias("kind"), "slug", "at", F.col("dst").alias("why"))


def rejections(posts: DataFrame) -> DataFrame:
    return moves(posts).filter((F.col("host") == vocab.REVIEWER) & (F.col("dst") == "disputed")) \
        .select(F.lit("rejection").alias("kind"), "slug", "at", F.lit("reviewer").alias("why"))


def clean_wins(notes: DataFrame, posts: DataFrame) -> DataFrame:
    """Supported, never disputed: the first reviewer post that stands. One aggregate."""
    stands = (F.col("host") == vocab.REVIEWER) & F.contains(F.coalesce("text", F.lit("")), F.lit("VERDICT: stands"))
    disputed = F.col("src").isNotNull() & F.coalesce(F.col("dst") == "disputed", F.lit(False))
    marks = posts.groupBy("slug").agg(F.bool_or(disputed).alias("_disputed"),
                                      F.min_by(F.when(stands, F.col("at")), F.when(stands, F.col("seq"))).alias("at"), F.bool_or(stands).alias("_stands"))
    held = notes.filter((F.col("kind") == "proposition") & (F.col("status") == "supported")).select("slug")
    return held.join(marks, "slug").filter(F.col("_stands") & ~F.col("_disputed")) \
        .select(F.lit("clean").alias("kind"), "slug", "at", F.lit("stood").alias("why"))


def signals(notes: DataFrame, posts: DataFrame, debts: DataFrame) -> DataFrame:
    """Every signal, in time order."""
    owed = debts.select(F.lit("debt").alias("kind"), "slug", F.col("when").alias("at"), "why")
    return reversals(notes, posts).unionByName(rejections(posts)).unionByName(owed).unionByName(clean_wins(notes, posts)) \
        .orderBy(F.col("at").asc_nulls_first(), "slug")


#: 16^10 seconds are longer than all time that a timestamp can hold.
LEVELS = 10


def time_blocks(lo: Column, hi: Column) -> Column:
    """The seconds lo to hi as blocks (level, block): seconds block * 16^level to (block + 1) * 16^level - 1, each second in one."""
    def run(start: Column, stop: Column) -> Column:
        return F.when(start < stop, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))

    def at_level(n: int, blocks: Column) -> Column:
        return F.transform(blocks, lambda x: F.struct(F.lit(n).alias("level"), x.alias("block")))

    out = []
    for n in range(LEVELS):
        # Whole blocks of this level from a to b, of the next from up to top.
        a, b = -F.shiftright(-lo, 4 * n), F.shiftright(hi + 1, 4 * n)
        up, top = -F.shiftright(-lo, 4 * n + 4), F.shiftright(hi + 1, 4 * n + 4)
        blocks = F.when(up < top, F.concat(run(a, up * 16), run(top * 16, b))).otherwise(run(a, b))
        out.append(at_level(n, blocks))
    return F.concat(*out)


def nearest_session(events: DataFrame, sessions: DataFrame, near: int = NEAR_SECONDS) -> DataFrame:
    """Each event with the session it happened in: session key columns and gap in seconds.

    Gap 0 inside [started, ended], else to the nearer end, at most `near`; the
    session listed first (by ended, host, id) wins ties. Times count in whole
    seconds, which lets the join run over distinct seconds. A session is cut into
    blocks of 16^n seconds, fewer than 32 on each of LEVELS levels whatever its
    length; a block keeps its best session, and a second asks for its own block
    on every level. The nearest ends are looked up inside hour ranges of at most
    3,600 distinct seconds. No event ever meets more than one row per lookup.
    """
    second = lambda c: F.floor(F.unix_micros(c) / F.lit(1_000_000))
    a, b = second(F.coalesce("started", "ended")), second(F.coalesce("ended", "started"))
    spans = sessions.filter(F.coalesce("started", "ended").isNotNull()).select(
        F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.struct("ended", "host", "session_id").alias("s"))
    moments = events.select(second(F.col("at")).alias("t")).filter(F.col("t").isNotNull()).distinct()
    covers = spans.select(F.inline(time_blocks(F.col("lo"), F.col("hi"))), "s").groupBy("level", "block").agg(F.min("s").alias("cover"))
    own = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("t", 4 * n).alias("block")) for n in range(LEVELS)])
    covered = moments.select("t", F.inline(own)).join(covers, ["level", "block"], "left").groupBy("t").agg(F.min("cover").alias("inside"))
    # outside: nearest end before and nearest start after, one best session per second
    ends = spans.groupBy(F.col("hi").alias("t")).agg(F.min("s").alias("mark"))
    starts = spans.groupBy(F.col("lo").alias("t")).agg(F.min("s").alias("mark"))
    before = _carry(covered.filter(F.col("inside").isNull()).select("t"), ends, near, forward=True)
    after = _carry(covered.filter(F.col("inside").isNull()).select("t"), starts, near, forward=False)
    both = covered.join(before.withColumnsRenamed({"at": "e_at", "mark": "e_mark"}), "t", "left") \
        .join(after.withColumnsRenamed({"at": "s_at", "mark": "s_mark"}), "t", "left")
    option = lambda gap, mark: F.when(mark.isNotNull() & (gap <= near), F.struct(gap.alias("gap"), mark.alias("s")))
    best = F.coalesce(F.when(F.col("inside").isNotNull(), F.struct(F.lit(0).cast("bigint").alias("gap"), F.col("inside").alias("s"))),
                      F.least(option(F.col("t") - F.col("e_at"), F.col("e_mark")), option(F.col("s_at") - F.col("t"), F.col("s_mark"))))
    table = both.select("t", best.alias("best")).filter(F.col("best").isNotNull())
    return events.withColumn("t", second(F.col("at"))).join(table, "t").drop("t") \
        .select(*events.columns, F.col("best.s.host").alias("host"), F.col("best.s.session_id").alias("session_id"), F.col("best.gap").alias("gap"))


def _carry(moments: DataFrame, marks: DataFrame, near: int, forward: bool) -> DataFrame:
    """Nearest mark at or before (forward) or at or after each moment: t, at, mark."""
    payload = F.struct(F.col("t").alias("at"), "mark")
    marked = marks.select("t", payload.alias("p"))
    rows = moments.select("t", F.lit(True).alias("asked")).join(marked, "t", "full_outer").withColumn("h", F.floor(F.col("t") / 3600))
    order = F.col("t") if forward else F.col("t").desc()
    local = F.last("p", ignorenulls=True).over(W.partitionBy("h").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    edge = marked.groupBy(F.floor(F.col("t") / 3600).alias("h")).agg((F.max_by if forward else F.min_by)("p", "t").alias("q"))
    # The nearest earlier hour with a mark, looked up over the few hours that can matter.
    hours = -(-near // 3600) + 1
    spread = edge.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(hours)), lambda d: F.struct(
        (F.col("h") + (d if forward else -d)).alias("h"), d.alias("d")))).alias("x"), "q").select("x.h", "x.d", "q")
    carried = spread.groupBy("h").agg(F.min_by("q", "d").alias("q"))
    found = rows.withColumn("l", local).filter("asked").join(carried, "h", "left")
    pick = F.coalesce("l", "q")
    return found.select("t", pick["at"].alias("at"), pick["mark"].alias("mark"))


LOSSES = ("reversal", "debt", "rejection")


def sampled_sessions(signals: DataFrame, sessions: DataFrame, max_loss: int = MAX_LOSS, max_win: int = MAX_WIN) -> DataFrame:
    """Sessions worth reading: newest first, losses and wins counted apart."""
    hits = nearest_session(signals.withColumnRenamed("kind", "signal"), sessions)
    told = hits.groupBy("host", "session_id").agg(F.count("*").alias("signals"), F.bool_or(F.col("signal").isin(*LOSSES)).alias("_loss"))
    rows = told.join(sessions.select("host", "session_id", "started", "ended"), ["host", "session_id"]) \
        .withColumn("kind", F.when(F.col("_loss"), "loss").otherwise("win"))
    pick = lambda kind, n: rows.filter(F.col("kind") == kind).orderBy(
        F.coalesce("ended", "started").desc_nulls_last(), "host", "session_id").limit(n)
    return pick("loss", max_loss).unionByName(pick("win", max_win)).select("host", "session_id", "kind", "signals", "ended")


# ------------------------------------------------------------------ patterns

def patterns(sightings: DataFrame) -> DataFrame:
    """Sightings merged per pattern: first body kept, sessions and hosts counted apart.

    Members stay in the long table `pattern_members`; here are their exact counts.
    """
    first = F.struct("day", "session")
    return sightings.groupBy("pattern").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.min_by("title", first).alias("title"), F.min_by("body", first).alias("body"),
        F.count_distinct("session").alias("sessions"), F.count_distinct("host").alias("hosts")).withColumn("status", F.lit("open"))


def pattern_members(sightings: DataFrame) -> DataFrame:
    return sightings.select("pattern", "session", "host").distinct()


def ready_patterns(merged: DataFrame, today, minimum: int = READY, expiry: int = EXPIRY_DAYS) -> DataFrame:
    """Open patterns seen in enough sessions and not silent for more than the expiry."""
    return merged.filter((F.col("status") == "open") & (F.col("sessions") >= minimum)
                         & (F.datediff(F.lit(today).cast("date"), F.col("last_seen")) <= expiry))


def silent_patterns(merged: DataFrame, today, expiry: int = EXPIRY_DAYS) -> DataFrame:
    return merged.filter(F.datediff(F.lit(today).cast("date"), F.col("last_seen")) > expiry)


def admit_observations(rows: DataFrame, sampled: DataFrame, limit: int = MAX_PATTERNS) -> DataFrame:
    """Observations with `kept` and `reason`. `rows`: seq, slug, sessions, body; `sampled`: session."""
    named = rows.select("seq", F.explode_outer("sessions").alias("session")).join(sampled.select("session").distinct(), "session", "left_semi") \
        .groupBy("seq").agg(F.count("*").alias("_named"))
    judged = rows.join(named, "seq", "left")
    reason = (F.when(~F.coalesce(F.col("slug"), F.lit("")).rlike(r"^[a-z0-9][a-z0-9-]*$"), "not a slug")
              .when(F.col("_named").isNull(), "names no session from this pass")
              .when(F.coalesce(F.length(F.trim("body")), F.lit(0)) == 0, "no body"))
    return _first_kept(judged.withColumn("reason", reason).drop("_named"), limit)


def _first_kept(judged: DataFrame, limit: int) -> DataFrame:
    """Of the rows without a reason, the first `limit` in order are kept."""
    first = judged.filter(F.col("reason").isNull()).orderBy("seq").limit(limit).select("seq", F.lit(True).alias("kept"))
    out = judged.join(first, "seq", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return out.withColumn("reason", F.when(~F.col("kept") & F.col("reason").isNull(), "over the limit").otherwise(F.col("reason")))


# ------------------------------------------------------------------ proposals

def fingerprint(kind: Column, target: Column, text: Column) -> Column:
    """Kind, target and words; case, spacing and closing punctuation make no new idea."""
    words = F.regexp_replace(tx.squash(F.lower(F.coalesce(text, F.lit("")))), r"^[ .;:!?]+|[ .;:!?]+$", "")
    return F.concat_ws("|", F.coalesce(kind, F.lit("")), F.lower(F.trim(F.coalesce(target, F.lit("")))), words)


def proposals(events: DataFrame) -> DataFrame:
    """Current state of every proposal: its text and the latest verdict."""
    made = events.filter(F.col("kind") == "proposal").groupBy("id").agg(F.max_by(F.struct(
        "at", "proposal_kind", "target", "text", "pattern"), "seq").alias("p")).select("id", "p.*")
    ruled = events.filter(F.col("kind") == "verdict").groupBy("id").agg(F.max_by(F.struct("verdict", F.col("at").alias("decided_at"), "note"), "seq").alias("v")) \
        .select("id", "v.*")
    return made.join(ruled, "id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("open")))


def live_rules(folded: DataFrame) -> DataFrame:
    """Accepted rules, ordered by acceptance."""
    return folded.filter((F.col("verdict") == "accepted") & (F.col("proposal_kind") == "rule")).orderBy(F.coalesce("decided_at", "at"), "id")


def rejected(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("verdict") == "rejected")


def new_proposals(drafts: DataFrame, folded: DataFrame) -> DataFrame:
    """Proposals whose fingerprint was never proposed; a retired one may return."""
    known = folded.filter(F.col("verdict") != "retired").select(fingerprint(F.col("proposal_kind"), F.col("target"), F.col("text")).alias("print")).distinct()
    return drafts.withColumn("print", fingerprint(F.col("proposal_kind"), F.col("target"), F.col("text"))).join(known, "print", "left_anti")


def admit_proposals(drafts: DataFrame, ready: DataFrame, members: DataFrame, folded: DataFrame, limit: int = MAX_PROPOSALS) -> DataFrame:
    """Drafts with `kept` and `reason`: a ready pattern, a known kind, enough hosts, not proposed before."""
    known = folded.filter(F.col("verdict") != "retired").select(
        fingerprint(F.col("proposal_kind"), F.col("target"), F.col("text")).alias("print"), F.lit(True).alias("_seen")).distinct()
    cited = drafts.withColumn("print", fingerprint(F.col("proposal_kind"), F.col("target"), F.col("text"))) \
        .join(ready.select("pattern", F.col("hosts").alias("_hosts")), "pattern", "left").join(known, "print", "left")
    own = cited.join(members.select("pattern", "host").distinct(), "pattern") \
        .filter(F.contains(F.lower("target"), F.lower("host"))).select("seq").distinct().withColumn("_own", F.lit(True))
    cited = cited.join(own, "seq", "left")
    blank = (F.coalesce(F.length(F.trim("target")), F.lit(0)) == 0) | (F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0)
    names = F.contains(F.lower(F.concat_ws("\n", "target", "text")), F.lit(FORBIDDEN))
    reason = (F.when(F.col("_hosts").isNull(), "cites no ready pattern").when(~F.col("proposal_kind").isin(*KINDS), "not a proposal kind")
              .when(blank, "needs a target and a change").when(names, "names the pattern library")
              .when((F.col("_hosts") < 2) & F.col("_own").isNull(), "one host only").when(F.col("_seen"), "proposed before"))
    judged = cited.withColumn("reason", reason)
    first = judged.filter(F.col("reason").isNull()).groupBy("print").agg(F.min("seq").alias("_first"))
    judged = judged.join(first, "print", "left").withColumn(
        "reason", F.when(F.col("reason").isNull() & (F.col("seq") != F.col("_first")), "proposed before").otherwise(F.col("reason")))
    return _first_kept(judged.drop("_hosts", "_seen", "_own", "_first", "print"), limit)


def quiet_rules(folded: DataFrame, merged: DataFrame, today) -> DataFrame:
    """Accepted rules whose pattern has been silent for the expiry."""
    return live_rules(folded).join(silent_patterns(merged, today).select("pattern"), "pattern", "left_semi")


def rules_from_proposals(events: DataFrame) -> DataFrame:
    """Proposals that fit the closed rule vocabulary: id, rule, params. `events` has patch as a map."""
    from .state import RULES
    named = F.col("patch")["rule"]
    fits = F.lit(False)
    for name, keys in RULES.items():
        fits = fits | ((named == name) & (F.size(F.array_except(F.lit(list(keys)), F.map_keys("patch"))) == 0))
    return events.filter((F.col("kind") == "proposal") & F.coalesce(fits, F.lit(False))).select(
        "id", named.alias("rule"), F.map_filter("patch", lambda k, v: ~k.isin("rule", "op", "target", "text")).alias("params"))


# ------------------------------------------------------------------ replies

def reply_verdict(text: Column) -> Column:
    """The one distinct verdict a reply gives, otherwise unclear."""
    pattern = r"(?im)^[\s>*\-#`]*\**\s*VERDICT\s*:?\s*\**\s*(" + "|".join(VERDICTS) + r")\b(?![|/,])"
    said = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.lower(v)))
    return F.when(F.size(said) == 1, F.element_at(said, 1)).otherwise("unclear")
