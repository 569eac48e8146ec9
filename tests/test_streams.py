import datetime as dt
import os
import random

from pyspark.sql import functions as F

from folioscope.operators import radar as rd
from folioscope.operators.similarity import hashed_embedding
from folioscope.plans.stream_queries import landed
from folioscope.plans.tables import Tables
from folioscope.session import work_dir
from folioscope.streaming import jobs, keyed


def parts(spark, tmp_path, df, n=3, order="seq"):
    """The rows as n files, in order; returns a function that adds the next file."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    folder = str(tmp_path / "in")
    chunks = [rows[i:i + size] for i in range(0, len(rows), size)]

    def add():
        spark.createDataFrame(chunks.pop(0), df.schema).coalesce(1).write.mode("append").parquet(folder)
        return bool(chunks)
    return folder, add


def test_decisions_restart_from_the_checkpoint(spark, tmp_path):
    log = spark.createDataFrame([(i, f"r{i % 2}", f"c{i % 5}", ["accept", "dismiss", "reset"][i % 7 % 3]) for i in range(40)], "seq bigint, report string, id string, decision string")
    folder, add = parts(spark, tmp_path, log)
    more = True
    while more:
        more = add()
        out = jobs.decisions(spark.readStream.schema(log.schema).parquet(folder), str(tmp_path / "job"))
    got = {tuple(r) for r in out.latest(spark, ["report", "id"]).filter("decision <> 'reset'").select("report", "id", "decision").collect()}
    assert got == {tuple(r) for r in rd.triage_state(log).select("report", "id", "decision").collect()}


def test_seen_ids_stay_seen(spark, tmp_path):
    log = spark.createDataFrame([(i, f"x{i % 4}") for i in range(12)], "seq bigint, id string")
    folder, add = parts(spark, tmp_path, log)
    more = True
    while more:
        more = add()
        out = jobs.first_seen(spark.readStream.schema(log.schema).parquet(folder), str(tmp_path / "job"))
    assert sorted((r["id"], r["seq"]) for r in out.read(spark).collect()) == [(f"x{i}", i) for i in range(4)]


def test_seen_ids_need_no_python_and_a_smaller_seq_comes_again(spark, tmp_path):
    log = spark.createDataFrame([(5, "a"), (3, "b"), (7, "a"), (2, "b"), (3, None), (5, "a"), (1, "a"), (2, "b")], "seq bigint, id string")
    rows, at = log.collect(), str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(log.schema).parquet(at)
    assert "Python" not in keyed.first_seen(log)._jdf.queryExecution().toString()
    for low in (0, 2, 4, 6):
        spark.createDataFrame(rows[low:low + 2], log.schema).coalesce(1).write.mode("append").parquet(at)
        out = jobs.first_seen(stream(), str(tmp_path / "job"))
    got = [(r["batch"], r["id"], r["seq"]) for r in out.read(spark).collect()]
    assert sorted(got, key=str) == sorted([(0, "a", 5), (0, "b", 3), (1, "b", 2), (2, None, 3), (3, "a", 1)], key=str)


def test_landed_files_follow_the_splits(spark, tmp_path):
    """A range of rows is several files, so that no task writes a quarter of all of them."""
    spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.range(0, 4000, 1, 32).select(F.col("id").alias("seq"))
    before = set(os.listdir(work_dir(spark)))
    stream = landed(Tables(spark, str(tmp_path)), rows, "seq")
    made = [d for d in set(os.listdir(work_dir(spark))) - before if d.startswith("landed-")]
    files = [f for f in os.listdir(os.path.join(work_dir(spark), made[0])) if f.endswith(".parquet")]
    seen = []
    jobs.run(stream, str(tmp_path / "job"), lambda df, i: seen.append(df.count()))
    assert len(files) >= 30 and 4 <= len(seen) <= 5 and sum(seen) == 4000


def test_spawn_alert_on_the_25th(spark, tmp_path):
    day = dt.datetime(2026, 1, 1)
    log = spark.createDataFrame([(i, "s", day) for i in range(60)], "seq bigint, session string, at timestamp")
    folder, add = parts(spark, tmp_path, log)
    seen = []
    more = True
    while more:
        more = add()
        _, alerts = jobs.spawn_alerts(spark.readStream.schema(log.schema).parquet(folder), str(tmp_path / "job"))
        seen.append(alerts.read(spark).agg(F.sum("alerts")).first()[0])
    assert seen == [0, 1, 2]


def test_enqueue_is_idempotent_while_waiting(spark, tmp_path):
    log = spark.createDataFrame([(0, "a", "arxiv", "1", None), (1, "b", "arxiv", "1", None), (2, "c", "arxiv", "1", "a"), (3, "d", "doi", "1", None), (4, "e", "arxiv", "1", None), (5, "f", "doi", "2", None)],
                                "seq bigint, req_id string, source_type string, value string, retry_of string")
    folder, add = parts(spark, tmp_path, log)
    none = spark.createDataFrame([], "kind string, req_id string")
    more = True
    while more:
        more = add()
        out = jobs.enqueue(spark.readStream.schema(log.schema).parquet(folder), none, str(tmp_path / "job"))
    assert sorted(r["req_id"] for r in out.read(spark).collect()) == ["a", "c", "d", "f"]


def test_incremental_index_and_cache(spark, tmp_path):
    rows = [(0, "l", "a", "# A\nx"), (1, "l", "b", "b"), (2, "l", "a", "# A\nx"), (3, "l", "b", "b2"), (4, "l", "a", None), (5, "l", "c", "c")]
    log = spark.createDataFrame(rows, "seq bigint, library string, path string, text string")
    folder, add = parts(spark, tmp_path, log)
    more = True
    while more:
        more = add()
        stream = spark.readStream.schema(log.schema).parquet(folder)
        files, chunks = jobs.incremental_index(stream, str(tmp_path / "job"))
        cache = jobs.cached_embeddings(stream.filter("text IS NOT NULL").select(F.col("path").alias("name"), "seq", "text"), str(tmp_path / "cache"), hashed_embedding(4))
    assert [(r["path"], r["change"]) for r in files.read(spark).orderBy("batch", "path").collect()] == [("a", "new"), ("b", "new"), ("b", "changed"), ("a", "deleted"), ("c", "new")]
    assert sorted((r["path"], r["content"]) for r in jobs.current_chunks(spark, files, chunks).collect()) == [("b", "b2"), ("c", "c")]
    assert [(r["name"], r["cached"]) for r in cache.read(spark).orderBy("batch", "name").collect()] == [("a", False), ("b", False), ("a", True), ("b", False), ("c", False)]


def test_state_by_key_takes_rows_in_any_order(spark, tmp_path):
    """A late older row changes nothing, a late smaller seq is written again, hot keys are reduced first."""
    steps = [[(5, "l", "a", "new"), (6, "l", "b", "b")] + [(7, "l", "hot", "h")] * 200, [(2, "l", "a", "old"), (9, "l", "b", None)], [(8, "l", "b", "late"), (10, "l", "a", "new"), (11, "l", "hot", "h2")]]
    folder, schema = str(tmp_path / "in"), "seq bigint, library string, path string, text string"
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        files, _ = jobs.incremental_index(stream, str(tmp_path / "job"))
        seen = jobs.first_seen(stream.select(F.col("path").alias("id"), "seq"), str(tmp_path / "seen"))
    assert [(r["path"], r["change"]) for r in files.read(spark).orderBy("batch", "path").collect()] == [("a", "new"), ("b", "new"), ("hot", "new"), ("b", "deleted"), ("hot", "changed")]
    assert sorted((r["batch"], r["id"], r["seq"]) for r in seen.read(spark).collect()) == [(0, "a", 5), (0, "b", 6), (0, "hot", 7), (1, "a", 2)]


def test_files_share_the_calls_of_a_bucket(spark, tmp_path):
    """Changes are those of each file alone, nulls and late rows too, with far fewer calls than files."""
    rng, held, wanted, steps = random.Random(2), {}, [], []
    for batch in range(3):
        rows = [(rng.choice([1, 2]) * 10_000 * (batch + 1) + i, rng.choice(["l", None]), f"p{rng.randrange(150)}", rng.choice(["a", "b", None])) for i in range(400)]
        steps.append(rows)
        for key in sorted({r[1:3] for r in rows}, key=str):
            seq, *_, text = max((r for r in rows if r[1:3] == key), key=lambda r: r[0])
            last, old = held.get(key, (-1, None))
            if seq > last:
                held[key] = seq, text
                wanted += [(batch, *key, "new" if old is None else "deleted" if text is None else "changed", text)] * (text != old)
    folder, schema, log = str(tmp_path / "in"), "seq bigint, library string, path string, text string", str(tmp_path / "out")
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        changes = keyed.changed(stream, ["library", "path"], F.md5("text"), "text", buckets=8)
        jobs.run(changes, str(tmp_path / "job"), lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{log}/b{i}"))
    got = [r for i in range(3) for r in spark.read.parquet(f"{log}/b{i}").collect()]
    assert sorted([(r.batch, r.library, r.path, r.change, r.text) for r in got], key=str) == sorted(wanted, key=str)
    assert "_bucket" in changes._jdf.queryExecution().analyzed().toString()
