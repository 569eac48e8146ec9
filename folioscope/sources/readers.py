"""Readers. Every log has a fixed schema; a line that does not parse is skipped."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import markup as md, text as tx
from ..functions.dates import parse_at
from ..operators.corpus import collection_of

QUEUE = ("seq bigint, kind string, req_id string, at string, source struct<type:string,value:string,library:string>, route string, "
         "retry_of string, title string")
CALLS = "at string, kind string, host string, model string, effort string, tier string, slug string, ok boolean, seconds double, note string"
TRIAGE = "seq bigint, report string, id string, decision string, at string"
PROMPTS = "host string, conversation string, workspace string, at string, text string"
SEEN = "id string, first_seen string, source string"
PAPERS = ("title string, externalIds struct<ArXiv:string,DOI:string>, abstract string, year int, url string, paperId string, "
          "authors array<struct<name:string>>, query string, pos int")
CARD_FIELDS = ("title", "type", "category", "status", "created", "updated", "verified", "ingested", "volatility", "confidence", "summary", "source", "url",
               "arxiv_id", "doi", "year", "venue", "journal", "kind", "priority", "view", "exclude_structure_check", "purpose", "bet",
               "found", "claim", "key_move")
CARD_LISTS = ("tags", "aliases", "sources", "authors", "line", "depends_on", "answers", "derivation", "evidence")
CARD_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("mtime", T.TimestampType())]
                           + [T.StructField(n, T.StringType()) for n in CARD_FIELDS]
                           + [T.StructField(n, T.ArrayType(T.StringType())) for n in CARD_LISTS]
                           + [T.StructField("compiled_from", T.StringType()), T.StructField("pinned", T.BooleanType()),
                              T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType())])


#: Characters of a JSON string; the parser's own limit is 20 million.
LONGEST_TEXT = (1 << 31) - 1


def corpus(spark: SparkSession, root: str, pattern: str = "*.md", bundled: bool = False) -> DataFrame:
    """Markdown files below `root`: path (relative), text, mtime, hash, collection.

    Stored one by one, or `bundled` as `sinks.write_corpus` does: every file
    passes as a row and none as a status through the driver, so that a corpus of
    millions can be read. `pattern` is matched with the names inside the bundles.
    """
    mtime = F.col("_metadata.file_modification_time").alias("mtime")
    if bundled:
        raw = spark.read.schema("path string, text string").option("recursiveFileLookup", True).option("maxStringLen", LONGEST_TEXT).json(root.rstrip("/"))
        files = raw.select("path", "text", mtime).filter(md.basename(F.col("path")).rlike("^" + fnmatch.translate(pattern)))
    else:
        raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root.rstrip("/"))
        rel = relative_to(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), root)
        files = raw.select(rel.alias("path"), F.col("value").alias("text"), mtime)
    kept = (md.basename(F.col("path")) != "_index.md") & ~F.array_contains(F.split("path", "/"), ".backup")
    return files.filter(kept).withColumn("hash", tx.content_hash(F.col("text"))).withColumn("collection", collection_of(F.col("path")))


SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?/*"


def relative_to(path: Column, root: str) -> Column:
    """A file's path below `root`; neither scheme nor host nor port counts, on either side.

    A file system may report `hdfs://name:8020/library/a.md` for a root given as
    `hdfs:///library`, and an absolute path for a relative root.
    """
    base = re.sub(SCHEME, "/", root).rstrip("/")
    return F.regexp_replace(F.regexp_replace(path, SCHEME, "/"), "^.*?" + re.escape(base) + "/", "")


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """Every file below `root` without its content: path, length, mtime."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.rstrip("/"))
    return raw.select(relative_to(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("mtime"))


def payload_heads(spark: SparkSession, root: str) -> DataFrame:
    """First bytes of downloaded payloads: path, payload."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.decode(F.substring("content", 1, 5), "ISO-8859-1").alias("payload"))


def _rows(batch: pd.DataFrame) -> pd.DataFrame:
    import yaml

    def text_of(value) -> str | None:
        return None if value is None else str(value)

    def list_of(value) -> list | None:
        if value is None:
            return None
        return [str(v) for v in value if v is not None] if isinstance(value, (list, tuple)) else [str(value)]

    out = []
    for path, text, mtime, front, body in batch[["path", "text", "mtime", "_front", "_body"]].itertuples(index=False):
        try:
            fm = yaml.safe_load(front) if isinstance(front, str) else {}
        except yaml.YAMLError:
            fm = {}
        fm = fm if isinstance(fm, dict) else {}
        fm = {str(k): v for k, v in fm.items()}
        row = {"path": path, "text": text, "mtime": mtime, **{n: text_of(fm.get(n)) for n in CARD_FIELDS}, **{n: list_of(fm.get(n)) for n in CARD_LISTS},
               "compiled_from": text_of(fm.get("compiled-from")), "pinned": str(fm.get("skeleton", "")).lower() in ("true", "yes", "1"),
               "fields": {k: text_of(v) or "" for k, v in fm.items()}, "body": body}
        out.append(row)
    return pd.DataFrame(out, columns=CARD_SCHEMA.fieldNames())


def cards(files: DataFrame) -> DataFrame:
    """Typed card columns from front matter; unreadable YAML gives empty fields.

    The fence is split in the JVM; only the YAML block is parsed in Python, by batch.
    """
    split = files.withColumn("_s", md.split_front_matter(F.col("text"))).select("path", "text", "mtime", F.col("_s.front").alias("_front"), F.col("_s.body").alias("_body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _rows(batch)

    return split.mapInPandas(run, CARD_SCHEMA).withColumn("collection", collection_of(F.col("path")))


#: Up to so many splits, their offsets go to every task (some 20 MB of paths).
BROADCAST_SPLITS = 100_000


def in_file_order(read: DataFrame, name: str = "seq") -> DataFrame:
    """Rows of a file scan with their place: files by path, rows by their place in the file.

    Spark packs the splits of files into tasks by size, so task numbers say
    nothing of the order. Rows of one split stay together and in order, which
    gives their place in it; the rows of the splits before are added, one number
    for each split. `read` is what a file reader returned.
    """
    meta = read.metadataColumn("_metadata")
    rows = read.select("*", F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at")).alias("_place"))
    splits = rows.groupBy("_place.file", "_place.start").agg(F.count("*").alias("n"), F.min("_place.at").alias("first"))
    files = splits.groupBy("file").agg(F.sum("n").alias("all"))
    earlier = (W.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("_file"), F.coalesce(F.sum("all").over(W.orderBy("file").rowsBetween(*earlier)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(*earlier)), F.lit(0))
    offsets = splits.withColumn("inside", inside).join(files, F.col("file") == F.col("_file")).select(
        F.col("file").alias("_file"), F.col("start").alias("_start"), (F.col("before") + F.col("inside") - F.col("first")).alias("_offset"))
    if splits.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    placed = rows.join(offsets, (F.col("_place.file") == F.col("_file")) & (F.col("_place.start") == F.col("_start")))
    return placed.select(*[F.col(f"`{c}`") for c in read.columns if c != name], (F.col("_place.at") + F.col("_offset")).alias(name))


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log of one or more files. Blank or torn lines are skipped; `seq` is the line's own or its place over all files."""
    raw = in_file_order(spark.read.option("recursiveFileLookup", True).text(path), "_order")
    rows = raw.select("_order", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNotNull().alias("_ok")).filter("_ok")
    fields = [f.name for f in rows.schema["r"].dataType.fields if f.name != "seq"]
    has_seq = "seq" in rows.schema["r"].dataType.fieldNames()
    seq = F.coalesce(F.col("r.seq"), F.col("_order")) if has_seq else F.col("_order")
    return rows.select(seq.alias("seq"), *[F.col(f"r.{f}").alias(f) for f in fields])


def call_log(spark: SparkSession, path: str) -> DataFrame:
    return json_log(spark, path, CALLS).withColumn("at", parse_at(F.col("at")))


def queue_log(spark: SparkSession, path: str) -> DataFrame:
    flat = json_log(spark, path, QUEUE)
    return flat.select("seq", "kind", "req_id", parse_at(F.col("at")).alias("at"), F.col("source.type").alias("source_type"), F.col("source.value").alias("value"),
                       F.col("source.library").alias("library"), "route", "retry_of", "title")


def prompt_log(spark: SparkSession, path: str) -> DataFrame:
    """Typed prompts of a host, one per line, in file order."""
    return json_log(spark, path, PROMPTS).withColumn("at", parse_at(F.col("at")))


def paper_feed(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed responses, one record per line."""
    return spark.read.schema(PAPERS).option("mode", "DROPMALFORMED").json(path)


def atom_feed(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Landed listing feed in Atom form."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(
        "id string, title string, published string, summary string, author array<struct<name:string>>").load(path)
    return raw.select(F.lit(category).alias("category"), "id", "title", "published", "summary",
                      F.transform(F.coalesce("author", F.array()), lambda a: a["name"]).alias("authors"))


def sqlite_tables(spark: SparkSession, url: str, names: list[str], **options: str) -> dict[str, DataFrame]:
    """Bibliographic tables over JDBC. The driver jar is the deployment's; pass partitioning options for large tables."""
    return {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names}


def parquet_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}.parquet") for n in names}


# ------------------------------------------------------------------ session recordings

TURN = ("host", "session_id", "cwd", "seq", "role", "at", "text")


def flat_turns(raw: DataFrame, host: str) -> DataFrame:
    """Recordings with one message per line: sessionId, cwd, timestamp, role, text; in file order."""
    return in_file_order(raw).select(F.lit(host).alias("host"), F.col("sessionId").alias("session_id"), "cwd", "seq",
                      F.coalesce("role", F.lit("user")).alias("role"), parse_at(F.col("timestamp")).alias("at"), "text")


def nested_turns(raw: DataFrame, host: str) -> DataFrame:
    """Recordings with one session per document: sessionId, cwd, messages[type, timestamp, content]."""
    rows = raw.select(F.lit(host).alias("host"), F.col("sessionId").alias("session_id"), "cwd", F.posexplode("messages").alias("seq", "m"))
    return rows.select("host", "session_id", "cwd", F.col("seq").cast("bigint").alias("seq"), F.coalesce("m.type", F.lit("user")).alias("role"),
                       parse_at(F.col("m.timestamp")).alias("at"), F.col("m.content").alias("text")).filter(F.length(F.trim("text")) > 0)


def sweep(readers: dict) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of every host's turns. A source that fails is named and the rest continue.

    `readers`: host → function returning a turns DataFrame; the schema is resolved here, so a missing file fails here.
    """
    out, failed = None, {}
    for host, read in readers.items():
        try:
            df = read().select(*TURN)
        except Exception as exc:  # noqa: BLE001
            failed[host] = f"{type(exc).__name__}: {str(exc)[:200]}"
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, failed
