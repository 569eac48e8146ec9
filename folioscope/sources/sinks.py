"""Sinks: versioned table sets, partitioned indexes, appended logs, text exports."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def _versions(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: number, version. Empty before the first version."""
    try:
        return spark.read.schema("number bigint, version string").parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "number bigint, version string")


def _newest(spark: SparkSession, root: str):
    """The row of the highest number; of two writers that took the same one, the greater name."""
    return _versions(spark, root).orderBy(F.col("number").desc(), F.col("version").desc()).first()


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Write a set of tables as one new version and return its name.

    Readers follow the manifest, to which the version is added only after every
    table is written: a rebuild that fails keeps the old version, whichever
    table it fails in. Versions are numbered, so that no clock decides. Old
    versions stay readable for those who hold them.
    """
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{root}/versions/{version}/{name}")
    last = _newest(spark, root)
    entry = spark.range(1).select(F.lit(last["number"] + 1 if last else 0).cast("bigint").alias("number"), F.lit(version).alias("version"))
    entry.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def published(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of the newest version. All are of the same one, whatever is published meanwhile."""
    newest = _newest(spark, root)
    if newest is None:
        raise LookupError(f"nothing is published under {root}")
    return {n: spark.read.parquet(f"{root}/versions/{newest['version']}/{n}") for n in names}


def append_log(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append events; the commit protocol replaces a file lock."""
    rows.write.mode("append").format(fmt).save(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Overwrite a result only when there is one, so an empty run keeps the last."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").json(path)
    return True


def write_corpus(files: DataFrame, root: str) -> None:
    """Files (path, text) in bundles: JSON lines, one for each file, which `readers.corpus(bundled=True)` reads.

    A stored file for each text would cost an open and a rename, and its status
    would pass through the driver. As in the text sink, a text ends with a line end.
    """
    files.select("path", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text")).write.mode("append").json(root)


def write_tag_index(index: DataFrame, path: str) -> None:
    """Inverted index as JSON rows (kind, term, path), clustered by term; a hot term spans files."""
    index.repartitionByRange("kind", "term", "path").sortWithinPartitions("kind", "term", "path").write.mode("overwrite").json(path)


def write_bibliography(entries: DataFrame, path: str) -> None:
    entries.sort("path").select("entry").write.mode("overwrite").option("lineSep", "\n\n").text(path)
