"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it
as Parquet to the shared folder and rereads it as the next stage's documents.
All but the last return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.llm import decontaminate, lines, minhash, packing, quality_fm
from folioscope.llm.common import stored
from folioscope.llm.queries import ranks_path, table


def own_columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def whole(docs: DataFrame) -> Column:
    """The row as one struct, in which no column can clash with a stage's own."""
    return F.struct(*own_columns(docs)).alias("whole")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, null and empty texts by their score too.

    Repeated rows and ties are scored alike, nulls in other columns pass, an
    empty table stays empty; without labels all scores are equal.
    """
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    return quality_fm.scored(docs.select(whole(docs), "text"), machine, ["whole"]).where(F.col("score") >= quality_fm.THRESHOLD).select("whole.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; n_chars, where there is one, follows the text where lines went.

    Every row stays: null texts and texts without such lines as they are; a
    recurring line stays in its first document, in all rows of equal id and text.
    """
    out = lines.drop_recurring_lines(docs.select("doc_id", "text", whole(docs)), every_line=True)
    own = {c: F.col("whole").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(name) for name, c in own.items()])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; repeated rows (same id, same text) once.

    Null and wordless texts are groups of their own, rows with a null id all
    stay, the smallest id of a group stays. An id that stands for different
    texts would tie their groups together: each of its texts goes by an id of its own.
    """
    own = docs.where("doc_id is not null").select(whole(docs), "text", F.xxhash64("text").alias("text_hash"), F.col("doc_id").cast("long").alias("id"))
    several = own.groupBy("id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a != b").select("id", F.lit(True).alias("several"))
    if not several.isEmpty():
        own = own.join(several, "id", "left").withColumn("id", F.when(F.col("several"), F.xxhash64("id", "text_hash")).otherwise(F.col("id")))
    near = minhash.near_duplicates(own.select(F.col("id").alias("doc_id"), "text"))
    gone = near.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    once = own.join(gone, F.col("id") == F.col("gone"), "left_anti").dropDuplicates(["id", "text_hash"])
    return once.select("whole.*").unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, all rows of equal id and text go or stay together."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a null text is its end id alone, a null id is kept, repeated rows are packed as often as they occur."""
    return packing.pack(docs, ranks_path()).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: A trained classifier, a tokenizer and a dynamic program are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
