"""From raw documents to token ids in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents; columns
with the names of an operator's results stay as they are. Null texts and ids: a null text is
empty and goes with the first stage; rows without doc_id are documents like others. Repeated
rows (same doc_id and text) get equal results until near dedup leaves one of them. Of equal
places the order is doc_id, nulls first where lines are compared and last where one document
of a class stays, then a hash of the text. Empty tables give empty tables. Very long texts are
taken whole in every stage, so memory grows with the longest text of a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bpe import bpe_round_trip
from lattica.llm.common import read, written
from lattica.llm.decontaminate import drop_contaminated
from lattica.llm.line_dedup import line_dedup
from lattica.llm.near_dedup import earlier_versions, one_of_each
from lattica.llm.quality import line_first_quality
from lattica.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base measures and keep enough of their lines, as they came."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    judged = line_first_quality(docs.select(row, F.col("text").alias("__text")), "__text", keep=["__row"])
    return judged.where("kept").select("__row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later places of repeated runs; documents that have no words left go."""
    left = line_dedup(docs).where(F.col("runs").isNull() | F.col("text").rlike("[^ \\t-\\r]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("runs").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class. Line dedup leaves little of a later near copy, and that
    little is like nothing else, so a document is also in the classes of its text before that stage."""
    return one_of_each(docs, versions=earlier_versions(docs, read(spark, sf_dir, "documents")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe_round_trip(docs, tokenizer_path(), keep=["doc_id"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe", bpe),
]

#: Winnowing, near-duplicate classes and BPE have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
