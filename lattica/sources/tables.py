"""Panels built from the star schema: brand by month and supplier by week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.panel import dense_panel, tasks_for
from lattica.sources.store import stored


def _cells(rows: DataFrame) -> DataFrame:
    """Prices from integer sums, so that they do not depend on the order of summing; lines are scanned once, when the panel is built."""
    made = rows.groupBy("asset", "ts").agg(F.sum("cents").alias("cents"), F.sum("l_quantity").alias("qty"))
    return stored(made.select("asset", "ts", F.try_divide(F.col("cents").cast("double"), "qty").alias("close"), (F.col("cents").cast("double") / 100).alias("adv")))


def _lines(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    return lines.select("l_partkey", "l_suppkey", F.to_date(F.date_trunc(unit, "l_shipdate")).alias("ts"), cents, "l_quantity")


def brand_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("asset"))
    lines = _lines(spark, sf_dir, "month")
    return dense_panel(_cells(lines.join(parts, lines.l_partkey == parts.p_partkey)))


def supplier_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier ships some two lines a week, so sums of a part of the lines are hardly fewer than these: lines are dealt
    out by cell, to tasks by their number, and added up there."""
    lines = _lines(spark, sf_dir, "week")
    rows = lines.select(F.col("l_suppkey").cast("string").alias("asset"), "ts", "cents", "l_quantity")
    return dense_panel(_cells(rows.repartition(tasks_for(spark, lines.count()), "asset", "ts")))
