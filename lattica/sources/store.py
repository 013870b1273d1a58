"""Tables written once and read by several plans, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import DataError


def new_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session may leave that unset; its folder goes with the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise DataError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tables-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"{own}/table"


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table: what reads it several times does not compute it again, and a lost executor costs no lineage."""
    folder = new_folder(frame.sparkSession)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def write_panel(panel: DataFrame, folder: str) -> None:
    """A panel by year of its times, so that a slice of time reads its years only. Each year is written by its own tasks."""
    rows = panel.withColumn("year", F.year("ts"))
    rows.repartition("year", "t").sortWithinPartitions("year", "t", "asset").write.mode("errorifexists").partitionBy("year").parquet(folder)


def read_panel(spark: SparkSession, folder: str) -> DataFrame:
    """What write_panel wrote, with its column `year`, by which scans leave out files."""
    return spark.read.parquet(folder)
