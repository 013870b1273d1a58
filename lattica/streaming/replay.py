"""A table as a stream: written as files that arrive one after the other, run through a streaming query to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.store import new_folder


def replayed(rows: DataFrame, arrival: Column, stream: Callable[[DataFrame], DataFrame], closing: DataFrame) -> DataFrame:
    """What `stream` makes of rows that arrive in order of the integer `arrival`, one micro-batch for each of its
    values, and of closing, rows of the same columns that come last and push the watermark past
    all others. Rows, checkpoint and output lie in a new folder, the output as Parquet."""
    spark = rows.sparkSession
    folder = new_folder(spark)
    fed = rows.withColumn("arrival", arrival.cast("int"))
    fed.repartition("arrival").write.partitionBy("arrival").parquet(f"{folder}/cut")
    cut = spark.read.schema(fed.schema).parquet(f"{folder}/cut")
    own = spark.newSession()  # its settings are the stream's alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")

    landed = f"{folder}/in"
    cut.limit(0).select(*rows.columns).write.parquet(landed)
    made = stream(own.readStream.schema(rows.schema).parquet(landed))
    running = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    try:
        for r in cut.select("arrival").distinct().orderBy("arrival").collect():  # as many as micro-batches
            cut.where(F.col("arrival") == r.arrival).select(*rows.columns).write.mode("append").parquet(landed)
            running.processAllAvailable()
        closing.select(*rows.columns).write.mode("append").parquet(landed)
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")
