"""Panel cells from a stream of trades: watermarked windows, one row for each asset and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_cells(trades: DataFrame, period: str = "1 day", late: str = "1 hour") -> DataFrame:
    """trades: ts (timestamp), asset, cents (long), quantity. Returns ts (the period's start), asset,
    close (volume-weighted price) and adv; rows later than `late` are not waited for. The state is
    two sums for each open period and asset, and sums of cents do not depend on arrival order."""
    sums = trades.withWatermark("ts", late).groupBy(F.window("ts", period).alias("w"), "asset").agg(F.sum("cents").alias("cents"), F.sum("quantity").alias("quantity"))
    return sums.select(F.col("w.start").alias("ts"), "asset", F.try_divide(F.col("cents").cast("double"), "quantity").alias("close"), (F.col("cents").cast("double") / 100).alias("adv"))
