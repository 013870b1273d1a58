"""Point-in-time universes. Masks are boolean columns of a dense panel.

Both hysteresis screens are latches whose set and reset exclude one another, so membership is
the last event seen: no state has to be carried row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import PanelError
from lattica.plans.signal import Keys


def listing_mask(panel: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds listed: ts lies in the asset's (asset, first, last), NULL sides open; unknown assets never."""
    if not listings.where("last < first").isEmpty():
        raise PanelError("a listing ends before it begins")
    known = listings.select("asset", "first", "last", F.lit(True).alias("__known"))
    member = F.col("__known") & (F.col("first").isNull() | (F.col("ts") >= F.col("first"))) & (F.col("last").isNull() | (F.col("ts") <= F.col("last")))
    return panel.join(known, "asset", "left").withColumn("listed", F.coalesce(member, F.lit(False))).drop("first", "last", "__known")


def latch(join: Column, leave: Column, keys: Keys = Keys()) -> Column:
    """True from a join until a leave, false before the first join."""
    event = F.when(join, True).when(leave, False)
    return F.coalesce(F.last(event, ignorenulls=True).over(keys.asset().rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))


def liquidity_screen(panel: DataFrame, volume: str, top_n: int | None = 500, min_dollar_volume: float = 1e6, window: int = 20, entry_rank: int | None = None, exit_rank: int | None = None, position: str = "asset") -> DataFrame:
    """Adds adv_mean, liquidity_rank and liquid. Members join at entry_rank or better (6 tenths of
    top_n) and leave beyond exit_rank (16 tenths); who is not eligible today is no member."""
    keys = Keys()
    enter = entry_rank if entry_rank is not None else max(1, int(0.6 * (top_n or 1)))
    leave = exit_rank if exit_rank is not None else int(1.6 * (top_n or 1))
    if window < 1:
        raise PanelError(f"window must be at least 1, got {window}")
    if top_n is not None and enter > leave:
        raise PanelError(f"entry rank {enter} is worse than exit rank {leave}: inverted hysteresis")
    frame = keys.asset().rangeBetween(-(window - 1), 0)
    v = F.col(volume)
    mean = F.when(F.count(v).over(frame) >= min(window, max(2, window // 2)), F.avg(v).over(frame))
    out = panel.withColumn("adv_mean", mean)
    able = F.coalesce((F.col("adv_mean") >= min_dollar_volume) & (v > 0) & (v < float("inf")), F.lit(False))
    out = out.withColumn("__able", able)
    if top_n is None:
        return out.withColumns({"liquidity_rank": F.lit(None).cast("int"), "liquid": F.col("__able")}).drop("__able")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.col("__able").desc(), F.col("adv_mean").desc(), position))
    out = out.withColumn("liquidity_rank", F.when(F.col("__able"), rank))
    inside = F.col("__able") & (F.col("liquidity_rank") <= enter)
    outside = ~F.col("__able") | (F.col("liquidity_rank") > leave)
    return out.withColumn("liquid", latch(inside, outside, keys)).drop("__able")


def price_floor_screen(panel: DataFrame, raw_price: str, min_price: float = 5.0, entry_price: float | None = None) -> DataFrame:
    """Adds priced: joins at entry_price (1.2 times the floor) or more, leaves below min_price;
    a missing price masks its day and keeps the state."""
    if raw_price not in panel.columns:
        raise PanelError(f"no raw price column {raw_price!r}: adjusted prices cannot stand in for it")
    entry = 1.2 * min_price if entry_price is None else entry_price
    if entry < min_price:
        raise PanelError(f"entry price {entry} is below the floor {min_price}: inverted hysteresis")
    p = F.col(raw_price)
    return panel.withColumn("priced", latch(p >= entry, p < min_price) & p.isNotNull())


def combine(panel: DataFrame, *masks: str) -> DataFrame:
    """Adds member: all masks hold."""
    member = F.lit(True)
    for m in masks:
        member = member & F.col(m)
    return panel.withColumn("member", member)


def apply_universe(panel: DataFrame, *fields: str) -> DataFrame:
    """Fields are missing outside the universe."""
    return panel.withColumns({f: F.when(F.col("member"), F.col(f)) for f in fields})


def members_on(panel: DataFrame, when) -> DataFrame:
    day = panel.where(F.col("ts") == F.lit(when))
    if day.isEmpty():
        raise PanelError(f"{when} is not a date of the panel")
    return day.where("member").select("asset")


def audit(panel: DataFrame) -> DataFrame:
    """One row: mean, least and most members, entries and exits after the first time, churn per
    period, and whether nobody ever left (survivorship) or members change too fast."""
    before = F.lag("member").over(Keys().asset())
    steps = panel.withColumns({"__in": (F.col("member") & ~before).cast("int"), "__out": (~F.col("member") & before).cast("int")})
    daily = steps.groupBy("t").agg(F.sum(F.col("member").cast("int")).alias("n"), F.sum("__in").alias("i"), F.sum("__out").alias("o"))
    total = daily.agg(
        F.avg("n").alias("mean_members"),
        F.min("n").alias("min_members"),
        F.max("n").alias("max_members"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("exits"),
        F.count("*").alias("n_times"),
    )
    churn = (F.col("entries") + F.col("exits")) / F.greatest(F.lit(1), F.col("n_times") - 1)
    return total.withColumns({"churn": churn, "survivorship_filtered": (F.col("exits") == 0) & (F.col("mean_members") > 0), "churns_fast": churn > 2})
