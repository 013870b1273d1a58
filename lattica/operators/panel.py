"""Panels: a dense long table (t, ts, asset, fields) over the axes of its times and assets.

`t` counts the distinct times from 0; `pos` counts the assets in order. The axes are as long
as the calendar and the list of assets, the only tables the grid is crossed from: numbered
times, dealt to as many tasks as the session shuffles to, or more for a large panel, meet the assets in chunks of CHUNK.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.errors import PanelError
from lattica.sources.store import stored


#: Assets that a row of the grid's second axis holds.
CHUNK = 64
#: Cells that a task takes at most, about: as a panel grows, it is dealt to more tasks, whatever the session shuffles to.
CELLS = 2**18


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that so many rows are dealt to: those the session shuffles to, or more if each would take over CELLS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // CELLS))


def tasks_of(panel: DataFrame) -> int:
    """tasks_for the size that dense_panel has noted at t; a panel without a note (t was made anew) counts as small."""
    return tasks_for(panel.sparkSession, panel.schema["t"].metadata.get("cells", 0))


def by_asset(panel: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """The panel dealt out along its assets."""
    return panel.repartition(tasks_of(panel), *[f"`{k}`" for k in run], "asset")


def by_time(panel: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """The panel dealt out by cross-sections. Times of a single run go to the tasks in turn: they are few and each has
    as many rows as there are assets, so by their hash some tasks would get several times the share of others."""
    if run or dict(panel.dtypes)["t"] != "int":
        return panel.repartition(tasks_of(panel), *[f"`{k}`" for k in run], "t")
    return panel.repartitionById(tasks_of(panel), F.col("t"))


def axes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, ts, chunks): the distinct times, numbered, and (chunk, assets): the distinct assets in chunks. Both are lists
    of distinct values, from aggregations with partial sets."""
    assets = rows.agg(F.array_sort(F.collect_set("asset")).alias("assets"))
    n = F.ceil(F.size("assets") / CHUNK).cast("int")
    chunks = assets.select("assets", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("chunk")).select("chunk", F.slice("assets", F.col("chunk") * CHUNK + 1, CHUNK).alias("assets"))
    both = rows.agg(F.array_sort(F.collect_set("ts")).alias("times"), F.count_distinct("asset").alias("n"))
    times = both.select(F.posexplode("times").alias("t", "ts"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    return times, chunks


def grid(rows: DataFrame) -> DataFrame:
    """t, ts, asset of all times and assets, made in as many tasks as they are dealt to: the calendar is dealt
    out by t, each time names the chunks, and a join by the chunk's number brings their assets. t notes the size."""
    n = rows.agg(F.approx_count_distinct("ts").alias("times"), F.approx_count_distinct("asset").alias("assets")).first()
    times, chunks = axes(rows)
    noted = times.withColumn("t", F.col("t").alias("t", metadata={"cells": n.times * n.assets}))
    named = by_time(noted).select("t", "ts", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    return named.join(chunks, "chunk").select("t", "ts", F.explode("assets").alias("asset"))


def dense_panel(rows: DataFrame) -> DataFrame:
    """The grid of all times and assets with the rows' fields, NULL where there is no row. rows are read
    four times, twice for one column (the axes) and once for their size: hand over a stored table if they cost something. Both sides are sorted:
    the grid comes from two rows of sets, so its size is taken for theirs, and where a filter makes the join an
    inner one the whole grid would be broadcast. Both are dealt to as many tasks as the grid asks for: tasks merged by
    the size of their compressed rows, which for a grid is next to nothing, would each sort a share of it that grows with it."""
    fields = [c for c in rows.columns if c not in ("t", "ts", "asset")]
    whole = grid(rows)
    tasks = tasks_of(whole)
    dealt = lambda x: x.repartition(tasks, "ts", "asset")
    return dealt(whole).hint("merge").join(dealt(rows.select("ts", "asset", *fields)), ["ts", "asset"], "left").select("t", "ts", "asset", *fields)


def long_to_panel(rows: DataFrame, date: str, asset: str, value: str, order: Sequence[str | Column], name: str = "v") -> DataFrame:
    """Long rows as a dense panel; of several rows for one cell the first by `order` counts."""
    cells = rows.groupBy(F.col(date).alias("ts"), F.col(asset).cast("string").alias("asset")).agg(F.min_by(F.struct(F.col(value).try_cast("double").alias("v")), F.struct(*order)).getField("v").alias(name))
    return dense_panel(stored(cells.where("ts is not null and asset is not null")))


def checked(panel: DataFrame) -> DataFrame:
    """The panel, or PanelError if a cell occurs twice. Costs one aggregation: for load boundaries."""
    if not panel.groupBy("ts", "asset").count().where("count > 1").isEmpty():
        raise PanelError("duplicate (ts, asset) cells; times and assets must be unique")
    return panel


def from_rows(spark: SparkSession, rows: Sequence[Sequence[float | None]], index: Sequence, assets: Sequence[str], name: str = "v") -> DataFrame:
    if len(set(assets)) != len(assets):
        raise PanelError("duplicate asset names")
    if any(a >= b for a, b in zip(index, index[1:])):
        raise PanelError("index must be strictly increasing")
    if len(rows) != len(index) or any(len(r) != len(assets) for r in rows):
        raise PanelError(f"shape does not match {len(index)} times x {len(assets)} assets")
    missing = lambda v: None if v is None or v != v else float(v)
    cells = [(t, ts, a, missing(v)) for t, (ts, row) in enumerate(zip(index, rows, strict=True)) for a, v in zip(assets, row, strict=True)]
    kind = "timestamp_ntz" if index and hasattr(index[0], "hour") else "date"
    return spark.createDataFrame(cells, f"t int, ts {kind}, asset string, {name} double")


def coverage(panel: DataFrame, value: str) -> DataFrame:
    """n_times, n_assets and the share of cells with a value (0 for an empty panel)."""
    return panel.agg(F.countDistinct("t").alias("n_times"), F.countDistinct("asset").alias("n_assets"), F.coalesce(F.try_divide(F.count(value), F.count("*")), F.lit(0.0)).alias("coverage"))


def count_per_row(panel: DataFrame, value: str) -> DataFrame:
    return panel.groupBy("t", "ts").agg(F.count(value).alias("n"))


def select_assets(panel: DataFrame, assets: Iterable[str]) -> DataFrame:
    """The named assets with their place in the request (pos); unknown names are an error."""
    wanted = list(assets)
    known = {r.asset for r in panel.where(F.col("asset").isin(wanted)).select("asset").distinct().collect()}
    if set(wanted) - known:
        raise PanelError(f"unknown assets: {sorted(set(wanted) - known)}")
    return panel.where(F.col("asset").isin(wanted)).withColumn("pos", F.array_position(F.array(*[F.lit(a) for a in wanted]), F.col("asset")).cast("int") - 1)


def slice_time(panel: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows by position with Python's slice rules; t counts from 0 again."""
    if (start or 0) < 0 or (stop or 0) < 0:
        n = panel.agg(F.coalesce(F.max("t") + 1, F.lit(0))).first()[0]
        start, stop, _ = slice(start, stop).indices(n)
    start = start or 0
    out = panel.where(F.col("t") >= start)
    return (out if stop is None else out.where(F.col("t") < stop)).withColumn("t", F.col("t") - start)


def between(panel: DataFrame, start, end) -> DataFrame:
    """Rows from start to end, both included; t stays."""
    return panel.where(F.col("ts").between(F.lit(start), F.lit(end)))


def align(*panels: DataFrame) -> DataFrame | list[DataFrame]:
    """Panels on their common times and assets, as one table (fields must differ); one panel stays as it is.
    Panels without a common time and asset are refused, which costs a look at the first row."""
    if len(panels) == 1:
        return panels[0]
    out = panels[0].drop("t")
    for p in panels[1:]:
        clash = set(out.columns) & set(p.columns) - {"ts", "asset", "t"}
        if clash:
            raise PanelError(f"fields in several panels: {sorted(clash)}")
        out = out.join(p.drop("t"), ["ts", "asset"])
    if out.isEmpty():
        raise PanelError("the panels share no time and asset")
    # panels are dense, so each common asset has all common times
    place = (F.row_number().over(Window.partitionBy("asset").orderBy("ts")) - 1).cast("int")
    return out.select(place.alias("t"), "ts", "asset", *[c for c in out.columns if c not in ("ts", "asset")])
