"""Daily security files of two layouts as one wide panel, and checks of an extract.

A dataset is a panel (t, ts, asset, close, close_raw, adv, ret) and a security table (asset,
first_tradable, last_tradable, delist_ret, ticker). Columns are read as text, matched without
case and cast tolerantly: codes in numeric columns become NULL. File order, which decides
which of several rows counts, is kept as (file, block, row).
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.errors import DataError
from lattica.operators import universe
from lattica.operators.panel import dense_panel
from lattica.sources.store import new_folder, read_panel, stored, write_panel

# Codes of the vendor's files.
US_COMMON_SHARES = (10, 11)
MAJOR_EXCHANGES = (1, 2, 3)
CIZ_SHARE_TYPES = ("NS",)
CIZ_EXCHANGES = ("N", "A", "Q")
CIZ_COMMON_STOCK = {"securitytype": ("EQTY",), "securitysubtype": ("COM",), "issuertype": ("CORP",), "usincflg": ("Y",)}
QUOTE_ONLY_FLAGS = ("BA",)
NO_SESSION_FLAGS = ("NT", "SU", "MP", "HA")
DELISTING_PAYMENT_FLAGS = ("DA", "DP", "DM")
#: Columns that hold a delisting return, in order of preference.
DELISTING_COLUMNS = ("dlret", "delret", "delistingreturn", "dlyret")
#: Columns of the same files that hold a code or an amount; a return is never read from them.
NO_RETURN_COLUMNS = ("delrettype", "delamt")

_ORDER = ("__file", "__block", "__row")


@dataclass(frozen=True)
class Dataset:
    panel: DataFrame
    securities: DataFrame

    def summary(self) -> DataFrame:
        """One row: securities, sessions, years, coverage, median breadth, delisted, returns below -50 %,
        and whether nothing ever delisted."""
        # a dense panel has every asset at every time
        times = self.panel.groupBy("t", "ts").agg(F.count("*").alias("cells"), F.count("close").alias("n"), F.count_if(F.col("ret") < -0.5).alias("crashes"))
        cells = times.agg(
            F.coalesce(F.max("cells"), F.lit(0)).alias("n_securities"),
            F.count("*").alias("n_sessions"),
            (F.datediff(F.max("ts"), F.min("ts")) / 365.25).alias("years"),
            F.try_divide(F.sum("n"), F.sum("cells")).alias("coverage"),
            F.coalesce(F.sum("crashes"), F.lit(0)).alias("crashes"),
            F.percentile("n", F.lit(0.5)).alias("median_breadth"),
        )
        gone = self.securities.agg(F.count("last_tradable").alias("delisted"), (F.count("last_tradable") == 0).alias("survivorship_warning"))
        return cells.join(gone)  # one row each


def keep_dataset(data: Dataset, folder: str | None = None) -> Dataset:
    """The dataset as Parquet tables (the panel by year), in a new folder if none is given, read back from there."""
    spark = data.panel.sparkSession
    folder = folder or new_folder(spark)
    write_panel(data.panel, f"{folder}/panel")
    data.securities.write.mode("errorifexists").parquet(f"{folder}/securities")
    return open_dataset(spark, folder)


def open_dataset(spark: SparkSession, folder: str) -> Dataset:
    return Dataset(read_panel(spark, f"{folder}/panel").drop("year"), spark.read.parquet(f"{folder}/securities"))


def numeric(column: str | Column) -> Column:
    """A trimmed number; letter codes are NULL."""
    return F.trim(F.col(column) if isinstance(column, str) else column).try_cast("double")


def key(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)).try_cast("long").cast("string"), F.trim(F.col(column)))


def read_raw(spark: SparkSession, path: str, required: Sequence[str], renames: Mapping[str, str] | None = None) -> DataFrame:
    """All columns as text under lower-case names, with the rows' place in the files."""
    try:
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    except Exception as e:
        raise DataError(f"{path} cannot be read: {e}") from e
    back = {v.lower(): k.lower() for k, v in (renames or {}).items()}
    names = [back.get(c.lower(), c.lower()) for c in raw.columns]
    missing = [c for c in required if c not in names]
    if missing:
        raise DataError(f"{path} lacks columns {missing}; found {sorted(names)}")
    place = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")).withColumn("__row", F.monotonically_increasing_id())
    return place.toDF(*names, *_ORDER)


def _kept(rows: DataFrame, path: str) -> DataFrame:
    if rows.isEmpty():
        raise DataError(f"{path}: no rows survive the filters")
    return rows


def listings(panel: DataFrame) -> DataFrame:
    """asset, first_tradable, last_tradable: first and last date with a price; last is NULL on the extract's last date
    (in a dense panel every asset's last row)."""
    day = F.when(F.col("close").isNotNull(), F.col("ts"))
    own = panel.groupBy("asset").agg(F.min(day).alias("first_tradable"), F.max(day).alias("__last"), F.max("ts").alias("__end")).where("first_tradable is not null")
    return own.select("asset", "first_tradable", F.when(F.col("__last") < F.col("__end"), F.col("__last")).alias("last_tradable"))


def _tickers(rows: DataFrame) -> DataFrame:
    if "ticker" not in rows.columns:
        return rows.select("asset").distinct().withColumn("ticker", F.lit(None).cast("string"))
    return rows.groupBy("asset").agg(F.max_by("ticker", F.when(F.col("ticker").isNotNull(), F.struct("ts", *_ORDER))).alias("ticker"))


def _dataset(rows: DataFrame, delistings: DataFrame, cells: DataFrame) -> Dataset:
    panel = dense_panel(stored(cells))
    return Dataset(panel, listings(panel).join(delistings, "asset", "left").join(_tickers(rows), "asset", "left"))


def load_daily_legacy(spark: SparkSession, path: str, share_codes: Sequence[int] = US_COMMON_SHARES, exchange_codes: Sequence[int] = MAJOR_EXCHANGES, columns: Mapping[str, str] | None = None) -> Dataset:
    """The older layout: a negative price marks a day without a trade (its size still makes the volume's value)."""
    raw = read_raw(spark, path, ("permno", "date", "prc"), columns)
    rows = raw.withColumns({"asset": key("permno"), "ts": F.try_to_date("date")})
    for name, codes in (("shrcd", share_codes), ("exchcd", exchange_codes)):
        if name in rows.columns and codes:
            rows = rows.where(numeric(name).isin([float(c) for c in codes]))
    rows = _kept(rows, path)
    price = numeric("prc")
    optional = lambda c: numeric(c) if c in rows.columns else F.lit(None).cast("double")
    cells = rows.select("asset", "ts", F.when(price > 0, price).alias("close"), F.abs(price).alias("close_raw"), (optional("vol") * F.abs(price)).alias("adv"), optional("ret").alias("ret"), *_ORDER)
    first = F.min_by(F.struct("close", "close_raw", "adv", "ret"), F.struct(*_ORDER))
    cells = cells.groupBy("ts", "asset").agg(first.alias("c")).select("ts", "asset", "c.*")
    exits = rows.groupBy("asset").agg(F.max_by(optional("dlret"), F.when(optional("dlret").isNotNull(), F.struct(*_ORDER))).alias("delist_ret"))
    return _dataset(rows, exits, cells)


def ciz_cells(rows: DataFrame) -> DataFrame:
    """ts, asset, close (chained from returns), close_raw, adv, ret of rows in the newer layout with asset and ts."""
    has = rows.columns
    optional = lambda c: numeric(c) if c in has else F.lit(None).cast("double")
    cells = rows.withColumns({"close_raw": numeric("dlyprc"), "ret": optional("dlyret")})
    if "dlyret" in has:
        order = Window.partitionBy("asset").orderBy("ts")
        chain = F.product(1 + F.coalesce("ret", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
        begin = F.first(F.struct("close_raw", (1 + F.coalesce("ret", F.lit(0.0))).alias("g"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("close", begin["close_raw"] * F.try_divide(chain, begin["g"]))
    else:
        cells = cells.withColumn("close", F.col("close_raw"))
    adv = numeric("dlyprcvol") if "dlyprcvol" in has else optional("dlyvol") * F.abs("close")
    cells = cells.withColumn("adv", adv)
    if "dlyprcflg" in has:
        # last of all: a day without a trade has no price, but its return stays in the chain
        flag = F.upper(F.trim("dlyprcflg"))
        cells = cells.withColumn("close", F.when(~F.coalesce(flag.isin(*QUOTE_ONLY_FLAGS, *NO_SESSION_FLAGS, *DELISTING_PAYMENT_FLAGS), F.lit(False)), F.col("close")))
    else:
        warnings.warn("the extract has no price flag: quotes pass for trades", UserWarning, stacklevel=2)
    return cells.select("ts", "asset", "close", "close_raw", "adv", "ret")


def load_daily_ciz(spark: SparkSession, path: str, delisting_path: str | None = None, share_types: Sequence[str] = CIZ_SHARE_TYPES, exchanges: Sequence[str] = CIZ_EXCHANGES, common_shares_only: bool = True) -> Dataset:
    raw = read_raw(spark, path, ("permno", "dlycaldt", "dlyprc")).withColumns({"asset": key("permno"), "ts": F.try_to_date("dlycaldt")})
    # the first of repeated rows counts, before any filter
    first = F.row_number().over(Window.partitionBy("asset", "ts").orderBy(*_ORDER))
    rows = raw.withColumn("__n", first).where("__n = 1").drop("__n")
    for name, codes in (("sharetype", share_types), ("primaryexch", exchanges)):
        if name in rows.columns and codes:
            rows = rows.where(F.trim(name).isin(*codes))
    if common_shares_only:
        missing = [c for c in CIZ_COMMON_STOCK if c not in rows.columns]
        if missing:
            raise DataError(f"{path} lacks the classification columns {missing}")
        for name, codes in CIZ_COMMON_STOCK.items():
            rows = rows.where(F.trim(name).isin(*codes))
    rows = _kept(rows, path)
    exits = load_delistings(spark, delisting_path) if delisting_path else rows.select("asset").distinct().withColumn("delist_ret", F.lit(None).cast("double"))
    return _dataset(rows, exits, ciz_cells(rows))


def load_delistings(spark: SparkSession, path: str) -> DataFrame:
    """asset, delist_ret: the last return in file order."""
    raw = read_raw(spark, path, ("permno",))
    column = next((c for c in DELISTING_COLUMNS if c in raw.columns), None)
    if column is None:
        other = [c for c in NO_RETURN_COLUMNS if c in raw.columns]
        hint = f"; {other} hold a type or an amount, not a return" if other else ""
        raise DataError(f"{path} has no delisting-return column (tried {list(DELISTING_COLUMNS)}){hint}")
    rows = raw.select(key("permno").alias("asset"), numeric(column).alias("r"), *_ORDER).where("r is not null")
    return rows.groupBy("asset").agg(F.max_by("r", F.struct(*_ORDER)).alias("delist_ret"))


def dataset_from_panel(panel: DataFrame) -> Dataset:
    """A panel with close and adv as a dataset, written once; returns are the price's changes if there is no ret."""
    if "ret" not in panel.columns:
        before = F.lag("close").over(Window.partitionBy("asset").orderBy("t"))
        panel = panel.withColumn("ret", F.try_divide(F.col("close") - before, F.nullif(before, F.lit(0.0))))
    if "close_raw" not in panel.columns:
        panel = panel.withColumn("close_raw", F.col("close"))
    panel = stored(panel)
    none = listings(panel).withColumns({"delist_ret": F.lit(None).cast("double"), "ticker": F.lit(None).cast("string")})
    return Dataset(panel, none)


def check_point_in_time(fundamentals: DataFrame, fiscal: str = "datadate", report: str = "rdq") -> DataFrame:
    """One row: days from fiscal date to report (median, p10, p90) and rows without a report date."""
    missing = [c for c in (fiscal, report) if c not in fundamentals.columns]
    if missing:
        raise DataError(f"fundamentals lack {missing}: without a report date nothing says when they were known")
    if fundamentals.isEmpty():
        raise DataError("fundamentals have no rows: nothing says when they were known")
    lag = F.datediff(F.col(report), F.col(fiscal))
    out = fundamentals.agg(F.percentile(lag, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("p"), F.count_if(F.col(report).isNull()).alias("undated"), F.count("*").alias("n"))
    return out.select(F.get("p", 0).alias("median_days"), F.get("p", 1).alias("p10_days"), F.get("p", 2).alias("p90_days"), "undated", "n")


def is_new_layout(spark: SparkSession, path: str) -> bool:
    """Whether the header of a file has the date column of the newer layout."""
    try:
        header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    except Exception as e:
        raise DataError(f"{path} cannot be read: {e}") from e
    return "dlycaldt" in [c.lower() for c in header]


def load_extract(spark: SparkSession, path: str, delisting_path: str | None = None) -> Dataset:
    """A daily file of either layout, told apart by its columns, not its name."""
    if is_new_layout(spark, path):
        return load_daily_ciz(spark, path, delisting_path)
    return load_daily_legacy(spark, path)


# Bars of the verifier.
LOW_ATTRITION, THIN, LARGE_MOVE, NEAR_EXIT_DAYS, AWAY, CHEAP, CHEAP_SHARE, LEAST_COVERAGE = 0.02, 30, 0.5, 5, 0.25, 5.0, 0.6, 0.5
SEVERE, SCREEN_TOP = -0.5, 1000


def verify_extract(data: Dataset) -> DataFrame:
    """Findings (section, key, value, severity OK, FLAG or FATAL): attrition a year, delisting returns,
    breadth by year, large moves (of all of them: share away from an exit, share of cheap stocks), coverage,
    and a universe built from the extract (listed, liquid, above the price floor).
    The panel is read four times: keep_dataset or dataset_from_panel make it a stored table first."""
    p, s = data.panel, stored(data.securities)
    rows = lambda section, *items: F.explode(F.array(*[F.struct(F.lit(section).alias("section"), k.cast("string").alias("key"), v.cast("double").alias("value"), F.when(fatal, "FATAL").when(flag, "FLAG").otherwise("OK").alias("severity")) for k, v, fatal, flag in items])).alias("f")
    no, name, zero = F.lit(False), F.lit, F.lit(0.0)
    times = p.groupBy("t", "ts").agg(F.count("close").alias("n"), F.count("*").alias("cells"))
    span = times.agg(F.greatest(F.datediff(F.max("ts"), F.min("ts")) / 365.25, F.lit(0.1)).alias("years"), F.greatest(F.max("cells"), F.lit(1)).alias("assets"), F.coalesce(F.try_divide(F.sum("n"), F.sum("cells")), zero).alias("coverage"))
    gone = s.agg(F.count("last_tradable").alias("left"), F.count("delist_ret").alias("known"), F.count_if(F.col("delist_ret") < SEVERE).alias("severe"), F.median("delist_ret").alias("median"))
    rate = F.col("left") / F.col("assets") / F.col("years")
    whole = span.join(gone).select(  # one row each
        rows(
            "all",
            (name("attrition_per_year"), rate, F.col("left") == 0, rate < LOW_ATTRITION),
            (name("delisting_returns"), F.col("known"), no, F.col("known") == 0),
            (name("delisting_median"), F.col("median"), no, no),
            (name("delisting_worse_than_half"), F.col("severe"), no, (F.col("known") > 0) & (F.col("severe") == 0)),
            (name("coverage"), F.col("coverage"), no, F.col("coverage") < LEAST_COVERAGE),
        )
    )
    years = times.groupBy(F.year("ts").alias("y")).agg(F.percentile("n", F.lit(0.5)).alias("m"), F.min("n").alias("low"))
    breadth = years.select(rows("breadth", (F.col("y"), F.col("m"), no, F.col("m") < THIN), (F.concat(F.col("y"), F.lit(" least")), F.col("low"), no, no)))
    big = p.where(F.abs("ret") > LARGE_MOVE).select("ts", "asset", (F.col("close_raw") < CHEAP).alias("cheap")).join(s.select("asset", "last_tradable"), "asset", "left")
    near = F.coalesce(F.abs(F.datediff("ts", "last_tradable")) <= NEAR_EXIT_DAYS, no)
    share = lambda x: F.coalesce(F.try_divide(F.count_if(x), F.count("*")), zero)
    moves = big.agg(F.count("*").alias("n"), share(F.coalesce("cheap", no)).alias("cheap"), share(~near).alias("away"))
    moves = moves.select(rows("moves", (name("large"), F.col("n"), no, no), (name("cheap"), F.col("cheap"), no, no), (name("away_from_exit"), F.col("away"), no, (F.col("away") > AWAY) & (F.col("cheap") <= CHEAP_SHARE))))
    listed = universe.listing_mask(p, s.select("asset", F.col("first_tradable").alias("first"), F.col("last_tradable").alias("last")))
    screened = universe.price_floor_screen(universe.liquidity_screen(listed, "adv", top_n=SCREEN_TOP), "close_raw", CHEAP)
    found = universe.audit(universe.combine(screened, "listed", "liquid", "priced"))
    built = found.select(rows("universe", *[(name(c), F.col(c), no, no) for c in ("mean_members", "min_members", "max_members", "entries", "exits", "churn")]))
    return whole.unionByName(breadth).unionByName(moves).unionByName(built).select("f.*")


def exit_code(findings: DataFrame) -> int:
    """1 with a fatal finding, else 0."""
    return int(not findings.where("severity = 'FATAL'").isEmpty())
