"""Queries of the panel library over the star schema, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import preregistration, significance
from lattica.functions.journal import Journal
from lattica.operators import backtest as bt
from lattica.operators import causality, diagnostics, events, panel, universe, walkforward
from lattica.operators.cross_section import cs_demean, cs_neutralize, cs_rank, cs_scale, cs_winsorize, cs_zscore, ts_decay, ts_rank, ts_zscore
from lattica.plans.signal import Signal, add_signals, field_of
from lattica.sources.tables import brand_months, supplier_weeks
from lattica.sources.store import new_folder, stored
from lattica.streaming.latches import stream_liquidity, stream_price_floor
from lattica.streaming.replay import replayed
from lattica.sources.vendor import Dataset, check_point_in_time, ciz_cells, dataset_from_panel, keep_dataset, listings, load_extract, verify_extract

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CLOSE, ADV = field_of("close"), field_of("adv")
COSTS = bt.CostModel(spread_bps=10.0, impact_coefficient=0.0, commission_per_share=0.005)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _six(*columns: str) -> dict[str, Column]:
    return {c: F.round(c, 6) + F.lit(0.0) for c in columns}


# --- SQL parts -----------------------------------------------------------------------------

_GRID = """ax as (select ts, cast(row_number() over (order by ts) - 1 as integer) as t from (select distinct ts from m)),
panel as (select ax.t, ax.ts, a.asset, cast(m.cents as double) / m.qty as close, cast(m.cents as double) / 100 as adv
  from ax cross join (select distinct asset from m) a left join m on m.ts = ax.ts and m.asset = a.asset)"""
BRAND = f"""m as (select p_brand as asset, cast(date_trunc('month', l_shipdate) as date) as ts,
  sum(cast(round(l_extendedprice * 100) as bigint)) as cents, sum(l_quantity) as qty
  from lineitem join part on l_partkey = p_partkey group by 1, 2), {_GRID}"""
SUPPLIER = f"""m as (select cast(l_suppkey as varchar) as asset, cast(date_trunc('week', l_shipdate) as date) as ts,
  sum(cast(round(l_extendedprice * 100) as bigint)) as cents, sum(l_quantity) as qty from lineitem group by 1, 2), {_GRID}"""
A = "over (partition by asset order by t)"
X = "over (partition by t)"


def rows_(n: int) -> str:
    return f"over (partition by asset order by t rows between {n - 1} preceding and current row)"


def change(n: int, v: str = "close", k: str = "") -> str:
    w = f"over (partition by {k}asset order by t)"
    return f"({v} - lag({v}, {n}) {w}) / nullif(lag({v}, {n}) {w}, 0)"


def ranked(v: str = "v", k: str = "", least: int = 5) -> str:
    w = f"over (partition by {k}t)"
    return f"""case when {v} is null or count({v}) {w} < {least} then null else
  (rank() over (partition by {k}t order by {v} nulls last) + (count({v}) over (partition by {k}t, {v}) - 1) / 2.0 - 1) / nullif(count({v}) {w} - 1, 0) end"""


def ordinal(v: str, k: str = "", least: int = 5) -> str:
    """Twice the rank, an integer."""
    w = f"over (partition by {k}t)"
    return f"""case when {v} is null or count({v}) {w} < {least} then null else
  2 * rank() over (partition by {k}t order by {v} nulls last) + count({v}) over (partition by {k}t, {v}) - 1 end"""


def exact(x: str = "x", y: str = "y", least: int = 5) -> str:
    """Pearson correlation of integers where both are there, from exact sums."""
    pair = lambda p, q, r: f"cast(count({x}) * sum(cast({r} as hugeint)) - sum({p}) * sum({q}) as double)"
    return f"case when count({x}) >= {least} then {pair(x, y, f'{x} * {y}')} / nullif(sqrt({pair(x, x, f'{x} * {x}')} * {pair(y, y, f'{y} * {y}')}), 0) end"


def each(v: str, base: str = BRAND, value: str = "close") -> str:
    """(t, asset, v) of an expression over the panel."""
    return f"with {base}, s as (select t, asset, {v} as v from (select *, {value} as x from panel)) select t, asset, round(v, 6) + 0.0 as v from s"


# --- panel ---------------------------------------------------------------------------------


def _signal(spark: SparkSession, sf_dir: str, signal: Signal, base: Callable = brand_months) -> DataFrame:
    return add_signals(base(spark, sf_dir), {"v": signal}).select("t", "asset", "v").withColumns(_six("v"))


@query(f"with {BRAND} select t, ts, asset, round(close, 6) as close, round(adv, 6) as adv from panel")
def panel_base(spark, sf_dir):
    return brand_months(spark, sf_dir).withColumns(_six("close", "adv"))


@query(f"with {SUPPLIER} select count(distinct t) as n_times, count(distinct asset) as n_assets, round(count(close) / count(*), 6) as coverage from panel")
def panel_coverage(spark, sf_dir):
    return panel.coverage(supplier_weeks(spark, sf_dir), "close").withColumns(_six("coverage"))


@query(f"with {SUPPLIER} select t, ts, count(close) as n from panel group by all")
def breadth_per_row(spark, sf_dir):
    return panel.count_per_row(supplier_weeks(spark, sf_dir), "close")


@query(f"with {BRAND} select t - 10 as t, asset, round(close, 6) as close from panel where asset in ('Brand#11', 'Brand#12') and t >= 10 and t < 20")
def panel_slice(spark, sf_dir):
    rows = brand_months(spark, sf_dir).where(F.col("asset").isin("Brand#11", "Brand#12"))
    return panel.slice_time(rows, 10, 20).select("t", "asset", "close").withColumns(_six("close"))


@query(f"with {BRAND} select t, asset, round(close, 6) as close from panel where ts between date '1995-01-01' and date '1995-06-01'")
def panel_between(spark, sf_dir):
    return panel.between(brand_months(spark, sf_dir), "1995-01-01", "1995-06-01").select("t", "asset", "close").withColumns(_six("close"))


@query(f"""with {SUPPLIER}, a as (select ts, asset, close from panel where t < 200), b as (select ts, asset, adv from panel where t >= 100),
j as (select * from a join b using (ts, asset)), x as (select ts, row_number() over (order by ts) - 1 as t from (select distinct ts from j))
select cast(x.t as integer) as t, j.asset, round(close, 6) as close, round(adv, 6) as adv from j join x using (ts)""")
def panel_align(spark, sf_dir):
    base = supplier_weeks(spark, sf_dir)
    made = panel.align(base.where("t < 200").select("t", "ts", "asset", "close"), base.where("t >= 100").select("t", "ts", "asset", "adv"))
    return made.select("t", "asset", "close", "adv").withColumns(_six("close", "adv"))


@query(f"""with {BRAND}, s as (select t, asset, close * 2 - adv / 1000 + close / adv as v, -abs(close - 1000) as w,
  case when close is not null then least(greatest(close, 900), 1100) end as c, case when close > 1000 then adv else 0 end as d, coalesce(close, 0) as f from panel)
select t, asset, round(v, 6) + 0.0 as v, round(w, 6) + 0.0 as w, round(c, 6) as c, round(d, 6) as d, round(f, 6) as f from s""")
def panel_arithmetic(spark, sf_dir):
    made = {
        "v": CLOSE * 2 - ADV / 1000 + CLOSE / ADV,
        "w": -(CLOSE - 1000).abs(),
        "c": CLOSE.clip(900, 1100),
        "d": ADV.where(CLOSE.compare(lambda a: a > 1000), 0.0),
        "f": CLOSE.fill_na(0.0),
    }
    return add_signals(brand_months(spark, sf_dir), made).select("t", "asset", *made).withColumns(_six(*made))


@query("""with m as (select cast(date_trunc('year', o_orderdate) as date) as ts, o_orderpriority as asset, sum(cast(round(o_totalprice * 100) as bigint)) as c from orders where o_orderstatus = 'P' group by 1, 2)
select cast(a.t as integer) as t, a.ts, b.asset, cast(m.c as double) as v from (select ts, row_number() over (order by ts) - 1 as t from (select distinct ts from m)) a cross join (select distinct asset from m) b left join m on m.ts = a.ts and m.asset = b.asset""")
def panel_from_rows(spark, sf_dir):
    """A small table by year and priority, gathered and handed over as rows of a matrix."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'P'")
    made = orders.groupBy(F.to_date(F.date_trunc("year", "o_orderdate")).alias("ts"), F.col("o_orderpriority").alias("asset")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("v"))
    cells = {(r.ts, r.asset): r.v for r in made.collect()}  # years times priorities
    days, names = (sorted({k[i] for k in cells}) for i in (0, 1))
    return panel.from_rows(spark, [[cells.get((d, n)) for n in names] for d in days], days, names)


@query(f"with {BRAND} select t, asset, cast(case asset when 'Brand#12' then 0 else 1 end as integer) as pos, round(close, 6) as close from panel where asset in ('Brand#12', 'Brand#11')")
def panel_select(spark, sf_dir):
    return panel.select_assets(brand_months(spark, sf_dir), ["Brand#12", "Brand#11"]).select("t", "asset", "pos", "close").withColumns(_six("close"))


@query("""with r as (select cast(date_trunc('month', l_shipdate) as date) as ts, cast(l_suppkey as varchar) as asset, first(l_quantity order by l_orderkey, l_linenumber) as v from lineitem group by 1, 2),
ax as (select ts, cast(row_number() over (order by ts) - 1 as integer) as t from (select distinct ts from r))
select ax.t, ax.ts, a.asset, cast(r.v as double) as v from ax cross join (select distinct asset from r) a left join r on r.ts = ax.ts and r.asset = a.asset""")
def long_to_panel(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"), "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber")
    return panel.long_to_panel(rows, "day", "l_suppkey", "l_quantity", ["l_orderkey", "l_linenumber"])


# --- signals along time and across assets --------------------------------------------------

_TIME: dict[str, tuple[Signal, str]] = {
    "shift": (CLOSE.shift(2), f"lag(close, 2) {A}"),
    "pct_change": (CLOSE.pct_change(3), change(3)),
    "log_return": (CLOSE.log_return(1), f"ln(close / lag(close) {A})"),
    "forward_returns": (CLOSE.forward_returns(2), f"(lead(close, 2) {A} - close) / nullif(close, 0)"),
    **{
        f"rolling_{name}": (CLOSE.rolling(12, name, 6), f"case when count(close) {rows_(12)} >= 6 then {f}(close) {rows_(12)} end")
        for name, f in (("mean", "avg"), ("std", "stddev_pop"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("median", "median"))
    },
    **{
        f"rolling_{name}_wide": ((CLOSE / 1000.0).rolling(104, name, 52), f"case when count(close) {rows_(104)} >= 52 then {f}(close / 1000) {rows_(104)} end")
        for name, f in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"), ("median", "median"))
    },
    "ts_rank_wide": (ts_rank(CLOSE, 52), f"case when count(close) {rows_(52)} = 52 then (" + " + ".join(f"case when lag(close, {i}) {A} < close then 1 else 0 end" for i in range(1, 52)) + ") / 51.0 end"),
    "ts_zscore": (ts_zscore(CLOSE, 12), f"case when count(close) {rows_(12)} = 12 then (close - avg(close) {rows_(12)}) / nullif(stddev_pop(close) {rows_(12)}, 0) end"),
    "ts_decay": (ts_decay(CLOSE, 6), f"case when count(close) {rows_(6)} = 6 then (" + " + ".join(f"{6 - i} * lag(close, {i}) {A}" for i in range(6)) + ") / 21.0 end"),
    "ts_rank": (ts_rank(CLOSE, 8), f"case when count(close) {rows_(8)} = 8 then (" + " + ".join(f"case when lag(close, {i}) {A} < close then 1 else 0 end" for i in range(1, 8)) + ") / 7.0 end"),
}
_WIDE = f"case when close is not null and count(close) {X} >= 5 then "
_ACROSS: dict[str, tuple[Signal, str]] = {
    "cs_rank": (cs_rank(CLOSE), ranked("close")),
    "cs_demean": (cs_demean(CLOSE), f"{_WIDE} close - avg(close) {X} end"),
    "cs_zscore": (cs_zscore(CLOSE), f"{_WIDE} (close - avg(close) {X}) / nullif(stddev_pop(close) {X}, 0) end"),
    "cs_winsorize": (cs_winsorize(CLOSE, 0.05), f"{_WIDE} greatest(least(close, quantile_cont(close, 0.95) {X}), quantile_cont(close, 0.05) {X}) end"),
    "cs_scale": (cs_scale(CLOSE - 1000.0), f"{_WIDE} (close - 1000) / nullif(sum(abs(close - 1000)) {X}, 0) end"),
}


def _add_signal(name: str, signal: Signal, sql: str, base: Callable, tables: str) -> None:
    def run(spark, sf_dir):
        return _signal(spark, sf_dir, signal, base)

    QUERIES[name] = run
    ORACLE[name] = each(sql, tables)


for _name, (_s, _sql) in (_TIME | _ACROSS).items():
    _add_signal(_name, _s, _sql, supplier_weeks, SUPPLIER)



@query(f"""with {BRAND}, j as (select t, asset, case when close is not null and adv is not null then close end as y, case when close is not null and adv is not null then adv end as x from panel),
s as (select t, asset, case when y is not null and count(y) {X} >= 5 then y - avg(y) {X} - coalesce(case when isnan(regr_slope(y, x) {X}) then 0 else regr_slope(y, x) {X} end, 0) * (x - avg(x) {X}) end as v from j)
select t, asset, round(v, 6) + 0.0 as v from s""")
def cs_neutralize_volume(spark, sf_dir):
    return _signal(spark, sf_dir, cs_neutralize(CLOSE, ADV))


MOMENTUM = cs_scale(cs_demean(cs_rank(CLOSE.pct_change(3))))


def momentum_sql(k: str = "", source: str = "panel", moves: str = "") -> str:
    """CTEs that end in `mom` with the columns of source and v."""
    w = f"over (partition by {k}t)"
    return f"""s1 as (select *, {moves or change(3, k=k)} as c from {source}), s2 as (select *, {ranked("c", k)} as rk from s1),
s3 as (select *, case when rk is not null and count(rk) {w} >= 5 then rk - avg(rk) {w} end as d from s2),
mom as (select *, case when d is not null and count(d) {w} >= 5 then d / nullif(sum(abs(d)) {w}, 0) end as v from s3)"""


@query(f"with {SUPPLIER}, {momentum_sql()} select t, asset, round(v, 6) + 0.0 as v from mom")
def momentum_stack(spark, sf_dir):
    return _signal(spark, sf_dir, MOMENTUM, supplier_weeks)


# --- universe ------------------------------------------------------------------------------


@query(f"""with {SUPPLIER}, l as (select asset, min(ts) as first, case when max(t) < 300 then max(ts) end as last from panel where close is not null and t between 50 and 320 group by asset)
select t, p.asset, coalesce(l.asset is not null and ts >= first and (last is null or ts <= last), false) as listed from panel p left join l on p.asset = l.asset""")
def listing_mask(spark, sf_dir):
    base = supplier_weeks(spark, sf_dir)
    known = base.where("close is not null and t between 50 and 320").groupBy("asset").agg(F.min("ts").alias("first"), F.when(F.max("t") < 300, F.max("ts")).alias("last"))
    return universe.listing_mask(base, known).select("t", "asset", "listed")


_LIQUID = f"""l1 as (select *, case when count(adv) {rows_(8)} >= 4 then avg(adv) {rows_(8)} end as adv_mean from panel),
l2 as (select *, coalesce(adv_mean >= 1000 and adv > 0, false) as able from l1),
l3 as (select *, case when able then row_number() over (partition by t order by able desc, adv_mean desc nulls last, asset) end as rk from l2),
l4 as (select *, case when able and rk <= 12 then true when not able or rk > 32 then false end as ev from l3),
liq as (select *, coalesce(last_value(ev ignore nulls) over (partition by asset order by t rows unbounded preceding), false) as liquid from l4)"""


def _screened(spark, sf_dir):
    return universe.liquidity_screen(supplier_weeks(spark, sf_dir), "adv", top_n=20, min_dollar_volume=1000.0, window=8)


@query(f"with {SUPPLIER}, {_LIQUID} select t, asset, cast(rk as integer) as liquidity_rank, liquid from liq")
def liquidity_hysteresis(spark, sf_dir):
    return _screened(spark, sf_dir).select("t", "asset", "liquidity_rank", "liquid")


_PRICED = "coalesce(last_value(case when close >= 1080 then true when close < 900 then false end ignore nulls) over (partition by asset order by t rows unbounded preceding), false) and close is not null"


@query(f"with {SUPPLIER} select t, asset, {_PRICED} as priced from panel")
def price_floor(spark, sf_dir):
    return universe.price_floor_screen(supplier_weeks(spark, sf_dir), "close", 900.0).select("t", "asset", "priced")


def _streamed(rows: DataFrame, stream: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Rows (t, ts, asset, ...) in ten micro-batches, up to four weeks out of order, with t found again by ts. stream is
    also told the number of buckets that holds some 256 assets each."""
    timed = rows.withColumn("ts", F.to_timestamp("ts"))
    last = timed.agg(F.max("t").alias("t"), F.max("ts").alias("ts"), F.approx_count_distinct("asset").alias("assets")).first()
    late = F.pmod(F.xxhash64("t", "asset"), F.lit(5))
    arrival = F.floor((F.col("t") + late) * 10 / ((last.t or 0) + 5))
    closing = timed.sparkSession.createDataFrame([(last.ts, "")], "ts timestamp, asset string")
    closing = closing.select(*[(F.col("ts") + F.expr("interval 60 days") if c == "ts" else F.col(c) if c == "asset" else F.lit(None).cast(timed.schema[c].dataType)).alias(c) for c in timed.columns])
    made = replayed(timed, arrival, lambda cells: stream(cells, last.assets // 256 + 1), closing)
    # as many rows as cells on both sides, though their files may be small: neither is broadcast
    return made.hint("merge").join(timed.select("t", "ts", "asset"), ["ts", "asset"]).select("t", "asset", *[c for c in made.columns if c not in ("ts", "asset")])


@query(f"with {SUPPLIER} select t, asset, {_PRICED} as priced from panel")
def price_floor_stream(spark, sf_dir):
    """The screen of price_floor, its cells coming late and out of order."""
    return _streamed(stored(supplier_weeks(spark, sf_dir).select("t", "ts", "asset", "close")), lambda cells, n: stream_price_floor(cells, "close", 900.0, late="28 days", buckets=n))


@query(f"with {SUPPLIER}, {_LIQUID} select t, asset, liquid from liq")
def liquidity_stream(spark, sf_dir):
    """Memberships from a stream of ranks; the ranks are a batch's."""
    return _streamed(stored(_screened(spark, sf_dir).select("t", "ts", "asset", "liquidity_rank")), lambda cells, n: stream_liquidity(cells, 12, 32, late="28 days", buckets=n))


_MEMBER = f"{_LIQUID}, mem as (select *, liquid and {_PRICED} as member from liq)"


def _universe(spark, sf_dir):
    return universe.combine(universe.price_floor_screen(_screened(spark, sf_dir), "close", 900.0), "liquid", "priced")


@query(f"with {SUPPLIER}, {_MEMBER} select t, asset, round(case when member then close end, 6) as close from mem")
def universe_apply(spark, sf_dir):
    return universe.apply_universe(_universe(spark, sf_dir), "close").select("t", "asset", "close").withColumns(_six("close"))


@query(f"""with {SUPPLIER}, {_MEMBER}, d as (select *, lag(member) {A} as b from mem),
y as (select t, sum(member::int) as n, sum((member and not b)::int) as i, sum((not member and b)::int) as o from d group by t),
z as (select round(avg(n), 6) as mean_members, min(n)::bigint as min_members, max(n)::bigint as max_members, coalesce(sum(i), 0)::bigint as entries, coalesce(sum(o), 0)::bigint as exits, count(*) as n_times from y)
select *, round((entries + exits) / greatest(1, n_times - 1), 6) as churn, exits = 0 and mean_members > 0 as survivorship_filtered, (entries + exits) / greatest(1, n_times - 1) > 2 as churns_fast from z""")
def universe_audit(spark, sf_dir):
    return universe.audit(_universe(spark, sf_dir)).withColumns(_six("mean_members", "churn"))


_DAY = "1996-01-01"


@query(f"with {SUPPLIER}, {_MEMBER} select asset from mem where ts = date '{_DAY}' and member")
def universe_members(spark, sf_dir):
    return universe.members_on(_universe(spark, sf_dir), _DAY)


# --- diagnostics ---------------------------------------------------------------------------

_HORIZONS = (1, 2, 5)


def _ic(horizons: tuple[int, ...], signal: str = "s1.c") -> str:
    parts = [
        f"""select {h} as horizon, t, asset, {ordinal("c")} as a, {ordinal("f")} as b from (select *, {change(3)} as c, (lead(close, {h}) {A} - close) / nullif(close, 0) as f from panel)"""
        for h in horizons
    ]
    return f"""r as ({" union all ".join(parts)}), j as (select horizon, t, case when b is not null then a end as x, case when a is not null then b end as y from r),
ics as (select horizon, t, count(x) as breadth, {exact()} as ic from j group by horizon, t)"""


CHANGE = CLOSE.pct_change(3)


@query(f"with {SUPPLIER}, {_ic(_HORIZONS)} select horizon, t, round(ic, 6) + 0.0 as ic, breadth from ics")
def ic_decay(spark, sf_dir):
    return diagnostics.information_coefficient(supplier_weeks(spark, sf_dir), CHANGE, "close", _HORIZONS).withColumns(_six("ic"))


@query(f"""with {SUPPLIER}, {_ic(_HORIZONS)}, q as (select horizon, count(ic) as n, avg(ic) as mean, stddev_samp(ic) as std, avg((ic > 0)::int) as hit_rate from ics where ic is not null group by horizon),
z as (select *, mean / std as icir, mean / std * sqrt(n) as t_stat from q)
select horizon, n, round(mean, 6) + 0.0 as mean, round(std, 6) as std, round(hit_rate, 6) as hit_rate, round(icir, 6) + 0.0 as icir, round(t_stat, 6) + 0.0 as t_stat,
 case when n < 20 then 'too few observations' when abs(mean) > 0.15 then 'implausibly strong: look for leakage' when abs(t_stat) < 2 then 'indistinguishable from noise' when mean < 0 then 'negative: predicts the reverse' else 'plausible' end as verdict from z""")
def ic_summary(spark, sf_dir):
    ics = diagnostics.information_coefficient(supplier_weeks(spark, sf_dir), CHANGE, "close", _HORIZONS)
    return diagnostics.ic_summary(ics).withColumns(_six("mean", "std", "hit_rate", "icir", "t_stat"))


_BUCKETS = f"""q as (select t, {ranked("c")} as rk, f from (select *, {change(3)} as c, (lead(close) {A} - close) / nullif(close, 0) as f from panel)),
w as (select *, count(*) {X} as n from q where rk is not null and f is not null),
b as (select least(cast(floor(rk * 5) as integer), 4) as bucket, avg(f) as mean_return, count(*) as n from w where n >= 5 group by 1)
select g.bucket, round(mean_return, 6) + 0.0 as mean_return, coalesce(n, 0) as n from (select cast(unnest(range(5)) as integer) as bucket) g left join b on g.bucket = b.bucket"""


@query(f"with {BRAND}, {_BUCKETS}")
def quantile_spread(spark, sf_dir):
    return diagnostics.quantile_spread(brand_months(spark, sf_dir), CHANGE, "close").withColumns(_six("mean_return"))


@query(f"""with {BRAND}, {_BUCKETS.replace('select g.bucket', ', bk as (select g.bucket')}), rk as (select *, rank() over (order by mean_return, bucket) - 1 as place from bk)
select round(max(mean_return) filter (where bucket = 4) - max(mean_return) filter (where bucket = 0), 6) + 0.0 as spread, round(corr(bucket, place), 6) + 0.0 as monotonicity,
 abs(max(mean_return) filter (where bucket = 3) - max(mean_return) filter (where bucket = 1)) / abs(max(mean_return) filter (where bucket = 4) - max(mean_return) filter (where bucket = 0)) < 0.3 as one_tail from rk""")
def quantile_report(spark, sf_dir):
    report = diagnostics.QuantileReport.of(diagnostics.quantile_spread(brand_months(spark, sf_dir), CHANGE, "close").withColumns(_six("mean_return")))
    return spark.createDataFrame([(round(report.spread, 6) + 0.0, round(report.monotonicity, 6) + 0.0, report.driven_by_one_tail)], "spread double, monotonicity double, one_tail boolean")


@query(f"""with {SUPPLIER}, r as (select t, asset, {ordinal("c")} as a from (select *, {change(3)} as c from panel)), l as (select t, a, lag(a) {A} as b from r),
j as (select t, case when b is not null then a end as x, case when a is not null then b end as y from l),
c as (select t, {exact()} as ic from j group by t)
select round(coalesce(avg(ic), 0), 6) + 0.0 as autocorrelation from c""")
def rank_autocorrelation(spark, sf_dir):
    return diagnostics.autocorrelation(supplier_weeks(spark, sf_dir), CHANGE).withColumns(_six("autocorrelation"))


@query(f"""with {SUPPLIER}, {_ic((1,))} select round(avg(ic) * sqrt(avg(breadth) * 252), 6) + 0.0 as information_ratio from ics where ic is not null""")
def fundamental_law(spark, sf_dir):
    ics = diagnostics.information_coefficient(supplier_weeks(spark, sf_dir), CHANGE, "close")
    return diagnostics.allowed_information_ratio(ics).withColumns(_six("information_ratio"))


@query(f"""with {SUPPLIER}, {_ic(_HORIZONS)}, {_BUCKETS.replace('select g.bucket', ', bk as (select g.bucket')}), ac as (select t, asset, {ordinal("c")} as a from (select *, {change(3)} as c from panel)), al as (select t, a, lag(a) {A} as b from ac),
aj as (select t, case when b is not null then a end as x, case when a is not null then b end as y from al), au as (select t, {exact()} as ic from aj group by t),
hz as (select horizon, count(ic) as n, avg(ic) as mean, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) as t_stat, avg((ic > 0)::int) as hit, avg(breadth) as breadth from ics where ic is not null group by horizon),
f as (select 'ic_mean' as section, horizon as key, mean as value, n, case when n < 20 then 'too few observations' when abs(mean) > 0.15 then 'implausibly strong: look for leakage' when abs(t_stat) < 2 then 'indistinguishable from noise' when mean < 0 then 'negative: predicts the reverse' else 'plausible' end as note from hz
 union all select 'ic_t_statistic', horizon, t_stat, n, null from hz union all select 'ic_hit_rate', horizon, hit, n, null from hz union all select 'ic_breadth', horizon, breadth, n, null from hz
 union all select 'autocorrelation', 0, avg(ic), count(ic), null from au having count(ic) > 0 union all select 'quantile', bucket, mean_return, n, null from bk)
select section, key, round(value, 6) + 0.0 as value, n, note from f""")
def diagnosis(spark, sf_dir):
    return diagnostics.diagnosis(supplier_weeks(spark, sf_dir), CHANGE, "close", _HORIZONS).withColumns(_six("value"))


# --- costs and backtests -------------------------------------------------------------------


@query(f"""with {SUPPLIER}, x as (select t, abs(coalesce({change(1)}, 0)) * 1000 as notional, close, adv from panel),
y as (select t, notional, case when close > 0 then notional / close else 0 end as shares, case when adv > 0 then notional / adv end as sh, notional > 0 and not coalesce(adv > 0, false) as blind from x),
z as (select t, sum(notional * 0.00015) / 1000 as spread, sum(0.1 / sqrt(252) * sqrt(case when blind then 1 else least(greatest(coalesce(sh, 0), 0), 1) end) * notional) / 1000 as impact, sum(shares * 0.01) / 1000 as commission, max(case when blind then 1.0 else coalesce(sh, 0) end) as peak from y group by t)
select t, round(spread, 6) as spread, round(impact, 6) as impact, round(commission, 6) as commission, round(peak, 6) as peak, round(spread + impact + commission, 6) as total, peak > 0.1 as strained from z""")
def cost_charge(spark, sf_dir):
    moved = add_signals(supplier_weeks(spark, sf_dir), {"traded": CLOSE.pct_change(1).fill_na(0.0)}).withColumns({"equity": F.lit(1000.0), "vol": F.lit(0.0)})
    out = bt.charge(moved, bt.CostModel(commission_per_share=0.01), price="close")
    return out.withColumns(_six("spread", "impact", "commission", "peak", "total"))


@query(f"""with {BRAND}, c as (select asset, avg(adv) as adv from panel group by asset)
select asset, round(adv * power((0.002 - 0.00015) / (0.25 / sqrt(252)), 2), 4) as capacity from c""")
def capacity(spark, sf_dir):
    model = bt.CostModel()
    unit = model.capacity_notional(20.0, 1.0, 0.25)
    return brand_months(spark, sf_dir).groupBy("asset").agg(F.round(F.avg("adv") * unit, 4).alias("capacity"))


def held_sql(source: str, k: str = "", exit_: float = -0.3) -> str:
    """CTEs from source (t, asset, w, p) to `b8`: positions of a book that earns nothing in gaps."""
    a, past, x = f"over (partition by {k}asset order by t)", f"over (partition by {k}asset order by t rows unbounded preceding)", f"over (partition by {k}t)"
    return f"""b1 as (select *, case when p is not null then coalesce(w, 0) end as target, (p - lag(p) {a}) / nullif(lag(p) {a}, 0) as r, max(case when p is not null then t end) over (partition by {k}asset) as last_t from {source}),
b2 as (select *, lag(target) {a} * r as move from b1), b3 as (select *, greatest(coalesce(sum(move) {x}, 0), -1) as gross from b2),
b4 as (select *, product(case when gross <= -1 then 1 else 1 + gross end) {past} as val from b3), b5 as (select *, last_value(case when p is not null then target * val end ignore nulls) {past} as base from b4),
b6 as (select *, case when p is not null then target when t <= last_t then coalesce(base / val, 0) else 0 end as held from b5),
b7 as (select *, coalesce(lag(held) {a}, 0) * case when gross <= -1 then 1 else (1 + coalesce(r, 0)) / (1 + gross) end as pre from b6),
b8 as (select *, t > coalesce(last_t, -1) and pre <> 0 as gone, case when p is not null then abs(held - pre) else 0 end as traded, {exit_} as exit_return from b7)"""


def daily_sql(k: str = "", half: float = 0.0005, fee: float = 0.005) -> str:
    """CTE `b9` from `b8`: what does not depend on the capital."""
    return f"""b9 as (select {k}t, first(gross) as gross, sum(case when gone then pre * exit_return else 0 end) as drag, sum(traded) as turnover, sum(traded) * {half} as spread,
  sum(case when p > 0 then traded / p else 0 end) * {fee} as commission, sum(gone::int)::bigint as delistings from b8 group by {k}t)"""


def wiped_sql(k: str = "", source: str = "b9i", initial: float = 1.0) -> str:
    """CTE `path` from daily rows with impact and peak; a wiped-out run stays at zero."""
    w = f"over ({'partition by ' + k.rstrip(', ') if k else ''} order by t rows between unbounded preceding and"
    names = ("gross", "drag", "spread", "impact", "commission", "net", "turnover", "peak")
    return f"""n1 as (select *, gross + drag - spread - impact - commission as net from {source}),
n2 as (select *, coalesce(min(1 + net) {w} 1 preceding) <= 0, false) as dead, min(1 + net) {w} current row) > 0 as alive, product(1 + net) {w} current row) as value_ from n1),
path as (select {k}t, {', '.join(f'case when dead then 0 else {c} end as {c}' for c in names)}, case when dead then 0 else delistings end as delistings, case when alive then {initial} * value_ else 0 end as equity from n2)"""


def path_sql(source: str, k: str = "", half: float = 0.0005, fee: float = 0.005, exit_: float = -0.3) -> str:
    """CTEs from source (t, asset, w, p) to `path`, without impact."""
    return f"{held_sql(source, k, exit_)}, {daily_sql(k, half, fee)}, b9i as (select *, 0.0 as impact, 0.0 as peak from b9), {wiped_sql(k)}"


_EXIT = "select *, v as w, case when asset = '7' and t > 200 then null else close end as p from mom"


def _traded(spark, sf_dir):
    """Momentum weights on supplier weeks; supplier 7 stops trading after week 200."""
    base = supplier_weeks(spark, sf_dir)
    made = add_signals(base, {"w": MOMENTUM})
    return made.withColumn("p", F.when(~((F.col("asset") == "7") & (F.col("t") > 200)), F.col("close")))


def _path(spark, sf_dir):
    return bt.backtest(_traded(spark, sf_dir), "w", "p", COSTS, delisting=-0.3)


_RUN = f"with {SUPPLIER}, {momentum_sql()}, src as ({_EXIT}), {path_sql('src')}"
_PATH_COLUMNS = ("gross", "drag", "spread", "commission", "net", "turnover", "equity")


@query(f"{_RUN} select t, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in _PATH_COLUMNS)}, delistings from path")
def backtest_path(spark, sf_dir):
    return _path(spark, sf_dir).select("t", *_PATH_COLUMNS, F.col("delistings").cast("long").alias("delistings")).withColumns(_six(*_PATH_COLUMNS))


@query(f"""{_RUN}, d as (select *, max(equity) over (order by t rows unbounded preceding) as peak_equity from path)
select round(greatest(product(1 + net), 0) - 1, 6) + 0.0 as total_return, round(avg(turnover) * 252, 6) as annual_turnover, sum(turnover) > 0 as traded, round(avg(net) / stddev_samp(net) * sqrt(252), 6) + 0.0 as sharpe,
 round(min(case when peak_equity > 0 then equity / peak_equity - 1 else 0 end), 6) + 0.0 as max_drawdown, round(sum(gross), 6) + 0.0 as gross, round(sum(spread + commission), 6) as costs, round(sum(drag), 6) + 0.0 as drag, sum(delistings)::bigint as delistings from d""")
def backtest_summary(spark, sf_dir):
    out = bt.summary(_path(spark, sf_dir)).withColumn("delistings", F.col("delistings").cast("long"))
    return out.withColumns(_six("total_return", "annual_turnover", "sharpe", "max_drawdown", "gross", "costs", "drag"))


@query(f"""with {SUPPLIER}, {momentum_sql()}, src as (select * replace (10 * w as w) from ({_EXIT})), {path_sql('src')}
select t, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in _PATH_COLUMNS)} from path""")
def backtest_wipeout(spark, sf_dir):
    """Ten times momentum: the book is lost on the way."""
    rows = _traded(spark, sf_dir).withColumn("w", F.col("w") * 10)
    return bt.backtest(rows, "w", "p", COSTS, delisting=-0.3).select("t", *_PATH_COLUMNS).withColumns(_six(*_PATH_COLUMNS))


@query(f"""{_RUN} select t, asset, round(held + 3e-8, 6) + 0.0 as held, round(traded + 3e-8, 6) + 0.0 as traded, gone from b8""")
def held_weights(spark, sf_dir):
    """Weights are often exact halves of a last digit, which engines round either way: both move off them."""
    cells = bt.cells_of(_traded(spark, sf_dir), "w", "p")
    return bt.held_weights(cells, 1, ()).select("t", "asset", "held", "traded", "gone").withColumns({c: F.round(F.col(c) + 3e-8, 6) + F.lit(0.0) for c in ("held", "traded")})


_MONTH = "over (partition by asset order by t rows between 19 preceding and current row)"


@query(f"""with recursive {SUPPLIER}, {momentum_sql()}, src as ({_EXIT}), {held_sql('src')}, {daily_sql(half=0.00015, fee=0.0)},
vol as (select t, asset, case when count(r) {_MONTH} = 20 then stddev_pop(r) {_MONTH} * sqrt(252) end as vol from b1),
tr as (select b8.t, list({{'w': traded, 'adv': adv, 's': greatest(coalesce(vol, 0), 0.1) / sqrt(252)}} order by b8.asset) as trades from b8 join vol on vol.t = b8.t and vol.asset = b8.asset where traded <> 0 group by b8.t),
st as (select b9.*, coalesce(trades, []) as trades from b9 left join tr on tr.t = b9.t),
cap as (select cast(-1 as integer) as t, cast(100000.0 as double) as capital, cast(0.0 as double) as impact, cast(0.0 as double) as peak
 union all select t, greatest(capital * (1 + gross + drag - spread - commission - now_), 0), case when capital > 0 then now_ else 0 end, case when capital > 0 then top_ else 0 end from (
  select st.t, capital, gross, drag, spread, commission, coalesce(list_sum([x.s * x.w * sqrt(case when coalesce(x.adv > 0, false) then least(x.w * capital / x.adv, 1) else 1 end) for x in trades]), 0) as now_,
   coalesce(list_max([case when coalesce(x.adv > 0, false) then x.w * capital / x.adv else 1 end for x in trades]), 0) as top_ from cap join st on st.t = cap.t + 1)),
b9i as (select b9.*, cap.impact, cap.peak from b9 join cap on cap.t = b9.t), {wiped_sql(initial=1e5)}
select t, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in (*_PATH_COLUMNS, 'impact', 'peak'))} from path""")
def backtest_impact(spark, sf_dir):
    path = bt.backtest(_traded(spark, sf_dir), "w", "p", bt.CostModel(), volume="adv", delisting=-0.3, initial_equity=1e5)
    return path.select("t", *_PATH_COLUMNS, "impact", "peak").withColumns(_six(*_PATH_COLUMNS, "impact", "peak"))


_SEGMENT = "over (partition by asset, seg order by t rows unbounded preceding)"


@query(f"""with recursive {SUPPLIER}, {momentum_sql()}, src as ({_EXIT}),
v1 as (select *, coalesce((p - lag(p) {A}) / nullif(lag(p) {A}, 0), 0.001) as r, case when p is not null then coalesce(w, 0) end as target, max(case when p is not null then t end) over (partition by asset) as last_t, count(p) over (partition by asset order by t rows unbounded preceding) as seg from src),
v2 as (select *, first(t) {_SEGMENT} as since, case when seg > 0 and t <= last_t then first(target) {_SEGMENT} * product(case when p is not null then 1 else 1 + r end) {_SEGMENT} else 0 end as own from v1),
v3 as (select *, lag(own) {A} * r as earned, lag(since) {A} as taken from v2),
v4 as (select t, taken, sum(earned) as c from v3 where earned is not null group by t, taken),
v5 as (select x.t, coalesce(list({{'s': taken, 'c': c}} order by taken) filter (where taken is not null), []) as terms from (select distinct t from v3) x left join v4 on v4.t = x.t group by x.t),
f as (select cast(-1 as integer) as t, cast([] as double[]) as vals, cast(0.0 as double) as gross
 union all select t, list_append(vals, case when gain / last_ <= -1 then last_ else last_ + gain end), greatest(gain / last_, -1) from (
  select v5.t, vals, coalesce(vals[len(vals)], 1.0) as last_, coalesce(list_sum([x.c * vals[x.s + 1] for x in terms]), 0) as gain from f join v5 on v5.t = f.t + 1)),
v6 as (select v3.*, f.gross, f.vals[v3.t + 1] as val, f.vals[v3.since + 1] as val0 from v3 join f on f.t = v3.t),
v7 as (select *, case when p is not null then target else coalesce(own * val0 / val, 0) end as held from v6),
v8 as (select *, coalesce(lag(held) {A}, 0) * case when gross <= -1 then 1 else (1 + r) / (1 + gross) end as pre from v7),
b8 as (select *, t > coalesce(last_t, -1) and pre <> 0 as gone, case when p is not null then abs(held - pre) else 0 end as traded, -0.3 as exit_return from v8), {daily_sql()}, b9i as (select *, 0.0 as impact, 0.0 as peak from b9), {wiped_sql()}
select t, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in _PATH_COLUMNS)} from path""")
def backtest_vendor_returns(spark, sf_dir):
    """Gaps earn 0.1 % a week by the vendor's word."""
    rows = add_signals(_traded(spark, sf_dir), {"ret": field_of("p").pct_change(1).fill_na(0.001)})
    path = bt.backtest(rows, "w", "p", COSTS, returns="ret", delisting=-0.3)
    return path.select("t", *_PATH_COLUMNS).withColumns(_six(*_PATH_COLUMNS))


# --- folds and walk-forward ----------------------------------------------------------------

_FOLD_ROWS = "select cast(g as integer) as fold, g * 12 as train_start, g * 12 + 24 as train_end, g * 12 + 24 as test_start, g * 12 + 36 as test_end, 6 as warmup, g * 12 + 18 as signal_start from (select unnest(range(0, cast(floor((n - 36) / 12) as bigint) + 1)) as g from (select count(distinct t) as n from panel))"


def _folds(base: DataFrame) -> list[walkforward.Fold]:
    return walkforward.rolling_folds(base.agg(F.countDistinct("t")).first()[0], 24, 12, 6)


@query(f"with {BRAND}, f as ({_FOLD_ROWS}) select fold, {', '.join(f'cast({c} as integer) as {c}' for c in ('train_start', 'train_end', 'test_start', 'test_end', 'warmup', 'signal_start'))} from f")
def folds_rolling(spark, sf_dir):
    base = brand_months(spark, sf_dir)
    return walkforward.folds_frame(base, _folds(base))


@query(f"with {BRAND} select cast(g as integer) as fold, 0 as train_start, cast(24 + g * 12 as integer) as train_end, cast(24 + g * 12 as integer) as test_start, cast(36 + g * 12 as integer) as test_end, 0 as warmup, cast(24 + g * 12 as integer) as signal_start from (select unnest(range(0, cast(floor((n - 36) / 12) as bigint) + 1)) as g from (select count(distinct t) as n from panel))")
def folds_expanding(spark, sf_dir):
    base = brand_months(spark, sf_dir)
    return walkforward.folds_frame(base, walkforward.expanding_folds(base.agg(F.countDistinct("t")).first()[0], 24, 12))


def _walk(spark, sf_dir):
    base = brand_months(spark, sf_dir)
    return walkforward.walk_forward(base, _folds(base), MOMENTUM, "close", COSTS)


_WALK = f"""with {BRAND}, f as ({_FOLD_ROWS}), pf as (select panel.*, f.fold, f.test_start from panel join f on t >= f.signal_start and t < f.test_end), {momentum_sql("fold, ", "pf")},
src as (select 'signal' as strategy, fold, t, asset, v as w, close as p from mom where t >= test_start union all select 'baseline', fold, t, asset, case when close is not null then 1.0 / count(close) over (partition by fold, t) end, close from mom where t >= test_start),
{path_sql("src", "strategy, fold, ", exit_=0.0)}, r as (select strategy, fold, greatest(product(1 + net), 0) - 1 as total, sum(turnover) > 0 as traded from path group by 1, 2),
o as (select f.fold, a.total as signal_return, b.total as baseline_return, a.total - b.total as excess, coalesce(a.traded, false) as traded, a.total is null as skipped, coalesce(a.traded and a.total > b.total, false) as genuine_win
 from f left join r a on a.fold = f.fold and a.strategy = 'signal' left join r b on b.fold = f.fold and b.strategy = 'baseline')"""


@query(f"{_WALK} select fold, round(signal_return, 6) + 0.0 as signal_return, round(baseline_return, 6) + 0.0 as baseline_return, round(excess, 6) + 0.0 as excess, traded, skipped, genuine_win from o")
def walk_forward(spark, sf_dir):
    return _walk(spark, sf_dir).outcomes.withColumns(_six("signal_return", "baseline_return", "excess"))


@query(f"""{_WALK} select sum((not skipped)::int)::bigint as scored, sum(skipped::int)::bigint as skipped, sum((not skipped and not traded)::int)::bigint as no_ops, sum(genuine_win::int)::bigint as genuine_wins,
 round(sum(genuine_win::int) / sum((not skipped)::int), 6) as win_rate, round(avg(excess), 6) + 0.0 as mean_excess, sum((not skipped and traded)::int) > 0 as testable from o""")
def walk_forward_summary(spark, sf_dir):
    return _walk(spark, sf_dir).summary().withColumns(_six("win_rate", "mean_excess"))


# --- events --------------------------------------------------------------------------------

_EVENTS = f"""ab as (select t, ts, asset, ret - avg(ret) {X} as abnormal from (select *, {change(1)} as ret from panel)),
ev as (select cast(t * 1000 + cast(asset as bigint) as bigint) as event_id, asset, t from (select *, {change(1, "adv")} as jump from panel) where jump > 1.5),
pl as (select * from ev where t - 3 >= 0 and t + 6 <= (select max(t) from panel)),
win as (select pl.event_id, cast(o.k as integer) as k, ab.abnormal from pl cross join (select unnest(range(-3, 7)) as k) o left join ab on ab.asset = pl.asset and ab.t = pl.t + o.k),
car as (select event_id, coalesce(sum(abnormal), 0) as car from win where k between 0 and 6 group by 1)"""


def _study(spark, sf_dir):
    base = add_signals(supplier_weeks(spark, sf_dir), {"ret": CLOSE.pct_change(1), "jump": ADV.pct_change(1)})
    found = base.where("jump > 1.5").select((F.col("t") * 1000 + F.col("asset").cast("long")).alias("event_id"), "asset", "ts")
    return events.event_study(base, found, "ret", pre=3, post=6)


@query(f"with {SUPPLIER}, {_EVENTS} select t, asset, round(abnormal, 6) + 0.0 as abnormal from ab")
def market_adjusted(spark, sf_dir):
    base = add_signals(supplier_weeks(spark, sf_dir), {"ret": CLOSE.pct_change(1)})
    return events.market_adjusted(base, "ret").select("t", "asset", "abnormal").withColumns(_six("abnormal"))


@query(f"with {SUPPLIER}, {_EVENTS} select event_id, round(car, 6) + 0.0 as car from car")
def event_car(spark, sf_dir):
    return _study(spark, sf_dir).car(0, 6).withColumns(_six("car"))


@query(f'with {SUPPLIER}, {_EVENTS} select k as "offset", round(avg(abnormal), 6) + 0.0 as mean_abnormal, count(abnormal) as n from win group by k')
def event_path(spark, sf_dir):
    return _study(spark, sf_dir).average_path().withColumns(_six("mean_abnormal"))


@query(f"""with {SUPPLIER}, {_EVENTS} select count(car) as n_events, round(avg(car), 6) + 0.0 as mean_car, round(stddev_samp(car), 6) as car_std, round(avg((car > 0)::int), 6) as win_rate, round(avg(car) / stddev_samp(car) * sqrt(count(car)), 6) + 0.0 as t_stat,
 (select round(avg((n > 1)::int), 6) from (select count(*) over (partition by t) as n from pl)) as clustering, (select count(*) from ev) - (select count(*) from pl) as dropped from car""")
def event_statistics(spark, sf_dir):
    return _study(spark, sf_dir).statistics(0, 6).withColumns(_six("mean_car", "car_std", "win_rate", "t_stat", "clustering"))


@query(f"""with {SUPPLIER}, {_EVENTS}, z as (select count(car) as n_events, avg(car) as mean_car, avg(car) / stddev_samp(car) * sqrt(count(car)) as t_statistic, avg((car > 0)::int) as win_rate, 2 * stddev_samp(car) / sqrt(count(car)) as detectable_car,
 (select avg((n > 1)::int) from (select count(*) over (partition by t) as n from pl)) as clustering, (select count(*) from ev) - (select count(*) from pl) as dropped from car),
r as (select *, (n_events < 30)::int + (mean_car < 0)::int + (abs(t_statistic) < 2)::int + (win_rate < 0.5)::int + (clustering > 0.5)::int + (dropped / (n_events + dropped) > 0.2)::int as n_reasons from z)
select case when n_reasons = 0 then 'SURVIVED' else 'KILLED' end as headline, n_events, cast(n_reasons as bigint) as n_reasons, round(mean_car, 6) + 0.0 as mean_car, round(t_statistic, 6) + 0.0 as t_statistic, round(win_rate, 6) as win_rate, round(clustering, 6) as clustering, round(detectable_car, 6) as detectable_car from r""")
def event_verdict(spark, sf_dir):
    v = events.evaluate(_study(spark, sf_dir), events.EventKillCriteria())
    row = (v.headline, v.n_events, len(v.reasons), *(round(x, 6) + 0.0 for x in (v.mean_car, v.t_statistic, v.win_rate, v.clustering, v.detectable_car)))
    return spark.createDataFrame([row], "headline string, n_events long, n_reasons long, mean_car double, t_statistic double, win_rate double, clustering double, detectable_car double")


# --- significance, causality, vendor files ---------------------------------------------------


@query(f"""{_RUN}, q as (select net, avg(net) over () as m from path), z as (select count(*) as n, avg(net) as m, stddev_samp(net) as s, avg(power(net - m, 3)) as c3, avg(power(net - m, 4)) as c4 from q)
select n, round(m / s, 6) + 0.0 as sharpe, round(c3 / power(s, 3), 6) + 0.0 as skew, round(c4 / power(s, 4), 6) as kurtosis from z""")
def sharpe_moments(spark, sf_dir):
    return significance.moments(_path(spark, sf_dir), "net").withColumns(_six("sharpe", "skew", "kurtosis"))


_TRIALS = (1, 2, 3, 5, 8)


def phi_sql(x: str) -> str:
    """The normal distribution function by its series."""
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum([exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) for k in range(0, 150)]))"


def _trial_paths(spark, sf_dir) -> DataFrame:
    """One backtest for each look-back of the momentum, told apart by trial."""
    made = add_signals(supplier_weeks(spark, sf_dir), {f"w{n}": cs_scale(cs_demean(cs_rank(CLOSE.pct_change(n)))) for n in _TRIALS})
    each_ = F.explode(F.array(*[F.struct(F.lit(n).alias("trial"), F.col(f"w{n}").alias("w")) for n in _TRIALS])).alias("x")
    cells = made.select("t", "ts", "asset", "close", each_).select("x.trial", "t", "ts", "asset", "close", "x.w")
    return bt.backtest(cells, "w", "close", COSTS, run=("trial",))


_TRIAL_SQL = f"""{SUPPLIER}, runs as (select trial, panel.* from panel cross join (select unnest([{', '.join(map(str, _TRIALS))}]) as trial)),
{momentum_sql("trial, ", "runs", "case trial " + " ".join(f"when {n} then {change(n, k='trial, ')}" for n in _TRIALS) + " end")},
src as (select trial, t, asset, v as w, close as p from mom), {path_sql("src", "trial, ", exit_=0.0)},
tr as (select trial, count(net) as n, avg(net) as m, stddev_samp(net) as s from path group by trial), sr as (select trial, n, m, s, coalesce(m / nullif(s, 0), 0) as sharpe from tr)"""


@query(f"with {_TRIAL_SQL} select cast(trial as integer) as trial, n, round(sharpe, 6) + 0.0 as sharpe from sr")
def trial_sharpes(spark, sf_dir):
    found = significance.moments(_trial_paths(spark, sf_dir), "net", ["trial"])
    return found.select("trial", "n", F.coalesce("sharpe", F.lit(0.0)).alias("sharpe")).withColumns(_six("sharpe"))


@query(f"""with recursive {_TRIAL_SQL}, best as (select * from sr order by sharpe desc, trial limit 1), k as (select count(*) as n, var_pop(sharpe) as v from sr),
targets as (select 1 - 1 / n as p, 'a' as which from k union all select 1 - 1 / (n * exp(1)), 'b' from k),
bis as (select which, p, cast(-10.0 as double) as lo, cast(10.0 as double) as hi, 0 as i from targets union all
 select which, p, case when below then mid else lo end, case when below then hi else mid end, i + 1 from (select *, {phi_sql('mid')} < p as below from (select *, (lo + hi) / 2 as mid from bis where i < 60))),
q as (select max(case when which = 'a' then (lo + hi) / 2 end) as qa, max(case when which = 'b' then (lo + hi) / 2 end) as qb from bis where i = 60),
mom4 as (select avg(power((net - m) / s, 3)) as skew, avg(power((net - m) / s, 4)) as kurt from path join best on path.trial = best.trial),
z as (select k.n as n_trials, best.trial, best.n, sharpe, sqrt(k.v) * ((1 - 0.5772156649015329) * qa + 0.5772156649015329 * qb) as bar, sqrt(greatest(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe)) as spread from best, k, q, mom4),
y as (select *, sharpe * sqrt(n - 1) / spread as z0, (sharpe - bar) * sqrt(n - 1) / spread as z1 from z)
select n_trials, cast(trial as integer) as best_trial, round(sharpe, 6) + 0.0 as sharpe, round({phi_sql('z0')}, 6) as probabilistic, round(bar, 6) as expected_max, round({phi_sql('z1')}, 6) as deflated, {phi_sql('z1')} >= 0.95 as survives from y""")
def deflated_sharpe(spark, sf_dir):
    trials = significance.deflation(_trial_paths(spark, sf_dir), "net", ["trial"])
    best = trials.orderBy(F.desc("sharpe"), "trial").limit(1)
    return best.select("n_trials", F.col("trial").alias("best_trial"), "sharpe", "probabilistic", "expected_max", "deflated", "survives").withColumns(_six("sharpe", "probabilistic", "expected_max", "deflated"))


_MONOTONE = _BUCKETS.replace("select g.bucket", ", bk as (select g.bucket") + "), rk as (select *, rank() over (order by mean_return, bucket) - 1 as place from bk)"


@query(f"""with e as (select (with {BRAND}, {_ic((1,))} select avg(ic) from ics where ic is not null) as ic, (with {BRAND}, {_ic((1,))} select avg(ic) / stddev_samp(ic) * sqrt(count(ic)) from ics where ic is not null) as t,
 (with {BRAND}, {_MONOTONE} select round(corr(bucket, place), 6) from rk) as mono, ({_WALK} select sum((not skipped)::int) from o) as scored, ({_WALK} select sum(genuine_win::int) / sum((not skipped)::int) from o) as win,
 ({_WALK} select sum((not skipped and traded)::int) > 0 from o) as testable, ({_WALK} select avg(turnover) * 12 from path where strategy = 'signal') as turnover),
v as (select *, list_filter([case when ic < 0.01 then 'min_ic' end, case when abs(t) < 2 then 'min_ic_t_statistic' end, case when mono < 0.5 then 'min_monotonicity' end, case when win < 0.5 then 'min_oos_fold_win_rate' end,
 case when turnover > 12 then 'max_annual_turnover' end, 'require_deflation_survival'], lambda x: x is not null) as broken, list_filter([case when scored = 0 then 'no_folds' end, case when scored > 0 and not testable then 'never_traded' end], lambda x: x is not null) as invalid from e)
select case when len(invalid) > 0 then 'invalid' when len(broken) > 0 then 'killed' else 'survived' end as verdict, array_to_string(case when len(invalid) > 0 then invalid else broken end, ',') as violations, cast(scored as bigint) as folds_scored from v""")
def preregistered_verdict(spark, sf_dir):
    """From panel to verdict: a claim, its evidence from diagnostics and walk-forward folds, and the bars."""
    base = brand_months(spark, sf_dir)
    claim = preregistration.Hypothesis(
        "brand momentum", "brands that rose for three months go on rising", preregistration.EdgeSource.INFORMATION_PROCESSING,
        "Buyers notice a brand's rise late, because price lists are compared once a quarter; until they do, those who hold the brand are paid by those who restock it.",
        "all brands with a price", horizon_bars=1, warmup_bars=6, parameters=("look-back",),
    )
    ic = diagnostics.ic_summary(diagnostics.information_coefficient(base, CHANGE, "close")).first()
    report = diagnostics.QuantileReport.of(diagnostics.quantile_spread(base, CHANGE, "close").withColumns(_six("mean_return")))
    walk = _walk(spark, sf_dir)
    folds = walk.summary().first()
    turnover = walk.paths.where("strategy = 'signal'").agg(F.avg("turnover") * 12).first()[0]
    evidence = preregistration.Evidence(ic.mean, ic.t_stat, round(report.monotonicity, 6), folds.win_rate, folds.scored, folds.testable, turnover, survived_deflation=False, trials_used=1, test_window_bars=12)
    verdict, violations = preregistration.assess(claim, evidence)
    return spark.createDataFrame([(verdict.value, ",".join(v.criterion for v in violations), folds.scored)], "verdict string, violations string, folds_scored long")


def _draw_sql(*keys: str) -> str:
    return "cast('0x' || substr(md5(concat_ws(':', " + ", ".join(keys) + ")), 1, 8) as bigint)"


def _shaken(field: str, salt: int) -> str:
    part = lambda n: f"({_draw_sql('m.t', 'p.asset', 'm.seed', str(n))} % 10000 / 10000.0::double)"
    return f"case when {part(salt)} >= 0.15 then {field} * (2 + 8 * {part(0)}) end as {field}"


_CAUSAL = f"""size as (select max(t) + 1 as n from panel), cuts as (select distinct greatest(1, least(n - 1, c)) as cut from (select n, unnest([n // 8, n // 4, n // 2, 3 * n // 4, n - 2]) as c from size)),
runs as (select cut, seed from cuts cross join (select unnest([0, 1, 2]) as seed)), times as (select distinct t, cut, seed from panel join runs on t >= cut),
o1 as (select *, row_number() over (partition by cut, seed order by t) as n from times), o2 as (select *, row_number() over (partition by cut, seed order by {_draw_sql('t', 'seed')}, t) as n from times),
m as (select o1.cut, o1.seed, o1.t, o2.t as origin from o1 join o2 using (cut, seed, n)),
shaken as (select cut, seed, t, asset, close, adv from panel join runs on t < cut union all select m.cut, m.seed, m.t, p.asset, {_shaken('close', 1)}, {_shaken('adv', 2)} from m join panel p on p.t = m.origin),
{momentum_sql("cut, seed, ", "shaken")}, forward as (select *, (lead(close) over (partition by cut, seed, asset order by t) - close) / nullif(close, 0) as v from shaken),
centred as (select *, close - avg(close) over (partition by cut, seed, asset) as v from shaken),
made as (select 'momentum' as signal, cut, seed, t, asset, v from mom union all select 'forward', cut, seed, t, asset, v from forward union all select 'centred', cut, seed, t, asset, v from centred)"""
_CAUSAL_OWN = f"""{momentum_sql()}, own as (select 'momentum' as signal, t, asset, v from mom union all select 'forward', t, asset, (lead(close) {A} - close) / nullif(close, 0) from panel
 union all select 'centred', t, asset, close - avg(close) over (partition by asset) from panel)"""


def _centred(rows: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """Prices less the mean of all their times: a look ahead that no expression shows."""
    return rows.withColumn("value", F.col("close") - F.avg("close").over(Window.partitionBy(*run, "asset")))


@query(f"""with {BRAND}, own_ as (with {_CAUSAL_OWN} select *, coalesce(max(abs(v)) over (partition by signal, t), 0) as scale from own), made_ as (with {_CAUSAL} select * from made),
d as (select made_.signal, made_.cut, made_.t, made_.asset, coalesce(own_.v = made_.v or abs(own_.v - made_.v) <= 1e-12 * greatest(abs(own_.v), abs(made_.v), scale), own_.v is null and made_.v is null) as same
  from made_ join own_ using (signal, t, asset) where t < cut)
select signal, signal = 'forward' as reads_future, bool_and(same) as causal, cast(15 as integer) as checks, count(*) filter (where not same) as changed,
 min(t) filter (where not same) as first_t, arg_min(asset, (t, asset, cut)) filter (where not same) as first_asset, arg_min(cut, (t, asset, cut)) filter (where not same) as first_cut from d group by signal""")
def causality_report(spark, sf_dir):
    """A signal that reads the past, a target, and a function that centres on the whole sample."""
    base = stored(brand_months(spark, sf_dir))
    checked = (("momentum", MOMENTUM), ("forward", CLOSE.forward_returns(1)), ("centred", _centred))
    rows = []
    for name, target in checked:
        found = causality.check_causality(target, base, ("close", "adv"))
        rows.append((name, isinstance(target, Signal) and target.reads_future, found.causal, found.checks, found.changed, *(found.first or (None, None, None))))
    return spark.createDataFrame(rows, "signal string, reads_future boolean, causal boolean, checks int, changed long, first_t int, first_asset string, first_cut int")


@query(f"""with {SUPPLIER}, v as (select t, ts, asset, close, {change(1)} as r from panel where close is not null),
c as (select *, first(close) over w as f, first(1 + coalesce(r, 0)) over w as g, product(1 + coalesce(r, 0)) over w as ch from v window w as (partition by asset order by ts rows unbounded preceding))
select ts, asset, round(case when t % 13 = 0 then null else f * ch / g end, 6) as close, round(r, 6) + 0.0 as ret from c""")
def vendor_chain(spark, sf_dir):
    rows = add_signals(supplier_weeks(spark, sf_dir).where("close is not null").withColumn("order", F.col("t")), {"dlyret": CLOSE.pct_change(1)})
    flagged = rows.withColumns({"dlyprc": F.col("close").cast("string"), "dlyret": F.col("dlyret").cast("string"), "dlyprcflg": F.when(F.col("t") % 13 == 0, " ba ").otherwise("TR"), "dlyvol": F.lit("1")})
    return ciz_cells(flagged.drop("close", "adv")).select("ts", "asset", "close", "ret").withColumns(_six("close", "ret"))


@query("""select quantile_cont(d, 0.5) as median_days, quantile_cont(d, 0.1) as p10_days, quantile_cont(d, 0.9) as p90_days, count(*) - count(d) as undated, count(*) as n
from (select date_diff('day', cast(o_orderdate as date), cast(s as date)) as d from orders left join (select l_orderkey, min(l_shipdate) as s from lineitem group by 1) on o_orderkey = l_orderkey)""")
def point_in_time_lag(spark, sf_dir):
    orders, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shipped = lines.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("rdq"))
    rows = orders.join(shipped, orders.o_orderkey == shipped.l_orderkey, "left").select(F.to_date("o_orderdate").alias("datadate"), F.to_date("rdq").alias("rdq"))
    return check_point_in_time(rows)


@query(f"""with {SUPPLIER} select asset, min(ts) as first_tradable, case when max(ts) < (select max(ts) from panel) then max(ts) end as last_tradable from panel where close is not null group by asset""")
def security_listings(spark, sf_dir):
    return listings(supplier_weeks(spark, sf_dir))


_SCREEN = f"""l0 as (select asset, min(ts) as first_, case when max(ts) < (select max(ts) from panel) then max(ts) end as last_ from panel where close is not null group by asset),
l1 as (select panel.*, first_, last_, first_ is not null and ts >= first_ and (last_ is null or ts <= last_) as listed, case when count(adv) {rows_(20).replace('asset', 'panel.asset')} >= 10 then avg(adv) {rows_(20).replace('asset', 'panel.asset')} end as adv_mean from panel left join l0 on l0.asset = panel.asset),
l2 as (select *, coalesce(adv_mean >= 1000000 and adv > 0, false) as able from l1),
l3 as (select *, case when able then row_number() over (partition by t order by able desc, adv_mean desc nulls last, asset) end as rk from l2),
l4 as (select *, coalesce(last_value(case when able and rk <= 600 then true when not able or rk > 1600 then false end ignore nulls) over (partition by asset order by t rows unbounded preceding), false) as liquid,
  coalesce(last_value(case when close >= 6 then true when close < 5 then false end ignore nulls) over (partition by asset order by t rows unbounded preceding), false) and close is not null as priced from l3),
l5 as (select t, asset, listed and liquid and priced as member from l4), l6 as (select *, lag(member) {A} as b from l5),
l7 as (select t, sum(member::int) as n, sum((member and not b)::int) as i, sum((not member and b)::int) as o from l6 group by t),
au as (select avg(n) as mean_members, min(n) as min_members, max(n) as max_members, coalesce(sum(i), 0) as entries, coalesce(sum(o), 0) as exits, (coalesce(sum(i), 0) + coalesce(sum(o), 0)) / greatest(1, count(*) - 1) as churn from l7)"""


@query(f"""with {SUPPLIER}, {_SCREEN}, r as (select *, {change(1)} as ret from panel), d as (select t, ts, count(close) as n, count(*) as cells from panel group by t, ts),
sp as (select greatest(date_diff('day', min(ts), max(ts)) / 365.25, 0.1) as years, max(cells) as assets, sum(n) / sum(cells) as coverage, (select count(last_) from l0) as gone from d),
big as (select r.t, r.ts, r.asset, close < 5 as cheap, last_ from r left join l0 on l0.asset = r.asset where abs(ret) > 0.5),
mv as (select count(*) as n, coalesce(avg(cheap::int), 0) as cheap, coalesce(avg((not coalesce(abs(date_diff('day', ts, last_)) <= 5, false))::int), 0) as away from big),
f as (select 'all' as section, 'attrition_per_year' as key, gone / assets / years as value, case when gone = 0 then 'FATAL' when gone / assets / years < 0.02 then 'FLAG' else 'OK' end as severity from sp
 union all select 'all', 'delisting_returns', 0, 'FLAG' union all select 'all', 'delisting_median', null, 'OK' union all select 'all', 'delisting_worse_than_half', 0, 'OK'
 union all select 'all', 'coverage', coverage, case when coverage < 0.5 then 'FLAG' else 'OK' end from sp
 union all select 'breadth', cast(year(ts) as varchar), median(n), case when median(n) < 30 then 'FLAG' else 'OK' end from d group by year(ts)
 union all select 'breadth', cast(year(ts) as varchar) || ' least', min(n), 'OK' from d group by year(ts)
 union all select 'moves', 'large', n, 'OK' from mv union all select 'moves', 'cheap', cheap, 'OK' from mv union all select 'moves', 'away_from_exit', away, case when away > 0.25 and cheap <= 0.6 then 'FLAG' else 'OK' end from mv
 union all select 'universe', 'mean_members', mean_members, 'OK' from au union all select 'universe', 'min_members', min_members, 'OK' from au union all select 'universe', 'max_members', max_members, 'OK' from au
 union all select 'universe', 'entries', entries, 'OK' from au union all select 'universe', 'exits', exits, 'OK' from au union all select 'universe', 'churn', churn, 'OK' from au)
select section, key, round(value, 6) + 0.0 as value, severity from f""")
def extract_findings(spark, sf_dir):
    return verify_extract(dataset_from_panel(supplier_weeks(spark, sf_dir))).withColumns(_six("value"))


@query(f"""with {SUPPLIER}, d as (select *, {change(1)} as ret from panel), l as (select asset, case when max(ts) < (select max(ts) from panel) then max(ts) end as last from panel where close is not null group by asset)
select count(distinct asset) as n_securities, count(distinct t) as n_sessions, round(date_diff('day', min(ts), max(ts)) / 365.25, 6) as years, round(count(close) / count(*), 6) as coverage, count(*) filter (where ret < -0.5) as crashes,
 (select median(n) from (select count(close) as n from panel group by t)) as median_breadth, (select count(last) from l) as delisted, (select count(last) = 0 from l) as survivorship_warning from d""")
def dataset_summary(spark, sf_dir):
    return dataset_from_panel(supplier_weeks(spark, sf_dir)).summary().withColumns(_six("years", "coverage"))


# --- files: both layouts written as CSV from lines, loaded, kept as Parquet by year ----------


#: Rows of a CSV file, about: a task sorts a file's rows.
_FILE_ROWS = 250_000


def _as_csv(rows: DataFrame, *order: str) -> str:
    """The rows in several files in a new folder, the more the more rows; the columns they are ordered by stay behind."""
    folder = new_folder(rows.sparkSession)
    files = max(4, -(-rows.count() // _FILE_ROWS))
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop(*order).write.option("header", True).csv(folder)
    return folder


def _with_securities(data: Dataset) -> DataFrame:
    kept = keep_dataset(data)
    both = kept.panel.join(kept.securities, "asset", "left")
    return both.select("t", "ts", "asset", "close", "close_raw", "adv", "ret", "first_tradable", "last_tradable", "delist_ret", "ticker").withColumns({"close": F.round(F.col("close") + 1e-8, 6)} | {c: F.round(c, 8) + F.lit(0.0) for c in ("close_raw", "adv", "ret", "delist_ret")})  # prices are cents over up to 50: exact in 7 digits, or moved off a half


def _file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.withColumns({"ok": F.col("l_orderkey"), "ln": F.col("l_linenumber"), "id": F.col("l_suppkey"), "day": F.to_date(F.date_trunc("week", "l_shipdate")), "price": F.try_divide(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")), "gain": F.round(F.col("l_discount").cast("double") - 0.05, 4)})


_LOADED = """ax as (select ts, cast(row_number() over (order by ts) - 1 as integer) as t from (select distinct ts from c)),
panel as (select ax.t, ax.ts, a.asset, close, close_raw, adv, ret from ax cross join (select distinct asset from c) a left join c on c.ts = ax.ts and c.asset = a.asset),
li as (select asset, min(ts) as first_tradable, case when max(ts) < (select max(ts) from ax) then max(ts) end as last_tradable from panel where close is not null group by asset)
select t, ts, panel.asset, round(close + 1e-8, 6) as close, round(close_raw, 8) as close_raw, round(adv, 8) as adv, round(ret, 8) + 0.0 as ret, first_tradable, last_tradable, round(delist_ret, 8) + 0.0 as delist_ret, ticker
from panel left join li on li.asset = panel.asset left join ex on ex.asset = panel.asset and li.asset is not null left join tk on tk.asset = panel.asset and li.asset is not null"""
_FILE_LINES = "select l_orderkey as ok, l_linenumber as ln, l_suppkey as id, cast(l_suppkey as varchar) as asset, cast(date_trunc('week', l_shipdate) as date) as ts, cast(l_extendedprice as double) / l_quantity as price, round(l_discount - 0.05, 4) as gain, l_quantity, l_returnflag, l_tax, l_extendedprice from lineitem"


@query(f"""with f as ({_FILE_LINES}), r as (select *, case when ln = 7 then null when ln = 5 then -price else price end as prc, case when ln = 1 and ok % 7 = 0 then null else gain end as ret,
  case when ln = 4 and l_returnflag = 'R' then -l_tax end as dlret, case when ln <> 2 then 'T' || asset || '-' || ln end as tick from f where id % 3 < 2 and id % 4 < 3),
c0 as (select ts, asset, first(prc order by ok, ln) as prc, first(l_quantity order by ok, ln) as vol, first(ret order by ok, ln) as ret from r group by 1, 2),
c as (select ts, asset, case when prc > 0 then prc end as close, abs(prc) as close_raw, vol * abs(prc) as adv, ret from c0),
ex as (select asset, last(dlret order by ok, ln) filter (where dlret is not null) as delist_ret from r group by 1),
tk as (select asset, last(tick order by ts, ok, ln) filter (where tick is not null) as ticker from r group by 1), {_LOADED}""")
def load_legacy_files(spark, sf_dir):
    """Lines as the older layout: several rows for a cell, of which the first in file order counts; negative prices,
    letters for returns, other shares and venues; exits by the last return in file order."""
    rows = _file_lines(spark, sf_dir).select(
        "ok",
        "ln",
        F.col("id").alias("PERMNO"),
        F.col("day").alias("date"),
        F.when(F.col("ln") == 7, None).when(F.col("ln") == 5, -F.col("price")).otherwise(F.col("price")).alias("PRC"),
        F.col("l_quantity").alias("VOL"),
        F.when((F.col("ln") == 1) & (F.col("ok") % 7 == 0), "C").otherwise(F.col("gain").cast("string")).alias("RET"),
        (10 + F.col("id") % 3).alias("SHRCD"),
        (1 + F.col("id") % 4).alias("EXCHCD"),
        F.when(F.col("ln") != 2, F.concat(F.lit("T"), F.col("id"), F.lit("-"), F.col("ln"))).alias("TICKER"),
        F.when(F.col("ln") == 4, F.when(F.col("l_returnflag") == "R", (-F.col("l_tax")).cast("string")).otherwise("A")).alias("DLRET"),
    )
    return _with_securities(load_extract(spark, _as_csv(rows, "ok", "ln")))


@query(f"""with f as ({_FILE_LINES}), r0 as (select *, case when ln <> 6 then price end as prc, case when ln <> 6 then gain end as gain_, row_number() over (partition by asset, ts order by ok, ln) as n from f),
r as (select *, row_number() over (partition by asset order by ts) as k from r0 where n = 1 and ln <> 3 and id % 4 < 3 and id % 5 > 0),
v as (select *, first(prc) over w as p0, first(1 + coalesce(gain_, 0)) over w as g0, product(1 + coalesce(gain_, 0)) over w as ch from r window w as (partition by asset order by ts rows unbounded preceding)),
c as (select ts, asset, case when ln not in (2, 6, 7) then p0 * ch / g0 end as close, prc as close_raw, l_extendedprice as adv, gain_ as ret from v),
ex as (select cast(s_suppkey as varchar) as asset, case when s_suppkey % 3 = 0 then -(s_suppkey % 10) / 20.0 else -(s_suppkey % 7) / 10.0 end as delist_ret from supplier where s_suppkey % 2 = 0),
tk as (select asset, last('T' || asset || '-' || ln order by ts) as ticker from r group by 1), {_LOADED}""")
def load_ciz_files(spark, sf_dir):
    """Lines as the newer layout and a table of delistings: repeated rows go before any filter, prices are chained from
    returns, flagged days have none, the last return of a delisting counts."""
    flag = F.when(F.col("ln") == 2, " ba").when(F.col("ln") == 6, "NT").when(F.col("ln") == 7, "DA").otherwise("TR")
    traded = F.col("ln") != 6
    rows = _file_lines(spark, sf_dir).select(
        "ok",
        "ln",
        F.col("id").alias("PERMNO"),
        F.col("day").alias("DlyCalDt"),
        F.when(traded, F.col("price")).alias("DlyPrc"),
        flag.alias("DlyPrcFlg"),
        F.col("l_quantity").alias("DlyVol"),
        F.col("l_extendedprice").alias("DlyPrcVol"),
        F.when(traded, F.col("gain")).alias("DlyRet"),
        F.when(F.col("ln") == 3, "ADR").otherwise("NS").alias("ShareType"),
        F.element_at(F.array(*map(F.lit, "NAQX")), (F.col("id") % 4 + 1).cast("int")).alias("PrimaryExch"),
        F.concat(F.lit("T"), F.col("id"), F.lit("-"), F.col("ln")).alias("Ticker"),
        F.when(F.col("id") % 5 == 0, "FUND").otherwise("EQTY").alias("SecurityType"),
        F.lit(" COM").alias("SecuritySubType"),
        F.lit("CORP").alias("IssuerType"),
        F.lit("Y").alias("USIncFlg"),
    )
    key = F.col("s_suppkey")
    gone = spark.read.parquet(f"{sf_dir}/supplier.parquet").where(key % 2 == 0).select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    last = F.when(key % 3 == 0, F.lit("B")).otherwise((-(key % 7) / 10).cast("string"))
    gone = gone.select(F.col("s_suppkey").alias("ok"), F.col("k").alias("ln"), key.alias("PERMNO"), F.when(F.col("k") == 0, (-(key % 10) / 20).cast("string")).otherwise(last).alias("DelRet"))
    return _with_securities(load_extract(spark, _as_csv(rows, "ok", "ln"), _as_csv(gone, "ok", "ln")))


# --- the journal ---------------------------------------------------------------------------

_REASON = "Suppliers whose parts are sent back lower their prices to move what is left, and buyers who can wait are paid for taking goods that others have no room for."
_CLAIMS = {
    flag: preregistration.Hypothesis(f"lines {flag}", f"lines with flag {flag} are discounted more", preregistration.EdgeSource.LIQUIDITY_PROVISION, _REASON, "all lines", 4, 2, ("flag",), trial_budget=budget)
    for flag, budget in (("A", 5), ("R", 1_000_000), ("X", 3))
}


@query(f"""with claims as (select flag, name, budget, substr(sha256(body), 1, 16) as fingerprint from (values {", ".join(f"('{f}', '{c.name}', {c.trial_budget}, '{c.text}')" for f, c in _CLAIMS.items())}) as v(flag, name, budget, body)),
t as (select l_returnflag as flag, l_suppkey, round(avg(l_discount) - 0.05, 6) as sharpe from lineitem group by 1, 2)
select fingerprint, name, cast(budget as bigint) as trial_budget, count(l_suppkey) as trials, max(sharpe) + 0.0 as best_sharpe, case when claims.flag = 'A' then 'invalid' end as verdict, count(l_suppkey) > budget as over_budget,
 (select count(*) from t where flag not in (select flag from claims)) as refused, 0 as faults
from claims left join t on t.flag = claims.flag group by fingerprint, name, budget, claims.flag""")
def journal_standing(spark, sf_dir):
    """Claims on return flags, a trial for each supplier, a verdict; trials of a flag without a claim are refused."""
    journal = Journal(spark, new_folder(spark))
    journal.register(*_CLAIMS.values())
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    marks = F.create_map(*[F.lit(x) for f, c in _CLAIMS.items() for x in (f, c.fingerprint)])
    trials = lines.groupBy("l_returnflag", "l_suppkey").agg(F.round(F.avg("l_discount") - 0.05, 6).cast("double").alias("sharpe"))
    trials = trials.select(F.coalesce(F.try_element_at(marks, F.col("l_returnflag")), F.col("l_returnflag")).alias("fingerprint"), "sharpe", F.col("l_suppkey").cast("string").alias("label"))
    stray = journal.unregistered(trials)
    journal.record_trials(trials.join(journal.claims().select("fingerprint"), "fingerprint", "left_semi"))
    journal.record_verdict(_CLAIMS["A"].fingerprint, preregistration.Verdict.INVALID, [preregistration.Violation("trial_budget_exceeded", "more suppliers than trials")])
    counted = stray.agg(F.count("*").alias("refused")).crossJoin(journal.faults().agg(F.count("*").cast("int").alias("faults")))  # one row each
    return journal.standing().crossJoin(counted).withColumn("best_sharpe", F.col("best_sharpe") + F.lit(0.0))
