"""Signals across assets at one time and ranks along time. A time with fewer than
min_breadth values has none (default 5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.errors import PanelError
from lattica.functions.windows import Sliding
from lattica.plans.signal import Keys, Signal, series

MIN_BREADTH = 5


def _across(name: str, signal: Signal, least: int, make: Callable[[Keys, Column], Column]) -> Signal:
    return Signal(f"{name}({signal.label})", (signal,), lambda k, a: F.when(a.isNotNull() & (F.count(a).over(k.time()) >= least), make(k, a)), "time")


def cs_rank(signal: Signal, min_breadth: int = MIN_BREADTH, pct: bool = True) -> Signal:
    """Rank with ties averaged; pct maps it to 0..1 with 1 the largest."""

    def make(k: Keys, a: Column) -> Column:
        ordered = k.time().orderBy(a.asc_nulls_last())
        rank = F.rank().over(ordered) + (F.count(a).over(ordered.rangeBetween(0, 0)) - 1) / 2.0
        n = F.count(a).over(k.time())
        return F.when(n > 1, (rank - 1) / F.nullif(n - 1, F.lit(0))).otherwise(rank) if pct else rank

    return _across("cs_rank", signal, min_breadth, make)


def cs_demean(signal: Signal, min_breadth: int = MIN_BREADTH) -> Signal:
    return _across("cs_demean", signal, min_breadth, lambda k, a: a - F.avg(a).over(k.time()))


def cs_zscore(signal: Signal, min_breadth: int = MIN_BREADTH) -> Signal:
    return _across("cs_zscore", signal, min_breadth, lambda k, a: F.try_divide(a - F.avg(a).over(k.time()), F.nullif(F.stddev_pop(a).over(k.time()), F.lit(0.0))))


def cs_winsorize(signal: Signal, limit: float = 0.01, min_breadth: int = MIN_BREADTH) -> Signal:
    """Clips to the interpolated quantiles limit and 1 - limit; limit 0 leaves everything as it is."""
    if not 0 <= limit < 0.5:
        raise PanelError(f"limit must lie in [0, 0.5), got {limit}")
    if limit == 0:
        return signal

    def make(k: Keys, a: Column) -> Column:
        ends = F.percentile(a, F.array(F.lit(limit), F.lit(1 - limit))).over(k.time())
        return F.greatest(F.least(a, F.get(ends, 1)), F.get(ends, 0))

    return _across("cs_winsorize", signal, min_breadth, make)


def cs_scale(signal: Signal, target: float = 1.0, min_breadth: int = MIN_BREADTH) -> Signal:
    """Scales the absolute values of a time to add up to target."""
    if target <= 0:
        raise PanelError(f"target must be positive, got {target}")
    return _across("cs_scale", signal, min_breadth, lambda k, a: F.try_divide(a, F.nullif(F.sum(F.abs(a)).over(k.time()), F.lit(0.0))) * target)


def cs_neutralize(signal: Signal, factor: Signal, min_breadth: int = MIN_BREADTH) -> Signal:
    """What a regression on the factor (with intercept) leaves; a constant factor leaves the demeaned signal."""

    def make(k: Keys, y: Column, x: Column) -> Column:
        both = y.isNotNull() & x.isNotNull()
        a, b = F.when(both, y), F.when(both, x)
        w = k.time()
        slope = F.coalesce(F.regr_slope(a, b).over(w), F.lit(0.0))
        slope = F.when(F.isnan(slope), F.lit(0.0)).otherwise(slope)
        return F.when(both & (F.count(a).over(w) >= min_breadth), a - F.avg(a).over(w) - slope * (b - F.avg(b).over(w)))

    return Signal(f"cs_neutralize({signal.label}, {factor.label})", (signal, factor), make, "time")


def ts_zscore(signal: Signal, window: int, min_periods: int | None = None) -> Signal:
    mean, std = signal.rolling(window, "mean", min_periods), signal.rolling(window, "std", min_periods)
    return Signal(f"ts_zscore({signal.label}, {window})", (signal, mean, std), lambda k, a, m, s: F.try_divide(a - m, F.nullif(s, F.lit(0.0))))


def ts_decay(signal: Signal, window: int) -> Signal:
    """Linearly weighted mean, today `window` times the oldest; needs a full window."""
    if window < 1:
        raise PanelError(f"window must be at least 1, got {window}")

    def make(k: Keys, a: Column) -> Column:
        frame = k.asset().rangeBetween(-(window - 1), 0)
        values = F.collect_list(a).over(frame)
        total = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(1).alias("i")), lambda acc, v: F.struct((acc["s"] + v * acc["i"]).alias("s"), (acc["i"] + 1).alias("i")), lambda acc: acc["s"])
        return F.when(F.count(a).over(frame) == window, total / (window * (window + 1) / 2))

    return Signal(f"ts_decay({signal.label}, {window})", (signal,), make, "asset")


def ts_rank(signal: Signal, window: int) -> Signal:
    """Share of the window's other values below today's; needs a full window."""
    if window < 1:
        raise PanelError(f"window must be at least 1, got {window}")

    below = series(f"below({signal.label}, {window})", signal, Sliding("below", window, window))
    return Signal(f"ts_rank({signal.label}, {window})", (below,), lambda k, a: a / float(max(1, window - 1)))
