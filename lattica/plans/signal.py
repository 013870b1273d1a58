"""Signals: lazy expressions over a dense panel (run keys, t, ts, asset, fields).

A node says on which axis it looks: a cell, an asset's time window, a time's cross-section, or an
asset's series by a kernel of its own (order statistics, and windows wider than WIDE: a window
frame computes each row's statistic anew, at a cost that grows with the window).
`add_signals` compiles a set of signals to stacked projections in which neighbouring nodes of
one axis share a window, so the plan has one exchange for each change of axis and none for
arithmetic. Missing values are NULL. Because nodes are data, reading the future can be proved
absent without running anything (`reads_future`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lattica.errors import PanelError
from lattica.functions.windows import Sliding, along_assets
from lattica.operators.panel import by_asset, by_time

#: Rows of a window up to which Spark's own frames compute sums, moments and extremes.
WIDE = 64


@dataclass(frozen=True)
class Keys:
    """Which columns tell independent runs apart (folds, strategies)."""

    run: tuple[str, ...] = ()

    def asset(self) -> WindowSpec:
        return Window.partitionBy(*self.run, "asset").orderBy("t")

    def time(self) -> WindowSpec:
        return Window.partitionBy(*self.run, "t")


@dataclass(frozen=True, eq=False)
class Signal:
    label: str
    inputs: tuple[Signal, ...]
    make: Callable[..., Column] = field(repr=False)
    axis: str = "cell"
    future: bool = False
    sliding: Sliding | None = None

    def __repr__(self) -> str:
        return self.label

    @property
    def reads_future(self) -> bool:
        return self.future or any(s.reads_future for s in self.inputs)

    def rename(self, label: str) -> Signal:
        return Signal(label, (self,), lambda k, v: v)

    # elementwise arithmetic; x/0 is infinite with x's sign and 0/0 is missing
    def _with(self, other: Signal | float, sign: str, make: Callable[[Column, Column], Column]) -> Signal:
        if isinstance(other, Signal):
            return Signal(f"({self.label} {sign} {other.label})", (self, other), lambda k, a, b: make(a, b))
        return Signal(f"({self.label} {sign} {other})", (self,), lambda k, a: make(a, F.lit(float(other))))

    def __add__(self, other: Signal | float) -> Signal:
        return self._with(other, "+", lambda a, b: a + b)

    def __sub__(self, other: Signal | float) -> Signal:
        return self._with(other, "-", lambda a, b: a - b)

    def __mul__(self, other: Signal | float) -> Signal:
        return self._with(other, "*", lambda a, b: a * b)

    def __truediv__(self, other: Signal | float) -> Signal:
        endless = lambda a: F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
        return self._with(other, "/", lambda a, b: F.when(b == 0, endless(a)).otherwise(F.try_divide(a, b)))

    def __neg__(self) -> Signal:
        return Signal(f"-{self.label}", (self,), lambda k, a: -a)

    def abs(self) -> Signal:
        return Signal(f"abs({self.label})", (self,), lambda k, a: F.abs(a))

    def clip(self, low: float | None = None, high: float | None = None) -> Signal:
        def make(k: Keys, a: Column) -> Column:
            out = a
            if low is not None:
                out = F.greatest(out, F.lit(float(low)))
            if high is not None:
                out = F.least(out, F.lit(float(high)))
            return F.when(a.isNotNull(), out)

        return Signal(f"clip({self.label})", (self,), make)

    def where(self, condition: Signal, otherwise: float | None = None) -> Signal:
        return Signal(f"where({self.label})", (self, condition), lambda k, a, c: F.when(c, a).otherwise(F.lit(otherwise).cast("double")))

    def fill_na(self, value: float) -> Signal:
        return Signal(f"fill({self.label})", (self,), lambda k, a: F.when(a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")), F.lit(float(value))).otherwise(a))

    def compare(self, make: Callable[[Column], Column]) -> Signal:
        """A condition on this signal, false where it is missing."""
        return Signal(f"cond({self.label})", (self,), lambda k, a: F.coalesce(make(a), F.lit(False)))

    # along time
    def shift(self, n: int = 1) -> Signal:
        if n < 0:
            raise PanelError(f"shift by {n} would read the future; use forward_returns for targets")
        return self if n == 0 else Signal(f"shift({self.label}, {n})", (self,), lambda k, a: F.lag(a, n).over(k.asset()), "asset")

    def pct_change(self, n: int = 1) -> Signal:
        if n < 1:
            raise PanelError(f"periods must be at least 1, got {n}")

        def make(k: Keys, a: Column) -> Column:
            before = F.lag(a, n).over(k.asset())
            return F.try_divide(a - before, F.nullif(before, F.lit(0.0)))

        return Signal(f"pct_change({self.label}, {n})", (self,), make, "asset")

    def log_return(self, n: int = 1) -> Signal:
        def make(k: Keys, a: Column) -> Column:
            before = F.lag(a, n).over(k.asset()) if n else a
            return F.when((a > 0) & (before > 0), F.log(F.try_divide(a, before)))

        return Signal(f"log_return({self.label}, {n})", (self,), make, "asset")

    def forward_returns(self, n: int = 1, skip: int = 0) -> Signal:
        """A target, never an input: the return from t + skip to t + skip + n."""
        if n < 1 or skip < 0:
            raise PanelError(f"periods must be at least 1, got {n}")

        def make(k: Keys, a: Column) -> Column:
            base = F.lead(a, skip).over(k.asset()) if skip else a
            return F.try_divide(F.lead(a, skip + n).over(k.asset()) - base, F.nullif(base, F.lit(0.0)))

        return Signal(f"forward({self.label}, {n})", (self,), make, "asset", future=True)

    def rolling(self, window: int, statistic: str = "mean", min_periods: int | None = None) -> Signal:
        """Trailing statistic over panel rows, skipping missing values; std is of the population."""
        least = window if min_periods is None else min_periods
        if window < 1 or not 1 <= least <= window:
            raise PanelError(f"bad window {window} with min_periods {least}")
        if statistic not in _STATISTICS:
            raise PanelError(f"unknown statistic {statistic!r}; one of {sorted(_STATISTICS)}")

        label = f"rolling_{statistic}({self.label}, {window})"
        if statistic == "median" or window > WIDE:
            return series(label, self, Sliding(statistic, window, least))

        def make(k: Keys, a: Column) -> Column:
            frame = k.asset().rangeBetween(-(window - 1), 0)
            return F.when(F.count(a).over(frame) >= least, _STATISTICS[statistic](a, frame))

        return Signal(label, (self,), make, "asset")


def series(label: str, signal: Signal, sliding: Sliding) -> Signal:
    """A statistic of sliding windows along each asset, by the kernel."""
    return Signal(label, (signal,), lambda k, a: a, "series", sliding=sliding)


_STATISTICS: dict[str, Callable[[Column, WindowSpec], Column]] = {
    "mean": lambda a, f: F.avg(a).over(f),
    "std": lambda a, f: F.stddev_pop(a).over(f),
    "sum": lambda a, f: F.sum(a).over(f),
    "min": lambda a, f: F.min(a).over(f),
    "max": lambda a, f: F.max(a).over(f),
    "median": lambda a, f: F.median(a).over(f),
}


def field_of(name: str) -> Signal:
    """A column of the panel."""
    return Signal(name, (), lambda k: F.col(f"`{name}`"))


def add_signals(panel: DataFrame, signals: dict[str, Signal], run: tuple[str, ...] = ()) -> DataFrame:
    """The panel with one column for each signal."""
    keys = Keys(run)
    order: list[Signal] = []
    seen: set[int] = set()

    def visit(s: Signal) -> None:
        if id(s) not in seen:
            seen.add(id(s))
            for i in s.inputs:
                visit(i)
            order.append(s)

    for s in signals.values():
        visit(s)
    names = {id(s): f"__s{i}" for i, s in enumerate(order)}
    # each axis is dealt to as many tasks as the panel's size asks for: tasks that were merged by the compressed size of
    # their rows would sort the whole of them once for every window of the axis
    out, done, axis, dealt = panel, set(), "asset", None
    while len(done) < len(order):
        ready = [s for s in order if id(s) not in done and all(id(i) in done for i in s.inputs)]
        # cells first, then the axis in hand, so that an axis changes only when it must
        for choice in ("cell", axis, "asset", "series", "time"):
            batch = [s for s in ready if s.axis == choice]
            if batch:
                axis = axis if choice == "cell" else choice
                break
        if batch[0].axis == "series":
            out = along_assets(out, {names[id(s)]: (names[id(s.inputs[0])], s.sliding) for s in batch}, run)
            dealt = "asset"
        else:
            if choice != "cell" and choice != dealt:
                out, dealt = (by_asset if choice == "asset" else by_time)(out, run), choice
            out = out.withColumns({names[id(s)]: s.make(keys, *[F.col(names[id(i)]) for i in s.inputs]) for s in batch})
        done |= {id(s) for s in batch}
    taken = [c for c in panel.columns if c not in signals]
    return out.select(*[F.col(f"`{c}`") for c in taken], *[F.col(names[id(s)]).alias(n) for n, s in signals.items()])
