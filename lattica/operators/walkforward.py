"""Folds and walk-forward evaluation: all folds run in one plan, told apart by a key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.errors import PanelError
from lattica.operators.backtest import CostModel, backtest, summary
from lattica.plans.signal import Signal, add_signals, field_of


@dataclass(frozen=True)
class Fold:
    train_start: int
    train_end: int
    test_start: int
    test_end: int
    warmup: int = 0

    def __post_init__(self) -> None:
        if not self.train_start < self.train_end <= self.test_start < self.test_end:
            raise PanelError(f"fold out of order: {self}")
        if self.warmup < 0:
            raise PanelError(f"warmup must be non-negative, got {self.warmup}")

    @property
    def signal_start(self) -> int:
        return self.test_start - self.warmup

    @property
    def usable(self) -> bool:
        return self.signal_start >= self.train_start

    @property
    def test_length(self) -> int:
        return self.test_end - self.test_start

    def train(self, panel: DataFrame) -> DataFrame:
        return panel.where(F.col("t").between(self.train_start, self.train_end - 1))

    def signal_window(self, panel: DataFrame) -> DataFrame:
        return panel.where(F.col("t").between(self.signal_start, self.test_end - 1))

    def test(self, panel: DataFrame) -> DataFrame:
        return panel.where(F.col("t").between(self.test_start, self.test_end - 1))


def rolling_folds(n_times: int, train_size: int, test_size: int, warmup: int = 0, step: int | None = None) -> list[Fold]:
    step = test_size if step is None else step
    if train_size < 1 or test_size < 1 or step < 1:
        raise PanelError("train_size, test_size and step must be positive")
    if warmup >= train_size:
        raise PanelError(f"warmup {warmup} leaves nothing of a training window of {train_size}")
    if n_times < train_size + test_size:
        raise PanelError(f"{n_times} times do not hold one fold of {train_size} + {test_size}")
    return [Fold(s, s + train_size, s + train_size, s + train_size + test_size, warmup) for s in range(0, n_times - train_size - test_size + 1, step)]


def expanding_folds(n_times: int, initial_train: int, test_size: int, warmup: int = 0) -> list[Fold]:
    if warmup >= initial_train:
        raise PanelError(f"warmup {warmup} leaves nothing of a first training window of {initial_train}")
    if initial_train < 1 or test_size < 1 or n_times < initial_train + test_size:
        raise PanelError(f"{n_times} times do not hold one fold of {initial_train} + {test_size}")
    return [Fold(0, e, e, e + test_size, warmup) for e in range(initial_train, n_times - test_size + 1, test_size)]


def folds_frame(panel: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    rows = [(i, f.train_start, f.train_end, f.test_start, f.test_end, f.warmup, f.signal_start) for i, f in enumerate(folds)]
    return panel.sparkSession.createDataFrame(rows, "fold int, train_start int, train_end int, test_start int, test_end int, warmup int, signal_start int")


def equal_weight(price: str) -> Signal:
    """The default baseline: the same weight in everything that has a price."""
    return Signal("equal_weight", (field_of(price),), lambda k, a: F.when(a.isNotNull(), 1 / F.nullif(F.count(a).over(k.time()), F.lit(0))), "time")


@dataclass(frozen=True)
class WalkForward:
    """paths: strategy, fold, t and the backtest's columns; outcomes: one row for each fold."""

    paths: DataFrame
    outcomes: DataFrame

    def summary(self) -> DataFrame:
        """Scored, skipped and idle folds, genuine wins, win_rate, mean_excess and whether anything was tested."""
        scored = ~F.col("skipped")
        idle = scored & ~F.col("traded")
        return self.outcomes.agg(
            F.sum(scored.cast("int")).alias("scored"),
            F.sum(F.col("skipped").cast("int")).alias("skipped"),
            F.sum(idle.cast("int")).alias("no_ops"),
            F.sum(F.col("genuine_win").cast("int")).alias("genuine_wins"),
            F.coalesce(F.try_divide(F.sum(F.col("genuine_win").cast("int")), F.sum(scored.cast("int"))), F.lit(0.0)).alias("win_rate"),
            F.coalesce(F.avg(F.when(scored, F.col("excess"))), F.lit(0.0)).alias("mean_excess"),
            (F.sum((scored & F.col("traded")).cast("int")) > 0).alias("testable"),
        )


def walk_forward(panel: DataFrame, folds: Sequence[Fold], signal: Signal, price: str, costs: CostModel | None = None, baseline: Signal | None = None, execution_lag: int = 1, **options: object) -> WalkForward:
    """Signals see warm-up and test rows of their fold only, and only test rows are scored."""
    if not folds:
        raise PanelError("no folds")
    able = [i for i, f in enumerate(folds) if f.usable and f.test_end - f.signal_start > execution_lag and f.test_length > execution_lag]
    # each fold's times, as an array that becomes rows: the cells are joined by time
    table = folds_frame(panel, folds).where(F.col("fold").isin(able))
    times = table.select("fold", "test_start", F.explode(F.sequence("signal_start", F.col("test_end") - 1)).alias("t"))
    rows = panel.join(times, "t")
    made = add_signals(rows, {"__signal": signal, "__baseline": baseline or equal_weight(price)}, run=("fold",)).where(F.col("t") >= F.col("test_start"))
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"__{n}").alias("__w")) for n in ("signal", "baseline")]))
    cells = made.withColumn("__b", both).withColumns({"strategy": F.col("__b.strategy"), "__w": F.col("__b.__w")})
    paths = backtest(cells, "__w", price, costs, execution_lag=execution_lag, run=("strategy", "fold"), **options)
    totals = summary(paths, ("strategy", "fold"))
    side = lambda n, c: F.max(F.when(F.col("strategy") == n, F.col(c)))
    both = totals.groupBy("fold").agg(side("signal", "total_return").alias("signal_return"), side("baseline", "total_return").alias("baseline_return"), side("signal", "traded").alias("traded"))
    out = folds_frame(panel, folds).select("fold").join(both, "fold", "left")
    skipped = F.col("signal_return").isNull()
    excess = F.col("signal_return") - F.col("baseline_return")
    traded = F.coalesce("traded", F.lit(False))
    outcomes = out.select("fold", "signal_return", "baseline_return", excess.alias("excess"), traded.alias("traded"), skipped.alias("skipped"), F.coalesce(traded & (excess > 0), F.lit(False)).alias("genuine_win"))
    return WalkForward(paths, outcomes)
