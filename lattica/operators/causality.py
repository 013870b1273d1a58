"""Proof that a signal does not read the future: by its expression, and by perturbing the tail.

Perturbations are drawn from the md5 of a cell's keys and a seed, which any other engine can
repeat, so that what a check finds can be held against SQL.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import CausalityViolation
from lattica.plans.signal import Signal, add_signals

#: A signal, or a function from panel to (t, asset, value). A function with a parameter `run` takes many panels
#: at once, told apart by the columns it names, and returns these columns too.
Target = Signal | Callable[..., DataFrame]
RUN = ("cut", "seed")


@dataclass(frozen=True)
class CausalityReport:
    causal: bool
    checks: int
    first: tuple[int, str, int] | None = None  # t, asset, cut
    changed: int = 0  # values, over all perturbations

    def describe(self) -> str:
        if self.causal:
            return f"causal: {self.checks} perturbations left every earlier value as it was"
        t, asset, cut = self.first
        return f"reads the future: value of {asset} at t={t} changed with data from t={cut} on"


def draw(*keys: str | int) -> Column:
    """0 to 2^32 - 1 from columns (by name) and numbers: the first 8 hex digits of the md5 of their texts, joined by colons."""
    text = F.concat_ws(":", *[F.lit(str(k)) if isinstance(k, int) else F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def perturbed(panel: DataFrame, fields: Sequence[str], runs: DataFrame) -> DataFrame:
    """The panel once for each of runs (cut, seed). From cut on, times are shuffled, values scaled by 2 to 10
    and some lost; what is earlier stays."""
    times = panel.select("t").distinct().join(runs, F.col("t") >= F.col("cut"))  # as many rows as times and runs
    order = lambda name, *by: times.withColumn(name, F.row_number().over(Window.partitionBy(*RUN).orderBy(*by)))
    moved = order("__n", F.col("t")).join(order("__n", draw("t", "seed"), F.col("t")).withColumnRenamed("t", "__from"), [*RUN, "__n"]).drop("__n")
    chance = lambda salt: draw("t", "asset", "seed", salt) % 10_000 / F.lit(10_000.0)
    others = [c for c in panel.columns if c not in fields]
    cells = panel.select(F.col("t").alias("__from"), "asset", *fields)
    tail = moved.join(panel.select(*others), "t").join(cells, ["__from", "asset"], "left").drop("__from")
    tail = tail.withColumns({f: F.when(chance(i + 1) >= 0.15, F.col(f) * (2 + 8 * chance(0))) for i, f in enumerate(fields)})
    head = panel.join(runs, F.col("t") < F.col("cut"))
    return head.select(*RUN, *panel.columns).unionByName(tail.select(*RUN, *panel.columns))


def _takes_runs(target: Target) -> bool:
    return "run" in inspect.signature(target).parameters


def _computed(target: Target, panel: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    if isinstance(target, Signal):
        return add_signals(panel, {"value": target}, run=run).select(*run, "t", "asset", "value")
    return (target(panel, run=run) if _takes_runs(target) else target(panel)).select(*run, "t", "asset", "value")


def changes(target: Target, panel: DataFrame, fields: Sequence[str], plan: Sequence[tuple[int, int]], tolerance: float = 1e-12) -> DataFrame:
    """cut, seed, t, asset, value, other of the values before their cut that differ after a perturbation (cut, seed)
    of plan. Signals and functions that take runs are one plan; another function is called for each perturbation."""
    table = lambda rows: panel.sparkSession.createDataFrame(list(rows), "cut int, seed int")
    here = F.col("t") < F.col("cut")
    scale = F.coalesce(F.max(F.abs("value")).over(Window.partitionBy("t")), F.lit(0.0))
    own = _computed(target, panel).withColumn("__scale", scale).join(table(plan), here)
    if isinstance(target, Signal) or _takes_runs(target):
        other = _computed(target, perturbed(panel, fields, table(plan)), RUN)
    else:
        other = None
        for cut, seed in plan:
            made = _computed(target, perturbed(panel, fields, table([(cut, seed)])).drop(*RUN)).withColumns({"cut": F.lit(cut), "seed": F.lit(seed)})
            other = made if other is None else other.unionByName(made)
    other = other.where(here).withColumnRenamed("value", "other").withColumn("__b", F.lit(1))
    both = own.withColumn("__a", F.lit(1)).join(other, [*RUN, "t", "asset"], "full")
    near = F.abs(F.col("value") - F.col("other")) <= tolerance * F.greatest(F.abs("value"), F.abs("other"), F.col("__scale"))
    same = F.col("value").eqNullSafe(F.col("other")) | F.coalesce(near, F.lit(False))
    return both.where(F.col("__a").isNull() | F.col("__b").isNull() | ~same).drop("__a", "__b", "__scale")


def check_causality(target: Target, panel: DataFrame, fields: Sequence[str], cut_points: Sequence[int] | None = None, seed: int = 0, trials: int = 3, tolerance: float = 1e-12) -> CausalityReport:
    """Recomputes the target with perturbed tails. Missing must stay missing; a value may differ by
    `tolerance` of the largest magnitude of its time, as sums in another order leave differences
    of that size where values cancel."""
    n = panel.agg(F.coalesce(F.max("t") + 1, F.lit(0))).first()[0]
    if n < 4:
        raise ValueError(f"need at least 4 times to cut, got {n}")
    cuts = sorted({max(1, min(n - 1, c)) for c in (cut_points or (n // 8, n // 4, n // 2, 3 * n // 4, n - 2))})
    if trials < 1:
        raise ValueError(f"trials must be positive, got {trials}")
    plan = [(cut, seed + trial) for cut in cuts for trial in range(trials)]
    found = changes(target, panel, fields, plan, tolerance).agg(F.min(F.struct("t", "asset", "cut")).alias("m"), F.count("*").alias("n")).first()
    first = found.m
    return CausalityReport(first is None, len(plan), None if first is None else (first.t, first.asset, first.cut), found.n)


def assert_causal(target: Target, panel: DataFrame, fields: Sequence[str], **options: object) -> CausalityReport:
    if isinstance(target, Signal) and target.reads_future:
        raise CausalityViolation(f"{target.label} is built on future rows")
    report = check_causality(target, panel, fields, **options)
    if not report.causal:
        raise CausalityViolation(report.describe())
    return report
