"""What a signal predicts: rank correlation by horizon, quantile spreads, persistence."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import PanelError
from lattica.operators.cross_section import MIN_BREADTH, cs_rank
from lattica.plans.signal import Signal, add_signals, field_of
from lattica.sources.store import stored

HORIZONS = (1, 2, 5, 10, 20, 60)


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def rank_correlations(rows: DataFrame, a: str, b: str, by: Sequence[str], min_breadth: int = MIN_BREADTH) -> DataFrame:
    """Per group the Pearson correlation (ic) of two columns of ranks over rows with both, and their
    number (breadth); NULL below min_breadth or without variance. Ranks are halves, so twice their
    values are integers and their sums exact: a correlation of zero is zero, whatever the order of rows."""
    twice = lambda c: F.round(F.col(c) * 2).cast("long")
    both = rows.select(*by, twice(a).alias("x"), twice(b).alias("y")).withColumns({"x": F.when(F.col("y").isNotNull(), F.col("x")), "y": F.when(F.col("x").isNotNull(), F.col("y"))})
    x, y = F.col("x"), F.col("y")
    # products are summed in halves of 31 bits, so that sums of longs hold them for any number of rows; decimals only meet the sums
    halves = lambda v: (F.sum(F.shiftright(v, 31)), F.sum(v.bitwiseAND(F.lit(2**31 - 1))))
    sums = {"__x": F.sum(x), "__y": F.sum(y)} | {f"{n}{h}": part for n, v in (("__xx", x * x), ("__yy", y * y), ("__xy", x * y)) for h, part in zip("hl", halves(v))}
    out = both.groupBy(*by).agg(F.count(x).alias("breadth"), *[v.alias(n) for n, v in sums.items()])
    whole = lambda n: F.col(f"{n}h").cast("decimal(18,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col(f"{n}l").cast("decimal(19,0)")
    out = out.withColumns({n: whole(n).cast("decimal(28,0)") for n in ("__xx", "__yy", "__xy")})
    centred = lambda p, q, r: (F.col("breadth").cast("decimal(10,0)") * F.col(r).cast("decimal(28,0)") - F.col(p).cast("decimal(18,0)") * F.col(q).cast("decimal(18,0)")).cast("double")
    ic = F.try_divide(centred("__x", "__y", "__xy"), F.nullif(F.sqrt(centred("__x", "__x", "__xx") * centred("__y", "__y", "__yy")), F.lit(0.0)))
    return out.select(*by, F.when(F.col("breadth") >= min_breadth, ic).alias("ic"), "breadth")


def _ranked(panel: DataFrame, signal: Signal, price: str, horizons: Sequence[int], lag: int, least: int, before: int | None = None) -> DataFrame:
    """t, asset, and for each horizon the rank of the signal and of the forward return, each on its own valid set;
    the signal's rank `before` rows earlier as __then."""
    if lag < 1 or any(h < 1 for h in horizons):
        raise PanelError("horizon and execution_lag must be at least 1")
    forward = {h: field_of(price).forward_returns(h, skip=lag - 1) for h in horizons}
    clean = Signal("finite", (signal,), lambda k, a: _finite(a))
    rank = cs_rank(clean, least, pct=False)
    ranks = {"__rank": rank, **{f"__r{h}": cs_rank(f, least, pct=False) for h, f in forward.items()}}
    then = {} if before is None else {"__then": rank.shift(before)}
    return add_signals(panel, ranks | then | {"__share": cs_rank(clean, least), **{f"__f{h}": f for h, f in forward.items()}})


def _correlations(rows: DataFrame, targets: dict[int, str], min_breadth: int) -> DataFrame:
    """horizon, t, ic, breadth of the signal's ranks with several columns of ranks, in one aggregation."""
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("target")) for h, c in targets.items()]))
    return rank_correlations(rows.select("t", "__rank", each.alias("h")).select("t", "__rank", "h.horizon", "h.target"), "__rank", "target", ["horizon", "t"], min_breadth)


def information_coefficient(panel: DataFrame, signal: Signal, price: str, horizons: Sequence[int] = (1,), execution_lag: int = 1, min_breadth: int = MIN_BREADTH) -> DataFrame:
    """horizon, t, ic, breadth; all horizons in one pass over the panel."""
    rows = _ranked(panel, signal, price, horizons, execution_lag, min_breadth)
    return _correlations(rows, {h: f"__r{h}" for h in horizons}, min_breadth)


def ic_summary(ics: DataFrame) -> DataFrame:
    """Per horizon: n, mean, std (sample), icir, t_stat, hit_rate, verdict."""
    return _summary(ics).drop("mean_breadth")


def _summary(ics: DataFrame) -> DataFrame:
    out = ics.where("ic is not null").groupBy("horizon").agg(F.avg("breadth").alias("mean_breadth"), F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("int")).alias("hit_rate"))
    endless = F.when(F.col("mean") > 0, F.lit(math.inf)).when(F.col("mean") < 0, F.lit(-math.inf)).otherwise(0.0)
    ratio = F.when(F.col("std") > 0, F.try_divide(F.col("mean"), F.col("std"))).otherwise(endless)
    out = out.withColumn("icir", ratio).withColumn("t_stat", F.col("icir") * F.sqrt("n"))
    verdict = (
        F.when(F.col("n") < 20, "too few observations")
        .when(F.abs("mean") > 0.15, "implausibly strong: look for leakage")
        .when(F.abs("t_stat") < 2, "indistinguishable from noise")
        .when(F.col("mean") < 0, "negative: predicts the reverse")
        .otherwise("plausible")
    )
    return out.withColumn("verdict", verdict)


def quantile_spread(panel: DataFrame, signal: Signal, price: str, n_quantiles: int = 5, horizon: int = 1, execution_lag: int = 1, min_breadth: int = MIN_BREADTH) -> DataFrame:
    """bucket, mean_return, n: forward returns pooled over all cells of a bucket; empty buckets are NULL and 0."""
    if n_quantiles < 2:
        raise PanelError(f"need at least 2 quantiles, got {n_quantiles}")
    return _buckets(_ranked(panel, signal, price, (horizon,), execution_lag, min_breadth), n_quantiles, horizon, min_breadth)


def _buckets(rows: DataFrame, n_quantiles: int, horizon: int, min_breadth: int) -> DataFrame:
    both = rows.where(F.col("__share").isNotNull() & F.col(f"__f{horizon}").isNotNull())
    bucket = F.least(F.floor(F.col("__share") * n_quantiles), F.lit(n_quantiles - 1)).cast("int")
    wide = both.select(bucket.alias("bucket"), F.col(f"__f{horizon}").alias("f"), F.count("*").over(Window.partitionBy("t")).alias("breadth")).where(F.col("breadth") >= min_breadth)
    found = wide.groupBy("bucket").agg(F.avg("f").alias("mean_return"), F.count("*").alias("n"))
    all_ = rows.sparkSession.range(n_quantiles).select(F.col("id").cast("int").alias("bucket"))
    return all_.join(found, "bucket", "left").select("bucket", "mean_return", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class QuantileReport:
    means: tuple[float | None, ...]
    counts: tuple[int, ...]

    @classmethod
    def of(cls, buckets: DataFrame) -> QuantileReport:
        rows = buckets.orderBy("bucket").collect()  # as many rows as quantiles
        return cls(tuple(r.mean_return for r in rows), tuple(r.n for r in rows))

    @property
    def spread(self) -> float | None:
        first, last = self.means[0], self.means[-1]
        return None if first is None or last is None else last - first

    @property
    def monotonicity(self) -> float:
        """Correlation of the buckets' order with the order of their means; 0 below three buckets."""
        known = [(i, m) for i, m in enumerate(self.means) if m is not None and math.isfinite(m)]
        if len(known) < 3:
            return 0.0
        by_mean = sorted(range(len(known)), key=lambda i: known[i][1])
        place = {i: r for r, i in enumerate(by_mean)}
        centre = (len(known) - 1) / 2
        top = sum((i - centre) * (place[i] - centre) for i in range(len(known)))
        return top / sum((i - centre) ** 2 for i in range(len(known)))

    @property
    def driven_by_one_tail(self) -> bool:
        """Whether the inner buckets span far less of the spread than even grading would."""
        k = len(self.means)
        if k < 4 or any(m is None for m in self.means) or not self.spread:
            return False
        inner = abs(self.means[-2] - self.means[1]) / abs(self.spread)
        return inner < 0.6 * (k - 3) / (k - 1)


def autocorrelation(panel: DataFrame, signal: Signal, lag: int = 1, min_breadth: int = MIN_BREADTH) -> DataFrame:
    """One row: mean over time of the rank correlation with the ranks `lag` rows before (0 if none)."""
    rank = cs_rank(signal, min_breadth, pct=False)
    rows = add_signals(panel, {"__now": rank, "__then": rank.shift(lag)})
    return rank_correlations(rows, "__now", "__then", ["t"], min_breadth).agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("autocorrelation"))


def fundamental_law(ic: float, breadth: float, periods_per_year: int = 252, transfer_coefficient: float = 1.0) -> float:
    """The information ratio that skill, breadth and implementation allow."""
    if breadth <= 0:
        raise PanelError(f"breadth must be positive, got {breadth}")
    if not 0 < transfer_coefficient <= 1:
        raise PanelError(f"transfer coefficient must lie in (0, 1], got {transfer_coefficient}")
    return transfer_coefficient * ic * math.sqrt(breadth * periods_per_year)


def allowed_information_ratio(ics: DataFrame, periods_per_year: int = 252) -> DataFrame:
    """One row: the fundamental law for the mean and mean breadth of information coefficients."""
    known = ics.where("ic is not null")
    return known.agg((F.avg("ic") * F.sqrt(F.avg("breadth") * periods_per_year)).alias("information_ratio"))


#: The key of the rank autocorrelation among horizons.
_PERSISTENCE = 0


def diagnosis(panel: DataFrame, signal: Signal, price: str, horizons: Sequence[int] = HORIZONS, execution_lag: int = 1, n_quantiles: int = 5, min_breadth: int = MIN_BREADTH) -> DataFrame:
    """section, key, value, n, note: ic_mean (with the verdict as note), ic_t_statistic, ic_hit_rate and ic_breadth by
    horizon; quantile by bucket, for the next return; autocorrelation of ranks. Ranks of the signal and of all
    forward returns are computed once and written; correlations of all horizons and the autocorrelation
    are one aggregation over them. A horizon without a correlation has no rows."""
    if n_quantiles < 2:
        raise PanelError(f"need at least 2 quantiles, got {n_quantiles}")
    wanted = sorted({1, *horizons})
    made = _ranked(panel, signal, price, wanted, execution_lag, min_breadth, before=1)
    rows = stored(made.select("t", "__rank", "__then", "__share", "__f1", *[f"__r{h}" for h in wanted]))
    found = _summary(_correlations(rows, {_PERSISTENCE: "__then"} | {h: f"__r{h}" for h in wanted}, min_breadth))
    figure = lambda section, value, note=None: F.struct(F.lit(section).alias("section"), value.cast("double").alias("value"), F.lit(None).cast("string").alias("note") if note is None else note.alias("note"))
    horizon = [figure("ic_mean", F.col("mean"), F.col("verdict")), figure("ic_t_statistic", F.col("t_stat")), figure("ic_hit_rate", F.col("hit_rate")), figure("ic_breadth", F.col("mean_breadth"))]
    each = F.explode(F.when(F.col("horizon") == _PERSISTENCE, F.array(figure("autocorrelation", F.col("mean")))).otherwise(F.array(*horizon))).alias("x")
    figures = found.select("horizon", "n", each).select("x.section", F.col("horizon").alias("key"), "x.value", "n", "x.note")
    buckets = _buckets(rows, n_quantiles, 1, min_breadth).select(F.lit("quantile").alias("section"), F.col("bucket").alias("key"), F.col("mean_return").alias("value"), "n", F.lit(None).cast("string").alias("note"))
    return figures.unionByName(buckets)


def diagnose(panel: DataFrame, signal: Signal, price: str, execution_lag: int = 1, n_quantiles: int = 5, periods_per_year: int = 252) -> str:
    """A text report of all diagnostics."""
    found = {(r.section, r.key): r for r in diagnosis(panel, signal, price, HORIZONS, execution_lag, n_quantiles).collect()}  # a few rows for each horizon and bucket
    of = lambda section, key: found[section, key].value
    buckets = QuantileReport(tuple(of("quantile", b) for b in range(n_quantiles)), tuple(found["quantile", b].n for b in range(n_quantiles)))
    lines = [f"signal {signal.label}"]
    lines += [f"  horizon {h:>3}: IC {of('ic_mean', h):+.4f}  t {of('ic_t_statistic', h):+.2f}  hit {of('ic_hit_rate', h):.0%}  n {found['ic_mean', h].n}" for h in HORIZONS if ("ic_mean", h) in found]
    if ("ic_mean", 1) in found:
        lines.append(f"  verdict: {found['ic_mean', 1].note}")
        lines.append(f"  fundamental law: IR up to {fundamental_law(of('ic_mean', 1), of('ic_breadth', 1), periods_per_year):.2f}")
    lines.append("  quantile means: " + ", ".join("-" if m is None else f"{m:+.4%}" for m in buckets.means))
    lines.append(f"  monotonicity {buckets.monotonicity:+.2f}" + ("  one tail drives the spread" if buckets.driven_by_one_tail else ""))
    persistence = of("autocorrelation", _PERSISTENCE) if ("autocorrelation", _PERSISTENCE) in found else 0.0
    lines.append(f"  rank autocorrelation {persistence:+.3f}")
    return "\n".join(lines)
