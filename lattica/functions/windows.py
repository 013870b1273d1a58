"""Statistics of sliding windows whose cost for a row grows with the logarithm of the window at most.

A window of row i is the interval from a first row to i, of rows with values. Sums, moments,
minima and maxima come from tables of stretches of 1, 2, 4, ... rows: an interval is cut into
one stretch for each set bit of its length, so values are only added, never taken away, and
nothing cancels. Moments are merged by their means. Order statistics come from a wavelet matrix over
dense ranks: a level for each bit of a rank says how many of the rows before have that bit unset,
so a walk down the levels narrows an interval to its k-th value, or counts its values below one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Ranks:
    """A wavelet matrix over the dense ranks of values."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, rank = np.unique(values, return_inverse=True)
        self.rank = rank
        self.bits = max(1, int(len(self.values) - 1).bit_length()) if len(self.values) else 1
        self.unset: list[np.ndarray] = []  # of each level, how many rows before have its bit unset
        for level in reversed(range(self.bits)):
            bit = rank >> level & 1
            self.unset.append(np.concatenate([[0], np.cumsum(1 - bit)]))
            rank = np.concatenate([rank[bit == 0], rank[bit == 1]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value (from 0) of rows low to high, which hold more than k."""
        low, high, k, rank = low.copy(), high.copy(), k.copy(), np.zeros(len(low), np.int64)
        for level, unset in zip(reversed(range(self.bits)), self.unset):
            a, b = unset[low], unset[high]
            up = k >= b - a
            k -= np.where(up, b - a, 0)
            rank |= up.astype(np.int64) << level
            low, high = np.where(up, unset[-1] + low - a, a), np.where(up, unset[-1] + high - b, b)
        return self.values[rank]

    def below(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of rows low to high have a lesser rank."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, unset in zip(reversed(range(self.bits)), self.unset):
            a, b = unset[low], unset[high]
            up = (rank >> level & 1).astype(bool)
            count += np.where(up, b - a, 0)
            low, high = np.where(up, unset[-1] + low - a, a), np.where(up, unset[-1] + high - b, b)
        return count


def folded(tables: list[np.ndarray], low: np.ndarray, high: np.ndarray, merge: Callable, start: list[np.ndarray]) -> list[np.ndarray]:
    """The merged parts of rows low to high. tables: the parts of single rows; merge joins the parts of two neighbours."""
    size, at = high - low, low.copy()
    for k in range(int(size.max(initial=0)).bit_length()):
        own = np.flatnonzero(size >> k & 1)
        for part, made in zip(start, merge([s[own] for s in start], [t[at[own]] for t in tables]), strict=True):
            part[own] = made
        at[own] += 1 << k
        n = len(tables[0]) - (1 << k)
        if n <= 0:
            break
        tables = merge([t[:n] for t in tables], [t[1 << k :][:n] for t in tables])
    return start


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


def _moments(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """(n, mean, squares around it) of both together."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    share = b[0] / n
    return [n, a[1] + apart * share, a[2] + b[2] + apart * apart * a[0] * share]


def statistic(kind: str, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The statistic of values[low:high] for each pair; no interval is empty. `below` is of the last value of each."""
    if kind in ("median", "below"):
        ranks = Ranks(values)
        if kind == "below":
            return ranks.below(low, high, ranks.rank[high - 1]).astype(np.float64)
        n = high - low
        return (ranks.kth(low, high, (n - 1) // 2) + ranks.kth(low, high, n // 2)) / 2
    if kind == "std":
        zero = np.zeros(len(low))
        n, _, squares = folded([np.ones(len(values)), values, np.zeros(len(values))], low, high, _moments, [zero, zero.copy(), zero.copy()])
        return np.sqrt(squares / n)
    if kind in ("min", "max"):
        best, first = (np.minimum, np.inf) if kind == "min" else (np.maximum, -np.inf)
        return folded([values], low, high, lambda a, b: [best(a[0], b[0])], [np.full(len(low), first)])[0]
    total = folded([values], low, high, _added, [np.zeros(len(low))])[0]
    return total / (high - low) if kind == "mean" else total


@dataclass(frozen=True)
class Sliding:
    """A statistic of the values at the last `window` places of t, this one included, where at least `least` are there.
    below: the number of them below today's."""

    kind: str
    window: int
    least: int


def sliding(made: Sliding, run: np.ndarray, t: np.ndarray, values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """NaN where there is none. Rows are in order of run (a number for each series) and t."""
    span = int(t.max() - t.min()) + made.window + 1 if len(t) else 1
    key = run * span + (t - t.min()) if len(t) else t
    first = np.searchsorted(key, np.maximum(key - (made.window - 1), run * span))
    count = np.concatenate([[0], np.cumsum(there)])
    low, high = count[first], count[1:]
    own = high - low >= made.least
    if made.kind == "below":
        own &= there
    out = np.full(len(t), np.nan)
    if own.any():
        out[own] = statistic(made.kind, values[there], low[own], high[own])
    return out


def along_assets(panel: DataFrame, wanted: dict[str, tuple[str, Sliding]], run: tuple[str, ...]) -> DataFrame:
    """The panel with a column for each (column, Sliding). Rows are dealt to tasks by series and sorted by t; a task
    keeps of a series that goes on in the next batch only what windows still reach."""
    keys = [*run, "asset"]
    schema = T.StructType([*panel.schema.fields, *[T.StructField(n, T.DoubleType()) for n in wanted]])
    arrow = to_arrow_schema(schema)
    at = {f.name: i for i, f in enumerate(panel.schema.fields)}
    widest = max(s.window for _, s in wanted.values())
    columns = sorted({c for c, _ in wanted.values()})

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        old_t = np.empty(0, np.int64)
        old = {c: (np.empty(0), np.empty(0, bool)) for c in columns}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            coded = [batch.column(at[k]).dictionary_encode().indices.fill_null(-1).to_numpy() for k in keys]
            new = np.zeros(n, bool)
            for x in coded:
                new[1:] |= x[1:] != x[:-1]
            first = tuple(batch.column(at[k])[0].as_py() for k in keys)
            if first != last:
                old_t = old_t[:0]
                old = {c: (v[:0], m[:0]) for c, (v, m) in old.items()}
            before = len(old_t)
            series = np.concatenate([np.zeros(before, np.int64), np.cumsum(new)])
            t = np.concatenate([old_t, batch.column(at["t"]).to_numpy().astype(np.int64)])
            data = {}
            for c in columns:
                values = batch.column(at[c])
                data[c] = tuple(np.concatenate(x) for x in zip(old[c], (values.cast(pa.float64()).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False))))
            made = [sliding(s, series, t, *data[c])[before:] for c, s in wanted.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.float64(), mask=np.isnan(x)) for x in made]], schema=arrow)
            last = tuple(batch.column(at[k])[n - 1].as_py() for k in keys)
            keep = (series == series[-1]) & (t > t[-1] - widest)
            old_t = t[keep]
            old = {c: (v[keep], m[keep]) for c, (v, m) in data.items()}

    dealt = panel.repartition(*[f"`{k}`" for k in keys]).sortWithinPartitions(*[f"`{k}`" for k in keys], "t")
    return dealt.mapInArrow(extended, schema)
