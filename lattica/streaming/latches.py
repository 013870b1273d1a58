"""Hysteresis on a stream: who joins stays until it leaves, cells arriving in any order.

State is kept with transformWithState by bucket of assets, for a call for each asset costs more than its
cells do: the membership of the bucket's assets so far, and the events of times that the watermark has not
passed, both as packed tables. A timer at the earliest of them wakes the bucket; what the watermark has
passed is then decided in order of time and put out, so a stream's output is the batch latch of
`operators/universe.py` over the same cells. State grows with the assets and with the times within
`late`, not with the stream; a bucket's with the assets in it, so there should be some 256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.errors import PanelError

#: What a cell does to the latch, the weakest first.
KEEPS, LEAVES, JOINS = 0, 1, 2

#: Buckets of assets that state is kept by.
BUCKETS = 1024


_WAITING = ["asset", "ms", "event", "able"]


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(value: tuple) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value[0])).read_all().to_pandas()


class Latch(StatefulProcessor):
    """Of several cells of one asset and time the one that joins counts, then one that leaves."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.on = handle.getValueState("on", "members binary")
        self.waiting = handle.getValueState("waiting", "cells binary")

    def _keep(self, cells: pd.DataFrame) -> None:
        """A timer at the earliest cell that waits; others may be set, and then find nothing to do."""
        if cells.empty:
            self.waiting.clear()
            return
        self.waiting.update((_packed(cells),))
        self.handle.registerTimer(int(cells["ms"].min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        there = self.waiting.get()
        frames = [*([_unpacked(there)] if there else []), *(frame[_WAITING] for frame in rows)]
        self._keep(pd.concat(frames, ignore_index=True).sort_values(_WAITING).drop_duplicates(["asset", "ms"], keep="last"))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        there = self.waiting.get()
        if not there:
            return
        cells = _unpacked(there)  # by asset and time
        due = cells["ms"] <= timerValues.getCurrentWatermarkInMs()
        if not due.any():
            return
        state = self.on.get()
        on = _unpacked(state).set_index("asset")["member"] if state else pd.Series([], dtype=bool)
        now = cells[due]
        seen = now["event"].where(now["event"] != KEEPS).groupby(now["asset"]).ffill()
        member = np.where(seen.isna(), on.reindex(now["asset"], fill_value=False).to_numpy(bool), seen == JOINS)
        last = pd.Series(member, index=now["asset"]).groupby(level=0).last()
        on = pd.concat([on[~on.index.isin(last.index)], last])
        self.on.update((_packed(pd.DataFrame({"asset": on.index.astype(str), "member": on.to_numpy(bool)})),))
        self._keep(cells[~due])
        yield pd.DataFrame({"asset": now["asset"].to_numpy(), "ms": now["ms"].to_numpy(), "member": member & now["able"].to_numpy(bool)})


def stream_latch(cells: DataFrame, join: Column, leave: Column, name: str, able: Column | None = None, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """ts, asset and name: whether a join has been seen up to ts and no leave after it (join
    wins where both hold), and able holds. cells: ts (timestamp), asset and what the conditions
    read; a missing condition does not hold. A cell is put out once the watermark has passed it;
    rows later than `late` are dropped. Rows without ts or asset are dropped, repeated ones count once.
    The session keeps state in RocksDB (`spark.sql.streaming.stateStore.providerClass`)."""
    if not cells.isStreaming:
        raise PanelError("stream_latch wants a stream; the batch form is operators.universe.latch")
    event = F.when(join, JOINS).when(leave, LEAVES).otherwise(KEEPS)
    rows = cells.where("ts is not null and asset is not null").withWatermark("ts", late)
    rows = rows.select("ts", F.pmod(F.xxhash64(F.col("asset").cast("string")), F.lit(buckets)).alias("bucket"), F.col("asset").cast("string").alias("asset"), F.unix_millis("ts").alias("ms"), event.alias("event"), F.coalesce(F.lit(True) if able is None else able, F.lit(False)).alias("able"))
    out = rows.groupBy("bucket").transformWithStateInPandas(Latch(), "asset string, ms long, member boolean", "Append", "EventTime")
    return out.select(F.timestamp_millis("ms").alias("ts"), "asset", F.col("member").alias(name))


def stream_price_floor(cells: DataFrame, raw_price: str, min_price: float = 5.0, entry_price: float | None = None, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """ts, asset, priced: the screen of operators.universe.price_floor_screen on a stream of cells."""
    if raw_price not in cells.columns:
        raise PanelError(f"no raw price column {raw_price!r}: adjusted prices cannot stand in for it")
    entry = 1.2 * min_price if entry_price is None else entry_price
    if entry < min_price:
        raise PanelError(f"entry price {entry} is below the floor {min_price}: inverted hysteresis")
    p = F.col(raw_price)
    return stream_latch(cells, p >= entry, p < min_price, "priced", p.isNotNull(), late, buckets)


def stream_liquidity(ranked: DataFrame, enter: int, leave: int, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """ts, asset, liquid: members join at rank `enter` or better and leave beyond `leave` or
    without a rank. ranked: ts, asset, liquidity_rank, as a screen gives them out time by time."""
    if enter > leave:
        raise PanelError(f"entry rank {enter} is worse than exit rank {leave}: inverted hysteresis")
    r = F.col("liquidity_rank")
    return stream_latch(ranked, r <= enter, r.isNull() | (r > leave), "liquid", late=late, buckets=buckets)
