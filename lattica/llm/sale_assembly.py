"""Sale completeness assembly on a stream: the rows of a sale gather until they add up.

The input is cut by arrival day into batches that land, one after the other, in a folder; a
Structured Streaming query with state is started anew on one checkpoint for each. Before that,
distinct lines are summed by sale and day, so a sale with a third of all lines has as many rows
as there are days. What a sale is due is known from the whole input and comes with its sale row.

State is kept by bucket (a hash of sale_id; about BUCKET_ROWS rows a bucket, so their number
grows with the input) in two MapStates: the open assemblies by sale_id, and a calendar queue of
the sale_ids whose assembly began on a day. A call to a state costs Python some 0.1 ms, so an
entry of the first holds the assemblies of a page of sale_ids (PAGES in a bucket), packed. Each
batch also brings every bucket a tick row, after whose rows the bucket drains the slots of days
that are over; the last tick drains all. An assembly that completes leaves its place in the
queue to be passed over. Files are in order of buckets, and rows of a bucket reach its state
packed by the Arrow batch.

Days in order, the rows of a sale_id join its open assembly or begin one. If it then has a sale
and a line and its cents equal what is due, it closes as `complete`. A tick closes those whose
first day is `patience` days or more before the largest day of all batches before: as `headless`
(no sale), `orphan` (no line), `short` or `over` (cents below or above what is due).

Null sale_ids are dropped; a null or non-finite amount or total is 0 cents; a null line_no is
written as an empty text in the hash; a sale without arrival arrives on the first day. Of
repeated rows of lines one counts. A sale_id with several sale rows is due by the largest total
among them. Ties of days are one step: all rows of a sale_id and a day join together. Empty
tables run all batches and give no rows. Extra columns of lines only make rows distinct; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.llm.common import let_go, shared_folder, written

#: Lines for each bucket.
BUCKET_ROWS = 16000
#: The least number of buckets.
BUCKETS = 64
#: Of the files of batches, states and closings.
CODEC = "zstd"
#: Entries of a bucket's map of assemblies.
PAGES = 16
OUT = "sale_id long, first_day int, last_day int, n_lines long, cents long, due long, status string, closing_batch int"
_DAYS = "sale_id long, day int, n_lines long, cents long, due long, kind int, bucket int"
#: Kinds of rows: lines of a day, a sale, a tick.
LINES, SALE, TICK = 0, 1, 2
_ROW = np.dtype([("sale_id", "<i8"), ("day", "<i4"), ("n_lines", "<i8"), ("cents", "<i8"), ("due", "<i8"), ("kind", "<i4"), ("batch", "<i4")])
_ASSEMBLY = np.dtype([("sale_id", "<i8"), ("first_day", "<i4"), ("last_day", "<i4"), ("n_lines", "<i8"), ("cents", "<i8"), ("due", "<i8"), ("sold", "?")])
#: Ticks that close nothing and everything.
NONE, ALL = -(2**31), 2**31 - 1


@dataclass(frozen=True)
class Calendar:
    """start: the first day (since 1970); days: how many the batches cover together; patience: days after
    which an assembly is given up; spread: days over which lines without a shipping day arrive."""

    start: int = 19723
    days: int = 160
    batches: int = 10
    patience: int = 10
    delay: int = 15
    spread: int = 152

    def batch(self, day: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.batches - 1), F.floor((day - self.start) * self.batches / self.days))).cast("int")


def cents(amount: Column) -> Column:
    fine = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != float("inf"))
    return F.when(fine, F.floor(F.lit(100.0) * amount + 0.5)).otherwise(F.lit(0)).cast("long")


def day_rows(lines: DataFrame, sales: DataFrame, calendar: Calendar) -> DataFrame:
    """sale_id, day, n_lines, cents, due, kind, batch: lines summed by day, and a row for each sale and arrival day, with what it is due."""
    h = F.crc32(F.concat_ws(":", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit(""))))
    shipped = F.unix_date(F.col("shipped_at").cast("date")) + h % calendar.delay
    own = lines.where("sale_id is not null").distinct().select(
        F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(shipped, calendar.start + h % calendar.spread).cast("int").alias("day"), cents(F.col("amount").cast("double")).alias("cents")
    )
    # written, so that the shuffle of whole lines goes before the next one comes
    by_day = written(own.groupBy("sale_id", "day").agg(F.count("*").alias("n_lines"), F.sum("cents").alias("cents")), CODEC)
    by_sale = by_day.groupBy("sale_id").agg(F.sum("cents").alias("all"), F.max_by("cents", "day").alias("last"))
    arrived = F.coalesce(F.unix_date(F.col("arrived_at").cast("date")), F.lit(calendar.start)).cast("int")
    heads = sales.where("sale_id is not null").select(F.col("sale_id").cast("long").alias("sale_id"), arrived.alias("day"), cents(F.col("total").cast("double")).alias("total"))
    heads = heads.groupBy("sale_id").agg(F.collect_set("day").alias("days"), F.max("total").alias("total")).join(by_sale, "sale_id", "left")
    kind = F.crc32(F.col("sale_id").cast("string")) % 5
    total = F.coalesce("all", F.lit(0))
    due = F.when(kind == 0, F.col("total")).when(kind == 1, total - F.coalesce("last", F.lit(0))).otherwise(total)
    heads = heads.select("sale_id", F.explode("days").alias("day"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("cents"), due.alias("due"), F.lit(SALE).alias("kind"))
    rows = by_day.withColumns({"due": F.lit(0).cast("long"), "kind": F.lit(LINES)}).unionByName(heads)
    return rows.withColumn("batch", calendar.batch(F.col("day")))


_NAMES = [f.split()[0] for f in OUT.split(", ")]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, rows: a row for each run of rows of one bucket."""
    for batch in batches:
        rows = np.empty(batch.num_rows, _ROW)
        for name in _ROW.names:
            rows[name] = batch.column(name).to_numpy()
        bucket = batch.column("bucket").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
        made = [part.tobytes() for part in np.split(rows, cut[1:])] if len(cut) else []
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array(made, pa.binary())], names=["bucket", "rows"])


class Assembler(StatefulProcessor):
    """The state of one bucket of sale_ids. The day of a tick row is the last first_day that is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("assembly", "page int", "assemblies binary")
        self.queue = handle.getMapState("queue", "first_day int", "sale_ids binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        packed = b"".join(x for frame in rows for x in frame["rows"])
        new = np.frombuffer(packed, _ROW)
        ticks = new[new["kind"] == TICK]
        new = new[new["kind"] != TICK]
        own = new[np.lexsort((new["day"], new["sale_id"]))].tolist()
        pages = {k[0]: bytes(v[0]) for k, v in self.pages.iterator()}
        state = {sale: at for page in pages.values() for sale, *at in np.frombuffer(page, _ASSEMBLY).tolist()}
        begun: dict[int, list[int]] = {}
        done: list[tuple] = []
        for i, (sale, day, n, c, due, kind, batch) in enumerate(own):
            at = state.get(sale)
            if at is None:
                at = state[sale] = [day, day, 0, 0, 0, False]
                begun.setdefault(day, []).append(sale)
            at[1] = day
            at[2] += n
            at[3] += c
            if kind == SALE:
                at[4:] = due, True
            if i + 1 < len(own) and own[i + 1][0] == sale and own[i + 1][1] == day:
                continue
            if at[5] and at[2] and at[3] == at[4]:
                done.append((sale, *state.pop(sale)[:5], "complete", batch))
        for tick in ticks:
            done += self._drain(state, begun, int(tick["batch"]), int(tick["day"]))
        self._keep(state, pages)
        for day, sales in begun.items():
            still = np.array([s for s in sales if s in state], "<i8")
            if len(still):
                there = self.queue.getValue((day,))
                self.queue.updateValue((day,), ((bytes(there[0]) if there else b"") + still.tobytes(),))
        if done:
            yield pd.DataFrame(done, columns=_NAMES, dtype=object)

    def _drain(self, state: dict, begun: dict, batch: int, until: int) -> Iterator[tuple]:
        """Closes what waits in the slots up to a day."""
        if until == NONE:
            return
        slots = {k[0]: np.frombuffer(bytes(v[0]), "<i8").tolist() for k, v in self.queue.iterator() if k[0] <= until}
        for day in slots:
            self.queue.removeKey((day,))
        for day in [d for d in begun if d <= until]:
            slots.setdefault(day, []).extend(begun.pop(day))
        for day, sales in sorted(slots.items()):
            for sale in sales:
                at = state.get(sale)
                if at is not None and at[0] == day:
                    del state[sale]
                    first, last, n, c, due, sold = at
                    status = "headless" if not sold else "orphan" if not n else "short" if c < due else "over"
                    yield (sale, first, last, n, c, due if sold else None, status, batch)

    def _keep(self, state: dict, before: dict[int, bytes]) -> None:
        """Writes the pages that changed."""
        parts: dict[int, list[tuple]] = {}
        for sale, at in sorted(state.items()):
            parts.setdefault(sale % PAGES, []).append((sale, *at))
        for page in before.keys() - parts.keys():
            self.pages.removeKey((page,))
        for page, rows in parts.items():
            packed = np.array(rows, _ASSEMBLY).tobytes()
            if packed != before.get(page):
                self.pages.updateValue((page,), (packed,))


def assemble_sales(lines: DataFrame, sales: DataFrame, calendar: Calendar = Calendar(), buckets: int | None = None) -> DataFrame:
    """One row for each closing (OUT). Runs the batches now, in a new folder below spark.checkpoint.dir."""
    spark: SparkSession = lines.sparkSession
    folder = shared_folder(spark)
    n = buckets or max(BUCKETS, lines.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("sale_id"), F.lit(n)).cast("int")
    rows = day_rows(lines, sales, calendar).withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("batch", "bucket", "sale_id", "day")
    rows.write.option("compression", CODEC).partitionBy("batch").parquet(f"{folder}/cut")
    let_go(spark)
    cut = spark.read.schema(f"{_DAYS}, batch int").parquet(f"{folder}/cut")
    largest = {r.batch: r.day for r in cut.groupBy("batch").agg(F.max("day").alias("day")).collect()}  # a row for each batch
    own = spark.newSession()  # its settings are the stream's alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores
    own.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "5s")  # stores of runs that are over go soon
    own.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    own.conf.set("spark.sql.streaming.stateStore.compression.codec", CODEC)
    own.conf.set("spark.sql.shuffle.partitions", str(min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    latest = None
    for batch in range(calendar.batches):
        until = ALL if batch == calendar.batches - 1 else NONE if latest is None else latest - calendar.patience
        zero = F.lit(0).cast("long")
        ticks = spark.range(n).select(zero.alias("sale_id"), F.lit(until).alias("day"), zero.alias("n_lines"), zero.alias("cents"), zero.alias("due"), F.lit(TICK).alias("kind"), F.col("id").cast("int").alias("bucket"), F.lit(batch).alias("batch"))
        cut.where(F.col("batch") == batch).unionByName(ticks).write.mode("append").option("compression", CODEC).parquet(f"{folder}/in")
        fed = own.readStream.schema(f"{_DAYS}, batch int").parquet(f"{folder}/in").mapInArrow(_packed, "bucket int, rows binary")
        closed = fed.groupBy("bucket").transformWithStateInPandas(Assembler(), OUT, "Append", "None")
        closed.writeStream.format("parquet").option("compression", CODEC).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        let_go(spark)
        day = largest.get(batch)
        latest = latest if day is None else day if latest is None else max(latest, day)
    return spark.read.schema(OUT).parquet(f"{folder}/out")
