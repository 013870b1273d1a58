import datetime as dt

import pytest
from pyspark.sql import functions as F

from lattica.errors import PanelError
from lattica.operators.universe import price_floor_screen
from lattica.streaming.cells import stream_cells
from lattica.streaming.latches import stream_price_floor
from lattica.streaming.replay import replayed

KIND = "ts timestamp, asset string, cents long, quantity double"


def test_stream_equals_batch(spark, tmp_path):
    first = dt.datetime(2024, 1, 1)
    rows = [(first + dt.timedelta(hours=5 * i), f"A{i % 3}", 100 * i + 7, 2.0) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_cells(stream).writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    want = sorted(stream_cells(spark.createDataFrame(rows, KIND)).collect())
    assert sorted(spark.table("cells").collect()) == want and len(want) > 30


CELLS = "t int, ts timestamp, asset string, p double"


def _prices(spark):
    """40 days of six assets whose prices cross the floor and the entry, some missing."""
    first = dt.datetime(2024, 1, 1)
    price = lambda t, a: None if (t + a) % 7 == 0 else 3.0 + (t * (a + 2) % 11) * 0.5
    return spark.createDataFrame([(t, first + dt.timedelta(days=t), f"A{a}", price(t, a)) for t in range(40) for a in range(6)], CELLS)


def test_latches_on_a_late_stream_equal_the_batch(spark):
    cells = _prices(spark)
    late = F.floor((F.col("t") + F.pmod(F.xxhash64("t", "asset"), F.lit(5))) / 12)  # up to four days out of order
    closing = spark.createDataFrame([(0, dt.datetime(2025, 1, 1), "", None)], CELLS)
    odd = spark.createDataFrame([(0, None, "A1", 9.0), (1, dt.datetime(2024, 1, 2), None, 9.0)], CELLS)
    fed = cells.unionByName(cells.where("t = 3")).unionByName(odd)  # repeated rows and missing keys
    got = replayed(fed, late, lambda s: stream_price_floor(s, "p", late="5 days"), closing)
    want = price_floor_screen(cells, "p").select("ts", "asset", "priced")
    assert sorted(got.collect()) == sorted(want.collect()) and got.where("priced").count() > 20


def test_assets_that_share_a_bucket_keep_apart(spark):
    cells = _prices(spark)
    late = F.floor((F.col("t") + F.pmod(F.xxhash64("t", "asset"), F.lit(5))) / 12)
    closing = spark.createDataFrame([(0, dt.datetime(2025, 1, 1), "", None)], CELLS)
    got = replayed(cells.unionByName(cells.where("t = 3")), late, lambda s: stream_price_floor(s, "p", late="5 days", buckets=2), closing)
    want = price_floor_screen(cells, "p").select("ts", "asset", "priced")
    assert sorted(got.collect()) == sorted(want.collect())


def test_rows_behind_the_watermark_are_dropped(spark):
    cells = _prices(spark)
    closing = spark.createDataFrame([(0, dt.datetime(2025, 1, 1), "", None)], CELLS)
    arrival = F.when((F.col("t") == 2) & (F.col("asset") == "A0"), 2).otherwise(F.when(F.col("t") < 30, 0).otherwise(1))
    got = replayed(cells, arrival, lambda s: stream_price_floor(s, "p", late="1 day"), closing)
    want = price_floor_screen(cells.where("not (t = 2 and asset = 'A0')"), "p").select("ts", "asset", "priced")
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_stream_of_nothing_puts_out_nothing(spark):
    closing = spark.createDataFrame([(0, dt.datetime(2025, 1, 1), "", None)], CELLS)
    assert replayed(_prices(spark).limit(0), F.lit(0), lambda s: stream_price_floor(s, "p"), closing).count() == 0


def test_bad_streams_are_refused(spark):
    with pytest.raises(PanelError):
        stream_price_floor(_prices(spark), "p")
    with pytest.raises(PanelError):
        stream_price_floor(_prices(spark), "p", 5.0, 4.0)
    with pytest.raises(PanelError):
        stream_price_floor(_prices(spark), "close")
