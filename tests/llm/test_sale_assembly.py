from __future__ import annotations

import math
import zlib
from collections import defaultdict
from datetime import datetime

import duckdb

from lattica.llm.queries import ORACLE, op12_sale_assembly
from lattica.llm.sale_assembly import Calendar, assemble_sales

LINES = "sale_id long, line_no int, item_id long, amount double, shipped_at timestamp_ntz, batch string"
SALES = "sale_id long, total double, arrived_at timestamp_ntz, day int"


def cents(value):
    return 0 if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)


def plain(lines, sales, batches=10):
    """lines: sale_id, line_no, amount, shipping day or None; sales: sale_id, total, day."""
    batch = lambda d: min(batches - 1, max(0, (d - 19723) * batches // 160))
    rows, by_day = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for sale, line, amount, shipped in lines:
        h = zlib.crc32(f"{sale}:{line}".encode())
        day = 19723 + h % 152 if shipped is None else shipped + h % 15
        rows[sale].append((day, 1, cents(amount), None))
        by_day[sale][day] += cents(amount)
    for sale, total, day in sales:
        own = by_day[sale]
        kind = zlib.crc32(str(sale).encode()) % 5
        due = cents(total) if kind == 0 else sum(own.values()) - (own[max(own)] if kind == 1 and own else 0)
        rows[sale].append((day, 0, 0, due))
    last = [max((d for r in rows.values() for d, *_ in r if batch(d) == b), default=None) for b in range(batches)]
    out = []
    for sale, own in rows.items():
        at = None
        for b in range(batches):
            for day in sorted({d for d, *_ in own if batch(d) == b}):
                at = at or [day, day, 0, 0, None]
                at[1] = day
                for d, n, c, due in own:
                    if d == day:
                        at[2], at[3], at[4] = at[2] + n, at[3] + c, at[4] if due is None else due
                if at[4] is not None and at[2] and at[3] == at[4]:
                    out.append((sale, *at, "complete", b))
                    at = None
            before = [d for d in last[:b] if d is not None]
            if at and (b == batches - 1 or (before and at[0] + 10 <= max(before))):
                status = "headless" if at[4] is None else "orphan" if not at[2] else "short" if at[3] < at[4] else "over"
                out.append((sale, *at, status, b))
                at = None
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def day(n):
    return datetime.fromtimestamp(n * 86400 + 5000, None).replace(hour=7)


def test_query_equals_sql_and_plain(spark, small):
    con = duckdb.connect()
    for t in ("sales", "sale_lines"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    have = found(op12_sale_assembly(spark, small))
    assert have == sorted(con.execute(ORACLE["op12_sale_assembly"]).fetchall(), key=str)
    of = "cast(floor(epoch({}) / 86400) as int)"
    lines = con.execute(f"select sale_id, line_no, amount, {of.format('shipped_at')} from (select distinct * from sale_lines) where sale_id is not null").fetchall()
    sales = con.execute(f"select sale_id, total, {of.format('arrived_at')} from sales").fetchall()
    assert have == plain(lines, sales)
    assert {r[6] for r in have} == {"complete", "headless", "orphan", "short", "over"}


def test_hot_sale_broken_rows_and_days_out_of_range(spark):
    lines = [(7, i, 1.0 + i % 3, 19700 + i % 230 if i % 7 else None) for i in range(900)]
    lines += [(2**62, 1, None, 19730), (2**62 + 1, 1, math.nan, 19900), (-3, 2, 5.005, 19800), (11, 1, 0.0, None)]
    sales = [(7, 10.0, 19760), (2**62, 0.0, 19724), (2**62 + 1, math.inf, 19905), (12, None, 19650)]
    own = [(s, n, 1, a, None if d is None else day(d), "x") for s, n, a, d in lines]
    frame = spark.createDataFrame(own + own[:50] + [(None, 1, 1, 2.0, None, None)], LINES)
    heads = spark.createDataFrame([(s, t, day(d), 3) for s, t, d in sales] + [(None, 1.0, day(19800), 1)], SALES)
    assert found(assemble_sales(frame, heads, Calendar(batches=3), buckets=5)) == plain(lines, sales, 3)


def test_empty(spark):
    assert assemble_sales(spark.createDataFrame([], LINES), spark.createDataFrame([], SALES), Calendar(batches=2), buckets=2).collect() == []
