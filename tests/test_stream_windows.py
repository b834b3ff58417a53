"""Windows of event time: out-of-order and late rows, restarts, retries; equal to the batch aggregate."""
from __future__ import annotations

import datetime as dt
import os

import pytest

from wagelens.streaming import windows as sw

SCHEMA = "ts timestamp, kind string, value double"


def hour(h, m=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)


def land(spark, folder, number, rows):
    """One landed file; files are picked up in the order of their times."""
    from pyspark.sql.types import StructType
    df = spark.createDataFrame(rows, StructType.fromDDL(SCHEMA)).coalesce(1)
    df.write.mode("append").parquet(f"{folder}/f{number:02d}")
    for name in os.listdir(f"{folder}/f{number:02d}"):
        os.utime(f"{folder}/f{number:02d}/{name}", (1_700_000_000 + number * 60,) * 2)


@pytest.fixture
def run(spark, tmp_path):
    from pyspark.sql.types import StructType

    def go(closed=True, slide=None, delay="2 hours"):
        stream = sw.landed_stream(spark, f"{tmp_path}/land/*", StructType.fromDDL(SCHEMA), max_files_per_trigger=1)
        stats = sw.window_stats(stream, "ts", "value", ["kind"], "1 hour", slide, delay)
        start = sw.start_closed_windows if closed else sw.start_windows
        kind = "closed" if closed else "latest"
        q = start(stats, f"{tmp_path}/{kind}", f"{tmp_path}/ckpt-{kind}")
        q.awaitTermination()
        table = (spark.read.schema(stats.schema).parquet(f"{tmp_path}/closed") if closed else
                 sw.latest_windows(spark, f"{tmp_path}/latest", stats.schema, ["kind"]))
        return q, sorted(map(tuple, table.collect()), key=repr)
    return go


def landed(spark, tmp_path):
    return sw.window_stats(spark.read.schema(SCHEMA).parquet(*(f"{tmp_path}/land/{x}" for x in os.listdir(f"{tmp_path}/land"))),
                           "ts", "value", ["kind"], "1 hour")


def test_out_of_order_rows_count_and_late_rows_do_not(spark, tmp_path, run):
    land(spark, f"{tmp_path}/land", 1, [(hour(1, 5), "a", 1.0), (hour(3), "a", 2.0), (None, "a", 9.0)])
    land(spark, f"{tmp_path}/land", 2, [(hour(1, 59), "a", 4.0), (hour(2, 30), None, None), (hour(6), "a", 8.0)])
    land(spark, f"{tmp_path}/land", 3, [(hour(1, 10), "a", 16.0), (hour(5, 30), "a", 32.0), (hour(9), "a", 64.0)])
    land(spark, f"{tmp_path}/land", 4, [(hour(1, 20), "a", 128.0)])
    q, got = run()
    # rows are late against the watermark that held when the batch before theirs began: 01:00 for file 3, 04:00 for
    # file 4, whose row is late; the last watermark, 07:00, closes the windows up to there
    want = [(1, "a", 3, 21.0), (2, None, 1, None), (3, "a", 1, 2.0), (5, "a", 1, 32.0), (6, "a", 1, 8.0)]
    assert sorted(((r[0].hour, r[2], r[3], None if r[5] is None else float(r[5])) for r in got), key=repr) == sorted(want, key=repr)
    assert sw.late_rows(q) == 1
    # a window after the watermark comes with the next rows, and what was late is found against all landed rows
    written = spark.read.parquet(f"{tmp_path}/closed")
    mend = sw.windows_to_mend(written, landed(spark, tmp_path)).collect()
    assert [(r["win_start"].hour, r["n"], float(r["sum_value"])) for r in mend] == [(1, 4, 149.0)]


def test_restart_goes_on_with_the_state(spark, tmp_path, run):
    land(spark, f"{tmp_path}/land", 1, [(hour(1, 5), "a", 1.0)])
    _, got = run()
    assert got == []                                       # 01:00-02:00 is open
    land(spark, f"{tmp_path}/land", 2, [(hour(1, 50), "a", 2.0), (hour(8), "b", 1.0)])
    _, got = run()
    assert [(r[0].hour, r[3], float(r[5])) for r in got] == [(1, 2, 3.0)]
    _, again = run()                                       # nothing landed: nothing written twice
    assert again == got


def test_latest_windows_equal_the_batch_aggregate(spark, tmp_path, run):
    land(spark, f"{tmp_path}/land", 1, [(hour(h % 5, h), "ab"[h % 2], float(h)) for h in range(20)])
    land(spark, f"{tmp_path}/land", 2, [(hour(h % 6, h), "abc"[h % 3], -float(h)) for h in range(20)])
    _, got = run(closed=False, delay="1 day")
    assert got == sorted(map(tuple, landed(spark, tmp_path).collect()), key=repr)
    land(spark, f"{tmp_path}/land", 3, [(hour(2, 2), "a", 0.25), (hour(30), "z", None)])
    _, got = run(closed=False, delay="1 day")
    assert got == sorted(map(tuple, landed(spark, tmp_path).collect()), key=repr)


def test_empty_stream(spark, tmp_path, run):
    land(spark, f"{tmp_path}/land", 1, [])
    assert run()[1] == [] and run(closed=False)[1] == []


def test_sliding_windows_hold_a_row_each(spark):
    rows = spark.createDataFrame([(hour(1, 30), "a", 1.0)], SCHEMA)
    got = sw.window_stats(rows, "ts", "value", width="1 hour", slide="20 minutes").orderBy("win_start").collect()
    assert [(r["win_start"].hour, r["win_start"].minute, r["n"]) for r in got] == [(0, 40, 1), (1, 0, 1), (1, 20, 1)]
