"""Incremental ingest: new files are ingested once, re-runs add nothing."""
from __future__ import annotations

import shutil
from pathlib import Path

from conftest import FIXTURES
from wagelens.session import scratch_path
from wagelens.sources.payroll_csv import read_payroll
from wagelens.sources.silver import quarantine, silver
from wagelens.streaming.ingest import start_payroll_ingest


def test_stream_ingest_matches_batch_and_is_incremental(spark):
    base = Path(scratch_path(spark, "stream-test"))
    landing, table, ck = (str(base / n) for n in ("landing", "table", "ck"))
    Path(landing).mkdir(parents=True)
    shutil.copy(FIXTURES / "2011-payroll.csv", landing)

    q = start_payroll_ingest(spark, landing, table, ck)
    q.awaitTermination(300)
    first = silver(spark, table).count()

    shutil.copy(FIXTURES / "2012-payroll.csv", landing)
    q = start_payroll_ingest(spark, landing, table, ck)
    q.awaitTermination(300)
    both = silver(spark, table)

    batch = read_payroll(spark, str(FIXTURES / "20*-payroll.csv"))
    want = batch.where("reason IS NULL OR reason NOT IN ('malformed_quote', 'missing_cells')")
    assert both.count() == want.count()
    assert first < both.count()
    assert quarantine(spark, table).count() == 2

    q = start_payroll_ingest(spark, landing, table, ck)   # nothing new
    q.awaitTermination(300)
    assert silver(spark, table).count() == both.count()
    assert sorted(r["employee_name"] or "" for r in both.collect()) == \
        sorted(r["employee_name"] or "" for r in want.collect())


def test_stream_ingest_pairwise_mode_matches_batch(spark):
    base = Path(scratch_path(spark, "stream-pairwise"))
    landing, table, ck = (str(base / n) for n in ("landing", "table", "ck"))
    Path(landing).mkdir(parents=True)
    for name in ("2011-payroll.csv", "2012-payroll.csv"):
        shutil.copy(FIXTURES / name, landing)
    q = start_payroll_ingest(spark, landing, table, ck, mode="pairwise")
    q.awaitTermination(300)
    got = sorted(r["employee_name"] or "" for r in silver(spark, table).collect())
    batch = read_payroll(spark, str(FIXTURES / "20*-payroll.csv"), "pairwise")
    want = batch.where("reason IS NULL OR reason NOT IN ('malformed_quote', 'missing_cells')")
    assert got == sorted(r["employee_name"] or "" for r in want.collect())
