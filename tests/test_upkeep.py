"""Upkeep of the payroll table: superseded and unlisted runs are not read, compacted and deleted."""
from __future__ import annotations

import os

import pytest

from wagelens.plans.jobs import ingest_job
from wagelens.sources import silver
from wagelens.sources.payroll_csv import read_payroll, rejected_record

ROW = "{name},Clerk,1,2,3,4,5,{pay},{year},,Oakland,FT"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(rows) + "\n")


def shown(spark, table):
    valid = sorted((os.path.basename(r["file"]), r["employee_name"], float(r["total_pay_benefits"]), r["year"])
                   for r in silver.silver(spark, table).collect())
    return valid, sorted((os.path.basename(r["file"]), r["raw"]) for r in silver.quarantine(spark, table).collect())


def runs_on_disk(table):
    return sorted(int(x[4:]) for x in os.listdir(f"{table}/rows") if x.startswith("run="))


@pytest.fixture
def table(spark, tmp_path):
    """Four files; a, b and c are read again, so the first run holds one live file of four, and the second is live."""
    land = f"{tmp_path}/land"
    for name in "abcd":
        put(land, f"{name}.csv", [ROW.format(name=f"{name}1", pay=10, year=2011), ROW.format(name=f"{name}2", pay=20, year=2012), '"bad"x,' + "1," * 10])
    ingest_job(spark, f"{land}/*.csv", f"{tmp_path}/t")
    for name in "abc":
        put(land, f"{name}.csv", [ROW.format(name=f"{name}9", pay=30, year=2011)])
    ingest_job(spark, f"{land}/[abc].csv", f"{tmp_path}/t")
    return f"{tmp_path}/t"


def test_superseded_runs_are_not_read(spark, table):
    before = shown(spark, table)
    ingest_job(spark, f"{os.path.dirname(table)}/land/[abc].csv", table)
    runs = runs_on_disk(table)
    assert len(runs) == 3
    files = {f.split("run=")[1].split("/")[0] for f in silver.current(spark, table).inputFiles() if "/rows/" in f}
    assert files == {str(runs[0]), str(runs[2])}
    assert shown(spark, table) == before


def test_compact_keeps_what_is_shown(spark, table):
    before = shown(spark, table)
    number = silver.compact(spark, table)
    assert number == max(runs_on_disk(table)) and shown(spark, table) == before
    assert {r["run"] for r in silver.live_runs(spark, table).collect()} == set(runs_on_disk(table)[1:])
    assert silver.compact(spark, table) is None


def test_vacuum_deletes_dead_runs_only(spark, table):
    before = shown(spark, table)
    os.makedirs(f"{table}/rows/run=5/rejected=0/year=2011")          # begun long ago, never listed
    assert silver.vacuum(spark, table, keep_hours=24) == [5]         # the superseded run is young
    first = runs_on_disk(table)[0]
    assert silver.vacuum(spark, table, keep_hours=-1) == [first]
    assert shown(spark, table) == before and first not in runs_on_disk(table)
    assert silver.vacuum(spark, table, keep_hours=-1) == []
    put(f"{os.path.dirname(table)}/land", "d.csv", [])               # an emptied file loses its rows and its rejects
    ingest_job(spark, f"{os.path.dirname(table)}/land/d.csv", table)
    assert {x[0] for x in shown(spark, table)[0]} == {"a.csv", "b.csv", "c.csv"} and shown(spark, table)[1] == []


def test_fail_mode_names_the_record(spark, tmp_path):
    put(f"{tmp_path}/x", "one.csv", [ROW.format(name="a", pay=1, year=2011)] * 4 + ['"bad"x,' + "1," * 10, ROW.format(name="b", pay=1, year=2011)])
    with pytest.raises(Exception) as failed:
        read_payroll(spark, f"{tmp_path}/x", on_error="fail").collect()
    said = rejected_record(failed.value)
    assert said["file"].endswith("/x/one.csv")
    assert (said["reason"], said["line"], said["text"]) == ("malformed_quote", 5, '"bad"x,' + "1," * 10)
    assert rejected_record(ValueError("something else")) is None
