"""Location lookup, resolver worklist, resolvers and the latest-wins upsert."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wagelens.operators.locate import (geocode_worklist, latest_locations, locate,
                                       resolve_with_function, resolve_with_table, upsert_locations)
from wagelens.sources.locations import read_location_csv, write_locations

T0 = dt.datetime(2016, 3, 1)


def cache(spark):
    return spark.createDataFrame(
        [("Oakland", 37.8, -122.27, "resolved", T0), ("Nowhere", None, None, "not_found", T0)],
        "agency string, lat double, lon double, status string, updated_at timestamp")


def test_locate_keeps_every_agency(spark):
    stats = spark.createDataFrame([("Oakland", 10), ("Nowhere", 3), ("Fresno", 7)], "agency string, n long")
    rows = {r["agency"]: r for r in locate(stats, cache(spark)).collect()}
    assert rows["Oakland"]["lat"] == 37.8 and rows["Oakland"]["status"] == "resolved"
    assert rows["Nowhere"]["lat"] is None and rows["Nowhere"]["status"] == "not_found"
    assert rows["Fresno"]["lat"] is None and rows["Fresno"]["status"] == "pending"


def test_worklist_and_function_resolver(spark):
    agencies = spark.createDataFrame([("Oakland",), ("Fresno",), ("Atlantis",), ("Busy",)], "agency string")
    todo = geocode_worklist(agencies, cache(spark))
    assert sorted(r["query"] for r in todo.collect()) == [
        "Atlantis, California", "Busy, California", "Fresno, California"]

    def geocode(q):
        if q.startswith("Busy"):
            raise RuntimeError("service declined")
        return (36.74, -119.79) if q.startswith("Fresno") else None

    got = {r["agency"]: r for r in resolve_with_function(todo, geocode).collect()}
    assert got["Fresno"]["status"] == "resolved" and got["Fresno"]["lat"] == 36.74
    assert got["Atlantis"]["status"] == "not_found" and got["Atlantis"]["lat"] is None
    assert "Busy" not in got                     # declined: stays on the worklist


def test_table_resolver_and_upsert(spark):
    todo = spark.createDataFrame([("Fresno", "Fresno, California"), ("Atlantis", "Atlantis, California")],
                                 "agency string, query string")
    gaz = spark.createDataFrame([("Fresno, California", 36.74, -119.79)], "query string, lat double, lon double")
    answers = resolve_with_table(todo, gaz)
    stale = spark.createDataFrame([("Oakland", 1.0, 1.0, "resolved", dt.datetime(2015, 1, 1))],
                                  "agency string, lat double, lon double, status string, updated_at timestamp")
    merged = upsert_locations(cache(spark).unionByName(stale), answers, dt.datetime(2016, 3, 2))
    rows = {r["agency"]: r for r in merged.collect()}
    assert len(rows) == 4
    assert rows["Oakland"]["lat"] == 37.8                 # newer cache entry wins over the stale one
    assert rows["Fresno"]["status"] == "resolved"
    assert rows["Atlantis"]["status"] == "not_found"


def test_latest_wins_prefers_resolved_on_ties(spark):
    df = spark.createDataFrame([("A", None, None, "not_found", T0), ("A", 1.0, 2.0, "resolved", T0)],
                               "agency string, lat double, lon double, status string, updated_at timestamp")
    r = latest_locations(df).first()
    assert r["status"] == "resolved" and r["lat"] == 1.0


def test_location_csv_roundtrip(spark, tmp_path):
    src = tmp_path / "location_lon_lat.csv"
    src.write_text("Oakland,37.8,-122.27\nbad line\nFresno,0,0\nOakland,37.9,-122.3\nx,1,2,3\n")
    loc = read_location_csv(spark, str(src))
    rows = {r["agency"]: r for r in loc.collect()}
    assert rows["Oakland"]["lat"] == 37.9                 # later duplicate wins
    assert rows["Fresno"]["status"] == "not_found" and rows["Fresno"]["lat"] is None
    assert set(rows) == {"Oakland", "Fresno"}             # lines without exactly 3 fields ignored
    out = str(tmp_path / "locations")
    write_locations(loc, out)
    back = {r["agency"]: r for r in read_location_csv(spark, out + "/*.csv").collect()}
    assert back["Oakland"]["lat"] == 37.9 and back["Fresno"]["status"] == "not_found"
    assert F is not None


def test_lookup_and_worklist_partition_the_agencies(spark):
    """J1 keeps one row per agency; worklist and cache hits split the agencies."""
    from conftest import SF_SMALL
    from wagelens.operators.stats import agency_stats
    from wagelens.sources.tables import location_view, pay_view
    pay = pay_view(spark, SF_SMALL)
    stats = agency_stats(pay)
    loc = location_view(spark, SF_SMALL)
    located = locate(stats, loc)
    assert located.count() == stats.count()
    hits = {r["agency"] for r in located.where("status <> 'pending'").collect()}
    todo = {r["agency"] for r in geocode_worklist(pay, loc).collect()}
    every = {r["agency"] for r in stats.collect()}
    assert hits | todo == every and not (hits & todo)


def test_bom_is_dropped(spark, tmp_path):
    from wagelens.sources.payroll_csv import read_payroll
    f = tmp_path / "2015-payroll.csv"
    f.write_bytes("\ufeffEmployee Name,Job Title,Base Pay,Overtime Pay,Other Pay,Benefits,Total Pay,"
                  "Total Pay & Benefits,Year,Notes,Agency,Status\nA,x,1,2,3,4,5,6,2015,n,Oak,FT\n"
                  .encode("utf-8"))
    rows = read_payroll(spark, str(f)).collect()
    assert [r["employee_name"] for r in rows] == ["A"]


def test_location_csv_quoted_names(spark, tmp_path):
    src = tmp_path / "location_lon_lat.csv"
    src.write_text('"San Francisco, City of",37.77,-122.42\n"Say ""Hi"" Town",36.1,-119.2\n')
    rows = {r["agency"]: r for r in read_location_csv(spark, str(src)).collect()}
    assert rows["San Francisco, City of"]["lat"] == 37.77
    assert rows['Say "Hi" Town']["lon"] == -119.2
