"""Ingest once, report from silver: the chart tables of the original report."""
from __future__ import annotations

from pathlib import Path

from conftest import FIXTURES
from wagelens.plans.jobs import ingest_job, report_job
from wagelens.schema import BAY_AREA, CALIFORNIA, MapRun
from wagelens.session import scratch_path


def test_ingest_then_report(spark):
    base = scratch_path(spark, "jobs-test")
    silver, out = f"{base}/table", f"{base}/out"
    ingest_job(spark, str(FIXTURES / "20*-payroll.csv"), silver)
    loc = Path(scratch_path(spark, "loc")) / "location_lon_lat.csv"
    loc.parent.mkdir(parents=True, exist_ok=True)
    loc.write_text("Oakland,37.80,-122.27\nDavis,38.54,-121.74\nFresno,0,0\n")
    runs = (MapRun.of(CALIFORNIA, 10, (2011, 2012, 2013)), MapRun.of(BAY_AREA, 8, (2011,)))
    report_job(spark, silver, str(loc), out, runs)

    hist = {(r["year"], r["bin_idx"]): r for r in spark.read.parquet(f"{out}/hist_by_year").collect()}
    # 2013 totals: Lower 200000, Three 0, Huge (null), Neg -1 -> bins 0 and 6, n_total 4
    assert hist[(2013, 0)]["n"] == 1 and hist[(2013, 6)]["n"] == 1 and hist[(2013, 0)]["n_total"] == 4
    stats = {r["year"]: r for r in spark.read.parquet(f"{out}/year_stats").collect()}
    assert stats[2014]["n_total"] == 1 and stats[2014]["mean_value"] is None
    axis = spark.read.parquet(f"{out}/year_axis").first()
    assert (axis["lo"], axis["hi"]) == (2010, 2015)
    work = {r["agency"] for r in spark.read.parquet(f"{out}/geocode_worklist").collect()}
    assert work == {"San Jose"}
    counts = {r["year"]: (r["n_agencies"], r["n_located"])
              for r in spark.read.parquet(f"{out}/location_counts").collect()}
    assert counts[2011] == (3, 1)          # Oakland located; Fresno not found; San Jose pending
    cells = spark.read.parquet(f"{out}/map_cells").collect()
    assert {(r["map_name"], r["year"]) for r in cells} == {("california", 2011), ("california", 2012),
                                                           ("california", 2013), ("bay_area", 2011)}
    assert sum(r["n_points"] for r in cells if r["map_name"] == "california") == 3


def test_single_map_without_year_filter(spark):
    """The v2 run: one map over every record of a file, whatever its year."""
    from wagelens.plans.reports import location_map
    from wagelens.schema import CALIFORNIA
    pay = spark.createDataFrame([(2011, "A", 100.0), (2012, "A", 300.0), (2012, "B", 50.0)],
                                "year int, agency string, pay double")
    loc = spark.createDataFrame([("A", 37.0, -120.0, "resolved"), ("B", 36.0, -119.0, "resolved")],
                                "agency string, lat double, lon double, status string")
    _, lon_0, lat_0, w, h = CALIFORNIA
    cells = location_map(pay, loc, None, lon_0, lat_0, w, h, 250).collect()
    assert sum(r["n_points"] for r in cells) == 2
    means = sorted(r["mean"] for r in cells)
    assert means == [0.05, 0.2]                     # agency A: (100 + 300) / 2 / 1000


def test_job_codes_join_and_industry_stats(spark, tmp_path):
    from wagelens.operators.stats import industry_stats
    from wagelens.sources.locations import read_job_codes
    codes_csv = tmp_path / "JobCode.csv"
    codes_csv.write_text('0101,Clerk\n0102,"Clerk, Senior"\n0201,Police Officer\n')
    codes = read_job_codes(spark, str(codes_csv))
    assert {r["major"] for r in codes.collect()} == {"01", "02"}
    pay = spark.createDataFrame([("Clerk", 10.0), ("Clerk, Senior", 20.0), ("Police Officer", 40.0),
                                 ("Unknown", 1.0)], "job_title string, pay double")
    got = {r["major"]: r for r in industry_stats(pay, codes, "job_title", "job_title", "code",
                                                 "pay").collect()}
    assert got["01"]["n"] == 2 and got["01"]["s"] == 30.0 and got["01"]["mean"] == 15.0
    # a left join: the title without a code is counted under no major
    assert got["02"]["n"] == 1 and got[None]["n"] == 1 and set(got) == {"01", "02", None}


def test_industry_stats_neither_lose_nor_repeat_facts(spark):
    from wagelens.operators.stats import industry_stats
    facts = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0)], "t string, v double")
    codes = spark.createDataFrame([("a", "0201"), ("a", "0102"), (None, "03")], "t string, code string")
    got = {r["major"]: (r["n"], r["s"]) for r in industry_stats(facts, codes, "t", "t", "code", "v").collect()}
    assert got == {"01": (2, 3.0), None: (1, 4.0)}


def test_huge_amounts_do_not_end_the_report(spark, tmp_path):
    base = scratch_path(spark, "huge")
    f = tmp_path / "2011-payroll.csv"
    f.write_text("".join(f"N{i},x,1,2,3,4,5,{9 * 10 ** 15 if i % 2 else i},2011,n,Oakland,FT\n" for i in range(300)))
    ingest_job(spark, str(f), f"{base}/silver")
    loc = tmp_path / "location_lon_lat.csv"
    loc.write_text("Oakland,37.80,-122.27\n")
    report_job(spark, f"{base}/silver", str(loc), f"{base}/out", (MapRun.of(CALIFORNIA, 10, (2011,)),))
    row = spark.read.parquet(f"{base}/out/year_stats").first()
    assert row["n"] == 300 and abs(row["std_value"] / 4.5e15 - 1) < 1e-9


def test_cli_ingest_and_report(spark, tmp_path):
    from wagelens.plans.jobs import main
    base = scratch_path(spark, "cli-test")
    loc = tmp_path / "location_lon_lat.csv"
    loc.write_text("Oakland,37.80,-122.27\n")
    assert main(["ingest", str(FIXTURES / "20*-payroll.csv"), f"{base}/silver"]) == 0
    assert main(["report", f"{base}/silver", str(loc), f"{base}/out"]) == 0
    assert spark.read.parquet(f"{base}/out/year_stats").count() == 4


def test_year_predicate_pushdown_and_empty_list(spark):
    from conftest import SF_SMALL
    from wagelens.sources.tables import pay_view
    assert pay_view(spark, SF_SMALL, []).count() == 0
    some = pay_view(spark, SF_SMALL, [1996, 1998])
    years = {r["year"] for r in some.select("year").distinct().collect()}
    assert years == {1996, 1998}


def test_ingest_writes_reason_summary(spark):
    base = scratch_path(spark, "summary-test")
    ingest_job(spark, str(FIXTURES / "20*-payroll.csv"), f"{base}/silver")
    from wagelens.sources.silver import summary as view
    summary = {r["reason"]: (r["n"], r["lines"]) for r in view(spark, f"{base}/silver").collect()}
    assert summary["malformed_quote"] == (2, 2)     # "Bad"tail and the unclosed quote, one line each
    assert summary["extra_cells"][0] == 1 and summary["out_of_range"][0] == 1


def test_report_summary_lines(spark, tmp_path):
    from wagelens.plans.jobs import report_summary
    base = scratch_path(spark, "summary-lines")
    ingest_job(spark, str(FIXTURES / "20*-payroll.csv"), f"{base}/silver")
    loc = tmp_path / "location_lon_lat.csv"
    loc.write_text("Oakland,37.80,-122.27\nDavis,38.54,-121.74\n")
    report_job(spark, f"{base}/silver", str(loc), f"{base}/out",
               (MapRun.of(CALIFORNIA, 10, (2011, 2012)),))
    lines = report_summary(spark, f"{base}/out")
    assert lines[0] == "13 payroll records are found."
    assert lines[1] == "years: [2011, 2012, 2013, 2014]"
    assert "california 2011: 1 located of 3 agencies" in lines


def test_first_records_in_file_order_on_silver(spark):
    from wagelens.operators.stats import first_records
    base = scratch_path(spark, "first-records")
    ingest_job(spark, str(FIXTURES / "20*-payroll.csv"), f"{base}/silver")
    from wagelens.sources.silver import silver as view
    silver = view(spark, f"{base}/silver")
    rows = first_records(silver, 3, ["file", "line_no"]).collect()
    assert [r["employee_name"] for r in rows] == ["Doe, Jane", "Multi", "Esc"]


def test_report_restricted_to_years_prunes_partitions(spark, tmp_path):
    from wagelens.plans.jobs import main, silver_pay
    base = scratch_path(spark, "years-test")
    ingest_job(spark, str(FIXTURES / "20*-payroll.csv"), f"{base}/silver")
    plan = silver_pay(spark, f"{base}/silver", [2012])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2012" in plan
    loc = tmp_path / "location_lon_lat.csv"
    loc.write_text("Oakland,37.80,-122.27\n")
    assert main(["report", f"{base}/silver", str(loc), f"{base}/out", "--years=2012,2013"]) == 0
    years = sorted(r["year"] for r in spark.read.parquet(f"{base}/out/year_stats").collect())
    assert years == [2012, 2013]
