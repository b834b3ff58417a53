"""Physical-plan checks: the plans we want, not just the right rows."""
from __future__ import annotations

import re

import pytest

from conftest import SF_CHECK
from wagelens.plans import catalog as entry


def final_plan(df) -> str:
    """Executed (AQE final) plan of this very query execution."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan \w+ .*?{table}", plan))


@pytest.fixture(scope="module")
def q():
    return entry.queries()


#: Queries that read record files (the stitch walks line codes in Arrow batches) or ask a caller's geocoder.
PYTHON = {"cell_typing", "csv_parse", "strict_reject", "stitch_parity", "stitch_pairwise", "stitch_stray_quote",
          "stitch_unclosed", "tsv_roundtrip", "fail_mode", "resolver_outcomes", "fail_mode_fails"}


def test_python_only_where_records_are_stitched(spark, q):
    for name, fn in q.items():
        plan = fn(spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"EvalPython|PythonUDF|FlatMapGroupsInPandas", plan), name
        assert bool(re.search(r"MapInArrow|MapInPandas", plan)) == (name in PYTHON), name


#: Queries that write the files they read, run a stream, or count in rounds.
WRITERS = {"cell_typing", "csv_parse", "strict_reject", "stitch_stray_quote", "stitch_unclosed", "tsv_roundtrip",
           "fail_mode", "industry_codes", "location_file", "fail_mode_fails", "stream_closed_windows", "stream_latest_windows", "stream_stitch",
           "pay_percentiles", "pay_percentiles_all", "sketch_years", "reingest_removed", "reingest_added", "reingest_kept", "nearest_agency"}


def test_building_a_query_runs_no_job(spark, q):
    sc = spark.sparkContext
    for name, fn in q.items():
        if name in WRITERS:
            continue
        fn(spark, SF_CHECK)                      # footers are read once
        sc.setJobGroup(f"build-{name}", name)
        fn(spark, SF_CHECK)
        jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        sc.setLocalProperty("spark.jobGroup.id", None)
        stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
        assert all(s.name.startswith("parquet at") for s in stages if s), (name, [s.name for s in stages if s])


def test_flagship_is_one_scan_one_small_shuffle(spark, q):
    plan = final_plan(q["hist_by_year"](spark, SF_CHECK))
    assert scans(plan, "orders.parquet") == 1
    # one shuffle: the partial aggregates by year (joins are broadcast at this size)
    assert len(re.findall(r"\bExchange hashpartitioning\(year", plan)) == 1
    assert "partial_count" in plan


def test_fused_maps_scan_facts_once(spark, q):
    plan = final_plan(q["map_report_all"](spark, SF_CHECK))
    assert scans(plan, "orders.parquet") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_location_join_is_broadcast_after_aggregation(spark, q):
    plan = final_plan(q["agency_located"](spark, SF_CHECK))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan


def test_year_filter_reaches_the_scan(spark, q):
    plan = q["year_values"](spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "o_orderdate" in pushed and "GreaterThanOrEqual" in pushed


def test_scan_reads_only_used_columns(spark, q):
    plan = q["hist_by_year"](spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan.split("orders.parquet")[1]).group(1)
    assert "o_orderpriority" not in schema and "o_orderstatus" not in schema


def test_stitch_shuffles_no_single_line_records(spark, q):
    """Texts are stitched in one pass; files with the table of splits (a few numbers each) sent to all tasks."""
    for name in ("stitch_parity", "stitch_pairwise"):
        plan = final_plan(q[name](spark, SF_CHECK))
        assert len(re.findall(r"FileScan (text|parquet)", plan)) == 1 and "Exchange" not in plan, name
    plan = final_plan(q["csv_parse"](spark, SF_CHECK))
    assert "SortMergeJoin" not in plan and len(re.findall(r"Window \[", plan)) <= 4
    for line in plan.splitlines():
        if re.search(r"\bExchange hashpartitioning", line):          # splits, or pieces of crossing records
            assert re.search(r"hashpartitioning\(file#\d+(, line_no#\d+L?)?,", line), line
