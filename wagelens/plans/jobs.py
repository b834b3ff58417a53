"""The batch jobs a user runs: ingest once, then report from the silver table.

``ingest_job``  payroll CSV glob -> payroll table (valid rows, quarantine and
                summary are its views, see ``sources.silver``).
``report_job``  valid rows -> chart-ready tables: per-year histogram and
                statistics (one aggregation pass), year axis, agency stats,
                location counts, geocoding worklist and all map cells of the
                report runs (one fused job).

Usage:
  python -m wagelens.plans.jobs ingest SRC_GLOB TABLE [quotes|pairwise]
  python -m wagelens.plans.jobs report TABLE LOCATIONS_CSV OUT_DIR [--years=2011,2012]
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagelens.operators.locate import geocode_worklist, locate
from wagelens.operators.stats import (rollup_agencies, rollup_years, stats_from_wide, year_agency_rollup,
                                      year_axis)
from wagelens.operators.histogram import explode_bins
from wagelens.plans.reports import map_report_from_stats
from wagelens.schema import PAY_EDGES, REPORT_RUNS, MapRun
from wagelens.session import ensure_checkpoint_dir
from wagelens.sources.locations import read_location_csv
from wagelens.sources import silver
from wagelens.sources.lines import QUOTES
from wagelens.sources.payroll_csv import read_payroll


def ingest_job(spark: SparkSession, source: str, table: str, mode: str = QUOTES) -> int:
    """Parse a glob and write its rows to the payroll table in one pass; returns the run's number.

    A file that is read again (same full path) replaces its own rows, valid
    and rejected; other files keep theirs (``sources.silver``).
    """
    listed = spark.createDataFrame([(f,) for f in spark.read.text(source).inputFiles()], "file STRING")
    # the listing writes file:///x where the rows' metadata has file:/x
    listed = listed.select(F.regexp_replace("file", "^file:///", "file:/").alias("file"))
    return silver.write_run(read_payroll(spark, source, mode), listed, table)


def silver_pay(spark: SparkSession, table: str, years: Sequence[int] | None = None) -> DataFrame:
    """(year, agency, job, pay) of the payroll table's valid rows; a year list prunes folders."""
    df = silver.silver(spark, table)
    if years is not None:
        df = df.where(F.col("year").isin(list(years)))
    return df.select("year", "agency", F.col("job_title").alias("job"),
                     F.col("total_pay_benefits").alias("pay"))


def report_job(spark: SparkSession, table: str, locations: str, out_dir: str,
               runs: Sequence[MapRun] = REPORT_RUNS, edges: Sequence[float] = PAY_EDGES,
               parallel_writes: int = 4, years: Sequence[int] | None = None) -> None:
    """One pass over the silver table, everything else from its small result.

    ``rollup(year, agency)`` yields the per-year bin counts and moments
    (histogram, statistics, axis) and the per-(year, agency) sums (agency
    table, location counts, worklist, all maps) from one scan. The result
    (years x agencies rows) is checkpointed into the shared folder, which
    also cuts its lineage from the silver scan. The output tables are then
    independent small jobs, submitted concurrently from ``parallel_writes``
    driver threads. ``years`` restricts the report to those year partitions
    (partition pruning: other years are not read).
    """
    ensure_checkpoint_dir(spark)             # the shared folder checkpoint() writes to
    pay = silver_pay(spark, table, years)
    rolled = year_agency_rollup(pay, "pay", "year", "agency", edges).checkpoint()
    wide = rollup_years(rolled)
    per_agency = rollup_agencies(rolled)
    loc = read_location_csv(spark, locations)
    located = locate(per_agency, loc)
    outputs = {
        "hist_by_year": explode_bins(wide, ["year"], edges),
        "year_stats": stats_from_wide(wide),
        "year_axis": year_axis(wide),
        "agency_stats": located,
        "location_counts": located.groupBy("year").agg(F.count(F.lit(1)).alias("n_agencies"),
                                                       F.count("lat").alias("n_located")),
        "geocode_worklist": geocode_worklist(per_agency, loc),
        "map_cells": map_report_from_stats(per_agency, loc, runs),
    }

    def write(item):
        name, df = item
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")

    with ThreadPoolExecutor(max_workers=max(1, parallel_writes)) as pool:
        list(pool.map(write, outputs.items()))      # re-raises the first failed write


def report_summary(spark: SparkSession, out_dir: str) -> list[str]:
    """Console lines like the original run's: records, filled years, places per map.

    Reads the small written tables only (one row per year / per map cell).
    """
    stats = spark.read.parquet(f"{out_dir}/year_stats")
    counts = spark.read.parquet(f"{out_dir}/location_counts")
    cells = spark.read.parquet(f"{out_dir}/map_cells")
    total = stats.agg(F.sum("n_total").alias("n")).first()["n"] or 0
    years = [r["year"] for r in stats.where("n_total > 0").orderBy("year").select("year").collect()]
    lines = [f"{total} payroll records are found.", f"years: {years}"]
    per_year = {r["year"]: (r["n_agencies"], r["n_located"]) for r in counts.collect()}
    for r in (cells.groupBy("map_name", "year").agg(F.sum("n_points").alias("n"))
              .orderBy("map_name", "year").collect()):
        agencies = per_year.get(r["year"], (0, 0))[0]
        lines.append(f"{r['map_name']} {r['year']}: {r['n']} located of {agencies} agencies")
    return lines


def main(argv: Sequence[str]) -> int:
    from wagelens.session import build_session
    spark = build_session()
    cmd, *args = argv
    years = None
    for a in [a for a in args if a.startswith("--years=")]:
        years = [int(y) for y in a.split("=", 1)[1].split(",") if y]
        args.remove(a)
    if cmd == "ingest":
        ingest_job(spark, *args[:2], *(args[2:3] or [QUOTES]))
    elif cmd == "report":
        report_job(spark, *args[:3], years=years)
        print("\n".join(report_summary(spark, args[2])))
    else:
        raise SystemExit(__doc__)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
