"""Report runs: per-year histogram + statistics, and the location maps.

The original job reads all files once per map (eight maps, eight scans and
eight shuffles). Here ``map_report`` draws every (window, year) map from
ONE aggregation of the facts: sum/count per (year, agency), one join with
the location table, the caller's maps as a literal array, the extents by an
aggregate over (map, year) of those points, and one cell aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wagelens.functions.geo import hex_rows
from wagelens.operators.hexbin import hexbin, project
from wagelens.operators.locate import locate, located_only
from wagelens.operators.stats import agency_stats, year_report
from wagelens.schema import PAY_EDGES, MapRun


def histogram_report(pay: DataFrame, edges: Sequence[float] = PAY_EDGES) -> tuple[DataFrame, DataFrame]:
    """(per-year mean/std/count, long per-year histogram) from one pass."""
    return year_report(pay, "pay", "year", edges)


def location_map(pay: DataFrame, locations: DataFrame, year: int | None, lon_0: float, lat_0: float,
                 width: float, height: float, gridsize: int) -> DataFrame:
    """One map: agencies of one year (or of all records when ``year`` is None),
    projected and hex-binned."""
    if year is None:                      # one map over every record: a single group
        facts, key = pay.withColumn("_map", F.lit(0)), "_map"
    else:                                 # keyed by year, so the extent window has a real key
        facts, key = pay.where(F.col("year") == year), "year"
    stats = agency_stats(facts, by=[key, "agency"])
    pts = project(located_only(locate(stats, locations)), lon_0, lat_0, width, height)
    cells = hexbin(pts, [key], gridsize, hex_rows(gridsize))
    return cells.drop("_map") if year is None else cells


def with_runs(stats: DataFrame, runs: Sequence[MapRun]) -> DataFrame:
    """Each row of (year, agency, ...) once for every map that draws its year.

    A run without years draws every year of the data. The maps are a literal
    array of the caller's list, so no table is joined and no job runs here.
    """
    keys = [(r.name, y) for r in runs for y in (r.years or (None,))]
    if len(set(keys)) != len(keys):
        raise ValueError("each (window, year) may be drawn only once")
    maps = [F.struct(F.lit(r.name).alias("map_name"), F.lit(float(r.lon_0)).alias("lon_0"), F.lit(float(r.lat_0)).alias("lat_0"),
                     F.lit(float(r.width)).alias("width"), F.lit(float(r.height)).alias("height"),
                     F.lit(float(r.gridsize)).alias("nx"), F.lit(float(hex_rows(r.gridsize))).alias("ny"),
                     F.array(*(F.lit(int(y)) for y in r.years)).cast("array<int>").alias("years")) for r in runs]
    if not maps:
        raise ValueError("no map to draw")
    each = stats.withColumn("_map", F.explode(F.array(*maps)))
    each = each.where((F.size("_map.years") == 0) | F.array_contains(F.col("_map.years"), F.col("year")))
    return each.select(*stats.columns, "_map.map_name", "_map.lon_0", "_map.lat_0", "_map.width", "_map.height",
                       "_map.nx", "_map.ny")


def map_report(pay: DataFrame, locations: DataFrame, runs: Sequence[MapRun]) -> DataFrame:
    """All maps in one job: map_name, year, hx2, hy2, cx, cy, n_points, mean, mean_clipped."""
    if all(r.years for r in runs):
        pay = pay.where(F.col("year").isin(sorted({y for r in runs for y in r.years})))
    return map_report_from_stats(agency_stats(pay, by=["year", "agency"]), locations, runs)


def map_report_from_stats(stats: DataFrame, locations: DataFrame, runs: Sequence[MapRun]) -> DataFrame:
    """The fused map job on per-(year, agency) statistics (year, agency, mean_k)."""
    pts = located_only(locate(stats.select("year", "agency", "mean_k"), locations))
    pts = with_runs(pts, runs)
    pts = project(pts, F.col("lon_0"), F.col("lat_0"), F.col("width"), F.col("height"))
    return hexbin(pts, ["map_name", "year"], "nx", "ny")
