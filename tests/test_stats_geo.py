"""Properties of the histogram, statistics, projection and hex binning."""
from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wagelens.functions.geo import hex_rows, lcc_xy
from wagelens.operators.hexbin import hexbin
from wagelens.operators.histogram import fixed_histogram
from wagelens.operators.stats import group_stats, year_report
from wagelens.schema import PAY_EDGES

VALUES = st.one_of(st.none(), st.floats(min_value=-5e4, max_value=4e5, allow_nan=False),
                   st.sampled_from([0.0, 9999.99, 10000.0, 200000.0, -1.0, float("inf")]))


def numpy_bins(values, edges):
    """np.histogram of the non-null values (out of range and NaN dropped)."""
    data = [v for v in values if v is not None]
    return np.histogram(data, bins=edges)[0].tolist() if data else [0] * (len(edges) - 1)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(2011, 2013), VALUES), min_size=1, max_size=60))
def test_histogram_matches_numpy(spark, rows):
    df = spark.createDataFrame(rows, "year int, pay double")
    got = {(r["year"], r["bin_idx"]): (r["n"], r["n_total"])
           for r in fixed_histogram(df, "pay", "year").collect()}
    for y in {y for y, _ in rows}:
        vals = [v for yy, v in rows if yy == y]
        want = numpy_bins(vals, list(PAY_EDGES))
        assert [got[(y, i)][0] for i in range(7)] == want
        assert all(got[(y, i)][1] == len(vals) for i in range(7))


def test_histogram_edges_and_denominator(spark):
    rows = [(2011, None), (2011, -1.0), (2011, 0.0), (2011, 9999.99), (2011, 10000.0), (2011, 200000.0)]
    df = spark.createDataFrame(rows, "year int, pay double")
    h = {r["bin_idx"]: r for r in fixed_histogram(df, "pay", "year").collect()}
    assert [h[i]["n"] for i in range(7)] == [2, 1, 0, 0, 0, 0, 1]
    assert h[0]["n_total"] == 6 and h[0]["pct"] == pytest.approx(2 / 6 * 100)
    assert h[0]["pct_err"] == pytest.approx(math.sqrt(2) / 6 * 100)
    assert [h[i]["bin_label"] for i in range(7)] == ["0 k", "10 k", "20 k", "50 k", "100 k",
                                                     "150 k", "200 k"]


def test_histogram_invariant_under_repartition(spark):
    df = spark.range(5000).select((F.col("id") % 4 + 2011).cast("int").alias("year"),
                                  (F.col("id") * 97 % 250000).cast("double").alias("pay"))
    a = sorted(fixed_histogram(df, "pay", "year").collect())
    b = sorted(fixed_histogram(df.repartition(13), "pay", "year").collect())
    assert a == b


def test_population_std_and_null_years(spark):
    df = spark.createDataFrame([(2011, 1.0), (2011, 3.0), (2012, None)], "year int, pay double")
    stats, hist = year_report(df)
    s = {r["year"]: r for r in stats.collect()}
    assert s[2011]["mean_value"] == 2.0 and s[2011]["std_value"] == 1.0   # population std
    assert s[2012]["mean_value"] is None and s[2012]["std_value"] is None and s[2012]["n_total"] == 1
    g = {r["year"]: r for r in group_stats(df, "pay", "year").collect()}
    assert g[2011]["n_null"] == 0 and g[2012]["n_null"] == 1


def test_projection_maps_centre_to_window_middle(spark):
    df = spark.createDataFrame([(-119.0, 37.2)], "lon double, lat double")
    x, y = lcc_xy(F.col("lon"), F.col("lat"), -119.0, 37.2, 1000000.0, 1200000.0)
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(500000.0, abs=1e-6)
    assert r["y"] == pytest.approx(600000.0, abs=1e-6)


def test_projection_is_conformal_lcc(spark):
    """Points on the same parallel are equidistant from the cone apex."""
    df = spark.createDataFrame([(-125.0, 40.0), (-113.0, 40.0)], "lon double, lat double")
    x, y = lcc_xy(F.col("lon"), F.col("lat"), -119.0, 37.2, 1e6, 1.2e6)
    a, b = df.select(x.alias("x"), y.alias("y")).collect()
    assert a["y"] == pytest.approx(b["y"], abs=1e-6)
    assert a["x"] - 5e5 == pytest.approx(5e5 - b["x"], abs=1e-6)


def numpy_hexbin(x, y, c, nx):
    """Direct per-point implementation of the hexbin lattice (mean of C per cell)."""
    ny = int(nx / math.sqrt(3))
    x, y = np.asarray(x, float), np.asarray(y, float)
    xmin, xmax, ymin, ymax = x.min(), x.max(), y.min(), y.max()
    if xmax - xmin <= max(abs(xmin), abs(xmax)) * 1e-15:
        xmin, xmax = (-0.1, 0.1) if xmin == xmax == 0 else (xmin - 0.1 * abs(xmin), xmax + 0.1 * abs(xmax))
    if ymax - ymin <= max(abs(ymin), abs(ymax)) * 1e-15:
        ymin, ymax = (-0.1, 0.1) if ymin == ymax == 0 else (ymin - 0.1 * abs(ymin), ymax + 0.1 * abs(ymax))
    pad = 1e-9 * (xmax - xmin)
    xmin, xmax = xmin - pad, xmax + pad
    sx, sy = (xmax - xmin) / nx, (ymax - ymin) / ny
    cells = {}
    for xi, yi, ci in zip(x, y, c):
        ix, iy = (xi - xmin) / sx, (yi - ymin) / sy
        ix1, iy1 = np.round(ix), np.round(iy)
        ix2, iy2 = np.floor(ix), np.floor(iy)
        d1 = (ix - ix1) ** 2 + 3.0 * (iy - iy1) ** 2
        d2 = (ix - ix2 - 0.5) ** 2 + 3.0 * (iy - iy2 - 0.5) ** 2
        if d1 < d2:
            if 0 <= ix1 <= nx and 0 <= iy1 <= ny:
                cells.setdefault((2 * int(ix1), 2 * int(iy1)), []).append(ci)
        elif 0 <= ix2 < nx and 0 <= iy2 < ny:
            cells.setdefault((2 * int(ix2) + 1, 2 * int(iy2) + 1), []).append(ci)
    return {k: (len(v), round(float(np.mean(v)), 6)) for k, v in cells.items()}


@pytest.mark.parametrize("seed,nx", [(1, 5), (2, 12), (3, 40)])
def test_hexbin_matches_direct_lattice(spark, seed, nx):
    rng = np.random.default_rng(seed)
    n = 300
    x = rng.integers(-20000, 900000, n)
    y = rng.integers(0, 1200000, n)
    c = rng.uniform(0, 200, n)
    df = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(x, y, c)],
                               "x bigint, y bigint, mean_k double")
    got = {(r["hx2"], r["hy2"]): (r["n_points"], r["mean"])
           for r in hexbin(df, [], nx, hex_rows(nx)).collect()}
    want = numpy_hexbin(x, y, c, nx)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0]
        assert got[k][1] == pytest.approx(want[k][1], abs=2e-6)
    assert sum(v[0] for v in got.values()) == n


def test_hexbin_single_point_extent(spark):
    df = spark.createDataFrame([(1000, 2000, 5.0)], "x bigint, y bigint, mean_k double")
    got = hexbin(df, [], 10, hex_rows(10)).collect()
    assert len(got) == 1 and got[0]["n_points"] == 1
    want = numpy_hexbin([1000], [2000], [5.0], 10)
    assert (got[0]["hx2"], got[0]["hy2"]) in want


def test_rollup_levels_equal_separate_aggregates(spark):
    from wagelens.operators.stats import (agency_stats, rollup_agencies, rollup_years, year_agency_rollup,
                                          year_wide)
    rows = [(2011, "A", 10.0), (2011, "A", None), (2011, None, 20000.0), (2012, "B", 250000.0)]
    df = spark.createDataFrame(rows, "year int, agency string, pay double")
    rolled = year_agency_rollup(df)
    assert sorted(rollup_years(rolled).collect()) == sorted(year_wide(df).collect())
    want = agency_stats(df, by=["year", "agency"]).select("year", "agency", "sum_pay", "n", "n_total",
                                                          "max_pay", "mean_k")
    assert sorted(rollup_agencies(rolled).collect(), key=str) == sorted(want.collect(), key=str)


def test_bin_upper_labels_end_with_inf(spark):
    df = spark.createDataFrame([(2011, 5.0)], "year int, pay double")
    h = sorted(fixed_histogram(df, "pay", "year").collect(), key=lambda r: r["bin_idx"])
    assert [r["bin_hi_label"] for r in h] == ["10 k", "20 k", "50 k", "100 k", "150 k", "200 k", "inf"]


def snyder_lcc(lon, lat, lon0, lat0, width, height, radius=6370997.0):
    """Spherical LCC, one standard parallel (Snyder 1987, eqs. 15-1..15-4), in NumPy."""
    phi, lam = np.radians(lat), np.radians(lon)
    phi0, lam0 = np.radians(lat0), np.radians(lon0)
    n = np.sin(phi0)
    big_f = np.cos(phi0) * np.tan(np.pi / 4 + phi0 / 2) ** n / n
    rho = radius * big_f / np.tan(np.pi / 4 + phi / 2) ** n
    rho0 = radius * big_f / np.tan(np.pi / 4 + phi0 / 2) ** n
    dlam = (lam - lam0 + np.pi) % (2 * np.pi) - np.pi
    theta = n * dlam
    return rho * np.sin(theta) + width / 2, rho0 - rho * np.cos(theta) + height / 2


def test_projection_matches_independent_formula(spark):
    rng = np.random.default_rng(4)
    lon = rng.uniform(-125, -113, 200)
    lat = rng.uniform(32, 42, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat)], "lon double, lat double")
    for lon0, lat0, w, h in ((-119.0, 37.2, 1e6, 1.2e6), (-122.16, 37.72, 1.2e5, 1.2e5)):
        x, y = lcc_xy(F.col("lon"), F.col("lat"), lon0, lat0, w, h)
        got = df.select("lon", "lat", x.alias("x"), y.alias("y")).collect()
        gx = np.array([r["x"] for r in got])
        gy = np.array([r["y"] for r in got])
        wx, wy = snyder_lcc(np.array([r["lon"] for r in got]), np.array([r["lat"] for r in got]),
                            lon0, lat0, w, h)
        assert np.max(np.abs(gx - wx)) < 1e-6 and np.max(np.abs(gy - wy)) < 1e-6


def test_longitude_wraps_across_the_antimeridian(spark):
    df = spark.createDataFrame([(-175.0, 10.0), (185.0, 10.0)], "lon double, lat double")
    x, y = lcc_xy(F.col("lon"), F.col("lat"), 170.0, 10.0, 1e6, 1e6)
    a, b = df.select(x.alias("x"), y.alias("y")).collect()
    assert a["x"] == pytest.approx(b["x"], abs=1e-6) and a["x"] > 5e5   # 15 degrees east
    wx, _ = snyder_lcc(np.array([-175.0]), np.array([10.0]), 170.0, 10.0, 1e6, 1e6)
    assert a["x"] == pytest.approx(float(wx[0]), abs=1e-6)


def test_hex_centres_match_direct_lattice(spark):
    rng = np.random.default_rng(21)
    x = rng.integers(0, 1_000_000, 200)
    y = rng.integers(0, 1_200_000, 200)
    df = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(x, y)], "x bigint, y bigint, mean_k double")
    nx = 7
    ny = hex_rows(nx)
    xmin, xmax, ymin, ymax = float(x.min()), float(x.max()), float(y.min()), float(y.max())
    pad = 1e-9 * (xmax - xmin)
    x0, sx, sy = xmin - pad, ((xmax + pad) - (xmin - pad)) / nx, (ymax - ymin) / ny
    for r in hexbin(df, [], nx, ny).collect():
        assert r["cx"] == pytest.approx(x0 + r["hx2"] / 2 * sx, rel=1e-12)
        assert r["cy"] == pytest.approx(ymin + r["hy2"] / 2 * sy, rel=1e-12)
