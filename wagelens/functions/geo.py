"""Map projection and hexagonal lattice as Column expressions (no UDF).

Projection: spherical Lambert conformal conic with one standard parallel
(Snyder 1987, USGS Professional Paper 1395). The origin is the lower-left
corner of a ``width`` x ``height`` window centred on (lon_0, lat_0).

Hex lattice (Carr et al. 1987): ``nx`` hexagons across the data extent,
``ny = floor(nx / sqrt 3)`` rows; two interleaved lattices, a point goes to
the nearer centre, the first lattice only when strictly nearer. Cells are
keyed by doubled indices: (2i, 2j) on the first lattice, (2i+1, 2j+1) on
the second.

Every parameter may be a Python number or a Column, so one plan can carry
many windows at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagelens.schema import SPHERE_RADIUS_M


DEG = math.pi / 180.0          # degrees -> radians, one multiplication
QUARTER_PI = math.pi / 4.0


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def wrap_degrees(d: Column) -> Column:
    """Wrap a longitude difference into [-180, 180)."""
    return d - F.lit(360.0) * F.floor((d + F.lit(180.0)) / F.lit(360.0))


def lcc_xy(lon: Column, lat: Column, lon_0, lat_0, width, height,
           lat_1=None, radius=SPHERE_RADIUS_M) -> tuple[Column, Column]:
    lon_0, lat_0, width, height = map(_c, (lon_0, lat_0, width, height))
    lat_1 = lat_0 if lat_1 is None else _c(lat_1)
    radius = _c(radius)
    quarter, half, deg = F.lit(QUARTER_PI), F.lit(2.0), F.lit(DEG)
    phi1 = lat_1 * deg
    n = F.sin(phi1)
    f = F.cos(phi1) * F.pow(F.tan(quarter + phi1 / half), n) / n
    rho0 = radius * f / F.pow(F.tan(quarter + (lat_0 * deg) / half), n)
    rho = radius * f / F.pow(F.tan(quarter + (lat * deg) / half), n)
    theta = n * (wrap_degrees(lon - lon_0) * deg)
    x = rho * F.sin(theta) + width / half
    y = rho0 - rho * F.cos(theta) + height / half
    return x, y


def truncate_m(v: Column) -> Column:
    """Whole metres toward zero (int() of the original job)."""
    return v.cast("bigint")


def inside_window(x: Column, y: Column, width, height) -> Column:
    width, height = _c(width), _c(height)
    return x.between(F.lit(0.0), width) & y.between(F.lit(0.0), height)


def hex_rows(nx: int) -> int:
    return int(nx / math.sqrt(3))


def nonsingular_lo(lo: Column, hi: Column) -> Column:
    """Lower extent, widened by 10% when the extent is a single value."""
    return (F.when((lo == 0) & (hi == 0), F.lit(-0.1))
            .when(hi - lo <= F.greatest(F.abs(lo), F.abs(hi)) * F.lit(1e-15),
                  lo - F.lit(0.1) * F.abs(lo))
            .otherwise(lo.cast("double")))


def nonsingular_hi(lo: Column, hi: Column) -> Column:
    return (F.when((lo == 0) & (hi == 0), F.lit(0.1))
            .when(hi - lo <= F.greatest(F.abs(lo), F.abs(hi)) * F.lit(1e-15),
                  hi + F.lit(0.1) * F.abs(hi))
            .otherwise(hi.cast("double")))


def with_hex_cell(df: DataFrame, x: str, y: str, nx, ny) -> DataFrame:
    """Add doubled lattice indices (hx2, hy2) of the hexagon holding (x, y).

    Needs the widened extents as columns xmin, xmax, ymin, ymax. Each step
    is its own column so the expressions stay small for code generation;
    points outside both lattices get null indices.
    """
    nx, ny = _c(nx), _c(ny)
    c = F.col
    out = (df.withColumn("_pad", F.lit(1e-9) * (c("xmax") - c("xmin")))
           .withColumn("_x0", c("xmin") - c("_pad"))
           .withColumn("_sx", F.try_divide((c("xmax") + c("_pad")) - c("_x0"), nx))
           .withColumn("_sy", F.try_divide(c("ymax") - c("ymin"), ny))
           .withColumn("_ix", F.try_divide(c(x) - c("_x0"), c("_sx")))
           .withColumn("_iy", F.try_divide(c(y) - c("ymin"), c("_sy")))
           .withColumn("_ix1", F.bround(c("_ix"), 0)).withColumn("_iy1", F.bround(c("_iy"), 0))
           .withColumn("_ix2", F.floor(c("_ix")).cast("double"))
           .withColumn("_iy2", F.floor(c("_iy")).cast("double")))
    dx1, dy1 = c("_ix") - c("_ix1"), c("_iy") - c("_iy1")
    dx2, dy2 = c("_ix") - c("_ix2") - F.lit(0.5), c("_iy") - c("_iy2") - F.lit(0.5)
    out = (out.withColumn("_d1", dx1 * dx1 + F.lit(3.0) * (dy1 * dy1))
           .withColumn("_d2", dx2 * dx2 + F.lit(3.0) * (dy2 * dy2)))
    first = c("_d1") < c("_d2")
    ok1 = (c("_ix1") >= 0) & (c("_ix1") <= nx) & (c("_iy1") >= 0) & (c("_iy1") <= ny)
    ok2 = (c("_ix2") >= 0) & (c("_ix2") < nx) & (c("_iy2") >= 0) & (c("_iy2") < ny)
    out = (out.withColumn("_lat", F.when(first & ok1, F.lit(1)).when(~first & ok2, F.lit(2)))
           .withColumn("hx2", F.when(c("_lat") == 1, F.lit(2) * c("_ix1").cast("int"))
                       .when(c("_lat") == 2, F.lit(2) * c("_ix2").cast("int") + F.lit(1)))
           .withColumn("hy2", F.when(c("_lat") == 1, F.lit(2) * c("_iy1").cast("int"))
                       .when(c("_lat") == 2, F.lit(2) * c("_iy2").cast("int") + F.lit(1))))
    return out.drop("_pad", "_x0", "_sx", "_sy", "_ix", "_iy", "_ix1", "_iy1", "_ix2", "_iy2",
                    "_d1", "_d2", "_lat")


def hex_centre(hx2: Column, hy2: Column, xmin: Column, xmax: Column,
               ymin: Column, ymax: Column, nx, ny) -> tuple[Column, Column]:
    nx, ny = _c(nx), _c(ny)
    pad = F.lit(1e-9) * (xmax - xmin)
    x0, x1 = xmin - pad, xmax + pad
    sx = F.try_divide(x1 - x0, nx)
    sy = F.try_divide(ymax - ymin, ny)
    return x0 + hx2 / F.lit(2.0) * sx, ymin + hy2 / F.lit(2.0) * sy
