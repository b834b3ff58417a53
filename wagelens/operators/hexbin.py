"""Projection of located agencies and hexagonal binning of their means.

Points are (group keys..., agency, x, y, value), one row per agency. The
lattice extent comes from the data of each group, then every point gets a
cell from column arithmetic and cells are aggregated: an unweighted mean of
the point values and the number of points. Only occupied cells are rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wagelens.functions.bins import clamp
from wagelens.functions.geo import (hex_centre, with_hex_cell, inside_window, lcc_xy,
                                    nonsingular_hi, nonsingular_lo, truncate_m)
from wagelens.schema import CLIM_HI, CLIM_LO

MEAN_DIGITS = 6


def project(df: DataFrame, lon_0, lat_0, width, height, lat_1=None) -> DataFrame:
    """Add whole-metre map coordinates x, y (BIGINT) and the window flag."""
    x, y = lcc_xy(F.col("lon"), F.col("lat"), lon_0, lat_0, width, height, lat_1)
    out = df.withColumn("x", truncate_m(x)).withColumn("y", truncate_m(y))
    return out.withColumn("inside", inside_window(F.col("x"), F.col("y"), width, height))


def hexbin(points: DataFrame, keys: Sequence[str], nx, ny, value: str = "mean_k",
           clim: tuple[float, float] = (CLIM_LO, CLIM_HI)) -> DataFrame:
    """Hex cells per group ``keys``: hx2, hy2, cx, cy, n_points, mean, mean_clipped.

    ``nx``/``ny`` are numbers or column names present on ``points``. The
    extent of each group is an aggregate (partial minima and maxima, one row a
    map) joined back; give ``points`` from a checkpointed or written table
    where computing them reads much (``report_job`` does).
    """
    keys = list(keys)
    if not keys:
        return hexbin(points.withColumn("_grp", F.lit(0)), ["_grp"], nx, ny, value, clim).drop("_grp")
    nxc = F.col(nx) if isinstance(nx, str) else F.lit(float(nx))
    nyc = F.col(ny) if isinstance(ny, str) else F.lit(float(ny))
    # the count makes both branches read the same columns, so that they share one exchange of the aggregated points
    box = points.groupBy(*keys).agg(F.count(value).alias("_n"), F.min("x").alias("_x0"), F.max("x").alias("_x1"),
                                    F.min("y").alias("_y0"), F.max("y").alias("_y1")).where("_n >= 0")
    box = box.select(*(F.col(k).alias(f"_key_{k}") for k in keys),
                     nonsingular_lo(F.col("_x0"), F.col("_x1")).alias("xmin"),
                     nonsingular_hi(F.col("_x0"), F.col("_x1")).alias("xmax"),
                     nonsingular_lo(F.col("_y0"), F.col("_y1")).alias("ymin"),
                     nonsingular_hi(F.col("_y0"), F.col("_y1")).alias("ymax"))
    same = [points[k].eqNullSafe(box[f"_key_{k}"]) for k in keys]
    pts = points.join(box, same).drop(*(f"_key_{k}" for k in keys))
    cxy = [F.col(c) for c in ("xmin", "xmax", "ymin", "ymax")]
    extra = [F.first(c).alias(c) for c in (nx, ny) if isinstance(c, str)]
    # Points outside both lattices form a null cell, dropped AFTER the
    # aggregate through its count: a filter on the cell key itself would be
    # pushed below the staged columns and inline the whole lattice expression.
    cells = (with_hex_cell(pts, "x", "y", nxc, nyc)
             .groupBy(*keys, "hx2", "hy2")
             .agg(F.count("hx2").alias("n_points"), F.avg(value).alias("_mean"),
                  F.first("xmin").alias("xmin"), F.first("xmax").alias("xmax"),
                  F.first("ymin").alias("ymin"), F.first("ymax").alias("ymax"), *extra)
             .where(F.col("n_points") > 0))
    cx, cy = hex_centre(F.col("hx2"), F.col("hy2"), *cxy, nxc, nyc)
    mean = F.round(F.col("_mean"), MEAN_DIGITS)
    return cells.select(*keys, "hx2", "hy2", cx.alias("cx"), cy.alias("cy"), "n_points",
                        mean.alias("mean"), clamp(mean, *clim).alias("mean_clipped"))
