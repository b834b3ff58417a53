"""Nearest located place of each point, exactly, without comparing each with each.

The places lie in a quadtree of grid cells, each with the box around its
members. Points go down the tree together: a step joins every point's cells
with their child cells (an equi-join on the parent cell) and keeps those whose
box is no farther than the farthest corner of the best box. So a point has a
few cells at every step however the places are clustered, and nothing that can
hold its nearest place is left out; at the leaves the distances are computed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wagelens.functions.sizing import broadcast_if_small
from wagelens.session import scratch_path

#: Binary digits of a cell's number gained by a step, and levels below those that the number of places asks for.
STEP, DEEPER, DEEPEST = 2, 3, 20


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cell(v, lo: float, width: float, cells: int):
    """Number of the cell of ``v`` among ``cells`` from ``lo`` on; never falling in v."""
    return F.least(F.floor((v - F.lit(lo)) / F.lit(width) * F.lit(float(cells))), F.lit(cells - 1)).cast("long")


def _squared(dx, dy):
    return dx * dx + dy * dy


def nearest(points: DataFrame, places: DataFrame, x: str, y: str, place_id: Sequence[str], place_x: str, place_y: str,
            within: float | None = None) -> DataFrame:
    """``points`` with the nearest place: its ``place_id`` columns and dist2, the squared distance (double).

    Ties go to the least ``place_id``. Points or places without both
    coordinates (null or NaN) take no part: such points, all points where
    there is no place, and points whose nearest place is farther than
    ``within``, have nulls. Equal points are searched once.
    """
    spark, c = points.sparkSession, F.col
    clash = sorted(({*place_id, "dist2"}) & {*points.columns})
    if clash:
        raise ValueError(f"columns of both sides: {clash}")
    known = lambda a, b: a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)                       # noqa: E731
    targets = places.select(c(place_x).cast("double").alias("tx"), c(place_y).cast("double").alias("ty"), *place_id)
    targets = targets.where(known(c("tx"), c("ty")))
    asked = points.select(c(x).cast("double").alias("_x"), c(y).cast("double").alias("_y")).where(known(c("_x"), c("_y"))).distinct()
    ends = targets.agg(F.count(F.lit(1)).alias("n"), F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    kinds = {f.name: f.dataType for f in places.schema.fields}
    nothing = [F.lit(None).cast(kinds[i]).alias(i) for i in place_id] + [F.lit(None).cast("double").alias("dist2")]
    if not ends["n"]:
        return points.select("*", *nothing)
    lo_x, lo_y = ends[1], ends[3]
    width = max(ends[2] - lo_x, ends[4] - lo_y) or 1.0
    levels = min(DEEPEST, math.ceil(math.log(max(ends["n"], 2), 4)) + DEEPER)
    levels += -levels % STEP
    cells = 1 << levels
    leaves = targets.select("*", _cell(c("tx"), lo_x, width, cells).alias("cx"), _cell(c("ty"), lo_y, width, cells).alias("cy"))
    leaves = _written(leaves, "nearest-leaves")
    boxes = leaves.groupBy("cx", "cy").agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"))
    tree = [_written(boxes, "nearest-boxes")]
    for _ in range(levels // STEP - 1):
        up = tree[0].select((F.shiftright("cx", STEP)).alias("cx"), F.shiftright("cy", STEP).alias("cy"), "x0", "x1", "y0", "y1")
        tree.insert(0, _written(up.groupBy("cx", "cy").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"),
                                                           F.min("y0").alias("y0"), F.max("y1").alias("y1")), "nearest-boxes"))
    at = asked.withColumn("cells", F.array(F.struct(F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))))
    for boxes in tree:
        children = boxes.select(F.shiftright("cx", STEP).alias("px"), F.shiftright("cy", STEP).alias("py"), "cx", "cy", "x0", "x1", "y0", "y1")
        now = at.select("_x", "_y", F.explode("cells").alias("p")).select("_x", "_y", c("p.cx").alias("px"), c("p.cy").alias("py"))
        met = now.join(broadcast_if_small(children), ["px", "py"])
        zero = F.lit(0.0)
        near = _squared(F.greatest(c("x0") - c("_x"), c("_x") - c("x1"), zero), F.greatest(c("y0") - c("_y"), c("_y") - c("y1"), zero))
        far = _squared(F.greatest(F.abs(c("x0") - c("_x")), F.abs(c("x1") - c("_x"))),
                       F.greatest(F.abs(c("y0") - c("_y")), F.abs(c("y1") - c("_y"))))
        kept = met.groupBy("_x", "_y").agg(F.min(far).alias("best"), F.collect_list(F.struct("cx", "cy", near.alias("near"))).alias("all"))
        at = kept.select("_x", "_y", F.transform(F.filter("all", lambda b: b["near"] <= c("best")),
                                                 lambda b: F.struct(b["cx"].alias("cx"), b["cy"].alias("cy"))).alias("cells"))
    last = at.select("_x", "_y", F.explode("cells").alias("p")).select("_x", "_y", c("p.cx").alias("cx"), c("p.cy").alias("cy"))
    met = last.join(broadcast_if_small(leaves), ["cx", "cy"])
    found = met.groupBy("_x", "_y").agg(F.min(F.struct(_squared(c("tx") - c("_x"), c("ty") - c("_y")).alias("dist2"), *place_id)).alias("_f"))
    if within is not None:
        found = found.where(c("_f.dist2") <= float(within) ** 2)
    joined = points.join(found, (points[x].cast("double") == c("_x")) & (points[y].cast("double") == c("_y")), "left")
    return joined.select(*(points[n] for n in points.columns), *(c(f"_f.{i}").alias(i) for i in place_id), c("_f.dist2").alias("dist2"))
