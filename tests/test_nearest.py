"""Nearest place against comparing each point with each place: clusters, ties, equal places, missing coordinates."""
from __future__ import annotations

import random

import pytest

from wagelens.operators.nearest import nearest


def brute(points, places, within=None):
    out = []
    for p in points:
        best = min((((t[1] - p[1]) ** 2 + (t[2] - p[2]) ** 2, t[0]) for t in places if t[1] is not None and t[2] is not None),
                   default=None) if p[1] is not None and p[2] is not None else None
        if best is not None and within is not None and best[0] > within ** 2:
            best = None
        out.append((*p, *(reversed(best) if best else (None, None))))
    return sorted(out, key=repr)


def check(spark, points, places, **how):
    p = spark.createDataFrame(points, "id long, x double, y double")
    t = spark.createDataFrame(places, "agency string, lon double, lat double")
    got = nearest(p, t, "x", "y", ["agency"], "lon", "lat", **how)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(points, places, **how)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_random_and_clustered_places(spark, seed):
    rng = random.Random(seed)
    places = [(f"a{i:03d}", rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(40)]
    places += [(f"b{i:03d}", 700 + rng.uniform(0, 1e-3), 10 + rng.uniform(0, 1e-3)) for i in range(150)]       # one dense town
    places += [("c1", None, 5.0), ("c2", 5.0, None), ("far", 50_000.0, -3.0)]
    points = [(i, rng.uniform(-500, 1500), rng.uniform(-500, 1500)) for i in range(150)]
    points += [(900, 700.0, 10.0), (901, 700.0, 10.0), (902, None, 1.0), (903, 1e6, 1e6)]
    check(spark, points, places)
    check(spark, points, places, within=60.0)


def test_ties_go_to_the_least_id(spark):
    places = [(f"p{x}{y}", float(x), float(y)) for x in range(6) for y in range(6)] + [("a-copy", 3.0, 3.0), ("z-copy", 3.0, 3.0)]
    points = [(i, a / 2, b / 2) for i, (a, b) in enumerate((a, b) for a in range(-1, 13) for b in range(-1, 13))]
    check(spark, points, places)


def test_one_place_and_none(spark):
    points = [(1, 0.0, 0.0), (2, None, None)]
    check(spark, points, [("only", 3.0, 4.0)])
    check(spark, points, [("only", None, 4.0)])
    check(spark, points, [("same", 1.0, 1.0)] * 5)
    with pytest.raises(ValueError):
        p = spark.createDataFrame(points, "id long, x double, y double")
        nearest(p, p.selectExpr("id", "x AS a", "y AS b"), "x", "y", ["id"], "a", "b")


def test_no_loop_over_all_pairs(spark):
    p = spark.range(50).selectExpr("id", "id * 3.0 AS x", "id * 7.0 % 40 AS y")
    t = spark.range(60).selectExpr("id AS agency", "id * 2.5 AS a", "id * 11.0 % 50 AS b")
    plan = nearest(p, t, "x", "y", ["agency"], "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
