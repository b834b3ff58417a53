"""Exact percentiles, ranks and running totals against plain sorting; hot groups; plans without one-task windows."""
from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wagelens.operators.order_stats import group_percentiles, values_at_ranks
from wagelens.operators.running import running

SHARES = (0.0, 0.3, 0.5, 0.75, 1.0)


def percentiles(values, share):
    v = sorted(values)
    n = len(v)
    place = share * (n - 1)
    lo, hi = float(v[math.floor(place)]), float(v[math.ceil(place)])
    return v[max(1, n - math.floor(n - share * n)) - 1], lo + (hi - lo) * (place - math.floor(place))


def check(spark, rows, kind, **how):
    df = spark.createDataFrame(rows, f"g string, v {kind}")
    got = {(r["g"], r["share"]): (r["n"], r["disc"], r["cont"]) for r in group_percentiles(df, ["g"], "v", SHARES, **how).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and not (isinstance(v, float) and math.isnan(v)):
            groups.setdefault(g, []).append(v)
    assert set(got) == {(g, s) for g in groups for s in SHARES}
    for (g, s), (n, disc, cont) in got.items():
        want_disc, want_cont = percentiles(groups[g], s)
        assert (n, disc) == (len(groups[g]), want_disc) and math.isclose(cont, want_cont, rel_tol=1e-12, abs_tol=1e-12), (g, s)


@pytest.mark.parametrize("bins, few", [(2, 0), (7, 0), (4096, 0), (16, 40)])
def test_percentiles_of_random_groups(spark, bins, few):
    rng = random.Random(bins + few)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.gauss(0, 1e6), float(rng.randint(-3, 3)), 2.0 ** rng.randint(-60, 60)]))
            for _ in range(400)]
    rows += [("one", 5.0), ("nothing", None), ("same", 7.0), ("same", 7.0), ("nan", float("nan")), ("nan", 1.0)]
    check(spark, rows, "double", bins=bins, few=few)


def test_percentiles_of_a_hot_group_with_a_hot_value(spark):
    rows = [("hot", 100)] * 700 + [("hot", i) for i in range(300)] + [("x", -1), ("x", 2 ** 62), ("x", -2 ** 62)]
    check(spark, rows, "long", bins=8, few=0)


def test_percentiles_without_group_or_rows(spark):
    df = spark.range(101).selectExpr("cast(id AS decimal(18,2)) AS v")
    assert [float(r["disc"]) for r in group_percentiles(df, [], "v", [0.5, 0.1]).orderBy("share").collect()] == [10.0, 50.0]
    assert group_percentiles(df.limit(0), [], "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        group_percentiles(df, [], "v", [1.5])
    with pytest.raises(Exception, match="infinite"):
        group_percentiles(spark.sql("SELECT double('inf') AS v"), [], "v", [0.5]).collect()


def test_few_rows_reach_the_second_round(spark):
    """A hot year is counted on bins; what goes on is one bin's rows, not the year's."""
    df = spark.range(40_000).selectExpr("1 AS year", "cast((id * 7919) % 40000 AS double) AS v")
    ranks = spark.createDataFrame([(1, 19_999)], "year int, rank long")
    seen = []
    from wagelens.operators import order_stats as os_
    old = os_._written

    def watched(frame, name):
        out = old(frame, name)
        if name == "ranks-rows":
            seen.append(out.count())
        return out
    os_._written = watched
    try:
        got = values_at_ranks(df, ["year"], "v", ranks, bins=100, few=0).collect()
    finally:
        os_._written = old
    assert [r["at_rank"] for r in got] == [19_999.0]
    assert seen[0] == 40_000 and seen[1] <= 401 and len(seen) <= 4


def sorted_running(rows, key, value):
    total, out = 0.0, {}
    for i, r in enumerate(sorted(rows, key=key), 1):
        total += value(r) or 0.0
        out[r[0]] = (i, round(total, 2))
    return out


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_running_totals_and_ranks(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, rng.choice([None, 1.5, 1.5, 2.0, float(rng.randint(0, 50))]), rng.choice([None, 0.25, float(rng.randint(-9, 9))]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t double, v double")
    got = running(df, ["t", "id"], "v", ranges=ranges).collect()
    want = sorted_running(rows, lambda r: (r[1] is None, r[1] or 0.0, r[0]), lambda r: r[2])
    assert {r["id"]: (r["row_no"], float(r["running_sum"])) for r in got} == want
    assert all(r["n_rows"] == 300 for r in got)
    known = [r[1] for r in rows if r[1] is not None]
    assert all(r["rank"] == (1 + sum(x < r["t"] for x in known) if r["t"] is not None else 1 + len(known)) for r in got)
    down = {r["id"]: r for r in running(df, ["t", "id"], descending=True, ranges=ranges).collect()}
    assert all(down[r[0]]["rank"] == (1 + sum(x > r[1] for x in known) if r[1] is not None else 1 + len(known)) for r in rows)


def test_no_window_over_all_rows(spark):
    df = spark.range(1000).selectExpr("id", "id AS t", "1.0 AS v")
    got = running(df, ["t", "id"], "v", ranges=8)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"Window \[", plan) and "Exchange hashpartitioning(_range" in plan
    for part in plan.split("Window [")[1:]:
        assert "_range" in part.split("\n")[0]
    assert got.groupBy(F.spark_partition_id()).count().count() >= 1


def test_running_of_nothing_and_clashes(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, v double")
    assert running(df.limit(0), ["id"], "v").count() == 0
    assert [tuple(r) for r in running(df, ["id"], "v").collect()] == [(1, 2.0, 1, 1, 1, 2)]
    with pytest.raises(ValueError):
        running(df.withColumnRenamed("v", "rank"), ["id"])
    with pytest.raises(ValueError):
        running(df, [])
