"""Interval join and as-of join against brute force, on random and hot keys; their plans."""
from __future__ import annotations

import datetime as dt
import random
import re

import pytest

from wagelens.operators.asof import asof_join
from wagelens.operators.interval import interval_join


def brute_interval(facts, ranges, left=False):
    out = []
    for f in facts:
        met = [(*f, *r[1:]) for r in ranges
               if f[1] is not None and f[1] == r[0] and f[2] is not None
               and (r[1] is None or r[1] <= f[2]) and (r[2] is None or f[2] < r[2])]
        out += met or ([(*f, None, None, None)] if left else [])
    return sorted(out, key=repr)


def brute_asof(facts, known, within=None, inner=False):
    out = []
    for f in facts:
        met = [r for r in known if f[1] is not None and r[0] == f[1] and f[2] is not None and r[1] is not None and r[1] <= f[2]]
        best = max(met, key=lambda r: (r[1], r[2] is not None, r[2] or 0), default=None)
        if best is not None and within is not None and f[2] - best[1] > within:
            best = None
        if best is not None or not inner:
            out.append((*f, *(best[1:] if best else (None, None))))
    return sorted(out, key=repr)


def some_facts(rng, n, keys, span):
    return [(i, rng.choice(keys), rng.choice([None, *(rng.randint(-span, span) for _ in range(8))])) for i in range(n)]


def some_ranges(rng, n, keys, span):
    out = []
    for i in range(n):
        lo = rng.randint(-span, span)
        hi = lo + rng.choice([-3, 0, 1, 2, 5, span // 7, span])
        out.append((rng.choice(keys), rng.choice([lo, lo, lo, None]), rng.choice([hi, hi, hi, None]), i))
    return out + out[:3]


def frames(spark, facts, ranges):
    return (spark.createDataFrame(facts, "id long, k string, t long"),
            spark.createDataFrame(ranges, "k string, a long, b long, v long"))


@pytest.mark.parametrize("seed, span", [(1, 40), (2, 10 ** 6), (3, 2 ** 61)])
def test_interval_join_against_brute_force(spark, seed, span):
    rng = random.Random(seed)
    keys = ["x", "y", "z", None]
    facts, ranges = some_facts(rng, 300, keys, span), some_ranges(rng, 60, keys, span)
    f, r = frames(spark, facts, ranges)
    got = interval_join(f, r, ["k"], "t", "a", "b")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_interval(facts, ranges)
    left = interval_join(f, r, ["k"], "t", "a", "b", how="left", row_id=["id"])
    assert sorted(map(tuple, left.collect()), key=repr) == brute_interval(facts, ranges, left=True)


def test_hot_bucket_is_dealt_into_blocks(spark):
    """All facts in one bucket of one key: the same rows, from many blocks."""
    facts = [(i, "x", 5) for i in range(3000)]
    ranges = [("x", 4, 6, 1), ("x", None, None, 2), ("x", 6, 9, 3)]
    f, r = frames(spark, facts, ranges)
    got = interval_join(f, r, ["k"], "t", "a", "b", hot_rows=100, slots=8)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_interval(facts, ranges)
    from wagelens.operators.interval import _blocks
    from pyspark.sql import functions as F
    blocks = _blocks(f.select(F.lit(3).alias("_slot")), 8, 100).first()[0]
    assert blocks[3] == 4 and blocks[:3] + blocks[4:] == [1] * 7          # 3,000 rows, two means of 375 a block
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)


def test_interval_join_on_times_and_dates(spark):
    day = dt.date(2020, 2, 28)
    f = spark.createDataFrame([(i, day + dt.timedelta(i)) for i in range(4)], "id int, d date").selectExpr(
        "id", "'k' AS k", "d", "cast(d AS timestamp_ntz) AS n", "cast(d AS timestamp) AS s")
    for kind, col in (("date", "d"), ("timestamp_ntz", "n"), ("timestamp", "s")):
        r = spark.sql(f"SELECT 'k' AS k, cast('2020-02-29' AS {kind}) AS a, cast('2020-03-02' AS {kind}) AS b")
        assert [x["id"] for x in interval_join(f, r, ["k"], col, "a", "b").orderBy("id").collect()] == [1, 2]
    with pytest.raises(TypeError):
        interval_join(f, r, ["k"], "d", "a", "b")
    with pytest.raises(ValueError):
        interval_join(f, r.withColumnRenamed("a", "d"), ["k"], "s", "d", "b")


def test_wall_clock_times_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")      # no 02:30 on that day there
        f = spark.sql("SELECT 1 AS id, 'k' AS k, timestamp_ntz'2024-03-10 02:30:00.5' AS n")
        r = spark.sql("SELECT 'k' AS k, timestamp_ntz'2024-03-10 02:30:00.5' AS a, timestamp_ntz'2024-03-10 03:00:00' AS b")
        assert interval_join(f, r, ["k"], "n", "a", "b").count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_interval_join_with_empty_sides(spark):
    f, r = frames(spark, [(1, "x", 5)], [("x", 1, 9, 1)])
    assert interval_join(f.limit(0), r, ["k"], "t", "a", "b").count() == 0
    assert interval_join(f, r.limit(0), ["k"], "t", "a", "b").count() == 0
    assert interval_join(f, r.limit(0), ["k"], "t", "a", "b", how="left", row_id=["id"]).count() == 1


@pytest.mark.parametrize("seed, span, ranges", [(1, 30, 1), (2, 30, 7), (3, 10 ** 9, 64), (4, 3, 64)])
def test_asof_join_against_brute_force(spark, seed, span, ranges):
    rng = random.Random(seed)
    keys = ["x", "x", "x", "y", "z", None]
    facts = some_facts(rng, 400, keys, span)
    known = [(rng.choice(keys), rng.choice([None, *(rng.randint(-span, span) for _ in range(9))]), rng.choice([None, 1, 2, 3]))
             for _ in range(70)]
    f = spark.createDataFrame(facts, "id long, k string, t long")
    r = spark.createDataFrame(known, "k string, a long, v long")
    got = asof_join(f, r, ["k"], "t", "a", ranges=ranges)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_asof(facts, known)
    got = asof_join(f, r, ["k"], "t", "a", ranges=ranges, within=span // 4, how="inner")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_asof(facts, known, span // 4, inner=True)


def test_one_key_is_the_work_of_many_tasks(spark):
    """All facts of one key, one known row far before them: each window partition holds a range of time."""
    f = spark.range(4000).selectExpr("id", "'x' AS k", "id AS t")
    r = spark.createDataFrame([("x", -10, 7)], "k string, a long, v long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        from pyspark.sql import functions as F
        got = asof_join(f, r, ["k"], "t", "a", ranges=16).withColumn("task", F.spark_partition_id())
        tasks = got.groupBy("task").agg(F.count("v").alias("count")).collect()
        assert sum(x["count"] for x in tasks) == 4000 and len(tasks) > 6 and max(x["count"] for x in tasks) < 1300
        assert got.where("v = 7").count() == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_asof_join_with_empty_sides_and_clashes(spark):
    f = spark.createDataFrame([(1, "x", 5), (2, None, 5), (3, "x", None)], "id long, k string, t long")
    r = spark.createDataFrame([("x", 1, 9)], "k string, a long, v long")
    assert asof_join(f.limit(0), r, ["k"], "t", "a").count() == 0
    assert [x["v"] for x in asof_join(f, r.limit(0), ["k"], "t", "a").collect()] == [None] * 3
    assert sorted((x["id"], x["v"]) for x in asof_join(f, r, ["k"], "t", "a").collect()) == [(1, 9), (2, None), (3, None)]
    with pytest.raises(ValueError):
        asof_join(f, r.withColumnRenamed("v", "id"), ["k"], "t", "a")
