"""Sketches: error bounds, merging, no facts read on the second level. Changes: multisets with repeats and nulls, unchanged files not read."""
from __future__ import annotations

import os
import random
from collections import Counter

import pytest

from wagelens.operators import changes as ch
from wagelens.operators import sketches as sk
from wagelens.plans.jobs import ingest_job
from wagelens.session import scratch_path


def test_sketches_keep_their_bounds_through_merging(spark):
    rng = random.Random(1)
    rows = [(rng.choice([2011, 2012]), rng.choice("abcde"), rng.randrange(6000), rng.lognormvariate(10, 1)) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "year int, agency string, person long, pay double")
    path = scratch_path(spark, "sketch-test")
    made = sk.sketched(df, ["year", "agency"], "person", "pay")
    made.write.parquet(path)
    stored = spark.read.parquet(path)
    for by in (["year", "agency"], ["year"], ["agency"], []):
        got = sk.estimates(sk.rolled_up(stored, by), [0.05, 0.5, 0.95]).collect()
        groups = {}
        for r in rows:
            groups.setdefault(tuple(dict(zip(("year", "agency"), r))[b] for b in by), []).append(r)
        assert len(got) == len(groups)
        for g in got:
            mine = groups[tuple(g[b] for b in by)]
            people, pays = len({r[2] for r in mine}), sorted(r[3] for r in mine)
            assert (g["n"], g["n_valued"]) == (len(mine), len(mine))
            assert abs(g["n_people"] - people) <= 0.05 * people
            for share, q in zip([0.05, 0.5, 0.95], g["quantiles"]):
                assert abs(sum(p <= q for p in pays) / len(pays) - share) <= 0.02
    plan = sk.rolled_up(stored, ["year"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<year:int,n:bigint,n_valued:bigint,people:binary,pay:binary>" in plan


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, float("nan")), (2, 5, 7.0)], "g int, person long, pay double")
    got = {r["g"]: r for r in sk.estimates(sk.sketched(df, ["g"], "person", "pay"), [0.5]).collect()}
    assert (got[1]["n"], got[1]["n_valued"], got[1]["n_people"], got[1]["quantiles"]) == (1, 0, 0, None)
    assert (got[2]["n"], got[2]["n_valued"], got[2]["n_people"], got[2]["quantiles"]) == (2, 1, 1, [7.0])
    assert sk.sketched(df.limit(0), ["g"], "person", "pay").count() == 0


def multiset(rows):
    return Counter({tuple(r)[:-1]: r[-1] for r in rows})


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_of_random_multisets(spark, seed):
    rng = random.Random(seed)
    row = lambda: (rng.choice([None, 1, 2]), rng.choice([None, "", "a"]), rng.choice([None, 0.0, 1.5]))
    a, b = [row() for _ in range(200)] + [(9, "hot", 1.0)] * 500, [row() for _ in range(150)] + [(9, "hot", 1.0)] * 499
    kind = "x int, y string, z double"
    old, new = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    ca, cb = Counter(a), Counter(b)
    assert multiset(ch.except_all(old, new).collect()) == ca - cb
    assert multiset(ch.except_all(new, old).collect()) == cb - ca
    assert multiset(ch.intersect_all(old, new).collect()) == ca & cb
    got = {tuple(r)[:3]: tuple(r)[3:] for r in ch.changes(old, new).collect()}
    assert got == {k: (ca[k], cb[k]) for k in ca | cb if ca[k] != cb[k]}
    assert ch.changes(old, old).count() == 0 and ch.changes(old.limit(0), new.limit(0)).count() == 0
    assert multiset(ch.except_all(old, new.limit(0)).collect()) == ca


def test_shifted_nulls_are_changes(spark):
    old, new = (spark.createDataFrame([r], "x string, y string") for r in ((None, "a"), ("a", None)))
    assert ch.changes(old, new).count() == 2
    with pytest.raises(TypeError):
        ch.changes(old, new.withColumn("y", new["y"].cast("int")))
    with pytest.raises(TypeError):
        ch.changes(old.selectExpr("map(1, 2) AS m"), old.selectExpr("map(1, 2) AS m"))


def test_runs_are_compared_by_their_changed_files(spark, tmp_path):
    line = "{0},Clerk,1,2,3,4,5,{1},2011,,Oakland,FT"
    land, table = tmp_path / "land", f"{tmp_path}/t"
    os.makedirs(land)
    for f in "abc":
        (land / f"{f}.csv").write_text("\n".join([line.format(f, 1)] * 3) + "\n")
    first = ingest_job(spark, f"{land}/*.csv", table)
    (land / "b.csv").write_text("\n".join([line.format("b", 1)] * 2 + [line.format("b", 2)]) + "\n")
    second = ingest_job(spark, f"{land}/b.csv", table)
    columns = ["employee_name", "total_pay_benefits", "year"]
    got = sorted((r[0], float(r[1]), r["n_old"], r["n_new"]) for r in ch.run_changes(spark, table, first, second, columns).collect())
    assert got == [("b", 1.0, 3, 2), ("b", 2.0, 0, 1)]
    assert ch.rows_as_of(spark, table, first).count() == 9 and ch.rows_as_of(spark, table, second).count() == 9
    assert ch.rows_as_of(spark, table, first, second).count() == 3
    assert ch.run_changes(spark, table, second, second, columns).count() == 0
