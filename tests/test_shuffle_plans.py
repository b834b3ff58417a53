"""The at-scale plan shape: no size check passes, no automatic broadcast.

Every query must still equal its oracle when all dimension joins run as
shuffle (sort-merge) joins, i.e. through the fallback beyond the size checks.
"""
from __future__ import annotations

import pytest

from conftest import SF_CHECK
from tools.check_oracles import compare, duck, rows_of
from wagelens.functions import sizing
from wagelens.plans import catalog as entry

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def shuffle_only(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    saved = sizing.small_enough
    sizing.small_enough = lambda df, max_bytes: False
    yield spark
    sizing.small_enough = saved
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle_with_shuffle_joins(shuffle_only, con, name):
    df = entry.queries()[name](shuffle_only, SF_CHECK)
    got = df.toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    cols_a, rows_a = rows_of(got)
    cols_b, rows_b = rows_of(want)
    assert cols_a == cols_b
    ok, msg = compare(rows_a, rows_b)
    assert ok, msg


def test_fallback_plan_has_no_size_checked_broadcast(shuffle_only):
    df = entry.queries()["agency_located"](shuffle_only, SF_CHECK)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
