"""Top-k search with components beyond the bit-sliced index."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wagelens.llm import bitslice
from wagelens.session import ship_package


def test_large_components_are_queries_and_candidates(spark):
    ship_package(spark)
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (60, 4)).astype(float)
    x[20, 1], x[7, 2], x[40, 0] = 1e6, -3e9, 262_145.0
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in bitslice.top_k(df, F.col("vec_id") % 20 == 0, 5, block_rows=16, batch_rows=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [[int(64 * c) for c in v] for v in x.tolist()]
    for q in (0, 20, 40):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in enumerate(whole) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    beyond = spark.createDataFrame([(0, [1e18]), (1, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        bitslice.top_k(beyond, F.col("vec_id") == 0, 5).collect()
