"""How the searches deal out their vectors: rows and not packs through the shuffle, ids that come again, batches of any size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wagelens.llm import bitslice, rpforest
from wagelens.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def shuffled(df) -> list[tuple[int, int]]:
    """(bytes, rows) of every exchange of the plan that has run."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name == "Exchange":
                out.append((node.metrics().apply("dataSize").value(),
                            node.metrics().apply("shuffleRecordsWritten").value()))
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("search", [bitslice.top_k, rpforest.nearest])
def test_blocks_are_not_sent_whole_for_every_batch(spark, search):
    x = np.random.default_rng(2).normal(size=(640, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = shuffled(search(df, F.col("vec_id") % 8 == 0, 3, block_rows=20, batch_rows=1))
    assert got and sum(b for b, _ in got) < 6 << 20               # blocks packed and sent to each of 80 batches: 13 MB and more
    assert all(b <= 2_000 * n for b, n in got)                    # no row of a shuffle holds a block


def test_repeated_ids_across_arrow_batches(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(120, 3)), 1)
    ids = rng.integers(0, 60, 120).tolist()                       # several vectors an id: the least stands
    ids[40:80] = [20] * 40
    least = {}
    for i, v in zip(ids, x.tolist()):
        least[i] = min(least.get(i, v), v)
    whole = {i: [int(np.floor(64 * c)) for c in v] for i, v in least.items()}
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "vec_id long, embedding array<double>")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for rows in ("1", "3", "1000"):
            spark.conf.set(key, rows)
            for block, batch in ((7, 1), (30, 2), (1_000, 1_000)):
                got = {}
                for r in bitslice.top_k(df, F.col("vec_id") % 5 == 0, 4, block_rows=block, batch_rows=batch).collect():
                    got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
                assert sorted(got) == sorted(i for i in whole if i % 5 == 0)
                for q in got:
                    best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:4]
                    assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    finally:
        spark.conf.set(key, was)
