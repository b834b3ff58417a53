"""Stitching as keyed state: equal to the batch stitch for random cuts, early and repeated lines, and after restarts."""
from __future__ import annotations

import os
import random

import pytest

from wagelens.sources.lines import PAIRWISE, QUOTES, lines_of_texts, stitch
from wagelens.streaming import records as sr


def text_of(rng):
    bits = ['a,b', '"open', 'x"y', 'done",z', '"q ""r"" s"', '', 'é,🙂', '"', ',,,,,,,,,,,', '"whole",1']
    return "\n".join("".join(rng.choice(bits) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 25)))


def land(spark, folder, number, rows):
    path = f"{folder}/cut{number:02d}"
    spark.createDataFrame(rows, sr.LINES).coalesce(1).write.parquet(path)
    for name in os.listdir(path):
        os.utime(f"{path}/{name}", (1_700_000_000 + number * 60,) * 2)


def drain(spark, tmp_path, mode):
    lines = sr.read_lines_stream(spark, f"{tmp_path}/land/*", 1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    sr.start_stitch(sr.stitched_stream(lines, mode, glue="|"), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    return sorted(map(tuple, spark.read.schema(sr.RECORDS).parquet(f"{tmp_path}/out").collect()))


@pytest.mark.parametrize("seed, mode", [(1, QUOTES), (2, QUOTES), (3, PAIRWISE)])
def test_equal_to_the_batch_stitch(spark, tmp_path, seed, mode):
    rng = random.Random(seed)
    texts = {f"f{i}": text_of(rng) for i in range(12)}
    texts["long"] = '"start\n' + "\n".join(f"line {i}" for i in range(300)) + '\nend",x\nnext,1'
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    want = sorted(map(tuple, stitch(lines_of_texts(df, "name", "text"), mode, whole=True, glue="|")
                      .select("file", "line_no", "n_lines", "raw").collect()))
    rows = []
    for name, text in texts.items():
        each = text.split("\n")
        rows += [(name, k, x) for k, x in enumerate(each)] + [(name, len(each), None)]
    cuts = [[] for _ in range(4)]
    for i, r in enumerate(rows):                     # mostly in order, some far too early or late
        cuts[rng.randrange(4) if rng.random() < 0.2 else 4 * i // len(rows)].append(r)
    cuts[3] += rng.sample(rows, 20) + [(None, 0, "nowhere")]
    for k, cut in enumerate(cuts[:2]):
        land(spark, f"{tmp_path}/land", k, rng.sample(cut, len(cut)))
    drain(spark, tmp_path, mode)                      # stops here, goes on with the state
    for k, cut in enumerate(cuts[2:], 2):
        land(spark, f"{tmp_path}/land", k, rng.sample(cut, len(cut)))
    assert drain(spark, tmp_path, mode) == want
    assert drain(spark, tmp_path, mode) == want


def test_open_records_wait_for_the_end(spark, tmp_path):
    land(spark, f"{tmp_path}/land", 0, [("f", 0, '"a'), ("f", 1, "b"), ("g", 1, "second"), ("h", 0, None)])
    assert drain(spark, tmp_path, QUOTES) == []
    land(spark, f"{tmp_path}/land", 1, [("f", 2, None), ("g", 0, "first")])
    assert drain(spark, tmp_path, QUOTES) == [("f", 0, 1, '"a'), ("f", 1, 1, "b"), ("g", 0, 1, "first"), ("g", 1, 1, "second")]
