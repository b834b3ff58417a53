"""The pipeline against its brute-force version on a small table."""

from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from wagelens.llm import bpe, langid  # noqa: E402
from wagelens.session import scratch_path, ship_package  # noqa: E402


def test_stages_and_run(spark):
    ship_package(spark)
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    rows = [tuple(r) for r in source.select("doc_id", "text", "lang", "source").collect()]
    rng = random.Random(7)
    extra = [(1000 + i, t, g, s) for i, (_, t, g, s) in enumerate(rng.sample(rows, 20))]
    extra += [(1100, None, "en", "src1"), (1101, "", "en", None), (1102, "1 2 3", None, None),
              (1103, "Ring the office and with the other +1 (988) 555-2485 or a.b@c.example", "en", None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string") \
        .withColumn("n_chars", F.length("text").cast("long")).coalesce(3)
    sf_dir = scratch_path(spark, "pipeline-test")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    model = langid.learn(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    left = [tuple(r) for r in docs.collect()]
    kept = brute.language_kept([r[1] for r in left], model, langid.LEVEL, langid.MIN_MARGIN, langid.MIN_SHARE)
    left = [r for r, stays in zip(left, kept) if stays]
    classes = brute.near_classes([r[:2] for r in left])
    left = [r for r in left if classes[r[0]] == r[0]]
    left = [(r[0], brute.redact(r[1]), *r[2:]) for r in left]
    copies = brute.mix_copies([(r[0], r[3], r[1]) for r in left])
    tok, _ = bpe.load(None)
    want = Counter()
    for r, n in zip(left, copies):
        if n:
            want[(r[0], *brute.digest(tok, r[1]))] += n

    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf_dir)
        assert step.columns == docs.columns, name
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want


def test_stages_take_an_empty_table(spark):
    ship_package(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _name, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, "")
        assert docs_out.count() == 0
