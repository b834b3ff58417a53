"""Language identification: languages that were not learned, languages of long texts only."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wagelens.llm import langid
from wagelens.llm.common import fold
from wagelens.session import ship_package


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang IS NOT NULL AND length(text) > 0")


def test_a_language_left_out_of_learning_is_rejected(docs):
    learnable = fold(F.col("doc_id"), 4) != 2
    held = docs.where(~learnable & (F.col("doc_id") < 4000)).withColumnRenamed("lang", "own")
    for left_out in ("de", "fr"):
        model = langid.learn(docs, learnable & (F.col("lang") != left_out))
        rows = held.join(langid.classify(held, model), "doc_id").collect()
        assert np.mean([r["rejected"] for r in rows if r["own"] == left_out]) > 0.7
        assert np.mean([r["rejected"] for r in rows if r["own"] != left_out]) < 0.05


def test_a_language_of_long_texts_only_is_learned(spark):
    ship_package(spark)
    rows = [(i, f"the cat sat on mat number {i} and slept", "en") for i in range(20)]
    rows += [(100 + i, f"der hund lief {i} mal über die straße " * 500, "de") for i in range(3)]
    rows += [(200, "le chat noir a été vu près de la fenêtre " * 9_000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True))
    assert list(model) == ["de", "en", "fr"] and all(8 <= len(v) <= langid.DICT_BYTES for v in model.values())
    asked = docs.selectExpr("doc_id", "substring(text, 1, 300) AS text", "lang AS own")
    got = asked.select("doc_id", "own").join(langid.classify(asked, model), "doc_id").collect()
    assert all(r["lang_pred"] == r["own"] for r in got)
