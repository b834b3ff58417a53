"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learnable: Column, rows: int, chars: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Texts and labels (0 or 1) of at most ``rows`` documents of at most ``chars`` characters.

    ``learnable`` is a condition on the column ``id``. The first rows in the
    order of the hash of the id, so the sample is the same in every run; of a
    document with several labels the least. Only ids and labels are sorted;
    the texts of the chosen ids (bounded) are fetched afterwards.
    """
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(learnable)
             .groupBy("id").agg(F.min("label").alias("label")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    short = texts.where(F.length("text").between(1, chars)).select("id").distinct()
    chosen = marks.join(short, "id").orderBy(F.xxhash64("id"), "id").limit(rows)
    got = (texts.where(F.length("text").between(1, chars)).join(F.broadcast(chosen), "id")   # at most ``rows`` rows
           .groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
           .select("id", "text", "label").collect())
    got.sort(key=lambda r: r["id"])
    return [r["text"] for r in got], [r["label"] for r in got]
