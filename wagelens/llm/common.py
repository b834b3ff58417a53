"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wagelens.session import ensure_checkpoint_dir, ship_package


#: Rows and bytes that go to Python at once: texts are long, so fewer than Spark's 10,000 rows and 64 MB.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1_000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound an Arrow batch by rows and bytes (a caller's smaller bounds stay)."""
    ship_package(spark)
    for name, most in (("maxRecordsPerBatch", ROWS_AT_ONCE), ("maxBytesPerBatch", BYTES_AT_ONCE)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"\d+", spark.conf.get(key, "1000000000"))
        if not now or not 0 < int(now.group()) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give memory that a task has freed back to the system: a worker lives on, and so would its high-water mark."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):               # another C library
        pass


def tidy(run):
    """An Arrow function of a partition that releases memory when the partition is done."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of these files only.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (a null id: -1)."""
    return F.coalesce((F.crc32(id_col.cast("string")) % F.lit(folds)).cast("int"), F.lit(-1))


def doc_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), so that no further column can clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
