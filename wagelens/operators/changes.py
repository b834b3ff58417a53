"""What changed between two tables with repeated rows: multiset difference and intersection.

Rows are compared as multisets, nulls equal. Each row is first reduced to a
128-bit hash and counted per side with partial sums, so that the shuffle holds
hashes and counts and a row that is there very often costs one row a task.
Only rows whose counts differ are read again with their columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.functions.sizing import broadcast_if_small
from wagelens.session import scratch_path
from wagelens.sources import silver

_H = ("_h1", "_h2")


def _row_hash(df: DataFrame, columns: Sequence[str]) -> list:
    """Two 64-bit hashes of the row; a column's null and place count, so that shifted values differ."""
    for f in (df.schema[c] for c in columns):
        if isinstance(f.dataType, (T.MapType, T.VariantType)):
            raise TypeError(f"{f.name}: rows with {f.dataType.simpleString()} cannot be compared")
    told = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(F.lit(seed), *told).alias(name) for seed, name in ((17, _H[0]), (40_503, _H[1]))]


def _counted(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """_h1, _h2, n_old, n_new of every distinct row of either side."""
    side = lambda df, a, b: df.select(*_row_hash(df, columns), F.lit(a).cast("long").alias("o"), F.lit(b).cast("long").alias("n"))
    return (side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(*_H)
            .agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new")))


def _compared(old: DataFrame, new: DataFrame, columns: Sequence[str] | None) -> list[str]:
    columns = list(columns or old.columns)
    for c in columns:
        if old.schema[c].dataType != new.schema[c].dataType:
            raise TypeError(f"{c}: {old.schema[c].dataType.simpleString()} and {new.schema[c].dataType.simpleString()}")
    if {*_H, "n_old", "n_new"} & set(columns):
        raise ValueError("columns named as this operator's own")
    return columns


def _with_columns(counts: DataFrame, old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``counts`` with the columns of the rows they stand for, taken from whichever side has them, one row each."""
    path = scratch_path(counts.sparkSession, "changes")          # written: its size is known, and the sides are not counted again
    counts.write.parquet(path)
    counts = counts.sparkSession.read.schema(counts.schema).parquet(path)
    rows = (old.select(*columns).unionByName(new.select(*columns))).select(*_row_hash(old, columns), *columns)
    met = rows.join(broadcast_if_small(counts), list(_H))
    return met.groupBy(*_H, "n_old", "n_new").agg(*(F.first(f"`{c}`").alias(c) for c in columns)).select(*columns, "n_old", "n_new")


def changes(old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``columns``, n_old, n_new: every distinct row that the two tables do not hold equally often."""
    columns = _compared(old, new, columns)
    return _with_columns(_counted(old, new, columns).where("n_old <> n_new"), old, new, columns)


def except_all(old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``columns``, n: the rows of ``old`` beyond those of ``new``, how often each."""
    return changes(old, new, columns).where("n_old > n_new").withColumn("n", F.col("n_old") - F.col("n_new")).drop("n_old", "n_new")


def intersect_all(old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``columns``, n: the rows that both hold, as often as the one that holds it less often."""
    columns = _compared(old, new, columns)
    both = _counted(old, new, columns).where("n_old > 0 AND n_new > 0")
    return (_with_columns(both, old, new, columns).withColumn("n", F.least("n_old", "n_new")).drop("n_old", "n_new"))


def rows_as_of(spark: SparkSession, table: str, run: int, besides: int | None = None) -> DataFrame:
    """The payroll table's rows as they were after ``run``; of files that another run shows alike, none.

    A file's rows are those of its last run up to then. With ``besides`` the
    files whose rows came from the same run at both times are left out, and
    so are the folders that hold only such files: they cannot have changed.
    """
    def last(until: int) -> DataFrame:
        return silver.listed(spark, table).where(F.col("run") <= until).groupBy("file").agg(F.max("run").alias("run"))
    mine = last(run)
    if besides is not None:
        mine = mine.join(last(besides), ["file", "run"], "left_anti")
    return silver.run_rows(spark, table, mine).join(mine, ["file", "run"], "left_semi")


def run_changes(spark: SparkSession, table: str, before: int, after: int, columns: Sequence[str]) -> DataFrame:
    """What a re-ingest changed: ``changes`` of the payroll table between two runs, unchanged files not read."""
    return changes(rows_as_of(spark, table, before, after), rows_as_of(spark, table, after, before), columns)
