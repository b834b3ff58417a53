"""The payroll table: every parsed row written once, each file's last run shown.

Layout of a table folder:

    rows/run=<n>/rejected=<0|1>/year=<y>/...   all rows of a run, valid and rejected
    files/...                                  (file, run): the files that a run has read

A run adds its rows, and only then its list of files; readers show, of each
file (full path), the rows of its last listed run. So a file that is read
again replaces exactly its own rows, valid and rejected, in every year, and a
file that has become clean or empty loses its old rejects. A run that failed
half way is never listed. Folders of superseded runs are not read, and
``vacuum`` deletes them once no reader can be at them. Valid rows, quarantine and summary are views of the
same rows, so they always describe the same files.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wagelens.schema import MIN_PIECES, PAYROLL_COLUMNS, PAYROLL_SCHEMA

ROW_COLUMNS = ("file", "line_no", "n_lines", "raw", *PAYROLL_COLUMNS, "reason")
FILES = "file STRING, run BIGINT"
#: Live runs whose folders are named one by one; beyond, the join alone tells them.
MOST_RUNS = 2_000


def _rows_schema() -> str:
    kinds = {f.name: f.dataType.simpleString() for f in PAYROLL_SCHEMA}
    kinds |= {"file": "string", "line_no": "bigint", "n_lines": "int", "raw": "string", "reason": "string"}
    return ", ".join(f"{c} {kinds[c]}" for c in ROW_COLUMNS) + ", run BIGINT, rejected INT"


def listed(spark: SparkSession, table: str) -> DataFrame:
    """(file, run) of all runs whose rows are complete."""
    try:
        return spark.read.schema(FILES).parquet(f"{table}/files")
    except AnalysisException:                       # no run yet
        return spark.createDataFrame([], FILES)


def next_run(spark: SparkSession, table: str) -> int:
    """A number above all listed runs (the clock's milliseconds, where that is above)."""
    last = listed(spark, table).agg(F.max("run")).first()[0] or 0
    return max(last + 1, int(time.time() * 1000))


def write_run(parsed: DataFrame, files: DataFrame, table: str, run: int | None = None,
              min_cells: int = MIN_PIECES) -> int:
    """Write the rows of a run in one pass, then list its files (column ``file``).

    The rebalance hint keeps the file count low while AQE splits a hot year
    over several tasks. The raw text is kept for rejected rows only.
    """
    spark = parsed.sparkSession
    run = next_run(spark, table) if run is None else run
    bad = ~F.col("ok") | F.coalesce(F.col("n_cells") < F.lit(min_cells), F.lit(False))
    rows = parsed.select("file", "line_no", "n_lines", F.when(bad, F.col("raw")).alias("raw"), *PAYROLL_COLUMNS, "reason",
                         bad.cast("int").alias("rejected"))
    (rows.hint("rebalance", "rejected", "year")
     .write.mode("overwrite").partitionBy("rejected", "year").parquet(f"{table}/rows/run={run}"))
    (files.select("file").distinct().withColumn("run", F.lit(run).cast("long"))
     .write.mode("append").parquet(f"{table}/files"))
    return run


def run_rows(spark: SparkSession, table: str, runs: DataFrame) -> DataFrame:
    """The rows of the ``runs`` (column ``run``), with ``run`` and ``rejected`` (0 or 1): only their folders are listed.

    Beyond ``MOST_RUNS`` runs all folders are, and the caller's join tells.
    """
    found = sorted(r["run"] for r in runs.select("run").distinct().limit(MOST_RUNS + 1).collect())
    paths = [f"{table}/rows/run={n}" for n in found] if 0 < len(found) <= MOST_RUNS else [f"{table}/rows/run=*"]
    return spark.read.schema(_rows_schema()).option("basePath", f"{table}/rows").parquet(*paths)


def current(spark: SparkSession, table: str) -> DataFrame:
    """All rows of each file's last run, with ``rejected`` (0 or 1)."""
    last = listed(spark, table).groupBy("file").agg(F.max("run").alias("run"))
    # folders of superseded and unlisted runs are not read
    return run_rows(spark, table, last).join(last, ["file", "run"], "left_semi")


def silver(spark: SparkSession, table: str) -> DataFrame:
    """The valid rows; a filter on year prunes folders."""
    return current(spark, table).where(F.col("rejected") == 0).drop("raw", "rejected", "run")


def quarantine(spark: SparkSession, table: str) -> DataFrame:
    """The rejected records with their raw text."""
    return current(spark, table).where(F.col("rejected") == 1).select("file", "line_no", "n_lines", "raw", "reason")


def summary(spark: SparkSession, table: str) -> DataFrame:
    """Records and physical lines per reason (null = clean records)."""
    return (current(spark, table).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("n_lines").cast("bigint").alias("lines")))


def live_runs(spark: SparkSession, table: str) -> DataFrame:
    """run, files: the runs that some file's rows are still read from."""
    return (listed(spark, table).groupBy("file").agg(F.max("run").alias("run"))
            .groupBy("run").agg(F.count(F.lit(1)).alias("files")))


def _folders(spark: SparkSession, table: str):
    """The file system of the table and its run folders by number."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{table}/rows")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return fs, {int(p.getName()[4:]): p for p in found if p.getName().startswith("run=")}


def compact(spark: SparkSession, table: str, live_share: float = 0.5) -> int | None:
    """Write the rows of mostly superseded runs again, as one run that holds what is live of them.

    A run counts where fewer than ``live_share`` of the files it once listed
    are still its own. The new run is listed after its rows are written, as
    any other, so readers see the same rows before and after, and an attempt
    that fails is never seen. Returns the new run's number, or None.
    """
    every = listed(spark, table)
    last = every.groupBy("file").agg(F.max("run").alias("last"))
    share = (every.distinct().join(last, "file").groupBy("run")
             .agg(F.avg((F.col("run") == F.col("last")).cast("int")).alias("live")))
    runs = [r["run"] for r in share.where((F.col("live") > 0) & (F.col("live") < live_share)).select("run").collect()]
    if not runs:
        return None
    old = current(spark, table).where(F.col("run").isin(runs))
    files = last.where(F.col("last").isin(runs)).select("file")
    number = next_run(spark, table)
    rows = old.select(*ROW_COLUMNS, "rejected")
    (rows.hint("rebalance", "rejected", "year").write.mode("overwrite").partitionBy("rejected", "year")
     .parquet(f"{table}/rows/run={number}"))
    files.withColumn("run", F.lit(number).cast("long")).write.mode("append").parquet(f"{table}/files")
    return number


def vacuum(spark: SparkSession, table: str, keep_hours: float = 24.0, live_share: float = 0.5) -> list[int]:
    """Compact, then delete the folders of runs that no file is read from; returns their numbers.

    Runs superseded or begun less than ``keep_hours`` ago stay: a reader may
    still be at them, or a writer. Whole run folders go; the lists of files
    are not touched.
    """
    compact(spark, table, live_share)
    live = {r["run"] for r in live_runs(spark, table).select("run").collect()}
    border = int((time.time() - keep_hours * 3600) * 1000)
    # a run is dead since the run that took over its last file
    every = listed(spark, table)
    took = (every.alias("a").join(every.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.run") < F.col("b.run")))
            .groupBy(F.col("a.run").alias("run"), F.col("a.file")).agg(F.min("b.run").alias("by"))
            .groupBy("run").agg(F.max("by").alias("since")))
    since = {r["run"]: r["since"] for r in took.collect()}
    fs, folders = _folders(spark, table)
    gone = [n for n in sorted(folders) if n not in live and max(n, since.get(n, n)) < border]
    for n in gone:
        fs.delete(folders[n], True)
    return gone
