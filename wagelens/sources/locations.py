"""Location cache and job-code tables (read and write).

Location cache lines are ``agency,lat,lon`` (the original 3-field form,
``0,0`` meaning "not found") or ``agency,lat,lon,status,updated_at`` (the
form written here). Lines with another number of fields are ignored. The
latest entry per agency wins: newest ``updated_at``, then the later line.
Rows are appended by one driver-planned write, never from inside tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagelens.schema import NOT_FOUND, RESOLVED
from wagelens.sources.lines import lines_of_files
from wagelens.sources.payroll_csv import cell_count

_OPTS = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def read_location_csv(spark: SparkSession, paths) -> DataFrame:
    """agency, lat, lon, status, updated_at — one row per agency."""
    lines = lines_of_files(spark, paths).where(F.col("line") != "")
    c = F.from_csv(F.col("line"), "c0 STRING, c1 STRING, c2 STRING, c3 STRING, c4 STRING", _OPTS)
    # inside a split the reader's order is file order; a split's rows are numbered in that order
    lines = lines.withColumn("seq", F.monotonically_increasing_id())
    df = lines.select("file", "blk", "seq", cell_count(F.col("line")).alias("n"), c.alias("c"))
    lat, lon = F.col("c.c1").try_cast("double"), F.col("c.c2").try_cast("double")
    legacy = F.col("n") == 3
    legacy_missing = (lat == 0) & (lon == 0)
    status = F.when(legacy, F.when(legacy_missing, F.lit(NOT_FOUND)).otherwise(F.lit(RESOLVED))) \
        .otherwise(F.col("c.c3"))
    found = status == F.lit(RESOLVED)
    rows = (df.where(F.col("n").isin(3, 5) & F.col("c.c0").isNotNull())
            .select(F.col("c.c0").alias("agency"),
                    F.when(found, lat).alias("lat"), F.when(found, lon).alias("lon"),
                    status.alias("status"),
                    F.when(~legacy, F.col("c.c4").try_cast("timestamp")).alias("updated_at"),
                    "file", "blk", "seq")
            .where(F.col("status").isin(RESOLVED, NOT_FOUND)
                   & (~found | (F.col("lat").isNotNull() & F.col("lon").isNotNull()))))
    best = F.max(F.struct("updated_at", "file", "blk", "seq", "status", "lat", "lon"))
    return (rows.groupBy("agency").agg(best.alias("b"))
            .select("agency", "b.lat", "b.lon", "b.status", "b.updated_at"))


def write_locations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write agency, lat, lon, status, updated_at as CSV (``mode='append'`` to add)."""
    (df.select("agency", "lat", "lon", "status", "updated_at")
     .write.mode(mode).options(sep=",", quote='"', escape='"', header=False,
                               timestampFormat="yyyy-MM-dd HH:mm:ss")
     .csv(path))


def read_job_codes(spark: SparkSession, paths) -> DataFrame:
    """Job-code table: column 0 the code, column 1 the title; major = first two characters."""
    df = (spark.read.options(sep=",", quote='"', escape='"', header=False)
          .schema("code STRING, job_title STRING").csv(paths))
    return df.select("job_title", "code", F.substring("code", 1, 2).alias("major"))
