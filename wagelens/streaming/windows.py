"""Statistics of landed rows by windows of event time, kept up by Structured Streaming.

``start_closed_windows`` writes each window once, when the watermark has
passed its end (append mode, the file sink's exactly-once). ``start_windows``
writes every window again whenever rows of it arrive (update mode): each
micro-batch is a folder of its own, ``latest_windows`` shows a window's last
row, and a batch that is retried overwrites its folder.

Rows older than the watermark (the one that held when the batch before theirs
began) are left out of both, as the state they would need is gone; ``late_rows`` tells how many state rows that concerned, and
``windows_to_mend`` compares the written windows with all landed rows and
gives those that lack some, with the right figures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

FIGURES = ("n", "n_valued", "sum_value", "min_value", "max_value")
#: Windows are written into folders by batch.
BATCH = "batch_id"


def landed_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None,
                  fmt: str = "parquet") -> DataFrame:
    """The rows of the files that land at ``path``, in the order in which the files land."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def event_time(rows: DataFrame, at: str) -> Column:
    """``at`` as a point in time; a wall clock without a zone is read in the session's."""
    return F.col(at).cast("timestamp")


def window_stats(rows: DataFrame, at: str, value: str, by: Sequence[str] = (), width: str = "1 hour",
                 slide: str | None = None, delay: str | None = None) -> DataFrame:
    """win_start, win_end, ``by``, n, n_valued, sum_value (exact), min_value, max_value; batch or stream.

    A row without a time belongs to no window; a null in ``by`` is a group of
    its own; null values count in n only. ``delay`` is how far behind the
    latest event time a row may arrive (streams only).
    """
    rows = rows.withColumn("_at", event_time(rows, at)).where("_at IS NOT NULL")
    if delay is not None:
        rows = rows.withWatermark("_at", delay)
    money = F.col(value).cast("decimal(18,2)")
    span = F.window("_at", width, slide) if slide else F.window("_at", width)
    return (rows.groupBy(span.alias("_w"), *by)
            .agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_valued"), F.sum(money).alias("sum_value"),
                 F.min(value).alias("min_value"), F.max(value).alias("max_value"))
            .select(F.col("_w.start").alias("win_start"), F.col("_w.end").alias("win_end"), *by, *FIGURES))


def _triggered(writer, available_now: bool, processing_time: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)


def start_closed_windows(stats: DataFrame, table: str, checkpoint: str, available_now: bool = True,
                         processing_time: str = "1 minute") -> StreamingQuery:
    """Append each window to the Parquet table once the watermark has passed its end."""
    writer = (stats.writeStream.format("parquet").outputMode("append")
              .option("path", table).option("checkpointLocation", checkpoint))
    return _triggered(writer, available_now, processing_time).start()


def start_windows(stats: DataFrame, table: str, checkpoint: str, available_now: bool = True,
                  processing_time: str = "1 minute") -> StreamingQuery:
    """Write the windows that a micro-batch changed; a batch that runs again replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/{BATCH}={batch_id}")
    writer = stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return _triggered(writer, available_now, processing_time).start()


def latest_windows(spark: SparkSession, table: str, schema: T.StructType, by: Sequence[str] = ()) -> DataFrame:
    """Every window's last row; an aggregate with partial results, not a window over the table."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(table)
    last = F.max_by(F.struct(*FIGURES), BATCH).alias("_f")
    return (rows.groupBy("win_start", "win_end", *by).agg(last)
            .select("win_start", "win_end", *by, *(F.col(f"_f.{c}").alias(c) for c in FIGURES)))


def late_rows(query: StreamingQuery) -> int:
    """How many rows of partial state the query's batches dropped behind the watermark, as far as its progress goes back."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def windows_to_mend(written: DataFrame, landed: DataFrame) -> DataFrame:
    """The windows of ``landed`` (``window_stats`` over all rows, in batch) that are written with other figures.

    Windows that are not written yet are still open and left alone.
    """
    keys = [c for c in landed.columns if c not in FIGURES]
    old = written.select(*(F.col(c).alias(f"_{c}") for c in written.columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    differ = F.lit(False)
    for f in FIGURES:
        differ = differ | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    return landed.join(old, same).where(differ).select(*landed.columns)
