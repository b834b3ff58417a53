"""Incremental payroll ingest with Structured Streaming.

New CSV files landing in a folder are picked up by a file stream; each
micro-batch holds whole files, so the batch reader, stitch and parse of
``sources`` apply unchanged inside ``foreachBatch``. Each batch is a run of
the payroll table (``sources.silver``): its files are listed after its rows
are written, and readers show each file's last listed run, so a retried batch
replaces its earlier attempt instead of adding to it (exactly once, together
with the stream's checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wagelens.session import ship_package
from wagelens.sources import silver
from wagelens.sources.lines import QUOTES, positioned, stitch
from wagelens.sources.payroll_csv import parse_records


def _landing_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None):
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return positioned(reader.load(landing_dir))


def ingest_batch(batch: DataFrame, batch_id: int, table: str, mode: str = QUOTES) -> None:
    """Stitch, parse and write one micro-batch as a run of the table."""
    ship_package(batch.sparkSession)
    silver.write_run(parse_records(stitch(batch, mode)), batch.select("file"), table)


def start_payroll_ingest(spark: SparkSession, landing_dir: str, table: str, checkpoint: str,
                         mode: str = QUOTES, available_now: bool = True,
                         max_files_per_trigger: int | None = None,
                         processing_time: str = "1 minute") -> StreamingQuery:
    """Start the ingest stream; ``available_now`` drains the folder and stops."""
    stream = _landing_stream(spark, landing_dir, max_files_per_trigger)
    writer = (stream.writeStream
              .foreachBatch(lambda df, bid: ingest_batch(df, bid, table, mode))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=processing_time)
    return writer.start()


def main(argv) -> int:
    """python -m wagelens.streaming.ingest LANDING TABLE CHECKPOINT [--continuous]"""
    from wagelens.session import build_session
    args = [a for a in argv if not a.startswith("--")]
    if len(args) != 3:
        raise SystemExit(main.__doc__)
    spark = build_session()
    query = start_payroll_ingest(spark, *args, available_now="--continuous" not in argv)
    query.awaitTermination()
    return 0


if __name__ == "__main__":
    import sys
    sys.exit(main(sys.argv[1:]))
