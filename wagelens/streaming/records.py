"""Records whose lines arrive in different micro-batches: the stitch as keyed state.

Lines come as (file, line_no, line), as a log shipper lands them: in any cut,
also before the lines ahead of them. The state of a file is what the batch
stitch (``sources.lines``) carries from line to line: the number of the next
line, the open record's lines, and the lines that came early. A record is
emitted once, when its last line is there; lines that come again are dropped.
A row without a line marks a file's end (its number is the count of lines) and
gives up what is still open, line by line, as the batch stitch does.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wagelens.session import ship_package
from wagelens.sources.lines import PAIRWISE, QUOTES, _Split, pairwise_code, quote_code
from wagelens.schema import MIN_PIECES

LINES = "file STRING, line_no LONG, line STRING"
RECORDS = "file STRING, line_no LONG, n_lines INT, raw STRING"
#: The state store that transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stitcher(StatefulProcessor):
    """One file's lines to records; state: place, open record, early lines."""

    def __init__(self, glue: str = ""):
        self.glue = glue.encode()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next LONG, inside BOOLEAN, first LONG, ends LONG")
        self.open = handle.getListState("open", "line BINARY")
        self.early = handle.getMapState("early", "line_no LONG", "code INT, line BINARY")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # each call to the state is a round trip to the JVM: a key without a place has nothing in it, and
        # the open record's lines are there just when the place says inside
        place = self.place.get()
        at, inside, first, ends = place or (0, False, 0, None)
        came: dict[int, tuple[int, bytes]] = {}
        for _, number, code, line in rows:
            if line is None:
                ends = number
            elif number >= at:
                came[number] = (code, bytes(line))
        codes, lines, n = [], [], at
        while True:
            got = came.pop(n, None)
            if got is None and place and self.early.containsKey((n,)):
                code, line = self.early.getValue((n,))
                got = (code, bytes(line))
                self.early.removeKey((n,))
            if got is None:
                break
            codes.append(got[0])
            lines.append(got[1])
            n += 1
        for number, (code, line) in came.items():           # beyond a line that is still missing
            self.early.updateValue((number,), (code, line))
        split = _Split(self.glue, at)
        split.inside = inside
        before = [bytes(x[0]) for x in self.open.get()] if inside and lines else []
        split.open = [(first + k, x) for k, x in enumerate(before)]
        single, glued, crossing = [], [], []
        if lines:
            split.feed(np.array(codes, np.int8), pa.array(lines, pa.binary()), single, glued, crossing)
        done = ends is not None and split.at >= ends
        if done:
            if not lines and inside:
                split.open = [(first + k, bytes(x[0])) for k, x in enumerate(self.open.get())]
            split.end(single, crossing)
            if inside:
                self.open.clear()
        elif lines:
            self._keep(split, before)
        now = (split.at, split.inside and not done, split.open[0][0] if split.open else first, ends)
        if now != place:
            self.place.update(now)
        name = key[0]
        for start, part in single:
            for k, x in enumerate(part.to_pylist()):
                yield Row(file=name, line_no=start + k, n_lines=1, raw=x.decode("utf-8", "replace"))
        for start, count, raw in glued:
            yield Row(file=name, line_no=start, n_lines=count, raw=raw.decode("utf-8", "replace"))

    def _keep(self, split: _Split, before: list[bytes]) -> None:
        """The open record's lines: further ones are appended, another record's replace them."""
        now = [x for _, x in split.open]
        if not now:
            if before:
                self.open.clear()
        elif before and now[:len(before)] == before:
            if now[len(before):]:
                self.open.appendList([(x,) for x in now[len(before):]])
        else:
            self.open.put([(x,) for x in now])

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for the queries started inside; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def start_stitch(records: DataFrame, table: str, checkpoint: str, available_now: bool = True,
                 processing_time: str = "1 minute") -> StreamingQuery:
    """Append the records of a ``stitched_stream`` to a Parquet table, each once."""
    writer = (records.writeStream.format("parquet").outputMode("append").option("path", table)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    with state_store(records.sparkSession):
        return writer.start()


def stitched_stream(lines: DataFrame, mode: str = QUOTES, min_pieces: int = MIN_PIECES, sep: str = ",",
                    glue: str = "") -> DataFrame:
    """Records (file, line_no, n_lines, raw) of a stream of ``LINES``, to be started by ``start_stitch`` (append mode, RocksDB state).

    Rows without a file are dropped. A line is coded where it is read; the
    state keeps it only while its record is open or a line before it is
    missing. One file is one key, handled by one task at a time.
    """
    if mode not in (QUOTES, PAIRWISE):
        raise ValueError(f"unknown stitch mode {mode!r}")
    spark = lines.sparkSession
    ship_package(spark)
    code = quote_code(F.col("line"), sep) if mode == QUOTES else pairwise_code(F.col("line"), min_pieces)
    coded = lines.where("file IS NOT NULL").select("file", "line_no", F.coalesce(code, F.lit(0)).cast("int").alias("code"),
                                                  F.col("line").cast("binary").alias("line"))
    return coded.groupBy("file").transformWithState(Stitcher(glue), RECORDS, "append", "none")


def read_lines_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed Parquet files of ``LINES``."""
    reader = spark.readStream.schema(LINES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)
