"""Positioned lines and record stitching (cells with embedded newlines).

Lines carry (file, blk, line): the file and the byte offset of the input
split that read it; inside a split they come in file order, one task a split.

A line maps the state before it to the state after it, and there are two
states: outside a record, or inside one that an earlier line opened. Two rules
give the maps, both per file in line order:

* ``quotes`` (default): inside means inside a quoted cell. A quote opens a
  cell only at a cell's start (blanks before it allowed); a quote inside an
  unquoted cell is text; a doubled quote inside a quoted cell is text. Where
  the quote that ends an open cell is followed by other text than a comma, or
  the file ends inside a cell, that cell was never meant to be open: the
  record has failed, its lines are read again one by one, and the line that
  shows the failure starts a record of its own. So a stray or unclosed quote
  costs its own record, not those behind it, and a record may have any number
  of lines. (One by one, not pairwise: gluing a left-over fragment to the line
  behind it would destroy that line.)
* ``pairwise`` (the original rule): a line with fewer than 11 comma pieces
  is held and glued to the next line, whatever that line holds.

Lines are glued without separator (the newline is dropped).

No raw line is shuffled or sorted: one pass over the line codes gives each
split's map, a few numbers; a window over that small table composes the maps
of a file's splits; a second pass, with the state before each split at hand,
emits the records. Only the lines of records that cross a split border are
grouped across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wagelens.functions.cells import IN_QUOTES, LOOSE_FIELD
from wagelens.schema import MIN_PIECES

LINE_BREAK = r"\r\n|\r|\n"
QUOTES, PAIRWISE = "quotes", "pairwise"
# codes of a line: 1 = opens a record when outside; when inside 0 stays, 2 closes the record, 4 shows its failure
OPENS, CLOSES, FAILS = 1, 2, 4
RECORDS = "file string, line_no long, n_lines int, raw binary"
SPLITS = "file string, blk long, n long, out_state int, out_start long, in_state int, in_start long, in_outcome int"
PIECES = "file string, line_no long, ln long, line binary"
# outcomes of a record that is open at a split's start, as that split sees it
STILL_OPEN, GOOD, BAD = 0, 1, 2


def positioned(df: DataFrame) -> DataFrame:
    """(file, blk, line) of a text scan or stream; a byte-order mark at a file's start is dropped."""
    bom = (F.col("_metadata.file_block_start") == 0) & F.col("value").startswith("﻿")
    return df.select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("blk"),
                     F.when(bom, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")).alias("line"))


def lines_of_files(spark, paths, line_sep: str | None = None) -> DataFrame:
    """(file, blk, line) from text files; splittable, one row per line.

    ``line_sep="\\n"`` keeps a carriage return as part of its line.
    """
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    return positioned(reader.text(paths))


def lines_of_texts(df: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """(file, blk=0, line) from a text column: each row is one "file" of one split."""
    return df.select(F.col(file_col).cast("string").alias("file"), F.lit(0).cast("long").alias("blk"),
                     F.explode(F.split(F.col(text_col), LINE_BREAK, -1)).alias("line"))


def quote_code(line: Column, sep: str = ",") -> Column:
    # text after a cell's closing quote spoils its record (the strict check tells), not the cells behind it
    field = LOOSE_FIELD.replace(",", sep)
    closed = rf'(?:{sep}{field}(?={sep}|$))*+'
    opening = rf'^(?s:(?:{field}{sep})*+ *"{IN_QUOTES})$'
    closing = rf'^(?s:{IN_QUOTES}"{closed})$'
    staying = rf'^(?s:{IN_QUOTES}(?:"{closed}{sep} *"{IN_QUOTES})?)$'
    inside = F.when(line.rlike(closing), F.lit(CLOSES)).when(line.rlike(staying), F.lit(0)).otherwise(F.lit(FAILS))
    return F.when(line.contains('"'), F.when(line.rlike(opening), F.lit(OPENS)).otherwise(F.lit(0)) + inside) \
        .otherwise(F.lit(0))


def pairwise_code(line: Column, min_pieces: int = MIN_PIECES) -> Column:
    commas = F.length(line) - F.length(F.regexp_replace(line, ",", ""))
    return F.when(commas + 1 < F.lit(min_pieces), F.lit(OPENS + CLOSES)).otherwise(F.lit(CLOSES))


def _walk(code: np.ndarray, inside: bool) -> tuple[int, int, int]:
    """(state after, line that opened the open record or -1, outcome of the record open at the start)."""
    start, outcome, entered = -1, STILL_OPEN, inside
    at = np.flatnonzero(code)
    for k, c in zip(at.tolist(), code[at].tolist()):
        if inside:
            if c & (CLOSES | FAILS):
                if entered:
                    outcome, entered = GOOD if c & CLOSES else BAD, False
                inside = bool(c & FAILS and c & OPENS)
                start = k if inside else -1
        elif c & OPENS:
            inside, start = True, k
    return int(inside), start if inside else -1, outcome


def _runs(batches: Iterator[pa.RecordBatch]):
    """(file, blk, batch) pieces of one split each, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, blk = batch.column("file").dictionary_encode(), batch.column("blk").to_numpy()
        key = file.indices.to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (blk[1:] != blk[:-1])) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
            yield (batch.column("file")[int(a)].as_py(), int(blk[a])), batch.slice(int(a), int(b - a))


def _split_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(key, codes):
        code = np.concatenate(codes)
        return (*key, len(code), *_walk(code, False)[:2], *_walk(code, True))
    rows, now, codes = [], None, []
    for key, piece in _runs(batches):
        if key != now and codes:
            rows.append(told(now, codes))
            codes = []
        now = key
        codes.append(piece.column("code").to_numpy().astype(np.int8))
    if codes:
        rows.append(told(now, codes))
    names = ["file", "blk", "n", "out_state", "out_start", "in_state", "in_start", "in_outcome"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    cols = list(zip(*rows)) or [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def split_table(lines: DataFrame) -> DataFrame:
    """One row per split: n_pre, entry (inside?), entry_rec, entry_good, exit_good.

    ``lines`` has file, blk, code. The state before a split is the value of
    the last constant map before it, turned over by the turning maps since.
    """
    maps = lines.select("file", "blk", "code").mapInArrow(_split_maps, SPLITS)
    w = Window.partitionBy("file").orderBy("blk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    behind = w.rowsBetween(1, Window.unboundedFollowing)
    constant = F.col("out_state") == F.col("in_state")
    turns = (F.col("out_state") == 1) & (F.col("in_state") == 0)
    t = maps.withColumn("turned", F.sum(turns.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(constant, F.struct("out_state", "turned")), True).over(before)
    t = (t.withColumn("last", last)
         .withColumn("turned_pre", F.coalesce(F.lag("turned").over(w), F.lit(0)))
         .withColumn("n_pre", F.coalesce(F.sum("n").over(before), F.lit(0)))
         # what becomes of a record that is open at this split's end
         .withColumn("then", F.first(F.when(F.col("in_outcome") != STILL_OPEN, F.col("in_outcome")), True).over(behind)))
    entry = (F.coalesce(F.col("last.out_state"), F.lit(0))
             + F.col("turned_pre") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2
    t = t.withColumn("entry", entry)
    pick = lambda name: F.when(F.col("entry") == 1, F.col(f"in_{name}")).otherwise(F.col(f"out_{name}"))
    t = t.withColumn("exit", pick("state")).withColumn("start", F.when(pick("start") >= 0, F.col("n_pre") + pick("start")))
    good = F.coalesce(F.col("then") == GOOD, F.lit(False))
    own = F.when(F.col("in_outcome") == STILL_OPEN, good).otherwise(F.col("in_outcome") == GOOD)
    return (t.withColumn("entry_rec", F.last("start", True).over(before))
            .select("file", "blk", "n_pre", "entry", "entry_rec", ((F.col("entry") == 1) & own).alias("entry_good"),
                    ((F.col("exit") == 1) & good).alias("exit_good")))


class _Split:
    """The records of one split, batch by batch; memory: the open record's lines."""

    def __init__(self, glue: bytes, n_pre=0, entry=0, entry_rec=None, entry_good=False, exit_good=False):
        self.at, self.inside, self.incoming = n_pre, bool(entry), bool(entry)
        self.glue, self.rec, self.entry_good, self.exit_good = glue, entry_rec, entry_good, exit_good
        self.open: list[tuple[int, bytes]] = []

    def feed(self, code: np.ndarray, line: pa.Array, single: list, glued: list, crossing: list) -> None:
        """``single``: (first line, lines) as they are; ``glued``: (first, count, raw); ``crossing``: (record, ln, line)."""
        cur, n = 0, len(code)
        events = np.flatnonzero(code)

        def alone(a, b):
            if b > a:
                single.append((self.at + a, line.slice(a, b - a)))

        def leave(b, failed):
            """Lines cur..b of the open record, which the record that came in has to itself."""
            if self.incoming:
                if not self.entry_good:
                    alone(cur, b)
                else:
                    crossing.extend((self.rec, self.at + k, line[k].as_py()) for k in range(cur, b))
                return
            self.open += [(self.at + k, line[k].as_py()) for k in range(cur, b)]
            if failed is None:
                return
            if failed:
                if self.open:
                    single.append((self.open[0][0], pa.array([x for _, x in self.open], pa.binary())))
            else:
                glued.append((self.open[0][0], len(self.open), self.glue.join(x for _, x in self.open)))
            self.open = []

        for k, c in zip(events.tolist(), code[events].tolist()):
            if not self.inside:
                if c & OPENS:
                    alone(cur, k)
                    self.inside, cur = True, k
            elif c & CLOSES:
                leave(k + 1, False)
                self.inside, self.incoming, cur = False, False, k + 1
            elif c & FAILS:
                leave(k, True)
                self.incoming, self.inside, cur = False, bool(c & OPENS), k
        if self.inside:
            leave(n, None)
        else:
            alone(cur, n)
        self.at += n

    def end(self, single: list, crossing: list) -> None:
        if self.open and self.exit_good:
            first = self.open[0][0]
            crossing.extend((first, ln, x) for ln, x in self.open)
        elif self.open:
            single.append((self.open[0][0], pa.array([x for _, x in self.open], pa.binary())))
        self.open = []


def _records(edges: bool, known: bool, glue: bytes):
    """The records inside the splits, or (``edges``) the lines of records that cross a border."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, split = None, None
        for key, piece in _runs(batches):
            single: list = []
            glued: list = []
            crossing: list = []
            done = []
            if key != now:
                if split:
                    split.end(single, crossing)
                    done.append((now[0], single, [], crossing))
                    single, crossing = [], []
                first = {c: piece.column(c)[0].as_py() for c in
                         ("n_pre", "entry", "entry_rec", "entry_good", "exit_good")} if known else {}
                now, split = key, _Split(glue, **first)
            split.feed(piece.column("code").to_numpy().astype(np.int8), piece.column("line"), single, glued, crossing)
            done.append((now[0], single, glued, crossing))
            for out in done:
                yield from _batch(edges, *out)
        if split:
            single, crossing = [], []
            split.end(single, crossing)
            yield from _batch(edges, now[0], single, [], crossing)
    return run


def _batch(edges: bool, file: str, single: list, glued: list, crossing: list) -> Iterator[pa.RecordBatch]:
    if edges:
        if crossing:
            rec, ln, line = zip(*crossing)
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rec)), pa.array(rec, pa.int64()), pa.array(ln, pa.int64()),
                                              pa.array(line, pa.binary())], ["file", "line_no", "ln", "line"])
        return
    for at, lines in single:
        yield pa.RecordBatch.from_arrays(
            [pa.array([file] * len(lines)), pa.array(np.arange(at, at + len(lines))), pa.array(np.ones(len(lines), np.int32)),
             lines], ["file", "line_no", "n_lines", "raw"])
    if glued:
        at, n, raw = zip(*glued)
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(at)), pa.array(at, pa.int64()), pa.array(n, pa.int32()),
                                          pa.array(raw, pa.binary())], ["file", "line_no", "n_lines", "raw"])


def stitch(lines: DataFrame, mode: str = QUOTES, min_pieces: int = MIN_PIECES, whole: bool = False,
           sep: str = ",", glue: str = "") -> DataFrame:
    """Records (file, line_no, n_lines, raw) of positioned lines, a record's lines joined by ``glue``.

    ``whole``: every file lies in one split that begins at its start (texts,
    not files): no table of splits is needed. Otherwise that table is sent to
    all tasks; its size is bounded by the input's splits (some 60 bytes each:
    60 MB for a million splits, i.e. over 100 TB at 128 MB).
    """
    if mode not in (QUOTES, PAIRWISE):
        raise ValueError(f"unknown stitch mode {mode!r}")
    code = quote_code(F.col("line"), sep) if mode == QUOTES else pairwise_code(F.col("line"), min_pieces)
    coded = lines.select("file", "blk", code.cast("byte").alias("code"), F.col("line").cast("binary").alias("line"))
    text = lambda df: df.withColumn("raw", F.col("raw").cast("string"))  # noqa: E731  bytes that are no UTF-8 pass unchanged
    if whole:
        return text(coded.mapInArrow(_records(False, False, glue.encode()), RECORDS))
    table = split_table(coded.select("file", "blk", "code"))
    placed = coded.join(F.broadcast(table), ["file", "blk"])
    inside = placed.mapInArrow(_records(False, True, glue.encode()), RECORDS)
    # only splits that a crossing record enters or leaves are read for their edges; the filter
    # stands before the codes, so that other splits' lines are neither coded nor sent to Python
    crossed = F.broadcast(table.where(F.col("entry_good") | F.col("exit_good")))
    edge = lines.select("file", "blk", "line").join(crossed, ["file", "blk"]).select(
        "file", "blk", code.cast("byte").alias("code"), F.col("line").cast("binary").alias("line"),
        "n_pre", "entry", "entry_rec", "entry_good", "exit_good")
    pieces = edge.mapInArrow(_records(True, True, glue.encode()), PIECES)
    across = (pieces.groupBy("file", "line_no")
              .agg(F.array_sort(F.collect_list(F.struct("ln", F.col("line").cast("string").alias("line")))).alias("parts"))
              .select("file", "line_no", F.size("parts").alias("n_lines"),
                      F.array_join(F.transform("parts", lambda p: p["line"]), glue).cast("binary").alias("raw")))
    return text(inside.unionByName(across))
