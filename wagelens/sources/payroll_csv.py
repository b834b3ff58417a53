"""Payroll CSV ingest: lines -> records -> typed rows + quarantine.

Route (all DataFrame work, splittable reads):
  1. ``lines_of_files``: positioned lines of a glob (local, HDFS, object store);
  2. ``stitch`` (quoted cells over lines by default, or the original pairwise rule);
  3. ``parse_records``: strict well-formedness check on the raw record,
     ``from_csv`` into string cells, header lines dropped by value, the null
     marker chain, typed cells (DECIMAL(18,2) money, INT year), and a reason;
  4. ``sources.silver``: all rows written once, by run, kind and year; the
     views of valid rows, quarantine and summary show each file's last run.

Reasons: malformed_quote (record refused by the strict check), missing_cells
(fewer than 11 cells), extra_cells (more than 12; kept), not_numeric (text in
a money/year cell; value null, kept), out_of_range (too many digits; kept).
Rejected = malformed_quote or missing_cells.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.functions.cells import (cell_problem, int_cell, is_number, money_cell, strict_ok,
                                      text_cell)
from wagelens.schema import (HEADER_FIRST_CELL, MIN_PIECES, MONEY_COLUMNS, PAYROLL_COLUMNS,
                             TEXT_COLUMNS)
from wagelens.session import ship_package
from wagelens.sources.lines import QUOTES, lines_of_files, stitch

# A value no real cell holds, so "absent" and "empty" cells stay apart.
_SENTINEL = "\u0000\u0001absent\u0001\u0000"
# Possessive: Java runs it as a loop, so long quoted cells cannot exhaust the stack.
_QUOTED = r'"(?:[^"]++|"")*+"'
REJECTING = ("malformed_quote", "missing_cells")
BLANK_RECORD = r"^[ \t]*$"
HEADER_RECORD = rf'^ *(?:{re.escape(HEADER_FIRST_CELL)}|"{re.escape(HEADER_FIRST_CELL)}")(?:,|$)'


def cell_count(raw: Column) -> Column:
    """Cells of a well-formed record: commas outside quoted sections + 1."""
    bare = F.regexp_replace(raw, _QUOTED, "")
    return F.length(bare) - F.length(F.regexp_replace(bare, ",", "")) + F.lit(1)


def _cells_schema(width: int) -> str:
    return ", ".join(f"c{i} STRING" for i in range(width))


def parse_records(records: DataFrame, columns=PAYROLL_COLUMNS, min_cells: int = MIN_PIECES) -> DataFrame:
    """Typed payroll rows with ``reason``; header lines removed.

    Input: file, line_no, n_lines, raw (from a stitch step).
    Output: file, line_no, n_lines, raw, n_cells, ok, the payroll columns, reason.
    """
    width = len(columns)
    opts = {"sep": ",", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true",
            "ignoreTrailingWhiteSpace": "false", "nullValue": _SENTINEL, "emptyValue": "",
            "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    # header lines (first cell 'Employee Name', quoted or not) are dropped on the
    # raw text: a filter on a parsed cell would be pushed below the projection
    # and repeat the whole parse inside the filter
    recs = records.where(~F.col("raw").rlike(BLANK_RECORD) & ~F.col("raw").rlike(HEADER_RECORD))
    recs = recs.withColumn("ok", strict_ok(F.col("raw")))
    recs = recs.withColumn("n_cells", F.when(F.col("ok"), cell_count(F.col("raw"))))
    recs = recs.withColumn("_c", F.from_csv(F.col("raw"), _cells_schema(width), opts))
    # stages: cells, then one number test a cell, then one value a cell; the value and its
    # reason read the staged columns, so no regular expression runs twice on a cell
    present = lambda i: F.col("ok") & (F.lit(i) < F.col("n_cells"))
    recs = recs.withColumns({f"_t{i}": F.when(present(i), F.coalesce(F.col(f"_c.c{i}"), F.lit("")))
                             for i in range(width)})
    numeric = [i for i, name in enumerate(columns) if name in MONEY_COLUMNS or name == "year"]
    recs = recs.withColumns({f"_n{i}": is_number(F.col(f"_t{i}")) for i in numeric})
    recs = recs.withColumns({f"_v{i}": (int_cell if columns[i] == "year" else money_cell)(F.col(f"_t{i}"), F.col(f"_n{i}"))
                             for i in numeric})
    typed = [(F.col(f"_v{i}") if i in numeric else text_cell(F.col(f"_t{i}"))).alias(name)
             for i, name in enumerate(columns)]
    problems = [cell_problem(F.col(f"_t{i}"), F.col(f"_v{i}"), F.col(f"_n{i}")) for i in numeric]
    record_reason = (F.when(~F.col("ok"), F.lit("malformed_quote"))
                     .when(F.col("n_cells") < F.lit(min_cells), F.lit("missing_cells"))
                     .when(F.col("n_cells") > F.lit(width), F.lit("extra_cells")))
    reason = F.coalesce(record_reason, *problems)
    return recs.select("file", "line_no", "n_lines", "raw", "n_cells", "ok", *typed,
                       reason.alias("reason"))


def split_valid(parsed: DataFrame, min_cells: int = MIN_PIECES) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine rows) of ``parse_records`` output.

    The split tests ``ok`` and ``n_cells`` (exactly the rejecting reasons)
    rather than ``reason``: the filter is pushed below the projection, and
    ``reason`` would drag every cell's parse into it.
    """
    bad = ~F.col("ok") | F.coalesce(F.col("n_cells") < F.lit(min_cells), F.lit(False))
    quarantine = parsed.where(bad).select("file", "line_no", "n_lines", "raw", "reason")
    valid = parsed.where(~bad).drop("raw", "ok")
    return valid, quarantine


def reason_summary(parsed: DataFrame) -> DataFrame:
    """Records and physical lines per reason (null = clean records)."""
    return parsed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum("n_lines").cast("bigint").alias("lines"))


def fail_on_rejects(parsed: DataFrame) -> DataFrame:
    """Strict mode: the job fails on the first rejected record, naming it."""
    bad = F.coalesce(F.col("reason").isin(*REJECTING), F.lit(False))
    message = F.concat(F.lit("rejected payroll record ("), F.col("reason"), F.lit(") at "),
                       F.col("file"), F.lit(":"), (F.col("line_no") + 1).cast("string"),
                       F.lit(": "), F.substring(F.col("raw"), 1, 1000))
    return parsed.withColumn("reason", F.when(bad, F.raise_error(message).cast("string"))
                             .otherwise(F.col("reason")))


_REJECTED = re.compile(r"rejected payroll record \((?P<reason>\w+)\) at (?P<file>\S.*?):(?P<line>\d+): (?P<text>.*)", re.S)


def rejected_record(error: BaseException) -> dict | None:
    """What a job in fail mode failed on (reason, file, line from 1, text), or None if it failed on something else."""
    found = _REJECTED.search(str(error))
    if not found:
        return None
    text = found["text"].split(" SQLSTATE:")[0].split("\n\nJVM stacktrace")[0]
    return {"reason": found["reason"], "file": found["file"], "line": int(found["line"]), "text": text}


def read_payroll(spark: SparkSession, paths, mode: str = QUOTES,
                 on_error: str = "quarantine") -> DataFrame:
    """Parsed payroll records (valid and rejected, with reason) from a glob.

    ``on_error='fail'`` makes the job fail on a rejected record instead of
    keeping it for the quarantine.
    """
    ship_package(spark)
    parsed = parse_records(stitch(lines_of_files(spark, paths), mode))
    if on_error == "fail":
        return fail_on_rejects(parsed)
    if on_error != "quarantine":
        raise ValueError(f"unknown on_error {on_error!r}")
    return parsed


def read_payroll_lenient(spark: SparkSession, paths) -> DataFrame:
    """Fast path: Spark's multi-line CSV reader, newlines inside cells dropped.

    No strictness and no quarantine (the reader never shows rejected raw
    text); one task per file. Use ``read_payroll`` for checked ingest.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in PAYROLL_COLUMNS])
    df = (spark.read.schema(schema)
          .options(multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True,
                   nullValue=_SENTINEL, emptyValue="", header=False, mode="PERMISSIVE")
          .csv(paths))
    cols = []
    for name in PAYROLL_COLUMNS:
        c = F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"\r?\n", "")
        if name in MONEY_COLUMNS:
            cols.append(money_cell(c).alias(name))
        elif name == "year":
            cols.append(int_cell(c).alias(name))
        else:
            cols.append(text_cell(c).alias(name))
    return (df.select(*cols)
            .where(~F.coalesce(F.col("employee_name") == F.lit(HEADER_FIRST_CELL), F.lit(False))))


__all__ = ["parse_records", "rejected_record", "split_valid", "read_payroll", "fail_on_rejects", "reason_summary",
           "read_payroll_lenient", "cell_count", "TEXT_COLUMNS"]
