"""Delimited text sinks and sources (batch).

``write_tsv``: tab-separated, every cell quoted, quotes doubled; a null is a
bare empty cell, so null and the empty string stay apart; line ends inside
cells are kept as they are. ``read_tsv`` reads it back through the splittable
stitch: a file of any size is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.session import ship_package
from wagelens.sources.lines import lines_of_files, stitch


# What the parser puts for a bare empty cell; no cell of a text file holds a NUL.
ABSENT = "\u0000\u0001absent\u0001\u0000"


def tsv_cell(cell: Column) -> Column:
    return F.when(cell.isNull(), F.lit("")).otherwise(
        F.concat(F.lit('"'), F.regexp_replace(cell.cast("string"), '"', '""'), F.lit('"')))


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = "\t") -> None:
    line = F.concat_ws(sep, *(tsv_cell(F.col(c)) for c in df.columns))
    df.select(line.alias("value")).write.mode(mode).text(path)


def read_tsv(spark: SparkSession, path, schema: T.StructType, sep: str = "\t") -> DataFrame:
    """Rows of ``schema``; records may span lines; a bare empty cell is null, a quoted one the empty string."""
    ship_package(spark)
    records = stitch(lines_of_files(spark, path, "\n"), sep=sep, glue="\n")
    # multiLine keeps the parser from rewriting line ends inside quotes
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "nullValue": ABSENT, "emptyValue": "",
               "maxCharsPerColumn": "-1", "lineSep": "\u0001\u0002", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "mode": "FAILFAST"}
    parsed = records.where(F.col("raw") != "").select(F.from_csv("raw", schema.toDDL(), options).alias("r"))
    return parsed.select("r.*")


def write_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """Write one text column as lines (rows may hold newlines: multi-line records)."""
    df.select(column).write.mode(mode).text(path)
