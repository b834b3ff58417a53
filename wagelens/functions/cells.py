"""Cell typing of raw text cells and the strict CSV record check.

Rules (applied to every cell): a cell is a number when it matches
``NUMBER_PATTERN``; a number holding '.' is a float, else an int; a non-number
equal to the null marker is null; any other text, the empty string included,
stays text. Declared numeric columns take numbers only: text there becomes
null and gets a reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wagelens.schema import MONEY, NULL_MARKER, NUMBER_PATTERN

KIND_NULL, KIND_TEXT, KIND_INT, KIND_FLOAT = "null", "text", "int", "float"

# Well-formed CSV record (comma, '"' quote, doubled quote, spaces allowed after
# a comma). Possessive quantifiers keep the Java matcher linear on long cells.
IN_QUOTES = r'(?:[^"]++|"")*+'
FIELD = rf' *(?:"{IN_QUOTES}"|[^", ][^,]*+|)'
# The same, with any text between a closing quote and the next comma.
LOOSE_FIELD = rf' *(?:"{IN_QUOTES}"[^,]*+|[^", ][^,]*+|)'
STRICT_RECORD = rf'^(?s:{FIELD}(?:,{FIELD})*+)$'


def is_number(cell: Column) -> Column:
    return F.coalesce(cell.rlike(NUMBER_PATTERN), F.lit(False))


def cell_kind(cell: Column) -> Column:
    return (F.when(cell.isNull(), F.lit(KIND_NULL))
            .when(is_number(cell), F.when(cell.contains("."), F.lit(KIND_FLOAT))
                  .otherwise(F.lit(KIND_INT)))
            .when(cell == F.lit(NULL_MARKER), F.lit(KIND_NULL))
            .otherwise(F.lit(KIND_TEXT)))


def text_cell(cell: Column) -> Column:
    """Text column value: the null marker becomes null, everything else stays."""
    return F.when(cell == F.lit(NULL_MARKER), F.lit(None).cast("string")).otherwise(cell)


def money_cell(cell: Column, number: Column | None = None) -> Column:
    """DECIMAL(18,2) of a numeric cell; null for text, marker or overflow.

    ``number``: the staged result of ``is_number``, where there is one.
    """
    return F.when(is_number(cell) if number is None else number, cell.try_cast(MONEY))


def int_cell(cell: Column, number: Column | None = None) -> Column:
    """INT of a numeric cell with an integral value (1e3 and 2011.0 accepted).

    A fractional value such as 2011.7 gives null (and a reason), not a
    silently truncated year.
    """
    d = cell.try_cast("double")
    # round() keeps DOUBLE, so a huge value cannot overflow the test itself
    return F.when((is_number(cell) if number is None else number) & (F.round(d, 0) == d), d.try_cast("int"))


def cell_problem(cell: Column, typed: Column, number: Column) -> Column:
    """Reason a declared-numeric cell lost its value, or null."""
    return (F.when(cell.isNull() | (cell == F.lit(NULL_MARKER)), F.lit(None).cast("string"))
            .when(~number, F.lit("not_numeric"))
            .when(typed.isNull(), F.lit("out_of_range")))


def strict_ok(raw: Column) -> Column:
    return F.coalesce(raw.rlike(STRICT_RECORD), F.lit(False))
