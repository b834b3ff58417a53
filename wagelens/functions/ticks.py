"""Times, dates and whole numbers as whole numbers in their own order, for joins on ranges of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers beyond these are refused: differences of two ticks must fit a long.
FIRST, LAST = -(1 << 62), (1 << 62) - 1


def ticks(col: Column, kind: T.DataType) -> Column:
    """Microseconds of a time, days of a date, or the number itself; null stays null.

    A time without a zone is read as its wall clock says, whatever zone the
    session is in.
    """
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(col.cast("date")).cast("long") * 86_400 + F.hour(col) * 3_600 + F.minute(col) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        v = col.cast("long")
        return F.when(v.between(FIRST, LAST) | v.isNull(), v).otherwise(
            F.raise_error(F.concat(F.lit("beyond 62 bits: "), v.cast("string"))).cast("long"))
    raise TypeError(f"no order of whole numbers for {kind.simpleString()}: a time, a date or a whole number is needed")


def same_kind(*kinds: T.DataType) -> None:
    """Bounds must be of the facts' own kind: a cast between times and dates would hide a change of zone."""
    family = {T.DateType: "date", T.TimestampType: "time", T.TimestampNTZType: "wall clock"}
    found = {family.get(type(k), "number") for k in kinds}
    if len(found) != 1:
        raise TypeError(f"times of different kinds: {', '.join(k.simpleString() for k in kinds)}")
