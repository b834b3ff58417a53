"""Row numbers, ranks and running totals over all rows, without bringing them into one task.

The rows are dealt by ranges of the leading order column, cut at its
quantiles; each range is numbered and added up within itself, and starts with
the counts and sums of the ranges before it. Those come from one row: the
totals of the ranges, as an array of their running sums (a scalar subquery of
the plan). One shuffle of the rows, no window over all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.functions.ticks import ticks

RANGES = 200
_OWN = ("_lead", "_cuts", "_range", "_before")


def running(rows: DataFrame, order: Sequence[str], value: str | None = None, descending: bool = False,
            ranges: int = RANGES) -> DataFrame:
    """``rows`` with row_no, rank, n_rows and, with ``value``, running_sum (decimal) over all rows in ``order``.

    ``order`` should tell rows apart, else equal ones are numbered in any
    order; rank is by the first column alone (equal values share the least
    number). The first column is a number, date or time, nulls last; where
    one of its values is on very many rows, these are one range. Null values
    add nothing. All rows are counted, whatever their number of ranges.
    """
    clash = sorted((set(_OWN) | {"row_no", "rank", "n_rows", "running_sum"}) & set(rows.columns))
    if clash or not order or ranges < 1:
        raise ValueError(f"columns that this operator adds: {clash}" if clash else "order and ranges are needed")
    c = F.col
    kind = rows.schema[order[0]].dataType
    lead = c(order[0]).cast("double") if isinstance(kind, (T.FractionalType, T.DecimalType)) else ticks(c(order[0]), kind)
    lead = -lead if descending else lead
    money = "decimal(38,2)"
    dealt = rows.withColumn("_lead", lead)
    cuts = dealt.agg(F.coalesce(F.array_distinct(F.percentile_approx(
        "_lead", F.array(*(F.lit(k / ranges) for k in range(1, ranges))), 10_000)) if ranges > 1 else F.lit(None).cast("array<double>"),
        F.array()).cast("array<double>").alias("cuts"))
    dealt = dealt.withColumn("_cuts", cuts.scalar())
    # values of one place in the order stay together; nulls come after all
    spot = F.aggregate("_cuts", F.lit(0), lambda n, x: n + (x <= c("_lead")).cast("int"))
    dealt = dealt.withColumn("_range", F.when(c("_lead").isNull(), ranges).otherwise(spot)).drop("_cuts")
    amount = F.coalesce(c(value).cast(money), F.lit(0).cast(money)) if value else F.lit(0).cast(money)
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum(amount).cast(money).alias("s"))
    totals = totals.agg(F.map_from_entries(F.collect_list(F.struct("_range", F.struct("n", "s")))).alias("of"))
    each = F.transform(F.sequence(F.lit(0), F.lit(ranges)), lambda i: F.coalesce(
        F.try_element_at("of", i), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast(money).alias("s"))))
    # place i of the array: what the ranges before range i hold; the last one: everything
    begins = F.transform(F.sequence(F.lit(0), F.lit(ranges + 1)), lambda i: F.aggregate(
        F.slice("each", F.lit(1), i), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast(money).alias("s")),
        lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), (a["s"] + x["s"]).cast(money).alias("s"))))
    before = totals.select(each.alias("each")).select(begins.alias("before")).scalar()
    dealt = dealt.withColumn("_before", before)
    first = (F.desc_nulls_last if descending else F.asc_nulls_last)(order[0])
    within = Window.partitionBy("_range").orderBy(first, *order[1:])
    by_lead = Window.partitionBy("_range").orderBy(first)
    start = F.element_at("_before", c("_range") + 1)
    out = dealt.select(*rows.columns, (start["n"] + F.row_number().over(within)).alias("row_no"),
                       (start["n"] + F.rank().over(by_lead)).alias("rank"), F.element_at("_before", -1)["n"].alias("n_rows"),
                       *([(start["s"] + F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                          .cast(money).alias("running_sum")] if value else []))
    return out
