"""Exact order statistics (median, percentiles) of each group, without sorting a group in one task.

A wanted rank is narrowed down by counting: the values between a group's least
and greatest are counted on equal bins, the bin that holds the rank becomes
the new range, and so on until a bin holds one value or few rows are left.
Each round is an aggregate with partial results over the rows that are still
in some range, so a group that holds all rows costs what any other does. From
the second round on only those rows are read, from a written table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.functions.sizing import broadcast_if_small
from wagelens.session import scratch_path

#: Bins of a range in a round; rows of all ranges together that are few enough to be numbered one by one.
BINS, FEW = 4_096, 50_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _checked(value, kind: T.DataType):
    """The value itself; NaN counts as null, an infinite one is refused (no bins between infinities)."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = value.cast("double")
        endless = value.isin(float("inf"), float("-inf"))
        return F.when(endless, F.raise_error(F.lit("an infinite value has no place among bins")).cast("double")).when(
            ~F.isnan(value), value)
    if isinstance(kind, (T.DecimalType, T.IntegralType)):
        return value.cast("decimal(38,0)") if isinstance(kind, T.LongType) else value
    raise TypeError(f"no order statistics of {kind.simpleString()}")


def _bin(v, lo, hi, bins: int):
    """Bin of ``v`` in [lo, hi]: never falling in v, the ends in the first and the last one."""
    part = (v - lo).cast("double") / (hi - lo).cast("double")
    return F.when(hi <= lo, 0).otherwise(F.least(F.floor(part * bins), F.lit(bins - 1))).cast("int")


def values_at_ranks(rows: DataFrame, by: Sequence[str], value: str, ranks: DataFrame, bins: int = BINS,
                    few: int = FEW) -> DataFrame:
    """``ranks`` (``by``, rank from 0, below the number of values) with the value of that rank, ``at_rank``.

    Nulls in ``by`` are a group; ``rows`` without a value take no part.
    """
    c = F.col
    kind = rows.schema[value].dataType
    rows = rows.select(*by, _checked(c(value), kind).alias("v")).where("v IS NOT NULL")
    ends = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = _written(_on(ranks.distinct(), ends, by).withColumn("below", F.lit(0).cast("long")), "ranks")
    done = None
    while True:
        open_ = wanted.where("lo < hi")
        got = wanted.where("lo = hi").select(*by, "rank", c("lo").alias("at_rank"))
        done = got if done is None else done.unionByName(got)
        if open_.isEmpty():
            break
        spans = open_.select(*by, "lo", "hi", "below").distinct()
        rows = _written(_on(rows, spans, by, both="v BETWEEN lo AND hi").select(*by, "v", "lo", "hi", "below"), "ranks-rows")
        if rows.count() <= few:
            order = Window.partitionBy(*by, "lo").orderBy("v")
            placed = rows.withColumn("rank", c("below") + F.row_number().over(order) - 1).select(*by, "rank", "v")
            done = done.unionByName(_on(open_.select(*by, "rank"), placed, by, ["rank"]).select(*by, "rank", c("v").alias("at_rank")))
            break
        counted = (rows.withColumn("bin", _bin(c("v"), c("lo"), c("hi"), bins)).groupBy(*by, "lo", "below", "bin")
                   .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi")))
        upto = F.sum("n").over(Window.partitionBy(*by, "lo").orderBy("bin"))
        counted = counted.withColumn("before", c("below") + upto - c("n")).select(*by, "lo", "before", "n", "bin_lo", "bin_hi")
        wanted = _written(_on(open_.select(*by, "rank", "lo"), counted, by, ["lo"], "rank >= before AND rank < before + n").select(
            *by, "rank", c("bin_lo").alias("lo"), c("bin_hi").alias("hi"), c("before").alias("below")), "ranks")
        rows = rows.select(*by, "v")
    return done.select(*by, "rank", c("at_rank").cast("double" if isinstance(kind, T.FloatType) else kind).alias("at_rank"))


def _on(left: DataFrame, right: DataFrame, by: Sequence[str], more: Sequence[str] = (), both: str | None = None) -> DataFrame:
    """Inner join on ``by`` (nulls equal) and ``more``; the right side, a few rows a group, is sent where it is small."""
    names = [*by, *more]
    other = right.select(*(F.col(n).alias(f"_{n}") if n in names else F.col(n) for n in right.columns))
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_{n}"))
    got = left.join(broadcast_if_small(other), on).drop(*(f"_{n}" for n in names))
    return got.where(both) if both else got


def group_percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], bins: int = BINS,
                      few: int = FEW) -> DataFrame:
    """``by``, share, n, disc, cont: exact percentiles of the values of each group, one row a share.

    disc: the least value that ``share`` of the values do not exceed; cont
    (double): between the two values around place share * (n - 1), in
    proportion. Groups without a value have no rows.
    """
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    c = F.col
    kind = rows.schema[value].dataType
    n = rows.select(*by, _checked(c(value), kind).alias("v")).where("v IS NOT NULL").groupBy(*by).agg(F.count("v").alias("n"))
    asked = n.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    place = c("share") * (c("n") - 1)
    asked = _written(asked.select(*by, "n", "share", place.alias("place"), F.floor(place).alias("r0"), F.ceil(place).alias("r1"),
                                  (F.greatest(F.lit(1), c("n") - F.floor(c("n") - c("share") * c("n"))) - 1).alias("rd")), "ranks-asked")
    ranks = asked.select(*by, F.explode(F.array("r0", "r1", "rd")).alias("rank")).distinct()
    at = _written(values_at_ranks(rows, by, value, ranks, bins, few), "ranks-values")
    for r in ("r0", "r1", "rd"):
        asked = _on(asked, at.select(*by, c("rank").alias(r), c("at_rank").alias(f"v_{r}")), by, [r])
    lo, hi = c("v_r0").cast("double"), c("v_r1").cast("double")
    return asked.select(*by, "share", "n", c("v_rd").alias("disc"), (lo + (hi - lo) * (c("place") - c("r0"))).alias("cont"))
