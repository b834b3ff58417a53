"""As-of join: each fact with the row of another table that was the last one known at its time.

Both sides are put in one table, dealt by key and range of time, and the last
known row is carried along in time order within each. The ranges are cut at
quantiles of the facts' times, so a key that holds a third of all facts, or
all of them, is the work of many tasks. What a range begins with comes from
the ranges before it: one row for each key and range, carried over by a window
over those few rows and put into the table as a row at the range's beginning.
The facts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wagelens.functions.ticks import FIRST, same_kind, ticks
from wagelens.operators.interval import hashable

#: Ranges of time among which the facts are dealt.
RANGES = 64
_OWN = ("_at", "_cuts", "_range", "_side", "_known", "_fact")


def asof_join(facts: DataFrame, known: DataFrame, on: Sequence[str], at: str, since: str, ranges: int = RANGES,
              within: int | None = None, how: str = "left") -> DataFrame:
    """Facts with the columns of the row of ``known`` of equal ``on`` and the latest ``since`` <= ``at``.

    Of rows of ``known`` with the same key and time the greatest in the order
    of its other columns counts (nulls first), so the result does not depend
    on the order of rows. ``within``: the row must be at most so many ticks
    old (microseconds, days, or units of the number). A null key or time
    finds nothing and is known to nobody. ``how``: left, or inner.
    """
    if how not in ("left", "inner") or ranges < 1:
        raise ValueError("how is 'left' or 'inner', ranges at least 1")
    extra = [x for x in known.columns if x not in on]
    clash = sorted((set(extra) & set(facts.columns)) | (set(_OWN) & (set(facts.columns) | set(known.columns))))
    if clash:
        raise ValueError(f"columns of both sides, or of this operator: {clash}")
    kinds = facts.schema[at].dataType, known.schema[since].dataType
    same_kind(*kinds)
    c = F.col
    # where the time is cut: one row, a scalar subquery of this plan
    times = facts.select(ticks(c(at), kinds[0]).alias("_at"))
    cuts = times.agg(F.coalesce(F.array_distinct(F.percentile_approx(
        "_at", F.array(*(F.lit(k / ranges) for k in range(1, ranges))), 10_000)),
        F.array().cast("array<bigint>")).alias("cuts")) if ranges > 1 else None
    def with_cuts(df: DataFrame) -> DataFrame:
        return df.withColumn("_cuts", F.array().cast("array<bigint>") if cuts is None else cuts.scalar())
    place = F.aggregate("_cuts", F.lit(0), lambda n, x: n + (x <= c("_at")).cast("int"))
    valid = F.lit(True)
    for k in on:
        valid = valid & c(k).isNotNull()
    rows = (known.withColumn("_at", ticks(c(since), kinds[1])).where(valid & c("_at").isNotNull())
            .groupBy(*on, "_at").agg(F.max(F.struct(*extra)).alias("_known")))
    rows = with_cuts(rows).withColumn("_range", place).drop("_cuts")
    # what each range ends with, and so what the next ones begin with
    ends = rows.groupBy(*on, "_range").agg(F.max(F.struct("_at", "_known")).alias("_end"))
    if cuts is None:
        begun = None
    else:
        order = Window.partitionBy(*on).orderBy("_range")
        final = F.size(cuts.scalar())
        until = F.coalesce(F.lead("_range").over(order), final)
        begun = (ends.withColumn("_until", until).where(c("_range") < final)
                 .withColumn("_next", F.explode(F.sequence(c("_range") + 1, c("_until"))))
                 .select(*on, F.struct(c("_end._at").alias("at"), c("_end._known").alias("row")).alias("_known"),
                         c("_next").alias("_range")))
    none_fact = F.lit(None).cast(f"struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in facts.schema.fields)}>")
    held = rows.select(*on, "_range", "_at", F.lit(1).alias("_side"),
                       F.struct(c("_at").alias("at"), c("_known").alias("row")).alias("_known"), none_fact.alias("_fact"))
    asked = facts.withColumn("_at", ticks(c(at), kinds[0]))
    kind = held.schema["_known"].dataType.simpleString()
    # facts that find nothing are dealt by their own hash
    apart = -1 - F.pmod(F.xxhash64(*hashable(facts)), F.lit(16 * ranges)).cast("int")
    asked = with_cuts(asked).withColumn("_range", F.when(valid & c("_at").isNotNull(), place).otherwise(apart)).select(
        *on, "_range", "_at", F.lit(2).alias("_side"), F.lit(None).cast(kind).alias("_known"),
        F.struct(*(c(f"`{x}`") for x in facts.columns)).alias("_fact"))
    both = held.unionByName(asked)
    if begun is not None:
        both = both.unionByName(begun.select(*on, "_range", F.lit(FIRST).cast("long").alias("_at"), F.lit(0).alias("_side"),
                                             "_known", none_fact.alias("_fact")))
    frame = (Window.partitionBy(*on, "_range").orderBy("_at", "_side")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (both.withColumn("_known", F.last("_known", ignorenulls=True).over(frame)).where("_side = 2"))
    near = c("_known").isNotNull() & c("_at").isNotNull() & valid
    if within is not None:
        near = near & (c("_at") - c("_known.at") <= within)
    found = found.withColumn("_known", F.when(near, c("_known")))
    if how == "inner":
        found = found.where("_known IS NOT NULL")
    return found.select(*(c(f"_fact.`{x}`").alias(x) for x in facts.columns),
                        *(c(f"_known.row.`{x}`").alias(x) for x in extra))
