"""Interval join: facts against rows that hold for a range of times (effective-dated places, job codes).

A range lies on the level of the smallest power of two of which it touches at
most two buckets; a fact looks its own bucket up on the levels that occur.
Both sides meet in an equi-join on (key, level, bucket), so no plan holds a
nested loop, a range costs two rows however long it is, and the levels are 64
at most whatever the data.

Buckets that hold very many facts are dealt into blocks: the facts are counted
on a fixed number of slots, and where a slot holds far more than its share its
facts are dealt by their own hash, the ranges repeated once for each block.
Both sides read the number of blocks from one small array (a scalar subquery
of this plan), so neither the levels nor the blocks cost a join, and building
the query runs no job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.functions.ticks import FIRST, LAST, same_kind, ticks

#: Slots on which the facts are counted, and how many of a slot's facts one block takes at least.
SLOTS, HOT_ROWS = 4_096, 1_000_000
_OWN = ("_key", "_at", "_lo", "_last", "_level", "_bucket", "_slot", "_block")


def hashable(df: DataFrame) -> list[str]:
    """The columns that Spark can hash."""
    return [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def _checked(facts: DataFrame, ranges: DataFrame, on: Sequence[str], bounds: tuple[str, str]) -> list[str]:
    """The columns of ``ranges`` that the result gets; clashing names are refused."""
    extra = [c for c in ranges.columns if c not in on]
    clash = sorted((set(extra) & set(facts.columns)) | (set(_OWN) & (set(facts.columns) | set(ranges.columns))))
    if clash:
        raise ValueError(f"columns of both sides, or of this operator: {clash}")
    missing = sorted(({*on} - {*facts.columns}) | ({*on, *bounds} - {*ranges.columns}))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return extra


def interval_join(facts: DataFrame, ranges: DataFrame, on: Sequence[str], at: str, lo: str, hi: str,
                  how: str = "inner", row_id: Sequence[str] = (), hot_rows: int = HOT_ROWS,
                  slots: int = SLOTS) -> DataFrame:
    """Facts with every row of ``ranges`` of equal ``on`` and ``lo`` <= ``at`` < ``hi``: all columns of both.

    A null bound is open. Ranges may overlap (a fact then has several rows),
    be empty (they match nothing) or repeated (as often). A null key or time
    matches nothing. ``how``: inner, or left, which keeps facts without a
    match and needs ``row_id``, columns that tell the facts apart.
    """
    if how not in ("inner", "left") or (how == "left" and not row_id):
        raise ValueError("how is 'inner' or 'left'; 'left' needs row_id")
    extra = _checked(facts, ranges, on, (lo, hi))
    kinds = [df.schema[c].dataType for df, c in ((facts, at), (ranges, lo), (ranges, hi))]
    same_kind(*kinds)
    c = F.col
    whole = F.lit(LAST).cast("long")
    held = (ranges.withColumn("_lo", F.coalesce(ticks(c(lo), kinds[1]), F.lit(FIRST).cast("long")))
            .withColumn("_last", F.coalesce(ticks(c(hi), kinds[2]) - 1, whole)).where("_lo <= _last")
            # the number of binary digits of the length: 2^level exceeds it, so two buckets hold the range
            .withColumn("_level", F.length(F.bin(c("_last") - c("_lo")))))
    levels = held.agg(F.collect_set("_level").alias("levels")).scalar()
    probes = facts.withColumn("_at", ticks(c(at), kinds[0])).where(
        F.col("_at").isNotNull() & _all_known(on)).withColumn("_level", F.explode(levels))
    probes = probes.withColumn("_bucket", F.call_function("shiftright", c("_at"), c("_level")))
    spread = F.explode(F.array_distinct(F.array(F.call_function("shiftright", c("_lo"), c("_level")),
                                                F.call_function("shiftright", c("_last"), c("_level")))))
    held = held.where(_all_known(on)).withColumn("_bucket", spread)
    slot = F.pmod(F.xxhash64(*(c(k) for k in on), c("_level"), c("_bucket")), F.lit(slots)).cast("int")
    blocks = _blocks(probes.select(slot.alias("_slot")), slots, hot_rows).scalar()
    many = F.element_at(blocks, slot + 1)
    probes = probes.withColumn("_block", F.pmod(F.xxhash64(*hashable(facts)), many).cast("int"))
    held = held.withColumn("_block", F.explode(F.sequence(F.lit(0), (many - 1).cast("int"))))
    keys = [*on, "_level", "_bucket", "_block"]
    met = probes.join(held, keys).where("_lo <= _at AND _at <= _last")
    met = met.select(*facts.columns, *extra)
    if how == "inner":
        return met
    alone = facts.join(met.select(*row_id).distinct(), list(row_id), "left_anti")
    return met.unionByName(alone.select(*facts.columns, *(F.lit(None).cast(ranges.schema[x].dataType).alias(x) for x in extra)))


def _all_known(columns: Sequence[str]):
    known = F.lit(True)
    for k in columns:
        known = known & F.col(k).isNotNull()
    return known


def _blocks(slots_of_rows: DataFrame, slots: int, hot_rows: int) -> DataFrame:
    """One row: an array that tells for each slot among how many blocks its rows are dealt.

    A block takes ``hot_rows`` or twice the mean of a slot, whichever is more:
    the blocks of all slots are then at most 1.5 times the slots.
    """
    counts = slots_of_rows.groupBy("_slot").agg(F.count(F.lit(1)).alias("n"))
    all_ = counts.agg(F.map_from_entries(F.collect_list(F.struct("_slot", "n"))).alias("of"), F.sum("n").alias("total"))
    size = F.greatest(F.lit(hot_rows).cast("long"), F.ceil(2 * F.coalesce(F.col("total"), F.lit(0)) / slots))
    return all_.select(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.ceil(
        F.greatest(F.coalesce(F.element_at("of", i), F.lit(0)), F.lit(1)) / size)).alias("blocks"))
