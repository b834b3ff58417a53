"""Approximate aggregates that are stored and merged: distinct people (HLL) and quantiles of pay (KLL) a group.

``sketched`` reads the facts once and keeps one row a group with its sketches;
coarser groups are merged from those rows (``rolled_up``), so a report by year
or over all never reads the facts again. Sketches are of bounded size whatever
the group holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-two logarithm of the HLL registers (standard error 1.04 / sqrt(2^LG_K)); accuracy parameter of KLL.
LG_K, KLL_K = 12, 400
#: Columns of a table of sketches besides its groups.
SKETCHES = ("n", "n_valued", "people", "pay")


def sketched(facts: DataFrame, by: Sequence[str], person: str, value: str, lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """``by``, n, n_valued, people, pay: rows, rows with a value, and the sketches of persons and values.

    Nulls are in no sketch; NaN is refused by none but belongs to no quantile,
    so it counts as null; a group without persons or values has empty sketches.
    """
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    return facts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_valued"),
                                  F.hll_sketch_agg(person, F.lit(lg_k)).alias("people"),
                                  F.kll_sketch_agg_double(v, F.lit(k)).alias("pay"))


def rolled_up(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same columns for coarser groups, merged from the rows of finer ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n_valued").alias("n_valued"),
                                     F.hll_union_agg("people").alias("people"), F.kll_merge_agg_double("pay").alias("pay"))


def estimates(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The groups with n, n_valued, n_people and quantiles (an array, one for each share; null without values)."""
    keys = [c for c in sketches.columns if c not in SKETCHES]
    asked = [F.kll_sketch_get_quantile_double("pay", F.lit(float(s))) for s in shares]
    return sketches.select(*keys, "n", "n_valued", F.hll_sketch_estimate("people").alias("n_people"),
                           F.when(F.col("n_valued") > 0, F.array(*asked)).alias("quantiles"))
