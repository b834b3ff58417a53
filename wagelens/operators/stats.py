"""Group statistics with exact money sums.

Values are summed as DECIMAL(18,2) cents, so results do not depend on
partitioning or task order. Mean and population standard deviation come
from the exact sums: mean = S/n, std = sqrt(n*SS - S^2) / n. Where amounts are
so large that these do not fit 38 digits, the spread is ``stddev_pop`` in
double precision instead; no amount that the ingest accepts ends a report.
The spread is reported to 1e-6. ``n_total`` counts every record, ``n`` only valued ones;
a group without values gets null statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagelens.functions.sizing import broadcast_if_small
from wagelens.operators.histogram import explode_bins, histogram_aggs, with_bin
from wagelens.schema import MONEY, PAY_EDGES

STAT_DIGITS = 6


def money(value: Column) -> Column:
    return value.cast(MONEY)


def moment_aggs(value: Column) -> list[Column]:
    m = money(value)
    return [F.count(F.lit(1)).alias("n_total"),
            F.count(m).alias("n"),
            F.sum(m).alias("_s"),
            F.try_sum(m * m).alias("_ss"),
            F.stddev_pop(m.cast("double")).alias("_sd"),
            F.max(value).alias("max_value")]


def mean_col(s: str = "_s", n: str = "n") -> Column:
    return F.try_divide(F.col(s).cast("double"), F.col(n).cast("double"))


def std_pop_col(s: str = "_s", ss: str = "_ss", n: str = "n", sd: str = "_sd") -> Column:
    spread = F.try_subtract(F.try_multiply(F.col(n).cast("decimal(20,0)"), F.col(ss)),
                            F.try_multiply(F.col(s), F.col(s)))
    exact = F.try_divide(F.sqrt(spread.cast("double")), F.col(n).cast("double"))
    return F.round(F.coalesce(exact, F.col(sd)), STAT_DIGITS)


def group_stats(df: DataFrame, value: str, by: Sequence[str] | str) -> DataFrame:
    """keys, n_total, n, n_null, sum, mean, std (population), max."""
    keys = [by] if isinstance(by, str) else list(by)
    agg = df.groupBy(*keys).agg(*moment_aggs(F.col(value)))
    return agg.select(*keys, "n_total", "n",
                      (F.col("n_total") - F.col("n")).alias("n_null"),
                      F.col("_s").cast("double").alias("sum_value"),
                      mean_col().alias("mean_value"),
                      std_pop_col().alias("std_value"),
                      "max_value")


def year_wide(df: DataFrame, value: str = "pay", year: str = "year",
              edges: Sequence[float] = PAY_EDGES) -> DataFrame:
    """One row per year: bin counts and exact moments, from one aggregation pass."""
    v = F.col(value)
    return with_bin(df, v, edges).groupBy(year).agg(*histogram_aggs(v, edges), *moment_aggs(v)[1:])


def stats_from_wide(wide: DataFrame, year: str = "year") -> DataFrame:
    return wide.select(year, "n_total", "n", (F.col("n_total") - F.col("n")).alias("n_null"),
                       mean_col().alias("mean_value"), std_pop_col().alias("std_value"))


def year_report(df: DataFrame, value: str = "pay", year: str = "year",
                edges: Sequence[float] = PAY_EDGES) -> tuple[DataFrame, DataFrame]:
    """(per-year statistics, long histogram), both from the same aggregate."""
    wide = year_wide(df, value, year, edges)
    return stats_from_wide(wide, year), explode_bins(wide, [year], edges)


def year_agency_rollup(df: DataFrame, value: str = "pay", year: str = "year", agency: str = "agency",
                       edges: Sequence[float] = PAY_EDGES) -> DataFrame:
    """Per-year AND per-(year, agency) aggregates from ONE scan (grouping sets).

    ``rollup(year, agency)`` expands each row to its grouping levels before
    the partial aggregation, so both levels share one scan and one small
    shuffle. ``_level`` is 0 for (year, agency) rows, 1 for year rows and 3
    for the grand total. Select levels with ``rollup_years`` /
    ``rollup_agencies``.
    """
    v = F.col(value)
    return (with_bin(df, v, edges).rollup(year, agency)
            .agg(*histogram_aggs(v, edges), *moment_aggs(v)[1:], F.grouping_id().alias("_level")))


def rollup_years(rolled: DataFrame, year: str = "year", agency: str = "agency") -> DataFrame:
    """The per-year rows of ``year_agency_rollup`` (same columns as ``year_wide``)."""
    return rolled.where(F.col("_level") == 1).drop(agency, "_level")


def rollup_agencies(rolled: DataFrame, year: str = "year", agency: str = "agency") -> DataFrame:
    """The per-(year, agency) rows, shaped like ``agency_stats(by=[year, agency])``."""
    return (rolled.where(F.col("_level") == 0)
            .select(year, agency, F.col("_s").cast("double").alias("sum_pay"), "n", "n_total",
                    F.col("max_value").alias("max_pay"),
                    F.try_divide(mean_col(), F.lit(1000.0)).alias("mean_k")))


def count_records(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_records"))


def year_axis(df: DataFrame, year: str = "year") -> DataFrame:
    """Axis limits of the year chart: first year - 1, last year + 1."""
    return df.agg((F.min(year) - 1).cast("int").alias("lo"),
                  (F.max(year) + 1).cast("int").alias("hi"))


def first_records(df: DataFrame, n: int = 12, order_by: Sequence[str] | str = "rec_id") -> DataFrame:
    """The first ``n`` records by key (a distributed top-k, no full sort).

    On the silver table ``order_by=["file", "line_no"]`` gives file order.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)


def values_of(df: DataFrame, key: str, key_value, columns: Sequence[str]) -> DataFrame:
    """All records of one key (lookup): a filter, never a collect."""
    return df.where(F.col(key) == F.lit(key_value)).select(*columns)


def agency_stats(df: DataFrame, value: str = "pay", by: Sequence[str] | str = "agency") -> DataFrame:
    """Sum, count, max per agency and mean in thousands (partial aggregation)."""
    keys = [by] if isinstance(by, str) else list(by)
    m = money(F.col(value))
    agg = df.groupBy(*keys).agg(F.sum(m).alias("_s"), F.count(m).alias("n"),
                                F.count(F.lit(1)).alias("n_total"),
                                F.max(value).alias("max_pay"))
    return agg.select(*keys, F.col("_s").cast("double").alias("sum_pay"), "n", "n_total",
                      "max_pay",
                      F.try_divide(mean_col(), F.lit(1000.0)).alias("mean_k"))


def industry_stats(facts: DataFrame, codes: DataFrame, fact_key: str, code_key: str,
                   code: str, value: str, prefix_len: int = 2) -> DataFrame:
    """Count, sum and mean of ``value`` per major code (first chars of ``code``).

    A left join: facts without a code are counted under a null major. A title
    with several codes takes the least one, so no fact is counted twice. The
    facts are aggregated per key before the join, so a hot key is one row.
    """
    dim = (codes.groupBy(F.col(code_key).alias("_k")).agg(F.min(code).alias("_c"))
           .select("_k", F.substring("_c", 1, prefix_len).alias("major")))
    m = money(F.col(value))
    pre = (facts.groupBy(F.col(fact_key).alias("_k"))
           .agg(F.count(F.lit(1)).alias("_n"), F.sum(m).alias("_s0")))
    per = (pre.join(broadcast_if_small(dim), "_k", "left").groupBy("major")
           .agg(F.sum("_n").alias("n"), F.sum("_s0").alias("_s")))
    return per.select("major", "n", F.col("_s").cast("double").alias("s"),
                      mean_col().alias("mean"))
