"""Fixed-edge histogram per group (one aggregation pass, no join).

Each group gets one row of conditional counts (map-side partial aggregates,
so a hot group costs one partial row per task), then the row is exploded
into one row per bin: every bin is present, empty ones with n = 0. The
denominator ``n_total`` counts every record of the group, null and
out-of-range values included, so percentages may sum to less than 100.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagelens.functions.bins import bin_index, bin_labels, check_edges, edge_label
from wagelens.schema import PAY_EDGES


BIN_COL = "_bin"


def with_bin(df: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    """Add the bin index once, so each per-bin count only compares integers."""
    return df.withColumn(BIN_COL, bin_index(value, edges))


def histogram_aggs(value: Column, edges: Sequence[float]) -> list[Column]:
    """Aggregates over a frame prepared by ``with_bin``."""
    edges = check_edges(edges)
    b = F.col(BIN_COL)
    return ([F.count(F.lit(1)).alias("n_total"), F.count(value).alias("n_valued")]
            + [F.count_if(b == F.lit(i)).alias(f"_bin{i}") for i in range(len(edges) - 1)])


def explode_bins(wide: DataFrame, keys: Sequence[str], edges: Sequence[float],
                 extra: Sequence[str] = ()) -> DataFrame:
    """Wide per-group counts -> long (keys, bin_idx, bin_label, n, pct, pct_err)."""
    edges = check_edges(edges)
    nb = len(edges) - 1
    labels = F.array(*[F.lit(s) for s in bin_labels(edges)])
    hi_labels = F.array(*[F.lit(edge_label(e)) for e in edges[1:]])
    lows = F.array(*[F.lit(e) for e in edges[:-1]])
    counts = F.array(*[F.col(f"_bin{i}") for i in range(nb)])
    long = wide.select(*keys, *extra, "n_total", "n_valued",
                       F.posexplode(counts).alias("bin_idx", "n"))
    return long.select(
        *keys, "bin_idx",
        F.element_at(labels, F.col("bin_idx") + 1).alias("bin_label"),
        F.element_at(hi_labels, F.col("bin_idx") + 1).alias("bin_hi_label"),
        F.element_at(lows, F.col("bin_idx") + 1).alias("bin_lo"),
        "n", "n_total", "n_valued", *extra,
        (F.col("n") / F.col("n_total") * F.lit(100)).alias("pct"),
        (F.sqrt(F.col("n")) / F.col("n_total") * F.lit(100)).alias("pct_err"))


def fixed_histogram(df: DataFrame, value: str, by: Sequence[str] | str,
                    edges: Sequence[float] = PAY_EDGES) -> DataFrame:
    """Long-form histogram of ``value`` per group ``by``."""
    keys = [by] if isinstance(by, str) else list(by)
    wide = with_bin(df, F.col(value), edges).groupBy(*keys).agg(*histogram_aggs(F.col(value), edges))
    return explode_bins(wide, keys, edges)


def requested_histogram(df: DataFrame, value: str, key: str, wanted: Sequence,
                        edges: Sequence[float] = PAY_EDGES) -> DataFrame:
    """Histogram for a requested list of keys, in the caller's order.

    Keys without records are dropped; ``ord`` is the 1-based position of the
    key in ``wanted``. The list is a literal array, so no join is planned.
    """
    wanted = list(wanted)
    if not wanted:
        raise ValueError("requested_histogram needs at least one key")
    hist = fixed_histogram(df.where(F.col(key).isin(wanted)), value, key, edges)
    order = F.array(*[F.lit(v) for v in wanted])
    return hist.withColumn("ord", F.array_position(order, F.col(key)).cast("int"))
