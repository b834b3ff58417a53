"""Size-checked broadcast.

A side is broadcast only where the planner's own estimate of its bytes is
below a bound; beyond it, or where the estimate is unknown, the plain
DataFrame is returned and Spark plans a shuffle join that AQE may still turn
into a broadcast once the true size is known. No job runs for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate: file sizes for scans, scaled by the columns; an upper bound above them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small_enough(df: DataFrame, max_bytes: int) -> bool:
    return estimated_bytes(df) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if small_enough(df, max_bytes) else df
