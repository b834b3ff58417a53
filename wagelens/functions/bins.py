"""Fixed-edge binning and chart helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_edges(edges: Sequence[float]) -> list[float]:
    edges = [float(e) for e in edges]
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError(f"edges must be strictly increasing, got {edges}")
    return edges


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """0-based bin of ``value`` for bins [e_i, e_i+1); the last bin is closed.

    Null, NaN and values outside [e_0, e_last] give null (no bin). One
    ascending threshold test per edge.
    """
    edges = check_edges(edges)
    expr = F.when(value < F.lit(edges[0]), F.lit(None).cast("int"))
    for i, hi in enumerate(edges[1:-1]):
        expr = expr.when(value < F.lit(hi), F.lit(i))
    return expr.when(value <= F.lit(edges[-1]), F.lit(len(edges) - 2))


def edge_label(edge: float) -> str:
    """Label of a lower edge: whole thousands and ' k'; infinity is 'inf'."""
    if edge == float("inf"):
        return "inf"
    return f"{int(edge) // 1000} k"


def bin_labels(edges: Sequence[float]) -> list[str]:
    return [edge_label(e) for e in check_edges(edges)[:-1]]


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))
