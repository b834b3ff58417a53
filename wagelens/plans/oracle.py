"""SQL text builders for the DuckDB oracles.

The oracles recompute every catalogue query in plain SQL over the same
Parquet tables. They share no code and no constant with the operators: labels,
radius, row rules and patterns are written out here. Floating-point steps
stand in the same order, so that both engines round alike.
"""

from __future__ import annotations

from collections.abc import Sequence

DEG, QUARTER_PI = 0.017453292519943295, 0.7853981633974483
RADIUS_M = 6370997.0
# Labels of the bins of the two edge lists that the catalogue uses.
LABELS = {
    (0.0, 10000.0, 20000.0, 50000.0, 100000.0, 150000.0, 200000.0, float("inf")):
        ("0 k", "10 k", "20 k", "50 k", "100 k", "150 k", "200 k"),
    (0.0, 1000.0, 2000.0, 5000.0, float("inf")): ("0 k", "1 k", "2 k", "5 k"),
}


def d(v: float) -> str:
    """A DOUBLE literal (DuckDB reads 0.35 as DECIMAL otherwise)."""
    if v == float("inf"):
        return "CAST('inf' AS DOUBLE)"
    return f"CAST({float(v)!r} AS DOUBLE)"


PAY_CTE = """pay AS (
  SELECT o_orderkey AS rec_id, CAST(year(o_orderdate) AS INTEGER) AS yr, n_name AS agency,
         o_orderpriority AS job, o_totalprice AS pay
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

LOC_CTE = f"""loc AS (
  SELECT n_name AS agency,
         {d(33.0)} + CAST(n_nationkey AS DOUBLE) * {d(0.35)} AS lat,
         {d(-123.0)} + CAST(n_nationkey AS DOUBLE) * {d(0.33)} AS lon,
         'resolved' AS status, TIMESTAMP '2016-03-01 00:00:00' AS updated_at
  FROM nation WHERE n_nationkey % 5 <> 4)"""

MONEY = "CAST({v} AS DECIMAL(18,2))"


def money(v: str) -> str:
    return MONEY.format(v=v)


def bin_case(v: str, edges: Sequence[float]) -> str:
    last = len(edges) - 2
    parts = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        op = "<=" if i == last else "<"
        parts.append(f"WHEN {v} >= {d(lo)} AND {v} {op} {d(hi)} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


def bins_values(edges: Sequence[float]) -> str:
    labels = LABELS[tuple(edges)]
    rows = ", ".join(f"({i}, '{s}')" for i, s in enumerate(labels))
    return f"(VALUES {rows}) AS bins(bin_idx, bin_label)"


def histogram_sql(source: str, key: str, value: str, edges: Sequence[float], key_out: str) -> str:
    """Long histogram via join with the bins table (all bins, empty ones with 0)."""
    return f"""
  b AS (SELECT {key} AS k, {bin_case(value, edges)} AS bin_idx FROM {source}),
  tot AS (SELECT k, count(*) AS n_total FROM b GROUP BY k),
  cnt AS (SELECT k, bin_idx, count(*) AS n FROM b WHERE bin_idx IS NOT NULL GROUP BY k, bin_idx),
  hist AS (
    SELECT tot.k AS {key_out}, CAST(bins.bin_idx AS INTEGER) AS bin_idx, bins.bin_label,
           coalesce(cnt.n, 0) AS n, tot.n_total,
           coalesce(cnt.n, 0) / tot.n_total * 100 AS pct,
           sqrt(coalesce(cnt.n, 0)) / tot.n_total * 100 AS pct_err
    FROM tot CROSS JOIN {bins_values(edges)}
    LEFT JOIN cnt ON cnt.k = tot.k AND cnt.bin_idx = bins.bin_idx)"""


def mean_k_sql(v: str) -> str:
    return (f"CAST(sum({money(v)}) AS DOUBLE) / CAST(count({v}) AS DOUBLE) / {d(1000.0)}")


def wrap_sql(delta: str) -> str:
    return f"(({delta}) - {d(360.0)} * floor((({delta}) + {d(180.0)}) / {d(360.0)}))"


def lcc_sql(lon: str, lat: str, lon_0: str, lat_0: str, width: str, height: str) -> tuple[str, str]:
    """Lambert conformal conic on the sphere, one standard parallel at lat_0 (false origin: the window's corner)."""
    q, half, deg, r = d(QUARTER_PI), d(2.0), d(DEG), d(RADIUS_M)
    phi1 = f"({lat_0} * {deg})"
    n = f"sin({phi1})"
    f = f"((cos({phi1}) * pow(tan({q} + {phi1} / {half}), {n})) / {n})"
    rho0 = f"(({r} * {f}) / pow(tan({q} + ({lat_0} * {deg}) / {half}), {n}))"
    rho = f"(({r} * {f}) / pow(tan({q} + ({lat} * {deg}) / {half}), {n}))"
    theta = f"({n} * ({wrap_sql(f'{lon} - {lon_0}')} * {deg}))"
    x = f"(({rho} * sin({theta})) + {width} / {half})"
    y = f"(({rho0} - {rho} * cos({theta})) + {height} / {half})"
    return f"trunc({x})", f"trunc({y})"


def nonsingular_sql(lo: str, hi: str) -> tuple[str, str]:
    single = f"({hi} - {lo} <= greatest(abs({lo}), abs({hi})) * {d(1e-15)})"
    both0 = f"({lo} = 0 AND {hi} = 0)"
    lo_s = (f"CASE WHEN {both0} THEN {d(-0.1)} WHEN {single} THEN {lo} - {d(0.1)} * abs({lo}) "
            f"ELSE CAST({lo} AS DOUBLE) END")
    hi_s = (f"CASE WHEN {both0} THEN {d(0.1)} WHEN {single} THEN {hi} + {d(0.1)} * abs({hi}) "
            f"ELSE CAST({hi} AS DOUBLE) END")
    return lo_s, hi_s


def hexcell_sql(x: str, y: str, xmin: str, xmax: str, ymin: str, ymax: str,
                nx: str, ny: str) -> tuple[str, str]:
    """Doubled index of the nearer of two shifted lattices' points."""
    pad = f"({d(1e-9)} * ({xmax} - {xmin}))"
    x0, x1 = f"({xmin} - {pad})", f"({xmax} + {pad})"
    sx = f"(({x1} - {x0}) / {nx})"
    sy = f"(({ymax} - {ymin}) / {ny})"
    ix = f"(({x} - {x0}) / {sx})"
    iy = f"(({y} - {ymin}) / {sy})"
    ix1, iy1 = f"round_even({ix}, 0)", f"round_even({iy}, 0)"
    ix2, iy2 = f"floor({ix})", f"floor({iy})"
    d1 = f"(({ix} - {ix1}) * ({ix} - {ix1}) + {d(3.0)} * (({iy} - {iy1}) * ({iy} - {iy1})))"
    dx2 = f"({ix} - {ix2} - {d(0.5)})"
    dy2 = f"({iy} - {iy2} - {d(0.5)})"
    d2 = f"({dx2} * {dx2} + {d(3.0)} * ({dy2} * {dy2}))"
    ok1 = f"({ix1} >= 0 AND {ix1} <= {nx} AND {iy1} >= 0 AND {iy1} <= {ny})"
    ok2 = f"({ix2} >= 0 AND {ix2} < {nx} AND {iy2} >= 0 AND {iy2} < {ny})"
    hx = (f"CASE WHEN {d1} < {d2} AND {ok1} THEN 2 * CAST({ix1} AS INTEGER) "
          f"WHEN NOT ({d1} < {d2}) AND {ok2} THEN 2 * CAST({ix2} AS INTEGER) + 1 END")
    hy = (f"CASE WHEN {d1} < {d2} AND {ok1} THEN 2 * CAST({iy1} AS INTEGER) "
          f"WHEN NOT ({d1} < {d2}) AND {ok2} THEN 2 * CAST({iy2} AS INTEGER) + 1 END")
    return hx, hy


def hexcentre_sql(h2: str, lo: str, hi: str, n: str, padded: bool) -> str:
    """Centre of a cell on one axis from its doubled index."""
    pad = f"({d(1e-9)} * ({hi} - {lo}))" if padded else d(0.0)
    return f"(({lo} - {pad}) + {h2} / {d(2.0)} * ((({hi} + {pad}) - ({lo} - {pad})) / {n}))"
