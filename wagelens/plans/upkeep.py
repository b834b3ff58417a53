"""Catalogue queries: sketches rolled up without the facts, what changed between two tables, nearest places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wagelens.functions.geo import lcc_xy, truncate_m
from wagelens.operators import changes as ch
from wagelens.operators import sketches as sk
from wagelens.operators.nearest import nearest
from wagelens.plans import oracle as o
from wagelens.plans.temporal import PAY_CTE, dated_pay
from wagelens.schema import CALIFORNIA
from wagelens.session import scratch_path
from wagelens.sources import tables as tb

SHARES = (0.1, 0.5, 0.9)
#: Three standard errors of the people's sketch, and the error of a quantile's place that KLL states for its size, with room.
PEOPLE_ERROR, PLACE_ERROR = 0.05, 0.02


def _people_pay(spark, sf) -> DataFrame:
    people = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("rec_id"), F.col("o_custkey").alias("person"))
    return dated_pay(spark, sf).withColumn("yr", F.year("pay_time").cast("int")).join(people, "rec_id")


def stored_sketches(spark, sf) -> DataFrame:
    """One row a (year, agency), written and read again."""
    path = scratch_path(spark, "sketches")
    made = sk.sketched(_people_pay(spark, sf), ["yr", "agency"], "person", "pay")
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def q_sketch_years(spark, sf):
    """Years merged from the stored (year, agency) rows: exact counts, estimates within their error bounds.

    The facts are read for the comparison only.
    """
    got = sk.estimates(sk.rolled_up(stored_sketches(spark, sf), ["yr"]), SHARES)
    facts = _people_pay(spark, sf)
    exact = facts.groupBy("yr").agg(F.countDistinct("person").alias("people"))
    asked = got.select("yr", "quantiles")
    places = facts.select("yr", "pay").join(F.broadcast(asked), "yr").groupBy("yr").agg(*(
        F.avg((F.col("pay") <= F.col("quantiles")[i]).cast("double")).alias(f"le{i}") for i in range(len(SHARES))), *(
        F.avg((F.col("pay") < F.col("quantiles")[i]).cast("double")).alias(f"lt{i}") for i in range(len(SHARES))))
    near = F.lit(True)
    for i, s in enumerate(SHARES):                      # the share lies among the places of the value, or near them
        near = near & (F.col(f"lt{i}") - PLACE_ERROR <= s) & (F.col(f"le{i}") + PLACE_ERROR >= s)
    return (got.join(exact, "yr").join(places, "yr")
            .select("yr", "n", "n_valued", (F.abs(F.col("n_people") - F.col("people")) <= PEOPLE_ERROR * F.col("people")).alias("people_ok"),
                    near.alias("quantiles_ok")))


def sql_sketch_years() -> str:
    return f"WITH {PAY_CTE}" + """
SELECT CAST(year(pay_time) AS INTEGER) AS yr, count(*) AS n, count(pay) AS n_valued, true AS people_ok, true AS quantiles_ok
FROM dp GROUP BY 1"""


def _two_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The orders as an earlier and a later run held them.

    Earlier: keys % 11 = 0 twice, prices of keys % 17 = 0 not known. Later:
    keys % 7 = 0 gone, keys % 13 = 0 dearer by one, keys % 11 = 0 three times.
    """
    o = tb.table(spark, sf, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = lambda p, n: o.select("o_custkey", "o_orderstatus", F.year("o_orderdate").cast("int").alias("yr"),          # noqa: E731
                                 p.cast("decimal(18,2)").alias("pay"), F.explode(F.array_repeat(key, n)).alias("o_orderkey"))
    old = rows(F.when(key % 17 != 0, price), F.when(key % 11 == 0, 2).otherwise(1))
    new = rows(F.when(key % 17 != 0, price + F.when(key % 13 == 0, 1.0).otherwise(0.0)),
               F.when(key % 7 == 0, 0).when(key % 11 == 0, 3).otherwise(1))
    # without the key rows of one customer, status, year and unknown price are equal: a multiset
    return old.drop("o_orderkey"), new.drop("o_orderkey")


_RUNS_CTE = """old AS (
  SELECT o_custkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS yr,
         CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS pay
  FROM orders, range(2) AS r(k) WHERE k < CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END),
new AS (
  SELECT o_custkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS yr,
         CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_totalprice + CASE WHEN o_orderkey % 13 = 0 THEN 1.0 ELSE 0.0 END AS DECIMAL(18,2)) END AS pay
  FROM orders, range(3) AS r(k) WHERE k < CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 3 ELSE 1 END)"""
_ROW = "o_custkey, o_orderstatus, yr, CAST(pay AS DOUBLE) AS pay, count(*) AS n"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("o_custkey", "o_orderstatus", "yr", F.col("pay").cast("double").alias("pay"), "n")


def q_reingest_removed(spark, sf):
    return _shown(ch.except_all(*_two_runs(spark, sf)))


def q_reingest_added(spark, sf):
    return _shown(ch.except_all(*reversed(_two_runs(spark, sf))))


def q_reingest_kept(spark, sf):
    return _shown(ch.intersect_all(*_two_runs(spark, sf)))


def _sql_sets(operation: str) -> str:
    return f"WITH {_RUNS_CTE}\nSELECT {_ROW} FROM ({operation}) GROUP BY o_custkey, o_orderstatus, yr, pay"


def sql_reingest_removed() -> str:
    return _sql_sets("SELECT * FROM old EXCEPT ALL SELECT * FROM new")


def sql_reingest_added() -> str:
    return _sql_sets("SELECT * FROM new EXCEPT ALL SELECT * FROM old")


def sql_reingest_kept() -> str:
    return _sql_sets("SELECT * FROM old INTERSECT ALL SELECT * FROM new")


def _projected(df: DataFrame, key: str, lon0: float, lat0: float, spread: int) -> DataFrame:
    """``df`` with lon and lat made from ``key``, projected to whole metres of the California window."""
    lon = F.lit(lon0) + ((F.col(key) * 37) % spread).cast("double") / F.lit(100.0)
    lat = F.lit(lat0) + ((F.col(key) * 91) % spread).cast("double") / F.lit(100.0)
    x, y = lcc_xy(lon, lat, *CALIFORNIA[1:])
    return df.withColumn("x", truncate_m(x)).withColumn("y", truncate_m(y))


def q_nearest_agency(spark, sf):
    """Every customer's nearest supplier, both projected; suppliers stand for located agencies."""
    people = _projected(tb.table(spark, sf, "customer").select("c_custkey"), "c_custkey", -124.0, 32.0, 997)
    places = _projected(tb.table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", -123.5, 32.5, 883)
    places = places.withColumnsRenamed({"x": "px", "y": "py"})
    got = nearest(people, places, "x", "y", ["s_suppkey"], "px", "py")
    return got.select("c_custkey", "s_suppkey", "dist2")


def sql_nearest_agency() -> str:
    def xy(key, lon0, lat0, spread):
        lon = f"({o.d(lon0)} + CAST(({key} * 37) % {spread} AS DOUBLE) / {o.d(100.0)})"
        lat = f"({o.d(lat0)} + CAST(({key} * 91) % {spread} AS DOUBLE) / {o.d(100.0)})"
        return o.lcc_sql(lon, lat, o.d(-119.0), o.d(37.20), o.d(1_000_000.0), o.d(1_200_000.0))
    cx, cy = xy("c_custkey", -124.0, 32.0, 997)
    sx, sy = xy("s_suppkey", -123.5, 32.5, 883)
    return f"""WITH c AS (SELECT c_custkey, {cx} AS x, {cy} AS y FROM customer),
s AS (SELECT s_suppkey, {sx} AS px, {sy} AS py FROM supplier),
r AS (SELECT c_custkey, s_suppkey, (px - x) * (px - x) + (py - y) * (py - y) AS dist2,
             row_number() OVER (PARTITION BY c_custkey ORDER BY (px - x) * (px - x) + (py - y) * (py - y), s_suppkey) AS k FROM c, s)
SELECT c_custkey, s_suppkey, dist2 FROM r WHERE k = 1"""


QUERIES = {
    "nearest_agency": q_nearest_agency,
    "sketch_years": q_sketch_years,
    "reingest_removed": q_reingest_removed,
    "reingest_added": q_reingest_added,
    "reingest_kept": q_reingest_kept,
}

ORACLES = {
    "nearest_agency": sql_nearest_agency,
    "sketch_years": sql_sketch_years,
    "reingest_removed": sql_reingest_removed,
    "reingest_added": sql_reingest_added,
    "reingest_kept": sql_reingest_kept,
}
