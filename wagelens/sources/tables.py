"""Parquet tables and the payroll-shaped views over them.

The test tables hold no payroll, so ``pay_view`` builds one:
orders -> customer -> nation gives rec_id, year, agency, job, pay. On real
data the same columns come from the silver payroll table
(``sources.payroll_csv``), and every operator only sees those names.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagelens.functions.sizing import broadcast_if_small
from wagelens.schema import RESOLVED

# Time stamp of the synthetic location cache and of resolver answers.
CACHE_TIME = dt.datetime(2016, 3, 1)
RESOLVE_TIME = dt.datetime(2016, 3, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def year_range_predicate(ts_col: str, years: Iterable[int]):
    """Disjunction of [Jan 1, next Jan 1) ranges; reaches the Parquet scan."""
    pred = F.lit(False)            # no years: no rows (Catalyst drops "false OR")
    for y in sorted(set(int(v) for v in years)):
        lo = F.lit(f"{y:04d}-01-01 00:00:00").cast("timestamp_ntz")
        hi = F.lit(f"{y + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
        pred = pred | ((F.col(ts_col) >= lo) & (F.col(ts_col) < hi))
    return pred


def agency_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> agency name; nation is broadcast after a size check."""
    nation = broadcast_if_small(table(spark, sf_dir, "nation")
                                .select("n_nationkey", "n_name"))
    return (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("n_name").alias("agency")))


def pay_view(spark: SparkSession, sf_dir: str, years: Iterable[int] | None = None) -> DataFrame:
    """rec_id BIGINT, year INT, agency STRING, job STRING, pay DOUBLE."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    if years is not None:
        orders = orders.where(year_range_predicate("o_orderdate", years))
    return (orders.join(agency_dim(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("rec_id"),
                    F.year("o_orderdate").cast("int").alias("year"),
                    F.col("agency"),
                    F.col("o_orderpriority").alias("job"),
                    F.col("o_totalprice").alias("pay")))


def _synthetic_lat(key):
    return F.lit(33.0) + key.cast("double") * F.lit(0.35)


def _synthetic_lon(key):
    return F.lit(-123.0) + key.cast("double") * F.lit(0.33)


def location_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location cache over the nations: keys with key % 5 <> 4 are located."""
    key = F.col("n_nationkey")
    return (table(spark, sf_dir, "nation").where(key % 5 != 4)
            .select(F.col("n_name").alias("agency"),
                    _synthetic_lat(key).alias("lat"),
                    _synthetic_lon(key).alias("lon"),
                    F.lit(RESOLVED).alias("status"),
                    F.lit(CACHE_TIME).alias("updated_at")))


def gazetteer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer places a table-backed resolver knows: keys with key % 10 = 4."""
    key = F.col("n_nationkey")
    return (table(spark, sf_dir, "nation").where(key % 10 == 4)
            .select(F.concat(F.col("n_name"), F.lit(", California")).alias("query"),
                    _synthetic_lat(key).alias("lat"),
                    _synthetic_lon(key).alias("lon")))


# ---------------------------------------------------------------------------
# Payroll-shaped CSV rendered from orders (ingest tests at any scale)
# ---------------------------------------------------------------------------
PAYROLL_HEADER = ("Employee Name,Job Title,Base Pay,Overtime Pay,Other Pay,Benefits,Total Pay,"
                  "Total Pay & Benefits,Year,Notes,Agency,Status")


def _q(c):
    return F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))


def orders_as_payroll_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payroll CSV record per order (plus one header line), as text rows.

    Rendering rules (the oracle inverts them):
      name   "Clerk, <custkey>" quoted; orders under 2000 get a stray quote
             (``"Bad"Clerk <custkey>``) and are malformed;
      job    the priority, quoted, with a newline after '-' (multi-line cell);
      pay    base/total/total+benefits = the price text;
      overtime 'Not Provided' for status P, else 0;
      other  '5.' (text, not a number) for priority 4-NOT SPECIFIED, else 1;
      year   year of the order date; notes = order key; agency = order status;
      status 'FT'; priority 2-HIGH adds a 13th cell, 3-MEDIUM drops the 12th.
    """
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("string")
    bad = F.col("o_totalprice") < F.lit(2000.0)
    name = F.when(bad, F.concat(F.lit('"Bad"Clerk '), F.col("o_custkey").cast("string"))) \
        .otherwise(_q(F.concat(F.lit("Clerk, "), F.col("o_custkey").cast("string"))))
    job = _q(F.regexp_replace(F.col("o_orderpriority"), "-", "-\n"))
    overtime = F.when(F.col("o_orderstatus") == "P", F.lit("Not Provided")).otherwise(F.lit("0"))
    other = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("5.")).otherwise(F.lit("1"))
    head = [name, job, price, overtime, other, F.lit("0"), price, price,
            F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string"),
            F.col("o_orderstatus")]
    tail = (F.when(F.col("o_orderpriority") == "2-HIGH", F.lit(",FT,extra"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit(""))
            .otherwise(F.lit(",FT")))
    rows = o.select(F.concat(F.concat_ws(",", *head), tail).alias("value"))
    header = spark.range(1).select(F.lit(PAYROLL_HEADER).alias("value"))
    return rows.unionByName(header)


def orders_with_quotes(spark: SparkSession, sf_dir: str, stray: bool) -> DataFrame:
    """One payroll record per order, with quotes where they hurt.

    ``stray``: an unquoted job title holds quotes (``5" pipe fitter``). Else:
    keys % 40 = 5 open a quoted cell that is never closed, and of the others
    keys % 3 = 1 have a job title over three lines.
    """
    o = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    if stray:
        job = F.concat(F.when(key % 2 == 0, F.lit('5" pipe fitter ')).otherwise(F.lit('say "hi" ')), "o_orderpriority")
    else:
        job = F.when(key % 40 == 5, F.concat(F.lit('"open '), "o_orderpriority")) \
            .when(key % 3 == 1, F.lit('"one\ntwo, and\nthree"')).otherwise(_q(F.col("o_orderpriority")))
    name = F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string"))
    return o.select(F.concat_ws(",", name, job, price, F.lit("0"), F.lit("1"), F.lit("0"), price, price,
                                F.year("o_orderdate").cast("string"), key.cast("string"), "o_orderstatus",
                                F.lit("FT")).alias("value"))


def documents_as_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one CSV record ``doc_id,"text",lang`` (text quoted)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws(",", F.col("doc_id").cast("string"), _q(F.col("text")),
                                          F.col("lang")).alias("record"))
