"""Catalogue queries on order: exact percentiles of a group, row numbers, ranks and running totals over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wagelens.operators.order_stats import group_percentiles
from wagelens.operators.running import running
from wagelens.plans.temporal import PAY_CTE, dated_pay
from wagelens.sources import tables as tb

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


def q_pay_percentiles(spark, sf):
    got = group_percentiles(tb.pay_view(spark, sf), ["year"], "pay", SHARES, few=500)
    return got.select(F.col("year").alias("yr"), "share", "n", "disc", F.round("cont", 6).alias("cont"))


def sql_pay_percentiles() -> str:
    shares = ", ".join(f"CAST({s!r} AS DOUBLE)" for s in SHARES)
    return f"WITH {PAY_CTE}" + f""",
q AS (SELECT CAST(year(pay_time) AS INTEGER) AS yr, count(pay) AS n, quantile_disc(pay, [{shares}]) AS d,
             quantile_cont(pay, [{shares}]) AS c FROM dp GROUP BY 1)
SELECT yr, unnest([{shares}]) AS share, n, unnest(d) AS disc, round(unnest(c), 6) AS cont FROM q"""


def q_pay_percentiles_all(spark, sf):
    """All line prices are one group: no task sorts it."""
    lines = tb.table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))
    got = group_percentiles(lines, [], "price", SHARES, few=500)
    return got.select("share", "n", F.col("disc").cast("double").alias("disc"), F.round("cont", 6).alias("cont"))


def sql_pay_percentiles_all() -> str:
    shares = ", ".join(f"CAST({s!r} AS DOUBLE)" for s in SHARES)
    return f"""WITH q AS (SELECT count(*) AS n, quantile_disc(p, [{shares}]) AS d, quantile_cont(CAST(p AS DOUBLE), [{shares}]) AS c
  FROM (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem))
SELECT unnest([{shares}]) AS share, n, CAST(unnest(d) AS DOUBLE) AS disc, round(unnest(c), 6) AS cont FROM q"""


def q_pay_running_total(spark, sf):
    got = running(dated_pay(spark, sf).select("rec_id", "pay_time", "pay"), ["pay_time", "rec_id"], "pay", ranges=16)
    return got.select("rec_id", F.col("row_no"), "n_rows", F.col("running_sum").cast("double").alias("running_sum"))


def sql_pay_running_total() -> str:
    return f"WITH {PAY_CTE}" + """
SELECT rec_id, row_number() OVER (ORDER BY pay_time, rec_id) AS row_no, count(*) OVER () AS n_rows,
       CAST(sum(CAST(pay AS DECIMAL(18,2))) OVER (ORDER BY pay_time, rec_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_sum
FROM dp"""


def q_pay_global_rank(spark, sf):
    """Rank of every line's quantity: 50 values on all rows, so ranks are shared widely."""
    lines = tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    got = running(lines, ["l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice"], descending=True, ranges=16)
    return got.select("l_orderkey", "l_linenumber", "l_quantity", F.col("rank"), "n_rows")


def sql_pay_global_rank() -> str:
    return """SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (ORDER BY l_quantity DESC) AS rank, count(*) OVER () AS n_rows
FROM lineitem"""


QUERIES = {
    "pay_percentiles": q_pay_percentiles,
    "pay_percentiles_all": q_pay_percentiles_all,
    "pay_running_total": q_pay_running_total,
    "pay_global_rank": q_pay_global_rank,
}

ORACLES = {
    "pay_percentiles": sql_pay_percentiles,
    "pay_percentiles_all": sql_pay_percentiles_all,
    "pay_running_total": sql_pay_running_total,
    "pay_global_rank": sql_pay_global_rank,
}
