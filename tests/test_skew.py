"""A third of all rows on one key: same answers, partial aggregation, pre-aggregated joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from wagelens.operators.histogram import fixed_histogram
from wagelens.operators.stats import agency_stats, industry_stats


def skewed(spark, n=60_000):
    ids = spark.range(n)
    hot = (F.col("id") % 3) == 0
    return ids.select(
        F.when(hot, F.lit(2014)).otherwise((F.col("id") % 7 + 2008).cast("int")).alias("year"),
        F.when(hot, F.lit("HOT")).otherwise(F.concat(F.lit("A"), (F.col("id") % 500).cast("string")))
        .alias("agency"),
        F.when(hot, F.lit(7)).otherwise(F.col("id") % 1000).alias("code_key"),
        ((F.col("id") * 7919) % 300_000).cast("double").alias("pay"))


def collect_sorted(df):
    return sorted(df.collect(), key=str)


def test_skewed_keys_same_answers_under_skew_settings(spark):
    df = skewed(spark)
    base_hist = collect_sorted(fixed_histogram(df, "pay", "year"))
    base_agency = collect_sorted(agency_stats(df))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        hist = fixed_histogram(df.repartition(16), "pay", "year")
        agency = agency_stats(df.repartition(16))
        assert collect_sorted(hist) == base_hist
        assert collect_sorted(agency) == base_agency
        plan = agency._jdf.queryExecution().executedPlan().toString()
        assert "partial_sum" in plan and "partial_count" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    hot = [r for r in base_agency if r["agency"] == "HOT"][0]
    assert hot["n"] == 20_000


def test_hot_join_key_is_pre_aggregated(spark):
    df = skewed(spark)
    codes = spark.range(1000).select(F.col("id").alias("code_key"),
                                     F.concat(F.lit("C"), (F.col("id") % 9).cast("string")).alias("code"))
    small = industry_stats(df, codes, "code_key", "code_key", "code", "pay")
    big = industry_stats(df, codes, "code_key", "code_key", "code", "pay")
    assert collect_sorted(small) == collect_sorted(big)
    plan = big._jdf.queryExecution().executedPlan().toString()
    # the facts are aggregated per key before the (non-broadcast) join
    assert plan.index("partial_count") > plan.index("Join")
