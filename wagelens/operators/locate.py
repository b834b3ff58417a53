"""Location lookup (left join), resolver worklist (anti join), upsert.

The location table has one row per agency: agency, lat, lon, status
(resolved / not_found), updated_at. Statistics are aggregated BEFORE the
join, so the join sees one row per agency (or per year and agency). The
location table is broadcast only after a size check; beyond it Spark plans
a shuffle join.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.functions.sizing import broadcast_if_small
from wagelens.schema import GEOCODE_SUFFIX, NOT_FOUND, PENDING, RESOLVED

def latest_locations(locations: DataFrame) -> DataFrame:
    """One row per agency: the latest entry wins (ties: resolved before not_found).

    A max over a struct is an ordinary aggregate with map-side partials, so
    an agency with very many cache entries costs one partial row per task.
    """
    best = F.max(F.struct(F.col("updated_at"), F.col("status"), F.col("lat"), F.col("lon")))
    return (locations.groupBy("agency").agg(best.alias("_b"))
            .select("agency", F.col("_b.lat").alias("lat"), F.col("_b.lon").alias("lon"),
                    F.col("_b.status").alias("status"), F.col("_b.updated_at").alias("updated_at")))


def locate(stats: DataFrame, locations: DataFrame, key: str = "agency") -> DataFrame:
    """Left join: every stats row kept; lat/lon null when unknown or not found.

    ``status`` is the cache status, or 'pending' when the agency is not in
    the cache yet.
    """
    places = locations.select(F.col("agency").alias(key), "lat", "lon",
                              F.col("status").alias("_status"))
    places = broadcast_if_small(places)
    return (stats.join(places, key, "left")
            .withColumn("status", F.coalesce(F.col("_status"), F.lit(PENDING)))
            .drop("_status"))


def located_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def geocode_worklist(agencies: DataFrame, locations: DataFrame, key: str = "agency") -> DataFrame:
    """Agencies absent from the cache, with the geocoder query text."""
    known = broadcast_if_small(locations.select(F.col("agency").alias(key)))
    return (agencies.select(key).distinct().join(known, key, "left_anti")
            .select(F.col(key).alias("agency"),
                    F.concat(F.col(key), F.lit(GEOCODE_SUFFIX)).alias("query")))


RESOLVED_SCHEMA = T.StructType([
    T.StructField("agency", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("status", T.StringType()),
])


def resolve_with_table(worklist: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Resolver backed by a gazetteer table (query, lat, lon): a left join."""
    gaz = broadcast_if_small(gazetteer.select("query", "lat", "lon"))
    return (worklist.join(gaz, "query", "left")
            .select("agency", "lat", "lon",
                    F.when(F.col("lat").isNotNull(), F.lit(RESOLVED))
                    .otherwise(F.lit(NOT_FOUND)).alias("status")))


def resolve_with_function(worklist: DataFrame,
                          geocode: Callable[[str], tuple[float, float] | None]) -> DataFrame:
    """Resolver calling ``geocode(query) -> (lat, lon) | None`` per worklist row.

    Runs in Arrow batches through ``mapInPandas``; an exception from the
    geocoder means "declined": the row is left out and stays in the worklist.
    Call it from the driver-planned job only; nothing is written from tasks.
    """
    def run(batches):
        for pdf in batches:
            rows = []
            for agency, query in zip(pdf["agency"], pdf["query"]):
                try:
                    hit = geocode(query)
                except Exception:
                    continue
                if hit is None:
                    rows.append((agency, None, None, NOT_FOUND))
                else:
                    rows.append((agency, float(hit[0]), float(hit[1]), RESOLVED))
            yield pd.DataFrame(rows, columns=["agency", "lat", "lon", "status"])

    return worklist.select("agency", "query").mapInPandas(run, RESOLVED_SCHEMA)


def upsert_locations(cache: DataFrame, resolved: DataFrame, resolved_at) -> DataFrame:
    """Cache plus resolver answers, latest entry per agency wins.

    Not-found answers are stored too (as null coordinates with status
    not_found), so they are not asked again.
    """
    fresh = resolved.select("agency", "lat", "lon", "status",
                            F.lit(resolved_at).cast("timestamp").alias("updated_at"))
    return latest_locations(cache.select("agency", "lat", "lon", "status", "updated_at")
                            .unionByName(fresh))
