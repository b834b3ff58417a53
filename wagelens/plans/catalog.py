"""Query catalogue: one callable per operator group, and its DuckDB oracle.

Every query reads the given Parquet tables (or data Spark derives from them)
in full. Output columns carry the same names in both engines.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.functions.geo import hex_rows
from wagelens.operators import hexbin as hx
from wagelens.operators import locate as lc
from wagelens.operators import stats as st
from wagelens.operators.histogram import fixed_histogram, requested_histogram
from wagelens.plans import oracle as o, ordered, temporal, upkeep
from wagelens.functions.cells import cell_kind
from wagelens.plans.reports import location_map, map_report
from wagelens.session import scratch_path, ship_package
from wagelens.sources import delimited as dl
from wagelens.sources import locations as ls
from wagelens.sources.lines import PAIRWISE, lines_of_texts, stitch
from wagelens.sources.payroll_csv import read_payroll, reason_summary, rejected_record
from wagelens.schema import BAY_AREA, CALIFORNIA, PAY_EDGES, PAYROLL_COLUMNS, MapRun
from wagelens.sources import tables as tb

# Parameters of the catalogue queries.
ONE_YEAR = 1998
REQUESTED_YEARS = (1999, 2050, 1996)
BALANCE_EDGES = (0.0, 1000.0, 2000.0, 5000.0, float("inf"))
HEX_NX = 5
FUSED_RUNS = (MapRun.of(CALIFORNIA, 6, ()), MapRun.of(BAY_AREA, 9, ()))      # every year of the data
STALE_TIME = dt.datetime(2016, 1, 1)

HIST_COLS = ["bin_idx", "bin_label", "n", "n_total", "pct", "pct_err"]


def _pay(spark, sf, years=None):
    return tb.pay_view(spark, sf, years)


def q_hist_by_year(spark: SparkSession, sf: str) -> DataFrame:
    _, hist = st.year_report(_pay(spark, sf))
    return hist.select(F.col("year").alias("yr"), *HIST_COLS)


def q_year_stats(spark, sf):
    stats, _ = st.year_report(_pay(spark, sf))
    return stats.select(F.col("year").alias("yr"), "n_total", "n", "n_null",
                        F.col("mean_value").alias("mean_pay"), F.col("std_value").alias("std_pay"))


def q_count_records(spark, sf):
    return st.count_records(tb.table(spark, sf, "orders"))


def q_hist_requested_years(spark, sf):
    h = requested_histogram(_pay(spark, sf, REQUESTED_YEARS), "pay", "year", REQUESTED_YEARS)
    return h.select("ord", F.col("year").alias("yr"), *HIST_COLS)


def q_hist_out_of_range(spark, sf):
    cust = tb.table(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    h = fixed_histogram(cust, "c_acctbal", "c_mktsegment", BALANCE_EDGES)
    return h.select(F.col("c_mktsegment").alias("seg"), *HIST_COLS)


def q_year_values(spark, sf):
    return st.values_of(_pay(spark, sf, [ONE_YEAR]), "year", ONE_YEAR, ["rec_id", "pay"])


def q_first_records(spark, sf):
    return st.first_records(_pay(spark, sf)).select("rec_id", F.col("year").alias("yr"),
                                                    "agency", "pay")


def q_agency_stats(spark, sf):
    s = st.agency_stats(_pay(spark, sf), by=["year", "agency"])
    return s.select(F.col("year").alias("yr"), "agency", "sum_pay", "n", "max_pay", "mean_k")


def q_year_axis(spark, sf):
    return st.year_axis(_pay(spark, sf))


def q_location_counts(spark, sf):
    s = st.agency_stats(_pay(spark, sf), by=["year", "agency"])
    located = lc.locate(s, tb.location_view(spark, sf))
    return (located.groupBy(F.col("year").alias("yr"))
            .agg(F.count(F.lit(1)).alias("n_agencies"), F.count("lat").alias("n_located")))


def q_agency_located(spark, sf):
    s = st.agency_stats(_pay(spark, sf), by=["year", "agency"])
    return lc.locate(s, tb.location_view(spark, sf)).select(
        F.col("year").alias("yr"), "agency", "lat", "lon", "status", "n", "mean_k")


def q_locate_misses(spark, sf):
    return lc.geocode_worklist(_pay(spark, sf), tb.location_view(spark, sf))


def _stale_cache(spark, sf):
    """Older cache entries (keys % 5 = 0, shifted one degree north) the upsert must hide."""
    key = F.col("n_nationkey")
    return (tb.table(spark, sf, "nation").where(key % 5 == 0)
            .select(F.col("n_name").alias("agency"),
                    (F.lit(34.0) + key.cast("double") * F.lit(0.35)).alias("lat"),
                    (F.lit(-123.0) + key.cast("double") * F.lit(0.33)).alias("lon"),
                    F.lit("resolved").alias("status"),
                    F.lit(STALE_TIME).alias("updated_at")))


def q_location_upsert(spark, sf):
    cache = tb.location_view(spark, sf).unionByName(_stale_cache(spark, sf))
    todo = lc.geocode_worklist(_pay(spark, sf), cache)
    answers = lc.resolve_with_table(todo, tb.gazetteer_view(spark, sf))
    return lc.upsert_locations(cache, answers, tb.RESOLVE_TIME).select(
        "agency", "lat", "lon", "status")


def _cal_points(spark, sf):
    name, lon_0, lat_0, w, h = CALIFORNIA
    return hx.project(lc.located_only(tb.location_view(spark, sf)), lon_0, lat_0, w, h)


def q_project_lcc(spark, sf):
    return _cal_points(spark, sf).select("agency", "x", "y")


def q_map_window(spark, sf):
    out = None
    for name, lon_0, lat_0, w, h in (CALIFORNIA, BAY_AREA):
        p = hx.project(tb.location_view(spark, sf), lon_0, lat_0, w, h).select(
            F.lit(name).alias("map_name"), "agency", "x", "y", "inside")
        out = p if out is None else out.unionByName(p)
    return out


def q_hexbin_mean(spark, sf):
    name, lon_0, lat_0, w, h = CALIFORNIA
    s = st.agency_stats(_pay(spark, sf), by=["year", "agency"])
    pts = hx.project(lc.located_only(lc.locate(s, tb.location_view(spark, sf))), lon_0, lat_0, w, h)
    cells = hx.hexbin(pts, ["year"], HEX_NX, hex_rows(HEX_NX))
    return cells.select(F.col("year").alias("yr"), "hx2", "hy2", F.col("n_points").alias("n_agencies"),
                        F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"),
                        F.col("mean").alias("mean_k"), F.col("mean_clipped").alias("mean_k_clipped"))


def q_map_report_all(spark, sf):
    cells = map_report(_pay(spark, sf), tb.location_view(spark, sf), FUSED_RUNS)
    return cells.select("map_name", F.col("year").alias("yr"), "hx2", "hy2",
                        F.col("n_points").alias("n_agencies"), F.col("mean").alias("mean_k"))


def q_industry_stats(spark, sf):
    return st.industry_stats(tb.table(spark, sf, "lineitem"), tb.table(spark, sf, "part"),
                             "l_partkey", "p_partkey", "p_type", "l_extendedprice")


def q_industry_codes(spark, sf):
    """Job codes written as a code file (titles missing and repeated) and read back, joined to all line items."""
    path = scratch_path(spark, "job-codes")
    part = tb.table(spark, sf, "part").where(F.col("p_partkey") % 5 != 0)
    first = part.select(F.concat_ws(",", "p_type", F.concat(F.lit("part "), "p_partkey")).alias("value"))
    again = part.where(F.col("p_partkey") % 3 == 0).select(
        F.concat_ws(",", F.concat(F.lit("AA"), "p_partkey"), F.concat(F.lit("part "), "p_partkey")).alias("value"))
    dl.write_lines(first.unionByName(again), "value", path)
    facts = tb.table(spark, sf, "lineitem").select(F.concat(F.lit("part "), "l_partkey").alias("title"), "l_extendedprice")
    return st.industry_stats(facts, ls.read_job_codes(spark, path), "title", "job_title", "code", "l_extendedprice")


def q_year_stats_wide(spark, sf):
    """Amounts up to 9e15 among the orders: the spread must not overflow (told in millions)."""
    wide = F.when(F.col("o_orderkey") % 50 == 7, F.lit(9e15).cast("decimal(18,2)") - F.col("o_custkey")) \
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)")
    pay = tb.table(spark, sf, "orders").select(F.year("o_orderdate").cast("int").alias("year"), wide.alias("pay"))
    stats, _ = st.year_report(pay)
    return stats.select(F.col("year").alias("yr"), "n_total", "n", F.col("mean_value").alias("mean_pay"),
                        F.round(F.col("std_value") / 1e6, 0).alias("std_millions"))


def q_location_file(spark, sf):
    """Places written as a location file, newer answers appended, the file read back: the latest entry wins."""
    path = scratch_path(spark, "location-file")
    ls.write_locations(_stale_cache(spark, sf), path)
    ls.write_locations(tb.location_view(spark, sf), path, "append")
    known = ls.read_location_csv(spark, path)
    s = st.agency_stats(_pay(spark, sf), by=["year", "agency"])
    return lc.locate(s, known).select(F.col("year").alias("yr"), "agency", "lat", "lon", "status", "n")


def _nation_geocoder(query: str):
    """A caller's geocoder: it knows names that begin with A to I, finds none with J to R and declines the rest."""
    if query[0] >= "S":
        raise TimeoutError(query)
    return (30.0 + len(query) / 4.0, -120.0 - len(query) / 8.0) if query[0] <= "I" else None


def q_resolver_outcomes(spark, sf):
    """Every agency asked: found, not found, and declined (still on the worklist)."""
    ship_package(spark)
    nobody = tb.location_view(spark, sf).limit(0)
    todo = lc.geocode_worklist(_pay(spark, sf), nobody)
    answers = lc.resolve_with_function(todo, _nation_geocoder)
    cache = lc.upsert_locations(nobody, answers, tb.RESOLVE_TIME)
    return lc.locate(todo.select("agency"), cache).select("agency", "lat", "lon", "status")


def q_map_all_records(spark, sf):
    """One map over every record, whatever its year, for both windows of the report."""
    out = None
    for name, lon_0, lat_0, w, h in (CALIFORNIA, BAY_AREA):
        cells = location_map(_pay(spark, sf), tb.location_view(spark, sf), None, lon_0, lat_0, w, h, HEX_NX)
        cells = cells.select(F.lit(name).alias("map_name"), "hx2", "hy2", F.col("n_points").alias("n_agencies"),
                             F.col("mean").alias("mean_k"))
        out = cells if out is None else out.unionByName(cells)
    return out


def q_cell_typing(spark, sf):
    """Every cell of the rendered payroll records, typed."""
    path = scratch_path(spark, "payroll-cells")
    dl.write_lines(tb.orders_as_payroll_lines(spark, sf), "value", path)
    p = read_payroll(spark, path).where("ok")
    raw = F.from_csv("raw", ", ".join(f"{c} STRING" for c in PAYROLL_COLUMNS), CSV_OPTS).alias("c")
    cells = p.select("raw").select(raw).select("c.*").unpivot([], list(PAYROLL_COLUMNS), "cell", "value")
    return cells.groupBy("cell", cell_kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _parsed_lines(spark, sf, name, stray):
    path = scratch_path(spark, name)
    dl.write_lines(tb.orders_with_quotes(spark, sf, stray), "value", path)
    return read_payroll(spark, path)


def q_stitch_stray_quote(spark, sf):
    """Quotes inside unquoted cells are text: no record is lost or merged."""
    p = _parsed_lines(spark, sf, "payroll-stray", True)
    return p.select(F.col("notes").cast("bigint").alias("rec_id"), "ok", F.col("job_title").alias("job"),
                    F.col("n_lines").cast("bigint").alias("n_lines"),
                    F.col("total_pay_benefits").cast("double").alias("pay"))


def q_stitch_unclosed(spark, sf):
    """Unclosed quotes cost their own record only."""
    p = _parsed_lines(spark, sf, "payroll-unclosed", False)
    return (p.groupBy("ok", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("n_lines").cast("bigint").alias("lines"),
                                          F.sum(F.col("notes").cast("bigint")).cast("bigint").alias("sum_rec_id")))


def q_fail_mode(spark, sf):
    """Fail mode on records that are all well formed: it fails on none (rejects make the job fail: tests)."""
    path = scratch_path(spark, "payroll-well-formed")
    well = tb.orders_as_payroll_lines(spark, sf).where(~F.col("value").startswith('"Bad"'))
    dl.write_lines(well, "value", path)
    return read_payroll(spark, path, on_error="fail").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q_fail_mode_fails(spark, sf):
    """Fail mode on records of which one is malformed: the job fails and names its reason, file, line and text.

    ``named_right``: a file of that name has a record of that text at that
    line, as the quarantine of the same files lists it.
    """
    path = scratch_path(spark, "payroll-one-malformed")
    orders = tb.table(spark, sf, "orders")
    least = orders.where("o_totalprice < 2000").agg(F.min("o_orderkey").cast("string")).scalar()
    lines = tb.orders_as_payroll_lines(spark, sf)
    bad = F.col("value").startswith('"Bad"')
    dl.write_lines(lines.where(~bad | (F.element_at(F.split("value", ","), 10) == least)), "value", path)
    kind = "reason string, rec_id long, n_rejected long, named_right boolean"
    try:
        read_payroll(spark, path, on_error="fail").write.format("noop").mode("overwrite").save()
    except Exception as error:
        said = rejected_record(error)
        if said is None:
            raise
        rejects = read_payroll(spark, path).where("NOT ok").select("file", "line_no", "raw")
        here = ((F.col("file") == said["file"]) & (F.col("line_no") + 1 == said["line"]) & (F.col("raw") == said["text"]))
        return rejects.agg(F.lit(said["reason"]).alias("reason"), F.element_at(F.split(F.first("raw"), ","), 10).cast("long").alias("rec_id"),
                           F.count(F.lit(1)).alias("n_rejected"), F.bool_or(here).alias("named_right"))
    return spark.createDataFrame([], kind)


def _parsed_orders(spark, sf):
    """Orders rendered as payroll CSV files, then read back by the ingest."""
    path = scratch_path(spark, "payroll-csv")
    dl.write_lines(tb.orders_as_payroll_lines(spark, sf), "value", path)
    return read_payroll(spark, path)


def q_csv_parse(spark, sf):
    p = _parsed_orders(spark, sf)
    return p.select(F.col("notes").cast("bigint").alias("rec_id"), "ok",
                    F.col("employee_name").alias("name"),
                    F.col("total_pay_benefits").cast("double").alias("pay"),
                    F.col("job_title").alias("job"), F.col("year").alias("yr"),
                    "agency", "status",
                    F.col("overtime_pay").cast("double").alias("overtime"),
                    F.col("other_pay").cast("double").alias("other"),
                    F.col("n_cells").cast("bigint").alias("n_cells"),
                    F.col("n_lines").cast("bigint").alias("n_lines"), "reason")


def q_strict_reject(spark, sf):
    return reason_summary(_parsed_orders(spark, sf))


DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING"
DOC_STRUCT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType())])
CSV_OPTS = {"sep": ",", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}


def q_stitch_parity(spark, sf):
    ship_package(spark)
    lines = lines_of_texts(tb.documents_as_csv(spark, sf), "doc_id", "record")
    recs = stitch(lines, whole=True)
    parsed = recs.select(F.from_csv("raw", DOC_SCHEMA, CSV_OPTS).alias("d"),
                         F.col("n_lines").cast("bigint").alias("n_lines"))
    return parsed.select("d.doc_id", "d.text", "d.lang", "n_lines")


def q_stitch_pairwise(spark, sf):
    ship_package(spark)
    lines = lines_of_texts(tb.table(spark, sf, "documents"), "doc_id", "text")
    recs = stitch(lines, PAIRWISE, whole=True).where(F.col("raw") != "")
    return recs.select(F.col("file").cast("bigint").alias("doc_id"),
                       F.col("line_no").cast("bigint").alias("rec"),
                       F.col("n_lines").cast("bigint").alias("n_lines"),
                       F.col("raw").alias("text"))


def _hard_cells(spark, sf):
    """The documents with cells that a delimited file can lose: null, empty, CRLF, CR, tabs, quotes."""
    k = F.col("doc_id") % 7
    text = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit(""))
            .when(k == 2, F.regexp_replace("text", " ", "\r\n")).when(k == 3, F.regexp_replace("text", " ", "\r"))
            .when(k == 4, F.regexp_replace("text", " ", '\t"')).otherwise(F.col("text")))
    return tb.table(spark, sf, "documents").select("doc_id", text.alias("text"), "lang")


def q_tsv_roundtrip(spark, sf):
    path = scratch_path(spark, "documents-tsv")
    dl.write_tsv(_hard_cells(spark, sf), path)
    return dl.read_tsv(spark, path, DOC_STRUCT)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hist_by_year": q_hist_by_year,
    "year_stats": q_year_stats,
    "count_records": q_count_records,
    "hist_requested_years": q_hist_requested_years,
    "hist_out_of_range": q_hist_out_of_range,
    "year_values": q_year_values,
    "first_records": q_first_records,
    "agency_stats": q_agency_stats,
    "year_axis": q_year_axis,
    "location_counts": q_location_counts,
    "agency_located": q_agency_located,
    "locate_misses": q_locate_misses,
    "location_upsert": q_location_upsert,
    "project_lcc": q_project_lcc,
    "map_window": q_map_window,
    "hexbin_mean": q_hexbin_mean,
    "map_report_all": q_map_report_all,
    "industry_stats": q_industry_stats,
    "cell_typing": q_cell_typing,
    "csv_parse": q_csv_parse,
    "strict_reject": q_strict_reject,
    "stitch_parity": q_stitch_parity,
    "stitch_pairwise": q_stitch_pairwise,
    "tsv_roundtrip": q_tsv_roundtrip,
    "industry_codes": q_industry_codes,
    "year_stats_wide": q_year_stats_wide,
    "location_file": q_location_file,
    "resolver_outcomes": q_resolver_outcomes,
    "map_all_records": q_map_all_records,
    "stitch_stray_quote": q_stitch_stray_quote,
    "stitch_unclosed": q_stitch_unclosed,
    "fail_mode": q_fail_mode,
    "fail_mode_fails": q_fail_mode_fails,
}


# ---------------------------------------------------------------------------
# Oracles
# ---------------------------------------------------------------------------

def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


HIST_OUT = "bin_idx, bin_label, n, n_total, pct, pct_err"


def sql_hist_by_year() -> str:
    return (_with(o.PAY_CTE, o.histogram_sql("pay", "yr", "pay", PAY_EDGES, "yr"))
            + f"SELECT yr, {HIST_OUT} FROM hist")


def sql_year_stats() -> str:
    m = o.money("pay")
    return (_with(o.PAY_CTE) + f"""
SELECT yr, count(*) AS n_total, count(pay) AS n, count(*) - count(pay) AS n_null,
       CAST(sum({m}) AS DOUBLE) / CAST(count(pay) AS DOUBLE) AS mean_pay,
       round(sqrt(CAST(CAST(count(pay) AS DECIMAL(20,0)) * sum({m} * {m}) - sum({m}) * sum({m}) AS DOUBLE))
             / CAST(count(pay) AS DOUBLE), 6) AS std_pay
FROM pay GROUP BY yr""")


def sql_count_records() -> str:
    return "SELECT count(*) AS n_records FROM orders"


def sql_hist_requested_years() -> str:
    wanted = ", ".join(f"({i + 1}, {y})" for i, y in enumerate(REQUESTED_YEARS))
    return (_with(o.PAY_CTE,
                  f"want AS (SELECT * FROM (VALUES {wanted}) AS w(ord, yr))",
                  "sel AS (SELECT pay.* FROM pay JOIN want USING (yr))",
                  o.histogram_sql("sel", "yr", "pay", PAY_EDGES, "yr"))
            + f"SELECT CAST(want.ord AS INTEGER) AS ord, hist.yr, {HIST_OUT} "
              "FROM hist JOIN want ON hist.yr = want.yr")


def sql_hist_out_of_range() -> str:
    return (_with(o.histogram_sql("customer", "c_mktsegment", "c_acctbal", BALANCE_EDGES, "seg"))
            + f"SELECT seg, {HIST_OUT} FROM hist")


def sql_year_values() -> str:
    return _with(o.PAY_CTE) + f"SELECT rec_id, pay FROM pay WHERE yr = {ONE_YEAR}"


def sql_first_records() -> str:
    return _with(o.PAY_CTE) + "SELECT rec_id, yr, agency, pay FROM pay ORDER BY rec_id LIMIT 12"


def _agency_cte() -> str:
    m = o.money("pay")
    return f"""ag AS (
  SELECT yr, agency, CAST(sum({m}) AS DOUBLE) AS sum_pay, count(pay) AS n, max(pay) AS max_pay,
         {o.mean_k_sql('pay')} AS mean_k
  FROM pay GROUP BY yr, agency)"""


def sql_agency_stats() -> str:
    return (_with(o.PAY_CTE, _agency_cte())
            + "SELECT yr, agency, sum_pay, n, max_pay, mean_k FROM ag")


def sql_year_axis() -> str:
    return (_with(o.PAY_CTE)
            + "SELECT CAST(min(yr) - 1 AS INTEGER) AS lo, CAST(max(yr) + 1 AS INTEGER) AS hi FROM pay")


def sql_location_counts() -> str:
    return (_with(o.PAY_CTE, o.LOC_CTE,
                  "s AS (SELECT yr, agency FROM pay GROUP BY yr, agency)")
            + "SELECT s.yr, count(*) AS n_agencies, count(loc.lat) AS n_located "
              "FROM s LEFT JOIN loc ON s.agency = loc.agency GROUP BY s.yr")


def sql_agency_located() -> str:
    return (_with(o.PAY_CTE, o.LOC_CTE, _agency_cte())
            + "SELECT ag.yr, ag.agency, loc.lat, loc.lon, coalesce(loc.status, 'pending') AS status, "
              "ag.n, ag.mean_k FROM ag LEFT JOIN loc ON ag.agency = loc.agency")


def _miss_cte(cache: str = "loc") -> str:
    return f"""miss AS (
  SELECT DISTINCT agency, agency || ', California' AS query FROM pay
  WHERE NOT EXISTS (SELECT 1 FROM {cache} c WHERE c.agency = pay.agency))"""


def sql_locate_misses() -> str:
    return _with(o.PAY_CTE, o.LOC_CTE, _miss_cte()) + "SELECT agency, query FROM miss"


def sql_location_upsert() -> str:
    stale = f"""stale AS (
  SELECT n_name AS agency, {o.d(34.0)} + CAST(n_nationkey AS DOUBLE) * {o.d(0.35)} AS lat,
         {o.d(-123.0)} + CAST(n_nationkey AS DOUBLE) * {o.d(0.33)} AS lon,
         'resolved' AS status, TIMESTAMP '2016-01-01 00:00:00' AS updated_at
  FROM nation WHERE n_nationkey % 5 = 0)"""
    gaz = f"""gaz AS (
  SELECT n_name || ', California' AS query,
         {o.d(33.0)} + CAST(n_nationkey AS DOUBLE) * {o.d(0.35)} AS lat,
         {o.d(-123.0)} + CAST(n_nationkey AS DOUBLE) * {o.d(0.33)} AS lon
  FROM nation WHERE n_nationkey % 10 = 4)"""
    return (_with(o.PAY_CTE, o.LOC_CTE, stale,
                  "cache AS (SELECT * FROM loc UNION ALL SELECT * FROM stale)",
                  _miss_cte("cache"), gaz,
                  """res AS (
  SELECT m.agency, g.lat, g.lon,
         CASE WHEN g.lat IS NOT NULL THEN 'resolved' ELSE 'not_found' END AS status,
         TIMESTAMP '2016-03-02 00:00:00' AS updated_at
  FROM miss m LEFT JOIN gaz g ON m.query = g.query)""",
                  """allrows AS (SELECT * FROM cache UNION ALL SELECT * FROM res)""",
                  """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY agency ORDER BY updated_at DESC, status DESC) AS rn
  FROM allrows)""")
            + "SELECT agency, lat, lon, status FROM ranked WHERE rn = 1")


def _xy_cols(lon_0, lat_0, w, h, src="loc"):
    x, y = o.lcc_sql(f"{src}.lon", f"{src}.lat", o.d(lon_0), o.d(lat_0), o.d(w), o.d(h))
    return f"CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y"


def sql_project_lcc() -> str:
    _, lon_0, lat_0, w, h = CALIFORNIA
    return _with(o.LOC_CTE) + f"SELECT agency, {_xy_cols(lon_0, lat_0, w, h)} FROM loc"


def sql_map_window() -> str:
    parts = []
    for name, lon_0, lat_0, w, h in (CALIFORNIA, BAY_AREA):
        parts.append(f"""SELECT '{name}' AS map_name, agency, x, y,
       (x BETWEEN 0 AND {o.d(w)}) AND (y BETWEEN 0 AND {o.d(h)}) AS inside
FROM (SELECT agency, {_xy_cols(lon_0, lat_0, w, h)} FROM loc) p""")
    return _with(o.LOC_CTE) + "\nUNION ALL\n".join(parts)


def _hex_tail(keys: str, nx: str, ny: str, key_join: str) -> list[str]:
    lo_x, hi_x = o.nonsingular_sql("x0", "x1")
    lo_y, hi_y = o.nonsingular_sql("y0", "y1")
    hxs, hys = o.hexcell_sql("p.x", "p.y", "e.xmin", "e.xmax", "e.ymin", "e.ymax", nx, ny)
    grp = f"{keys}, " if keys else ""
    return [
        f"""ext0 AS (SELECT {grp}min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1
  FROM pts {('GROUP BY ' + keys) if keys else ''})""",
        f"""ext AS (SELECT {grp}{lo_x} AS xmin, {hi_x} AS xmax, {lo_y} AS ymin, {hi_y} AS ymax FROM ext0)""",
        f"""cells AS (SELECT p.*, {hxs} AS hx2, {hys} AS hy2
  FROM pts p JOIN ext e ON {key_join})""",
    ]


def _map_points(window: tuple, facts: str, keys: str) -> str:
    _, lon_0, lat_0, w, h = window
    return f"""pts AS (SELECT {keys}, {facts}.agency, {facts}.mean_k, {_xy_cols(lon_0, lat_0, w, h)}
  FROM {facts} JOIN loc ON {facts}.agency = loc.agency)"""


def sql_hexbin_mean() -> str:
    tail = _hex_tail("yr", o.d(HEX_NX), o.d(2.0), "p.yr = e.yr")                # 5 columns give 2 rows
    return (_with(o.PAY_CTE, o.LOC_CTE, _agency_cte(), _map_points(CALIFORNIA, "ag", "ag.yr"), *tail)
            + f"""SELECT c.yr, hx2, hy2, count(*) AS n_agencies,
       round(any_value({o.hexcentre_sql('hx2', 'e.xmin', 'e.xmax', o.d(HEX_NX), True)}), 3) AS cx,
       round(any_value({o.hexcentre_sql('hy2', 'e.ymin', 'e.ymax', o.d(2.0), False)}), 3) AS cy,
       round(avg(mean_k), 6) AS mean_k, least(greatest(round(avg(mean_k), 6), 0.0), 150.0) AS mean_k_clipped
FROM cells c JOIN ext e ON c.yr = e.yr WHERE hx2 IS NOT NULL GROUP BY c.yr, hx2, hy2""")


def sql_map_report_all() -> str:
    # (window, columns, rows): 6 columns give 3 rows, 9 give 5
    rows = ", ".join(f"('{r.name}', {o.d(r.lon_0)}, {o.d(r.lat_0)}, {o.d(r.width)}, {o.d(r.height)}, {o.d(nx)}, {o.d(ny)})"
                     for r, nx, ny in zip(FUSED_RUNS, (6.0, 9.0), (3.0, 5.0)))
    runs = f"runs AS (SELECT * FROM (VALUES {rows}) AS t(map_name, lon_0, lat_0, width, height, nx, ny))"
    x, y = o.lcc_sql("loc.lon", "loc.lat", "r.lon_0", "r.lat_0", "r.width", "r.height")
    pts = f"""pts AS (
  SELECT r.map_name, ag.yr, r.nx, r.ny, ag.agency, ag.mean_k,
         CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y
  FROM ag JOIN loc ON ag.agency = loc.agency CROSS JOIN runs r)"""
    tail = _hex_tail("map_name, yr", "p.nx", "p.ny", "p.map_name = e.map_name AND p.yr = e.yr")
    return (_with(o.PAY_CTE, o.LOC_CTE, runs, _agency_cte(), pts, *tail)
            + """SELECT map_name, yr, hx2, hy2, count(*) AS n_agencies, round(avg(mean_k), 6) AS mean_k
FROM cells WHERE hx2 IS NOT NULL GROUP BY map_name, yr, hx2, hy2""")


def sql_map_all_records() -> str:
    every = f"""every AS (SELECT 0 AS one, agency, {o.mean_k_sql('pay')} AS mean_k FROM pay GROUP BY agency)"""
    parts = []
    for window in (CALIFORNIA, BAY_AREA):
        tail = _hex_tail("one", o.d(HEX_NX), o.d(2.0), "p.one = e.one")
        ctes = ",\n".join([_map_points(window, "every", "every.one"), *tail])
        parts.append(f"""SELECT * FROM (WITH {ctes}
SELECT '{window[0]}' AS map_name, hx2, hy2, count(*) AS n_agencies, round(avg(mean_k), 6) AS mean_k
FROM cells WHERE hx2 IS NOT NULL GROUP BY hx2, hy2)""")
    return _with(o.PAY_CTE, o.LOC_CTE, every) + "\nUNION ALL\n".join(parts)


def sql_industry_codes() -> str:
    m = o.money("l_extendedprice")
    return f"""WITH codes AS (
  SELECT 'part ' || p_partkey AS title, p_type AS code FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT 'part ' || p_partkey, 'AA' || p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 = 0),
one AS (SELECT title, min(code) AS code FROM codes GROUP BY title)
SELECT substring(code, 1, 2) AS major, count(*) AS n, CAST(sum({m}) AS DOUBLE) AS s,
       CAST(sum({m}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean
FROM lineitem LEFT JOIN one ON 'part ' || l_partkey = title GROUP BY 1"""


def sql_year_stats_wide() -> str:
    return """WITH p AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS yr,
         CAST(CASE WHEN o_orderkey % 50 = 7 THEN CAST(9000000000000000 AS DECIMAL(18,2)) - o_custkey
              ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS pay
  FROM orders)
SELECT yr, count(*) AS n_total, count(pay) AS n,
       CAST(sum(pay) AS DOUBLE) / CAST(count(pay) AS DOUBLE) AS mean_pay,
       round(stddev_pop(CAST(pay AS DOUBLE)) / 1e6, 0) AS std_millions
FROM p GROUP BY yr"""


def sql_location_file() -> str:
    return (_with(o.PAY_CTE, o.LOC_CTE, """stale AS (
  SELECT n_name AS agency, CAST(34.0 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) * CAST(0.35 AS DOUBLE) AS lat,
         CAST(-123.0 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) * CAST(0.33 AS DOUBLE) AS lon, 'resolved' AS status
  FROM nation WHERE n_nationkey % 5 = 0)""", """known AS (
  SELECT agency, lat, lon, status FROM loc
  UNION ALL SELECT * FROM stale WHERE agency NOT IN (SELECT agency FROM loc))""",
                  "s AS (SELECT yr, agency, count(pay) AS n FROM pay GROUP BY yr, agency)")
            + "SELECT s.yr, s.agency, known.lat, known.lon, coalesce(known.status, 'pending') AS status, s.n "
              "FROM s LEFT JOIN known ON s.agency = known.agency")


def sql_resolver_outcomes() -> str:
    return (_with(o.PAY_CTE) + """
SELECT agency, CASE WHEN agency < 'J' THEN CAST(30.0 AS DOUBLE) + length(agency || ', California') / CAST(4.0 AS DOUBLE) END AS lat,
       CASE WHEN agency < 'J' THEN CAST(-120.0 AS DOUBLE) - length(agency || ', California') / CAST(8.0 AS DOUBLE) END AS lon,
       CASE WHEN agency < 'J' THEN 'resolved' WHEN agency < 'S' THEN 'not_found' ELSE 'pending' END AS status
FROM (SELECT DISTINCT agency FROM pay) a""")


def sql_stitch_stray_quote() -> str:
    return """SELECT o_orderkey AS rec_id, true AS ok,
       CASE WHEN o_orderkey % 2 = 0 THEN '5" pipe fitter ' ELSE 'say "hi" ' END || o_orderpriority AS job,
       CAST(1 AS BIGINT) AS n_lines, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS pay FROM orders"""


def sql_stitch_unclosed() -> str:
    return """WITH r AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 5 THEN 0 ELSE 1 END AS good,
         CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 40 <> 5 THEN 3 ELSE 1 END AS n_lines FROM orders)
SELECT good = 1 AS ok, CASE WHEN good = 0 THEN 'malformed_quote' END AS reason, count(*) AS n,
       CAST(sum(n_lines) AS BIGINT) AS lines, CAST(sum(CASE WHEN good = 1 THEN o_orderkey END) AS BIGINT) AS sum_rec_id
FROM r GROUP BY good"""


def sql_fail_mode() -> str:
    return ("WITH " + _ORDER_FACTS + """
SELECT CASE WHEN n_cells > 12 THEN 'extra_cells' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'not_numeric' END AS reason,
       count(*) AS n
FROM facts WHERE ok GROUP BY 1""")


def sql_fail_mode_fails() -> str:
    return """SELECT 'malformed_quote' AS reason, min(o_orderkey) AS rec_id, CAST(1 AS BIGINT) AS n_rejected, true AS named_right
FROM orders WHERE o_totalprice < 2000 HAVING count(*) > 0"""


def sql_industry_stats() -> str:
    m = o.money("l_extendedprice")
    return f"""SELECT substring(p_type, 1, 2) AS major, count(*) AS n,
       CAST(sum({m}) AS DOUBLE) AS s,
       CAST(sum({m}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY substring(p_type, 1, 2)"""


def sql_cell_typing() -> str:
    number = "[-+]?[0-9]*[.]?[0-9]+([eE][-+]?[0-9]+)?"
    cells = {"employee_name": "'Clerk, ' || o_custkey", "job_title": "o_orderpriority",
             "base_pay": "CAST(o_totalprice AS VARCHAR)",
             "overtime_pay": "CASE WHEN o_orderstatus = 'P' THEN 'Not Provided' ELSE '0' END",
             "other_pay": "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '5.' ELSE '1' END",
             "benefits": "'0'", "total_pay": "CAST(o_totalprice AS VARCHAR)",
             "total_pay_benefits": "CAST(o_totalprice AS VARCHAR)", "year": "CAST(year(o_orderdate) AS VARCHAR)",
             "notes": "CAST(o_orderkey AS VARCHAR)", "agency": "o_orderstatus",
             "status": "CASE WHEN n_cells >= 12 THEN 'FT' END"}
    u = "\nUNION ALL ".join(f"SELECT '{c}' AS cell, {v} AS v FROM facts WHERE ok" for c, v in cells.items())
    return ("WITH " + _ORDER_FACTS + f""",
u AS ({u})
SELECT cell, CASE WHEN v IS NULL THEN 'null' WHEN regexp_full_match(v, '{number}')
                  THEN CASE WHEN contains(v, '.') THEN 'float' ELSE 'int' END
                  WHEN v = 'Not Provided' THEN 'null' ELSE 'text' END AS kind, count(*) AS n
FROM u GROUP BY ALL""")


_ORDER_FACTS = """facts AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus,
         o_totalprice >= 2000 AS ok,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 13
              WHEN o_orderpriority = '3-MEDIUM' THEN 11 ELSE 12 END AS n_cells
  FROM orders)"""


def sql_csv_parse() -> str:
    return ("WITH " + _ORDER_FACTS + "\n" + """
SELECT CASE WHEN ok THEN o_orderkey END AS rec_id, ok,
       CASE WHEN ok THEN 'Clerk, ' || CAST(o_custkey AS VARCHAR) END AS name,
       CASE WHEN ok THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS pay,
       CASE WHEN ok THEN o_orderpriority END AS job,
       CASE WHEN ok THEN CAST(year(o_orderdate) AS INTEGER) END AS yr,
       CASE WHEN ok THEN o_orderstatus END AS agency,
       CASE WHEN ok AND n_cells >= 12 THEN 'FT' END AS status,
       CASE WHEN ok AND o_orderstatus <> 'P' THEN CAST(0 AS DOUBLE) END AS overtime,
       CASE WHEN ok AND o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(1 AS DOUBLE) END AS other,
       CAST(CASE WHEN ok THEN n_cells END AS BIGINT) AS n_cells,
       CAST(2 AS BIGINT) AS n_lines,
       CASE WHEN NOT ok THEN 'malformed_quote'
            WHEN n_cells > 12 THEN 'extra_cells'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'not_numeric' END AS reason
FROM facts""")


def sql_strict_reject() -> str:
    return ("WITH " + _ORDER_FACTS + ",\n" + """r AS (
  SELECT CASE WHEN NOT ok THEN 'malformed_quote'
              WHEN n_cells > 12 THEN 'extra_cells'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'not_numeric' END AS reason
  FROM facts)
SELECT reason, count(*) AS n, CAST(2 * count(*) AS BIGINT) AS lines FROM r GROUP BY reason""")


def sql_stitch_parity() -> str:
    return ("SELECT doc_id, replace(replace(text, chr(13), ''), chr(10), '') AS text, lang, "
            "CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents")


def sql_stitch_pairwise() -> str:
    return """WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS ln
  FROM documents),
f AS (SELECT *, len(string_split(line, ',')) < 11 AS short FROM l),
g AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END)
        OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS island FROM f),
h AS (SELECT *, sum(CASE WHEN short THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, island ORDER BY ln ROWS UNBOUNDED PRECEDING) AS r FROM g),
k AS (SELECT *, short AND r % 2 = 1 AS holder FROM h),
m AS (SELECT *, holder OR (NOT short AND NOT coalesce(
        lag(holder) OVER (PARTITION BY doc_id ORDER BY ln), false)) AS starts FROM k),
n AS (SELECT doc_id, CASE WHEN starts THEN ln ELSE ln - 1 END AS rec, ln, line FROM m)
SELECT doc_id, CAST(rec AS BIGINT) AS rec, count(*) AS n_lines,
       string_agg(line, '' ORDER BY ln) AS text
FROM n GROUP BY doc_id, rec HAVING string_agg(line, '' ORDER BY ln) <> ''"""


def sql_tsv_roundtrip() -> str:
    return """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ''
         WHEN 2 THEN replace(text, ' ', chr(13) || chr(10)) WHEN 3 THEN replace(text, ' ', chr(13))
         WHEN 4 THEN replace(text, ' ', chr(9) || '"') ELSE text END AS text, lang FROM documents"""


ORACLES: dict[str, Callable[[], str]] = {
    "hist_by_year": sql_hist_by_year,
    "year_stats": sql_year_stats,
    "count_records": sql_count_records,
    "hist_requested_years": sql_hist_requested_years,
    "hist_out_of_range": sql_hist_out_of_range,
    "year_values": sql_year_values,
    "first_records": sql_first_records,
    "agency_stats": sql_agency_stats,
    "year_axis": sql_year_axis,
    "location_counts": sql_location_counts,
    "agency_located": sql_agency_located,
    "locate_misses": sql_locate_misses,
    "location_upsert": sql_location_upsert,
    "project_lcc": sql_project_lcc,
    "map_window": sql_map_window,
    "hexbin_mean": sql_hexbin_mean,
    "map_report_all": sql_map_report_all,
    "industry_stats": sql_industry_stats,
    "cell_typing": sql_cell_typing,
    "csv_parse": sql_csv_parse,
    "strict_reject": sql_strict_reject,
    "stitch_parity": sql_stitch_parity,
    "stitch_pairwise": sql_stitch_pairwise,
    "tsv_roundtrip": sql_tsv_roundtrip,
    "industry_codes": sql_industry_codes,
    "year_stats_wide": sql_year_stats_wide,
    "location_file": sql_location_file,
    "resolver_outcomes": sql_resolver_outcomes,
    "map_all_records": sql_map_all_records,
    "stitch_stray_quote": sql_stitch_stray_quote,
    "stitch_unclosed": sql_stitch_unclosed,
    "fail_mode": sql_fail_mode,
    "fail_mode_fails": sql_fail_mode_fails,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | temporal.QUERIES | ordered.QUERIES | upkeep.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: build() for name, build in (ORACLES | temporal.ORACLES | ordered.ORACLES | upkeep.ORACLES).items()}
