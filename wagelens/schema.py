"""Schemas and fixed values.

Fixed values that must equal the original job's for the same answers are kept
together here, in natural order, as plain text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the original job's)
# ---------------------------------------------------------------------------
# Pay histogram edges: half-open bins [e_i, e_i+1), the last bin closed.
PAY_EDGES = (0.0, 10000.0, 20000.0, 50000.0, 100000.0, 150000.0, 200000.0, float("inf"))
# Marker meaning "no value" in a payroll cell (exact, case-sensitive).
NULL_MARKER = "Not Provided"
# First cell of a header line; such lines are dropped wherever they occur.
HEADER_FIRST_CELL = "Employee Name"
# A cell is a number when it matches this pattern (whole cell).
NUMBER_PATTERN = r"^[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?$"
# A line with fewer comma pieces than this is a fragment (pairwise stitch rule).
MIN_PIECES = 11
# Suffix added to an agency name for a geocoding request.
GEOCODE_SUFFIX = ", California"
# Colour-scale clamp for mean pay in thousands.
CLIM_LO, CLIM_HI = 0.0, 150.0
# Earth radius of the spherical projection, metres (library default).
SPHERE_RADIUS_M = 6370997.0
# Payroll column names in file order (12 columns; files with 11 lack Status).
PAYROLL_COLUMNS = (
    "employee_name", "job_title", "base_pay", "overtime_pay", "other_pay",
    "benefits", "total_pay", "total_pay_benefits", "year", "notes", "agency",
    "status",
)
# Map windows of the report runs: name, lon_0, lat_0, width m, height m.
CALIFORNIA = ("california", -119.0, 37.20, 1000000.0, 1200000.0)
BAY_AREA = ("bay_area", -122.16, 37.72, 120000.0, 120000.0)
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(18, 2)
MONEY_COLUMNS = ("base_pay", "overtime_pay", "other_pay", "benefits", "total_pay",
                 "total_pay_benefits")
TEXT_COLUMNS = ("employee_name", "job_title", "notes", "agency", "status")

PAYROLL_SCHEMA = T.StructType(
    [T.StructField(c, MONEY if c in MONEY_COLUMNS else
                   (T.IntegerType() if c == "year" else T.StringType()), True)
     for c in PAYROLL_COLUMNS])

LOCATION_SCHEMA = T.StructType([
    T.StructField("agency", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), True),
    T.StructField("lon", T.DoubleType(), True),
    T.StructField("status", T.StringType(), False),        # resolved / not_found
    T.StructField("updated_at", T.TimestampType(), True),
])

RESOLVED, NOT_FOUND, PENDING = "resolved", "not_found", "pending"


@dataclass(frozen=True)
class MapRun:
    """One map of the report: a window, a hex grid size and the years drawn."""
    name: str
    lon_0: float
    lat_0: float
    width: float
    height: float
    gridsize: int
    years: tuple[int, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, window: tuple, gridsize: int, years) -> "MapRun":
        name, lon_0, lat_0, width, height = window
        return cls(name, lon_0, lat_0, width, height, int(gridsize), tuple(int(y) for y in years))


# The eight maps of the original report, as one list for the fused job.
REPORT_RUNS = (
    MapRun.of(CALIFORNIA, 1000, (2011, 2012, 2013, 2014)),
    MapRun.of(BAY_AREA, 1600, (2012, 2013, 2014)),
    MapRun.of(BAY_AREA, 2500, (2011,)),
)
