"""Fixed values of the physical model.

Everything here is a published constant, a format string or a lookup cell that has to be
equal for results to agree with other implementations of the same model.
"""

import math

# --- fixed values: Earth, Moon, epoch -------------------------------------------------
PI = math.pi
DEG = math.pi / 180.0
MU_EARTH = 398600.4418  # km^3/s^2
MU_MOON = 4902.800066  # km^3/s^2
R_EARTH = 6378.137  # km
R_MOON = 1737.4  # km
J2 = 1.08262668e-3
DEFAULT_EPOCH_JD = 2461253.916666667  # 2026-08-01 10:00:00 UTC
SECONDS_PER_DAY = 86400.0

# --- fixed values: lunar ephemeris (Meeus, Astronomical Algorithms, ch. 47) -----------
# mean angles in degrees: name -> (constant, rate per Julian century)
MOON_ANGLES = {
    "lp": (218.3164477, 481267.88123421),
    "d": (297.8501921, 445267.1114034),
    "m": (357.5291092, 35999.0502909),
    "mp": (134.9633964, 477198.8675055),
    "f": (93.2720950, 483202.0175233),
}
# periodic terms: (coefficient, multiples of D, M, M', F)
MOON_LONGITUDE_SIN = [
    (6.288774, 0, 0, 1, 0),
    (1.274027, 2, 0, -1, 0),
    (0.658314, 2, 0, 0, 0),
    (0.213618, 0, 0, 2, 0),
    (-0.185116, 0, 1, 0, 0),
    (-0.114332, 0, 0, 0, 2),
    (0.058793, 2, 0, -2, 0),
    (0.057066, 2, -1, -1, 0),
    (0.053322, 2, 0, 1, 0),
    (0.045758, 2, -1, 0, 0),
]
MOON_LATITUDE_SIN = [
    (5.128122, 0, 0, 0, 1),
    (0.280602, 0, 0, 1, 1),
    (0.277693, 0, 0, 1, -1),
    (0.173237, 2, 0, 0, -1),
    (0.055413, 2, 0, -1, 1),
    (0.046271, 2, 0, -1, -1),
]
MOON_DISTANCE_KM = 385000.56
MOON_DISTANCE_COS = [
    (-20905.355, 0, 0, 1, 0),
    (-3699.111, 2, 0, -1, 0),
    (-2955.968, 2, 0, 0, 0),
    (-569.925, 0, 0, 2, 0),
    (48.888, 0, 1, 0, 0),
    (-3.149, 0, 0, 0, 2),
    (246.158, 2, 0, -2, 0),
    (-152.138, 2, -1, -1, 0),
    (-170.733, 2, 0, 1, 0),
    (-204.586, 2, -1, 0, 0),
]
OBLIQUITY_DEG = (23.439291, -0.0130042)

# --- fixed values: Earth's rotation and shape (IAU 1976/1980/1982, WGS84; nutation as in Meeus, ch. 22) ---
J2000_JD = 2451545.0
SIDEREAL_SECONDS = (67310.54841, 876600.0 * 3600.0 + 8640184.812866, 0.093104, -6.2e-6)
PRECESSION_ARCSEC = {
    "zeta": (2306.2181, 0.30188, 0.017998),
    "theta": (2004.3109, -0.42665, -0.041833),
    "z": (2306.2181, 1.09468, 0.018203),
}
#: Node of the Moon, mean longitudes of the Sun and the Moon: degrees at J2000 and per century.
NUTATION_ANGLES_DEG = ((125.04452, -1934.136261), (280.4665, 36000.7698), (218.3165, 481267.8813))
#: Multiples of these angles, arc seconds in longitude (sine) and in obliquity (cosine).
NUTATION_ARCSEC = (
    ((1, 0, 0), -17.20, 9.20),
    ((0, 2, 0), -1.32, 0.57),
    ((0, 0, 2), -0.23, 0.10),
    ((2, 0, 0), 0.21, -0.09),
)
WGS84_A_KM = 6378.137
WGS84_FLATTENING = 1.0 / 298.257223563
WGS84_E2 = WGS84_FLATTENING * (2.0 - WGS84_FLATTENING)

# --- fixed values: element sets (SGP4 with WGS72, Spacetrack Report 3 as revised in 2006) ---
SGP4_MU = 398600.8
SGP4_RE_KM = 6378.135
SGP4_J2, SGP4_J3, SGP4_J4 = 0.001082616, -0.00000253881, -0.00000165597
DEEP_SPACE_MIN = 225.0

# --- fixed values: catalogue ----------------------------------------------------------
OBJECT_TYPES = ["PAYLOAD", "DEBRIS", "ROCKET BODY", "UNKNOWN"]
RCS_CLASSES = ["SMALL", "MEDIUM", "LARGE", "NONE"]
FRAGMENT_CATEGORY = "FRAGMENTS"
SIZE_BY_RCS_M = {"SMALL": 0.2, "LARGE": 4.0}
SIZE_DEFAULT_M = 0.8
FRAGMENT_ID_BASE = 10_000_000
CATALOG_MIN_FIELDS = 17
EPOCH_MARKER = "epoch commun) :"
REGIMES_KM = {"LEO": (0.0, 2000.0), "MEO": (2000.0, 35000.0), "GEO": (35000.0, 36500.0)}
GP_WINDOW_DAYS = 21
GP_BATCH_SIZE = 300

# typical mass in kg by radar class (rows) and object type (columns, order of OBJECT_TYPES)
MASS_TABLE_KG = {
    "SMALL": [5.0, 0.5, 50.0, 1.0],
    "MEDIUM": [50.0, 5.0, 300.0, 10.0],
    "LARGE": [500.0, 50.0, 2000.0, 100.0],
    "NONE": [100.0, 5.0, 500.0, 10.0],
}
AREA_BY_RCS_M2 = {"SMALL": 0.05, "MEDIUM": 0.5, "LARGE": 5.0, "NONE": 0.5}
FALLBACK_MASS_KG = 100.0

# --- fixed values: screening ----------------------------------------------------------
GRAVITY_GRADIENT = 2e-6  # s^-2
GATE_SLACK_KM = 1e-3
MIN_CELL_KM = 1.0
KEY_OFFSET = 1 << 20  # cell coordinates are packed as 3 x 21 bits
KEY_BITS = 21
GOLDEN = 0.6180339887498949
GOLDEN_ITERATIONS = 60
EDGE_MARGIN = 1e-9
MISS_BINS_KM = [0.1, 1.0, 2.0, 5.0]

# --- fixed values: NASA Standard Breakup Model ----------------------------------------
CATASTROPHIC_J_PER_G = 40.0
SBM_EXPONENT = 1.71
SBM_COEFFICIENT = 0.1
SBM_MASS_POWER = 0.75
DEFAULT_LC_M = 0.10
AREA_COEFFICIENT = 0.540424
PROJECTILE_DENSITY_KG_M3 = 300.0
# --- fixed values: transformed rejection for Poisson counts (Hoermann 1993, PTRS) ---
POISSON_B = (0.931, 2.53)
POISSON_A = (-0.059, 0.02483)
POISSON_ALPHA = (1.1239, 1.1328, 3.4)
POISSON_SQUEEZE = (0.9277, 3.6224, 2.0)
# --- fixed values: NASA Standard Breakup Model, continued ---
# piecewise linear parameters over log10(size): (x0, y0, x1, y1)
AM_ALPHA = (-1.95, 0.0, 0.55, 1.0)
AM_MU1 = (-1.1, -0.6, 0.0, -0.95)
AM_SIGMA1 = (-1.3, 0.1, -0.3, 0.3)
AM_MU2 = (-0.7, -1.2, -0.1, -2.0)
AM_SIGMA2 = (-0.5, 0.5, -0.3, 0.3)
AM_SMALL_MU = (-1.75, -0.3, -1.25, -1.0)
AM_SMALL_SIGMA = (-3.5, 0.2, 0.1333)  # knee, value below the knee, slope above it
AM_LARGE_FROM_M = 0.11
AM_SMALL_TO_M = 0.08
DV_SLOPE, DV_OFFSET, DV_SIGMA = 0.9, 2.9, 0.4

# --- fixed values: event feeds --------------------------------------------------------
EVENT_LIFETIME_S = 4.0
BURST_LIFETIME_S = 6.0
RECENT_EVENTS = 200
NEAREST_CELLS = 300
EMA_KEEP = 0.9
