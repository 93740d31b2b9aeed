"""Map projections in closed form, as Columns: UTM (Krueger series, WGS84), Web Mercator, great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 and UTM.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING, EARTH_RADIUS = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0, 6371008.8
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
#: The series' coefficients in powers of N.
FORWARD = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BACKWARD = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """struct(x, y) in metres; northings of the southern hemisphere have the false northing."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(FORWARD, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.struct((FALSE_EASTING + SCALE * RECTIFYING * x).alias("x"), (F.when(lat < 0, FALSE_NORTHING).otherwise(0.0) + SCALE * RECTIFYING * y).alias("y"))


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """struct(lon, lat) in degrees."""
    xi = (y - F.when(south, FALSE_NORTHING).otherwise(0.0)) / (SCALE * RECTIFYING)
    eta = (x - FALSE_EASTING) / (SCALE * RECTIFYING)
    u, v = xi, eta
    for k, b in enumerate(BACKWARD, 1):
        u = u - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        v = v - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    conformal = F.sin(u) / F.cosh(v)
    target = F.atanh(conformal)
    sine = conformal
    for _ in range(6):  # fixed-point steps for the isometric latitude; each gains two digits or more
        sine = F.tanh(target + e * F.atanh(e * sine))
    return F.struct((F.degrees(F.atan2(F.sinh(v), F.cos(u))) + zone * 6 - 183).alias("lon"), F.degrees(F.asin(sine)).alias("lat"))


def web_mercator(lon: Column, lat: Column) -> Column:
    return F.struct((F.radians(lon) * SEMI_MAJOR).alias("x"), (F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * SEMI_MAJOR).alias("y"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(a))


#: The widest and highest box, in kilometres, for which one UTM zone is taken as plane enough.
UTM_WIDTH_KM, UTM_HEIGHT_KM = 750.0, 2000.0


def is_utm_reasonable(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a box in degrees is narrow and low enough for one UTM zone."""
    middle = (ymin + ymax) / 2
    wide, high = haversine(xmin, middle, xmax, middle), haversine(xmin, ymin, xmin, ymax)
    return (wide <= UTM_WIDTH_KM * 1000) & (high <= UTM_HEIGHT_KM * 1000)


def authalic_latitude(lat: Column) -> Column:
    """Latitude (radians) on the sphere of the ellipsoid's area at which zones have the ellipsoid's areas."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + F.atanh(e * s) / e)
    pole = (1 - e2) * (1 / (1 - e2) + math.atanh(e) / e)
    return F.asin(F.least(F.greatest(q(F.sin(F.radians(lat))) / pole, F.lit(-1.0)), F.lit(1.0)))


def authalic_radius() -> float:
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    return SEMI_MAJOR * math.sqrt((1 + (1 - e2) / e * math.atanh(e)) / 2)


def geodesic_area(ring: Column) -> Column:
    """Area in m2 of a closed ring of degrees: spherical excess, edge by edge, on the sphere of equal area."""

    def part(s: Column) -> Column:
        a, b = authalic_latitude(s["a"]["y"]), authalic_latitude(s["b"]["y"])
        turn = F.radians(s["b"]["x"] - s["a"]["x"])
        return 2 * F.atan2(F.tan(turn / 2) * (F.tan(a / 2) + F.tan(b / 2)), 1 + F.tan(a / 2) * F.tan(b / 2))

    n = F.size(ring)
    sides = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.abs(F.aggregate(F.transform(sides, part), F.lit(0.0), lambda acc, v: acc + v)) * authalic_radius() ** 2
