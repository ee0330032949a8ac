"""Plane and spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the standard parallel of the equal-area cylindrical grid.
A, INVERSE_FLATTENING, PARALLEL = 6378137.0, 298.257223563, 30.0
_F = 1 / INVERSE_FLATTENING
E2 = _F * (2 - _F)
E = math.sqrt(E2)
K0 = math.cos(math.radians(PARALLEL)) / math.sqrt(1 - E2 * math.sin(math.radians(PARALLEL)) ** 2)
#: Metres of a degree of latitude where that is near enough.
DEGREE_M = 111320.0


def equal_area_x(lon: Column) -> Column:
    return F.radians(lon) * (A * K0)


def equal_area_y(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    q = (s / (1 - E2 * s * s) - F.log((1 - E * s) / (1 + E * s)) / (2 * E)) * (1 - E2)
    return q * (A / (2 * K0))


def equal_area_lon(x: Column) -> Column:
    return F.degrees(x / (A * K0))


def equal_area_lat(y: Column) -> Column:
    """Inverse by the series on the authalic latitude; good to about 1e-9 degrees."""
    qp = 1 - (1 - E2) / (2 * E) * math.log((1 - E) / (1 + E))
    beta = F.asin(y * (2 * K0 / (A * qp)))
    return F.degrees(
        beta
        + F.sin(2 * beta) * (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040)
        + F.sin(4 * beta) * (23 * E2**2 / 360 + 251 * E2**3 / 3780)
        + F.sin(6 * beta) * (761 * E2**3 / 45360)
    )


def utm_epsg(lon: Column, lat: Column) -> Column:
    return (F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6.0) + 1).cast("int")


# Scale on the central meridian, false easting and false northing of the south, and the coefficients of Krueger's
# series in the third flattening, from the second power of the one to the sixth, as (numerator, denominator) by rising power.
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0
_FORWARD = (
    ((1, 2), (-2, 3), (5, 16), (41, 180), (-127, 288), (7891, 37800)),
    ((13, 48), (-3, 5), (557, 1440), (281, 630), (-1983433, 1935360)),
    ((61, 240), (-103, 140), (15061, 26880), (167603, 181440)),
    ((49561, 161280), (-179, 168), (6601661, 7257600)),
    ((34729, 80640), (-3418889, 1995840)),
    ((212378941, 319334400),),
)
_INVERSE = (
    ((1, 2), (-2, 3), (37, 96), (-1, 360), (-81, 512), (96199, 604800)),
    ((1, 48), (1, 15), (-437, 1440), (46, 105), (-1118711, 3870720)),
    ((17, 480), (-37, 840), (-209, 4480), (5569, 90720)),
    ((4397, 161280), (-11, 504), (-830251, 7257600)),
    ((4583, 161280), (-108847, 3991680)),
    ((20648693, 638668800),),
)
_N = _F / (2 - _F)
#: Radius of the sphere whose meridian is as long as the ellipsoid's.
RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def series(table: tuple) -> list[float]:
    """The series' coefficients for this ellipsoid, from the first on."""
    return [sum(p / q * _N ** (j + k) for k, (p, q) in enumerate(row)) for j, row in enumerate(table, 1)]


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6.0) + 1).cast("int")


def utm_xy(lon: Column, lat: Column, zone: Column, south: Column) -> Column:
    """(x, y) in metres of a place in a UTM zone, by Krueger's series; good to well below a millimetre within some 30 degrees of the zone."""
    l = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * E) * E)
    xi, eta = F.atan2(t, F.cos(l)), F.asinh(F.sin(l) / F.sqrt(t * t + F.cos(l) * F.cos(l)))
    x, y = eta, xi
    for j, c in enumerate(series(_FORWARD), 1):
        x = x + F.cos(2 * j * xi) * F.sinh(2 * j * eta) * c
        y = y + F.sin(2 * j * xi) * F.cosh(2 * j * eta) * c
    k = UTM_SCALE * RECTIFYING
    return F.struct((x * k + UTM_EAST).alias("x"), (y * k + F.when(south, UTM_SOUTH).otherwise(0.0)).alias("y"))


def utm_lonlat(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """(lon, lat) of a place in a UTM zone; the inverse of utm_xy."""
    k = UTM_SCALE * RECTIFYING
    eta, xi = (x - UTM_EAST) / k, (y - F.when(south, UTM_SOUTH).otherwise(0.0)) / k
    h, v = eta, xi
    for j, c in enumerate(series(_INVERSE), 1):
        h = h - F.cos(2 * j * xi) * F.sinh(2 * j * eta) * c
        v = v - F.sin(2 * j * xi) * F.cosh(2 * j * eta) * c
    conformal = F.sin(v) / F.sqrt(F.sinh(h) * F.sinh(h) + F.cos(v) * F.cos(v))

    def nearer(t: Column, goal: Column) -> Column:
        """One step of Newton's way from the tangent of the conformal latitude to that of the geodetic one."""
        root = F.sqrt(t * t + 1)
        s = F.sinh(F.atanh(t / root * E) * E)
        now = t * F.sqrt(s * s + 1) - s * root
        return t + (goal - now) / F.sqrt(now * now + 1) * (t * t * (1 - E2) + 1) / (root * (1 - E2))

    start = F.struct(conformal.alias("t"), conformal.alias("goal"))
    tangent = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, lambda a, _: F.struct(nearer(a["t"], a["goal"]).alias("t"), a["goal"].alias("goal")), lambda a: a["t"])
    return F.struct((F.degrees(F.atan2(F.sinh(h), F.cos(v))) + (zone * 6 - 183)).alias("lon"), F.degrees(F.atan(tangent)).alias("lat"))


def utm_bounds(xmin: Column, ymin: Column, xmax: Column, ymax: Column, zone: Column, south: Column, points: int = 21) -> Column:
    """(xmin, ymin, xmax, ymax) in degrees of a box in a UTM zone: the extent of so many points on each of its sides."""
    t = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / float(points - 1))
    at = lambda a, b: F.transform(t, lambda s: a + (b - a) * s)
    side = lambda xs, ys: F.zip_with(xs, ys, lambda x, y: utm_lonlat(x, y, zone, south))
    flat = lambda c: F.transform(t, lambda _: c)
    rim = F.concat(side(at(xmin, xmax), flat(ymin)), side(at(xmin, xmax), flat(ymax)), side(flat(xmin), at(ymin, ymax)), side(flat(xmax), at(ymin, ymax)))
    edge = lambda f, c: f(F.transform(rim, lambda p: p[c]))
    return F.struct(edge(F.array_min, "lon").alias("xmin"), edge(F.array_min, "lat").alias("ymin"), edge(F.array_max, "lon").alias("xmax"), edge(F.array_max, "lat").alias("ymax"))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """From a point to a segment; a segment of one point is that point."""
    dx, dy = x1 - x0, y1 - y0
    span = dx * dx + dy * dy
    t = F.when(span == 0, 0.0).otherwise(((x - x0) * dx + (y - y0) * dy) / span)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(x, y, x0 + t * dx, y0 + t * dy)


def box_overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Area shared by two boxes (xmin, ymin, xmax, ymax)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def _pairs(ring: Column) -> Column:
    return F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring of (x, y); 0 for fewer than four points."""
    cross = F.aggregate(_pairs(ring), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])
    return F.when(F.size(ring) >= 4, F.abs(cross) / 2).otherwise(0.0)


def ring_centroid(ring: Column) -> Column:
    """(x, y) of a closed ring, weighted by area; null where there is none."""
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, p: Column) -> Column:
        c = p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
        return F.struct((s["c"] + c).alias("c"), (s["x"] + (p["a"]["x"] + p["b"]["x"]) * c).alias("x"), (s["y"] + (p["a"]["y"] + p["b"]["y"]) * c).alias("y"))

    def end(s: Column) -> Column:
        return F.when(s["c"] != 0, F.struct((s["x"] / (3 * s["c"])).alias("x"), (s["y"] / (3 * s["c"])).alias("y")))

    return F.when(F.size(ring) >= 4, F.aggregate(_pairs(ring), zero, add, end))


def line_length(line: Column) -> Column:
    return F.when(F.size(line) >= 2, F.aggregate(_pairs(line), F.lit(0.0), lambda s, p: s + distance(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))).otherwise(0.0)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: a ray to the right crosses the ring an odd number of times."""
    n = F.aggregate(
        _pairs(ring),
        F.lit(0),
        lambda s, p: s + F.when(((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]) / F.nullif(p["b"]["y"] - p["a"]["y"], F.lit(0.0)) + p["a"]["x"]), 1).otherwise(0),
    )
    return (n % 2) == 1


def densify(x0: Column, y0: Column, x1: Column, y1: Column, step: float) -> Column:
    """Points along a segment, ends included, at even spacing of at most step."""
    n = F.greatest(F.ceil(distance(x0, y0, x1, y1) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((x0 + (x1 - x0) * i / n).alias("x"), (y0 + (y1 - y0) * i / n).alias("y")))


def bearing_bin(dx: Column, dy: Column, width: float = 30.0) -> Column:
    """Direction without sense, folded into half a turn, in bins of width degrees."""
    return F.floor(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)) / width).cast("int")
