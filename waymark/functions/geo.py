"""Geometry as column expressions. x is longitude or easting, y latitude or northing; wgs84 distances are metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, METRES_PER_DEGREE = 6_371_000.0, 111_320.0


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def distance(x1: Column, y1: Column, x2: Column, y2: Column, crs: str = "wgs84") -> Column:
    return {"wgs84": haversine, "metric": euclid}[crs](x1, y1, x2, y2)


def equirectangular(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot((x2 - x1) * 111000.0 * F.cos(F.radians((y1 + y2) / 2)), (y2 - y1) * 111000.0)


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    dx, a, b = F.radians(x2 - x1), F.radians(y1), F.radians(y2)
    return F.pmod(F.degrees(F.atan2(F.sin(dx) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dx))), F.lit(360.0))


def between(b1: Column, b2: Column) -> Column:
    """Angle between two bearings, 0 to 180."""
    d = F.pmod(F.abs(b1 - b2), F.lit(360.0))
    return F.least(d, 360.0 - d)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres from a point to a segment, in a plane local to the point."""
    kx, ky = METRES_PER_DEGREE * F.cos(F.radians(y)), F.lit(METRES_PER_DEGREE)
    ax, ay, bx, by = (x1 - x) * kx, (y1 - y) * ky, (x2 - x) * kx, (y2 - y) * ky
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length)))
    return F.hypot(ax + t * dx, ay + t * dy)


def offset(x: Column, y: Column, heading: Column, metres: Column | float) -> tuple[Column, Column]:
    """The point so many metres from (x, y) in the direction of a bearing."""
    north, east = F.cos(F.radians(heading)) * metres, F.sin(F.radians(heading)) * metres
    return x + east / (METRES_PER_DEGREE * F.cos(F.radians(y))), y + north / METRES_PER_DEGREE


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over an array of (x, y) structs; the last point is joined to the first."""
    ends = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(inside: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        hit = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax)
        return F.when(F.coalesce(hit, F.lit(False)), ~inside).otherwise(inside)

    return F.aggregate(ends, F.lit(False), crosses)


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def grid_row(lat: Column, metres: Column | float) -> Column:
    """Row of a grid whose rows are as high as some metres: points so near each other lie in the same or in neighbouring rows."""
    return F.floor(lat / (metres / (math.radians(1.0) * EARTH_M) * 1.000001)).cast("long")


def grid_columns(row: Column, metres: Column | float) -> Column:
    """Into how many columns a row of that grid is cut, all around: as many as leave any two points of this or a neighbouring row that are
    so near each other in the same or in neighbouring columns; the nearer to a pole, the fewer, and one at last."""
    degrees = metres / (math.radians(1.0) * EARTH_M) * 1.000001
    farthest = F.least(F.greatest(F.abs(row - 1), F.abs(row + 2)) * degrees, F.lit(90.0))
    ratio = F.sin(F.least(F.lit(math.pi / 2), metres / F.lit(2 * EARTH_M))) / F.greatest(F.cos(F.radians(farthest)), F.lit(1e-12))
    wide = F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) * 1.000001
    return F.greatest(F.lit(1).cast("long"), F.floor(360.0 / wide).cast("long"))


def grid_column(lng: Column, columns: Column) -> Column:
    """Column of a longitude, 180 degrees west being the first column's edge."""
    return F.least(F.floor(F.pmod(lng + 180.0, F.lit(360.0)) / 360.0 * columns).cast("long"), columns - 1)


def tile(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """XYZ tile of a point."""
    n = float(1 << zoom)
    r = F.radians(y)
    return F.floor((x + 180.0) / 360.0 * n).cast("long"), F.floor((1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n).cast("long")


def tobler(slope: Column) -> Column:
    """Speed on a slope as a part of that on the flat."""
    return F.exp(-3.5 * F.abs(slope + 0.05)) / math.exp(-0.175)


def mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Web-Mercator metres of degrees."""
    return F.radians(x) * 6378137.0, F.ln(F.tan(math.pi / 4 + F.radians(y) / 2)) * 6378137.0


def from_mercator(east: Column, north: Column) -> tuple[Column, Column]:
    return F.degrees(east / 6378137.0), F.degrees(2 * F.atan(F.exp(north / 6378137.0)) - math.pi / 2)


# The ellipsoid, and the constants of Lambert-93.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
LAMBERT = {"n": 0.7256077650532670, "c": 11754255.4261, "x": 700000.0, "y": 12655612.0499, "lng": 3.0}
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = 0.9996 * SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_OUT = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LAT = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _total(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def lambert93(x: Column, y: Column) -> tuple[Column, Column]:
    """Easting and northing of degrees in EPSG 2154."""
    k, s = LAMBERT, F.sin(F.radians(y)) * ECC
    iso = F.ln(F.tan(math.pi / 4 + F.radians(y) / 2) * F.pow((1 - s) / (1 + s), F.lit(ECC / 2)))
    r, g = k["c"] * F.exp(-k["n"] * iso), k["n"] * F.radians(x - k["lng"])
    return k["x"] + r * F.sin(g), k["y"] - r * F.cos(g)


def from_lambert93(east: Column, north: Column) -> tuple[Column, Column]:
    """Degrees of EPSG 2154; the latitude is found in six steps, each some 300 times nearer."""
    k = LAMBERT
    dx, dy = east - k["x"], k["y"] - north
    iso = F.ln(F.hypot(dx, dy) / k["c"]) / -k["n"]
    start = F.struct((2 * F.atan(F.exp(iso)) - math.pi / 2).alias("lat"), F.exp(iso).alias("e"))

    def step(a: Column, _: Column) -> Column:
        s = F.sin(a["lat"]) * ECC
        return F.struct((2 * F.atan(F.pow((1 + s) / (1 - s), F.lit(ECC / 2)) * a["e"]) - math.pi / 2).alias("lat"), a["e"].alias("e"))

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda a: a["lat"])
    return k["lng"] + F.degrees(F.atan2(dx, dy) / k["n"]), F.degrees(lat)


def utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing of degrees in a UTM zone."""
    k, s, l = 2 * math.sqrt(_N) / (1 + _N), F.sin(F.radians(y)), F.radians(x - (zone * 6 - 183))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(l)), F.atanh(F.sin(l) / F.sqrt(1 + t * t))
    east = eta + _total([a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_OUT, 1)])
    north = xi + _total([a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_OUT, 1)])
    return 500000.0 + _RADIUS * east, (1e7 if south else 0.0) + _RADIUS * north


def from_utm(east: Column, north: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Degrees of a UTM zone."""
    xi, eta = (north - (1e7 if south else 0.0)) / _RADIUS, (east - 500000.0) / _RADIUS
    a = xi - _total([b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BACK, 1)])
    b = eta - _total([b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BACK, 1)])
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi + _total([d * F.sin(2 * j * chi) for j, d in enumerate(_LAT, 1)])
    return (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


def to_degrees(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Degrees of projected places in EPSG 2154, 3857, 326xx or 327xx; places that are degrees already (4326, or neither part beyond
    1000) stay; other systems give null."""
    if epsg == 4326:
        return x, y
    if epsg == 2154:
        lng, lat = from_lambert93(x, y)
    elif epsg == 3857:
        lng, lat = from_mercator(x, y)
    elif 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        lng, lat = from_utm(x, y, epsg % 100, epsg > 32700)
    else:
        lng, lat = F.lit(None).cast("double"), F.lit(None).cast("double")
    projected = (F.abs(x) > 1000) | (F.abs(y) > 1000)
    return F.when(projected, lng).otherwise(x), F.when(projected, lat).otherwise(y)


def affine(x: Column, y: Column, east: tuple[float, float, float], north: tuple[float, float, float]) -> tuple[Column, Column]:
    """A pixel's place: each part is a * x + b * y + c."""
    return x * east[0] + y * east[1] + east[2], x * north[0] + y * north[1] + north[2]


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value (0 to 1) of a colour of 0 to 255."""
    hi = F.greatest(r, g, b)
    span = hi - F.least(r, g, b)
    some = F.when(span > 0, span)
    hue = F.when(span == 0, F.lit(0.0)).when(hi == r, F.pmod(60 * (g - b) / some, F.lit(360.0))).when(hi == g, 60 * (b - r) / some + 120).otherwise(60 * (r - g) / some + 240)
    return hue, F.coalesce(span / F.when(hi > 0, hi), F.lit(0.0)), hi / 255


# The same in DuckDB's SQL, for the oracles.
def hav_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    a = f"(power(sin(radians(({y2}) - ({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * power(sin(radians(({x2}) - ({x1})) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * asin(CASE WHEN {a} > 1 THEN 1 ELSE sqrt({a}) END))"


def bearing_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    d = f"degrees(atan2(sin(radians(({x2}) - ({x1}))) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians(({x2}) - ({x1})))))"
    return f"(({d} + 360) % 360)"


def between_sql(a: str, b: str) -> str:
    return f"least(abs(({a}) - ({b})) % 360, 360 - abs(({a}) - ({b})) % 360)"
