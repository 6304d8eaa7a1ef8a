"""Distances, coordinate conversion and tiles as column expressions."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
E7 = 10_000_000.0
# The box of Seoul in degrees.
BOX = (37.4, 37.75, 126.7, 127.3)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between points in 1e-7 degrees, null if either is unknown."""
    a1, a2 = F.radians(lat1 / E7), F.radians(lat2 / E7)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians((lon2 - lon1) / E7) / 2), 2)
    # least and greatest pass over nulls
    h = F.when(h.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def rounded_m(metres: Column) -> Column:
    return F.floor(metres + 0.5).cast("long")


def distance_bucket(metres: Column) -> Column:
    """The upper bound that is shown: a multiple of 250 m, 250 at least; null if unknown."""
    return F.when(metres.isNotNull(), F.greatest(F.lit(250), F.ceil(metres / 250) * 250)).cast("long")


# The transverse Mercator grid EPSG:5174 (Bessel 1841) and its shift to WGS 84.
_A, _F = 6377397.155, 1 / 299.1528128
_LAT0, _LON0, _X0, _Y0 = math.radians(38), math.radians(127.0028902777778), 200000.0, 500000.0
_SHIFT = (-145.907, 505.034, 685.756)
_TURN = tuple(math.radians(s / 3600) for s in (-1.162, 2.347, 1.592))
_SCALE = 1 + 6.342e-6
_WGS_A, _WGS_F = 6378137.0, 1 / 298.257223563


def _arc(lat: float) -> float:
    e2 = _F * (2 - _F)
    return _A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * lat)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * lat)
        - 35 * e2**3 / 3072 * math.sin(6 * lat)
    )


def _let(value: Column, use) -> Column:
    """``use`` of a named value; nested uses of a plain column would copy its whole expression each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grid_to_wgs84(x: Column, y: Column) -> Column:
    """struct(lat, lon) in degrees of grid metres: inverse projection series, seven-parameter shift, geodetic latitude."""
    e2 = _F * (2 - _F)
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = (y - _Y0 + _arc(_LAT0)) / (_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))

    def footpoint(m):
        return (
            m
            + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * m)
            + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * m)
            + 151 * e1**3 / 96 * F.sin(6 * m)
            + 1097 * e1**4 / 512 * F.sin(8 * m)
        )

    def terms(p):
        w = 1 - e2 * F.pow(F.sin(p), 2)
        n = _A / F.sqrt(w)
        return F.struct(p.alias("p"), (ep2 * F.pow(F.cos(p), 2)).alias("c"), F.pow(F.tan(p), 2).alias("t"), n.alias("n"), (_A * (1 - e2) / F.pow(w, 1.5)).alias("r"), ((x - _X0) / n).alias("d"))

    def local(v):
        p, c, t, d = v["p"], v["c"], v["t"], v["d"]
        lat = p - v["n"] * F.tan(p) / v["r"] * (
            F.pow(d, 2) / 2
            - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24
            + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720
        )
        lon = _LON0 + (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(p)
        return F.struct(lat.alias("lat"), lon.alias("lon"), (_A / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))).alias("n"))

    def shifted(v):
        gx, gy, gz = v["n"] * F.cos(v["lat"]) * F.cos(v["lon"]), v["n"] * F.cos(v["lat"]) * F.sin(v["lon"]), v["n"] * (1 - e2) * F.sin(v["lat"])
        rx, ry, rz = _TURN
        wx = _SHIFT[0] + _SCALE * (gx - rz * gy + ry * gz)
        wy = _SHIFT[1] + _SCALE * (rz * gx + gy - rx * gz)
        wz = _SHIFT[2] + _SCALE * (-ry * gx + rx * gy + gz)
        return F.struct(wx.alias("x"), wy.alias("y"), wz.alias("z"))

    w2 = _WGS_F * (2 - _WGS_F)
    b = _WGS_A * (1 - _WGS_F)

    def geodetic(v):
        flat = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        theta = F.atan2(v["z"] * _WGS_A, flat * b)
        lat = F.atan2(v["z"] + w2 / (1 - w2) * b * F.pow(F.sin(theta), 3), flat - w2 * _WGS_A * F.pow(F.cos(theta), 3))
        return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(v["y"], v["x"])).alias("lon"))

    return _let(_let(_let(_let(_let(mu, footpoint), terms), local), shifted), geodetic)


def coordinates(x: Column, y: Column) -> Column:
    """struct(latitude_e7, longitude_e7, crs) of grid coordinates given as text; null if missing, malformed or outside the box."""

    def e7(v):
        inside = v["lat"].between(BOX[0], BOX[1]) & v["lon"].between(BOX[2], BOX[3])
        return F.when(inside, F.struct(F.floor(v["lat"] * E7 + 0.5).cast("int").alias("latitude_e7"), F.floor(v["lon"] * E7 + 0.5).cast("int").alias("longitude_e7"), F.lit("EPSG:4326").alias("crs")))

    return _let(grid_to_wgs84(x.try_cast("double"), y.try_cast("double")), e7)


def _path(row: Column, col: Column, depth: int) -> Column:
    bit = lambda v, k: F.shiftright(v, depth - 1 - k).bitwiseAND(F.lit(1))
    return F.concat_ws(".", F.lit("0"), *((bit(row, k) * 2 + bit(col, k)).cast("string") for k in range(depth)))


def tile_key(lat_e7: Column, lon_e7: Column, depth: int, box: tuple[int, int, int, int]) -> Column:
    """The path of quadrants (0 to 3, joined by dots) of a point in a box (lat0, lat1, lon0, lon1) of 1e-7 degrees."""
    n = 1 << depth
    row = F.least(F.floor((lat_e7 - box[0]) * n / (box[1] - box[0])), F.lit(n - 1)).cast("long")
    col = F.least(F.floor((lon_e7 - box[2]) * n / (box[3] - box[2])), F.lit(n - 1)).cast("long")
    return _path(row, col, depth)


def tile_key_degrees(lat: Column, lon: Column, depth: int, area: tuple[float, float, float, float]) -> Column:
    """As ``tile_key`` for degrees in an area (west, south, east, north); points outside belong to the tiles at its edge."""
    n = 1 << depth

    def at(x: Column, low: float, high: float) -> Column:
        # the width as it is written: 127.3 - 126.7 in doubles is a little less than 0.6
        width = float(Decimal(str(high)) - Decimal(str(low)))
        return F.greatest(F.least(F.floor((x - low) / width * n), F.lit(n - 1)), F.lit(0)).cast("long")

    return _path(at(lat, area[1], area[3]), at(lon, area[0], area[2]), depth)
