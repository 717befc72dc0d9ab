"""Geography as built-in expressions: 52-bit geohashes, great-circle distances and boxes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere's radius in metres, the projection's latitude limit, units in metres, base 32 digits.
RADIUS = 6372797.560856
MAX_LAT = 85.05112878
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
STEP = 26

def _spread_byte(b: int) -> int:
    """The bits of a byte at every other place."""
    return sum((b >> i & 1) << 2 * i for i in range(8))


def _gather_byte(b: int) -> int:
    """The bits at the even places of a byte, together."""
    return sum((b >> 2 * i & 1) << i for i in range(4))


def _look(table, index: Column) -> Column:
    """An entry of a table of 256 numbers made from a rule; the table folds into one constant."""
    return F.element_at(F.expr("array(" + ",".join(f"{table(b)}L" for b in range(256)) + ")"), index.cast("int") + 1)


def _spread(x: Column) -> Column:
    """A number of 26 bits with its bits at every other place, a byte at a time."""
    parts = [F.shiftleft(_look(_spread_byte, F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))), 16 * i) for i in range(4)]
    return reduce(Column.bitwiseOR, parts)


def _gather(x: Column) -> Column:
    """The bits at the even places of a number of 52 bits."""
    parts = [F.shiftleft(_look(_gather_byte, F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))), 4 * i) for i in range(7)]
    return reduce(Column.bitwiseOR, parts)


def valid(lon: Column, lat: Column) -> Column:
    return lon.between(-180.0, 180.0) & lat.between(-MAX_LAT, MAX_LAT)


def _cell(x: Column, low: float, high: float) -> Column:
    at = F.floor((x - low) / (high - low) * float(1 << STEP)).cast("long")
    return F.least(F.greatest(at, F.lit(0)), F.lit((1 << STEP) - 1))


def encode(lon: Column, lat: Column, max_lat: float = MAX_LAT) -> Column:
    """The 52-bit interleaved cell number: longitude in the odd places, latitude in the even ones."""
    return F.shiftleft(_spread(_cell(lon, -180.0, 180.0)), 1).bitwiseOR(_spread(_cell(lat, -max_lat, max_lat)))


def decode(cell: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of a cell's centre."""
    lon, lat = _gather(F.shiftright(cell, 1)), _gather(cell)
    size = float(1 << STEP)
    return (lon + 0.5) / size * 360.0 - 180.0, (lat + 0.5) / size * (2 * MAX_LAT) - MAX_LAT


def base32(lon: Column, lat: Column) -> Column:
    """The 11-digit standard geohash, of latitudes up to 90; the last digit is 0 as 52 bits hold ten."""
    digit = lambda i: F.substring(F.lit(DIGITS), (F.call_function("shiftright", cell, 47 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    cell = encode(lon, lat, 90.0)
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), digit), ""), F.lit("0"))


def distance(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres (haversine)."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    lon1, lat1, lon2, lat2 = map(as_col, (lon1, lat1, lon2, lat2))
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    part = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    metres = 2.0 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), part)))
    return F.when((lon1 + lat1 + lon2 + lat2).isNotNull(), metres)  # least() passes over NULL


def in_box(lon: Column, lat: Column, lon0: float, lat0: float, width: float, height: float) -> Column:
    """Whether a point is within a box of metres around a centre, measured along its own latitude."""
    return (distance(lon0, lat, lon, lat) <= width / 2) & (distance(lon, lat0, lon, lat) <= height / 2)


def bounds(lon0: float, lat0: float, metres: float) -> tuple[float, float, float, float]:
    """(min lon, min lat, max lon, max lat) that surely hold a circle; a wide or polar one spans all longitudes."""
    dlat = math.degrees(metres / RADIUS) * 1.000001
    low, high = lat0 - dlat, lat0 + dlat
    if low <= -90 or high >= 90:
        return -180.0, max(low, -90.0), 180.0, min(high, 90.0)
    # the circle's widest longitude is where its tangent meridian touches it
    ratio = math.sin(min(metres / RADIUS, math.pi / 2)) / math.cos(math.radians(lat0))
    if ratio >= 1:
        return -180.0, low, 180.0, high
    dlon = math.degrees(math.asin(ratio)) * 1.000001
    if lon0 - dlon < -180 or lon0 + dlon > 180:
        return -180.0, low, 180.0, high
    return lon0 - dlon, low, lon0 + dlon, high
