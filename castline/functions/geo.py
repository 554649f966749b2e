"""Distances, boxes and tiles as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid, and the sphere for bounding boxes.
A, FLATTENING, SPHERE_KM = 6378137.0, 1 / 298.257223563, 6371.0088


def geo_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Geodesic metres between two points in degrees (Andoyer-Lambert); 0 for the same point."""
    b = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    b1, b2 = b(lat1), b(lat2)
    x = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    s = 2 * F.asin(F.sqrt(F.least(x, F.lit(1.0))))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    big_x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q) / F.cos(s / 2), 2)
    big_y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q) / F.nullif(F.sin(s / 2), F.lit(0.0)), 2)
    return F.when(x == 0, 0.0).otherwise(A * (s - FLATTENING / 2 * (big_x + big_y)))


def in_bbox(west: float, south: float, east: float, north: float, lon: str = "longitude", lat: str = "latitude") -> Column:
    """Inside the box, edges included; a box with west > east crosses the antimeridian and is two."""
    inside = F.col(lon).between(west, east) if west <= east else (F.col(lon).between(west, 180) | F.col(lon).between(-180, east))
    return inside & F.col(lat).between(south, north)


def circle(lat: Column, km: Column) -> tuple[Column, Column, Column]:
    """(south, north, reach) of the box around a circle on the sphere: latitudes, and degrees of longitude either side.

    A circle that holds a pole reaches all the way round, 180 degrees.
    """
    height = F.degrees(km / SPHERE_KM)
    south, north = F.greatest(lat - height, F.lit(-90.0)), F.least(lat + height, F.lit(90.0))
    wide = F.degrees(km / (SPHERE_KM * F.cos(F.radians(F.greatest(F.abs(south), F.abs(north))))))
    pole = (south <= -90 + 1e-9) | (north >= 90 - 1e-9)
    return south, north, F.when(pole, 180.0).otherwise(F.least(wide, F.lit(180.0)))


def circle_boxes(lon: Column, lat: Column, km: Column) -> Column:
    """Array of boxes (west, south, east, north) around a circle: two where it crosses 180 degrees."""
    south, north, reach = circle(lat, km)
    box = lambda west, east: F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))
    low, high, west, east = F.lit(-180.0), F.lit(180.0), lon - reach, lon + reach
    return (
        F.when(reach >= 180, F.array(box(low, high)))
        .when(west < low, F.array(box(west + 360, high), box(low, east)))
        .when(east > high, F.array(box(west, high), box(low, east - 360)))
        .otherwise(F.array(box(west, east)))
    )


def near(lon: Column, lat: Column, km: Column, x: str = "longitude", y: str = "latitude") -> Column:
    """Within a geodesic distance of (lon, lat), behind a box that a scan can use where these are literals.

    The box is a hundredth wider than the sphere's, as a degree of the ellipsoid is up to 0.6 % shorter than one of the sphere.
    """
    south, north, reach = circle(lat, km * 1.01)
    px, py = F.col(x), F.col(y)
    around = (reach >= 180) | px.between(lon - reach, lon + reach) | (px >= lon - reach + 360) | (px <= lon + reach - 360)
    return py.between(south, north) & around & (geo_distance(px, py, lon, lat) <= km * 1000)


def within_km(lon: float, lat: float, km: float) -> Column:
    """Within a geodesic distance of one point."""
    return near(F.lit(float(lon)), F.lit(float(lat)), F.lit(float(km)))


# The envelope of the tiles (west, south, east, north), and the side of a tile.
ENVELOPE, TILE = (20, -60, 120, 30), 10


def tiles_of_boxes(boxes: Column) -> Column:
    """Array of tiles (west, south) that meet any of the boxes; the envelope's outer edges belong to its last tiles."""
    west, south, east, north = ENVELOPE

    def steps(low: Column, high: Column, first: int, last: int) -> Column:
        at = lambda v: F.least(F.greatest(F.floor((v - first) / TILE), F.lit(0)), F.lit((last - first) // TILE - 1))
        return F.transform(F.sequence(at(low), at(high)), lambda k: (k * TILE + first).cast("long"))

    def of(b: Column) -> Column:
        apart = (b["east"] < west) | (b["west"] > east) | (b["north"] < south) | (b["south"] > north)
        columns, rows = steps(b["west"], b["east"], west, east), steps(b["south"], b["north"], south, north)
        cells = F.flatten(F.transform(columns, lambda x: F.transform(rows, lambda y: F.struct(x.alias("west"), y.alias("south")))))
        return F.when(~apart, cells).otherwise(F.array().cast("array<struct<west:bigint,south:bigint>>"))

    return F.array_distinct(F.flatten(F.transform(boxes, of)))


def tile_key(lon: Column, lat: Column) -> Column:
    """South-west corner of the 10-degree tile that owns a point; the outer east and north edges belong to the last tile."""
    west = F.when(lon == 120, 110).otherwise(F.floor((lon - 20) / 10) * 10 + 20)
    south = F.when(lat == 30, 20).otherwise(F.floor((lat + 60) / 10) * 10 - 60)
    return F.concat_ws("_", west.cast("string"), south.cast("string"))


def box_tile_keys(west: float, south: float, east: float, north: float) -> list[str]:
    """``tile_key`` of every point that a box may hold; one with west > east crosses 180 degrees. Empty for a box that is the whole globe."""
    if west <= -180 and east >= 180 and south <= -90 and north >= 90:
        return []
    spans = [(west, east)] if west <= east else [(west, 180), (-180, east)]
    # One tile more below an edge, as the envelope's outer edges belong to its last tiles.
    steps = lambda low, high, first: range(math.ceil((low - first) / TILE) - 1, math.floor((high - first) / TILE) + 1)
    xs = sorted({x * TILE + ENVELOPE[0] for a, b in spans for x in steps(a, b, ENVELOPE[0])})
    return [f"{x}_{y * TILE + ENVELOPE[1]}" for x in xs for y in steps(south, north, ENVELOPE[1])]


def distance_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """The same distance in SQL."""
    f = repr(FLATTENING)
    b1, b2 = (f"atan((1 - {f}) * tan(radians({x})))" for x in (lat1, lat2))
    x = f"(pow(sin(({b2} - {b1}) / 2), 2) + cos({b1}) * cos({b2}) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    s = f"(2 * asin(sqrt(least({x}, 1.0e0))))"
    p, q = f"(({b1} + {b2}) / 2)", f"(({b2} - {b1}) / 2)"
    big_x = f"(({s} - sin({s})) * pow(sin({p}) * cos({q}) / cos({s} / 2), 2))"
    big_y = f"(({s} + sin({s})) * pow(cos({p}) * sin({q}) / nullif(sin({s} / 2), 0), 2))"
    return f"CASE WHEN {x} = 0 THEN 0e0 ELSE 6378137.0e0 * ({s} - {f} / 2 * ({big_x} + {big_y})) END"
