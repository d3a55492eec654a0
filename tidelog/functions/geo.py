"""Column functions on WGS84 places, in degrees; radii are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float) -> Column:
    dlat, dlon = F.radians(lat_b - lat_a), F.radians(lon_b - lon_a)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * radius) * F.asin(F.when(a.isNotNull(), F.least(F.lit(1.0), F.sqrt(a))))


def bearing(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Initial bearing in [0, 360)."""
    dlon = F.radians(lon_b - lon_a)
    y = F.sin(dlon) * F.cos(F.radians(lat_b))
    x = F.cos(F.radians(lat_a)) * F.sin(F.radians(lat_b)) - F.sin(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """Least angle between two courses, 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def side(a: tuple[float, float], b: tuple[float, float], inside: tuple[float, float], lon: Column, lat: Column) -> Column:
    """Signed side of the line a-b, positive where `inside` lies; places are (lon, lat)."""
    flip = 1.0 if (b[0] - a[0]) * (inside[1] - a[1]) - (b[1] - a[1]) * (inside[0] - a[0]) >= 0 else -1.0
    return F.lit(flip) * cross(*(F.lit(x) for x in (*a, *b)), lon, lat)


def crossing(x1: Column, y1: Column, x2: Column, y2: Column, a: tuple[float, float], b: tuple[float, float], tolerance: float = 1e-8) -> Column:
    """Where the segment (x1, y1)-(x2, y2) meets a-b, as struct<x, y>; NULL if it doesn't or is parallel."""
    dx, dy, ex, ey = x2 - x1, y2 - y1, F.lit(b[0] - a[0]), F.lit(b[1] - a[1])
    den = dx * ey - dy * ex
    t = F.try_divide((F.lit(a[0]) - x1) * ey - (F.lit(a[1]) - y1) * ex, den)
    x, y = x1 + t * dx, y1 + t * dy

    def between(v: Column, p: Column, q: Column) -> Column:
        return (v >= F.least(p, q) - tolerance) & (v <= F.greatest(p, q) + tolerance)

    meets = between(x, x1, x2) & between(y, y1, y2) & between(x, F.lit(a[0]), F.lit(b[0])) & between(y, F.lit(a[1]), F.lit(b[1]))
    return F.when((F.abs(den) >= 1e-14) & meets, F.struct(x.alias("x"), y.alias("y")))


def inside_polygon(lon: Column, lat: Column, corners: list[tuple[float, float]]) -> Column:
    """Ray casting over literal corners; a place on the border isn't promised to be inside."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 != y2:
            over = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1)))
            crossings = crossings + over.cast("int")
    return crossings % 2 == 1


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def centre(i: Column, size: float) -> Column:
    return (i + 0.5) * size


def local_km(lat: Column, lon: Column, lat0: float, lon0: float, km_per_degree: float = 111.32) -> tuple[Column, Column]:
    """East and north offsets in km about a fixed place."""
    return (lon - lon0) * km_per_degree * F.cos(F.radians(F.lit(lat0))), (lat - lat0) * km_per_degree


def sector(course: Column) -> Column:
    """Bounds of the approach sectors."""
    return F.when(course < 60, "NNE").when(course < 120, "E").when(course < 200, "SSE").otherwise("OTHER")
