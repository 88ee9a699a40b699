"""Geographic column functions: conic projection, polar features, parsers, hierarchical cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 and the French conformal conic projection (EPSG:2154).
A, INV_F = 6378137.0, 298.257222101
PHI1, PHI2, PHI0, LAM0 = 44.0, 49.0, 46.5, 3.0
X0, Y0 = 700000.0, 6600000.0
CENTER = (2.3499, 48.8530)


def _constants() -> tuple[float, float, float, float]:
    """e, n, c and ys of the projection, from its definition."""
    f = 1 / INV_F
    e = math.sqrt(2 * f - f * f)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2, p0 = (math.radians(x) for x in (PHI1, PHI2, PHI0))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    c = A * m(p1) / (n * t(p1) ** n)
    return e, n, c, Y0 + c * t(p0) ** n


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metric x, y of degrees of longitude and latitude."""
    e, n, c, ys = _constants()
    phi = F.radians(lat)
    s = F.sin(phi) * e
    t = F.tan(F.lit(math.pi / 4) - phi / 2.0) / F.pow((1.0 - s) / (1.0 + s), F.lit(e / 2))
    r = F.pow(t, F.lit(n)) * c
    g = (F.radians(lon) - math.radians(LAM0)) * n
    return r * F.sin(g) + X0, F.lit(ys) - r * F.cos(g)


def polar(x: Column, y: Column, center: tuple[float, float] = CENTER) -> tuple[Column, Column, Column]:
    """Distance from the centre (degrees), sine and cosine of the bearing."""
    cx, cy = lambert93(F.lit(center[0]), F.lit(center[1]))
    dx, dy = x - cx, y - cy
    bearing = F.atan2(dy, dx)
    return F.hypot(dx, dy), F.sin(bearing), F.cos(bearing)


NUMBER = r"[-+]?\d+(?:\.\d+)?"


def parse_point(text: Column) -> tuple[Column, Column]:
    """(lon, lat) of "lat, lon"; null with fewer than two numbers."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    lat, lon = F.get(found, 0).try_cast("double"), F.get(found, 1).try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    return F.when(both, lon), F.when(both, lat)


def wkt_centroid(text: Column) -> tuple[Column, Column]:
    """Mean of all vertices of a WKT geometry; null with fewer than two numbers."""
    nums = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.try_cast("double"))
    pairs = F.floor(F.size(nums) / 2).cast("int")
    each = lambda k: F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.get(nums, i * 2 + k))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / pairs
    return F.when(pairs >= 1, mean(each(0))), F.when(pairs >= 1, mean(each(1)))


#: Edge in metres of a hexagon of each resolution (the mean edges of the usual hexagonal grid of these resolutions).
CELL_METERS = {8: 531.4, 9: 200.8, 10: 75.9}


def cell(x: Column, y: Column, resolution: int) -> Column:
    """Id of the hexagon of the metric plane that holds (x, y): pointy-topped, in axial coordinates, the nearest centre.

    A point on an edge or a corner is as near to several centres: it goes to the smallest (q, r).
    The same neighbourhoods as the usual global hexagonal grid at this resolution, by metres on the map's own projection; ids differ from it."""
    m = CELL_METERS[resolution]
    wide, high = F.lit(m) * F.lit(3.0**0.5), m * 1.5
    square = lambda c: c * c

    def centre(q: Column, r: Column) -> Column:
        away = square(x - wide * (q + r / F.lit(2.0))) + square(y - F.lit(high) * r)
        return F.struct(away.alias("away"), q.cast("long").alias("q"), r.cast("long").alias("r"))

    # rows of centres are 1.5 edges apart and none is further than an edge, so one of three rows holds the nearest; in each, one of the two beside x
    rows = [F.floor(y / F.lit(high) + 0.5) + k for k in (-1, 0, 1)]
    beside = [(F.floor(x / wide - r / F.lit(2.0)) + k, r) for r in rows for k in (0, 1)]
    nearest = F.array_min(F.array(*[centre(q.cast("double"), r.cast("double")) for q, r in beside]))
    return F.concat(F.lit(f"c{resolution}_"), nearest["q"].cast("string"), F.lit("_"), nearest["r"].cast("string"))
