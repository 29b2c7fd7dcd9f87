"""Planar geometry on array<struct<x,y>> columns, in Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Column


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(line: Column) -> Column:
    """Consecutive pairs (a, b) of a line's points."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def _hypot(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda acc, s: acc + _hypot(s["a"], s["b"]))


def point_at(line: Column, share: Column | float) -> Column:
    """Point at a share of the length; ends where the share is outside 0 to 1; a line without length gives its first point."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    want = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * length(line)
    start = F.struct(F.lit(0.0).alias("at"), F.element_at(line, 1).alias("p"))

    def step(acc: Column, s: Column) -> Column:
        d = _hypot(s["a"], s["b"])
        end = acc["at"] + d
        t = F.when(d > 0, (want - acc["at"]) / d).otherwise(0.0)
        there = point(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * t, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * t)
        return F.struct(end.alias("at"), F.when((acc["at"] <= want) & (want <= end) & (d > 0), there).otherwise(acc["p"]).alias("p"))

    return F.aggregate(segments(line), start, step)["p"]


def nearest_on_segment(p: Column, a: Column, b: Column) -> Column:
    """Nearest point of a segment; along an axis its own coordinate is that of the point, unrounded."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    d2 = dx * dx + dy * dy
    t = F.when(d2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / d2))).otherwise(0.0)
    within = lambda k: F.greatest(F.least(a[k], b[k]), F.least(F.greatest(a[k], b[k]), p[k]))
    return point(F.when(dy == 0, within("x")).otherwise(a["x"] + t * dx), F.when(dx == 0, within("y")).otherwise(a["y"] + t * dy))


def distance_to_line(p: Column, line: Column) -> Column:
    """From a point to the nearest point of a line; to its only point where it has one."""
    to = F.array_min(F.transform(segments(line), lambda s: _hypot(p, nearest_on_segment(p, s["a"], s["b"]))))
    return F.coalesce(to, _hypot(p, F.element_at(line, 1)))


def signed_area(ring: Column) -> Column:
    """Of a closed ring by the shoelace formula; counter-clockwise is positive."""
    return F.aggregate(segments(ring), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2


def contains(ring: Column, p: Column) -> Column:
    """Whether a point is inside a closed ring, by the number of edges that a ray to the right crosses."""
    crosses = lambda s: ((s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"])) & (p["x"] < (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return F.size(F.filter(segments(ring), crosses)) % 2 == 1


def bounds(line: Column) -> Column:
    pick = lambda f, k: f(F.transform(line, lambda p: p[k]))
    return F.struct(pick(F.array_min, "x").alias("x0"), pick(F.array_min, "y").alias("y0"), pick(F.array_max, "x").alias("x1"), pick(F.array_max, "y").alias("y1"))


def cohesion(line: Column) -> Column:
    """Length over four times the bounding diagonal, at most 1: high for walks that fill one place; 1 for those within a metre."""
    b = bounds(line)
    diagonal = F.hypot(b["x1"] - b["x0"], b["y1"] - b["y0"])
    return F.when(diagonal > 1, F.least(F.lit(1.0), length(line) / diagonal / 4)).otherwise(1.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def deviation(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle in degrees between two headings; null for one without length."""
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(size > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size)))))


class Lambert:
    """Lambert conformal conic projection with two standard parallels, on the GRS80 ellipsoid, as Column expressions."""

    A, F_ = 6378137.0, 1 / 298.257222101

    def __init__(self, lat1: float, lat2: float, lat0: float, lon0: float, x0: float, y0: float):
        self.e = math.sqrt(2 * self.F_ - self.F_**2)
        p1, p2, p0, self.l0 = map(math.radians, (lat1, lat2, lat0, lon0))
        m = lambda p: math.cos(p) / math.sqrt(1 - (self.e * math.sin(p)) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - self.e * math.sin(p)) / (1 + self.e * math.sin(p))) ** (self.e / 2)
        self.n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        self.c = self.A * m(p1) / (self.n * t(p1) ** self.n)
        self.r0, self.x0, self.y0 = self.c * t(p0) ** self.n, x0, y0

    def forward(self, lon: Column, lat: Column) -> Column:
        """Degrees to metres."""
        p = F.radians(lat)
        s = F.sin(p) * self.e
        t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(self.e / 2))
        r = F.lit(self.c) * F.pow(t, F.lit(self.n))
        angle = (F.radians(lon) - self.l0) * self.n
        return point(r * F.sin(angle) + self.x0, F.lit(self.r0 + self.y0) - r * F.cos(angle))

    def inverse(self, x: Column, y: Column) -> Column:
        """Metres to degrees; x is the longitude."""
        dx, dy = x - self.x0, F.lit(self.r0 + self.y0) - y
        t = F.pow(F.hypot(dx, dy) / self.c, F.lit(1 / self.n))
        p = F.lit(math.pi / 2) - 2 * F.atan(t)
        for _ in range(6):
            s = F.sin(p) * self.e
            p = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(self.e / 2)))
        return point(F.degrees(F.atan2(dx, dy) / self.n + self.l0), F.degrees(p))


#: The state plane zone that street layers are measured in, in metres.
STATE_PLANE = Lambert(lat1=37.96666666666667, lat2=36.76666666666667, lat0=36.33333333333334, lon0=-78.5, x0=3500000.0, y0=1000000.0)
