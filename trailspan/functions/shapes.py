"""Shapes from points and lines: hulls, thinning, centres, shares of a line beside another, and GeoJSON out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspan.functions.geometry import contains, distance_to_line, length, point_at, segments

POINTS = "array<struct<x:double,y:double>>"


def _ring(points: np.ndarray) -> np.ndarray:
    """Closed counter-clockwise hull by the monotone chain; one or two points are a ring without area."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return np.concatenate([p, p[:1]]) if len(p) else p

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for c in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    ring = np.array(chain(p) + chain(p[::-1]))
    return np.concatenate([ring, ring[:1]])


def hulls(frame: DataFrame, group: str, cell: float = 10.0) -> DataFrame:
    """(group, n, hull): convex hull of each group's points (x, y) as a closed ring; null where a group has no whole point.

    Only the outermost points of each row and column of a grid can be corners,
    so aggregates with map-side combine thin a group before any ring is made.
    """
    whole = frame.where("x IS NOT NULL AND y IS NOT NULL").select(group, "x", "y")
    p = F.struct("x", "y")
    ends = lambda k, o: whole.groupBy(group, F.floor(F.col(k) / cell)).agg(F.min(F.struct(F.col(o).alias("o"), p.alias("p"))).alias("a"), F.max(F.struct(F.col(o).alias("o"), p.alias("p"))).alias("b")).select(group, F.explode(F.array("a.p", "b.p")).alias("p"))

    rims = [ends("x", "y"), ends("y", "x")]
    # within one row of cells the extreme points along it are corners as well
    for k, o in (("x", "y"), ("y", "x")):
        rims.append(whole.groupBy(group, F.floor(F.col(o) / cell)).agg(F.min(F.struct(k, p.alias("p"))).alias("a"), F.max(F.struct(k, p.alias("p"))).alias("b")).select(group, F.explode(F.array("a.p", "b.p")).alias("p")))
    out = rims[0]
    for r in rims[1:]:
        out = out.unionByName(r)

    @F.pandas_udf(POINTS)
    def ring(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ps: [{"x": float(a), "y": float(b)} for a, b in _ring(np.array([(q["x"], q["y"]) for q in ps]))])

    sizes = frame.groupBy(group).agg(F.count("*").alias("n"))
    rings = out.distinct().groupBy(group).agg(F.collect_list("p").alias("ps")).select(group, ring("ps").alias("hull"))
    return sizes.join(rings, group, "left")


def near_hull(hull: Column, p: Column, slack: float = 15.0, thin: float = 20.0) -> Column:
    """Inside a hull or no farther from it than ``slack``; a hull without area reaches ``thin`` further."""
    area = F.abs(F.aggregate(segments(hull), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]))
    reach = F.when(area < 1e-9, slack + thin).otherwise(slack)
    return F.coalesce(contains(hull, p) | (distance_to_line(p, hull) <= reach), F.lit(False))


def thinned(line: Column, tolerance: float = 0.00002) -> Column:
    """First and last point, and of those between each that is farther than ``tolerance`` from the last one kept, in x or y."""
    n = F.size(line)
    inner = F.slice(line, F.lit(2), F.greatest(n - 2, F.lit(0)))
    keep = lambda acc, p: F.when((F.abs(p["x"] - F.element_at(acc, -1)["x"]) > tolerance) | (F.abs(p["y"] - F.element_at(acc, -1)["y"]) > tolerance), F.concat(acc, F.array(p))).otherwise(acc)
    return F.when(n <= 2, line).otherwise(F.concat(F.aggregate(inner, F.slice(line, F.lit(1), F.lit(1)), keep), F.slice(line, n, F.lit(1))))


def simplified(line: Column, tolerance: float, places: int = 5) -> Column:
    """Douglas-Peucker with a stack, and coordinates rounded; lines go through Arrow in batches."""

    def one(points: np.ndarray) -> list[dict]:
        keep = np.zeros(len(points), bool)
        keep[[0, -1]] = True
        todo = [(0, len(points) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d = points[b] - points[a]
            rel = points[a + 1 : b] - points[a]
            size = float(np.hypot(*d))
            off = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / size if size else np.hypot(rel[:, 0], rel[:, 1])
            i = int(off.argmax())
            if off[i] > tolerance:
                keep[a + 1 + i] = True
                todo += [(a, a + 1 + i), (a + 1 + i, b)]
        return [{"x": round(float(x), places), "y": round(float(y), places)} for x, y in points[keep]]

    @F.pandas_udf(POINTS)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda ps: None if ps is None else one(np.array([(p["x"], p["y"]) for p in ps])) if len(ps) else [])

    return run(line)


def share_beside(line: Column, other: Column, within: float = 45.0) -> Column:
    """Share of n + 1 even samples of a line that lie within a distance of another; n is its length over 5, at least 4."""
    n = F.greatest(F.lit(4), F.floor(length(line) / 5)).cast("int")
    at = F.transform(F.sequence(F.lit(0), n), lambda k: point_at(line, k / n))
    return F.size(F.filter(at, lambda p: distance_to_line(p, other) <= within)) / (n + 1)


def centres(frame: DataFrame, group: str, least: int = 1) -> DataFrame:
    """(group, x, y, lines): mean of line midpoints weighted by length, of groups of ``least`` lines or more; lines without
    length count as a metre."""
    m, w = point_at(F.col("line"), 0.5), F.greatest(length(F.col("line")), F.lit(1.0))
    rows = frame.select(group, m.alias("m"), w.alias("w"))
    mean = lambda k: (F.sum(F.col(f"m.{k}") * F.col("w")) / F.sum("w")).alias(k)
    return rows.groupBy(group).agg(mean("x"), mean("y"), F.count("*").alias("lines")).where(F.col("lines") >= least)


def geojson(line: Column, places: int = 6) -> Column:
    """A LineString as GeoJSON text with rounded coordinates; null for lines of fewer than two points."""
    at = F.transform(line, lambda p: F.array(F.round(p["x"], places), F.round(p["y"], places)))
    return F.when(F.size(line) > 1, F.to_json(F.struct(F.lit("LineString").alias("type"), at.alias("coordinates"))))


def iso_utc(millis: Column) -> Column:
    """Milliseconds of the epoch as an ISO time in UTC."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_millis(millis), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def either_side(left: Column, right: Column) -> Column:
    """struct(name, boundary): the left name, else the right one, and whether the two differ."""
    a, b = F.nullif(F.trim(left), F.lit("")), F.nullif(F.trim(right), F.lit(""))
    return F.struct(F.coalesce(a, b).alias("name"), F.coalesce(a != b, F.lit(False)).alias("boundary"))


# Fixed values of a frame: how far it is pulled back, and the least height in degrees.
PULL_BACK, LEAST_SPAN = 0.75, 0.010


def bounds(frame: DataFrame, group: list[str], lon: str, lat: str, name: str) -> DataFrame:
    """(group, ``name``): struct(west, south, east, north) of finite points; a group without any has a null."""
    fine = F.col(lon).isNotNull() & F.col(lat).isNotNull() & (F.abs(lon) < float("inf")) & (F.abs(lat) < float("inf")) & ~F.isnan(lon) & ~F.isnan(lat)
    x, y = F.when(fine, F.col(lon)), F.when(fine, F.col(lat))
    box = F.struct(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))
    return frame.groupBy(*group).agg(F.when(F.count(x) > 0, box).alias(name))


def progress_frame(covered: Column, whole: Column) -> Column:
    """The box to show: what is covered, pulled back, no smaller than LEAST_SPAN degrees, and within the whole. The whole where
    nothing is covered or nothing would be left; null without a whole."""
    tall, wide = F.greatest(covered["north"] - covered["south"], F.lit(1e-9)), F.greatest(covered["east"] - covered["west"], F.lit(1e-9))
    extra = F.greatest(LEAST_SPAN - tall * (1 + 2 * PULL_BACK), F.lit(0.0)) / 2
    up, side = tall * PULL_BACK + extra, wide * PULL_BACK + extra / F.cos(F.radians(covered["north"]))
    west, east = F.greatest(covered["west"] - side, whole["west"]), F.least(covered["east"] + side, whole["east"])
    south, north = F.greatest(covered["south"] - up, whole["south"]), F.least(covered["north"] + up, whole["north"])
    box = F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))
    return F.when(whole.isNull(), F.lit(None)).when(covered.isNotNull() & (east > west) & (north > south), box).otherwise(whole)
