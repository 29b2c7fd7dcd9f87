import math
import random

import pytest
from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.operators import network, polygons

RING = "poly_id string, ring array<struct<x:double,y:double>>"


def star(rng, cx, cy, n, low, high):
    return [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i, r in ((i, rng.uniform(low, high)) for i in range(n))]


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def meets(p, q, a, b):
    d = (q[0] - p[0]) * (b[1] - a[1]) - (q[1] - p[1]) * (b[0] - a[0])
    if not d:
        return None
    t = ((a[0] - p[0]) * (b[1] - a[1]) - (a[1] - p[1]) * (b[0] - a[0])) / d
    u = ((a[0] - p[0]) * (q[1] - p[1]) - (a[1] - p[1]) * (q[0] - p[0])) / d
    return t if 0 <= t <= 1 and 0 <= u <= 1 else None


@pytest.fixture(scope="module")
def layers():
    rng = random.Random(4)
    made = {"plain": [star(rng, 0, 0, 40, 200, 500)], "holed": [star(rng, 900, 0, 60, 350, 480), star(rng, 900, 0, 20, 80, 300), star(rng, 900, 0, 9, 20, 60)],
            "parts": [star(rng, -50, 900, 30, 100, 200), star(rng, 500, 900, 30, 100, 200)], "over": [star(rng, 300, 100, 7, 300, 600)], "tiny": [[(10.25, 10.25), (12.25, 10.25), (11.25, 13.25)]]}
    return made


def edges(spark, layers):
    rows = [(k, [*r, r[0]] if i % 2 else r) for k, rings in layers.items() for i, r in enumerate(rings)] + [("line", [(0.0, 0.0), (5.0, 5.0)])]
    return polygons.polygon_edges(spark.createDataFrame(rows, RING))


@pytest.mark.parametrize("cell", [30.0, 100.0, 5000.0])
def test_points_equal_ray_casting(spark, layers, cell):
    rng = random.Random(9)
    points = [(i, rng.uniform(-700, 1600), rng.uniform(-700, 1300)) for i in range(700)] + [(700, 11.25, 11.25), (701, None, 1.0)]
    got = polygons.points_in(spark.createDataFrame(points, "point_id long, x double, y double"), edges(spark, layers), cell)
    want = {(i, k) for i, x, y in points if x is not None for k, rings in layers.items() if inside(rings, x, y)}
    assert {(r.point_id, r.poly_id) for r in got.collect()} == want and (700, "tiny") in want


def test_lines_equal_brute_force_and_flags_follow(spark, layers):
    rng = random.Random(2)
    lines = []
    for i in range(250):
        x, y = rng.uniform(-600, 1500), rng.uniform(-600, 1200)
        line = [(x, y)]
        for _ in range(rng.randrange(1, 4)):
            x, y = x + rng.uniform(-150, 150), y + rng.uniform(-150, 150)
            line.append((x, y))
        lines.append((i, line))
    frame = spark.createDataFrame(lines, "line_id long, line array<struct<x:double,y:double>>")
    rims = edges(spark, layers)
    got = {(r.line_id, r.poly_id): (r.middle_inside, r.crosses, r.contains) for r in polygons.lines_against(frame, rims).collect()}
    middles = {r.line_id: r.p for r in frame.select("line_id", geometry.point_at(F.col("line"), 0.5).alias("p")).collect()}
    want = {}
    for i, line in lines:
        for k, rings in layers.items():
            over = any(meets(p, q, a, b) is not None for p, q in zip(line, line[1:]) for r in rings for a, b in zip(r, r[1:] + r[:1]))
            mid = inside(rings, middles[i].x, middles[i].y)
            if over or mid:
                want[i, k] = (mid, over, not over)
    assert got == want
    town, campus = rims.where("poly_id = 'plain'"), rims.where("poly_id IN ('holed', 'parts')")
    flags = {r.line_id: tuple(r)[1:] for r in polygons.layer_flags(frame, town, campus, rims.limit(0)).collect()}
    for i, _ in lines:
        t, c = want.get((i, "plain"), (False, False, False)), [want.get((i, k), (False,))[0] for k in ("holed", "parts")]
        assert flags[i] == (t[0], t[1], any(c), False)


def test_a_large_polygon_is_dealt_to_tasks(spark):
    n = 100_000
    angle = 2 * F.pi() * F.col("id") / n
    at = lambda k: geometry.point(1000 * F.cos(2 * F.pi() * k / n), 1000 * F.sin(2 * F.pi() * k / n))
    ring = spark.range(n, numPartitions=8).select(F.lit("big").alias("poly_id"), at(F.col("id")).alias("a"), at((F.col("id") + 1) % n).alias("b"), angle.alias("w")).drop("w")
    points = spark.createDataFrame([(i, x, 0.5) for i, x in enumerate((-1001.0, -999.0, 0.0, 999.9, 1000.1))], "point_id long, x double, y double")
    assert sorted(r.point_id for r in polygons.points_in(points, ring, 50.0).collect()) == [1, 2, 3]


def test_a_long_diagonal_passes_hundreds_of_cells(spark):
    cells = lambda a, b: spark.range(1).select(F.size(network.passed_cells(geometry.point(*map(F.lit, a)), geometry.point(*map(F.lit, b)), 50.0)).alias("n")).first().n
    assert 400 <= cells((0.0, 1.0), (14142.0, 14142.0)) <= 900
    assert cells((10.0, 10.0), (10.0, 10.0)) == 1 and cells((10.0, 10.0), (110.0, 10.0)) == 3 and cells((10.0, 110.0), (10.0, 10.0)) == 3


def test_crossings_equal_pairs(spark):
    rng = random.Random(6)
    def some(n, k):
        return [(i, [(rng.uniform(0, 2000), rng.uniform(0, 2000)) for _ in range(k)]) for i in range(n)]
    left, right = some(40, 3), [(100 + i, line) for i, line in some(30, 4)] + [(500, [(0.0, 0.0), (2000.0, 0.0)])]
    left += [(60, [(100.0, -10.0), (100.0, 10.0)]), (61, [(200.0, -0.2), (200.0, 50.0)]), (62, [(300.0, -10.0), (300.0, 0.0), (300.0, 20.0)])]
    made = lambda rows: spark.createDataFrame(rows, "line_id long, line array<struct<x:double,y:double>>")
    got = sorted((r.line_id, r.other_id, r.at) for r in network.crossings(made(left), made(right)).collect())
    want = set()
    for i, line in left:
        total, at = sum(math.dist(p, q) for p, q in zip(line, line[1:])), 0.0
        for p, q in zip(line, line[1:]):
            for j, other in right:
                for a, b in zip(other, other[1:]):
                    t = meets(p, q, a, b)
                    if t is not None and 0.5 < at + t * math.dist(p, q) < total - 0.5:
                        want.add((i, j, round(at + t * math.dist(p, q), 3)))
            at += math.dist(p, q)
    assert got == sorted(want) and (60, 500, 10.0) in want and not any(i == 61 and j == 500 for i, j, _ in want) and (62, 500, 10.0) in want
