import math
import random

from trailspan.operators import nearest, sites

HOMES = "home_id long, site string, x double, y double"
LINES = "line_id long, line array<struct<x:double,y:double>>, segment_type string, role string, access_type string, walkable boolean, display_name string"


def to_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    d2 = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / d2)) if d2 else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def hull(points):
    points = sorted(set(points))
    if len(points) < 3:
        return points
    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]
    return half(points) + half(points[::-1])


def to_ground(p, ring):
    edges = list(zip(ring, ring[1:] + ring[:1]))
    if len(ring) > 2 and all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for a, b in edges):
        return 0.0
    return min(to_segment(p, a, b) for a, b in edges)


def town(seed=3):
    rng = random.Random(seed)
    homes, lines = [], []
    for k, (name, spread, n) in enumerate((("Mill", 150, 60), ("Ridge", 60, 40), ("Far", 80, 30), ("Row", 0, 20), ("Spot", None, 5))):
        for i in range(n):
            x, y = (k * 800.0 + rng.uniform(-spread, spread), rng.uniform(-spread, spread)) if spread else (k * 800.0 + (i * 10.0 if spread == 0 else 0.0), 5.0)
            homes.append((len(homes), name, x + (5000.0 if name == "Far" else 0.0), y))
    homes += [(900, None, 1.0, 1.0), (901, "Mill", None, 1.0)]
    for i in range(160):
        x, y = rng.uniform(-300, 3500), rng.uniform(-300, 300)
        line = [(x, y), (x + rng.uniform(-90, 90), y + rng.uniform(-90, 90)), (x + rng.uniform(-90, 90), y + rng.uniform(-90, 90))]
        lines.append((i, line, rng.choice(("STREET", "TRAIL")), rng.choice(("REQUIRED", "OPTIONAL_CONNECTOR", "EXCLUDED")), rng.choice(("PUBLIC", "PRIVATE", None)), rng.random() < 0.8, rng.choice((None, "elm", "oak", "fir"))))
    return homes, lines


def middle(line):
    sizes = [math.dist(p, q) for p, q in zip(line, line[1:])]
    left = sum(sizes) / 2
    for (p, q), s in zip(zip(line, line[1:]), sizes):
        if left <= s:
            return (p[0] + (q[0] - p[0]) * left / s, p[1] + (q[1] - p[1]) * left / s)
        left -= s


def test_profiles_equal_brute_force(spark):
    homes, lines = town()
    got = {r.site: r for r in sites.site_profiles(spark.createDataFrame(homes, HOMES), spark.createDataFrame(lines, LINES), ["ridge"]).collect()}
    assert set(got) == {"Mill", "Ridge", "Far", "Row", "Spot"}
    for name, r in got.items():
        points = [(x, y) for _, s, x, y in homes if s == name and x is not None]
        ring = hull(points)
        area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
        slack = 15.0 if area > 1e-9 else 35.0
        rim = sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1]))
        assert abs(r.acres - (area + slack * rim + math.pi * slack**2) / 4046.86) < 0.011
        inside = [x for x in lines if to_ground(middle(x[1]), ring) <= slack]
        length = lambda some: round(sum(math.dist(p, q) for x in some for p, q in zip(x[1], x[1][1:])) / 1609.344, 4)
        ok = [x for x in lines if x[5] and x[3] != "EXCLUDED"]
        assert abs(r.eligible_miles - length([x for x in inside if x in ok])) < 2e-4 and abs(r.private_miles - length([x for x in inside if x[4] == "PRIVATE"])) < 2e-4
        far = sorted(min(to_segment(p, a, b) for x in ok for a, b in zip(x[1], x[1][1:])) for p in points)
        assert (r.units, r.beyond, r.within_25m, r.within_150m) == (len(points), sum(d > 75 for d in far), sum(d <= 25 for d in far), sum(d <= 150 for d in far))
        assert abs(r.median_m - far[len(far) // 2]) < 0.06 and abs(r.p90_m - far[int(0.9 * len(far))]) < 0.06 and abs(r.max_m - far[-1]) < 0.06
        assert r.associated + r.held == r.units and ("NAMED_FOR_REVIEW" in r.flags) == (name == "Ridge")
    assert got["Far"].hold == "ALL" and got["Far"].disposition == "ADD_AUTHORITATIVE_PEDESTRIAN_NETWORK" and len(got["Far"].reasons) == 2
    assert got["Far"].held == 30 and got["Far"].median_m > 1000


def test_groups_on_and_around(spark):
    homes, lines = town(5)
    frame = spark.createDataFrame(lines, LINES)
    ground = sites.grounds(spark.createDataFrame(homes, HOMES))
    placed = sites.site_lines(ground, frame)
    got = {(r.site, r.line_id): r.inside for r in placed.collect()}
    want = {}
    for name in ("Mill", "Ridge", "Row", "Spot", "Far"):
        ring = hull([(x, y) for _, s, x, y in homes if s == name and x is not None])
        slack = 15.0 if len(ring) > 2 else 35.0
        for x in lines:
            d = to_ground(middle(x[1]), ring)
            if d <= slack + 90:
                want[name, x[0]] = d <= slack
    assert got == want and len(set(want.values())) == 2
    groups = sites.site_groups(placed, frame).collect()
    assert sum(r.segments for r in groups) == len(want)
    assert all(r.names == sorted(set(r.names)) for r in groups) and any(r.names for r in groups) and any(r.access_type is None for r in groups)


def test_nearest_line_without_lines(spark):
    none = spark.createDataFrame([], LINES)
    assert nearest.nearest_line(spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, x double, y double"), none).count() == 0
