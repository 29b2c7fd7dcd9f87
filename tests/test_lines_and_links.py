import itertools
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.operators import merging, nearest, slates, whatif
from trailspan.operators.graph import connected_components

LINE = "line_id long, line array<struct<x:double,y:double>>"


def brute_merge(lines):
    """Chains by walking: {(frozenset of ids, pieces, closed, rounded length)}."""
    at = defaultdict(list)
    for i, line in lines:
        for end in (0, -1):
            at[line[end]].append((i, end))
    shape, left, out = dict(lines), {i for i, _ in lines}, set()
    follow = lambda i, end: next(((j, e) for j, e in at[shape[i][end]] if (j, e) != (i, end)), None) if len(at[shape[i][end]]) == 2 else None
    while left:
        first = min(left)
        ids, closed = {first}, False
        for end in (0, -1):
            i, e = first, end
            while (step := follow(i, e)) is not None:
                i, e = step[0], -1 - step[1]
                if i == first:
                    closed = True
                    break
                ids.add(i)
            if closed:
                break
        left -= ids
        out.add((min(ids), len(ids), closed, round(sum(math.dist(p, q) for i in ids for p, q in zip(shape[i], shape[i][1:])), 6)))
    return out


def test_merging_equals_brute_force(spark):
    rng = random.Random(5)
    lines, n = [], 0
    def add(points):
        nonlocal n
        n += 1
        lines.append((n, points if rng.random() < 0.5 else points[::-1]))
    for k, size in enumerate((1, 2, 3, 7, 40)):  # rings
        points = [(1000.0 * k + 100 * math.cos(2 * math.pi * i / (2 * size)), 100 * math.sin(2 * math.pi * i / (2 * size))) for i in range(2 * size)]
        points = [(round(x, 3), round(y, 3)) for x, y in points]
        for i in range(size):
            add([points[2 * i], points[2 * i + 1], points[(2 * i + 2) % (2 * size)]])
    side = 7
    for y, x in itertools.product(range(side), range(side)):  # a lattice with gaps
        for dx, dy in ((1, 0), (0, 1)):
            if rng.random() < 0.55:
                add([(float(x), 500.0 + y), (x + dx / 2, 500.0 + y + dy / 2 + 0.1), (float(x + dx), 500.0 + y + dy)])
    rng.shuffle(lines)
    ids = list(range(1, len(lines) + 1))
    rng.shuffle(ids)
    lines = [(j, line) for j, (_, line) in zip(ids, lines)]
    got = merging.merged_lines(spark.createDataFrame([*lines, (9999, [(1.0, 1.0)])], LINE)).select("*", F.round(geometry.length(F.col("line")), 6).alias("size")).collect()
    assert {(r.merged_id, r.pieces, r.closed, r["size"]) for r in got} == brute_merge(lines) and len(got) == len(brute_merge(lines))
    shape = dict(lines)
    for r in got:
        points = [(p.x, p.y) for p in r.line]
        pieces = {frozenset(zip(points, points[1:])) for _ in (0,)}
        assert (points[0] == points[-1]) == r.closed or r.pieces == 1
        assert len(pieces) == 1 and len(points) == len(set(points)) + r.closed
        if r.closed:
            assert points[: len(shape[r.merged_id])] == shape[r.merged_id]


def test_a_chain_of_ten_thousand_pieces(spark):
    n = 10_000
    turn = F.col("id") * 7919 % n  # any order
    point = lambda k: geometry.point(k * 1.0, k % 3 * 1.0)
    lines = spark.range(n).select(turn.alias("line_id"), F.when(turn % 2 == 0, F.array(point(turn), point(turn + 1))).otherwise(F.array(point(turn + 1), point(turn))).alias("line"))
    r = merging.merged_lines(lines).collect()
    assert len(r) == 1 and r[0].pieces == n and not r[0].closed and len(r[0].line) == n + 1
    assert merging.merged_lines(spark.createDataFrame([], LINE)).count() == 0


def test_nearest_equals_brute_force(spark):
    rng = random.Random(8)
    places = [(i, rng.gauss(0, 300) + rng.choice((0, 9000)), rng.gauss(0, 300)) for i in range(400)] + [(900, 5.0, 5.0), (401, 5.0, 5.0), (902, None, 1.0), (903, 1e6, 1e6)]
    points = [(i, rng.uniform(-20_000, 30_000), rng.uniform(-20_000, 20_000)) for i in range(150)] + [(i, 5.0, 5.0) for i in range(150, 180)] + [(i, 4500.0, 0.0) for i in range(180, 200)] + [(999, None, 0.0)]
    kind = lambda k: f"{k} long, x double, y double"
    for share in (1, 16, 10_000):
        got = {r.point_id: (r.place_id, round(r.distance, 9)) for r in nearest.nearest(spark.createDataFrame(points, kind("point_id")), spark.createDataFrame(places, kind("place_id")), share=share).collect()}
        want = {}
        for i, x, y in points:
            if x is not None:
                d, p = min((math.hypot(x - px, y - py), p) for p, px, py in places if px is not None)
                want[i] = (p, round(d, 9))
        assert got == want
    none = spark.createDataFrame([], kind("place_id"))
    assert nearest.nearest(spark.createDataFrame(points, kind("point_id")), none).count() == 0
    one = spark.createDataFrame([(3, 1.0, 1.0)], kind("place_id"))
    assert {r.place_id for r in nearest.nearest(spark.createDataFrame(points, kind("point_id")), one).collect()} == {3}


def parts(nodes, edges):
    up = {n: n for n in nodes}
    def root(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_links_on_the_small_graph_equal_whole_runs(spark):
    rng = random.Random(3)
    base = [(n, n + 1) for n in range(0, 240, 2)] + [(n, n + 2) for n in range(0, 240, 8)]
    nodes = sorted({n for e in base for n in e})
    links = [(i, rng.choice(nodes), rng.choice(nodes)) for i in range(150)] + [(150, 0, 7777), (151, 0, 1)]
    sets = [("few", i) for i in range(40)] + [("many", i) for i in range(110)] + [("many", 150), ("few", 0), ("none", 151)]
    made = connected_components(spark.createDataFrame(base, "src long, dst long"))
    frames = (made, spark.createDataFrame(links, "link_id long, u long, v long"), spark.createDataFrame(sets, "scenario string, link_id long"))
    start = parts(nodes, base)
    by_id = {i: (u, v) for i, u, v in links}
    got = {r.scenario: (r.components, r.largest, r.joining, r.saved) for r in whatif.scenario_summary(*frames).collect()}
    needed = {(r.scenario, r.link_id): (r.beside, r.needed, r.low_nodes, r.high_nodes) for r in whatif.joined_by(*frames).collect()}
    sizes = Counter(start.values())
    for name in ("base", "few", "many", "none"):
        mine = sorted({i for s, i in sets if s == name and by_id[i][1] in start})
        after = parts(nodes, base + [by_id[i] for i in mine])
        joins = [i for i in mine if start[by_id[i][0]] != start[by_id[i][1]]]
        count = len(set(after.values()))
        assert got[name] == (count, max(Counter(after.values()).values()), len(joins), len(sizes) - count)
        for i in joins:
            a, b = sorted(start[n] for n in by_id[i])
            same = [j for j in joins if sorted(start[n] for n in by_id[j]) == [a, b]]
            without = parts(nodes, base + [by_id[j] for j in joins if j not in same])
            assert needed.pop((name, i)) == (len(same) - 1, without[a] != without[b], sizes[a], sizes[b]), (name, i)
    assert not needed
    facts = spark.createDataFrame([(i, 20.0 if i % 2 else 60.0, i % 3, i % 4, i % 5 * 10.0, "Arterial" if i % 7 == 0 else "Local", 25, i % 2) for i in range(150)], "link_id long, length double, junction_near int, opposed_ends int, homes_near double, worst_class string, worst_speed int, crossed int")
    ranked = whatif.link_priority(whatif.joined_by(*frames), facts).collect()
    assert {r.priority for r in ranked} >= {"HIGH", "LOW"}
    for r in ranked:
        assert ("not needed" in r.evidence_against) <= (r.priority != "HIGH") and (r.priority != "HIGH" or not r.evidence_against)


def test_spread_looks_at_all_candidates(spark):
    near = [(1, n, 1000.0 - n, 0.0, n * 1e-5) for n in range(250)]
    far = [(1, 300 + k, 1.0, 0.05 * (k + 1), 0.0) for k in range(5)]
    got = slates.spread(spark.createDataFrame([*near, *far, (2, 7, 1.0, 0.0, 0.0)], "g int, node int, score double, lon double, lat double"), "g", 14).collect()
    assert [r.node for r in sorted((r for r in got if r.g == 1), key=lambda r: r.pos)] == [0, 300, 301, 302, 303, 304]
    assert [r.node for r in got if r.g == 2] == [7]
