"""Faults found by a review: what ties, copies and large tables must not change."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trailspan.functions import names
from trailspan.operators import cluster_search, corridors, coverage, graph, joins, nearest, network, places, polygons, reports, routing_areas, search
from trailspan.plans.registry import QUERIES
from trailspan.streaming import people


def test_credits_add_up_in_any_order(spark):
    rows = spark.createDataFrame([(1, 0.1)] * 8 + [(2, 0.1)] * 7, "t long, f double").coalesce(1)  # eight tenths, as doubles, are 0.7999999999999999
    assert [tuple(r) for r in coverage.credited(rows, "t", "f", 0.8, rows.limit(0), "t").collect()] == [(1, 0.8)]


def test_privacy_scan_keeps_case(spark, tmp_path):
    texts = [(1, "so One two three, Four it is"), (2, "so one two three, four it is"), (3, None), (4, "an ONE"), (5, "bone")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "one two three, four"), (8, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(tuple(r) for r in QUERIES["privacy_scan"](spark, str(tmp_path)).collect()) == [(2, 7), (2, 8), (5, 8)]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _lines(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, line array<struct<x:double,y:double>>")


def test_what_is_dealt_to_cells_is_not_broadcast(spark):
    ways = _lines(spark, [(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(0.0, 40.0), (100.0, 41.0)])], "segment_id")
    met = corridors._met(ways.where("segment_id = 1"), ways.where("segment_id = 2"))
    assert met.count() == 21 and "Broadcast" not in _plan(met)
    roads = _lines(spark, [(3, [(50.0, -10.0), (50.0, 90.0)])], "line_id")
    crossed = network.crossings(ways.withColumnRenamed("segment_id", "line_id"), roads)
    assert crossed.count() == 2 and not [x for x in _plan(crossed).splitlines() if "BroadcastHashJoin [cx" in x]


def test_copies_add_nothing_to_capped_searches(spark):
    left = spark.createDataFrame([(i, float(i % 3 * 40), i % 2) for i in range(12)] + [(12, None, 1), (13, 900.0, 0)], "l long, x double, a long")
    right = spark.createDataFrame([(i, float(i % 4 * 25), i % 3 if i % 5 else None) for i in range(40)], "r long, y double, b long")
    bonus = F.when(F.col("a") == F.col("b"), 12.0).otherwise(0.0)
    got = [sorted(tuple(r[c] for c in ("l", "r", "rank", "gap")) for r in joins.nearest_capped(left, right, "l", "r", "x", "y", 30.0, bonus, 3, reads).collect()) for reads in (None, ["a", "b"])]
    assert got[0] == got[1] and len(got[0]) == 36
    assert sorted(r.l for r in joins.beyond(left, right, "x", "y", 30.0).collect()) == [12, 13]
    assert sorted(r.l for r in joins.beyond(left, right, "x", "y", 4.0).collect()) == [r.l for r in left.where("x IS NULL OR x % 25 > 4 AND x % 25 < 21 OR x > 79").orderBy("l").collect()]


def test_radius_counts_of_copies(spark, tmp_path):
    parts = [(i, f"b{i % 5}", 10 + i % 4, 100.0 + i % 3) for i in range(40)] + [(40, "b9", 49, 5.0), (41, None, 10, 300.0), (42, None, 10, 300.0)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for k, _, s, v in parts:
        near = [p for p in parts if p[0] != k and (p[2] - s) ** 2 + (p[3] - v) ** 2 <= 9]
        if near:
            want[k] = (len(near), len({p[1] for p in near} - {None}), max(p[2] for p in near))
    got = QUERIES["radius_counts"](spark, str(tmp_path))
    assert {r.p_partkey: (r.near, r.brands, r.largest) for r in got.collect()} == want


def test_lines_a_home_lies_on_tie(spark):
    ends = [(-64.35, 25.0), (80.15, 25.0), (98.5, 25.0)]  # the second foot was rounded away from the home
    lines = spark.createDataFrame([(i, [(x, y), (x + 60, y)], "n", True) for i, (x, y) in enumerate(ends)], "line_id long, line array<struct<x:double,y:double>>, name string, owed boolean")
    places_ = [(i, 98.5 + i / 97, 25.0, "n") for i in range(300)]
    homes = spark.createDataFrame(places_, "home_id long, x double, y double, name string")
    assert {(r.main, r.distance) for r in places.associated(homes.where("x < 140.15"), lines).collect()} == {(1, 0.0)}


def test_cells_of_a_strip_are_as_full_as_those_of_a_square(spark):
    places_ = spark.range(4000).select(F.col("id").alias("place_id"), (F.col("id") % 5 * 10.0).alias("x"), (F.floor(F.col("id") / 5) * 10.0).alias("y"))
    points = spark.range(300).select(F.col("id").alias("point_id"), (F.col("id") % 7 * 6.0 + 0.5).alias("x"), (F.col("id") % 30 * 3.0 + 0.25).alias("y"))
    spots = places_.select("place_id", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    assert nearest._descended(points, spots, "point_id", 16).count() < 300 * 16 * 6
    assert nearest.nearest(points, places_).count() == 300


def test_roads_on_one_line_are_crossed_together(spark, tmp_path):
    spark.createDataFrame([(k, 3 * (k > 4000)) for k in (17, 5017, 10017, 23)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(4000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    copies = QUERIES["link_crossings"](spark, str(tmp_path)).collect()
    assert {(r.crossed, r.crossed_limited) for r in copies} <= {(3, 3), (3, 2), (1, 0), (1, 1), (4, 3), (4, 2), (4, 4)} and len(copies) > 20


def test_gaps_of_copies(spark):
    points = spark.createDataFrame([(c, x, 0.0) for c, x in ((1, 0.0), (1, 50.0), (2, 90.0), (3, 500.0), (None, 1.0))] * 40, "component long, x double, y double")
    assert sorted(tuple(r) for r in routing_areas.separation(points).collect()) == [(1, 40.0), (2, 40.0)]


def test_a_name_is_worked_out_once(spark):
    made = _plan(spark.createDataFrame([("N. Main Street",)], "s string").select(names.normalize(F.col("s")).alias("n")))
    assert made.count("lower(") == 1  # it was once for every place that read it


def test_blobs_are_snapped_many_at_once(spark):
    spots = spark.range(300).select(F.explode(F.array(*(F.struct((4 * F.col("id") + k).alias("ordinal"), (F.col("id") * 7.0 + k * 0.6).alias("x"), F.lit(0.0).alias("y")) for k in range(3)))).alias("p")).select("p.*")
    made = network.snapped(spots)
    assert "pack" in _plan(made)  # it was a call for each blob
    got = {r.ordinal: (r.node_id, round(r.node_x, 9)) for r in made.collect()}
    assert got == {4 * i + k: (4 * i + (k if k == 2 else 0), round(7 * i + (1.2 if k == 2 else 0.3), 9)) for i in range(300) for k in range(3)}


def test_seeds_of_a_start_share_a_planner(spark, monkeypatch):
    rows = [(i, (i + s) % 30, 30 * s + i, 50.0 + 7 * (i % 9)) for s in (1, 7) for i in range(30)]
    edges = pd.DataFrame(rows, columns=["u", "v", "seg", "length"])
    paths, want = search.Paths(edges), edges[edges.seg % 3 == 0].assign(prize=lambda d: d.length)
    shared = search.Planner(paths, want, 0, 900.0)
    assert [shared.one(900.0, k) for k in range(6)] == [search.walk(search.Paths(edges), want, 0, 900.0, k) for k in range(6)]


def _brute(pairs):
    label = {n: n for e in pairs for n in e}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_what_lies_near_is_joined_without_rounds(spark, monkeypatch):
    rounds = []
    kept = graph.stored_at
    monkeypatch.setattr(graph, "stored_at", lambda df, path: rounds.append(path) or kept(df, path))
    run = lambda pairs: {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "src long, dst int")).collect()}
    chain = [(i, i + 1) for i in range(100, 300)] + [(7, 7), (9, 9), (8, 9), (None, 3)]
    assert run(chain) == _brute(chain[:-1]) and not rounds  # it took a round and a written table for each doubling
    assert run([]) == {}
    rng = random.Random(5)
    far = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i - 1) for i in range(1001, 1040)]
    monkeypatch.setattr(graph, "NEAR_BITS", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(far) == _brute(far) and rounds
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_small_front_shuffles_only_edges_beside_it(spark, monkeypatch):
    seen = []
    kept = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: seen.append(_plan(df)) or kept(df, name))
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 1), (1, 3, 9), (3, 1, 7), (50, 51, 1)], "a long, b long, w long")
    sources = spark.createDataFrame([(1,), (51,)], "node long")
    want = [(1, 1, 0), (1, 2, 5), (1, 3, 6), (51, 50, 1), (51, 51, 0)]
    assert sorted(tuple(r) for r in graph.shortest_distances(edges, "a", "b", "w", sources).collect()) == want
    assert all("BroadcastHashJoin" in p and "LeftSemi" in p for p in seen[2:]) and len(seen) > 3
    monkeypatch.setattr(graph, "FEW_NODES", 0)
    assert sorted(tuple(r) for r in graph.shortest_distances(edges, "a", "b", "w", sources).collect()) == want


def test_heaps_far_apart_are_split(spark):
    """Heaps with nothing between: a point meets a few items of its heap, not the whole of it, and the nearest stays the same."""
    rng = np.random.default_rng(7)
    heaps = [(float(x), float(y) + far) for far in (0.0, 4e9, 8e9) for x, y in rng.random((800, 2)) * 1000]
    places_ = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(heaps)], "place_id long, x double, y double")
    asked = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((60, 2)) * 3000 - 1000)]
    points = spark.createDataFrame(asked, "point_id long, x double, y double")
    spots = places_.select("place_id", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    assert nearest._descended(points, spots, "point_id", 16).count() < 60 * 16 * 8
    got = {r.point_id: r.place_id for r in nearest.nearest(points, places_).collect()}
    assert got == {i: min(range(len(heaps)), key=lambda k: (np.hypot(heaps[k][0] - x, heaps[k][1] - y), k)) for i, x, y in asked}


def test_copies_of_a_piece_are_met_once(spark):
    """Lines drawn a thousand times over one another count as the one of the smallest number."""
    rows = [(i, [(0.0, 0.0), (10.0, 0.0)]) for i in range(3000, 2000, -1)] + [(1, [(0.0, 50.0), (10.0, 50.0)])]
    lines = spark.createDataFrame(rows, "line_id long, line array<struct<x:double,y:double>>")
    got = nearest.nearest_line(spark.createDataFrame([(7, 5.0, 1.0), (8, 5.0, 30.0)], "point_id long, x double, y double"), lines).collect()
    assert sorted((r.point_id, r.line_id, r.distance) for r in got) == [(7, 2001, 1.0), (8, 1, 20.0)]


def test_sizes_of_large_components_are_broadcast(spark, monkeypatch):
    """No join has all nodes of a large component under one key, and sizes stay the same on both sides of the bound."""
    monkeypatch.setattr(network, "LARGE", 50)
    parts = spark.range(200).select(F.col("id").alias("node"), F.when(F.col("id") < 150, 0).otherwise(F.col("id") - F.col("id") % 7).alias("component"))
    sized = network._sized(parts)
    want = parts.groupBy("component").count().collect()
    assert {(r.component, r.size) for r in sized.collect()} == {(r.component, r["count"]) for r in want} and sized.count() == 200
    assert "BroadcastHashJoin" in sized._jdf.queryExecution().executedPlan().toString()


def test_links_from_the_middle_of_a_cell(spark):
    """A node in the very middle of a cell looks into all cells within the link's length."""
    line = "piece_id string, u long, v long, line array<struct<x:double,y:double>>"
    rows = [("a", 1, 2, [(25.0, 25.0), (25.0, -60.0)]), ("b", 3, 4, [(20.0, 30.0), (-200.0, 30.0)]), ("c", 4, 5, [(-200.0, 30.0), (-300.0, 30.0)])]
    got = network.piece_links(spark.createDataFrame(rows, line)).collect()
    assert [(r.node, r.piece_id, r["at"], round(r.distance, 6)) for r in got] == [(1, "b", 0.0, 7.071068)]


def test_people_are_folded_row_by_row(spark):
    """No person's commands are gathered in one group, people do not mix, and numbers beyond a double's stay whole beside the row of
    a walk that was given up, which has none."""
    big = (1 << 53) + 1
    rows = [("a@x.org", "2026-01-01 00:00:00", big, "register", None, None, "t"), ("a@x.org", "2026-01-01 00:01:00", big + 2, "preview", "w", "t", None)]
    rows += [("a@x.org", "2026-01-02 00:00:00", big + 4, "discard", "w", "t", None), ("b@x.org", "2026-01-01 00:01:00", 5, "preview", "w", "t", None)]
    frame = spark.createDataFrame(rows, "email string, at string, seq long, kind string, walk string, token string, new_token string").withColumn("at", F.to_timestamp("at"))
    made = people.folded(frame)
    got = sorted((r.person, str(r.at), r.seq or 0, r.kind, r.outcome) for r in made.collect())
    assert got == [
        ("a@x.org", "2026-01-01 00:00:00", big, "register", "CREATED"), ("a@x.org", "2026-01-01 00:01:00", big + 2, "preview", "PREVIEW"), ("a@x.org", "2026-01-01 12:01:00", 0, "expire", "EXPIRED"),
        ("a@x.org", "2026-01-02 00:00:00", big + 4, "discard", "REJECTED"), ("b@x.org", "2026-01-01 00:01:00", 5, "preview", "REJECTED"),
    ]
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()


def test_route_summary_counts_without_expanding(spark):
    """Segments, required ones and connectors are counted from one row a segment and route; repeats count for steps and miles."""
    steps = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 9), (2, 2), (2, 3), (None, 3)], "route long, segment_id long")
    facts = spark.createDataFrame([(1, 1609.344, "REQUIRED"), (2, 3218.688, None), (3, None, "OTHER")], "segment_id long, length_m double, role string")
    made = reports.route_summary(steps, facts)
    assert {tuple(r) for r in made.collect()} == {(1, 3, 2, 4.0, 1, 1), (2, 2, 2, 2.0, 0, 2), (None, 1, 1, None, 0, 1)}
    assert "Expand" not in made._jdf.queryExecution().executedPlan().toString()


def test_the_sweep_offers_all_walks(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr("id AS p_partkey", "CAST(id * 7 % 50 + 1 AS int) AS p_size", "concat('b', id % 9) AS p_brand", "'STANDARD' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 0), (7, 0), (12, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    asked, routes = [], cluster_search.cluster_routes
    monkeypatch.setattr(cluster_search, "cluster_routes", lambda facts, starts, seeds, most, weights: asked.append((seeds, most)) or routes(facts, starts, seeds, most, weights))
    got = QUERIES["budget_sweep"](spark, str(tmp_path)).collect()
    assert {r.target for r in got} == {b for _, b in routing_areas.BANDS} and len(got) == 20 and all(r.starts == 2 for r in got)  # it was three of five
    assert asked == [(cluster_search.SEEDS, cluster_search.MOST_CLUSTERS)]


def test_edges_in_cells_are_not_broadcast(spark):
    ring = [(0.0, 0.0), (900.0, 30.0), (450.0, 800.0)]
    edges = polygons.polygon_edges(spark.createDataFrame([("p", ring)], "poly_id string, ring array<struct<x:double,y:double>>"))
    points = spark.createDataFrame([(1, 450.0, 300.0), (2, 10.0, 300.0), (3, 450.0, 20.0)], "point_id long, x double, y double")
    made = polygons.points_in(points, edges)
    assert [r.point_id for r in made.orderBy("point_id").collect()] == [1, 3] and "Broadcast" not in _plan(made)  # tables of their rows were held by the driver


def test_radius_counts_broadcast_nothing(spark, tmp_path):
    rows = [(i, f"b{i % 3}" if i % 5 else None, 10 + i % 7, 100.0 + i * 13 % 11) for i in range(60)] + [(60, "b7", 40, 100.0), (61, None, 41, 100.0), (62, None, 60, 100.0), (63, "b1", 60, 100.0), (64, "b1", 90, 100.0)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for k, _, s, v in rows:
        near = [p for p in rows if p[0] != k and (p[2] - s) ** 2 + (p[3] - v) ** 2 <= 9]
        if near:
            want[k] = (len(near), len({p[1] for p in near} - {None}), max(p[2] for p in near))
    got = QUERIES["radius_counts"](spark, str(tmp_path))
    assert {r.p_partkey: (r.near, r.brands, r.largest) for r in got.collect()} == want and "Broadcast" not in _plan(got)


def test_homes_among_many_lines_look_near_first(spark, monkeypatch):
    rng, seen, within = random.Random(6), [], places._best_within
    monkeypatch.setattr(places, "ENOUGH", 2)
    monkeypatch.setattr(places, "_best_within", lambda homes, pieces, radius, most, by: seen.append((radius, homes.count())) or within(homes, pieces, radius, most, by))
    ways = [(i, x, y, rng.choice("abcd"), i % 3 > 0) for i, x, y in ((i, rng.uniform(0, 300), float(rng.randrange(300))) for i in range(900))] + [(900, 700.0, 0.0, "a", False), (901, 740.0, 10.0, "b", True), (902, 1500.0, 0.0, "a", None)]
    lines = spark.createDataFrame([(i, [(x, y), (x + 30, y + i % 2 * 10)], n, o) for i, x, y, n, o in ways], "line_id long, line array<struct<x:double,y:double>>, name string, owed boolean")
    spots = [(i, rng.uniform(0, 330), float(rng.randrange(310)), rng.choice(["a", "b", "z", None])) for i in range(150)] + [(150, 745.0, 2.0, "a"), (151, 1100.0, 0.0, "a"), (152, None, 1.0, "a"), (153, 1510.0, 3.0, None)]
    got = {r.home_id: (r.main, r.others, r.reason) for r in places.associated(spark.createDataFrame(spots, "home_id long, x double, y double, name string"), lines).collect()}
    for h, x, y, name in spots:
        found = []
        for i, ax, ay, n, owed in ways if x is not None else []:
            dx, dy = 30.0, i % 2 * 10.0
            t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            d = ((x - (ax + t * dx if dy else max(ax, min(ax + dx, x)))) ** 2 + (y - (ay + t * dy)) ** 2) ** 0.5
            if d <= 75:
                found.append((d - 12 * (n == name) - 1000 * bool(owed), d, n != name, i))
        best = [f[3] for f in sorted(found)[:4]]
        assert got[h] == ((best[0], best[1:], None) if best else (None, [], "BEYOND_CAP"))
    assert seen[0][0] < 75 and max(n for r, n in seen if r == 75) < 60  # all homes met all lines within the cap


def test_distances_of_a_few_sources_stand_in_one_row(spark, monkeypatch):
    rng, offered = random.Random(8), []
    rows = [(rng.randrange(60), rng.randrange(60), rng.choice([0.0, 1.5, 2.25, 9.0, 40.0])) for _ in range(110)] + [(70, 71, 3.0), (80, 80, 1.0)]
    edges = spark.createDataFrame(rows, "a long, b long, w double")
    sources = spark.createDataFrame([(0,), (7,), (70,), (80,), (99,), (7,), (None,)], "node long")
    few = graph._from_few
    monkeypatch.setattr(graph, "_from_few", lambda *x: offered.append(x[2]) or few(*x))
    far = lambda: {tuple(r) for r in graph.shortest_distances(edges, "a", "b", "w", sources.where("node IS NOT NULL")).select("source", "node", "distance").collect()}
    got = [far()]
    monkeypatch.setattr(graph, "FEW_SOURCES", 0)
    got.append(far())
    assert got[0] == got[1] and (99, 99, 0.0) in got[0] and (70, 71, 3.0) in got[0]
    assert offered == [[0, 7, 70, 80, 99]]  # a round met an edge once for each source


def test_capped_searches_try_small_caps_first(spark, monkeypatch):
    rng = random.Random(3)
    left = spark.createDataFrame([(i, rng.choice([rng.uniform(0, 400), rng.randrange(40) * 10.0]), rng.choice([0, 1, 2, None])) for i in range(300)] + [(300, None, 1), (301, 900.0, 0), (302, 455.0, 1)], "l long, x double, a long")
    right = spark.createDataFrame([(i, rng.choice([rng.uniform(0, 400), rng.randrange(40) * 10.0]), rng.choice([0, 1, 2, None])) for i in range(400)] + [(400, 460.0, 1), (401, None, 1)], "r long, y double, b long")
    bonus = F.when(F.col("a") == F.col("b"), 12.0).otherwise(0.0)
    sizes, kept = [], joins.stored
    monkeypatch.setattr(joins, "stored", lambda df, name: kept(df, name) if name != "capped-left" else [t := kept(df, name), sizes.append(t.count())][0])
    got = [sorted(tuple(r[c] for c in ("l", "r", "rank", "gap")) for r in joins.nearest_capped(left, right, "l", "r", "x", "y", 75.0, bonus, 4, reads, match).collect()) for reads, match in ((None, None), (["a", "b"], ("a", "b", 12.0)), (None, ("a", "b", 12.0)))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 1200
    assert sizes and sizes[-1] < 40  # all rows met all that lies within the cap


def test_gaps_are_looked_for_near_first(spark, monkeypatch):
    rng, tried, within = random.Random(5), [], routing_areas.within_radius
    monkeypatch.setattr(routing_areas, "within_radius", lambda points, other, *x: tried.append((x[-1], points.count())) or within(points, other, *x))
    spots = [(rng.randrange(5), rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(400)] + [(7, 70.0, 0.0), (8, 220.0, 0.0), (9, 600.0, 0.0), (None, 71.0, 0.0), (9, None, 1.0)]
    want = {}
    for c, x, y in spots:
        far = [((x - u) ** 2 + (y - v) ** 2) ** 0.5 for d, u, v in spots if None not in (c, d, x, u) and c != d]
        if far and min(far) <= 150:
            want[c] = min(want.get(c, 1e9), min(far))
    got = routing_areas.separation(spark.createDataFrame(spots, "component long, x double, y double"))
    assert {r.component: round(r.gap, 9) for r in got.collect()} == {c: round(g, 9) for c, g in want.items()} and {7, 8} < set(want)
    assert tried[0][0] < 1 and tried[-1][0] == 150 and tried[-1][1] < 10  # all points met all within the farthest


def test_a_town_is_not_broadcast_for_its_walks(spark):
    rows = [(i, i + s, 100 * s + i, 40.0) for s in (1, 6) for i in range(30)]
    edges = spark.createDataFrame(rows, "u long, v long, seg long, length double")
    starts = spark.createDataFrame([(0, 0, 200.0), (14, 1, 200.0)], "start long, seed int, budget double")
    steps = search.routes(edges, edges.withColumn("prize", F.col("length")), starts)
    made = search.best_routes(steps, edges.select("seg", "length", F.lit(True).alias("wanted")))
    assert made.count() == 2 and "Broadcast" not in _plan(made)  # the driver held all its edges
