import random

from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.operators import checks, coverage, events, graph, joins, layer_rules, network, rules, search


def lines(spark, *shapes):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in s]) for i, s in enumerate(shapes)], "line_id long, line array<struct<x:double,y:double>>")


def cut(spark, *shapes):
    out = {}
    for r in network.noded(lines(spark, *shapes)).orderBy("line_id", "part").collect():
        out.setdefault(r.line_id, []).append([(round(p.x, 3), round(p.y, 3)) for p in r.line])
    return out


def test_crossing_and_t_junction(spark):
    got = cut(spark, [(0, 0), (100, 0)], [(50, -50), (50, 50)], [(20, 0), (20, 30)])
    assert got[0] == [[(0, 0), (20, 0)], [(20, 0), (50, 0)], [(50, 0), (100, 0)]]
    assert got[1] == [[(50, -50), (50, 0)], [(50, 0), (50, 50)]]
    assert got[2] == [[(20, 0), (20, 30)]]


def test_shared_run_shared_end_and_vertices(spark):
    got = cut(spark, [(0, 0), (100, 0)], [(40, 0), (160, 0)], [(100, 0), (100, 70), (180, 70)], [(140, 40), (140, 90)])
    assert got[0] == [[(0, 0), (40, 0)], [(40, 0), (100, 0)]]
    assert got[1] == [[(40, 0), (100, 0)], [(100, 0), (160, 0)]]
    assert got[2] == [[(100, 0), (100, 70), (140, 70)], [(140, 70), (180, 70)]]
    assert got[3] == [[(140, 40), (140, 70)], [(140, 70), (140, 90)]]


def test_cut_length_is_kept(spark):
    rng = random.Random(5)
    shapes = [[(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(rng.randrange(2, 5))] for _ in range(25)]
    before = lines(spark, *shapes).agg(F.sum(geometry.length(F.col("line")))).first()[0]
    after = network.noded(lines(spark, *shapes), rim=0.0).agg(F.sum(geometry.length(F.col("line")))).first()[0]
    assert abs(before - after) < 1e-6 * before + 0.2


def test_snapping_is_greedy_in_order(spark):
    xs = [0.0, 0.29, 0.31, 0.99, 1.01, 1.9, 50.0]
    points = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(xs)], "ordinal long, x double, y double")
    got = {r.ordinal: r.node_id for r in network.snapped(points, 1.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}


def test_stitching_joins_the_near_island_only(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0), (4, 220.0, 0.0), (5, 320.0, 0.0), (6, 380.0, 0.0), (7, 480.0, 0.0)], "node long, x double, y double")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 7)], "src long, dst long")
    _, links = network.stitched(edges, nodes)
    assert [(r.src, r.dst, r.distance) for r in links.collect()] == [(4, 3, 20.0)]


def test_components_and_distances_equal_brute_force(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(90), rng.randrange(90), rng.randrange(1, 9)) for _ in range(70)] + [(i, i + 1, 2) for i in range(200, 260)] + [(500, 500, 1)]
    edges = spark.createDataFrame(pairs, "src long, dst long, w long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    near = {}
    for a, b, w in pairs:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))

    def reach(s):
        best, todo = {s: 0}, [s]
        while todo:
            u = todo.pop()
            for v, w in near[u]:
                if best[u] + w < best.get(v, 10**9):
                    best[v] = best[u] + w
                    todo.append(v)
        return best

    assert got == {n: min(reach(n)) for n in near}
    sources = spark.createDataFrame([(pairs[0][0],), (200,)], "node long")
    dist = {(r.source, r.node): r.distance for r in graph.shortest_distances(edges, "src", "dst", "w", sources).collect()}
    assert dist == {(s, n): d for s in (pairs[0][0], 200) for n, d in reach(s).items()}
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_nearest_capped_bonus_ties_and_cap(spark):
    left = spark.createDataFrame([(1, 0.0, "a"), (2, 500.0, "a")], "l long, x double, n string")
    right = spark.createDataFrame([(10, 11.0, "b"), (11, 22.0, "a"), (12, -75.0, "c"), (13, 75.1, "a"), (14, -11.0, "b")], "r long, y double, m string")
    bonus = F.when(F.col("n") == F.col("m"), 12.0).otherwise(0.0)
    got = [(r.l, r.r, r["rank"]) for r in joins.nearest_capped(left, right, "l", "r", "x", "y", 75.0, bonus, 4).orderBy("l", "rank").collect()]
    assert got == [(1, 11, 1), (1, 10, 2), (1, 14, 3), (1, 12, 4)]


def test_radius_join_equals_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(150)]
    a, b = spark.createDataFrame(pts, "i long, x double, y double"), spark.createDataFrame(pts, "j long, ox double, oy double")
    got = {(r.i, r.j) for r in joins.within_radius(a, b, "x", "y", "ox", "oy", 5.0).collect()}
    assert got == {(p[0], q[0]) for p in pts for q in pts if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 25}


def test_holds_release_renew_and_expiry(spark):
    rows = [("a", "t", "2024-01-01 00:00:00", 1), ("b", "t", "2024-01-01 00:00:00", 2), ("b", "r", "2024-01-01 00:05:00", 3), ("c", "t", "2024-01-01 00:00:00", 4), ("c", "r", "2024-01-01 00:01:00", 5), ("c", "t", "2024-01-01 00:02:00", 6), ("d", "t", "2023-12-31 23:40:00", 7), ("e", "t", "2024-01-01 00:30:00", 8)]
    frame = spark.createDataFrame(rows, "k string, kind string, at string, id long").withColumn("at", F.col("at").cast("timestamp"))
    live = events.live_holds(frame, ["k"], "at", "id", F.col("kind") == "t", F.col("kind") == "r", "2024-01-01 00:10:00", 20)
    assert sorted(r.k for r in live.collect()) == ["a", "c"]


def test_recording_twice_changes_nothing(spark):
    have = spark.createDataFrame([(1, "x")], "w long, s string")
    chosen = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x")], "w long, s string")
    new = events.newly_recorded(chosen, have, ["w", "s"])
    assert sorted(map(tuple, new.collect())) == [(1, "y"), (2, "x")]
    assert events.newly_recorded(chosen, have.unionByName(new), ["w", "s"]).count() == 0


def test_rules_first_match_and_reasons(spark):
    frame = spark.createDataFrame([("Private", "Private"), ("Private", "Local"), ("State", "Ramp"), ("State", "Local"), (None, "Local"), ("State", None)], "o string, k string")
    got = frame.select("o", "k", rules.classify(F.col("o"), "Private", ["State"], F.col("k"), "Private", ["Ramp"]).alias("c")).collect()
    assert [(r.c.access, r.c.role, r.c.status) for r in got] == [("PRIVATE", "EXCLUDED", "AUTOMATIC"), ("PRIVATE", "EXCLUDED", "NEEDS_REVIEW"), ("PUBLIC", "EXCLUDED", "AUTOMATIC"), ("PUBLIC", "REQUIRED", "AUTOMATIC"), ("UNKNOWN", "OPTIONAL_CONNECTOR", "NEEDS_REVIEW"), ("PUBLIC", "REQUIRED", "AUTOMATIC")]
    r = spark.range(1).select(rules.stress(F.lit(25), F.lit("Arterial")).alias("a"), rules.stress(F.lit(None).cast("int"), F.lit("Collector")).alias("b"), rules.stress(F.lit(60), F.lit("Primary")).alias("c"), rules.stress(F.lit(35), F.lit("Collector")).alias("d")).first()
    assert tuple(r) == (3, 3, 5, 3)


def test_steps_index_percentile_and_slate(spark):
    steps = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 6, 6, 5, 7, 5])], "route int, pos int, seg int")
    got = coverage.runs(coverage.traversals(steps, "route", "pos", "seg"), "route", "pos", "seg").orderBy("pos").collect()
    assert [r.pass_no for r in got] == [1, 1, 2, 2, 1, 3] and [r.run_id for r in got] == [1, 2, 2, 3, 4, 5]
    r = coverage.at_index(spark.range(10).withColumn("g", F.lit(1)), ["g"], "id", {"med": 0.5, "p90": 0.9, "top": 1.0}).first()
    assert (r.n, r.med, r.p90, r.top) == (10, 5, 9, 9)
    rows = [(1, 1, 10.0, [1, 2, 3]), (1, 2, 9.0, [1, 2, 4]), (1, 3, 8.0, [7, 8]), (1, 4, 6.9, [9])]
    chosen = coverage.slate(spark.createDataFrame(rows, "g long, k long, s double, items array<bigint>"), "g", "k", "s", "items", 5, 0.7, 0.35).orderBy("rank").collect()
    assert [r.k for r in chosen] == [1, 3]


def test_checks_and_verdict(spark):
    frame = spark.range(5)
    results = checks.run_checks(frame, [checks.Check("some", F.count("*") > 0), checks.Check("small", F.max("id") < 3, fatal=False)])
    assert checks.verdict(results).first().verdict == "CONDITIONS"
    assert checks.verdict(checks.run_checks(frame.limit(0), [checks.Check("max", F.max("id") >= 0)])).first().verdict == "NO-GO"


def test_leaks_are_found_at_any_place(spark):
    texts = spark.createDataFrame([(1, "xx the secret of five whole words yy"), (2, "the secret of five"), (3, "athe secret of five whole wordsz"), (4, "")], "i long, t string")
    secrets = spark.createDataFrame([(9, "the secret of five whole words")], "j long, s string")
    assert sorted(r.i for r in checks.leaked(texts, "t", secrets, "s").collect()) == [1, 3]
    homes = spark.createDataFrame([(1, "He lives at 12 MAIN ST. they say"), (2, "12 main street"), (3, "at 12 Main"), (4, None)], "i long, t string")
    short = spark.createDataFrame([(1, "12 Main St"), (2, "Main"), (3, " "), (4, None), (5, "no such place here")], "j long, s string")
    assert sorted((r.i, r.j) for r in checks.leaked(homes, "t", short, "s").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2)]


def test_walks_are_closed_within_budget_and_repeatable(spark):
    rows = []
    for x in range(5):
        for y in range(5):
            if x < 4:
                rows.append((5 * x + y, 5 * x + 5 + y, 100.0))
            if y < 4:
                rows.append((5 * x + y, 5 * x + y + 1, 100.0))
    edges = spark.createDataFrame([(u, v, i, n) for i, (u, v, n) in enumerate(rows)], "u long, v long, seg long, length double")
    wanted = edges.withColumn("prize", F.col("length"))
    starts = spark.createDataFrame([(0, s, b) for s in range(3) for b in (800.0, 1600.0)], "start long, seed int, budget double")
    steps = search.routes(edges, wanted, starts)
    first = sorted(map(tuple, steps.collect()))
    assert first == sorted(map(tuple, search.routes(edges, wanted, starts).collect()))
    ends = {i: (u, v) for i, (u, v, _) in enumerate(rows)}
    for s in range(3):
        for b in (800.0, 1600.0):
            here, mine = 0, [r for r in first if r[1] == s and r[2] == b]
            assert 0 < len(mine) * 100 <= b
            for r in sorted(mine, key=lambda r: r[3]):
                u, v = ends[r[4]]
                assert here in (u, v)
                here = v if here == u else u
            assert here == 0
    best = search.best_routes(steps, edges.select("seg", "length", F.lit(True).alias("wanted"))).collect()
    assert len(best) == 2 and all(r.new_length + r.repeated == r.length for r in best)


def test_clusters_states_and_turns(spark):
    from trailspan.operators import areas

    rows = [(1, 2, 10, 100.0, 5), (2, 3, 11, 100.0, 0), (3, 4, 12, 100.0, 0), (4, 5, 13, 100.0, 9), (8, 9, 14, 50.0, 1)]
    edges = spark.createDataFrame(rows, "u long, v long, seg long, length double, households long")
    home = spark.createDataFrame([(1, 0.0), (2, 100.0), (3, 200.0), (4, 300.0), (5, 400.0)], "node long, distance double")
    open_ = spark.createDataFrame([(10,), (11,), (13,), (14,)], "seg long")
    got = areas.clusters(edges, open_, home, 650.0).collect()
    assert [(r.root, r.segs, r.access, r.usable, r.homes) for r in got] == [(1, 2, 0.0, 200.0, 5), (4, 1, 300.0, 50.0, 9)]
    assert [r.seg for r in areas.finished_state(edges, 0.0).collect()] == []
    assert areas.finished_state(edges, 1.0).count() == 5
    half = sorted(r.seg for r in areas.finished_state(edges, 0.5, seed=3).collect())
    assert half and half == sorted(r.seg for r in areas.finished_state(edges, 0.5, seed=3).collect())
    main = [s for s in half if s != 14]
    assert main == list(range(min(main), max(main) + 1)) if main else True
    assert areas.finished_state(edges, 0.5, seed=3, spatial=False).count() >= 2
    steps = [(1, 0, 10, 1.0, 0.0, 1.0, 0.0, 1), (1, 1, 11, 0.0, 1.0, 0.0, 1.0, 3), (1, 2, 11, 0.0, -1.0, 0.0, -1.0, 2), (1, 3, 12, 0.0, -1.0, 0.0, -1.0, 3)]
    r = areas.turns(spark.createDataFrame(steps, "route int, pos int, seg int, in_x double, in_y double, out_x double, out_y double, degree int"), 60.0).first()
    assert (r.turns, r.uturns) == (1, 1)


def test_node_sequence_and_line(spark):
    pts = {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (1.0, 1.0)}
    xy = lambda n: {"x": pts[n][0], "y": pts[n][1]}
    mid = {"x": 2.0, "y": 0.5}
    walks = [(1, [(2, 1, [xy(2), xy(1)]), (2, 3, [xy(2), mid, xy(3)]), (2, 3, [xy(2), mid, xy(3)])]), (2, [(1, 2, [xy(1), xy(2)])]), (3, [])]
    frame = spark.createDataFrame(walks, "r int, steps array<struct<u:int,v:int,line:array<struct<x:double,y:double>>>>")
    got = {r.r: r for r in frame.select("r", coverage.node_sequence(F.transform("steps", lambda s: F.struct(s["u"].alias("u"), s["v"].alias("v")))).alias("n"), coverage.walked_line(F.col("steps")).alias("l")).collect()}
    assert got[1].n == [1, 2, 3, 2] and got[2].n == [1, 2] and got[3].n is None
    assert [(p.x, p.y) for p in got[1].l] == [(0, 0), (1, 0), (2, 0.5), (1, 1), (2, 0.5), (1, 0)]


def test_positions_of_large_groups_equal_sorted_values(spark):
    """A group beyond WHOLE_GROUP with long tails and ties, one of a single value, a small one, and a null key; nulls do not count."""
    g = F.when(F.col("id") < 90_000, "wide").when(F.col("id") < 120_000, "same").when(F.col("id") < 120_007, "few")
    v = F.when(g == "wide", F.floor(F.pow(F.lit(10.0), F.rand(5) * 9))).when(g == "same", 7.0).otherwise(F.col("id") % 1000)
    table = spark.range(150_000).select(g.alias("g"), F.when(F.col("id") % 11 != 3, v).cast("decimal(20,2)").alias("v"))
    rows = table.where("v IS NOT NULL").toPandas()
    assert rows["g"].value_counts()["wide"] > coverage.WHOLE_GROUP
    shares = {"first": 0.0, "median": 0.5, "p90": 0.9, "p9999": 0.9999, "top": 1.0}
    got = {r.g: r for r in coverage.at_index(table, ["g"], "v", shares).collect()}
    for key, some in rows.fillna({"g": "-"}).groupby("g"):
        ordered, r = sorted(some["v"]), got.pop(None if key == "-" else key)
        assert r.n == len(ordered)
        assert [r[k] for k in shares] == [ordered[min(int(s * len(ordered)), len(ordered) - 1)] for s in shares.values()]
    assert not got
    assert coverage.at_index(table.limit(0), ["g"], "v", shares).collect() == []


def test_links_are_numbered_over_ranges(spark):
    links = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    rows = layer_rules.as_features(links, ["x"]).collect()
    assert {r.x: r.link_id for r in rows} == {i: f"CONN-{i + 1:05d}" for i in range(5000)}
    assert layer_rules.as_features(links.limit(0), [F.desc("x")]).collect() == []
