"""Ways beside each other against brute force; gates that must fail; summaries at their edges."""

import numpy as np
from pyspark.sql import functions as F

from trailspan.operators import corridors, gates, places, validation

LINE = "array<struct<x:double,y:double>>"


def _gap(p, line):
    best = np.inf
    for a, b in zip(line, line[1:]):
        d = b - a
        if (d @ d) > 0:
            t = np.clip((p - a) @ d / (d @ d), 0, 1)
            best = min(best, np.hypot(*(p - a - t * d)))
    return best


def _points(line):
    size = np.hypot(*np.diff(line, axis=0).T)
    n, upto = max(4, int(size.sum() // 5)), np.concatenate([[0], np.cumsum(size)])
    at = np.linspace(0, 1, n + 1) * upto[-1]
    return np.stack([np.interp(at, upto, line[:, k]) for k in (0, 1)], 1)


def test_bent_ways_are_compared_with_all_canonical_ones(spark):
    r = np.random.default_rng(4)
    lines = {i: np.cumsum(np.vstack([r.uniform(0, 400, 2), r.uniform(-30, 45, (r.integers(1, 6), 2))]), 0) for i in range(60)}
    rows = [(i, None if i % 3 == 0 else f"c{i % 4}", "ALTERNATIVE" if i % 7 == 1 else "CANONICAL", [(float(x), float(y)) for x, y in line]) for i, line in lines.items()]
    rows += [(900, None, "CANONICAL", [(1.0, 1.0), (1.0, 1.0)]), (901, None, "CANONICAL", [])]
    ways = spark.createDataFrame(rows, f"segment_id long, corridor string, given string, line {LINE}")
    named = ways.where("corridor IS NOT NULL")
    duties = named.select("segment_id", "corridor", F.col("given").alias("obligation")).unionByName(corridors.unnamed_duties(ways.where("corridor IS NULL"), named.where("given = 'CANONICAL'")))
    canon = [lines[i] for i, c, g, _ in rows if c and g == "CANONICAL"]
    want = {}
    for i, c, g, _ in rows[:60]:
        near = np.mean([min(_gap(p, o) for o in canon) <= 45 for p in _points(lines[i])])
        want[i] = g if c else "ALTERNATIVE" if near >= 0.7 else "CANONICAL"
    got = {x.segment_id: x.obligation for x in duties.collect()}
    assert got == want and {want[i] for i in range(0, 60, 3)} == {"ALTERNATIVE", "CANONICAL"}
    corridor = {i: c for i, c, _, _ in rows}
    links = {}
    for a in (i for i in want if want[i] == "ALTERNATIVE"):
        for c in (i for i in want if want[i] == "CANONICAL"):
            if corridor[a] is None or corridor[a] == corridor[c]:
                share = np.mean([_gap(p, lines[a]) <= 45 for p in _points(lines[c])])
                if share >= 0.05:
                    links[a, c] = round(float(share), 4)
    assert {(x.alternative, x.canonical): x.fraction for x in corridors.credits(ways, duties).collect()} == links


def test_all_duties_of_named_and_unnamed_ways_and_of_none(spark):
    rows = [(1, "mall", [(0.0, 0.0), (300.0, 0.0)]), (2, "mall", [(0.0, 20.0), (150.0, 20.0)]), (3, None, [(10.0, 30.0), (200.0, 30.0)]), (4, None, [(0.0, 900.0), (50.0, 900.0)])]
    ways = spark.createDataFrame(rows, f"segment_id long, corridor string, line {LINE}").withColumn("length_m", F.lit(100.0))
    duties = corridors.all_duties(ways)
    assert {x.segment_id: x.obligation for x in duties.collect()} == {1: "CANONICAL", 2: "ALTERNATIVE", 3: "ALTERNATIVE", 4: "CANONICAL"}
    one = corridors.campus_totals(ways, duties, corridors.credits(ways, duties)).first()
    assert (one.corridors, one.segments, one.alternatives_with_credit, one.canonical_with_an_alternative) == (1, 4, 2, 1)
    none = ways.limit(0)
    assert corridors.all_duties(none).count() == 0
    one = corridors.campus_totals(none, duties, corridors.credits(none, duties)).first()
    assert (one.segments, one.miles) == (0, 0.0)
    assert corridors.coverage_by(spark.createDataFrame([(None, None, " ", 10.0)], "segment_type string, owner string, name string, length_m double")).orderBy("kind").select("kind", "value").collect() == [("owner", "(blank)"), ("type", "?")]


def _passed(frame):
    return {x.name: x.passed for x in frame.collect()}


def test_gates_fail_on_what_they_are_there_for(spark):
    ab = lambda *r: _passed(gates.comparison_gates(spark.createDataFrame(r, "metric string, before double, after double")))["repeat_traversal_improved_without_coverage_loss"]
    assert ab(("avoidable_repeat_miles", 10.0, 8.0), ("new_required_miles", 10.0, 9.6)) and ab(("avoidable_repeat_miles", 10.0, 8.0))
    assert not ab(("avoidable_repeat_miles", 10.0, 9.5)) and not ab(("avoidable_repeat_miles", 10.0, 8.0), ("new_required_miles", 10.0, 9.0)) and not ab(("avoidable_repeat_miles", 0.0, 0.0))
    members = spark.createDataFrame([(1, "REQUIRED", "CANONICAL", 20_000.0, "main"), (2, "OPTIONAL_CONNECTOR", "ALTERNATIVE", 9.0, "side")], "segment_id long, role string, campus_obligation string, length_m double, normalized_name string")
    credits = lambda *r: spark.createDataFrame(r, "alternative long, canonical long, found boolean")
    promoted = lambda m, c: _passed(gates.promotion_gates(m, c))["campus_promoted_without_duplicate_obligation"]
    assert promoted(members, credits((2, 1, True)))
    assert not promoted(members, credits((2, 9, False))) and not promoted(members, credits((2, 1, True), (2, 9, False))) and not promoted(members.limit(0), credits((2, 1, True)))
    assert not promoted(members.withColumn("role", F.lit("REQUIRED")), credits((2, 1, True)))
    one = lambda d: next(iter(_passed(d).values()))
    assert one(gates.override_gates(spark.range(1), members, "gone")) and not one(gates.override_gates(spark.range(1), members, "main")) and not one(gates.override_gates(spark.range(0), members, "gone"))
    areas = spark.createDataFrame([("Park east", "VALID_INDEPENDENT_ROUTING_AREA"), (None, "x")], "description string, class string")
    crossing = lambda i: spark.createDataFrame([(i, True), (5, False)], "segment_id long, touches boolean")
    assert one(gates.crossing_gates(crossing(8), members, areas, "Park")) and not one(gates.crossing_gates(crossing(1), members, areas, "Park")) and not one(gates.crossing_gates(crossing(8), members, areas, "Lake"))
    assert one(gates.stranded_gates(members.withColumn("in_main", F.lit(True)))) and not one(gates.stranded_gates(members.withColumn("in_main", F.lit(None).cast("boolean"))))
    routes = spark.createDataFrame([("a", 3, 1.0, "ROUTE_AVAILABLE", 50.0), ("b", 9, None, "LATE", 900.0), ("a", 0, 1.0, None, 60.0)], "location string, households int, distance_miles double, state string, single_ms double")
    assert _passed(gates.benchmark_gates(routes, "a")) == {"location_explained": True, "late_opportunity_states_defined": False, "performance_interactive": True}
    assert not _passed(gates.benchmark_gates(routes, "b"))["location_explained"] and not _passed(gates.benchmark_gates(routes.limit(0), "a"))["performance_interactive"]


def test_lines_are_seen_by_those_signed_in_only(spark):
    rows = spark.createDataFrame([(1, "l", True), (2, "l", False), (3, "l", None)], "id int, line string, me boolean")
    assert [x.line for x in gates.visible(rows, ["line"], F.col("me")).orderBy("id").collect()] == ["l", None, None]
    assert gates.visible(rows, ["line"], F.col("me"), public=True).where("line IS NULL").isEmpty()
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (7, "a")], "walk int, person string")
    assert sorted(map(tuple, gates.owned(asked.where("person = 'a' AND walk = 1"), asked, "walk", "person").collect())) == [(1, "a", True), (1, "b", False), (7, "a", False)]


def test_trust_in_attachments_and_summaries_at_their_edges(spark):
    at = [(40.0, True), (40.1, True), (25.0, False), (25.1, False), (25.1, None)]
    got = spark.createDataFrame(at, "d double, s boolean").select(places.confidence(F.col("d"), F.col("s")).alias("c")).collect()
    assert [x.c for x in got] == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]
    edges = spark.createDataFrame([(1, 1, 2, "REQUIRED"), (2, 2, 3, "REQUIRED"), (3, 3, 1, "OPTIONAL_CONNECTOR"), (4, 3, 4, "REQUIRED"), (5, 9, 9, "REQUIRED")], "segment_id long, u long, v long, role string")
    assert sorted(x.segment_id for x in validation.only_dead_ends_left(edges).collect()) == [1, 2, 5]
    assert validation.only_dead_ends_left(edges.limit(0)).count() == 0
    places_, bands = spark.createDataFrame([(1, 0, 3.0, True, True), (2, 4, None, None, None)], "location int, component int, snap_m double, campus boolean, reaches_both boolean"), spark.createDataFrame([(1, b, True, b < 2) for b in range(5)], "location int, band int, available boolean, coherent boolean")
    one = validation.validated(places_, bands).first()
    assert tuple(one) == (2, 1, 2, 3.0, 1, 1, 0.4, 1)
    assert validation.validated(places_.limit(0), bands).first().coherent_loop_rate == 0.0
    routes = spark.createDataFrame([(1.0, 4), (None, 90), (2.0, None)], "distance_miles double, households int")
    got = {x.metric: (x.before, x.after, x.routes_before, x.routes_after) for x in validation.means_compared(routes, routes.limit(0), ["distance_miles", "households"]).collect()}
    assert got == {"distance_miles": (1.5, None, 2, 0), "households": (4.0, None, 2, 0)}
    walks = validation.walk_homes(spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7)], "walk int, segment_id int"), spark.createDataFrame([(5, 3), (6, 4)], "segment_id int, households int"))
    assert {x.walk: x.households for x in walks.collect()} == {1: 7, 2: 0}
