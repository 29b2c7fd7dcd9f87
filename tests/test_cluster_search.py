import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailspan.operators import cluster_search, coverage, missions, search
from trailspan.operators.membership import MILE


def lattice(seed, side, spacing=200.0):
    """Segments of a lattice with gaps and dead ends, and the places of its nodes."""
    rng = random.Random(seed)
    rows, seg = [], 0
    for y, x in itertools.product(range(side), range(side)):
        for dx, dy in ((1, 0), (0, 1)):
            if x + dx < side and y + dy < side and rng.random() < 0.85:
                seg += 1
                name = None if rng.random() < 0.2 else f"{'row' if dx else 'column'} {y if dx else x}"
                rows.append((seg, y * side + x, (y + dy) * side + x + dx, spacing * rng.uniform(1, 1.3), "REQUIRED" if rng.random() < 0.7 else "OPTIONAL_CONNECTOR", rng.randrange(30), name, rng.random() < 0.1, rng.randrange(1, 6)))
    degree = pd.Series([n for r in rows for n in r[1:3]]).value_counts()
    kept = [(*r[:7], r[6], bool(degree[r[1]] == 1 or degree[r[2]] == 1), *r[7:]) for r in rows]
    return kept, [(y * side + x, x * spacing, y * spacing) for y, x in itertools.product(range(side), range(side))]


MEMBERS = "segment_id long, u long, v long, length_m double, role string, households int, display_name string, normalized_name string, dead_end boolean, derived boolean, stress int"


def made(spark, seed, side, credits=None):
    rows, places = lattice(seed, side)
    members = spark.createDataFrame(rows, MEMBERS)
    done = members.where("segment_id % 6 = 0 OR u % 5 = 2").select("segment_id")
    facts = cluster_search.with_facts(members, done, spark.createDataFrame(places, "node long, x double, y double"), credits)
    return members, done, facts


@pytest.fixture(scope="module")
def walked(spark):
    members, done, facts = made(spark, 3, 9)
    starts = spark.createDataFrame([(s, t) for s in (0, 40, 44, 80) for t in (1.0, 2.0)] + [(999, 1.0), (None, 1.0)], "start long, target double")
    steps = cluster_search.cluster_routes(facts, starts, seeds=3, most=3).toPandas()
    return members, done, facts.toPandas(), steps


def test_walks_close_fit_and_score_as_the_facts_say(spark, walked):
    members, done, facts, steps = walked
    ends = {r.seg: (r.u, r.v) for r in facts.itertuples()}
    assert set(steps["start"]) == {0, 40, 44, 80}
    assert steps.groupby(["start", "target"])["cluster"].nunique().max() > 2
    for (start, target, _), g in steps.groupby(["start", "target", "cluster"]):
        here = start
        for s in g.sort_values("pos")["seg"]:
            assert here in ends[s]
            here = sum(ends[s]) - here
        assert here == start and g["length"].iloc[0] <= target * MILE * 1.08 + 1e-6
    route = F.concat_ws("/", "start", "target", "cluster")
    frame = spark.createDataFrame(steps).withColumn("route", route)
    segs = spark.createDataFrame(facts.drop(columns=["credits"])).select("seg", (F.col("length") / MILE).alias("miles"), "required", "households", "dead_end", "derived", "stress", "isolated")
    per = missions.route_facts(frame, segs, done.select(F.col("segment_id").alias("seg"))).toPandas().set_index("route")
    for (start, target, cluster), g in steps.groupby(["start", "target", "cluster"]):
        score = cluster_search.RouteScore(facts, start)
        order = g.sort_values("pos")
        walk, closing = order["seg"].tolist(), int(order["closing"].sum())
        parts = score.components(walk, closing, target)
        assert abs(score.of(walk, closing, target) - g["score"].iloc[0]) < 1e-6
        row = per.loc[f"{start}/{target}/{cluster}"]
        for mine, theirs in (("new_required", "new_required"), ("households", "households"), ("dead_end_completion", "dead_ends"), ("isolation", "isolated"), ("repeat_closing", "closing_miles"), ("repeat_dead_end", "dead_end_return"), ("repeat_extra_traversal", "extra"), ("connector", "connector"), ("derived_connector", "derived"), ("stress", "stress"), ("loop_shape", "loop_shape")):
            assert abs(parts[mine] - row[theirs]) < 1e-9, mine
        off = spark.createDataFrame([tuple(float(row[c]) for c in ("total", "avoidable", "repeat_share"))], "total double, avoidable double, repeat_share double") if start == 0 else None
        if off is not None:
            r = off.select((F.col("avoidable") * missions.band_factor(F.lit(target))).alias("a"), missions.repeat_penalty(F.col("repeat_share"), F.col("total")).alias("b")).first()
            assert abs(parts["repeat_avoidable"] - r.a) < 1e-9 and abs(parts["repeat_share"] - r.b) < 1e-9


def test_best_is_never_below_plain_routes(spark, walked):
    members, done, facts, steps = walked
    edges = spark.createDataFrame(facts[["u", "v", "seg", "length"]])
    wanted = spark.createDataFrame(facts[facts["open"]][["u", "v", "seg", "length"]].assign(prize=lambda w: w["length"]))
    asked = spark.createDataFrame([(s, k, t * MILE * 1.08) for s in (0, 40, 44, 80) for t in (1.0, 2.0) for k in range(3)], "start long, seed int, budget double")
    plain = search.routes(edges, wanted, asked).toPandas()
    best = steps.groupby(["start", "target"])["score"].max()
    frame = cluster_search.best_of_clusters(spark.createDataFrame(steps)).toPandas()
    assert frame.groupby(["start", "target"])["score"].first().round(6).to_dict() == best.round(6).to_dict()
    assert len(plain)
    for (start, budget, _), g in plain.groupby(["start", "budget", "seed"]):
        target = round(budget / MILE / 1.08, 6)
        order = g.sort_values("pos")
        assert cluster_search.RouteScore(facts, start).of(order["seg"].tolist(), int(order["closing"].sum()), target) <= best[(start, target)] + 1e-6


def test_small_graphs_come_close_to_brute_force(spark):
    """At most eight wanted segments: every order and direction of every subset, by the score itself."""
    for seed in (1, 2, 3):
        rows, places = lattice(seed, 3)
        open_ids = [r[0] for r in rows if r[4] == "REQUIRED"][:5]
        rows = [(*r[:4], "REQUIRED" if r[0] in open_ids else "OPTIONAL_CONNECTOR", *r[5:]) for r in rows]
        facts = cluster_search.with_facts(spark.createDataFrame(rows, MEMBERS), spark.createDataFrame([], "segment_id long"), spark.createDataFrame(places, "node long, x double, y double"))
        got = cluster_search.cluster_routes(facts, spark.createDataFrame([(0, 1.0)], "start long, target double"), seeds=6).toPandas()
        known = facts.toPandas().sort_values(["seg"])
        paths, score, budget = search.Paths(known), cluster_search.RouteScore(known, 0), MILE * 1.08
        want = known[known["open"]].assign(prize=1.0)
        planner = cluster_search.ScoredPlanner(paths, want, 0, budget, score, 1.0)
        best = -1e18
        for n in range(1, len(open_ids) + 1):
            for some in itertools.permutations(want.itertuples(), n):
                for way in itertools.product((0, 1), repeat=n):
                    legs = [(r.v, r.seg, r.u) if w else (r.u, r.seg, r.v) for r, w in zip(some, way)]
                    if all(a in paths.of(0)[0] for a, _, _ in legs):
                        worth, length, _ = planner.value(legs)
                        if length <= budget:
                            best = max(best, worth)
        if best > -1e18:
            assert got["score"].max() <= best + 1e-6 and got["score"].max() >= best - 0.15 * abs(best) - 5


def test_credits_count_once_and_only_from_the_share_needed(spark):
    rows = [(1, 0, 1, 400.0, "OPTIONAL_CONNECTOR", 0, None, None, False, False, 1), (2, 0, 1, 410.0, "REQUIRED", 9, "elm", "elm", False, False, 1), (3, 1, 0, 420.0, "OPTIONAL_CONNECTOR", 0, None, None, False, False, 1)]
    credits = spark.createDataFrame([(1, 2, 0.5, 0.8), (3, 2, 0.4, 0.8)], "segment_id long, to_segment long, share double, needed double")
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 300.0, 0.0)], "node long, x double, y double")
    facts = cluster_search.with_facts(spark.createDataFrame(rows, MEMBERS), spark.createDataFrame([], "segment_id long"), places, credits).toPandas()
    score = cluster_search.RouteScore(facts, 0)
    both, one = score.components([1, 3], 0, 0.5), score.components([1, 1], 1, 0.5)
    assert abs(both["new_required"] - 410.0 / MILE) < 1e-12 and both["households"] == 9 and one["new_required"] == 0
    direct = score.components([1, 2], 0, 0.5)
    assert abs(direct["new_required"] - 410.0 / MILE) < 1e-12 and direct["corridor_completion"] == 1


def test_sweep_of_contexts_targets_and_weights(spark):
    members, done, _ = made(spark, 8, 6)
    places = spark.createDataFrame(lattice(8, 6)[1], "node long, x double, y double")
    facts = cluster_search.in_contexts(members, {"empty": done.limit(0), "some": done, "all": members.select("segment_id")}, places)
    kinds = {"usual": missions.ROUTE_WEIGHTS, "homes": {**missions.ROUTE_WEIGHTS, "households": 5.0}}
    rows = cluster_search.sweep(facts, spark.createDataFrame([(0,), (14,), (None,), (777,)], "start long"), [0.5, 1.5], kinds, seeds=2, most=2)
    got = {(r.start, r.target, r.context, r.weighting): r for r in rows.collect()}
    assert len(got) == 3 * 2 * 3 * 2
    assert not any(r.available for k, r in got.items() if k[0] == 777 or k[2] == "all")
    assert all(got[s, 1.5, c, "usual"].available for s in (0, 14) for c in ("empty", "some"))
    one = cluster_search.best_of_clusters(cluster_search.cluster_routes(facts.where("context = 'some'").drop("context"), spark.createDataFrame([(14, 1.5)], "start long, target double"), 2, 2)).toPandas()
    assert abs(one["score"].iloc[0] - got[14, 1.5, "some", "usual"].score) < 1e-9 and abs(one["length"].iloc[0] - got[14, 1.5, "some", "usual"].length) < 1e-6
    for r in got.values():
        assert not r.available or (r.length <= r.target * MILE * 1.08 + 1e-6 and r.new_miles + r.repeated_miles <= r.length / MILE + 1e-3)
    total = {(r.context, r.weighting, r.target): r for r in cluster_search.sweep_summary(rows).collect()}
    assert total["some", "usual", 1.5].starts == 3 and total["some", "usual", 1.5].available == 2 and total["all", "homes", 0.5].available == 0
    changes = cluster_search.weights_compared(rows, "usual", "homes").collect()
    assert len(changes) == sum(r.available and got[k[0], k[1], k[2], "homes"].available for k, r in got.items() if k[3] == "usual")


def test_nothing_open_gives_no_walk(spark):
    members, _, _ = made(spark, 4, 4)
    places = spark.createDataFrame(lattice(4, 4)[1], "node long, x double, y double")
    facts = cluster_search.with_facts(members, members.select("segment_id"), places)
    assert cluster_search.cluster_routes(facts, spark.createDataFrame([(0, 1.0)], "start long, target double")).count() == 0
