"""Closed walks by clusters of unfinished work: the best few clusters of each start are searched on their own, and what a search
maximises is the whole score of the route."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspan.operators.graph import connected_components
from trailspan.operators.joins import within_radius
from trailspan.operators.membership import MILE
from trailspan.operators.missions import ROUTE_WEIGHTS
from trailspan.operators.routing_areas import node_degrees, open_neighbours
from trailspan.operators.search import SLACK, Leg, Paths, Planner
from trailspan.shared import stored

# Clusters tried, seeds of each, share by which a walk may pass its target, radians of a sharp turn.
MOST_CLUSTERS, SEEDS, TOLERANCE, SHARP = 5, 4, 0.08, 1.05
#: The cluster number of a search among all open segments in reach.
EVERYWHERE = -1


class RouteScore:
    """The score of a walk, from facts of its segments: see missions.route_facts and missions.route_components, which give the same
    from the steps of many walks at once."""

    def __init__(self, edges: pd.DataFrame, start: int):
        self.start = start
        cols = ["length", "required", "open", "households", "dead_end", "derived", "stress", "isolated", "corridor", "corridor_open", "u", "v"]
        self.facts = dict(zip(edges["seg"].tolist(), edges[cols].itertuples(index=False)))
        ends = [(e.u, e.ux, e.uy, e.du) for e in edges.itertuples()] + [(e.v, e.vx, e.vy, e.dv) for e in edges.itertuples()]
        self.at = {n: (x, y) for n, x, y, _ in ends}
        self.degree = {n: d for n, _, _, d in ends}
        self.credits: dict[int, list[tuple[int, float, float, int]]] = {s: c for s, c in zip(edges["seg"].tolist(), edges["credits"].tolist()) if c is not None and len(c)}

    def turns(self, segs: list[int]) -> tuple[int, int]:
        """(turns, u-turns): taking a segment back counts where there is another way, a sharp change of heading where there is a
        choice."""
        turns = uturns = 0
        here, heading, before = self.start, None, None
        for s in segs:
            f = self.facts[s]
            there = f.v if here == f.u else f.u
            (ax, ay), (bx, by) = self.at[here], self.at[there]
            new = (bx - ax, by - ay)
            if s == before:
                uturns += self.degree[here] > 1
            elif heading is not None and self.degree[here] > 2:
                size = math.hypot(*heading) * math.hypot(*new)
                if size > 0 and math.acos(max(-1.0, min(1.0, (heading[0] * new[0] + heading[1] * new[1]) / size))) > SHARP:
                    turns += 1
            here, heading, before = there, new, s
        return turns, uturns

    def cohesion(self, once: Iterable[int]) -> float:
        """Covered length against the diagonal of its ground, at most 1."""
        once = list(once)
        points = [self.at[n] for s in once for n in (self.facts[s].u, self.facts[s].v)]
        if len(points) < 3:
            return 1.0
        x, y = zip(*points)
        diagonal = math.hypot(max(x) - min(x), max(y) - min(y))
        return min(1.0, sum(self.facts[s].length for s in once) / diagonal / 4) if diagonal > 1 else 1.0

    def components(self, segs: list[int], closing: int, target: float) -> dict[str, float]:
        """What ROUTE_WEIGHTS weigh, for segments in order, the last ``closing`` of which lead home, and a target in miles."""
        out = dict.fromkeys(ROUTE_WEIGHTS, 0.0)
        passes: Counter[int] = Counter()
        total = repeated = 0.0
        new: dict[int, int] = {}
        for i, s in enumerate(segs):
            f = self.facts[s]
            miles = f.length / MILE
            passes[s] += 1
            total += miles
            if passes[s] > 1:
                repeated += miles
                kind = "repeat_dead_end" if f.dead_end else "repeat_closing" if i >= len(segs) - closing else "repeat_avoidable"
                out[kind] += miles
                out["repeat_extra_traversal"] += passes[s] > 2
                continue
            if f.open:
                new[s] = f.corridor
                out["new_required"] += miles
                out["households"] += f.households
                out["dead_end_completion"] += bool(f.dead_end)
                out["isolation"] += bool(f.isolated)
            if not f.required:
                out["connector"] += miles
            out["derived_connector"] += bool(f.derived)
            out["stress"] += miles * (f.stress - 1) / 4
        earned: dict[int, list[float]] = {}
        for s in passes:
            for to, share, needed, length, households, corridor in self.credits.get(s, ()):
                earned.setdefault(to, [0.0, needed, length, households, corridor])[0] += share
        for to, (share, needed, length, households, corridor) in earned.items():
            if share >= needed and to not in passes:
                new[to] = corridor
                out["new_required"] += length / MILE
                out["households"] += households
        left = {f.corridor: f.corridor_open for f in (self.facts[s] for s in passes) if f.corridor >= 0}
        done = Counter(c for c in new.values() if c >= 0)
        out["corridor_completion"] = float(sum(n == left.get(c) for c, n in done.items()))
        share = repeated / total if total else 0.0
        out["repeat_share"] = share * share * min(total / 3.5, 2.0)
        out["repeat_avoidable"] *= math.sqrt(target / 2.0) if target else 1.0
        out["turns"], out["uturns"] = map(float, self.turns(segs))
        out["cohesion"] = self.cohesion(passes)
        off = (total - target) / target if target else 0.0
        out["length_overshoot"], out["length_undershoot"] = max(0.0, off), max(0.0, -off)
        out["loop_shape"] = len(passes) / len(segs) if segs else 0.0
        return out

    def of(self, segs: list[int], closing: int, target: float, weights: Mapping[str, float] = ROUTE_WEIGHTS) -> float:
        return sum(weights.get(k, 0.0) * v for k, v in self.components(segs, closing, target).items())


class ScoredPlanner(Planner):
    """A planner whose local search goes by the route's score; a walk of nothing is worth less than any other."""

    def __init__(self, paths: Paths, wanted: pd.DataFrame, start: int, budget: float, score: RouteScore, target: float, weights: Mapping[str, float] = ROUTE_WEIGHTS):
        super().__init__(paths, wanted, start, budget)
        self.score, self.target, self.weights = score, target, weights

    def value(self, legs: list[Leg]) -> tuple[float, float, frozenset[int]]:
        segs, closing = self.walk(legs)
        worth = self.score.of(segs, closing, self.target, self.weights) if segs else -1e18
        return worth, sum(self.size[s] for s in segs), frozenset(s for s in set(segs) if s in self.wanted)


def searched(paths: Paths, wanted: pd.DataFrame, start: int, target: float, score: RouteScore, seeds: int, plain: bool, weights: Mapping[str, float] = ROUTE_WEIGHTS) -> tuple[float, int, list[int], int] | None:
    """(score, seed, segments, closing) of the best seed; None where no walk fits. ``plain`` walks are first improved as search.routes
    improves them, so that none of those scores more."""
    budget = target * MILE * (1 + TOLERANCE)
    planner = ScoredPlanner(paths, wanted, start, budget, score, target, weights)
    found = []
    for seed in range(seeds):
        rng = np.random.default_rng(seed)
        legs = planner.construct(budget, rng) or []
        if plain:
            legs = Planner.improve(_Plain(planner), legs, budget, rng)
        if legs:
            legs = planner.improve(legs, budget, rng)
            segs, closing = planner.walk(legs)
            found.append((-planner.value(legs)[0], seed, segs, closing))
    if not found:
        return None
    best = min(found, key=lambda f: f[:2])
    return -best[0], *best[1:]


class _Plain:
    """A planner's moves and walks under the measure of search.routes."""

    def __init__(self, planner: Planner):
        self.planner = planner
        self.moves, self.walk, self.size, self.wanted = planner.moves, planner.walk, planner.size, planner.wanted

    def value(self, legs: list[Leg]) -> tuple[float, float, frozenset[int]]:
        return Planner.value(self, legs)


FACTS = "u, v, seg, length, required, open, households, dead_end, derived, stress, isolated, corridor, corridor_open, ux, uy, vx, vy, du, dv, credits".split(", ")


def with_facts(members: DataFrame, done: DataFrame, nodes: DataFrame, credits: DataFrame | None = None) -> DataFrame:
    """Segments with what a route's score needs (FACTS) and ``cluster``, the component of open segments that they belong to, null for
    others; ``cluster_length`` and ``cluster_homes`` are of the whole cluster.

    ``members`` has segment_id, u, v, length_m, role, households, display_name,
    normalized_name, dead_end, derived, stress; ``done`` segment_id; ``nodes``
    node, x, y; ``credits`` segment_id, to_segment, share, needed: walking the
    one earns a share of the other.
    """
    open_ = members.where(F.col("role") == "REQUIRED").join(done.select("segment_id"), "segment_id", "left_anti")
    open_ = stored(open_.select("segment_id", "u", "v", "length_m", "households", "normalized_name"), "cluster-open")
    parts = connected_components(open_, "u", "v")
    placed = stored(open_.join(parts.select(F.col("node").alias("u"), F.col("component").alias("cluster")), "u").select("segment_id", "cluster", "length_m", "households"), "cluster-placed")
    per = placed.groupBy("cluster").agg(F.sum("length_m").alias("cluster_length"), F.sum("households").alias("cluster_homes"))
    left = open_.where(F.col("normalized_name").isNotNull()).groupBy("normalized_name").agg(F.count("*").alias("corridor_open"))
    degree = node_degrees(members).select("node", "degree")
    around = open_neighbours(members, done).select("segment_id", (F.col("neighbours") <= 1).alias("isolated"))
    at = nodes.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(degree, "node")
    end = lambda k: at.select(F.col("node").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"), F.col("degree").cast("long").alias(f"d{k}"))
    name = F.when(F.col("normalized_name").isNotNull(), F.abs(F.xxhash64("normalized_name"))).otherwise(-1)
    out = members.join(placed.select("segment_id", "cluster"), "segment_id", "left").join(per, "cluster", "left").join(left, "normalized_name", "left").join(around, "segment_id", "left").join(end("u"), "u").join(end("v"), "v")
    if credits is None:
        out = out.withColumn("credits", F.expr("CAST(NULL AS array<struct<to:bigint,share:double,needed:double,length:double,households:bigint,corridor:bigint>>)"))
    else:
        earns = credits.join(open_.select(F.col("segment_id").alias("to_segment"), F.col("length_m").cast("double").alias("length"), F.col("households").cast("long").alias("households"), name.alias("corridor")), "to_segment")
        item = F.struct(F.col("to_segment").alias("to"), F.col("share").cast("double"), F.col("needed").cast("double"), "length", "households", "corridor")
        out = out.join(earns.groupBy("segment_id").agg(F.array_sort(F.collect_list(item)).alias("credits")), "segment_id", "left")
    return out.select(
        "u", "v", F.col("segment_id").alias("seg"), F.col("length_m").cast("double").alias("length"), (F.coalesce("role", F.lit("")) == "REQUIRED").alias("required"), F.col("cluster").isNotNull().alias("open"),
        F.coalesce("households", F.lit(0)).cast("long").alias("households"), F.coalesce("dead_end", F.lit(False)).alias("dead_end"), F.coalesce("derived", F.lit(False)).alias("derived"),
        F.coalesce(F.col("stress").cast("double"), F.lit(1.0)).alias("stress"), F.coalesce("isolated", F.lit(False)).alias("isolated"), name.alias("corridor"), F.coalesce("corridor_open", F.lit(0)).alias("corridor_open"),
        "ux", "uy", "vx", "vy", "du", "dv", "credits", "cluster", "cluster_length", "cluster_homes",
    )


def _frames(parts: pd.DataFrame) -> tuple[Paths, pd.DataFrame]:
    parts = parts.sort_values(["seg", "u", "v"], kind="stable")
    return Paths(parts[["u", "v", "seg", "length"]]), parts


def in_reach(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """``facts`` among the nodes within half of each start's largest budget on a straight line, as (start, ...). A segment is never
    shorter than the straight line between its ends, so no walk within the budget leaves this."""
    at = facts.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct(F.col("v").alias("node"), F.col("vx").alias("x"), F.col("vy").alias("y")))).alias("n")).select("n.*").distinct()
    at = stored(at, "cluster-nodes")
    most = asked.groupBy("start").agg((F.max("target") * (MILE * (1 + TOLERANCE) / 2) * (1 + SLACK)).alias("half"))
    centres = stored(most.join(at.select(F.col("node").alias("start"), F.col("x").alias("sx"), F.col("y").alias("sy")), "start"), "cluster-starts")
    far = centres.agg(F.max("half")).first()[0] or 1.0
    near = stored(within_radius(at, centres, "x", "y", "sx", "sy", far).where("distance <= half").select("start", "node"), "cluster-reach")
    end = lambda k: near.select("start", F.col("node").alias(k))
    return facts.join(end("u"), "u").join(end("v"), ["start", "v"])


def cluster_routes(facts: DataFrame, starts: DataFrame, seeds: int = SEEDS, most: int = MOST_CLUSTERS, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Steps (start, target, context, weighting, cluster, seed, score, length, pos, seg, closing) of one closed walk for each start
    (start, target in miles), each set of ``weights`` by its name, and each of the ``most`` best clusters, and one for all clusters
    together (EVERYWHERE); see with_facts.

    ``facts`` may have a column ``context`` (see in_contexts): then there is a
    walk for each context too. A cluster is worth what the round trip to it
    leaves of the budget, by the distance to it, its homes and that ground
    itself; those whose nearest end is farther than half the budget are left
    out. Walks come home within the target and TOLERANCE more. Starts without
    open segments in reach, or that are no node, have no rows. Every (start,
    context, cluster) is a task group of its own: the segments in reach of the
    start's largest target, and the ways found on them, serve all its targets and
    weights.
    """
    kinds = {k: dict(v) for k, v in (weights or {"": ROUTE_WEIGHTS}).items()}
    facts = facts if "context" in facts.columns else facts.withColumn("context", F.lit(""))
    asked = stored(starts.select(F.col("start").cast("long").alias("start"), F.col("target").cast("double").alias("target")).where("start IS NOT NULL AND target > 0").distinct(), "cluster-asked")
    near = stored(in_reach(facts, asked), "cluster-near")

    def entries(mine: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(mine) and len(parts):
            start = int(mine["start"].iloc[0])
            for context, some in parts.groupby("context"):
                paths, some = _frames(some)
                dist, _ = paths.of(start)
                ends = pd.concat([some[["cluster", k]].rename(columns={k: "node"}) for k in "uv"]).dropna()
                ends["access"] = ends["node"].map(dist)
                least = ends.dropna().groupby("cluster")["access"].min()
                rows += [(start, t, context, int(c), float(d)) for t in mine["target"] for c, d in least.items()]
        return pd.DataFrame(rows, columns=["start", "target", "context", "cluster", "access"])

    reach = asked.groupBy("start").cogroup(near.select("start", "context", "u", "v", "seg", "length", "cluster").groupBy("start")).applyInPandas(entries, "start long, target double, context string, cluster long, access double")
    sizes = near.where("open").select("context", "cluster", "cluster_length", "cluster_homes").distinct()
    budget = F.col("target") * MILE * (1 + TOLERANCE)
    usable = F.least("cluster_length", F.greatest(F.lit(0.0), budget - 2 * F.col("access")))
    worth = usable / F.greatest(F.col("access") + budget * 0.25, F.lit(1.0)) * 1000 + F.col("cluster_homes") * 0.4 + usable * 0.01
    ranked = reach.join(sizes, ["context", "cluster"]).where((F.col("access") <= budget / 2) & (usable > 0)).withColumn("worth", worth)
    rank = F.row_number().over(Window.partitionBy("start", "target", "context").orderBy(F.desc("worth"), "cluster"))
    best = stored(ranked.withColumn("r", rank).where(F.col("r") <= most).select("start", "target", "context", "cluster"), "cluster-picked")
    picked = stored(best.unionByName(best.select("start", "target", "context").distinct().withColumn("cluster", F.lit(EVERYWHERE).cast("long"))), "cluster-all")
    key = ["start", "context", "cluster"]
    mine = picked.select(*(F.col(c).alias(f"p_{c}") for c in key)).distinct()
    given = near.select(F.col("start").alias("p_start"), F.col("context").alias("p_context"), *FACTS, F.col("cluster").alias("own")).join(mine, ["p_start", "p_context"])
    schema = "start long, target double, context string, weighting string, cluster long, seed int, score double, length double, pos int, seg long, closing boolean"

    def run(mine: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        frames = [pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])]
        if len(mine) and len(parts):
            start, context, cluster = int(mine["start"].iloc[0]), mine["context"].iloc[0], int(mine["cluster"].iloc[0])
            paths, parts = _frames(parts)
            wanted = parts[parts["open"] & ((parts["own"] == cluster) | (cluster == EVERYWHERE))].assign(prize=lambda w: w["length"])
            score, size = RouteScore(parts, start), dict(zip(parts["seg"].tolist(), parts["length"].tolist()))
            for target in sorted(mine["target"].tolist(), reverse=True):
                for name, kind in kinds.items():
                    found = searched(paths, wanted, start, target, score, seeds, cluster == EVERYWHERE, kind)
                    if found:
                        worth, seed, segs, closing = found
                        made = {"start": start, "target": target, "context": context, "weighting": name, "cluster": cluster, "seed": seed, "score": worth, "length": float(sum(size[s] for s in segs))}
                        frames.append(pd.DataFrame({**made, "pos": np.arange(len(segs), dtype=np.int32), "seg": np.array(segs, np.int64), "closing": np.arange(len(segs)) >= len(segs) - closing}))
        return pd.concat(frames[1:] or frames)

    return picked.groupBy(*key).cogroup(given.groupBy(*(f"p_{k}" for k in key))).applyInPandas(run, schema)


def best_of_clusters(steps: DataFrame) -> DataFrame:
    """The steps of the best walk of each start, target, context and weighting, by score; ties go to the smaller cluster. They are
    read twice, so they are written first."""
    key, steps = ["start", "target", "context", "weighting"], stored(steps, "cluster-steps")
    heads = steps.groupBy(*key, "cluster").agg(F.first("score").alias("s"))
    first = Window.partitionBy(*key).orderBy(F.desc("s"), "cluster")
    best = heads.withColumn("r", F.row_number().over(first)).where("r = 1").select(*key, "cluster")
    return steps.join(best, [*key, "cluster"])


def in_contexts(members: DataFrame, done: Mapping[str, DataFrame], nodes: DataFrame, credits: DataFrame | None = None) -> DataFrame:
    """with_facts for each of a few states of the town, by name: what is finished (segment_id) in each."""
    out = None
    for name, some in done.items():
        facts = with_facts(members, some, nodes, credits).withColumn("context", F.lit(name))
        out = facts if out is None else out.unionByName(facts)
    if out is None:
        raise ValueError("no contexts")
    return out


def sweep(facts: DataFrame, starts: DataFrame, targets: list[float], weights: Mapping[str, Mapping[str, float]] | None = None, seeds: int = SEEDS, most: int = MOST_CLUSTERS) -> DataFrame:
    """One row for every start, target, context and weighting: available, cluster, score, length, new_miles and repeated_miles of the
    best walk, which are null where there is none. All are searched in one job."""
    contexts = facts.select("context").distinct() if "context" in facts.columns else facts.sparkSession.createDataFrame([("",)], "context string")
    places = starts.select(F.col("start").cast("long").alias("start")).where("start IS NOT NULL").distinct()
    asked = places.select("start", F.explode(F.array(*(F.lit(float(t)) for t in targets))).alias("target"))
    steps = stored(best_of_clusters(cluster_routes(facts, asked, seeds, most, weights)), "sweep-steps")
    facts = facts if "context" in facts.columns else facts.withColumn("context", F.lit(""))
    key = ["start", "target", "context", "weighting"]
    again = F.row_number().over(Window.partitionBy(*key, "seg").orderBy("pos")) > 1
    walked = steps.join(facts.select("context", "seg", F.col("length").alias("size"), "open"), ["context", "seg"]).withColumn("again", again)
    miles = lambda c: F.round(F.sum(F.when(c, F.col("size")).otherwise(0.0)) / MILE, 4)
    per = walked.groupBy(*key).agg(F.first("cluster").alias("cluster"), F.first("score").alias("score"), F.first("length").alias("length"), miles(F.col("open") & ~F.col("again")).alias("new_miles"), miles(F.col("again")).alias("repeated_miles"))
    names = F.explode(F.array(*map(F.lit, weights or {"": None})))
    every = asked.withColumn("weighting", names).join(F.broadcast(contexts), F.lit(True))  # a few contexts, by name
    return every.join(per, key, "left").select(*key, F.col("cluster").isNotNull().alias("available"), "cluster", "score", "length", "new_miles", "repeated_miles")


def sweep_summary(rows: DataFrame) -> DataFrame:
    """(context, weighting, target): starts, available, and means over the available walks; see sweep."""
    mean = lambda c: F.round(F.avg(c), 3).alias(f"mean_{c}")
    return rows.groupBy("context", "weighting", "target").agg(F.count("*").alias("starts"), F.count_if("available").alias("available"), *map(mean, ("score", "new_miles", "repeated_miles")))


def weights_compared(rows: DataFrame, old: str, new: str) -> DataFrame:
    """(start, target, context) and the differences new less old in new, repeated and all miles, of walks that both weightings have."""
    key = ["start", "target", "context"]
    some = lambda w, tag: rows.where((F.col("weighting") == w) & F.col("available")).select(*key, *(F.col(c).alias(f"{c}_{tag}") for c in ("new_miles", "repeated_miles", "length")))
    both = some(old, "old").join(some(new, "new"), key)
    return both.select(*key, *(F.round(F.col(f"{c}_new") - F.col(f"{c}_old"), 4).alias(f"{c}_change") for c in ("new_miles", "repeated_miles", "length")))
