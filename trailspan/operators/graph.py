"""Iterative graph operators on edge DataFrames."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from trailspan.shared import discard, shared_folder, stored, stored_at


#: Edges that a task makes stars of together, and bits of a number in which those of a neighbourhood differ.
LOCAL_EDGES, NEAR_BITS = 500_000, 16


#: Nodes that are broadcast at most.
FEW_NODES = 2_000_000
#: Sources whose distances stand beside each other in one row of a node, at most.
FEW_SOURCES = 32


def _least_together(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that these edges join it with) of every node: the larger root of an edge takes the smaller one, then
    every node its root's, until no edge has two roots."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _stars(batches: Iterator[pd.DataFrame], lone: bool) -> Iterator[pd.DataFrame]:
    """Stars (u, v = smallest node) of what LOCAL_EDGES edges at a time join; a smallest node has an edge to itself, always if
    ``lone``, or else only where nothing else names it."""

    def star(held: list[pd.DataFrame]) -> pd.DataFrame:
        some = pd.concat(held)
        node, least = _least_together(some["u"].to_numpy(), some["v"].to_numpy())
        kept = np.full(len(node), True) if lone else (node != least) | ~np.isin(node, least[node != least])
        return pd.DataFrame({"u": node[kept], "v": least[kept]})

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= LOCAL_EDGES:
            yield star(held)
            held, size = [], 0
    if held:
        yield star(held)


def _joined_nearby(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, left): a node's smallest known companion as (u, m), and the edges (u, v) among these that are still to be joined.

    Each task makes stars of its own edges; these are brought together by
    neighbourhoods of numbers and made stars again, since nodes that hang
    together often have near numbers. A hub is the end of a star, not its
    key, so no task gets all of its edges.
    """
    kind = pairs.select(F.greatest("u", "v")).schema[0].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    near = F.shiftright(F.greatest("u", "v"), NEAR_BITS)
    stars = pairs.mapInPandas(lambda it: _stars(it, False), schema).repartition(near).sortWithinPartitions(near)
    first = stored(stars.mapInPandas(lambda it: _stars(it, True), schema), "cc-stars")
    labels = stored(first.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")), "cc-labels")
    several = labels.where("m < x").select("u", "m")
    return labels.select("u", "m"), first.join(several, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of an edge list: columns ``node``, ``component``.

    Alternating large-star and small-star contraction: every round is two
    aggregations with map-side combine and two equi-joins, the number of rounds
    grows with the logarithm of the longest chain, and no adjacency list is ever
    gathered in one place. Each round's edges are a written table, counted in
    the same job, so a lost executor costs one round at most; the table of the
    round before is deleted.

    Where nodes are whole numbers, what lies together in the input or has near
    numbers is joined first (see _joined_nearby), and only what that leaves
    apart goes into the rounds.

    Null ends are ignored; self loops and repeated edges are harmless; a node
    with only a self loop is its own component; an empty list gives no rows.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    if all(isinstance(f.dataType, (IntegerType, LongType)) for f in pairs.schema):
        labels, left = _joined_nearby(pairs)
        roots = _rounds(left, max_rounds).select(F.col("node").alias("m"), "component")
        return labels.join(roots, "m", "left").select(F.col("u").alias("node"), F.coalesce("component", "m").alias("component"))
    return _rounds(pairs, max_rounds)


def _rounds(pairs: DataFrame, max_rounds: int) -> DataFrame:
    """The rounds of connected_components on edges (u, v)."""
    spark = pairs.sparkSession
    mark = [F.count_if(F.col("u") != F.col("v")).alias("n"), F.bit_xor(F.when(F.col("u") != F.col("v"), F.xxhash64("u", "v"))).alias("s")]
    told = Observation()
    first = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().observe(told, *mark), "cc-edges")
    now, path, sums = first.where("u <> v"), None, told.get
    if not sums["n"]:
        return first.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        # counted while it is written: a round is one job
        seen, before, old = Observation(), sums, path
        path = shared_folder(spark, "cc-edges")
        now = stored_at(small.observe(seen, *mark), path)
        sums = seen.get
        if old:
            discard(spark, old)
        if sums == before or not sums["n"]:
            ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            own = lambda x, k: x.select(F.col(k).alias("node"), F.col(k).alias("component"))
            return ends.unionByName(own(now, "v")).unionByName(own(first.where("u = v"), "u")).groupBy("node").agg(F.min("component").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def both_ways(edges: DataFrame, src: str, dst: str, *columns: str) -> DataFrame:
    """Every edge from both of its ends; a self loop once."""
    back = edges.where(F.col(src) != F.col(dst)).select(F.col(dst).alias("u"), F.col(src).alias("v"), *columns)
    return edges.select(F.col(src).alias("u"), F.col(dst).alias("v"), *columns).unionByName(back)


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges at each node; parallel edges count each, a self loop once."""
    return both_ways(edges, src, dst).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def component_profile(edges: DataFrame, src: str, dst: str, weight: str, components: DataFrame) -> DataFrame:
    """Nodes, edges, independent cycles (edges - nodes + 1) and weight of each component."""
    nodes = components.groupBy("component").agg(F.count("*").alias("nodes"))
    placed = edges.join(components.select(F.col("node").alias(src), "component"), src)
    per = placed.groupBy("component").agg(F.count("*").alias("edges"), F.sum(weight).alias("weight"))
    return per.join(nodes, "component").withColumn("cycles", F.col("edges") - F.col("nodes") + 1).withColumn("has_cycle", F.col("edges") >= F.col("nodes"))


def shortest_distances(edges: DataFrame, src: str, dst: str, weight: str, sources: DataFrame, max_rounds: int | None = None, within: str | None = None) -> DataFrame:
    """(source, node, distance) of every node that a source reaches, for many sources at once.

    Frontier relaxation: a round joins only the nodes whose distance has just
    dropped with their edges, and keeps the least offer of each node. Weights
    are not negative; of parallel edges the lightest counts. With weight 1 the
    distances are the levels of a breadth-first search. ``sources`` has one
    column, node; each round writes what it bettered to the shared folder, and
    the least of all rounds is taken at the end. ``within``
    names a column of ``sources``, one value a node: nodes farther than that from
    their source are left out and never searched from. A round follows one more
    edge, as many as the longest of the shortest paths has, unless
    ``max_rounds`` says when to give up. While the nodes to search from are no
    more than FEW_NODES they are broadcast, and only edges at them are shuffled;
    edges and distances are met by sorted rows, as they look small as files.
    Where there are FEW_SOURCES at most and no bounds, a round meets each edge
    once for all of them (see _from_few).
    """
    light = stored(both_ways(edges, src, dst, weight).select("u", "v", F.col(weight).alias("w")), "sssp-edges")
    kind = light.schema["w"].dataType
    if not within:
        few = [r.node for r in sources.select("node").distinct().limit(FEW_SOURCES + 1).collect()]
        if 0 < len(few) <= FEW_SOURCES:
            return _from_few(light, sources, sorted(n for n in few if n is not None), max_rounds)
    cap = [F.col(within).alias("cap")] if within else []
    keep = ["cap"] if within else []
    best = stored(sources.select(F.col("node").alias("source"), "node", F.lit(0).cast(kind).alias("distance"), *cap).distinct(), "sssp-best")
    front = best
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        at = front.select(F.col("node").alias("u")).distinct()
        if at.count() <= FEW_NODES:
            beside = light.join(F.broadcast(at), "u", "left_semi")
        else:
            beside = light
        offers = front.join(beside.hint("merge"), front["node"] == beside["u"]).select("source", F.col("v").alias("node"), (F.col("distance") + F.col("w")).cast(kind).alias("offer"), *keep)
        if within:
            offers = offers.where("offer <= cap")
        offers = offers.groupBy("source", "node").agg(F.min("offer").alias("offer"), *(F.min(c).alias(c) for c in keep))
        known = best.select("source", "node", "distance")
        worse = (offers["source"] == known["source"]) & (offers["node"] == known["node"]) & (known["distance"] <= offers["offer"])
        front = stored(offers.join(known.hint("merge"), worse, "left_anti").select("source", "node", F.col("offer").alias("distance"), *keep), "sssp-front")
        if front.isEmpty():
            return best.groupBy("source", "node").agg(F.min("distance").alias("distance"))
        best = best.unionByName(front)
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")


def _from_few(light: DataFrame, sources: DataFrame, few: list, max_rounds: int | None) -> DataFrame:
    """shortest_distances of a few sources: a row is a node with its distances from all of them, so that an edge is met once a round
    and a node gets one offer from each task. A round goes on from the nodes of which it bettered any distance."""
    spark, kind, told = light.sparkSession, light.schema["w"].dataType, Observation()
    each = [f"d{i}" for i in range(len(few))]
    marks = [F.when(F.col("node") == F.lit(n), F.lit(0).cast(kind)).alias(d) for n, d in zip(few, each)]
    path = shared_folder(spark, "sssp-known")
    now = sources.where("node IS NOT NULL").select("node").distinct().select("node", *marks, F.lit(True).alias("better"))
    known, size = stored_at(now.observe(told, F.count_if("better").alias("n")), path), len(few)
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        front = known.where("better").drop("better")
        beside = light.join(F.broadcast(front.select(F.col("node").alias("u"))), "u", "left_semi") if size <= FEW_NODES // 10 else light
        offers = front.join(beside.hint("merge"), front["node"] == beside["u"]).groupBy(F.col("v").alias("node")).agg(*(F.min((F.col(d) + F.col("w")).cast(kind)).alias(f"o{d}") for d in each))
        both = known.drop("better").join(offers.hint("merge"), "node", "full")
        better = F.lit(False)
        for d in each:
            better |= F.coalesce(F.col(f"o{d}") < F.col(d), F.col(f"o{d}").isNotNull())
        told, old = Observation(), path
        path = shared_folder(spark, "sssp-known")
        made = both.select("node", *(F.least(d, f"o{d}").alias(d) for d in each), better.alias("better"))
        known = stored_at(made.observe(told, F.count_if("better").alias("n")), path)
        size = told.get["n"]
        discard(spark, old)
        if not size:
            rows = F.explode(F.array(*(F.struct(F.lit(n).alias("source"), F.col(d).alias("distance")) for n, d in zip(few, each))))
            return known.select("node", rows.alias("r")).where("r.distance IS NOT NULL").select("r.source", "node", "r.distance")
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
