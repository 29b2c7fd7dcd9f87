"""Areas of unfinished work: clusters within reach, finished states for stress tests, turns of a walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.operators.graph import connected_components, shortest_distances


def clusters(edges: DataFrame, open_segs: DataFrame, home: DataFrame, budget: float, most: int = 8) -> DataFrame:
    """Best clusters of unfinished segments that share nodes: root, segs, length, homes, access, usable, score.

    ``edges`` has u, v, seg, length, households; ``open_segs`` has seg; ``home``
    has node and distance. Work farther than half the budget has no way back;
    what is usable is what the round trip leaves of the budget.
    """
    mine = edges.join(open_segs.select("seg").distinct(), "seg")
    parts = connected_components(mine, "u", "v")
    placed = mine.join(parts.select(F.col("node").alias("u"), "component"), "u")
    ends = placed.select("component", F.explode(F.array("u", "v")).alias("node")).distinct().join(home.select("node", "distance"), "node")
    access = ends.groupBy("component").agg(F.min(F.struct("distance", "node")).alias("a"))
    per = placed.groupBy("component").agg(F.count("*").alias("segs"), F.sum("length").alias("length"), F.sum("households").alias("homes")).join(access, "component")
    near = per.where(F.col("a.distance") <= budget / 2).withColumn("usable", F.least("length", F.greatest(F.lit(0.0), F.lit(budget) - 2 * F.col("a.distance")))).where("usable > 0")
    score = F.col("usable") / F.greatest(F.col("a.distance") + budget * 0.25, F.lit(1.0)) * 1000 + F.col("homes") * 0.4 + F.col("usable") * 0.01
    out = near.select(F.col("component").alias("root"), "segs", "length", "homes", F.col("a.distance").alias("access"), F.col("a.node").alias("entry"), "usable", score.alias("score"))
    return out.orderBy(F.desc("score"), "root").limit(most)


def finished_state(edges: DataFrame, share: float, seed: int = 0, spatial: bool = True) -> DataFrame:
    """(seg): segments finished when ``share`` of the whole length is.

    ``spatial`` grows from one seeded segment along shared nodes, level by
    level, each level in a seeded order, and goes on with other components;
    else the order is the seeded one alone. ``edges`` has u, v, seg, length.
    Sums by level and hash bucket find the bucket in which the share is reached,
    and only that one is put in order.
    """
    h = F.xxhash64(F.lit(seed), "seg")
    total = edges.agg(F.sum("length")).first()[0] or 0.0
    placed = edges.withColumn("_h", h)
    if spatial:
        first = placed.orderBy("_h", "seg").limit(1).select(F.explode(F.array("u", "v")).alias("node")).distinct()
        hops = shortest_distances(edges.withColumn("hop", F.lit(1).cast("long")), "u", "v", "hop", first).groupBy("node").agg(F.min("distance").alias("d"))
        at = lambda end: hops.select(F.col("node").alias(end), F.col("d").alias(f"d_{end}"))
        placed = placed.join(at("u"), "u", "left").join(at("v"), "v", "left").withColumn("_level", F.coalesce(F.least("d_u", "d_v"), F.lit(1 << 40)))
    else:
        placed = placed.withColumn("_level", F.lit(0))
    if total <= 0 or share <= 0:
        return placed.limit(0).select("seg")
    target = share * total
    placed = placed.withColumn("_b", F.shiftright("_h", 52))
    sums = placed.groupBy("_level", "_b").agg(F.sum("length").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_level", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    buckets = sums.withColumn("_before", before).where(F.col("_before") < target)
    order = Window.partitionBy("_level", "_b").orderBy("_h", "seg").rowsBetween(Window.unboundedPreceding, -1)
    some = placed.join(buckets, ["_level", "_b"]).withColumn("_last", F.col("_before") + F.col("_s") >= target)
    cut = some.where("_last").withColumn("_upto", F.col("_before") + F.coalesce(F.sum("length").over(order), F.lit(0.0))).where(F.col("_upto") < target)
    return some.where("NOT _last").select("seg").unionByName(cut.select("seg"))


def turns(steps: DataFrame, sharp: float, route: str = "route", pos: str = "pos") -> DataFrame:
    """(route, turns, uturns) from steps with seg, the headings (in_x, in_y) at their start and (out_x, out_y) at their end, and
    ``degree`` of the node at their start.

    A turn is a change of heading by more than ``sharp`` degrees where there is
    a choice (degree above 2); taking the same segment back at once is a u-turn
    unless the node is a dead end.
    """
    order = Window.partitionBy(route).orderBy(pos)
    back = F.col("seg") == F.lag("seg").over(order)
    angle = geometry.deviation(F.lag("out_x").over(order), F.lag("out_y").over(order), F.col("in_x"), F.col("in_y"))
    marked = steps.withColumn("_u", back & (F.col("degree") > 1)).withColumn("_t", ~back & (angle > sharp) & (F.col("degree") > 2))
    return marked.groupBy(route).agg(F.count_if("_t").alias("turns"), F.count_if("_u").alias("uturns"))
