"""Missions from end to end: clusters, starts, walks, scores and a slate of different places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspan.operators import search, slates
from trailspan.operators.coverage import slate
from trailspan.operators.graph import connected_components
from trailspan.operators.membership import MILE
from trailspan.operators.missions import mission_score, starts_wanted
from trailspan.operators.routing_areas import node_degrees
from trailspan.shared import stored

# Clusters and walks tried for a slate, least new length, and what makes missions different enough.
MOST_CLUSTERS, MOST_WALKS, LEAST_NEW, TOLERANCE, OVERLAP = 8, 26, 0.1, 0.70, 0.35


def cluster_starts(members: DataFrame, done: DataFrame, nodes: DataFrame, budget: float) -> DataFrame:
    """(cluster, start, miles) of the best clusters for a budget (miles): junctions spread over each, MOST_WALKS in all.

    ``members`` are segments (segment_id, u, v, length_m, households, role,
    display_name), ``nodes`` (node, lon, lat). Dead ends are no starts. The
    numbers of clusters and walks are the feature's own limits, as a slate is
    for one person to read.
    """
    clusters = slates.open_clusters(members, done).withColumn("score", slates.cluster_score(F.col("miles"), F.col("value"), budget))
    best = clusters.orderBy(F.desc("score"), "cluster").limit(MOST_CLUSTERS).withColumn("wanted", starts_wanted(F.col("miles") / max(budget, 0.01)))
    open_ = members.where(F.col("role") == "REQUIRED").join(done.select("segment_id"), "segment_id", "left_anti")
    parts = connected_components(open_, "u", "v").select("node", F.col("component").alias("cluster"))
    junctions = node_degrees(members).where("degree >= 2").select("node", slates.start_score(F.col("degree"), F.col("streets")).alias("start_score"))
    at = parts.join(F.broadcast(best), "cluster").join(junctions, "node").join(nodes, "node")  # MOST_CLUSTERS rows
    at = stored(at.select("cluster", "node", F.col("start_score").alias("score"), "lon", "lat", "wanted", "miles", F.col("score").alias("rank")), "mission-starts")
    few, many = slates.spread(at.where("wanted <= 4"), "cluster", 4), slates.spread(at.where("wanted > 4"), "cluster", 14)
    chosen = few.unionByName(many).join(at.select("cluster", "wanted", "miles", "rank").distinct(), "cluster").where("pos <= wanted")
    return chosen.orderBy(F.desc("rank"), "cluster", "pos").limit(MOST_WALKS).select("cluster", F.col("node").alias("start"), "miles")


def discovered(members: DataFrame, done: DataFrame, nodes: DataFrame, held: DataFrame, budget: float, size: int = 5, seeds: int = 4) -> DataFrame:
    """(rank, start, score, cluster, new_miles, homes, miles, completes) of up to ``size`` missions for a budget of miles.

    A mission's score counts new length, homes, fit to the budget and what
    others hold; later ones reach TOLERANCE of the best and share no more than
    OVERLAP of the smaller coverage with one taken before. No open cluster gives
    no rows.
    """
    starts = stored(cluster_starts(members, done, nodes, budget), "mission-walks")
    open_ = members.where(F.col("role") == "REQUIRED").join(done.select("segment_id"), "segment_id", "left_anti")
    edges = members.select("u", "v", F.col("segment_id").alias("seg"), F.col("length_m").alias("length"))
    want = open_.select("u", "v", F.col("segment_id").alias("seg"), F.col("length_m").alias("length"), (F.col("length_m") + F.col("households") * 6.0).alias("prize"))
    asked = starts.select("start").distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("budget", F.lit(budget * MILE))
    steps = stored(search.routes(edges, want, asked), "mission-steps")
    best = search.best_routes(steps, edges.select("seg", "length").join(want.select("seg", F.lit(True).alias("wanted")), "seg", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False))))
    mine = steps.join(best.select("start", "seed"), ["start", "seed"], "left_semi").select("start", "seg").distinct()
    facts = mine.join(open_.select(F.col("segment_id").alias("seg"), "length_m", "households"), "seg").join(held.select(F.col("segment_id").alias("seg"), F.lit(1).alias("h")).distinct(), "seg", "left")
    per = facts.groupBy("start").agg(F.sum("length_m").alias("m"), F.sum("households").alias("homes"), F.collect_set("seg").alias("segs"), (F.count("h") / F.count("*")).alias("held_share"))
    scored = per.join(best.select("start", "length"), "start").join(starts, "start").withColumn("new_miles", F.round(F.col("m") / MILE, 3)).withColumn("walked", F.col("length") / MILE)
    score = mission_score(F.col("new_miles"), F.col("homes"), F.col("walked"), F.lit(budget), F.lit(None).cast("double"), F.col("held_share"))
    one = Window.partitionBy("start").orderBy("cluster")
    scored = stored(scored.where(F.col("new_miles") >= LEAST_NEW).withColumn("score", F.round(score, 6)).withColumn("_one", F.row_number().over(one)).where("_one = 1").withColumn("all", F.lit(1)), "missions")
    chosen = slate(scored, "all", "start", "score", "segs", size, TOLERANCE, OVERLAP)
    return chosen.select("rank", "start", "score").join(scored.select("start", "cluster", "new_miles", "homes", F.round("walked", 3).alias("miles"), (F.col("new_miles") >= F.col("miles") - slates.WHOLE_MILES).alias("completes")), "start")
