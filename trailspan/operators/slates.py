"""Missions: clusters worth a walk, places to start in, and what is said about a mission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspan.operators.graph import connected_components
from trailspan.operators.membership import MILE
from trailspan.shared import stored

# Fixed values.
LEAST_CLUSTER_MILES, WHOLE_MILES = 0.15, 0.05
METRES_PER_LON, METRES_PER_LAT = 88_800.0, 111_320.0


def open_clusters(members: DataFrame, done: DataFrame) -> DataFrame:
    """(cluster, segment_id) and their facts in one table: open required segments that hang together by shared ends, where a
    cluster has LEAST_CLUSTER_MILES or more; cluster, miles, value and segments of each."""
    open_ = members.where(F.col("role") == "REQUIRED").join(done.select("segment_id"), "segment_id", "left_anti")
    parts = connected_components(open_, "u", "v")
    placed = open_.join(parts.select(F.col("node").alias("u"), F.col("component").alias("cluster")), "u")
    per = placed.groupBy("cluster").agg(F.round(F.sum("length_m") / MILE, 6).alias("miles"), F.sum("households").alias("value"), F.count("*").alias("segments"))
    return per.where(F.col("miles") >= LEAST_CLUSTER_MILES)


def cluster_score(miles: Column, value: Column, budget: float) -> Column:
    """How much of the budget it fills, whether it can be finished, its homes and its size."""
    fit = F.least(miles, F.lit(budget)) / max(budget, 0.01)
    return fit * 100.0 + F.when(miles <= budget * 0.95, 35.0).otherwise(0.0) + F.least(value, F.lit(1500)) * 0.05 + F.least(miles, F.lit(10.0)) * 2.0


def start_score(degree: Column, streets: Column) -> Column:
    """A junction of named streets is easiest to find."""
    n = F.size(streets)
    return degree * 2.0 + n * 3.0 + F.when(n >= 2, 4.0).otherwise(0.0)


def rough_metres(lon: Column, lat: Column, lon2: Column, lat2: Column) -> Column:
    return F.hypot((lon - lon2) * METRES_PER_LON, (lat - lat2) * METRES_PER_LAT)


def spread(candidates: DataFrame, group: str, most: int) -> DataFrame:
    """Up to ``most`` of each group's candidates (node, score, lon, lat), best first, none within 250 m (700 m where more than
    four are wanted) of one taken before; ties go to smaller nodes.

    ``most`` rounds over all candidates: each takes the best of a group that is
    far enough from all taken so far. A round is one aggregation with map-side
    combine, and what it keeps is one row a group with at most ``most`` places,
    so a group may have any number of candidates.
    """
    near = 250.0 if most <= 4 else 700.0
    kind = dict(candidates.dtypes)
    all_ = stored(candidates.select(group, "node", F.col("score").cast("double").alias("score"), "lon", "lat"), "spread-all")
    taken = all_.select(group).distinct().withColumn("chosen", F.expr(f"CAST(array() AS array<struct<pos:int,node:{kind['node']},lon:{kind['lon']},lat:{kind['lat']}>>)"))
    for pos in range(1, most + 1):
        free = ~F.exists("chosen", lambda c: rough_metres(c["lon"], c["lat"], F.col("lon"), F.col("lat")) < near)
        best = F.min(F.struct((-F.col("score")).alias("s"), "node", "lon", "lat")).alias("b")
        found = all_.join(taken, group).where(free).groupBy(group).agg(best)
        item = F.array(F.struct(F.lit(pos).alias("pos"), F.col("b.node").alias("node"), F.col("b.lon").alias("lon"), F.col("b.lat").alias("lat")))
        after = taken.join(found, group, "left").select(group, F.when(F.col("b").isNotNull(), F.concat("chosen", item)).otherwise(F.col("chosen")).alias("chosen"), F.col("b").isNotNull().alias("new"))
        after = stored(after, "spread-taken")
        taken = after.drop("new")
        if after.where("new").isEmpty():
            break
    return taken.select(group, F.explode("chosen").alias("c")).select(group, "c.pos", "c.node", "c.lon", "c.lat")


def mission_id(network: Column, start: Column, budget: Column, segments: Column) -> Column:
    """16 hex digits over the network, the start, the budget to two places and the segments in walking order."""
    return F.substring(F.sha2(F.concat(network, start.cast("string"), F.format_string("%.2f", budget.cast("double")), F.concat_ws("", segments)), 256), 1, 16)


def areas(covered: DataFrame) -> DataFrame:
    """(mission, dominant, share, second): labels by new length (mission, label, length_m); unlabelled length counts in the
    share only. Ties go to smaller names."""
    per = covered.groupBy("mission", "label").agg(F.round(F.sum("length_m"), 3).alias("m"))
    named = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct((-F.col("m")).alias("m"), "label"))))
    out = per.groupBy("mission").agg(F.sum("m").alias("total"), named.alias("l"))
    at = lambda i: F.try_element_at("l", F.lit(i))
    return out.select("mission", at(1)["label"].alias("dominant"), F.coalesce(F.round(-at(1)["m"] / F.nullif("total", F.lit(0.0)), 6), F.lit(0.0)).alias("share"), at(2)["label"].alias("second"))


def headline_streets(covered: DataFrame, most: int = 3) -> DataFrame:
    """(mission, streets): the names of most new length (mission, display_name, length_m); ties go to smaller names."""
    per = covered.where(F.col("display_name").isNotNull()).groupBy("mission", "display_name").agg(F.round(F.sum("length_m"), 3).alias("m"))
    rank = F.row_number().over(Window.partitionBy("mission").orderBy(F.desc("m"), "display_name"))
    return per.withColumn("r", rank).where(F.col("r") <= most).groupBy("mission").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "display_name"))), lambda x: x["display_name"]).alias("streets"))


def title(completes: Column, dominant: Column, share: Column, second: Column, streets: Column) -> Column:
    """Says finish only where the walk finishes the area."""
    street = F.try_element_at(streets, F.lit(1))
    return (
        F.when(completes & dominant.isNotNull(), F.concat(F.lit("Finish what is left in "), dominant)).when(completes & street.isNotNull(), F.concat(F.lit("Finish what is left around "), street))
        .when(dominant.isNotNull() & ((share >= 0.6) | second.isNull()), F.concat(F.lit("Continue through "), dominant)).when(dominant.isNotNull(), F.concat(F.lit("Walk through "), dominant, F.lit(" and "), second))
        .when(street.isNotNull(), F.concat(F.lit("Walk the streets around "), street)).otherwise("Walk through this area")
    )


def homes_line(value: Column) -> Column:
    """Never a zero."""
    return F.when(value >= 25, F.concat(F.lit("Approximately "), F.format_number(value, 0), F.lit(" households"))).when(value > 0, F.concat(F.lit("About "), value.cast("string"), F.lit(" households"))).otherwise("No homes on this route")


def start_line(streets: Column) -> Column:
    at = lambda i: F.try_element_at(streets, F.lit(i))
    return F.when(at(2).isNotNull(), F.concat(at(1), F.lit(" at "), at(2))).otherwise(F.coalesce(at(1), F.lit("the start of the route")))
