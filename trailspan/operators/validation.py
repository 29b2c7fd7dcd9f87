"""What a set of walks, a benchmark and a map hold in all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspan.operators.membership import MILE, affects_coverage, layer


def means_compared(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, before, after, routes_before, routes_after): means to three places over routes that have a distance_miles. Nulls
    are left out of their mean; a side without routes has null means."""

    def means(routes: DataFrame, name: str) -> DataFrame:
        # decimals, so that a mean does not depend on the order of its rows
        real = routes.where(F.col("distance_miles").isNotNull())
        mean = lambda m: F.try_divide(F.sum(F.col(m).cast("decimal(28,6)")).cast("double"), F.count(m))
        one = real.agg(F.count("*").alias("n"), *(mean(m).alias(f"_{m}") for m in metrics))
        rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(f"_{m}", 3).alias(name)) for m in metrics)))
        return one.select("n", rows.alias("r")).select("r.metric", f"r.{name}", F.col("n").alias(f"routes_{name}"))

    return means(before, "before").join(means(after, "after"), "metric")


def walk_homes(planned: DataFrame, segments: DataFrame) -> DataFrame:
    """(walk, households) of planned required segments (walk, segment_id): each counts once a walk, unknown ones not at all, and a
    walk of unknown ones alone has 0."""
    per = planned.select("walk", "segment_id").distinct().join(segments.select("segment_id", "households"), "segment_id", "left")
    return per.groupBy("walk").agg(F.coalesce(F.sum("households"), F.lit(0)).alias("households"))


def layer_stats(segments: DataFrame) -> DataFrame:
    """(layer, segments, miles) of each map layer, and of what a decision would change as layer ``review``; one pass."""
    at = layer(F.col("dataset"), F.col("role"), F.col("segment_type"))
    asked = F.coalesce(affects_coverage(F.col("role"), F.col("role_status")), F.lit(False))
    dealt = segments.select("length_m", F.explode(F.array(at, F.when(asked, "review"))).alias("layer")).where("layer IS NOT NULL")
    return dealt.groupBy("layer").agg(F.count("*").alias("segments"), F.round(F.sum("length_m") / MILE, 3).alias("miles"))


def validated(locations: DataFrame, bands: DataFrame, wanted: int = 5) -> DataFrame:
    """One row about locations (location, component, snap_m, campus, reaches_both) and their bands (location, band, available,
    coherent): how many there are, stand in component 0, have no band or all ``wanted``, the number of components, the farthest
    snap, the share of available bands that are coherent loops, and campus starts that reach both sides. A location without
    bands has none available."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    per = bands.groupBy("location").agg(F.count_if(yes("available")).alias("open"), F.count_if(yes("available") & yes("coherent")).alias("loops"))
    rows = locations.join(per, "location", "left").withColumns({"open": F.coalesce("open", F.lit(0)), "loops": F.coalesce("loops", F.lit(0))})
    return rows.agg(
        F.count("*").alias("locations"), F.count_if(F.col("component") == 0).alias("landed_in_main"), F.count_distinct("component").alias("components"), F.max("snap_m").alias("max_snap_m"),
        F.count_if(F.col("open") == 0).alias("without_route"), F.count_if(F.col("open") == wanted).alias("with_all"),
        F.round(F.coalesce(F.sum("loops"), F.lit(0)) / F.greatest(F.coalesce(F.sum("open"), F.lit(0)), F.lit(1)), 3).alias("coherent_loop_rate"), F.count_if(yes("campus") & yes("reaches_both")).alias("campus_reaching_both"),
    )


def only_dead_ends_left(segments: DataFrame) -> DataFrame:
    """(segment_id) of a state in which all that is required is done but dead ends: segments (segment_id, u, v, role), of which one
    is a dead end if a node of it has no other segment. A loop at one node is none."""
    ends = segments.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).where("degree = 1")
    required = segments.where(F.col("role") == "REQUIRED")
    # a node of degree 1 has one segment, so this join keeps a row an end
    stubs = segments.select("segment_id", F.explode(F.array("u", "v")).alias("node")).join(ends, "node", "left_semi")
    return required.select("segment_id").join(stubs.select("segment_id"), "segment_id", "left_anti")
