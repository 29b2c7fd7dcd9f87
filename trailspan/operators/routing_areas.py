"""Components of a network as places to walk in: facts, separation, classes, and reports on what is cut off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspan.operators.joins import within_radius
from trailspan.operators.membership import MILE, miles
from trailspan.operators.rules import reasons
from trailspan.shared import stored

# Length that makes an area, gaps of digitising and of a missing link, and the walks on offer.
AREA_MILES, ARTEFACT_M, MISSING_M = 0.25, 30.0, 150.0
BANDS = (("Quick", 1.0), ("Short", 2.0), ("Medium", 3.5), ("Long", 5.0), ("Extended", 7.5))


def placed(segments: DataFrame, components: DataFrame, u: str = "u") -> DataFrame:
    """Segments with the component of their first end: one equi-join, whatever the number of components."""
    return segments.join(components.select(F.col("node").alias(u), "component"), u)


def facts(members: DataFrame, components: DataFrame) -> DataFrame:
    """One row for each component: nodes, segments, miles, required_miles, households, has_cycle, restricted, max_walk_miles and
    main (the one of most nodes, of ties the smallest). Only PRIVATE and GATED required segments restrict an area."""
    required = F.col("role") == "REQUIRED"
    per = placed(members, components).groupBy("component").agg(
        F.count("*").alias("segments"), F.sum("length_m").alias("m"), F.coalesce(F.sum(F.when(required, F.col("length_m"))), F.lit(0.0)).alias("rm"),
        F.coalesce(F.sum(F.when(required, F.col("households"))), F.lit(0)).alias("households"), F.count_if(required & F.col("access_type").isin("PRIVATE", "GATED")).alias("restricted"),
    )
    both = per.join(components.groupBy("component").agg(F.count("*").alias("nodes")), "component")
    top = both.agg(F.min(F.struct(-F.col("nodes"), "component")).alias("t")).select(F.col("t.component").alias("top"))
    return both.crossJoin(F.broadcast(top)).select(  # one row
        "component", "nodes", "segments", F.round(F.col("m") / MILE, 4).alias("miles"), F.round(F.col("rm") / MILE, 4).alias("required_miles"), "households",
        (F.col("segments") >= F.col("nodes")).alias("has_cycle"), (F.col("restricted") > 0).alias("restricted"), F.round(F.col("m") / MILE * 2, 3).alias("max_walk_miles"), (F.col("component") == F.col("top")).alias("main"),
    )


def separation(points: DataFrame, most: float = MISSING_M) -> DataFrame:
    """(component, gap): the least distance from a component's points (component, x, y) to another's, where it is below ``most``.
    Points of a component at one spot count once. Small distances are tried first: what is found within one is the least, so only
    components without another so near go on to the next, and no point meets all within ``most`` of it where some are nearer."""
    points = stored(points.select("component", "x", "y").where("component IS NOT NULL").distinct(), "separate")
    other = points.select(F.col("component").alias("oc"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    out, left = None, points
    for share in (1 / 256, 1 / 64, 1 / 16, 1 / 4, 1.0):
        near = within_radius(left, other.hint("merge"), "x", "y", "ox", "oy", most * share).where("component <> oc")
        found = stored(near.groupBy("component").agg(F.min("distance").alias("gap")), "separate-found")
        out = found if out is None else out.unionByName(found)
        left = left.join(found, "component", "left_anti")
        if left.isEmpty():
            break
    return out


def gap_cause(main: Column, gap: Column) -> Column:
    """What a gap means: nothing for the main component; a null gap is one of MISSING_M or more."""
    return F.when(main, "main").when(gap <= ARTEFACT_M, "untrusted link").when(gap < MISSING_M, "missing link").otherwise("apart")


def area_class(main: Column, required_miles: Column, has_cycle: Column, restricted: Column, gap: Column, max_walk_miles: Column) -> Column:
    """struct(class, in_denominator, start_allowed, reasons); ordered: main, connectors only, restricted, large enough, too small."""
    none, enough = required_miles <= 0.0005, required_miles >= AREA_MILES
    name = F.when(main, "VALID_INDEPENDENT_ROUTING_AREA").when(none, "CONNECTOR_ONLY").when(restricted, "INACCESSIBLE_OR_RESTRICTED").when(enough, "VALID_INDEPENDENT_ROUTING_AREA").otherwise("DATA_ERROR_OR_REVIEW_REQUIRED")
    valid = ~main & ~none & ~restricted & enough
    small = ~main & ~none & ~restricted & ~enough
    why = reasons([
        ("main component", main), ("no required length", ~main & none), ("required length that is not open to all", ~main & ~none & restricted),
        ("has a cycle", valid & has_cycle), ("out and back only", valid & ~has_cycle), ("cut off by an untrusted link only", valid & (gap <= ARTEFACT_M)),
        ("too small for the shortest walk", valid & (max_walk_miles < BANDS[0][1] * 0.8)), ("below the length of an area", small), ("no cycle", small & ~has_cycle),
    ])
    denominator = main | none | ~restricted
    start = main | valid
    return F.struct(name.alias("class"), denominator.alias("in_denominator"), start.alias("start_allowed"), why.alias("reasons"))


def bands_within(max_walk_miles: Column) -> Column:
    """Names of the walks that an area can hold."""
    return F.array_compact(F.array(*(F.when(max_walk_miles >= m, n) for n, m in BANDS)))


def top_names(members: DataFrame, components: DataFrame, most: int = 5) -> DataFrame:
    """(component, names): names of required segments by length, of ties the smaller; segments without a name count as one."""
    per = placed(members.where(F.col("role") == "REQUIRED"), components).groupBy("component", F.coalesce("display_name", F.lit("(unnamed)")).alias("name")).agg(F.sum("length_m").alias("m"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc(F.round("m", 3)), "name"))
    return per.withColumn("r", rank).where(F.col("r") <= most).groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("names"))


def described(main: Column, names: Column) -> Column:
    """A component's name: its first street, and the next two in brackets."""
    more = F.array_join(F.slice(names, 2, 2), ", ")
    return F.when(main, "Main network").when(F.coalesce(F.size(names), F.lit(0)) == 0, "Connector-only fragment").when(F.size(names) > 1, F.concat(names[0], F.lit(" area ("), more, F.lit(")"))).otherwise(names[0])


def area_summary(areas: DataFrame) -> DataFrame:
    """(class, components, required_miles, households, in_denominator_miles) by class."""
    return areas.groupBy("class").agg(F.count("*").alias("components"), F.round(F.sum("required_miles"), 4).alias("required_miles"), F.sum("households").alias("households"), F.round(F.sum(F.when(F.col("in_denominator"), F.col("required_miles")).otherwise(0.0)), 4).alias("in_denominator_miles"))


def connectivity(segments: DataFrame, areas: DataFrame, components: DataFrame) -> DataFrame:
    """One row: components, required miles in all and in the main one, its share, and required segments off it; required
    segments outside the network count as off."""
    main = components.join(areas.where("main").select("component"), "component", "left_semi").select(F.col("node").alias("u"), F.lit(True).alias("on"))
    rows = segments.where(F.col("role") == "REQUIRED").join(main, "u", "left")
    on = F.coalesce("on", F.lit(False))
    total, mine = F.sum("length_m"), F.sum(F.when(on, F.col("length_m")).otherwise(0.0))
    one = rows.agg(miles(total).alias("required_miles"), miles(mine).alias("main_miles"), F.round(mine / total, 4).alias("main_share"), F.count_if(~on).alias("stranded_segments"))
    return one.crossJoin(areas.agg(F.count("*").alias("components")))  # one row each


def node_degrees(members: DataFrame) -> DataFrame:
    """(node, degree, streets, incident): segments at each node and the distinct names that meet there."""
    ends = members.select(F.explode(F.array_distinct(F.array("u", "v"))).alias("node"), "display_name", "segment_id")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.array_sort(F.collect_set("display_name")).alias("streets"), F.count_distinct("segment_id").alias("incident"))


def open_neighbours(members: DataFrame, done: DataFrame) -> DataFrame:
    """(segment_id, neighbours): open required segments that share an end with each, counted at both ends."""
    open_ = members.where(F.col("role") == "REQUIRED").join(done.select("segment_id"), "segment_id", "left_anti")
    at = lambda x: x.select("segment_id", F.explode(F.array_distinct(F.array("u", "v"))).alias("node"))
    here = at(open_).groupBy("node").agg(F.count("*").alias("n"))
    own = at(members).join(here, "node", "left").join(open_.select("segment_id", F.lit(1).alias("mine")), "segment_id", "left")
    return own.groupBy("segment_id").agg(F.coalesce(F.sum(F.coalesce("n", F.lit(0)) - F.when(F.col("n").isNotNull(), F.coalesce("mine", F.lit(0))).otherwise(0)), F.lit(0)).alias("neighbours"))


def corridor_progress(members: DataFrame, done: DataFrame, covered: DataFrame) -> DataFrame:
    """(route, touched, completed): street names that a route (route, segment_id) touches, and those that it completes."""
    named = members.where((F.col("role") == "REQUIRED") & F.col("normalized_name").isNotNull())
    left = named.join(done.select("segment_id"), "segment_id", "left_anti").groupBy("normalized_name").agg(F.count("*").alias("open"))
    size = named.groupBy("normalized_name").agg(F.count("*").alias("members"))
    all_names = members.where(F.col("normalized_name").isNotNull()).select("segment_id", "normalized_name", (F.col("role") == "REQUIRED").alias("required"))
    mine = covered.select("route", "segment_id").distinct().join(all_names, "segment_id").join(done.select("segment_id", F.lit(True).alias("before")), "segment_id", "left")
    per = mine.groupBy("route", "normalized_name").agg(F.count_if(F.col("required") & F.col("before").isNull()).alias("new"))
    full = per.join(size, "normalized_name", "left").join(left, "normalized_name", "left")
    whole = F.col("members").isNotNull() & (F.col("new") == F.coalesce("open", F.lit(0)))
    return full.groupBy("route").agg(F.count("*").alias("touched"), F.count_if(whole).alias("completed"))
