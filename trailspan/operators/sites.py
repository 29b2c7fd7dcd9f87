"""Sites of many homes: their ground as a hull, the network inside and around it, how far homes are from it, and what follows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.functions.shapes import hulls
from trailspan.operators.coverage import at_index
from trailspan.operators.membership import MILE
from trailspan.operators.nearest import nearest_line
from trailspan.operators.places import ACRE_M2, CAP_M, MOSTLY_SHARE, NO_NETWORK_M, REACHABLE_SHARE, site_disposition
from trailspan.operators.polygons import points_near
from trailspan.operators.rules import reasons
from trailspan.shared import stored

# Metres around a hull that belong to a site, more of them where the hull has no ground, metres of context beyond,
# names listed for a group.
SLACK_M, THIN_M, CONTEXT_M, MOST_NAMES = 15.0, 20.0, 90.0, 8


def grounds(homes: DataFrame) -> DataFrame:
    """(site, units, hull, rim_m, slack, area_m2): each site's hull, grown by SLACK_M, and by THIN_M before that where its homes
    stand on one line or spot. The area of a convex hull grown by r is its own and r times its rim and that of a circle of r."""
    found = hulls(homes.where("site IS NOT NULL"), "site").where("hull IS NOT NULL").withColumnRenamed("n", "units")
    area = F.abs(geometry.signed_area(F.col("hull")))
    found = found.withColumn("own", area).withColumn("rim_m", geometry.length(F.col("hull")))
    slack = F.when(F.col("own") > 1e-9, SLACK_M).otherwise(SLACK_M + THIN_M)
    return found.withColumn("slack", slack).withColumn("area_m2", F.col("own") + F.col("slack") * F.col("rim_m") + math.pi * F.col("slack") ** 2).drop("own")


def site_lines(sites: DataFrame, lines: DataFrame) -> DataFrame:
    """(site, line_id, inside): lines whose midpoint is on a site's ground, or else within CONTEXT_M of it."""
    edges = sites.select(F.col("site").alias("poly_id"), F.explode(geometry.segments(F.col("hull"))).alias("s")).select("poly_id", "s.a", "s.b")
    # a hull of one place has no edge, so the place stands for itself
    spots = sites.where("rim_m = 0").select(F.col("site").alias("poly_id"), F.element_at("hull", 1).alias("a"), F.element_at("hull", 1).alias("b"))
    # written, so that a midpoint is worked out once and not for each cell that it looks into
    middle = stored(lines.select("line_id", geometry.point_at(F.col("line"), 0.5).alias("p")), "site-middles").select("line_id", "p.x", "p.y")
    near = points_near(middle, stored(edges.unionByName(spots).distinct(), "site-edges"), SLACK_M + THIN_M + CONTEXT_M, "line_id")
    placed = near.join(sites.select(F.col("site").alias("poly_id"), "slack"), "poly_id").where(F.col("distance") <= F.col("slack") + CONTEXT_M)
    return placed.select(F.col("poly_id").alias("site"), "line_id", (F.col("distance") <= F.col("slack")).alias("inside"))


def site_groups(placed: DataFrame, lines: DataFrame) -> DataFrame:
    """(site, inside, segment_type, role, access_type, segments, miles, names): what lies on and around each site, with up to
    MOST_NAMES names in order."""
    named = placed.join(lines.select("line_id", "segment_type", "role", "access_type", "display_name", geometry.length(F.col("line")).alias("m")), "line_id")
    key = ["site", "inside", "segment_type", "role", "access_type"]
    per = named.groupBy(*key).agg(F.count("*").alias("segments"), F.round(F.sum("m") / MILE, 4).alias("miles"))
    one = named.where(F.col("display_name").isNotNull()).select(*key, "display_name").distinct()
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("display_name"))
    names = one.withColumn("r", rank).where(F.col("r") <= MOST_NAMES).groupBy(*key).agg(F.array_sort(F.collect_list("display_name")).alias("names"))
    same = per["site"].eqNullSafe(names["site"])
    for c in key[1:]:
        same = same & per[c].eqNullSafe(names[c])
    return per.join(names, same, "left").select(*(per[c] for c in key), "segments", "miles", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def site_decision(units: Column, beyond: Column, network_m: Column, area_m2: Column, named: Column) -> Column:
    """struct(disposition, hold, reasons, flags): see places.site_disposition for the rule; ``named`` sites are flagged for review."""
    made = site_disposition(units, beyond, network_m, area_m2)
    share, none = beyond / units, network_m < NO_NETWORK_M
    counted = F.concat(beyond.cast("string"), F.lit(" of "), units.cast("string"), F.lit(" units ("), F.format_number(share * 100, 0), F.lit(f"%) beyond {CAP_M:.0f} m"))
    bare = F.concat(F.lit("no walkable network inside ("), F.format_number(network_m, 0), F.lit(" m on "), F.format_number(area_m2 / ACRE_M2, 1), F.lit(" acres)"))
    why = reasons([(counted, share > REACHABLE_SHARE), (bare, none & (made["hold"] == "ALL")), ("small ground that its streets serve", none & (share <= REACHABLE_SHARE))])
    flags = reasons([("NAMED_FOR_REVIEW", named), ("NO_INTERNAL_NETWORK", none), ("MOSTLY_BEYOND_CAP", share > MOSTLY_SHARE)])
    return F.struct(made["disposition"].alias("disposition"), made["hold"].alias("hold"), why.alias("reasons"), flags.alias("flags"))


def site_profiles(homes: DataFrame, lines: DataFrame, named: list[str] | None = None) -> DataFrame:
    """One row for each site of ``homes`` (home_id, site, x, y) against ``lines`` (line_id, line, segment_type, role, access_type,
    walkable): units, acres, miles inside (eligible, private, public, pedestrian), distances of its homes to the nearest eligible
    line at fixed positions and within fixed metres, units beyond the cap, and the decision with reasons and flags.

    Eligible lines are walkable required ways and connectors. Homes without a
    place or a site are in no site; a site whose homes find no eligible line at
    all is wholly beyond the cap.
    """
    sites = stored(grounds(homes), "site-grounds")
    eligible = F.col("walkable") & F.col("role").isin("REQUIRED", "OPTIONAL_CONNECTOR")
    placed = stored(site_lines(sites, lines), "site-lines")
    facts = lines.select("line_id", "segment_type", "access_type", F.coalesce(eligible, F.lit(False)).alias("eligible"), geometry.length(F.col("line")).alias("m"))
    miles = lambda c, name: F.round(F.sum(F.when(c, F.col("m")).otherwise(0.0)) / MILE, 4).alias(name)
    inner = placed.where("inside").join(facts, "line_id").groupBy("site").agg(
        F.sum(F.when(F.col("eligible"), F.col("m")).otherwise(0.0)).alias("network_m"), miles(F.col("eligible"), "eligible_miles"), miles(F.col("access_type") == "PRIVATE", "private_miles"),
        miles(F.col("access_type") == "PUBLIC", "public_miles"), miles(F.col("segment_type").isin("TRAIL", "PEDESTRIAN_CONNECTOR"), "pedestrian_miles"),
    )
    mine = homes.where("site IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select(F.col("home_id").alias("point_id"), "site", "x", "y")
    far = stored(mine.select("point_id", "site").join(nearest_line(mine, lines.where(eligible)), "point_id", "left").select("site", "distance"), "site-distances")
    within = lambda m: F.count_if(F.col("distance") <= m).alias(f"within_{m}m")
    counts = far.groupBy("site").agg(F.count("*").alias("placed_units"), *map(within, (25, 75, 150)), F.count_if(F.col("distance").isNull() | (F.col("distance") > CAP_M)).alias("beyond"), F.round(F.max("distance"), 1).alias("max_m"))
    middle = at_index(far, ["site"], "distance", {"median_m": 0.5, "p90_m": 0.9}).select("site", F.round("median_m", 1).alias("median_m"), F.round("p90_m", 1).alias("p90_m"))
    all_ = sites.select("site", "area_m2").join(counts, "site").join(middle, "site", "left").join(inner, "site", "left")
    metres = F.coalesce("network_m", F.lit(0.0))
    is_named = F.lit(False)
    for n in named or []:
        is_named = is_named | F.contains(F.lower(F.col("site").cast("string")), F.lit(n.lower()))
    made = all_.withColumn("d", site_decision(F.col("placed_units"), F.col("beyond"), metres, F.col("area_m2"), is_named))
    held = F.when(F.col("d.hold") == "ALL", F.col("placed_units")).when(F.col("d.hold") == "BEYOND_CAP_ONLY", F.col("beyond")).otherwise(0)
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("eligible_miles", "private_miles", "public_miles", "pedestrian_miles")]
    return made.select("site", F.col("placed_units").alias("units"), F.round(F.col("area_m2") / ACRE_M2, 2).alias("acres"), *zero, "median_m", "p90_m", "max_m", "within_25m", "within_75m", "within_150m", "beyond", "d.disposition", "d.hold", "d.reasons", "d.flags", held.alias("held"), (F.col("placed_units") - held).alias("associated"))
