"""The gates of a build, of a candidate and of an integration as checks over their tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspan.operators.checks import Check, run_checks
from trailspan.operators.membership import MILE

UNITS = {"EPSG:6594": "metre", "EPSG:6593": "us-ft", "EPSG:4326": "degree", "EPSG:3857": "metre", "EPSG:2284": "us-ft"}


def assert_metric(crs: str, units: Mapping[str, str] = UNITS) -> str:
    """Refuses a reference system whose unit is not the metre, or is not known."""
    unit = units.get(crs)
    if unit != "metre":
        raise ValueError(f"{crs} has the unit {unit}, not metre: lengths would be wrong")
    return crs


def build_gates(segments: DataFrame, homes: DataFrame, links: DataFrame, least_homes: int = 12_000, most_homes: int = 24_000) -> DataFrame:
    """(name, passed, fatal): lengths, unique ids, keys and main segments; plausible homes and associations only warn."""
    one = segments.agg(F.count_if(F.col("length_m") <= 0.05).alias("zero"), F.count("*").alias("n"), F.count_distinct("segment_id").alias("ids"))
    two = homes.agg(F.count("*").alias("homes"), F.count_distinct("key").alias("keys"))
    three = links.agg(F.count("*").alias("links"), F.count_distinct("key").alias("linked"))
    facts = one.crossJoin(two).crossJoin(three)  # one row each
    total = lambda c: F.max(F.col(c))
    return run_checks(facts, [
        Check("no_zero_length_segments", total("zero") == 0), Check("segment_ids_unique", total("ids") == total("n")), Check("home_keys_unique", total("keys") == total("homes")),
        Check("one_main_segment_per_home", total("linked") == total("links")), Check("homes_plausible", total("homes").between(least_homes, most_homes), fatal=False),
        Check("association_rate", 1 - F.try_divide(total("links").cast("double"), total("homes")) <= 0.20, fatal=False),
    ])


def candidate_gates(segments: DataFrame, main_share: float = 0.97) -> DataFrame:
    """Of a candidate (dataset, connector_class, routable_by_default, walkable, in_campus, campus_obligation, role, length_m,
    in_main): links, campus obligations, and required length in the main component, which only warns."""
    derived = F.col("dataset") == "DERIVED"
    untrusted = derived & (F.coalesce("connector_class", F.lit("")) != "HIGH_CONFIDENCE")
    required = F.col("role") == "REQUIRED"
    share = F.try_divide(F.sum(F.when(required & F.col("in_main"), F.col("length_m")).otherwise(0.0)), F.sum(F.when(required, F.col("length_m"))))
    return run_checks(segments, [
        Check("no_unresolved_connector_routed_by_default", F.count_if(untrusted & (F.col("routable_by_default") | F.col("walkable"))) == 0),
        Check("campus_duplicate_obligations_removed", F.count_if(F.col("in_campus") & ~derived & F.col("campus_obligation").isNull()) == 0),
        Check("required_mileage_reachable", share >= main_share, fatal=False),
    ])


def integration_gates(segments: DataFrame, areas: DataFrame) -> DataFrame:
    """Alternatives are no duty of their own, the kinds of required length part it, enough areas are valid, and none is shut out
    for being cut off."""
    campus = F.coalesce(F.col("campus_obligation") == "CANONICAL", F.lit(False))
    required = F.col("role") == "REQUIRED"
    parts = required & (campus | F.col("segment_type").isin("STREET", "TRAIL"))
    a = run_checks(segments, [
        Check("alternatives_not_required", F.count_if(required & (F.col("campus_obligation") == "ALTERNATIVE")) == 0),
        Check("required_mileage_partitions", F.count_if(required & ~parts) == 0),
    ])
    valid = F.col("class") == "VALID_INDEPENDENT_ROUTING_AREA"
    b = run_checks(areas, [
        Check("valid_independent_components_supported", F.count_if(valid) >= 2),
        Check("no_public_area_excluded_for_disconnection", F.count_if((F.col("required_miles") >= 0.25) & ~F.col("restricted") & ~valid) == 0),
    ])
    return a.unionByName(b)


# Fixed values of the gates that rest on evidence: changes in percent, miles, milliseconds.
LESS_REPEAT, LEAST_COVERAGE, CAMPUS_MILES, STRANDED_MILES, INTERACTIVE_MS = -10.0, -5.0, 10.0, 2.0, 100.0
STATES = ("ROUTE_AVAILABLE", "LIMITED_LOCAL_COVERAGE", "NO_USEFUL_ROUTE_NEAR_START", "LONGER_ROUTE_REQUIRED", "SELECT_DIFFERENT_START_AREA")


def comparison_gates(compared: DataFrame) -> DataFrame:
    """Of (metric, before, after): repeats that could be avoided fell by a tenth or more, new coverage by a twentieth at most. A
    metric that is missing, or was 0, counts as unchanged; without any row the gate fails."""
    change = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.try_divide(100.0 * (F.col("after") - F.col("before")), F.col("before")))), F.lit(0.0))
    fine = (change("avoidable_repeat_miles") <= LESS_REPEAT) & (change("new_required_miles") >= LEAST_COVERAGE)
    return run_checks(compared, [Check("repeat_traversal_improved_without_coverage_loss", fine)])


def override_gates(overridden: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Some segment was overridden, and none of that normalised name is a member."""
    left = members.where(F.col("normalized_name") == name).agg(F.count("*").alias("left"))
    facts = overridden.agg(F.count("*").alias("applied")).crossJoin(left)  # one row each
    return run_checks(facts, [Check("override_applied", (F.max("applied") > 0) & (F.max("left") == 0))])


def benchmark_gates(routes: DataFrame, location: str) -> DataFrame:
    """Of routes (location, households, distance_miles, state, single_ms): the location has homes on some route, all states are
    known ones, and the median time of a route is interactive, which only warns."""
    real = F.col("distance_miles").isNotNull() & (F.col("location") == location)
    return run_checks(routes, [
        Check("location_explained", F.coalesce(F.max(F.when(real, F.col("households"))), F.lit(0)) > 0),
        Check("late_opportunity_states_defined", F.count_if(~F.coalesce(F.col("state").isin(*STATES), F.lit(False))) == 0),
        Check("performance_interactive", F.percentile("single_ms", 0.5) < INTERACTIVE_MS, fatal=False),
    ])


def promotion_gates(members: DataFrame, credits: DataFrame) -> DataFrame:
    """Of members (segment_id, role, campus_obligation, length_m) and resolved credits (alternative, canonical, found): enough
    canonical campus length is required, no alternative is, every alternative earns a canonical way, and no credit dangles."""
    required = F.col("role") == "REQUIRED"
    earns = credits.where("found").select(F.col("alternative").alias("segment_id")).distinct().withColumn("_earns", F.lit(True))
    rows = members.where(F.col("campus_obligation").isin("CANONICAL", "ALTERNATIVE")).join(earns, "segment_id", "left")
    alt, canon = F.col("campus_obligation") == "ALTERNATIVE", F.col("campus_obligation") == "CANONICAL"
    one = rows.agg(F.sum(F.when(canon & required, F.col("length_m")).otherwise(0.0)).alias("m"), F.count_if(alt & required).alias("owed"), F.count_if(alt & F.col("_earns").isNull()).alias("idle"))
    two = credits.agg(F.count_if(~F.col("found")).alias("dangling"))
    fine = (F.max("m") / MILE > CAMPUS_MILES) & (F.max("owed") == 0) & (F.max("idle") == 0) & (F.max("dangling") == 0)
    return run_checks(one.crossJoin(two), [Check("campus_promoted_without_duplicate_obligation", fine)])


def crossing_gates(crossings: DataFrame, members: DataFrame, areas: DataFrame, area: str) -> DataFrame:
    """Of crossings (segment_id, touches) catalogued for review, some touch the area, none of those is a member, and the area
    (description, class) that holds the name is valid."""
    touching = crossings.where("touches").select("segment_id").distinct()
    one = touching.agg(F.count("*").alias("n"))
    two = members.select("segment_id").join(touching, "segment_id", "left_semi").agg(F.count("*").alias("promoted"))
    three = areas.where(F.contains(F.coalesce("description", F.lit("")), F.lit(area))).agg(F.count_if(F.col("class") == "VALID_INDEPENDENT_ROUTING_AREA").alias("valid"))
    fine = (F.max("n") > 0) & (F.max("promoted") == 0) & (F.max("valid") > 0)
    return run_checks(one.crossJoin(two).crossJoin(three), [Check("crossings_catalogued_not_promoted", fine)])


def stranded_gates(members: DataFrame) -> DataFrame:
    """Of members (role, length_m, in_main): required length off the main component is within STRANDED_MILES; only warns."""
    off = F.sum(F.when((F.col("role") == "REQUIRED") & ~F.coalesce("in_main", F.lit(False)), F.col("length_m")).otherwise(0.0)) / MILE
    return run_checks(members, [Check("off_main_required_mileage_attributed", F.coalesce(off, F.lit(0.0)) <= STRANDED_MILES, fatal=False)])


def visible(frame: DataFrame, lines: list[str], signed: Column, public: bool = False) -> DataFrame:
    """Rows whose columns ``lines`` are null unless the lines are public or the row's reader is signed in; null is not signed in."""
    seen = F.lit(public) | F.coalesce(signed, F.lit(False))
    return frame.withColumns({c: F.when(seen, F.col(c)) for c in lines})


def owned(rows: DataFrame, wanted: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner, found) of asked rows (key, owner): found is whether the row exists and is theirs; what is another's looks like
    what does not exist. Each is asked once."""
    theirs = rows.select(key, owner).distinct().withColumn("found", F.lit(True))
    return wanted.select(key, owner).distinct().join(theirs, [key, owner], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def same_version(rows: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Rows (with network) and whether they were made on the version in use: ``versions`` has one row, network."""
    return rows.crossJoin(F.broadcast(versions.select(F.col("network").alias("_now")))).withColumn("current", F.coalesce(F.col("network") == F.col("_now"), F.lit(False))).select(key, "network", "current")
