"""What a request for walks gets back: a state from local facts, the next band that works, and payloads by allow-list.

Bands are rows (request, band, target, has_route, new_miles, total_miles, efficiency, nearest_miles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What makes a walk worth offering, and the distance from which another start is better advice.
NEW_MILES, EFFICIENCY, FAR_MILES = 0.25, 0.30, 2.5


def worthwhile(efficiency: float = 0.0) -> Column:
    return F.col("has_route") & (F.col("new_miles") >= NEW_MILES) & (F.col("efficiency") >= efficiency)


def longer_bands(bands: DataFrame) -> DataFrame:
    """Bands with next_any and next_good: struct(target, band) of the shortest longer band of the request that works, and that
    works well. A window over the few bands of one request."""
    later = Window.partitionBy("request").orderBy("target").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    after = lambda c: F.filter(F.array_sort(F.collect_list(F.when(c, F.struct("target", "band"))).over(later)), lambda x: x["target"] > F.col("target"))
    first = lambda c: F.try_element_at(after(c), F.lit(1))
    return bands.withColumn("next_any", first(worthwhile())).withColumn("next_good", first(worthwhile(EFFICIENCY)))


def assessed(bands: DataFrame) -> DataFrame:
    """Bands with state, suggested and suggested_target.

    Without a route: a longer one if any works, another start if the nearest
    open segment is far, else nothing. With one: available if it earns enough
    at enough efficiency, else limited, or another start if no longer band does
    well and the nearest is far.
    """
    far = F.coalesce(F.col("nearest_miles") > FAR_MILES, F.lit(False))
    without = F.when(F.col("next_any").isNotNull(), "LONGER_ROUTE_REQUIRED").when(far, "SELECT_DIFFERENT_START_AREA").otherwise("NO_USEFUL_ROUTE_NEAR_START")
    with_ = F.when(worthwhile(EFFICIENCY), "ROUTE_AVAILABLE").when(F.col("next_good").isNull() & far, "SELECT_DIFFERENT_START_AREA").otherwise("LIMITED_LOCAL_COVERAGE")
    state = F.when(F.col("has_route"), with_).otherwise(without)
    offer = F.when(state == "LONGER_ROUTE_REQUIRED", F.col("next_any")).when(state == "LIMITED_LOCAL_COVERAGE", F.col("next_good"))
    return longer_bands(bands).withColumn("state", state).withColumn("_o", offer).withColumn("suggested", F.col("_o.band")).withColumn("suggested_target", F.col("_o.target")).drop("_o", "next_any", "next_good")


def state_counts(answers: DataFrame) -> DataFrame:
    return answers.groupBy("state").agg(F.count("*").alias("answers"))


def first_bands(bands: DataFrame) -> DataFrame:
    """(request, band, target): the shortest band with a route; requests without any have none."""
    best = F.min(F.when(F.col("has_route"), F.struct("target", "band")))
    return bands.groupBy("request").agg(best.alias("b")).where("b IS NOT NULL").select("request", "b.band", "b.target")


def nesting(covered: DataFrame) -> DataFrame:
    """(request, target, nested): whether a band covers all that the next shorter one of its request does. ``covered`` is
    (request, target, segment_id); a shortest band is nested."""
    order = Window.partitionBy("request").orderBy("target")
    ranked = covered.select("request", "target").distinct().withColumn("before", F.lag("target").over(order))
    here = ranked.join(covered, ["request", "target"])
    kept = here.join(covered.select("request", F.col("target").alias("before"), "segment_id"), ["request", "before", "segment_id"], "left_semi").groupBy("request", "target").agg(F.count_distinct("segment_id").alias("kept"))
    sizes = covered.groupBy("request", F.col("target").alias("before")).agg(F.count_distinct("segment_id").alias("size"))
    out = ranked.join(sizes, ["request", "before"], "left").join(kept, ["request", "target"], "left")
    return out.select("request", "target", (F.col("before").isNull() | (F.coalesce("kept", F.lit(0)) == F.col("size"))).alias("nested"))


def within_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Starts outside the box, and those without coordinates, are refused."""
    return F.coalesce(lon.between(west, east) & lat.between(south, north), F.lit(False))


def band_payload(answers: DataFrame) -> DataFrame:
    """Only what a client may see; numbers of a band without a route are null."""
    on = F.col("has_route")
    number = lambda c, d: F.when(on, F.round(c, d)).alias(c)
    return answers.select("request", "band", "target", on.alias("available"), "state", number("total_miles", 2), number("new_miles", 2), number("efficiency", 3), "suggested", "nearest_miles")


def loop_verdict(closes: Column, shape: Column, avoidable_share: Column) -> Column:
    """Whether a walk is a loop, or out and back with a way home added."""
    good = closes & (shape >= 0.55) & (avoidable_share <= 0.25)
    return F.when(good, "coherent loop").when(closes, "returns to start but retraces heavily").otherwise("does not close")


#: Statistic, measure, limit, severity and finding of the quality report; a limit is exceeded, of cohesion missed.
FINDINGS = (
    ("uturns_per_mile", "p90", 1.0, "MEDIUM", "U-turns away from dead ends"), ("turns_per_mile", "p90", 14.0, "MEDIUM", "zigzag"), ("runs_per_street", "mean", 1.6, "LOW", "streets entered again"),
    ("avoidable_repeat_share", "p90", 0.20, "MEDIUM", "avoidable repeats"), ("extra_traversals", "max", 2.0, "LOW", "walked three times or more"), ("cohesion", "median", 0.7, "LOW", "scattered"), ("derived_connectors", "max", 0.0, "LOW", "derived links in use"),
)


def quality_findings(summary: DataFrame) -> DataFrame:
    """(severity, finding, value) from statistics (statistic, mean, median, p90, max); repeats within their limit are an INFO."""
    rules = F.array(*(F.struct(F.lit(s).alias("statistic"), F.lit(m).alias("measure"), F.lit(float(x)).alias("most"), F.lit(v).alias("severity"), F.lit(f).alias("finding")) for s, m, x, v, f in FINDINGS))
    each = summary.withColumn("rule", F.explode(rules)).where(F.col("rule.statistic") == F.col("statistic"))
    value = F.when(F.col("rule.measure") == "p90", F.col("p90")).when(F.col("rule.measure") == "mean", F.col("mean")).when(F.col("rule.measure") == "median", F.col("median")).otherwise(F.col("max"))
    over = F.when(F.col("statistic") == "cohesion", value < F.col("rule.most")).otherwise(value > F.col("rule.most"))
    quiet = (F.col("statistic") == "avoidable_repeat_share") & value.isNotNull() & ~over
    out = each.where(over | quiet)
    return out.select(F.when(quiet, "INFO").otherwise(F.col("rule.severity")).alias("severity"), F.when(quiet, "avoidable repeats within their limit").otherwise(F.col("rule.finding")).alias("finding"), value.alias("value"))
