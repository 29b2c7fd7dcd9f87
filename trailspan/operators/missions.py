"""Minutes and miles, walk quality, and wishes for a set of walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Walking pace, the range of the time slider, metres in a mile.
PACE_MPH, LEAST_MIN, MOST_MIN, STEP_MIN, MILE_M = 3.0, 20, 90, 5, 1609.344


def clamped_minutes(minutes: Column) -> Column:
    """To the nearest step, halves to the even one, within the slider's range."""
    return F.greatest(F.lit(LEAST_MIN), F.least(F.lit(MOST_MIN), (F.bround(minutes / STEP_MIN) * STEP_MIN).cast("int")))


def miles_of(minutes: Column) -> Column:
    return minutes * PACE_MPH / 60


def minutes_of(miles: Column) -> Column:
    return miles / PACE_MPH * 60


def starts_wanted(ratio: Column, least: int = 3, most: int = 14) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(ratio).cast("int")))


def walk_quality(total: Column, avoidable: Column, closing: Column, stress: Column, uturns: Column, turns: Column, loop_shape: Column) -> Column:
    """0 to 100: repeats weigh 45, stress 25, turns about 15, turns 15, and a walk that is all repeats keeps 60 %."""
    miles = F.greatest(total, F.lit(0.01))
    lost = (
        F.least(F.lit(1.0), (avoidable + 0.5 * closing) / miles) * 45 + F.least(F.lit(1.0), stress / miles) * 25
        + F.least(F.lit(1.0), uturns / 4.0) * 15 + F.least(F.lit(1.0), turns / F.greatest(total * 8, F.lit(1.0))) * 15
    )
    return F.round(F.greatest(F.lit(0.0), 100.0 - lost) * (0.6 + 0.4 * loop_shape), 1)


def repeat_penalty(share: Column, total: Column) -> Column:
    """Quadratic in the repeated share, growing with the length up to twice."""
    return share * share * F.least(total / 3.5, F.lit(2.0))


def band_factor(target: Column, reference: float = 2.0, exponent: float = 0.5) -> Column:
    return F.when(F.coalesce(target, F.lit(0.0)) == 0, 1.0).otherwise(F.pow(target / reference, F.lit(exponent)))


# Weights of a route's components.
ROUTE_WEIGHTS = {
    "new_required": 100.0, "households": 0.35, "corridor_completion": 25.0, "dead_end_completion": 12.0, "isolation": 8.0, "cohesion": 40.0,
    "repeat_avoidable": -55.0, "repeat_closing": -20.0, "repeat_dead_end": -6.0, "repeat_share": -260.0, "repeat_extra_traversal": -14.0,
    "connector": -12.0, "derived_connector": -6.0, "stress": -9.0, "turns": -0.7, "uturns": -6.0, "length_overshoot": -120.0, "length_undershoot": -25.0, "loop_shape": 18.0,
}


def route_components(target: Column) -> dict[str, Column]:
    """The components that ROUTE_WEIGHTS weigh, from one row of facts a route (see route_facts; miles throughout)."""
    c = F.col
    off = F.when(target > 0, (c("total") - target) / target).otherwise(0.0)
    return {
        "new_required": c("new_required"), "households": c("households"), "corridor_completion": c("corridors_completed"), "dead_end_completion": c("dead_ends"),
        "isolation": c("isolated"), "cohesion": c("cohesion"), "repeat_avoidable": c("avoidable") * band_factor(target), "repeat_closing": c("closing_miles"),
        "repeat_dead_end": c("dead_end_return"), "repeat_share": repeat_penalty(c("repeat_share"), c("total")), "repeat_extra_traversal": c("extra"), "connector": c("connector"),
        "derived_connector": c("derived"), "stress": c("stress"), "turns": c("turns"), "uturns": c("uturns"), "length_overshoot": F.greatest(F.lit(0.0), off),
        "length_undershoot": F.greatest(F.lit(0.0), -off), "loop_shape": c("loop_shape"),
    }


def route_facts(steps: DataFrame, segs: DataFrame, done: DataFrame, route: str = "route", pos: str = "pos", closing: str = "closing") -> DataFrame:
    """One row of facts for each route from its steps (route, pos, seg, closing).

    ``segs`` has seg, miles, required, households, dead_end, derived, stress (1
    to 5) and isolated; ``done`` has the finished segs. A segment's first pass
    earns what it is worth; later ones repeat: back out of a dead end, on the
    way home, or avoidably. A third pass and on are extra.
    """
    n = F.row_number().over(Window.partitionBy(route, "seg").orderBy(pos))
    s = steps.join(segs, "seg").join(done.select("seg").distinct().withColumn("_done", F.lit(True)), "seg", "left").withColumn("_n", n)
    first, again = F.col("_n") == 1, F.col("_n") > 1
    new = first & F.col("required") & F.col("_done").isNull()
    miles = lambda cond: F.sum(F.when(cond, F.col("miles")).otherwise(0.0))
    back, home = again & F.col("dead_end"), again & ~F.col("dead_end") & F.col(closing)
    out = s.groupBy(route).agg(
        F.sum("miles").alias("total"), miles(new).alias("new_required"), miles(first & F.col("required")).alias("required_walked"), miles(again).alias("repeated"),
        F.sum(F.when(new, F.col("households")).otherwise(0)).alias("households"), F.count_if(new & F.col("dead_end")).alias("dead_ends"), F.count_if(new & F.col("isolated")).alias("isolated"),
        miles(back).alias("dead_end_return"), miles(home).alias("closing_miles"), miles(again & ~F.col("dead_end") & ~F.col(closing)).alias("avoidable"),
        F.count_if(F.col("_n") > 2).alias("extra"), F.max("_n").alias("most_passes"), miles(first & ~F.col("required")).alias("connector"), F.count_if(first & F.col("derived")).alias("derived"),
        F.sum(F.when(first, F.col("miles") * (F.col("stress") - 1) / 4).otherwise(0.0)).alias("stress"), (F.count_distinct("seg") / F.count("*")).alias("loop_shape"),
    )
    return out.withColumn("repeat_share", F.when(F.col("total") > 0, F.col("repeated") / F.col("total")).otherwise(0.0))


def directions(steps: DataFrame, route: str = "route", pos: str = "pos", name: str = "name", derived: str = "derived", miles: str = "miles") -> DataFrame:
    """Instructions (route, step, name, derived, miles): neighbours of one name and kind are one; those below 0.01 miles are left out."""
    order = Window.partitionBy(route).orderBy(pos)
    shown = F.coalesce(F.col(name), F.when(F.col(derived), "crossing").otherwise("unnamed path"))
    s = steps.withColumn("_name", shown)
    new = ~(F.col("_name").eqNullSafe(F.lag("_name").over(order)) & F.col(derived).eqNullSafe(F.lag(derived).over(order)))
    runs = s.withColumn("step", F.sum(new.cast("int")).over(order)).groupBy(route, "step").agg(F.first("_name").alias("name"), F.first(derived).alias("derived"), F.round(F.sum(miles), 2).alias("miles"))
    return runs.where(F.col("miles") >= 0.01)


def mission_score(new_miles: Column, households: Column, miles: Column, budget: Column, quality: Column, reserved_share: Column) -> Column:
    """How good a place to go is: unfinished ground, homes on it, fit to the time, a pleasant walk, and nobody there already."""
    fit = 1.0 - F.least(F.abs(miles - budget) / F.greatest(budget, F.lit(0.01)), F.lit(1.0))
    return new_miles * 100.0 + F.least(households, F.lit(2000)) * 0.20 + fit * 40.0 + F.coalesce(quality / 100.0, F.lit(0.5)) * 30.0 - reserved_share * 120.0
