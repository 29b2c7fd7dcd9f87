"""Route steps in long form (route, pos, segment): what a walk covers, repeats and scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspan.shared import stored


def traversals(steps: DataFrame, route: str, pos: str, seg: str) -> DataFrame:
    """``pass_no`` of each step: 1 the first time that the route takes the segment."""
    return steps.withColumn("pass_no", F.row_number().over(Window.partitionBy(route, seg).orderBy(pos)))


def runs(steps: DataFrame, route: str, pos: str, value: str) -> DataFrame:
    """``run_id`` of each step: equal neighbours share one."""
    order = Window.partitionBy(route).orderBy(pos)
    new = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(order)), F.lit(True)) | (F.row_number().over(order) == 1)
    return steps.withColumn("run_id", F.sum(new.cast("int")).over(order))


def rising_runs(steps: DataFrame, route: str, pos: str, condition: Column, name: str = "runs") -> DataFrame:
    """(route, ``name``): how often the condition begins to hold along each route; a null condition does not hold."""
    holds = steps.select(route, pos, F.coalesce(condition, F.lit(False)).alias("_on"))
    before = F.coalesce(F.lag("_on").over(Window.partitionBy(route).orderBy(pos)), F.lit(False))
    return holds.withColumn("_up", F.col("_on") & ~before).groupBy(route).agg(F.count_if("_up").alias(name))


def filled(frame: DataFrame, group: list[str], order: list[Column], amount: str, target: float) -> DataFrame:
    """Rows in order while what came before is below the target."""
    before = F.coalesce(F.sum(amount).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frame.withColumn("_before", before).where(F.col("_before") < target).drop("_before")


def score(components: Mapping[str, Column], weights: Mapping[str, float]) -> tuple[Column, Column]:
    """(map of rounded weighted components, their rounded total). Weights not named are 0."""
    parts = {k: F.lit(float(weights.get(k, 0.0))) * c for k, c in components.items()}
    pairs = [x for k, v in parts.items() for x in (F.lit(k), F.round(v, 2))]
    total = None
    for v in parts.values():
        total = v if total is None else total + v
    return F.create_map(*pairs), F.round(total, 2)


def credited(credits: DataFrame, target: str, fraction: str, share: float, done: DataFrame, done_key: str) -> DataFrame:
    """Targets whose credits add up to the share and that are not done themselves. Credits are summed as decimals, to twelve
    places in the end, so what adds up to the share does so in whatever order rows come."""
    total = F.round(F.sum(F.col(fraction).try_cast("decimal(38,15)")), 12).cast("double")
    got = credits.groupBy(target).agg(total.alias("credit")).where(F.col("credit") >= share)
    return got.join(done.select(F.col(done_key).alias(target)).distinct(), target, "left_anti")


#: Groups of so many rows are ordered as a whole; in larger ones only what lies within NEAR of a share, on both sides.
WHOLE_GROUP, NEAR, ACCURACY = 20_000, 0.0005, 10_000


def at_positions(frame: DataFrame, group: list[str], value: str, positions: Mapping[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """(group, n, one column a position, _most): the value at a position from 0 of each group in ascending order, and the largest.

    A position is (its share of n, to within two places; the place itself, from n). Values are numbers; nulls do not count,
    and a group of nulls only has no row. A sketch of each group, which tasks combine before the shuffle, gives two values
    that enclose each place for certain: its error is n / ACCURACY, and NEAR is five times that. What lies below them is
    counted, and only equal values between them, counted as one, are ordered.
    """
    at = F.col(value).cast("double")
    some = frame.where(F.col(value).isNotNull())
    # least and greatest where a bound would leave the group
    cuts = {k: (share - NEAR, share + NEAR) for k, (share, _) in positions.items()}
    sketch = lambda q: F.percentile_approx(at, F.lit(q), F.lit(ACCURACY))
    low = {k: sketch(a) if a > 0 else F.min(at) for k, (a, _) in cuts.items()}
    high = {k: sketch(b) if b < 1 else F.max(at) for k, (_, b) in cuts.items()}
    ends = some.groupBy(*group).agg(
        F.count("*").alias("_n"), F.min(at).alias("_least"), F.max(at).alias("_greatest"), F.max(value).alias("_most"),
        *(c.alias(f"_low_{k}") for k, c in low.items()), *(c.alias(f"_high_{k}") for k, c in high.items()),
    )
    whole = F.col("_n") <= WHOLE_GROUP
    bounds = F.array(*(
        F.struct(F.lit(k).alias("k"), place(F.col("_n")).cast("long").alias("place"), F.when(whole, F.col("_least")).otherwise(F.col(f"_low_{k}")).alias("low"), F.when(whole, F.col("_greatest")).otherwise(F.col(f"_high_{k}")).alias("high"))
        for k, (_, place) in positions.items()
    ))
    ends = ends.select(*group, "_n", "_most", bounds.alias("_bounds"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}")) for c in group] or [F.lit(True)]
    joined = some.select(*group, value).alias("p").join(ends.alias("e"), reduce(and_, same)).select(*(F.col(f"p.{c}").alias(c) for c in group), F.col(f"p.{value}").alias(value), "_bounds")
    # one pass: a row below a bound is only counted, one above it is not kept at all
    dealt = joined.select(*group, value, F.explode(F.filter("_bounds", lambda b: at <= b["high"])).alias("_b"))
    near = F.when(at >= F.col("_b.low"), F.col(value))
    counted = dealt.select(*group, F.col("_b.k").alias("_k"), F.col("_b.place").alias("_place"), near.alias("_v")).groupBy(*group, "_k", "_place", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*group, "_k").orderBy(F.col("_v").asc_nulls_first()))
    found = counted.withColumn("_upto", upto).where((F.col("_upto") > F.col("_place")) & F.col("_v").isNotNull())
    values = found.groupBy(*group).agg(*(F.min(F.when(F.col("_k") == k, F.col("_v"))).alias(k) for k in positions))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"e.{c}")) for c in group] or [F.lit(True)]
    return values.alias("v").join(ends.alias("e"), reduce(and_, same)).select(*(F.col(f"v.{c}").alias(c) for c in group), F.col("_n").alias("n"), *positions, "_most")


def at_index(frame: DataFrame, group: list[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Value at position floor(share * n), from 0 and n - 1 at most, of each group in ascending order: an index, never interpolated."""
    place = lambda s: lambda n: F.least(F.floor(F.lit(s) * n), n - 1)
    return at_positions(frame, group, value, {k: (s, place(s)) for k, s in shares.items()}).drop("_most")


def covered_share(obligation: DataFrame, key: str, weight: str, done: DataFrame) -> DataFrame:
    """One row: weight and number of what is owed, of what is done, and their share in percent. Each key counts once."""
    hit = done.select(key).distinct().withColumn("_done", F.lit(True))
    joined = obligation.join(hit, key, "left")
    done_weight = F.sum(F.when(F.col("_done"), F.col(weight)).otherwise(0))
    return joined.agg(
        F.count("*").alias("owed"), F.count("_done").alias("done"), F.sum(weight).alias("owed_weight"), done_weight.alias("done_weight"),
        F.round(100.0 * done_weight / F.sum(weight), 2).alias("percent"),
    )


def slate(candidates: DataFrame, group: str, key: str, score_col: str, items: str, size: int, least_share: float, most_overlap: float) -> DataFrame:
    """Greedy choice in each group: best score first, of ties the smaller key, at least ``least_share`` of the best, sharing with
    none chosen before more than ``most_overlap`` of the smaller set; (group, rank, key, score). Candidates without a group, score
    or items are not chosen; keys are unique in a group.

    ``size`` rounds: each takes the best candidate that is left in every group, an aggregation with map-side combine, and drops
    those that share too much with it. Items stay in one written table with a row a candidate and never meet in one row.
    """
    best = F.max(score_col).over(Window.partitionBy(group))
    fit = candidates.where(F.col(group).isNotNull() & F.col(score_col).isNotNull() & (F.size(F.coalesce(items, F.array())) > 0)).withColumn("_best", best).where(F.col(score_col) >= F.col("_best") * least_share)
    held = stored(fit.select(group, key, F.col(score_col).cast("double").alias(score_col), F.array_distinct(items).alias("_i")), "slate-held")
    left, chosen = held, None
    for rank in range(1, size + 1):
        top = left.groupBy(group).agg(F.min(F.struct((-F.col(score_col)).alias("s"), F.col(key).alias("k"))).alias("b"))
        new = stored(top.select(group, F.lit(rank).alias("rank"), F.col("b.k").alias(key), (-F.col("b.s")).alias(score_col)), "slate-new")
        if new.isEmpty():
            break
        chosen = new if chosen is None else chosen.unionByName(new)
        if rank < size:
            # those chosen again, with their items, one row a group
            taken = new.select(group, key).join(held, [group, key]).select(group, F.col(key).alias("_k"), F.col("_i").alias("_t"))
            shared = F.size(F.array_intersect("_i", "_t")) / F.least(F.size("_i"), F.size("_t"))
            left = stored(left.join(taken, group).where((F.col(key) != F.col("_k")) & (shared <= most_overlap)).drop("_k", "_t"), "slate-left")
    if chosen is None:
        return held.select(group, F.lit(0).alias("rank"), key, score_col).limit(0)
    return chosen


def node_sequence(steps: Column) -> Column:
    """Nodes that a walk visits, from an array of its steps' ends (struct u, v) in order. It begins at the end of the first step
    that the second one does not touch; a step that touches neither end of what is before it is taken from its u."""
    a, b = F.try_element_at(steps, F.lit(1)), F.try_element_at(steps, F.lit(2))
    touches = lambda n: F.coalesce((n == b["u"]) | (n == b["v"]), F.lit(False))
    start = F.when(touches(a["v"]), a["u"]).when(touches(a["u"]), a["v"]).otherwise(a["u"])
    step = lambda acc, s: F.concat(acc, F.array(F.when(F.try_element_at(acc, F.lit(-1)) == s["v"], s["u"]).otherwise(s["v"])))
    return F.when(F.size(steps) > 0, F.aggregate(steps, F.array(start), step))


def walked_line(steps: Column) -> Column:
    """One line from an array of steps (struct u, v, line), each turned the way it is walked; the joints appear once."""
    nodes = node_sequence(F.transform(steps, lambda s: F.struct(s["u"].alias("u"), s["v"].alias("v"))))
    turned = F.transform(steps, lambda s, i: F.when(F.try_element_at(nodes, (i + 1).cast("int")) == s["u"], s["line"]).otherwise(F.reverse(s["line"])))
    return F.concat(F.slice(F.get(turned, F.lit(0)), 1, 1), F.flatten(F.transform(turned, lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))))))


def joined_line(parts: Column, tolerance: float = 1e-7) -> Column:
    """One line from an array of lines in walking order, by their ends alone: a part whose last point, and not its first, is where
    the line stands is turned, and a point that is there already is not repeated. Empty parts are passed over; no parts give an
    empty line."""
    far = lambda a, b: (F.abs(a["x"] - b["x"]) > tolerance) | (F.abs(a["y"] - b["y"]) > tolerance)

    def step(line: Column, part: Column) -> Column:
        end, first, last = F.try_element_at(line, F.lit(-1)), F.get(part, F.lit(0)), F.try_element_at(part, F.lit(-1))
        turned = F.when(F.coalesce(far(end, first) & ~far(end, last), F.lit(False)), F.reverse(part)).otherwise(part)
        same = F.coalesce(end == F.get(turned, F.lit(0)), F.lit(False))
        return F.concat(line, F.when(same, F.slice(turned, F.lit(2), F.greatest(F.size(turned) - 1, F.lit(0)))).otherwise(turned))

    some = F.filter(parts, lambda p: F.coalesce(F.size(p) > 0, F.lit(False)))
    return F.aggregate(some, F.array().cast("array<struct<x:double,y:double>>"), step)
