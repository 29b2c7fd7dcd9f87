"""Small reports: tallies, summaries, pivots and projections that people and clients read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspan.functions.keys import numbered
from trailspan.operators.coverage import at_positions
from trailspan.operators.membership import MILE, miles


def freeze_metrics(segments: DataFrame) -> DataFrame:
    """One row about a candidate (role, segment_type, dataset, length_m, in_main): counts and miles by role, and the main
    component's share of the required miles."""
    required = F.col("role") == "REQUIRED"
    some = {"required": required, "required_street": required & (F.col("segment_type") == "STREET"), "required_trail": required & (F.col("segment_type") == "TRAIL"), "connector": F.col("role") == "OPTIONAL_CONNECTOR", "excluded": F.col("role") == "EXCLUDED", "main": required & F.col("in_main")}
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("length_m"))), F.lit(0.0))
    aggs = [a for k, c in some.items() for a in (F.count_if(c).alias(f"{k}_segments"), miles(total(c)).alias(f"{k}_miles"))]
    return segments.agg(F.count("*").alias("segments"), F.count_if(F.col("dataset") == "DERIVED").alias("derived_segments"), *aggs, F.coalesce(F.round(F.try_divide(total(some["main"]), total(required)), 4), F.lit(0.0)).alias("main_share"))


def edit_lists(edits: DataFrame) -> DataFrame:
    """(walk, added, removed): sorted ids of each walk's edits (walk, segment_id, kind); a walk's edits are few."""
    ids = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("segment_id"))))
    return edits.groupBy("walk").agg(ids("ADDED").alias("added"), ids("REMOVED").alias("removed"))


def tally(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(question, yes, no, unanswered) of boolean columns in one pass; nulls count neither way."""
    one = frame.agg(*(a for c in columns for a in (F.count_if(F.col(c)).alias(f"{c}_y"), F.count_if(~F.col(c)).alias(f"{c}_n"), F.count_if(F.col(c).isNull()).alias(f"{c}_u"))))
    rows = F.array(*(F.struct(F.lit(c).alias("question"), F.col(f"{c}_y").alias("yes"), F.col(f"{c}_n").alias("no"), F.col(f"{c}_u").alias("unanswered")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def served_states(requests: DataFrame) -> DataFrame:
    """(state, served) over the nested answers of requests (variants: array of structs with state)."""
    return requests.select(F.explode("variants").alias("v")).groupBy("v.state").agg(F.count("*").alias("served"))


def holds_by_walk(live: DataFrame) -> DataFrame:
    """(walk, segments, expires_at) of live holds: how many each walk has, and when the first of them ends."""
    return live.groupBy("walk").agg(F.count_distinct("segment_id").alias("segments"), F.min("expires_at").alias("expires_at"))


def means(frame: DataFrame, group: Sequence[str], columns: Sequence[str], places: int = 3) -> DataFrame:
    """Means of each group; what is no number is left out, and a group without any has null."""
    return frame.groupBy(*group).agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(c).try_cast("double")), places).alias(c) for c in columns))


def timing_summary(frame: DataFrame, group: Sequence[str], ms: str) -> DataFrame:
    """median, p90 and most of a group's distinct timings, by index: n // 2, and the whole part of 0.9 * (n - 1)."""
    once = frame.where(F.col(ms).isNotNull()).select(*group, ms).distinct()
    positions = {"median": (0.5, lambda n: F.floor(n / 2)), "p90": (0.9, lambda n: F.floor(0.9 * (n - 1)))}
    return at_positions(once, list(group), ms, positions).withColumnRenamed("_most", "most").select(*group, "n", "median", "p90", "most")


def marked(name: Column, markers: Sequence[str]) -> Column:
    """Whether a name holds any of the markers, in any case of letters."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(F.lower(name), F.lit(m.lower()))
    return F.coalesce(out, F.lit(False))


def crossings(links: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Links (a_name, b_name, a_component, b_component, recovered) that touch a marked place or join it to another component, with
    touches and bridges; to be read with those that touch first, then by what they win back."""
    a, b = marked(F.col("a_name"), markers), marked(F.col("b_name"), markers)
    out = links.withColumn("touches", a | b).withColumn("bridges", (a | b) & ~F.col("a_component").eqNullSafe(F.col("b_component")))
    return numbered(out.where("touches OR bridges"), [F.desc("bridges"), F.desc("recovered"), F.col("link")], "place")


def context_roads(segments: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Roads that a map shows around the network: of the listed classes, or connectors; nothing private or gated."""
    open_ = ~F.coalesce(F.col("access_type").isin("PRIVATE", "GATED"), F.lit(False))
    return segments.where(open_ & (F.coalesce(F.col("road_class").isin(*classes), F.lit(False)) | (F.coalesce("role", F.lit("")) == "OPTIONAL_CONNECTOR")))


def allowed(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the listed columns; one that is missing is an error, and what is not listed never leaves."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return frame.select(*columns)


def tagged_union(frames: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Rows of several sources with their ``source``; columns that one lacks are null there. Repeated rows stay."""
    out: DataFrame | None = None
    for name, frame in frames.items():
        part = frame.select(F.lit(name).alias("source"), *(F.col(c) if c in frame.columns else F.lit(None).alias(c) for c in columns))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out


def route_summary(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """(route, steps, segments, miles, required, connectors) of steps (route, segment_id): each pass counts for the miles, each
    segment once for the rest."""
    s = steps.join(segments.select("segment_id", "length_m", (F.col("role") == "REQUIRED").alias("owed")), "segment_id")
    owed = F.coalesce("owed", F.lit(False))
    # a segment of a route is one row first: it lies where the join left it, so nothing is counted apart and few rows are shuffled
    per = s.groupBy("route", "segment_id").agg(F.count("*").alias("n"), F.sum("length_m").alias("m"), F.bool_or(owed).alias("required"), F.bool_or(~owed).alias("connector"))
    return per.groupBy("route").agg(F.sum("n").alias("steps"), F.count("*").alias("segments"), F.round(F.sum("m") / MILE, 3).alias("miles"), F.count_if("required").alias("required"), F.count_if("connector").alias("connectors"))


def absorption(paths: DataFrame, absorbed: DataFrame, key: str) -> DataFrame:
    """(kind, paths, absorbed, kept) of paths (kind) and those that a street took in."""
    hit = paths.join(absorbed.select(key, F.lit(1).alias("_a")).distinct(), key, "left")
    return hit.groupBy("kind").agg(F.count("*").alias("paths"), F.count("_a").alias("absorbed"), F.count_if(F.col("_a").isNull()).alias("kept"))


# What a reason must hold to say something about a crossing.
TELLING = ("cross", "steps into", "m gap", "insufficient signal")


def telling_reasons(reasons: Column) -> Column:
    """Of an array of reasons those that speak of crossing, in any case of letters; null is none."""
    found = lambda r: F.lower(r).rlike("|".join(TELLING))
    return F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: F.coalesce(found(r), F.lit(False)))


def crossings_to_review(links: DataFrame, touched: DataFrame) -> DataFrame:
    """Of rejected links (segment_id, u, v, a, b, miles_a, miles_b, reasons), a and b the components of their ends, those that join two
    components or have an end among ``touched`` (node): with bridges, touches, the miles on the smaller side if they bridge (else
    0), and the reasons that speak of crossing. An end in no component bridges nothing."""
    node = touched.select("node").distinct().withColumn("_hit", F.lit(True))
    at = lambda d, end: d.join(node.withColumnsRenamed({"node": end, "_hit": f"_{end}"}), end, "left")
    bridges, touches = F.coalesce(F.col("a") != F.col("b"), F.lit(False)), F.col("_u").isNotNull() | F.col("_v").isNotNull()
    rows = at(at(links, "u"), "v").withColumns({"bridges": bridges, "touches": touches}).where("bridges OR touches")
    return rows.select("segment_id", "bridges", "touches", F.round(F.when(F.col("bridges"), F.least("miles_a", "miles_b")).otherwise(0.0), 3).alias("smaller_miles"), telling_reasons(F.col("reasons")).alias("reasons"))
