"""Corridors of parallel ways: one side carries the duty, the others earn it in parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.operators.membership import MILE
from trailspan.operators.network import around_cells, passed_cells, straight_pieces
from trailspan.shared import stored

# How near and how much of a way runs beside what is there, and the least credit.
PARALLEL_M, PARALLEL_SHARE, LEAST_CREDIT = 45.0, 0.7, 0.05


def _beside(line: np.ndarray, pieces: list[np.ndarray]) -> float:
    """Share of even samples of a line within PARALLEL_M of any straight piece."""
    steps = np.hypot(*np.diff(line, axis=0).T)
    n = max(4, int(steps.sum() // 5))
    upto = np.concatenate([[0.0], np.cumsum(steps)])
    at = np.stack([np.interp(np.linspace(0, upto[-1], n + 1), upto, line[:, k]) for k in (0, 1)], 1)
    a, b = np.concatenate([p[:-1] for p in pieces]), np.concatenate([p[1:] for p in pieces])
    near = np.zeros(len(at), bool)
    for i in range(0, len(at), 256):
        p, d = at[i : i + 256, None, :], b - a
        t = np.clip(((p - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-12), 0, 1)
        near[i : i + 256] = (np.hypot(*np.moveaxis(p - a - t[:, :, None] * d, 2, 0)) <= PARALLEL_M).any(1)
    return float(near.mean())


def obligations(ways: DataFrame) -> DataFrame:
    """(segment_id, corridor, obligation) of ways (segment_id, corridor, line): by descending length, of ties the smaller id, a way
    is ALTERNATIVE if most of it runs beside the CANONICAL ones before it. One corridor is one street's ways: a small group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lines = [np.array([(p["x"], p["y"]) for p in line], float) for line in group["line"]]
        size = [float(np.hypot(*np.diff(x, axis=0).T).sum()) for x in lines]
        order = sorted(range(len(group)), key=lambda i: (-size[i], group["segment_id"].iloc[i]))
        kept, out = [], {}
        for i in order:
            beside = bool(kept) and _beside(lines[i], kept) >= PARALLEL_SHARE
            out[i] = "ALTERNATIVE" if beside else "CANONICAL"
            if not beside:
                kept.append(lines[i])
        return pd.DataFrame({"segment_id": group["segment_id"], "corridor": group["corridor"], "obligation": [out[i] for i in range(len(group))]})

    whole = ways.where((F.size("line") > 1) & F.col("corridor").isNotNull()).select("segment_id", "corridor", "line")
    return whole.groupBy("corridor").applyInPandas(run, "segment_id long, corridor string, obligation string")


def _samples(ways: DataFrame) -> DataFrame:
    """(segment_id, k, n, p): n + 1 even points of each way; n is its length over 5, at least 4. Each straight piece gives the points
    that lie on it, so a way is walked once however many it has. Ways without length have none."""
    line = Window.partitionBy("line_id")
    n = F.greatest(F.lit(4), F.floor(F.col("total") / 5)).cast("int")
    pieces = straight_pieces(ways.select(F.col("segment_id").alias("line_id"), "line")).withColumn("total", F.sum("size").over(line)).withColumn("end", F.lead("at").over(line.orderBy("k")))
    first = lambda at: F.ceil(at * F.col("n") / F.col("total")).cast("int")
    last = F.when(F.col("end").isNull(), F.col("n")).otherwise(first(F.col("end")) - 1)
    dealt = pieces.withColumn("n", n).withColumn("lo", first(F.col("at"))).withColumn("hi", last).where("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi")))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") * F.col("total") / F.col("n") - F.col("at")) / F.col("size")))
    p = geometry.point(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * t, F.col("a.y") + (F.col("b.y") - F.col("a.y")) * t)
    return dealt.select(F.col("line_id").alias("segment_id"), "k", "n", p.alias("p"))


def _met(ways: DataFrame, others: DataFrame) -> DataFrame:
    """(segment_id, k, n, other): samples of ways within PARALLEL_M of other ways (segment_id, line). Straight pieces of the others
    stand in the grid cells of that size that they pass and those around them, samples in one: an equi-join, merged, as the size of
    what was dealt to cells is not known beforehand and must not be broadcast."""
    pieces = straight_pieces(others.select(F.col("segment_id").alias("line_id"), "line"), measured=False)
    dealt = pieces.withColumn("c", F.explode(around_cells(passed_cells(F.col("a"), F.col("b"), PARALLEL_M)))).select(F.col("line_id").alias("other"), "a", "b", "c.cx", "c.cy")
    here = _samples(ways).withColumn("cx", F.floor(F.col("p.x") / PARALLEL_M)).withColumn("cy", F.floor(F.col("p.y") / PARALLEL_M))
    foot = geometry.nearest_on_segment(F.col("p"), F.col("a"), F.col("b"))
    near = here.join(dealt.hint("merge"), ["cx", "cy"]).withColumn("foot", foot).where(F.hypot(F.col("p.x") - F.col("foot.x"), F.col("p.y") - F.col("foot.y")) <= PARALLEL_M)
    return near.select("segment_id", "k", "n", "other").distinct()


def unnamed_duties(unnamed: DataFrame, canonical: DataFrame) -> DataFrame:
    """(segment_id, corridor, obligation) of ways without a corridor: ALTERNATIVE if most of one runs beside canonical ways of any
    corridors (segment_id, line), all taken together, else CANONICAL. They are not compared with each other; ways without
    length are left out, and nothing runs beside one."""
    near = _met(unnamed, canonical).groupBy("segment_id", "n").agg(F.count_distinct("k").alias("near"))
    beside = near.select("segment_id", (F.col("near") / (F.col("n") + 1) >= PARALLEL_SHARE).alias("beside"))
    real = unnamed.where(geometry.length(F.col("line")) > 0).select("segment_id")
    duty = F.when(F.coalesce("beside", F.lit(False)), "ALTERNATIVE").otherwise("CANONICAL")
    return real.join(beside, "segment_id", "left").select("segment_id", F.lit(None).cast("string").alias("corridor"), duty.alias("obligation"))


def all_duties(ways: DataFrame) -> DataFrame:
    """(segment_id, corridor, obligation) of ways with a corridor, by ``obligations``, and of those without, by ``unnamed_duties``."""
    named = stored(obligations(ways), "duties")
    canonical = ways.select("segment_id", "line").join(named.where("obligation = 'CANONICAL'").select("segment_id"), "segment_id")
    return named.unionByName(unnamed_duties(ways.where("corridor IS NULL"), canonical))


def credits(ways: DataFrame, duties: DataFrame) -> DataFrame:
    """(alternative, canonical, fraction): how much of a canonical way an alternative runs beside. A way with a corridor stands in
    for canonical ways of its own corridor, one without for any."""
    both = ways.select("segment_id", "line").join(duties.select("segment_id", "corridor", "obligation"), "segment_id")
    alt, canon = both.where("obligation = 'ALTERNATIVE'"), both.where("obligation = 'CANONICAL'")
    of = lambda d, n: d.select(F.col("segment_id").alias(n), F.col("corridor").alias(f"{n}_corridor"))
    met = _met(canon, alt).groupBy(F.col("other").alias("alternative"), F.col("segment_id").alias("canonical"), "n").agg(F.count("*").alias("near"))
    pairs = met.join(of(alt, "alternative"), "alternative").join(of(canon, "canonical"), "canonical").where("alternative_corridor IS NULL OR alternative_corridor = canonical_corridor")
    fraction = F.col("near") / (F.col("n") + 1)
    return pairs.where(fraction >= LEAST_CREDIT).select("alternative", "canonical", F.round(fraction, 4).alias("fraction"))


def corridor_sides(ways: DataFrame, duties: DataFrame) -> DataFrame:
    """(corridor, obligation, segments, miles, types, surfaces, names) of ways (segment_id, length_m, segment_type, surface,
    display_name): each side of each corridor, its distinct kinds and names sorted. Its ids are rows of ``duties``."""
    rows = ways.select("segment_id", "length_m", "segment_type", "surface", "display_name").join(duties.where("corridor IS NOT NULL"), "segment_id")
    kinds = lambda c, n: F.array_sort(F.collect_set(c)).alias(n)
    return rows.groupBy("corridor", "obligation").agg(F.count("*").alias("segments"), F.round(F.sum("length_m") / MILE, 4).alias("miles"), kinds("segment_type", "types"), kinds("surface", "surfaces"), kinds("display_name", "names"))


def corridor_pack(ways: DataFrame, duties: DataFrame, length: str = "length_m") -> DataFrame:
    """(corridor, ways, miles, canonical_miles, duplicate_share, duplication_ratio) of each corridor; the ratio is of all length to
    the canonical one, null without any."""
    rows = ways.select("segment_id", length).join(duties.where("corridor IS NOT NULL"), "segment_id")
    own = F.sum(F.when(F.col("obligation") == "CANONICAL", F.col(length)).otherwise(0.0))
    return rows.groupBy("corridor").agg(
        F.count("*").alias("ways"), F.round(F.sum(length) / MILE, 3).alias("miles"), F.round(own / MILE, 3).alias("canonical_miles"), F.round(1 - own / F.sum(length), 4).alias("duplicate_share"),
        F.round(F.try_divide(F.sum(length), own), 2).alias("duplication_ratio"),
    )


def campus_totals(ways: DataFrame, duties: DataFrame, links: DataFrame) -> DataFrame:
    """One row about ways (segment_id, length_m), their duties and the credits between them: numbers of both sides, of alternatives
    with a credit and without, of canonical ways that have an alternative, and miles of named and unnamed ways of both sides."""
    rows = ways.select("segment_id", "length_m").join(duties, "segment_id")
    earns = links.select(F.col("alternative").alias("segment_id")).distinct().withColumn("earns", F.lit(True))
    served = links.select(F.col("canonical").alias("segment_id")).distinct().withColumn("served", F.lit(True))
    rows = rows.join(earns, "segment_id", "left").join(served, "segment_id", "left")
    alt, canon, named = F.col("obligation") == "ALTERNATIVE", F.col("obligation") == "CANONICAL", F.col("corridor").isNotNull()
    miles = lambda c, n: F.round(F.coalesce(F.sum(F.when(c, F.col("length_m"))), F.lit(0.0)) / MILE, 3).alias(n)
    return rows.agg(
        F.count_distinct("corridor").alias("corridors"), F.count("*").alias("segments"), F.count_if(canon).alias("canonical_segments"), F.count_if(alt).alias("alternative_segments"),
        F.count_if(alt & F.col("earns").isNotNull()).alias("alternatives_with_credit"), F.count_if(alt & F.col("earns").isNull()).alias("alternatives_without_credit"),
        F.count_if(canon & F.col("served").isNotNull()).alias("canonical_with_an_alternative"), miles(canon, "canonical_miles"), miles(alt, "duplicate_miles"),
        miles(canon & named, "named_canonical_miles"), miles(alt & named, "named_duplicate_miles"), miles(canon & ~named, "unnamed_distinct_miles"), miles(alt & ~named, "unnamed_duplicate_miles"), miles(canon | alt, "miles"),
    )


def coverage_by(ways: DataFrame, most: int = 40) -> DataFrame:
    """(kind, value, features, miles) of ways (segment_type, owner, name, length_m): by type (``?`` if null), by owner (``(blank)``),
    and of the ``most`` names of most miles, ties to smaller names. One pass over the ways."""
    clean = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    kinds = {"type": F.trim(F.coalesce("segment_type", F.lit("?"))), "owner": clean("owner", "(blank)"), "name": clean("name", None)}
    dealt = ways.select("length_m", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()))).alias("s")).where("s.value IS NOT NULL")
    per = dealt.groupBy("s.kind", "s.value").agg(F.count("*").alias("features"), F.round(F.sum("length_m") / MILE, 3).alias("miles"))
    names = per.where("kind = 'name'").orderBy(F.desc("miles"), "value").limit(most)
    return per.where("kind <> 'name'").unionByName(names)


def component_split(members: DataFrame, component: str, streets: int = 6) -> DataFrame:
    """(component, campus_miles, other_miles, households, top_streets) of required members (role, campus_obligation, length_m,
    households, display_name); streets by length, ties to smaller names."""
    required = members.where(F.col("role") == "REQUIRED")
    campus = F.coalesce(F.col("campus_obligation") == "CANONICAL", F.lit(False))
    # names are summed before they are ranked, so a component has one row a name
    per = required.groupBy(component, "display_name").agg(F.sum(F.when(campus, F.col("length_m")).otherwise(0.0)).alias("c"), F.sum("length_m").alias("m"), F.sum("households").alias("h"))
    rank = F.row_number().over(Window.partitionBy(component).orderBy(F.isnull("display_name"), F.round("m", 6).desc(), "display_name"))
    top = F.array_sort(F.collect_list(F.when(F.col("display_name").isNotNull() & (F.col("r") <= streets), F.struct("r", "display_name"))))
    out = per.withColumn("r", rank).groupBy(component).agg(F.round(F.sum("c") / MILE, 3).alias("campus_miles"), F.round((F.sum("m") - F.sum("c")) / MILE, 3).alias("other_miles"), F.coalesce(F.sum("h"), F.lit(0)).alias("households"), top.alias("t"))
    return out.withColumn("top_streets", F.transform("t", lambda x: x["display_name"])).drop("t")
