"""Homes and sites: who counts, which line serves them, and what becomes of sites that are out of reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.functions.keys import composite_key
from trailspan.operators.network import passed_cells, straight_pieces
from trailspan.shared import stored

# Tiers and sizes of the site rules.
REACHABLE_SHARE, MOSTLY_SHARE, SMALL_ACRES, NO_NETWORK_M, ACRE_M2 = 0.10, 0.35, 6.0, 25.0, 4046.86
#: Fixed values of the association: a name match counts 12 m less, an owed line 1000 m less, nothing beyond 75 m.
CAP_M, NAME_M, OWED_M = 75.0, 12.0, 1000.0


def is_dwelling(kind: Column, landmark: Column) -> Column:
    """Residential, and not vacant, demolished or under construction."""
    fine = ~F.lower(F.coalesce(landmark, F.lit(""))).rlike("vacant|demolished|construction")
    return (F.trim(F.coalesce(kind, F.lit(""))) == "Residential") & fine


def address_key(number: Column, *parts: Column) -> Column:
    """Composite key whose first part is a house number: a whole number if it is one, else nothing."""
    whole = F.try_to_number(F.trim(number.cast("string")), F.lit("999999999.99"))
    return composite_key(F.when(whole.isNotNull(), whole.cast("long")), *parts)


def funnel(homes: DataFrame, kind: str, landmark: str, key: Column) -> DataFrame:
    """One row: addresses, residential, dwellings, distinct units and rows that repeat one."""
    dwelling = is_dwelling(F.col(kind), F.col(landmark))
    made = homes.withColumn("_k", F.when(dwelling, key))
    return made.agg(
        F.count("*").alias("addresses"), F.count_if(F.trim(F.col(kind)) == "Residential").alias("residential"), F.count_if(dwelling).alias("dwellings"),
        F.count_distinct("_k").alias("units"), (F.count_if(dwelling) - F.count_distinct("_k")).alias("repeats"),
    )


#: Radii that are tried one after the other, as shares of the cap, and the lines in reach from which one is worth a trial.
TRIALS, ENOUGH = (1 / 64, 1 / 16, 1 / 4), 16


def _best_within(homes: DataFrame, pieces: DataFrame, radius: float, most: int, by: list[str]) -> DataFrame:
    """(home_id, line_id, distance, score) of the ``most`` best pieces of lines within ``radius`` of each home, among those equal in
    ``by``. Pieces stand in every cell from which they are in reach and a home in one, so its rows are dealt once: they are
    joined, made one a line and ranked without being moved again."""
    cell, parts = radius, int(homes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small tables that meet often are not brought together
    three = lambda f: F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), f))
    nine = lambda c: three(lambda i: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda j: F.struct((c["cx"] + i).alias("cx"), (c["cy"] + j).alias("cy"))))
    around = F.explode(F.array_distinct(F.flatten(F.transform(passed_cells(F.col("a"), F.col("b"), cell), nine)))).alias("c")
    size = {k: (F.col(f"b.{k}") - F.col(f"a.{k}")).alias(f"d{k}") for k in "xy"}
    ends = [f(f"a.{k}", f"b.{k}").alias(f"{k}{i}") for k in "xy" for i, f in ((0, F.least), (1, F.greatest))]
    key = ["cx", "cy", *by]
    dealt = pieces.select("line_id", F.col("name").alias("line_name"), *by, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), *size.values(), *ends, around).select("*", "c.cx", "c.cy").drop("c")
    here = homes.select("home_id", "x", "y", F.col("name").alias("home_name"), *by, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    box = lambda k: F.col(k).between(F.col(f"{k}0") - 1.001 * radius, F.col(f"{k}1") + 1.001 * radius)
    met = here.repartition(parts, *key).join(dealt.repartition(parts, *key).hint("merge"), key).where(box("x") & box("y"))
    # the steps of geometry.nearest_on_segment, each worked out once a row; the radius is asked for last, or all would stand in the join
    met = met.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * F.col("dx") + (F.col("y") - F.col("ay")) * F.col("dy")) / (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))))
    foot = lambda k, o: F.when(F.col(f"d{o}") == 0, F.greatest(F.col(f"{k}0"), F.least(F.col(f"{k}1"), F.col(k)))).otherwise(F.col(f"a{k}") + F.col("t") * F.col(f"d{k}"))
    met = met.withColumn("gx", F.col("x") - foot("x", "y")).withColumn("gy", F.col("y") - foot("y", "x"))
    same = F.coalesce(F.col("home_name") == F.col("line_name"), F.lit(False))
    near = met.groupBy(*key, "home_id", "line_id").agg(F.min(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("distance"), F.first(same).alias("same")).where(F.col("distance") <= radius)
    near = near.withColumn("score", F.col("distance") - F.when(F.col("same"), NAME_M).otherwise(0.0))
    rank = F.row_number().over(Window.partitionBy(*key, "home_id").orderBy("score", "distance", ~F.col("same"), "line_id"))
    return near.withColumn("r", rank).where(F.col("r") <= most).select("home_id", "line_id", "distance", "same", "score")


def _best_of_kind(homes: DataFrame, pieces: DataFrame, cap: float, most: int) -> DataFrame:
    """(home_id, r, line_id, distance) of each home's ``most`` best pieces of lines within ``cap``, where all are owed or none is.

    Small radii come first. No line that a trial leaves out scores less than its radius, as those of the home's name are looked for
    NAME_M farther: so a home whose last wanted line scores less is done, and only the others go on to the next radius.
    """
    facts = pieces.agg(
        F.count("*").alias("n"), F.avg(F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))).alias("size"),
        *(f(F.col(f"a.{k}")).alias(f"{k}{i}") for k in "xy" for i, f in ((0, F.min), (1, F.max))),
    ).first()
    area = max(1.0, ((facts["x1"] or 0) - (facts["x0"] or 0) + (facts["size"] or 0)) * ((facts["y1"] or 0) - (facts["y0"] or 0)))
    tried = [r for r in (cap * t for t in TRIALS) if facts["n"] / area * 2 * r * ((facts["size"] or 0) + 2 * r) >= ENOUGH]
    out, left = None, homes
    for radius in [*tried, cap]:
        found = _best_within(left, pieces, radius, most, [])
        if radius < cap:
            found = found.unionByName(_best_within(left.where("name IS NOT NULL"), pieces, min(cap, radius + NAME_M), most, ["name"])).distinct()
        rank = F.row_number().over(Window.partitionBy("home_id").orderBy("score", "distance", ~F.col("same"), "line_id"))
        best = found.withColumn("r", rank).where(F.col("r") <= most)
        if radius < cap:
            best = stored(best, "home-best")
            sure = best.where((F.col("r") == most) & (F.col("score") < radius - 1e-6)).select("home_id")
            left = stored(left.join(sure.hint("merge"), "home_id", "left_anti"), "home-left")
            best = best.join(sure.hint("merge"), "home_id", "left_semi")
        best = best.select("home_id", "r", "line_id", "distance")
        out = best if out is None else out.unionByName(best)
    return out


def associated(homes: DataFrame, lines: DataFrame, cap: float = CAP_M, secondary: int = 3) -> DataFrame:
    """(home_id, main, others, distance, reason) for homes (home_id, x, y, name) and lines (line_id, line, name, owed).

    Of the lines within the cap, the best is that of least distance less the
    bonuses of an equal name and of an owed line, then least distance, a name
    match, the smaller id; the next ones are listed. A home without any has the
    reason BEYOND_CAP. Any owed line comes before any other, so the others are
    looked for only by homes that have too few owed ones within the cap (see
    _best_of_kind). Homes of one place and name are sought for once, and of lines
    that differ in their ids only, the first that could be listed.
    """
    most = 1 + secondary
    if OWED_M <= cap + NAME_M:
        raise ValueError("an owed line must come before all others")
    copies = F.row_number().over(Window.partitionBy("line", "name", "owed").orderBy("line_id"))
    everyone = homes.withColumn("_like", F.struct("x", "y", "name"))
    homes = stored(homes.select("x", "y", "name").where("x IS NOT NULL AND y IS NOT NULL").distinct().withColumn("home_id", F.struct("x", "y", "name")), "homes")
    lines = stored(lines.withColumn("_copy", copies).where(F.col("_copy") <= most).drop("_copy"), "home-lines")
    pieces = stored(straight_pieces(lines.select("line_id", "line"), False).join(lines.select("line_id", "name", F.coalesce("owed", F.lit(False)).alias("owed")).hint("merge"), "line_id"), "home-pieces")
    owed = stored(_best_of_kind(homes, pieces.where("owed"), cap, most), "home-owed")
    full = owed.where(F.col("r") == most).select("home_id")
    rest = stored(homes.join(full.hint("merge"), "home_id", "left_anti"), "home-rest")
    other = _best_of_kind(rest, pieces.where("NOT owed"), cap, most).withColumn("r", F.col("r") + most)
    best = owed.unionByName(other).groupBy("home_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("r", "line_id", "distance"))), 1, most).alias("b"))
    out = everyone.select("home_id", "_like").join(best.withColumnRenamed("home_id", "_like").hint("merge"), "_like", "left")
    first = F.get("b", F.lit(0))
    return out.select("home_id", first["line_id"].alias("main"), F.coalesce(F.transform(F.slice("b", 2, most), lambda x: x["line_id"]), F.array().cast("array<bigint>")).alias("others"), first["distance"].alias("distance"), F.when(F.col("b").isNull(), "BEYOND_CAP").alias("reason"))


# An attachment by name is sure within SURE_M, one without is likely within LIKELY_M.
SURE_M, LIKELY_M = 40.0, 25.0


def confidence(distance: Column, same_name: Column) -> Column:
    """HIGH, MEDIUM or LOW trust in one attachment; a null match is none."""
    same = F.coalesce(same_name, F.lit(False))
    return F.when(same & (distance <= SURE_M), "HIGH").when(same | (distance <= LIKELY_M), "MEDIUM").otherwise("LOW")


def association_stats(links: DataFrame, lines: DataFrame) -> DataFrame:
    """(stat, n) of links (home_id, main, distance, same_name) as ``associated`` gives them: confidence_*, role_* by the lines'
    role (line_id, role), associated and unassociated. Each line's role is met once; one pass over the links."""
    own = links.join(lines.select(F.col("line_id").alias("main"), "role"), "main", "left")
    got = F.col("main").isNotNull()
    stats = F.array(
        F.when(got, F.concat(F.lit("confidence_"), F.lower(confidence(F.col("distance"), F.col("same_name"))))),
        F.when(got, F.concat(F.lit("role_"), F.lower(F.coalesce("role", F.lit("none"))))), F.when(got, "associated").otherwise("unassociated"),
    )
    return own.select(F.explode(stats).alias("stat")).where("stat IS NOT NULL").groupBy("stat").agg(F.count("*").alias("n"))


def site_disposition(units: Column, beyond: Column, network_m: Column, area_m2: Column) -> Column:
    """struct(disposition, hold): accept, hold the units beyond the cap, or hold all until there is a network."""
    share = beyond / units
    none = network_m < NO_NETWORK_M
    hold_all = (share > MOSTLY_SHARE) | (none & (share > REACHABLE_SHARE) & (area_m2 / ACRE_M2 > SMALL_ACRES))
    name = F.when(hold_all, "ADD_AUTHORITATIVE_PEDESTRIAN_NETWORK").when(share > REACHABLE_SHARE, "ASSOCIATE_WITH_FRONTAGE_STREETS").otherwise("ACCEPT_AUTOMATIC_ASSOCIATION")
    hold = F.when(hold_all, "ALL").when(share > REACHABLE_SHARE, "BEYOND_CAP_ONLY").otherwise("NONE")
    return F.struct(name.alias("disposition"), hold.alias("hold"))


def ratio_verdict(ours: Column, theirs: Column) -> Column:
    """PASS near 1, FAIL near a factor of 3.28 either way (feet for metres), else WARN; null totals warn."""
    r = F.try_divide(ours.cast("double"), theirs)
    return F.when(r.between(0.9, 1.1), "PASS").when(r.between(3.0, 3.5) | r.between(0.28, 0.34), "FAIL").otherwise("WARN")
