"""Lines that follow each other become one: chains through places where just two ends meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspan.shared import stored


def _place(p: Column, digits: int) -> Column:
    # 0.0 is added so that -0.0 is the same place as 0.0
    return F.struct((F.round(p["x"], digits) + 0.0).alias("x"), (F.round(p["y"], digits) + 0.0).alias("y"))


def _doubled(now: DataFrame) -> DataFrame:
    """One round of pointer doubling over (dart, next, steps, least): twice as far along, with the least dart passed."""
    on = now.select(F.col("dart").alias("next"), F.col("next").alias("next2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"), F.col("last").alias("last2"))
    far = now.where("next IS NOT NULL").join(on, "next")
    moved = far.select("dart", F.col("next2").alias("next"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least"), F.col("last2").alias("last"))
    return moved.unionByName(now.where("next IS NULL"))


def _followed(darts: DataFrame) -> DataFrame:
    """``darts`` (dart, next) with steps to the end of their chain and the last dart of it; those on rings keep a ``next`` and have
    the least dart of their ring. Rounds are logarithmic in the longest chain; each is a written table."""
    now = stored(darts.select("dart", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("dart").alias("least"), F.col("dart").alias("last")), "merge-darts")
    before = None
    while True:
        seen = tuple(now.where("next IS NOT NULL").agg(F.count("*"), F.sum(F.col("least").cast("decimal(38,0)"))).first())
        # an open chain has fewer unfinished darts after every round; what stays as it was are rings
        if not seen[0] or seen == before:
            return now
        before = seen
        now = stored(_doubled(now), "merge-darts")


def merged_lines(lines: DataFrame, digits: int = 3) -> DataFrame:
    """(merged_id, line, pieces, closed): ``lines`` (line_id, line) joined wherever exactly two ends meet, to ``digits`` decimals.

    Lines may be given in any order and direction. A merged line runs so that
    its last piece has the smaller number of the two ways round, and is named
    after its smallest line_id; a ring begins with its smallest piece, in that
    piece's direction. Lines of fewer than two points are left out; a line that
    closes itself is a ring of one piece. Each line is two darts, one for each
    direction, and chains are followed by pointer doubling, so no chain is ever
    walked in one place; only the points of one merged line come together.
    """
    ways = lines.where(F.size("line") > 1).select(F.col("line_id").cast("long").alias("line_id"), "line")
    first, last = _place(F.element_at("line", 1), digits), _place(F.element_at("line", -1), digits)
    ends = stored(ways.select("line_id", F.posexplode(F.array(first, last)).alias("end", "at")), "merge-ends")
    two = ends.groupBy("at").agg(F.count("*").alias("n")).where("n = 2").select("at")
    joint = ends.join(two, "at")
    # arriving at an end, the way goes on from the other end that is there
    a, b = joint.select("at", "line_id", "end"), joint.select("at", F.col("line_id").alias("to"), F.col("end").alias("to_end"))
    goes = a.join(b, "at").where((F.col("line_id") != F.col("to")) | (F.col("end") != F.col("to_end")))
    nexts = goes.select((F.col("line_id") * 2 + 1 - F.col("end")).alias("dart"), (F.col("to") * 2 + F.col("to_end")).alias("next"))
    darts = ways.select(F.explode(F.array(F.col("line_id") * 2, F.col("line_id") * 2 + 1)).alias("dart")).join(nexts, "dart", "left")
    done = _followed(darts)
    ring = done.where("next IS NOT NULL")
    if not ring.isEmpty():
        # a ring is cut before its least dart; of its two directions that with the even one stays
        kept = stored(ring.where("least % 2 = 0").select("dart", F.col("least").alias("root")), "merge-rings")
        cut = kept.join(nexts, "dart").select("dart", F.when(F.col("next") != F.col("root"), F.col("next")).alias("next"))
        rings = _followed(cut).select("dart", "steps", "last").withColumn("closed", F.lit(True))
    chains = done.where("next IS NULL").select("dart", "steps", "last").withColumn("closed", F.lit(False))
    heads = chains.groupBy("last").agg(F.max(F.struct("steps", "dart")).alias("h")).select("last", F.col("h.dart").bitwiseXOR(F.lit(1)).alias("other"))
    placed = chains.join(heads.where("last < other").select("last"), "last", "left_semi")
    if not ring.isEmpty():
        placed = placed.unionByName(rings)
    turned = placed.withColumn("line_id", F.floor(F.col("dart") / 2)).join(ways, "line_id").withColumn("line", F.when(F.col("dart") % 2 == 1, F.reverse("line")).otherwise(F.col("line")))
    per = turned.groupBy("last", "closed").agg(F.min("line_id").alias("merged_id"), F.count("*").alias("pieces"), F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("s"), "line"))).alias("all"))
    rest = F.flatten(F.transform("all", lambda p: F.slice(p["line"], F.lit(2), F.size(p["line"]) - 1)))
    return per.select("merged_id", F.concat(F.slice(F.get("all", F.lit(0))["line"], 1, 1), rest).alias("line"), "pieces", "closed")
