"""Completions as records with an audit trail: outcomes, edits, corrections and reversals.

Tables: walks (walk, person, outcome, distance), planned and chosen (walk, segment_id), completions (walk, segment_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspan.operators.membership import MILE, miles

KEY = ["walk", "segment_id"]


def final_segments(walks: DataFrame, planned: DataFrame, chosen: DataFrame, segments: DataFrame, credits: DataFrame | None = None, share: float = 0.6) -> DataFrame:
    """(walk, segment_id, via_alternative): required segments that each walk earns.

    AS_PLANNED takes the plan, EDITED what was chosen, DID_NOT_COMPLETE nothing.
    Ids that are no segments are ignored. ``credits`` (alternative, canonical,
    fraction) add canonical segments whose fractions reach ``share``.
    """
    asked = planned.join(walks.where("outcome = 'AS_PLANNED'").select("walk"), "walk", "left_semi").select(*KEY)
    asked = asked.unionByName(chosen.join(walks.where("outcome = 'EDITED'").select("walk"), "walk", "left_semi").select(*KEY)).distinct()
    required = segments.where("role = 'REQUIRED'").select("segment_id")
    own = asked.join(required, "segment_id", "left_semi").select(*KEY, F.lit(False).alias("via_alternative"))
    if credits is None:
        return own
    walked = asked.join(segments.select("segment_id"), "segment_id", "left_semi")
    earned = walked.join(credits.withColumnRenamed("alternative", "segment_id"), "segment_id").groupBy("walk", F.col("canonical").alias("segment_id")).agg(F.sum("fraction").alias("f")).where(F.col("f") >= share)
    more = earned.join(required, "segment_id", "left_semi").join(walked, KEY, "left_anti").select(*KEY, F.lit(True).alias("via_alternative"))
    return own.unionByName(more)


def new_completions(final: DataFrame, planned: DataFrame, walks: DataFrame, existing: DataFrame) -> DataFrame:
    """(walk, segment_id, source, via_alternative) to append; recording again appends nothing."""
    hit = final.join(existing.select(*KEY), KEY, "left_anti").join(planned.select(*KEY, F.lit(True).alias("was")).distinct(), KEY, "left").join(walks.select("walk", "outcome"), "walk")
    source = F.when(F.col("outcome") == "AS_PLANNED", "AS_PLANNED").when(F.col("was").isNull(), "MANUAL_ADDITION").otherwise("EDITED")
    return hit.select(*KEY, source.alias("source"), "via_alternative")


def edits(final: DataFrame, planned: DataFrame, walks: DataFrame, edited: DataFrame | None = None) -> DataFrame:
    """(walk, segment_id, kind): what was ADDED to and REMOVED from each plan; walks in ``edited`` have theirs already."""
    p = planned.join(walks.select("walk"), "walk", "left_semi").select(*KEY).distinct()
    f = final.select(*KEY).distinct()
    out = f.join(p, KEY, "left_anti").withColumn("kind", F.lit("ADDED")).unionByName(p.join(f, KEY, "left_anti").withColumn("kind", F.lit("REMOVED")))
    return out if edited is None else out.join(edited.select("walk").distinct(), "walk", "left_anti")


def final_distance(walks: DataFrame, final: DataFrame, planned: DataFrame, segments: DataFrame) -> DataFrame:
    """(walk, miles): as planned the plan's distance; edited, what was claimed and the plan's connectors; not completed, 0."""
    lengths = segments.select("segment_id", "length_m", "role")
    claimed = final.where("NOT via_alternative").join(lengths, "segment_id").select("walk", "length_m")
    links = planned.select(*KEY).distinct().join(lengths.where("role <> 'REQUIRED'"), "segment_id").select("walk", "length_m")
    sums = claimed.unionByName(links).groupBy("walk").agg(F.sum("length_m").alias("m"))
    got = F.when(F.col("outcome") == "AS_PLANNED", F.col("distance")).when(F.col("outcome") == "EDITED", miles(F.coalesce("m", F.lit(0.0)))).otherwise(0.0)
    return walks.join(sums, "walk", "left").select("walk", got.alias("miles"))


def good_reason(reason: Column) -> Column:
    return F.coalesce(F.length(F.trim(reason)) >= 5, F.lit(False))


def reversed_segments(completions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(completions left, audit rows (action, subject, rows, reason)): requests (segment_id, reason) with a good reason remove
    every completion of their segment. The audit is derived from the state before, and is to be written first."""
    asked = requests.where(good_reason(F.col("reason"))).groupBy("segment_id").agg(F.min(F.trim("reason")).alias("reason"))
    counts = completions.join(asked, "segment_id").groupBy("segment_id", "reason").agg(F.count("*").alias("rows"))
    return completions.join(asked, "segment_id", "left_anti"), counts.select(F.lit("reverse_completion").alias("action"), F.col("segment_id").alias("subject"), "rows", "reason")


def corrected(completions: DataFrame, walks: DataFrame, corrections: DataFrame, planned: DataFrame, chosen: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(completions, audit rows (action, subject, from_outcome, to_outcome, rows)): the walks of ``corrections`` (walk, outcome,
    reason) are cleared and recorded anew, so that a correction can take away as well as add. The plan is never rewritten."""
    asked = corrections.where(good_reason(F.col("reason")) & F.col("outcome").isin("AS_PLANNED", "EDITED", "DID_NOT_COMPLETE")).select("walk", F.col("outcome").alias("to_outcome"))
    mine = walks.join(asked, "walk")
    before = completions.join(asked.select("walk"), "walk", "left_semi").groupBy("walk").agg(F.count("*").alias("rows"))
    audit = mine.join(before, "walk", "left").select(F.lit("correct_walk").alias("action"), F.col("walk").alias("subject"), F.col("outcome").alias("from_outcome"), "to_outcome", F.coalesce("rows", F.lit(0)).alias("rows"))
    anew = final_segments(mine.select("walk", F.col("to_outcome").alias("outcome")), planned, chosen, segments).select(*KEY)
    return completions.join(mine.select("walk"), "walk", "left_anti").select(*KEY).unionByName(anew), audit


def progress(segments: DataFrame, completions: DataFrame, holds: DataFrame) -> DataFrame:
    """(segment_id, kind, done, held) of what the map shows: required segments but the alternatives; held only while open."""
    done = completions.select("segment_id", F.lit(True).alias("d")).distinct()
    held = holds.select("segment_id", F.lit(True).alias("h")).distinct()
    shown = segments.where((F.col("role") == "REQUIRED") & (F.coalesce("campus_obligation", F.lit("")) != "ALTERNATIVE"))
    kind = F.when(F.col("campus_obligation") == "CANONICAL", "campus").when(F.col("segment_type") == "TRAIL", "trail").otherwise("street")
    d = F.coalesce("d", F.lit(False))
    return shown.join(done, "segment_id", "left").join(held, "segment_id", "left").select("segment_id", kind.alias("kind"), d.alias("done"), (F.coalesce("h", F.lit(False)) & ~d).alias("held"))


def others_holds(holds: DataFrame, person: str | int | None = None, walk: str | int | None = None) -> DataFrame:
    """Live holds but those of one person or walk, whose own never stand in their way."""
    out = holds
    if person is not None:
        out = out.where(~F.col("person").eqNullSafe(F.lit(person)))
    return out.where(~F.col("walk").eqNullSafe(F.lit(walk))) if walk is not None else out


def snapshot(segments: DataFrame, completions: DataFrame, holds: DataFrame, person: str | int | None, damping: float) -> DataFrame:
    """(segment_id, done, reserved, worth) of every segment as a request of ``person`` sees the town: finished by anyone, held by
    someone else, and what is left of its prize: nothing once finished, ``damping`` of it while others hold it, else all. A
    person's own holds damp nothing; a null person has none."""
    done = completions.select("segment_id", F.lit(True).alias("d")).distinct()
    held = others_holds(holds, person).select("segment_id", F.lit(True).alias("h")).distinct()
    seen = segments.select("segment_id").distinct().join(done, "segment_id", "left").join(held, "segment_id", "left")
    d, h = F.coalesce("d", F.lit(False)), F.coalesce("h", F.lit(False))
    return seen.select("segment_id", d.alias("done"), h.alias("reserved"), F.when(d, 0.0).when(h, damping).otherwise(1.0).alias("worth"))


def people_walks(people: DataFrame, walks: DataFrame) -> DataFrame:
    """(person, completed_walks): everybody, 0 for those without a completed walk."""
    return people.join(walks.where("status = 'COMPLETED'").groupBy("person").agg(F.count("*").alias("n")), "person", "left").select("person", F.coalesce("n", F.lit(0)).alias("completed_walks"))


def latest(frame: DataFrame, order: str, tie: str, wanted: int, cap: int = 500) -> DataFrame:
    """The newest rows, never more than ``cap``: a bounded sort."""
    return frame.orderBy(F.desc(order), F.desc(tie)).limit(min(wanted, cap))


def completion_share(segments: DataFrame, completions: DataFrame) -> DataFrame:
    """One row: share of required segments that are done, and the required miles still open."""
    done = completions.select("segment_id", F.lit(1).alias("d")).distinct()
    rows = segments.where("role = 'REQUIRED'").join(done, "segment_id", "left")
    return rows.agg(F.round(F.count("d") / F.count("*"), 6).alias("fraction"), F.round(F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("length_m"))), F.lit(0.0)) / MILE, 3).alias("open_miles"))
