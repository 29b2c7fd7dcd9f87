"""Event-sourced state: holds that expire, state machines, idempotent records, last-write-wins. Batch folds; ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_holds(events: DataFrame, key: list[str], ts: str, event_id: str, take: Column, release: Column, now: str, minutes: int) -> DataFrame:
    """Holds that live at ``now``: a key's last take, not released since and not yet expired.

    One aggregation with map-side combine; events after ``now`` do not count; of
    events at one instant the larger event_id is later.
    """
    at = F.lit(now).cast("timestamp")
    last = lambda c: F.max(F.when(c, F.struct(F.col(ts).alias("at"), F.col(event_id).alias("id"))))
    state = events.where(F.col(ts) <= at).groupBy(*key).agg(last(take).alias("taken"), last(release).alias("freed"))
    ends = F.col("taken.at") + F.make_interval(mins=F.lit(minutes))
    alive = F.col("taken").isNotNull() & (F.col("freed").isNull() | (F.col("freed") < F.col("taken"))) & (ends > at)
    return state.where(alive).select(*key, F.col("taken.at").alias("reserved_at"), ends.alias("expires_at"))


def last_by(frame: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Last write of each key: an aggregation over structs, no sort."""
    last = F.max(F.struct(*order, *(c for c in columns if c not in order)))
    return frame.groupBy(*key).agg(last.alias("_last")).select(*key, *(F.col(f"_last.{c}").alias(c) for c in columns))


def walked_states(events: DataFrame, key: str, order: list[str], kind: str, steps: list[str]) -> DataFrame:
    """State of each key after its events: step k counts only after step k - 1, as the first such event later than that.

    ``state`` is the last step reached, null before the first.
    """
    out = events.select(key).distinct()
    before: DataFrame | None = None
    for i, step in enumerate(steps):
        mine = events.where(F.col(kind) == step).select(key, F.struct(*order).alias("_at"))
        if before is not None:
            mine = mine.join(before, key).where(F.col("_at") > F.col("_before")).drop("_before")
        before = mine.groupBy(key).agg(F.min("_at").alias("_before"))
        out = out.join(before.select(key, F.lit(True).alias(f"_s{i}")), key, "left")
    state = F.coalesce(*(F.when(F.col(f"_s{i}"), s) for i, s in reversed(list(enumerate(steps)))))
    return out.select(key, state.alias("state"))


def newly_recorded(chosen: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """What is to be appended so that recording again changes nothing."""
    return chosen.select(*key).distinct().join(existing.select(*key).distinct(), key, "left_anti")


def plan_changes(planned: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Rows added to and removed from a plan, each once."""
    p, a = planned.select(*key).distinct(), actual.select(*key).distinct()
    return a.exceptAll(p).withColumn("change", F.lit("added")).unionByName(p.exceptAll(a).withColumn("change", F.lit("removed")))


def gaps(events: DataFrame, key: str, order: list[str], ts: str, least: float, most: float) -> DataFrame:
    """Minutes from each event to the one before it of the same key, null unless least < minutes <= most."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(*order))
    minutes = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / F.lit(60_000_000)
    return events.select(key, *order, F.when((minutes > least) & (minutes <= most), minutes).alias("minutes"))
