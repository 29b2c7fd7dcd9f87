"""Holds and counts as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, change string, at timestamp, expires_at timestamp"


def hold_changes(events: DataFrame, key: str, ts: str, kind: str, take: str, release: str, minutes: int, lateness: str = "10 minutes") -> DataFrame:
    """Stream of changes (taken, renewed, released, expired) of each key's hold.

    A hold is taken by an event of kind ``take``, renewed by another while it
    lives, freed by one of kind ``release``, and expires ``minutes`` after its
    last take once the watermark has passed that instant. The state of a key is
    its expiry alone, and it goes with the hold. Events of a batch are put in
    order of time first; events later than the watermark are dropped by Spark.
    """
    span = pd.Timedelta(minutes=minutes)

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, out = group[0], []
        until = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        if state.hasTimedOut:
            out.append((name, "expired", until, until))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "kind"])
            for at, what in zip(rows["at"], rows["kind"]):
                if until is not None and until <= at:
                    out.append((name, "expired", until, until))
                    until = None
                if what == take:
                    out.append((name, "taken" if until is None else "renewed", at, at + span))
                    until = at + span
                elif what == release and until is not None:
                    out.append((name, "released", at, at))
                    until = None
            if until is None:
                if state.exists:
                    state.remove()
            else:
                state.update((int(until.value // 1000),))
                state.setTimeoutTimestamp(max(int(until.value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "change", "at", "expires_at"])

    some = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(kind).alias("kind")).where(F.col("kind").isin(take, release))
    return some.withWatermark("at", lateness).groupBy("key").applyInPandasWithState(run, OUT, "until_us long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; a window is complete once the watermark has passed its end."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", lateness)
    return timed.groupBy(F.window("_at", width, slide or width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), kind, "n", "total")


def recorded_once(events: DataFrame, key: list[str], ts: str, lateness: str = "1 day") -> DataFrame:
    """First event of each key, however often it is sent again within the lateness."""
    return events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", lateness).dropDuplicatesWithinWatermark(key)


def append_new(path: str, key: list[str]):
    """A foreachBatch function that appends only keys that the Parquet table at ``path`` does not have: running a batch again
    changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        try:
            known = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None:
            new = new.join(known.select(*key).distinct(), key, "left_anti")
        new.write.mode("append").parquet(path)

    return write
