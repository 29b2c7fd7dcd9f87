"""Keys, fingerprints and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspan.shared import stored

def composite_key(*parts: Column) -> Column:
    """Upper-cased parts that are not blank, with a space between."""
    return F.upper(F.concat_ws(" ", *(F.when(F.trim(p.cast("string")) != "", F.trim(p.cast("string"))) for p in parts)))


def fingerprint(values: Column, prefix: str = "cs", digits: int = 12) -> Column:
    """``prefix-n-hash`` of an array of integers, whatever its order: the hash is over the sorted values, each followed by a comma."""
    text = F.concat_ws("", F.transform(F.array_sort(values), lambda v: F.concat(v.cast("string"), F.lit(","))))
    return F.concat(F.lit(prefix + "-"), F.size(values).cast("string"), F.lit("-"), F.substring(F.sha2(text, 256), 1, digits))


def held_fingerprint(values: Column, digits: int = 12) -> Column:
    """``n-hash`` of a set of integers held, ``0`` for none or null: two different sets never share a name for being held."""
    some = F.array_distinct(values)
    text = F.concat_ws("", F.transform(F.array_sort(some), lambda v: F.concat(v.cast("string"), F.lit(","))))
    name = F.concat(F.size(some).cast("string"), F.lit("-"), F.substring(F.sha2(text, 256), 1, digits))
    return F.when(F.size(F.coalesce(values, F.array())) > 0, name).otherwise("0")


def assigned(key: Column, n: int) -> Column:
    """A fixed one of ``n`` places for a key: the first 8 hex digits of its sha256, modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(n))


def numbered(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``name``: 1, 2, 3 ... in the given order, which must be total.

    Ranges are cut first and written once, so each task numbers its own rows and
    only the counts of the ranges, one row each, are summed up in one place.
    """
    parts = stored(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "id-ranges")
    local = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = parts.groupBy("_part").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def stable_ids(frame: DataFrame, order: list[Column], prefix: str = "SEG", name: str = "stable_id") -> DataFrame:
    """``prefix-000001`` and so on in the given order, which must be total."""
    return numbered(frame, order, name).withColumn(name, F.format_string(prefix + "-%06d", F.col(name)))


def keep_first(frame: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order: an aggregation that combines on the map side, so no key's rows are sorted in
    one place. Null keys are one key."""
    columns = [F.col(c) for c in frame.columns]
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return frame.groupBy(*key).agg(first).select(*(F.col(f"_first.{c}").alias(c) for c in frame.columns))
