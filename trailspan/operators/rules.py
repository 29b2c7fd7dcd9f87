"""Ordered rules: the first that holds decides; what disagrees is kept as reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """Name of the first rule that holds; a null condition does not hold."""
    out: Column | None = None
    for name, condition in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    if out is None:
        return F.lit(otherwise)
    return out.otherwise(otherwise) if otherwise is not None else out


def reasons(rules: Sequence[tuple[str | Column, Column]]) -> Column:
    """Array of the texts of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, t if isinstance(t, Column) else F.lit(t)) for t, c in rules)))


def stress(speed: Column, road_class: Column) -> Column:
    """1 calm to 5 hostile: a step by speed, one more on the classes of large roads."""
    base = F.when(speed.isNull(), 2).when(speed <= 20, 1).when(speed <= 25, 2).when(speed <= 35, 3).when(speed <= 45, 4).otherwise(5)
    bump = F.when(road_class.isin("Arterial", "Primary"), 1).when((road_class == "Collector") & (base < 3), 1).otherwise(0)
    return F.least(F.lit(5), base + bump)


def classify(owner: Column, owner_private: str, owner_public: Sequence[str], kind: Column, kind_private: str, excluded: Sequence[str], expected: Sequence[str] | None = None) -> Column:
    """struct(access, role, status, reasons): the owner decides; a kind that disagrees about privacy is a conflict to be reviewed.

    Blank texts count as none. A kind outside ``expected`` (if given) is noted.
    """
    owner, kind = F.nullif(F.trim(owner), F.lit("")), F.nullif(F.trim(kind), F.lit(""))
    out = F.coalesce(kind.isin(*excluded), F.lit(False))
    access = first_match([("PRIVATE", owner == owner_private), ("PUBLIC", owner.isin(*owner_public))], "UNKNOWN")
    conflict = F.coalesce(owner == owner_private, F.lit(False)) != F.coalesce(kind == kind_private, F.lit(False))
    role = first_match([("EXCLUDED", out), ("EXCLUDED", access == "PRIVATE"), ("REQUIRED", access == "PUBLIC")], "OPTIONAL_CONNECTOR")
    status = F.when((role == "OPTIONAL_CONNECTOR") | conflict, "NEEDS_REVIEW").otherwise("AUTOMATIC")
    strange = kind.isNotNull() & ~kind.isin(*expected) if expected is not None else F.lit(False)
    why = reasons([
        (F.concat(F.lit("owner "), F.coalesce(owner, F.lit("none")), F.lit(" not recognised")), access == "UNKNOWN"),
        (F.concat(F.lit("owner "), F.coalesce(owner, F.lit("none")), F.lit(" conflicts with kind "), F.coalesce(kind, F.lit("none"))), conflict),
        ("kind is excluded", out), ("owner is private", ~out & (access == "PRIVATE")), (F.concat(F.lit("unexpected kind "), kind), strange),
    ])
    return F.struct(access.alias("access"), role.alias("role"), status.alias("status"), why.alias("reasons"))


def inherit_by_prefix(frame: DataFrame, column: str, rules: Sequence[tuple[str, str]], otherwise: str, name: str = "role") -> DataFrame:
    """Value of the exactly equal rule, or else of the first rule in declared order that the text begins with."""
    text = F.col(column)
    return frame.withColumn(name, first_match([(v, text == k) for k, v in rules] + [(v, text.startswith(k)) for k, v in rules], otherwise))


def totals(frame: DataFrame, role: str, kind: str, weight: Column) -> DataFrame:
    """Count and weight by role, by role and kind, and over all, in one pass."""
    out = frame.withColumn("_w", weight).groupingSets([[F.col(role), F.col(kind)], [F.col(role)], []], F.col(role), F.col(kind))
    return out.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("_w").alias("weight"))


def bucket_report(frame: DataFrame, rules: Sequence[tuple[str, Column]], name: Column, weight: Column, top: int) -> DataFrame:
    """Rows, weight and the ``top`` names by weight for each bucket; every row counts in the first bucket that takes it."""
    placed = frame.select(first_match(rules).alias("bucket"), name.alias("_name"), weight.alias("_w")).where("bucket IS NOT NULL")
    per = placed.groupBy("bucket", "_name").agg(F.count("*").alias("n"), F.sum("_w").alias("w"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("w"), "_name"))
    best = per.withColumn("r", rank).where(F.col("r") <= top).groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "_name"))), lambda x: x["_name"]), ",").alias("top_names"))
    return per.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("w").alias("weight")).join(best, "bucket")


def bucket_ids(frame: DataFrame, rules: Sequence[tuple[str, Column]], key: Column, most: int = 400) -> DataFrame:
    """(bucket, ids): the ``most`` smallest distinct keys of each bucket in order, for people to look at. Nulls are no key. Only rows
    that can be among them are shuffled, as the limit is applied in each task first."""
    placed = frame.select(first_match(rules).alias("bucket"), key.alias("_k")).where("bucket IS NOT NULL AND _k IS NOT NULL").distinct()
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("_k"))
    return placed.withColumn("_r", rank).where(F.col("_r") <= most).groupBy("bucket").agg(F.array_sort(F.collect_list("_k")).alias("ids"))
