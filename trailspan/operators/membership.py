"""Which segments belong to a routing network, what each map layer shows, and what a network holds in all.

Segments have dataset, connector_class, role, role_status, segment_type, walkable, length_m and more, as each function says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspan.operators.rules import first_match

# Fixed values.
DERIVED, TRUSTED, MILE = "DERIVED", "HIGH_CONFIDENCE", 1609.344


def miles(metres: Column) -> Column:
    return F.round(metres / MILE, 3)


def membership(dataset: Column, connector_class: Column, role: Column, walkable: Column) -> Column:
    """struct(keep, reason). Derived links come first, so that the reason names their class and not that they are closed."""
    derived = F.coalesce(dataset == DERIVED, F.lit(False))
    trusted = F.coalesce(connector_class == TRUSTED, F.lit(False))
    open_ = F.coalesce(walkable, F.lit(False))
    reason = (
        F.when(derived, F.concat(F.lit("derived link: "), F.coalesce(connector_class, F.lit("unclassified"))))
        .when(role == "EXCLUDED", "excluded").when(~open_, "not walkable").when(role == "REQUIRED", "required")
        .when(role == "OPTIONAL_CONNECTOR", "connector of a source").otherwise(F.concat(F.lit("role "), F.coalesce(role, F.lit("none"))))
    )
    keep = F.when(derived, trusted).otherwise(open_ & F.coalesce(role.isin("REQUIRED", "OPTIONAL_CONNECTOR"), F.lit(False)))
    return F.struct(keep.alias("keep"), reason.alias("reason"))


def what_if(segments: DataFrame, routable: DataFrame, key: str) -> DataFrame:
    """Members if just the derived links in ``routable`` were open; whether the build had closed them is not asked."""
    derived = segments.where(F.col("dataset") == DERIVED).join(routable.select(key).distinct(), key, "left_semi")
    others = segments.where(~F.coalesce(F.col("dataset") == DERIVED, F.lit(False)) & F.col("walkable") & (F.coalesce("role", F.lit("")) != "EXCLUDED"))
    return derived.unionByName(others)


def frozen(dataset: Column, routable: Column, role: Column, walkable: Column) -> Column:
    """Membership when a candidate is frozen: open, not excluded, and of derived links those open by default."""
    return F.coalesce(walkable, F.lit(False)) & (F.coalesce(role, F.lit("")) != "EXCLUDED") & (~F.coalesce(dataset == DERIVED, F.lit(False)) | F.coalesce(routable, F.lit(False)))


def affects_coverage(role: Column, status: Column) -> Column:
    return role.isin("REQUIRED", "EXCLUDED") & status.isin("NEEDS_REVIEW", "PROVISIONAL")


def layer(dataset: Column, role: Column, kind: Column) -> Column:
    """Map layer of a segment."""
    return first_match([("derived", dataset == DERIVED), ("excluded", role == "EXCLUDED"), ("required_trail", (role == "REQUIRED") & (kind == "TRAIL")), ("required_street", role == "REQUIRED")], "connector")


def excluded_reasons(segments: DataFrame) -> DataFrame:
    """(reason, segments) of what stays out."""
    m = membership(F.col("dataset"), F.col("connector_class"), F.col("role"), F.col("walkable"))
    return segments.select(m.alias("m")).where("NOT m.keep").groupBy(F.col("m.reason").alias("reason")).agg(F.count("*").alias("segments"))


def network_stats(members: DataFrame) -> DataFrame:
    """One row about the members of a network. Streets, trails and campus ways part the required length among them: campus goes
    first, by its obligation and not by its type."""
    required = F.col("role") == "REQUIRED"
    campus = F.coalesce(F.col("campus_obligation") == "CANONICAL", F.lit(False))
    derived = F.coalesce(F.col("dataset") == DERIVED, F.lit(False))
    connector = (F.col("role") == "OPTIONAL_CONNECTOR") & ~derived
    some = {
        "required": required, "required_street": required & ~campus & (F.col("segment_type") == "STREET"), "required_trail": required & ~campus & (F.col("segment_type") == "TRAIL"),
        "required_campus": required & campus, "connector": connector, "derived": derived, "campus_alternative": F.col("campus_obligation") == "ALTERNATIVE",
    }
    aggs = [a for k, c in some.items() for a in (F.count_if(c).alias(f"{k}_segments"), miles(F.coalesce(F.sum(F.when(c, F.col("length_m"))), F.lit(0.0))).alias(f"{k}_miles"))]
    return members.agg(F.count("*").alias("segments"), miles(F.coalesce(F.sum("length_m"), F.lit(0.0))).alias("miles"), F.coalesce(F.sum("households"), F.lit(0)).alias("households"), *aggs)


def content_hash(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(n, hash): 16 hex digits that do not depend on the order of rows; one aggregation with map-side combine, no sort."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    part = lambda k: F.sum(F.conv(F.substring("r", 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).alias(f"s{k}")
    text = F.concat_ws(":", "n", *(F.coalesce(F.col(f"s{k}").cast("string"), F.lit("0")) for k in range(4)))
    return frame.select(row.alias("r")).agg(F.count("*").alias("n"), *map(part, range(4))).select("n", F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


def resolved_credits(members: DataFrame, credits: DataFrame) -> DataFrame:
    """(alternative, canonical, fraction, found): coverage that walking an alternative earns; credits to segments outside the
    network are kept apart as not found, so that they can be counted."""
    known = members.select(F.col("segment_id").alias("canonical"), F.lit(True).alias("found"))
    mine = credits.join(members.select(F.col("segment_id").alias("alternative")), "alternative", "left_semi")
    return mine.join(known, "canonical", "left").select("alternative", "canonical", "fraction", F.coalesce("found", F.lit(False)).alias("found"))
