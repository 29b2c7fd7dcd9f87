"""Rules that turn layers into classified segments: paths, materials, links, overrides, promotion, review queues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspan.functions.keys import numbered
from trailspan.operators.membership import miles
from trailspan.operators.rules import first_match, reasons

# Fixed values.
MATERIAL_FIXES = {"aspahlt": "Asphalt"}
MATERIALS = {
    "concrete": "Concrete", "asphalt": "Asphalt", "brick": "Brick", "concrete/asphalt": "Concrete/Asphalt", "mix": "Mixed",
    "gravel": "Gravel", "dirt": "Dirt", "wood": "Wood", "green lane": "Green Lane",
}
PATH_ACCESS = {"VT": "PUBLIC", "TOB": "PUBLIC", "PRIV": "PRIVATE"}
SHORT_LINK_M, LONG_LINK_M = 10.0, 15.0
LIMITED_CLASSES, TRAFFIC_CLASSES = ("Ramp", "Primary"), ("Arterial", "Collector", "Secondary")


def lookup(key: Column, values: Mapping[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def trimmed(text: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def material(raw: Column) -> Column:
    """struct(value, fixed): the canonical word; unknown words pass; blank and 'review' are null."""
    v = trimmed(raw)
    low = F.lower(v)
    fix = lookup(low, MATERIAL_FIXES)
    value = F.when(v.isNull() | (low == "review"), None).otherwise(F.coalesce(fix, lookup(low, MATERIALS), v))
    return F.struct(value.alias("value"), F.coalesce(fix.isNotNull(), F.lit(False)).alias("fixed"))


def path(kind: Column, owner: Column, in_campus: Column, curated_role: Column, curated_status: Column, trail_kinds: Sequence[str], walk_kinds: Sequence[str]) -> Column:
    """struct(segment_type, access, role, status, walkable, reasons) of a path.

    Trails take their curated role, else wait for review; a private owner
    overrides whatever role was found.
    """
    kind, owner = F.coalesce(F.trim(kind), F.lit("")), trimmed(owner)
    campus = F.coalesce(in_campus, F.lit(False))
    trail, walk, listed = kind.isin(*trail_kinds), kind.isin(*walk_kinds), curated_role.isNotNull()
    private = F.coalesce(owner == "PRIV", F.lit(False))
    role = F.when(private, "EXCLUDED").when(trail & listed, curated_role).otherwise("OPTIONAL_CONNECTOR")
    status = F.when(private, "NEEDS_REVIEW").when(trail & listed, curated_status).otherwise("NEEDS_REVIEW")
    access = F.coalesce(lookup(owner, PATH_ACCESS), F.lit("UNKNOWN"))
    why = reasons([
        ("curated trail", trail & listed), ("campus path to be selected", trail & ~listed & campus), ("trail not on the list", trail & ~listed & ~campus),
        ("campus walk without a street", walk & campus), ("walk without a street", walk & ~campus), ("no rule for this kind", ~trail & ~walk),
        ("private owner", private), ("owner unknown", access == "UNKNOWN"),
    ])
    return F.struct(F.when(trail, "TRAIL").otherwise("PEDESTRIAN_CONNECTOR").alias("segment_type"), access.alias("access"), role.alias("role"), status.alias("status"), (role != "EXCLUDED").alias("walkable"), why.alias("reasons"))


def outside(segments: DataFrame, inside: Column) -> DataFrame:
    """Segments whose midpoint lies outside the area become connectors of their own type, with a reason."""
    out = ~F.coalesce(inside, F.lit(False))
    return segments.withColumns({
        "segment_type": F.when(out, "OUT_OF_AREA_CONNECTOR").otherwise(F.col("segment_type")), "role": F.when(out, "OPTIONAL_CONNECTOR").otherwise(F.col("role")),
        "role_status": F.when(out, "AUTOMATIC").otherwise(F.col("role_status")), "review_reasons": F.when(out, F.concat(F.col("review_reasons"), F.array(F.lit("midpoint outside")))).otherwise(F.col("review_reasons")),
    })


def corroborated(segments: DataFrame, private: DataFrame, key: str) -> DataFrame:
    """Required streets that stand in ``private`` (keys whose midpoint lies in private land) go to review, with a reason."""
    hit = segments.join(private.select(key, F.lit(True).alias("_in")).distinct(), key, "left")
    doubt = F.coalesce("_in", F.lit(False)) & (F.col("segment_type") == "STREET") & (F.col("role") == "REQUIRED")
    return hit.withColumn("role_status", F.when(doubt, "NEEDS_REVIEW").otherwise(F.col("role_status"))).withColumn("review_reasons", F.when(doubt, F.concat("review_reasons", F.array(F.lit("midpoint in private land")))).otherwise(F.col("review_reasons"))).drop("_in")


def overridden(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """Roles replaced by ``rules`` (normalized_name, new_role, new_access, why), with the role before as ``from_role``, null where
    no rule applies. Rules are one a name; how they are joined is left to their size."""
    hit = segments.join(rules, "normalized_name", "left")
    on = F.col("new_role").isNotNull()
    note = F.concat(F.lit("override "), F.coalesce("role", F.lit("none")), F.lit(" -> "), F.col("new_role"), F.lit(": "), F.coalesce("why", F.lit("")))
    return hit.withColumns({
        "from_role": F.when(on, F.col("role")), "role": F.when(on, F.col("new_role")).otherwise(F.col("role")), "access_type": F.when(on, F.coalesce("new_access", "access_type")).otherwise(F.col("access_type")),
        "role_status": F.when(on, "CONFIRMED").otherwise(F.col("role_status")), "walkable": F.when(on, F.col("new_role") != "EXCLUDED").otherwise(F.col("walkable")),
        "review_reasons": F.when(on, F.concat("review_reasons", F.array(note))).otherwise(F.col("review_reasons")),
    }).drop("new_role", "new_access", "why")


def link_class(worst_class: Column, worst_role: Column, worst_speed: Column, crossed: Column, crossed_limited: Column, name_match: Column, streets: Column, peds: Column, length: Column) -> Column:
    """Trust in a derived link, in order: false, sure, a crossing to be looked at, unresolved. ``crossed`` counts roadways met
    between its ends."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    limited, busy, speed = worst_class.isin(*LIMITED_CLASSES), worst_class.isin(*TRAFFIC_CLASSES), F.coalesce(worst_speed, F.lit(0))
    return first_match([
        ("LIKELY_FALSE", limited), ("LIKELY_FALSE", crossed_limited), ("LIKELY_FALSE", (worst_role == "EXCLUDED") & no(name_match) & (streets > 0)),
        ("HIGH_CONFIDENCE", (streets == 0) & (peds > 0)), ("HIGH_CONFIDENCE", name_match & (crossed == 0)),
        ("HIGH_CONFIDENCE", (length <= SHORT_LINK_M) & (crossed == 0) & no(busy) & (speed <= 25)),
        ("CROSSING_REVIEW_REQUIRED", crossed > 0), ("CROSSING_REVIEW_REQUIRED", busy), ("CROSSING_REVIEW_REQUIRED", speed >= 35), ("CROSSING_REVIEW_REQUIRED", length > LONG_LINK_M),
    ], "UNRESOLVED")


def same_start(a: Column, b: Column, n: int = 8) -> Column:
    """Whether either name begins with the first ``n`` letters of the other; blank names match nothing."""
    x, y = F.lower(trimmed(a)), F.lower(trimmed(b))
    return F.coalesce(F.startswith(x, F.substring(y, 1, n)) | F.startswith(y, F.substring(x, 1, n)), F.lit(False))


def with_link_classes(segments: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """connector_class and routable_by_default written back; links that are not trusted are closed."""
    hit = segments.drop("connector_class").join(classes.select(key, "connector_class"), key, "left")
    trusted = F.col("connector_class").isNull() | (F.col("connector_class") == "HIGH_CONFIDENCE")
    return hit.withColumn("routable_by_default", trusted).withColumn("walkable", F.col("walkable") & trusted)


def promoted(segments: DataFrame) -> DataFrame:
    """Canonical campus segments become required, with ``from_role``; an exclusion or a closed way outranks the promotion."""
    on = F.coalesce(F.col("in_campus") & (F.col("dataset") != "DERIVED") & (F.col("campus_obligation") == "CANONICAL") & (F.coalesce("role", F.lit("")) != "EXCLUDED") & F.col("walkable"), F.lit(False))
    return segments.withColumn("from_role", F.when(on, F.col("role"))).withColumn("role", F.when(on, "REQUIRED").otherwise(F.col("role"))).withColumn("role_status", F.when(on, "CONFIRMED").otherwise(F.col("role_status")))


def site_advice(units: Column, area_m2: Column) -> Column:
    return F.when(units >= 100, "ADD_AUTHORITATIVE_PEDESTRIAN_NETWORK").when(area_m2 > 20_000, "ASSOCIATE_WITH_FRONTAGE_STREETS").otherwise("TREAT_AS_UNRESOLVED")


def review_queue(segments: DataFrame, letters: int = 70) -> DataFrame:
    """(queue, n): segments waiting by status, and by the beginning of their first reason."""
    waiting = segments.where(F.col("role_status").isin("NEEDS_REVIEW", "PROVISIONAL"))
    first = F.concat(F.lit("reason::"), F.substring(F.try_element_at("review_reasons", F.lit(1)), 1, letters))
    return waiting.select(F.explode(F.array_compact(F.array(F.col("role_status"), first))).alias("queue")).groupBy("queue").agg(F.count("*").alias("n"))


def homes_per_segment(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Segments with estimated_households: distinct homes whose main segment each is, 0 where none."""
    per = links.groupBy(F.col("main").alias("segment_id")).agg(F.count_distinct("home").alias("n"))
    return segments.join(per, "segment_id", "left").withColumn("estimated_households", F.coalesce("n", F.lit(0))).drop("n")


def link_totals(segments: DataFrame) -> DataFrame:
    """(connector_class, links, miles) of derived links."""
    return segments.where(F.col("connector_class").isNotNull()).groupBy("connector_class").agg(F.count("*").alias("links"), miles(F.sum("length_m")).alias("miles"))


def street_rollup(paths: DataFrame, streets: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """Streets with has_<flag>: whether any path of the same name has it."""
    per = paths.groupBy(key).agg(*(F.max(F.coalesce(F.col(f), F.lit(False))).alias(f"has_{f}") for f in flags))
    return streets.join(per, key, "left").withColumns({f"has_{f}": F.coalesce(f"has_{f}", F.lit(False)) for f in flags})


def site_rollup(sites: DataFrame) -> DataFrame:
    """One row over sites (units, hold, first_status): how many are held, in part or whole, and whose first rule said otherwise."""
    held = lambda h: F.count_if(F.col("hold") == h)
    changed = (F.col("first_status") == "UNRESOLVED") != (F.col("hold") == "ALL")
    return sites.agg(F.count("*").alias("profiled"), held("ALL").alias("held"), held("BEYOND_CAP_ONLY").alias("held_in_part"), held("NONE").alias("accepted"), F.coalesce(F.sum(F.when(F.col("hold") == "ALL", F.col("units"))), F.lit(0)).alias("units_held"), F.count_if(changed).alias("changed"))


def site_status(units: Column, beyond: Column, network_m: Column, named: Column) -> Column:
    """struct(status, trigger) by the first rule: no network inside, or more than a quarter beyond the cap, or named by people."""
    auto = (network_m < 25.0) | (beyond / units > 0.25)
    trigger = F.when(named & auto, "INSTRUCTION_AND_AUTOMATIC").when(named, "INSTRUCTION_ONLY").when(auto, "AUTOMATIC")
    return F.struct(F.when(auto | named, "UNRESOLVED").otherwise("OK").alias("status"), trigger.alias("trigger"))


def street_like(kind: Column, in_campus: Column, name: Column) -> Column:
    """A street, or a campus way with a street's word in its name."""
    return (kind == "STREET") | (F.coalesce(in_campus, F.lit(False)) & F.coalesce(F.lower(name).rlike(" (dr|drive|st|street|ave|avenue|rd|road|ln|lane)"), F.lit(False)))


def link_review(recovered: Column, focus: Column, homes: Column, opposed: Column, at_junction: Column, forms_junction: Column, road_class: Column, length: Column, speed: Column) -> Column:
    """struct(priority, recommendation, confidence, against) of a link to be looked at: what it wins back counts most."""
    one = lambda c, n: F.when(c, n).otherwise(0.0)
    priority = F.round(recovered * 100 + one(focus, 2.0) + F.least(homes, F.lit(2000)) / 200.0 + one(opposed, 3.0) + one(at_junction, 2.0) + one(forms_junction, 3.0), 2)
    junction = at_junction | forms_junction
    limited = F.coalesce(road_class.isin(*LIMITED_CLASSES), F.lit(False))
    slow = (length <= 15) & (F.coalesce(F.nullif(speed, F.lit(0)), F.lit(99)) <= 30)
    verdict = F.when(limited, "REJECT").when(opposed | junction, "REVIEW_ON_SITE").otherwise("DO_NOT_PROMOTE_WITHOUT_EVIDENCE")
    sure = F.when(limited, "HIGH").when((opposed & junction) | (junction & slow), "MEDIUM").otherwise("LOW")
    busy = F.coalesce(road_class.isin(*TRAFFIC_CLASSES), F.lit(False))
    against = reasons([("limited access", limited), ("crosses a large road between junctions", busy & ~junction), ("nothing on the far side", ~opposed), ("too long for a crossing", length > 20)])
    return F.struct(priority.alias("priority"), verdict.alias("recommendation"), sure.alias("confidence"), against.alias("against"))


def representation(canonical_miles: Column, found: Column) -> Column:
    return F.when(~F.coalesce(found, F.lit(False)), "NO_REPRESENTATION").when(canonical_miles >= 0.05, "REPRESENTED").otherwise("THIN")


def probe_verdict(features: Column, metres: Column) -> Column:
    return F.when(features == 0, "ABSENT").when(metres < 100, "STUB_ONLY").otherwise("PRESENT")


def as_features(links: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Derived links with running ids (CONN-00001 ...) in the given total order, numbered range by range."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    return numbered(links, columns, "link_id").withColumn("link_id", F.format_string("CONN-%05d", F.col("link_id")))
