"""Rules on small tables, and properties that SQL over the driver's tables cannot show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspan.operators import gates, layer_rules, ledger, membership, routing_areas, slates


def test_metres_only():
    assert gates.assert_metric("EPSG:6594") == "EPSG:6594"
    for crs in ("EPSG:6593", "EPSG:4326", "nowhere"):
        with pytest.raises(ValueError):
            gates.assert_metric(crs)


def test_content_hash_is_of_rows_not_of_their_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i long, s string")
    b = a.orderBy(F.desc("i")).repartition(3)
    one = lambda d: membership.content_hash(d, ["i", "s"]).first()
    assert one(a) == one(b) and one(a) != one(a.distinct()) and one(a.limit(0)).n == 0


def test_spread_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), i, float(rng.integers(0, 40)), float(rng.random() / 50), float(rng.random() / 50)) for i, g in enumerate(rng.integers(0, 3, 120))]
    frame = spark.createDataFrame(rows, "g long, node long, score double, lon double, lat double")
    for most in (4, 9):
        got = {}
        for r in slates.spread(frame, "g", most).orderBy("g", "pos").collect():
            got.setdefault(r.g, []).append(r.node)
        near = 250.0 if most <= 4 else 700.0
        for g in range(3):
            taken = []
            for _, node, _, lon, lat in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
                if len(taken) < most and all(np.hypot((lon - x) * 88_800, (lat - y) * 111_320) >= near for _, x, y in taken):
                    taken.append((node, lon, lat))
            assert got[g] == [t[0] for t in taken]


def test_recording_twice_appends_nothing_and_corrections_take_away(spark):
    seg = spark.createDataFrame([("a", "REQUIRED", 10.0), ("b", "REQUIRED", 20.0), ("c", "OPTIONAL_CONNECTOR", 5.0)], "segment_id string, role string, length_m double")
    walks = spark.createDataFrame([(1, "EDITED", 1.0), (2, "DID_NOT_COMPLETE", 2.0)], "walk long, outcome string, distance double")
    planned = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a")], "walk long, segment_id string")
    chosen = spark.createDataFrame([(1, "b"), (1, "b"), (1, "nowhere"), (2, "b")], "walk long, segment_id string")
    final = ledger.final_segments(walks, planned, chosen, seg)
    new = ledger.new_completions(final, planned, walks, planned.limit(0))
    assert [tuple(r) for r in new.select("walk", "segment_id", "source").collect()] == [(1, "b", "MANUAL_ADDITION")]
    assert ledger.new_completions(final, planned, walks, new).count() == 0
    assert sorted(tuple(r) for r in ledger.edits(final, planned, walks).collect()) == [(1, "a", "REMOVED"), (1, "b", "ADDED"), (1, "c", "REMOVED"), (2, "a", "REMOVED")]
    fix = spark.createDataFrame([(1, "DID_NOT_COMPLETE", "was ill that day"), (2, "AS_PLANNED", "no")], "walk long, outcome string, reason string")
    after, audit = ledger.corrected(new, walks, fix, planned, chosen, seg)
    assert after.count() == 0 and [(r.subject, r.from_outcome, r.to_outcome, r.rows) for r in audit.collect()] == [(1, "EDITED", "DID_NOT_COMPLETE", 1)]


def test_empty_and_null_rows(spark):
    none = spark.createDataFrame([(None,) * 6], "dataset string, connector_class string, role string, walkable boolean, segment_type string, length_m double")
    m = none.select(membership.membership(F.col("dataset"), F.col("connector_class"), F.col("role"), F.col("walkable")).alias("m")).first().m
    assert (m.keep, m.reason) == (False, "not walkable")
    p = none.select(layer_rules.path(F.col("role"), F.col("dataset"), F.col("walkable"), F.lit(None).cast("string"), F.lit(None).cast("string"), ["Trail"], ["Sidewalk"]).alias("p")).first().p
    assert (p.role, p.status, p.access, p.reasons) == ("OPTIONAL_CONNECTOR", "NEEDS_REVIEW", "UNKNOWN", ["no rule for this kind", "owner unknown"])
    c = none.select(routing_areas.area_class(F.lit(False), F.lit(0.3), F.lit(False), F.lit(False), F.lit(12.0), F.lit(0.6)).alias("c")).first().c
    assert c["class"] == "VALID_INDEPENDENT_ROUTING_AREA" and c.reasons == ["out and back only", "cut off by an untrusted link only", "too small for the shortest walk"]
