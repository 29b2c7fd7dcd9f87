import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from trailspan.functions import geometry, identity
from trailspan.operators import cartography, coverage, missions, places


def column(spark, rows, kind, f):
    return [r.o for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_minutes_clamp(spark):
    given = [5, 19, 20, 22, 23, 45, 88, 240]
    assert column(spark, [float(v) for v in given], "double", missions.clamped_minutes) == [20, 20, 20, 20, 25, 45, 90, 90]


def test_emails(spark):
    same = ["Ada@Example.com", "  ada@example.com ", "ADA@EXAMPLE.COM"]
    assert set(column(spark, same, "string", identity.normal_email)) == {"ada@example.com"}
    assert len(set(column(spark, ["alice@x.com", "alice+walks@x.com"], "string", identity.normal_email))) == 2
    assert len(set(column(spark, ["alice@x.com", "alice+walks@x.com"], "string", identity.mailbox))) == 1
    bad = ["notanemail", "a@b", "@example.com", "a b@x.com", "two@@example.com", "", None]
    assert not any(column(spark, bad, "string", identity.valid_email)) and all(column(spark, same, "string", identity.valid_email))


def test_keyed_hash(spark):
    got = column(spark, ["token", None], "string", lambda c: identity.keyed_hash(c, "pepper"))
    assert got == [hmac.new(b"pepper", b"token", hashlib.sha256).hexdigest(), None]


def test_shields(spark):
    rows = [(None, "Bus,460", None), (None, "11,460", None), (None, "460,Alt,11", None), ("81", "11", None), (None, None, "733"), (None, None, "114,600"), (None, "", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string")
    got = [r.o for r in frame.select("i", cartography.shield(F.col("a"), F.col("b"), F.col("c")).alias("o")).orderBy("i").collect()]
    assert got == ["US 460 Bus", "US 11/460", "US 460/11", "I-81", "", "VA 114", ""]


@pytest.mark.parametrize("units,beyond,net,acres,want", [(108, 3, 150.0, 4.8, "NONE"), (558, 72, 2200.0, 40.0, "BEYOND_CAP_ONLY"), (162, 65, 0.0, 12.0, "ALL"), (100, 20, 0.0, 12.0, "ALL"), (100, 20, 0.0, 5.0, "BEYOND_CAP_ONLY")])
def test_sites(spark, units, beyond, net, acres, want):
    r = spark.range(1).select(places.site_disposition(F.lit(units), F.lit(beyond), F.lit(net), F.lit(acres * 4046.86)).alias("d")).first()
    assert r.d.hold == want


def test_homes_and_keys(spark):
    rows = [("Residential", None, "12", "Main", "St"), (" Residential ", "Vacant lot", "13", "Main", "St"), ("Residential", None, "12.0", "main", "st"), ("Business", None, "x", "Main", "St"), ("Residential", "", "abc", "Main", "")]
    homes = spark.createDataFrame(rows, "kind string, mark string, num string, name string, type string")
    key = places.address_key(F.col("num"), F.col("name"), F.col("type"))
    r = places.funnel(homes, "kind", "mark", key).first()
    assert tuple(r) == (5, 4, 3, 2, 1)
    assert [r.k for r in homes.select(key.alias("k")).collect()] == ["12 MAIN ST", "13 MAIN ST", "12 MAIN ST", "MAIN ST", "MAIN"]


def test_association_bonuses_and_cap(spark):
    homes = spark.createDataFrame([(1, 0.0, 0.0, "elm st"), (2, 5000.0, 0.0, "elm st"), (3, 0.0, 200.0, None)], "home_id long, x double, y double, name string")
    bar = lambda y: [{"x": -200.0, "y": y}, {"x": 200.0, "y": y}]
    lines = spark.createDataFrame([(10, bar(-11.0), "oak st", False), (11, bar(22.0), "elm st", False), (12, bar(125.0), "far st", True)], "line_id long, line array<struct<x:double,y:double>>, name string, owed boolean")
    got = {r.home_id: r for r in places.associated(homes, lines).collect()}
    assert got[1].main == 11 and got[1].others == [10] and got[1].distance == 22
    assert got[2].main is None and got[2].reason == "BEYOND_CAP" and got[2].others == []
    assert got[3].main == 12 and got[3].distance == 75


def test_thinning_and_ratio(spark):
    line = F.array(*(geometry.point(F.lit(float(i)), F.lit(0.0)) for i in range(8)))
    r = spark.range(1).select(cartography.thinned(line, 3).alias("t"), places.ratio_verdict(F.lit(100), F.lit(100.0)).alias("a"), places.ratio_verdict(F.lit(328), F.lit(100.0)).alias("b"), places.ratio_verdict(F.lit(50), F.lit(0.0)).alias("c")).first()
    assert [p.x for p in r.t] == [0, 3, 6, 7] and (r.a, r.b, r.c) == ("PASS", "FAIL", "WARN")


def test_route_facts_and_score(spark):
    segs = spark.createDataFrame([(1, 1.0, True, 10, False, False, 1, False), (2, 0.5, True, 4, True, False, 3, True), (3, 0.25, False, 0, False, True, 5, False)], "seg int, miles double, required boolean, households int, dead_end boolean, derived boolean, stress int, isolated boolean")
    walk = [1, 2, 2, 3, 1, 3, 1]
    steps = spark.createDataFrame([(7, i, s, i >= 5) for i, s in enumerate(walk)], "route int, pos int, seg int, closing boolean")
    done = spark.createDataFrame([(3,)], "seg int")
    f = missions.route_facts(steps, segs, done).withColumns({"corridors_completed": F.lit(1), "cohesion": F.lit(0.5), "turns": F.lit(2), "uturns": F.lit(1)})
    r = f.first()
    assert (r.total, r.new_required, r.households, r.dead_ends, r.isolated) == (4.5, 1.5, 14, 1, 1)
    assert (r.dead_end_return, r.closing_miles, r.avoidable, r.extra, r.most_passes) == (0.5, 1.25, 1.0, 1, 3)
    assert (r.connector, r.derived, r.stress) == (0.25, 1, 0.5 * 0.5 + 0.25)
    parts, total = coverage.score(missions.route_components(F.lit(2.0)), missions.ROUTE_WEIGHTS)
    got = f.select(parts.alias("p"), total.alias("t")).first()
    share = 2.75 / 4.5
    want = {"new_required": 150.0, "repeat_avoidable": -55.0, "repeat_closing": -25.0, "repeat_dead_end": -3.0, "repeat_share": round(-260 * share**2 * (4.5 / 3.5), 2), "length_overshoot": -150.0, "length_undershoot": 0.0, "loop_shape": round(18 * 3 / 7, 2)}
    assert {k: got.p[k] + 0.0 for k in want} == want and len(got.p) == len(missions.ROUTE_WEIGHTS)
    assert abs(got.t - sum(got.p.values())) < 0.1


def test_directions_and_mission_score(spark):
    rows = [(1, 0, "Elm Rd", False, 0.1), (1, 1, "Elm Rd", False, 0.2), (1, 2, None, True, 0.004), (1, 3, None, False, 0.05), (1, 4, "Elm Rd", False, 0.02)]
    got = missions.directions(spark.createDataFrame(rows, "route int, pos int, name string, derived boolean, miles double")).orderBy("step").collect()
    assert [(r.name, r.miles) for r in got] == [("Elm Rd", 0.3), ("unnamed path", 0.05), ("Elm Rd", 0.02)]
    r = spark.range(1).select(missions.mission_score(F.lit(1.0), F.lit(100), F.lit(2.0), F.lit(2.0), F.lit(80.0), F.lit(0.5)).alias("s")).first()
    assert r.s == 100 + 20 + 40 + 24 - 60
