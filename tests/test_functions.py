import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailspan.functions import geometry as g
from trailspan.functions import keys, names


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def line(*points):
    return F.array(*(g.point(F.lit(float(x)), F.lit(float(y))) for x, y in points))


@pytest.mark.parametrize(
    "raw,display,normal",
    [
        ("N Main St", "N Main St", "main st n"), ("Main St N", "N Main St", "main st n"), ("main street north", "N Main St", "main st n"),
        ("West Campus Drive Trail", "W Campus Drive Trl", "campus drive trl w"), ("Deerfield", "Deerfield Trl", "deerfield trl"), ("St", "St", "st"),
        ("o'neil rd.", "O Neil Rd", "o neil rd"), ("S Main Sts", "S Main St", "main st s"),
    ],
)
def test_names(spark, raw, display, normal):
    r = one(spark, n=names.normalize(F.lit(raw)))
    assert (r.n.display, r.n.normalized) == (display, normal)


@pytest.mark.parametrize("raw", [None, "", "  ", "!!"])
def test_blank_names(spark, raw):
    r = one(spark, n=names.normalize(F.lit(raw).cast("string")))
    assert (r.n.display, r.n.normalized) == (None, None)


def test_compose_and_keys(spark):
    r = one(spark, c=names.compose(F.lit(" N "), F.lit(None).cast("string"), F.lit(""), F.lit("Main")), k=keys.composite_key(F.lit(12), F.lit(" "), F.lit("a st")), e=names.without_endings(F.lit("elm trail spur"), ["trail", "spur"]))
    assert (r.c, r.k, r.e) == ("N Main", "12 A ST", "elm")


def test_fingerprint_ignores_order(spark):
    f = lambda *v: keys.fingerprint(F.array(*map(F.lit, v)))
    r = one(spark, a=f(3, 1, 2), b=f(2, 3, 1), c=f(1, 2), d=keys.fingerprint(F.array().cast("array<int>")))
    assert r.a == r.b != r.c and r.a.startswith("cs-3-") and r.d.startswith("cs-0-e3b0c44298fc")


def test_stable_ids_number_everything(spark):
    rows = keys.stable_ids(spark.range(1000).withColumn("o", F.xxhash64("id")), [F.col("o"), F.col("id")]).orderBy("o").collect()
    assert [r.stable_id for r in rows] == [f"SEG-{i:06d}" for i in range(1, 1001)]


def test_lines(spark):
    l_ = line((0, 0), (3, 4), (3, 10))
    r = one(spark, n=g.length(l_), mid=g.point_at(l_, 0.5), start=g.point_at(l_, -1.0), end=g.point_at(l_, 2.0), d=g.distance_to_line(g.point(F.lit(5.0), F.lit(7.0)), l_), area=g.signed_area(line((0, 0), (2, 0), (2, 3), (0, 3), (0, 0))), b=g.bounds(l_), alone=g.distance_to_line(g.point(F.lit(3.0), F.lit(4.0)), line((0, 0))))
    assert r.n == 11 and (r.mid.x, r.mid.y) == (3, 4.5) and (r.start.x, r.end.y) == (0, 10) and r.d == 2 and r.area == 6 and (r.b.x1, r.b.y1) == (3, 10) and r.alone == 5


def test_projection_round_trip(spark):
    p = g.STATE_PLANE.forward(F.lit(-80.4139), F.lit(37.2296))
    r = one(spark, o=g.STATE_PLANE.forward(F.lit(-78.5), F.lit(36.333333333333336)), p=p, q=g.STATE_PLANE.inverse(p["x"], p["y"]), n=g.STATE_PLANE.forward(F.lit(-80.4139), F.lit(37.2396)), h=g.haversine(F.lit(37.2296), F.lit(-80.4139), F.lit(37.2396), F.lit(-80.4139)))
    assert abs(r.o.x - 3500000) < 1e-3 and abs(r.o.y - 1000000) < 1e-3
    assert abs(r.q.x + 80.4139) < 1e-9 and abs(r.q.y - 37.2296) < 1e-9
    assert abs(math.hypot(r.n.x - r.p.x, r.n.y - r.p.y) - r.h) < 5


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=30, max_size=30))
def test_contains_equals_plain_ray_casting(spark, points):
    ring = [(-20, -20), (30, -10), (10, 5), (25, 30), (-30, 22), (-20, -20)]
    frame = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    got = [r.i for r in frame.select(g.contains(line(*ring), g.point(F.col("x"), F.col("y"))).alias("i")).collect()]
    for (x, y), inside in zip(points, got):
        n = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:]))
        assert inside == (n % 2 == 1)
