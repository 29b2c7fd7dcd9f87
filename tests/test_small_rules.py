"""Names of held sets, lines from parts, frames, runs, rejected rows and the manifest of all sources."""

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspan.functions import keys, shapes
from trailspan.operators import coverage, reports, rules
from trailspan.sources import layers


def test_held_sets_have_names_of_their_own(spark):
    rows = [([3, 1, 3],), ([1, 3],), ([],), (None,), ([13],)]
    got = [r.f for r in spark.createDataFrame(rows, "v array<int>").select(keys.held_fingerprint(F.col("v")).alias("f")).collect()]
    name = lambda *v: f"{len(v)}-" + hashlib.sha256("".join(f"{i}," for i in v).encode()).hexdigest()[:12]
    assert got == [name(1, 3), name(1, 3), "0", "0", name(13)]


def test_lines_are_joined_by_their_ends(spark):
    kind = "parts array<array<struct<x:double,y:double>>>"
    a, b, c = [(0.0, 0.0), (1.0, 0.0)], [(2.0, 0.0), (1.0, 0.0)], [(2.0, 0.0), (2.0, 5.0)]
    rows = [([a, b, c],), ([a, [], [(9.0, 9.0), (8.0, 8.0)]],), ([],), ([None, a],)]
    got = [[(p.x, p.y) for p in r.line] for r in spark.createDataFrame(rows, kind).select(coverage.joined_line(F.col("parts")).alias("line")).collect()]
    assert got == [[(0, 0), (1, 0), (2, 0), (2, 5)], [(0, 0), (1, 0), (9, 9), (8, 8)], [], [(0, 0), (1, 0)]]


def test_frames_are_pulled_back_and_stay_within_the_whole(spark):
    points = [("a", 0.0, 37.0, False), ("a", 1.0, 38.0, False), ("a", 0.5, 37.5, True), ("b", float("nan"), 1.0, True), ("b", None, 1.0, False), ("c", 3.0, 3.0, False), ("c", 3.0, float("inf"), True), ("c", 4.0, 4.0, False)]
    frame = spark.createDataFrame(points, "g string, lon double, lat double, done boolean")
    both = shapes.bounds(frame, ["g"], "lon", "lat", "whole").join(shapes.bounds(frame.where("done"), ["g"], "lon", "lat", "covered"), "g", "left")
    got = {r.g: r.f for r in both.select("g", shapes.progress_frame(F.col("covered"), F.col("whole")).alias("f")).collect()}
    assert abs(got["a"].north - got["a"].south - 0.010) < 1e-7 and abs((got["a"].east + got["a"].west) / 2 - 0.5) < 1e-9 and got["a"].east - got["a"].west > 0.0125
    assert got["b"] is None and tuple(got["c"]) == (3.0, 3.0, 4.0, 4.0)


def test_runs_begin_where_a_condition_does(spark):
    steps = spark.createDataFrame([(1, i, v) for i, v in enumerate([True, True, False, True, None, True])] + [(2, 0, False)], "r int, p int, c boolean")
    assert {x.r: x.runs for x in coverage.rising_runs(steps, "r", "p", F.col("c")).collect()} == {1: 3, 2: 0}


def test_rejected_rows_are_kept_and_all_sources_are_accounted_for(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a|b\n1|x\nbad|y\n2\n3|z|more\n4|w\n")
    rows, bad = layers.split_delimited(spark, str(tmp_path / "t.txt"), T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]))
    assert sorted(map(tuple, rows.collect())) == [(1, "x"), (4, "w")] and sorted(r.line for r in bad.collect()) == ["2", "3|z|more", "bad|y"] and bad.count() == 3
    folder = str(tmp_path / "snap")
    layers.write_snapshot(rows, folder, "roads", "2024-01-01")
    layers.write_snapshot(rows.limit(1), folder, "roads", "2024-02-01")
    layers.write_snapshot(rows, folder, "odd", "2024-01-01")
    held = layers.read_manifests(spark, folder)
    assert held.count() == 3
    registry = spark.createDataFrame([("roads", False, None), ("parcels", True, "host not reached"), ("paths", None, None)], "layer string, blocked boolean, note string")
    got = {r.layer: (r.feature_count, r.status, r.note) for r in layers.source_manifest(held, registry, "2024-01-01").collect()}
    assert got == {"roads": (2, "fetched", None), "odd": (2, "unregistered", None), "parcels": (None, "blocked", "host not reached"), "paths": (None, "missing", None)}


def test_crossings_are_reviewed_where_they_bridge_or_touch(spark):
    kind = "segment_id int, u int, v int, a int, b int, miles_a double, miles_b double, reasons array<string>"
    rows = [(1, 1, 2, 0, 1, 5.0, 2.0, ["Steps into a road", "narrow", None]), (2, 3, 4, 0, 0, 5.0, 5.0, []), (3, 9, 4, 0, None, 5.0, None, None), (4, 4, 4, None, 1, 1.0, 1.0, ["CROSSING"])]
    got = reports.crossings_to_review(spark.createDataFrame(rows, kind), spark.createDataFrame([(9,), (9,), (None,)], "node int"))
    assert sorted(map(tuple, got.collect())) == [(1, True, False, 2.0, ["Steps into a road"]), (3, False, True, 0.0, [])]


def test_buckets_list_their_smallest_ids_once(spark):
    frame = spark.createDataFrame([(i % 7, i % 2 == 0) for i in range(50)] + [(None, True)], "k int, even boolean")
    got = {r.bucket: r.ids for r in rules.bucket_ids(frame, [("even", F.col("even"))], F.col("k"), 3).collect()}
    assert got == {"even": [0, 1, 2]}
