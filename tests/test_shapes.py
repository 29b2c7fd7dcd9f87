import json
import struct

import numpy as np
from pyspark.sql import functions as F

from trailspan.functions import shapes
from trailspan.functions.geometry import point
from trailspan.operators import corridors
from trailspan.sources import shapefiles

LINE = "array<struct<x:double,y:double>>"


def test_hulls_hold_all_points_and_nothing_more(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x), float(y)) for g, n in ((1, 300), (2, 40)) for x, y in rng.normal(0, 60, (n, 2))] + [(3, 5.0, 5.0), (4, 0.0, 0.0), (4, 10.0, 10.0), (5, None, 1.0)]
    got = {r.g: r for r in shapes.hulls(spark.createDataFrame(rows, "g long, x double, y double"), "g").collect()}
    for g in (1, 2):
        pts = np.array([r[1:] for r in rows if r[0] == g])
        assert [(p.x, p.y) for p in got[g].hull] == [tuple(p) for p in shapes._ring(pts)] and got[g].n == len(pts)
        ring = np.array([(p.x, p.y) for p in got[g].hull])
        edge, rel = np.diff(ring, axis=0), pts[:, None, :] - ring[None, :-1]
        assert (edge[None, :, 0] * rel[:, :, 1] - edge[None, :, 1] * rel[:, :, 0] >= -1e-6).all()
    assert [(p.x, p.y) for p in got[3].hull] == [(5, 5), (5, 5)] and len(got[4].hull) == 3 and got[5].hull is None
    near = spark.createDataFrame([r.asDict(True) for r in got.values() if r.hull], f"g long, n long, hull {LINE}").select("g", shapes.near_hull(F.col("hull"), point(F.lit(20.0), F.lit(5.0))).alias("in"))
    assert dict(near.collect()) == {1: True, 2: True, 3: True, 4: True}


def test_lines(spark):
    line = [(0.0, 0.0), (1.0, 0.00001), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)]
    frame = spark.createDataFrame([(1, line), (2, [(0.0, 0.0), (0.0, 8.0)]), (3, [])], f"g long, line {LINE}")
    r = {x.g: x for x in frame.select("g", shapes.thinned(F.col("line"), 1.5).alias("t"), shapes.simplified(F.col("line"), 0.1).alias("s"), shapes.geojson(F.col("line"), 1).alias("j")).collect()}
    assert [p.x for p in r[1].t] == [0, 2, 3, 4] and [p.x for p in r[1].s] == [0, 2, 3, 4] and r[3].s == [] and r[3].j is None
    assert json.loads(r[2].j) == {"type": "LineString", "coordinates": [[0.0, 0.0], [0.0, 8.0]]}
    c = {x.g: x for x in shapes.centres(frame.where("g = 2"), "g").collect()}
    assert (c[2].x, c[2].y, c[2].lines) == (0.0, 4.0, 1)
    one = spark.range(1).select(shapes.iso_utc(F.lit(1_700_000_000_000)).alias("t"), shapes.either_side(F.lit(" "), F.lit("b")).alias("e"), shapes.either_side(F.lit("a"), F.lit("b")).alias("f")).first()
    assert one.t == "2023-11-14T22:13:20+00:00" and (one.e.name, one.e.boundary, one.f.name, one.f.boundary) == ("b", False, "a", True)


def test_one_side_of_a_corridor_carries_the_duty(spark):
    rows = [(1, "mall", [(0.0, 0.0), (300.0, 0.0)]), (2, "mall", [(0.0, 20.0), (150.0, 20.0)]), (3, "mall", [(0.0, 200.0), (100.0, 200.0)]), (4, "quad", [(0.0, 10.0), (90.0, 10.0)])]
    ways = spark.createDataFrame(rows, f"segment_id long, corridor string, line {LINE}").withColumn("length_m", F.lit(100.0))
    duties = corridors.obligations(ways)
    assert {r.segment_id: r.obligation for r in duties.collect()} == {1: "CANONICAL", 2: "ALTERNATIVE", 3: "CANONICAL", 4: "CANONICAL"}
    (c,) = corridors.credits(ways, duties).collect()
    want = sum(min(np.hypot(x - min(x, 150.0), 20.0), 999) <= 45 for x in np.linspace(0, 300, 61)) / 61
    assert (c.alternative, c.canonical, c.fraction) == (2, 1, round(want, 4))
    assert {r.corridor: r.duplicate_share for r in corridors.corridor_pack(ways, duties).collect()} == {"mall": 0.3333, "quad": 0.0}


def test_shapefiles(spark, tmp_path):
    def shp(kind, shapes_):
        body = b""
        for i, parts in enumerate(shapes_):
            pts = [p for part in parts for p in part]
            starts = np.cumsum([0, *map(len, parts)])[:-1]
            rec = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(pts)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
            body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
        return b"\0" * 100 + body

    def dbf(names, rows):
        head = 32 + 32 * len(names) + 1
        raw = struct.pack("<4BI2H", 3, 0, 0, 0, len(rows), head, 1 + 10 * len(names)) + b"\0" * 20
        raw += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 for n in names) + b"\r"
        return raw + b"".join(b" " + b"".join(v.encode().ljust(10) for v in r) for r in rows)

    outer, hole, far = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(2, 2), (3, 2), (3, 3), (2, 3), (2, 2)], [(20, 0), (20, 5), (25, 5), (20, 0)]
    (tmp_path / "a.shp").write_bytes(shp(5, [[outer, hole, far], [[(0, 0), (1, 1)]]]))
    (tmp_path / "a.dbf").write_bytes(dbf(["NAME", "KIND"], [("pond", "x"), ("", "y")]))
    (tmp_path / "b.shp").write_bytes(shp(3, [[[(50, 50), (60, 60)], [(51, 51)]]]))
    rows = sorted(shapefiles.read_shapes(spark, str(tmp_path)).withColumn("p", shapefiles.polygons(F.col("parts"))).withColumn("l", shapefiles.polylines(F.col("parts"))).withColumn("m", shapefiles.meets_box(F.col("parts"), 0, 0, 10, 10)).collect(), key=lambda r: (r.file, r.record))
    assert [r.attributes for r in rows] == [{"NAME": "pond", "KIND": "x"}, {"KIND": "y"}, {}] and [r.kind for r in rows] == [5, 5, 3]
    assert [[len(ring) for ring in poly] for poly in rows[0].p] == [[5, 5], [4]] and rows[1].p == []
    assert [len(x) for x in rows[2].l] == [2] and [r.m for r in rows] == [True, True, False]
