import struct

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from trailspan.sources import shape_scan


def write(stem, kind, shapes, names, rows):
    body, index, at = b"", b"", 100
    for i, parts in enumerate(shapes):
        points = [p for part in parts for p in part]
        if not points:
            rec = struct.pack("<i", 0)
        elif kind == 1:
            rec = struct.pack("<i2d", 1, *points[0])
        else:
            x, y = zip(*points)
            starts = np.cumsum([0, *map(len, parts)])[:-1]
            rec = struct.pack("<i4d2i", kind, min(x), min(y), max(x), max(y), len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
        index += struct.pack(">2i", at // 2, len(rec) // 2)
        at += 8 + len(rec)
    head = 32 + 32 * len(names) + 1
    dbf = struct.pack("<4BI2H", 3, 0, 0, 0, len(rows), head, 1 + 24 * len(names)) + b"\0" * 20
    dbf += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([24]) + b"\0" * 15 for n in names) + b"\r"
    dbf += b"".join(b" " + b"".join(str(v).encode("latin-1").ljust(24) for v in r) for r in rows)
    for end, raw in ((".shp", b"\0" * 100 + body), (".shx", b"\0" * 100 + index), (".dbf", dbf)):
        open(f"{stem}{end}", "wb").write(raw)
    return str(stem)


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("shapes"), []
    for s in range(2):
        shapes = [[[(i * 10.0, s * 100.0), (i * 10.0 + 5, s * 100.0 + 5)]] if i % 9 else [] for i in range(200)]
        rows = [(f"road {i % 4}" if i % 3 else "", ("S1400", "S1500", "S1200", "S1630")[i % 4], i % 8, "460" if i == 20 else "", "", "", "x" if i % 2 else "y") for i in range(200)]
        out.append(write(folder / f"seg{s}", 3, shapes, ["NAME", "MTFCC_CODE", "TNMFRC", "US_ROUTE", "INTERSTATE", "STATE_ROUTE", "KIND"], rows))
    return out


def test_all_records_in_ranges(spark, shards):
    frame = shape_scan.scan(spark, *shards, step=33)
    rows = frame.collect()
    assert len(rows) == 400 and frame.rdd.getNumPartitions() == 14
    assert {r.kind for r in rows} == {0, 3} and all((r.west is None) == (r.kind == 0) and len(r.parts) == (r.kind == 3) for r in rows)
    assert sum(r.name is None for r in rows) == 134 and {r.kind_ for r in rows} == {"x", "y"}


def test_filters_give_the_same_rows_as_without_pushdown(spark, shards):
    tests = ["name = 'road 1'", "tnmfrc IN ('1', '2')", "west >= 500 AND east < 900", "name IS NULL AND kind_ = 'x'", "record < 20", "mtfcc_code = 'S1400' AND north > 100", "kind = 0", "name LIKE '%2' OR tnmfrc = '7'", "name <> 'road 1'"]
    whole = shape_scan.scan(spark, *shards, step=50).collect()
    plain = spark.createDataFrame(whole, shape_scan.scan(spark, *shards).schema)
    key = lambda rows: sorted((r.record, str(r.name), r.mtfcc_code, str(r.south)) for r in rows)
    for t in tests:
        assert key(shape_scan.scan(spark, *shards, step=50).where(t).collect()) == key(plain.where(t).collect()), t
    box = (300.0, 90.0, 400.0, 104.0)
    got = key(shape_scan.scan(spark, *shards, box=box).collect())
    assert got == key(shape_scan.within(plain, box).collect()) == key(shape_scan.within(shape_scan.scan(spark, *shards), box).collect()) and 5 < len(got) < 20


def test_only_what_may_be_wanted_is_read(shards):
    reader = shape_scan.ShapeReader({"path": ",".join(shards), "step": "50"})
    rest = list(reader.pushFilters([ds.EqualTo(("tnmfrc",), "3"), ds.LessThan(("west",), 500.0), ds.StringContains(("name",), "oa")]))
    assert [type(f) for f in rest] == [ds.StringContains]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    with_three = [i for i in range(200) if i % 8 == 3]
    assert (reader.seen, reader.bounded) == (400, 2 * len(with_three))
    assert reader.decoded == len(rows) == 2 * sum(i * 10 < 500 and i % 9 > 0 for i in with_three)


def test_layers(spark, shards, tmp_path):
    got = shape_scan.roads(shape_scan.scan(spark, *shards)).collect()
    assert {r["class"] for r in got} <= {"motorway", "trunk", "primary", "secondary", "tertiary", "minor", "link", *(r["class"] for r in got)} and len(got) == 2 * sum(i % 9 > 0 and i % 4 != 1 for i in range(200))
    assert [(r.name, r.ref) for r in got if r.ref] == [("US 460", "US 460")] * 2 and all(r["class"] == "link" for r in got if r.name == "road 3")
    ring = lambda x: [[(x, 0.0), (x, 9.0), (x + 9, 9.0), (x + 9, 0.0), (x, 0.0)]]
    bodies = write(tmp_path / "body", 5, [ring(0.0), ring(20.0)], ["GNIS_NAME", "VISIBILITY", "FTYPE"], [("Pond", 0, 390), ("", 500000, 390)])
    areas = write(tmp_path / "area", 5, [ring(40.0), ring(60.0), ring(80.0)], ["GNIS_NAME", "VISIBILITY", "FTYPE"], [("Wide", 1000000, 460), ("Dry", 0, 343), ("Sea", 0, 445)])
    wet = shape_scan.water(shape_scan.scan(spark, bodies), shape_scan.scan(spark, areas)).collect()
    assert sorted((r.kind, r.name or "", r.first_zoom) for r in wet) == [("area", "Wide", 7), ("body", "", 9), ("body", "Pond", 13)]
    flows = write(tmp_path / "flow", 3, [[[(0.0, 0.0), (1.0, 1.0)]]] * 3, ["GNIS_NAME", "VISIBILITY", "FTYPE"], [("New River", 0, 460), ("Pipe", 0, 428), ("Brook", 100000, 460)])
    assert sorted((r.name, r.first_zoom, r.major) for r in shape_scan.waterways(shape_scan.scan(spark, flows)).collect()) == [("Brook", 11, False), ("New River", 7, True)]
    lands = write(tmp_path / "land", 5, [ring(0.0), ring(1.0)], ["FEATURE1", "GNIS_NAME1"], [("National Forest", "Big"), ("Air Base", "No")])
    frame = shape_scan.public_land(shape_scan.scan(spark, lands))
    assert [r.name for r in frame.collect()] == ["Big"] and frame.select(F.size("polygons").alias("n")).first().n == 1
    assert shape_scan.rail(shape_scan.scan(spark, flows)).count() == 3
