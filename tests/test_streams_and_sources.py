import json
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspan.functions.geometry import STATE_PLANE
from trailspan.sources import layers, paged
from trailspan.streaming import holds


def batches(spark, folder, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "k string, at string, kind string, id long").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema("k string, at timestamp, kind string, id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_holds_as_a_stream(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    source = batches(
        spark, folder,
        [("a", "2024-01-01 00:00:00", "take", 1), ("b", "2024-01-01 00:00:00", "take", 2)],
        [("a", "2024-01-01 00:10:00", "take", 3), ("b", "2024-01-01 00:05:00", "free", 4)],
        [("z", "2024-01-01 03:00:00", "take", 5)],
        [("z", "2024-01-01 03:01:00", "take", 6)],
    )
    out = drain(holds.hold_changes(source, "k", "at", "kind", "take", "free", 20), "held")
    got = sorted((r.key, r.change) for r in out.where("key <> 'z'").collect())
    assert got == [("a", "expired"), ("a", "renewed"), ("a", "taken"), ("b", "released"), ("b", "taken")]


def test_counts_and_deduplication(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    source = batches(spark, folder, [("a", "2024-01-01 00:00:00", "x", 1), ("a", "2024-01-01 00:30:00", "x", 1)], [("a", "2024-01-01 05:00:00", "x", 9)], [("a", "2024-01-01 06:00:00", "y", 3)])
    rows = drain(holds.windowed_counts(source, "at", "kind", "id"), "counted").collect()
    assert [(r.kind, r.n, r.total) for r in rows if r.starts.hour == 0] == [("x", 2, 2)]
    once = drain(holds.recorded_once(source, ["k", "id"], "at"), "once").collect()
    assert sorted(r.id for r in once) == [1, 3, 9]


def test_append_new_is_idempotent(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    write = holds.append_new(path, ["k"])
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    for i in range(3):
        write(batch, i)
    assert spark.read.parquet(path).count() == 2


def test_features_snapshots_and_text(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    line = lambda c, **p: {"type": "Feature", "properties": p, "geometry": {"type": "LineString", "coordinates": c}}
    features = [line([[-80.41, 37.22], [-80.40, 37.22]], OBJECTID=1), {"type": "Feature", "properties": {"OBJECTID": 2}, "geometry": None}, line([], OBJECTID=3), {"type": "Feature", "properties": {"OBJECTID": 4}, "geometry": {"type": "MultiLineString", "coordinates": [[[-80.4, 37.2], [-80.4, 37.21]], [[-80.3, 37.2], [-80.3, 37.21]]]}}]
    with open(f"{folder}/x.geojson", "w") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
    got = layers.read_features(spark, f"{folder}/x.geojson", T.StructType([T.StructField("OBJECTID", T.LongType())]), STATE_PLANE)
    assert sorted((r.OBJECTID, len(r.lines)) for r in got.collect()) == [(1, 1), (4, 2)]
    assert layers.exploded_lines(got, "OBJECTID").count() == 3
    for date in ("2024-01-01", "2024-02-01"):
        m = layers.write_snapshot(got.select("OBJECTID"), folder + "/snap", "roads", date, expected=2, source="test").first()
        assert (m.feature_count, m.facts["source"]) == (2, "test")
    snaps = spark.read.option("basePath", folder + "/snap/roads").parquet(folder + "/snap/roads").withColumn("snapshot_date", F.col("snapshot_date").cast("string"))
    assert {r.snapshot_date for r in layers.latest(snaps).collect()} == {"2024-02-01"}
    try:
        layers.write_snapshot(got.select("OBJECTID"), folder + "/snap", "roads", "2024-03-01", expected=3)
        raise AssertionError("no error")
    except ValueError:
        pass
    with open(f"{folder}/p.txt", "w") as f:
        f.write("id|name\n1|a\nx|b\n3|c\n")
    assert [r.id for r in layers.read_delimited(spark, f"{folder}/p.txt", T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])).collect()] == [1, 3]
    layers.write_ndjson(got.select("OBJECTID"), folder + "/out")
    assert spark.read.json(folder + "/out").count() == 2


def test_paged_reader_pages_and_retries(monkeypatch):
    calls = []

    def answer(url, params, **_):
        calls.append(params)
        if "returnCountOnly" in params:
            return {"count": 5}
        at = params["resultOffset"]
        return {"features": [{"properties": {"i": i}, "geometry": None} for i in range(at, min(5, at + 2))]}

    monkeypatch.setattr(paged, "post", answer)
    reader = paged.FeatureReader({"url": "http://x", "pageSize": "2"})
    rows = [json.loads(p)["i"] for part in reader.partitions() for p, _ in reader.read(part)]
    assert rows == [0, 1, 2, 3, 4]


def test_post_gives_up_after_its_tries():
    waits = []
    try:
        paged.post("http://127.0.0.1:9/none", {}, tries=3, wait=waits.append)
        raise AssertionError("no error")
    except OSError:
        assert waits == [1.0, 2.0]
