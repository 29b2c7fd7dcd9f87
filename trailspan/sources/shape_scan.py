"""Shapefiles as a Spark data source that reads ranges of records and leaves out, before a shape is decoded, what filters and a box
exclude; and the layers of a base map with their rules."""

from __future__ import annotations

import operator
import struct
from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from trailspan.operators.cartography import first_zoom, overlaps, road_class, shield
from trailspan.sources.shapefiles import polygons, polylines

BOUNDS = ("west", "south", "east", "north")
_OWN = ("record", "kind", *BOUNDS, "parts")
# Features of areas that are open water, of flow lines that run under ground, and kinds of public land.
OPEN_WATER, UNDERGROUND = (460, 390, 361), (420, 428)
PUBLIC_LAND = ("National Forest", "National Park", "Wilderness", "National Wildlife Refuge")
GREAT_RIVERS, GREAT_ZOOM = ("New River", "Roanoke River"), 7
#: Column tests that are decided here, with the value on the right.
_TESTS = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


def _opened(path: str):
    """A file of any store that pyarrow knows; s3a is the same store as s3."""
    if "://" in path or path.startswith("file:"):
        store, inner = pafs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)
        return store.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(path)


class Table:
    """The attribute file: records of fixed width, so any range of them is one read."""

    def __init__(self, path: str, encoding: str):
        self.file, self.encoding = _opened(path), encoding
        self.count, self.head, self.width = struct.unpack("<I2H", self.file.read_at(8, 4))
        raw, self.fields, at, place = self.file.read_at(self.head, 0), [], 32, 1
        while at < len(raw) and raw[at] != 0x0D:
            name = raw[at : at + 11].split(b"\0")[0].decode("latin-1").lower()
            self.fields.append((f"{name}_" if name in _OWN else name, place, place + raw[at + 16]))
            place += raw[at + 16]
            at += 32

    def rows(self, start: int, stop: int) -> Iterator[dict[str, str | None]]:
        stop = min(stop, self.count)
        raw = self.file.read_at(max(0, stop - start) * self.width, self.head + start * self.width)
        for i in range(max(0, stop - start)):
            row = raw[i * self.width : (i + 1) * self.width]
            yield {name: row[a:b].decode(self.encoding, "replace").strip(" \0") or None for name, a, b in self.fields}


class Records(ds.InputPartition):
    def __init__(self, stem: str, start: int, stop: int):
        super().__init__((stem, start, stop))
        self.stem, self.start, self.stop = stem, start, stop


class ShapeReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.stems = [p.removesuffix(".shp") for p in options["path"].split(",")]
        self.step, self.encoding = int(options.get("step", 10_000)), options.get("encoding", "latin-1")
        self.box = [float(v) for v in options["box"].split(",")] if "box" in options else None
        self.tests: list[tuple[str, object, object]] = []
        #: Records whose attributes, bounds and shape were looked at; of this reader's own ``read`` calls.
        self.seen = self.bounded = self.decoded = 0

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Comparisons with a value, lists of values and tests for null of single columns are done here; the rest is left to Spark."""
        for f in filters:
            name = f.attribute[0].lower() if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            kind = type(f)
            if name is None or name == "parts" or not (kind in _TESTS or kind in (ds.In, ds.IsNotNull, ds.IsNull)):
                yield f
            elif kind is ds.IsNotNull:
                self.tests.append((name, lambda v, _: v is not None, None))
            elif kind is ds.IsNull:
                self.tests.append((name, lambda v, _: v is None, None))
            elif kind is ds.In:
                self.tests.append((name, lambda v, some: v is not None and v in some, set(f.value)))
            else:
                self.tests.append((name, lambda v, w, test=_TESTS[kind]: v is not None and w is not None and test(v, w), f.value))

    def partitions(self) -> list[Records]:
        out = []
        for stem in self.stems:
            n = (_opened(stem + ".shx").size() - 100) // 8
            out += [Records(stem, i, min(n, i + self.step)) for i in range(0, n, self.step)]
        return out

    def read(self, partition: Records) -> Iterator[tuple]:
        table = Table(partition.stem + ".dbf", self.encoding)
        late = {"kind", *BOUNDS}
        early = [t for t in self.tests if t[0] not in late and t[0] != "record"]
        wanted = []
        for i, row in enumerate(table.rows(partition.start, partition.stop), partition.start):
            self.seen += 1
            if all(test(row.get(name), value) for name, test, value in early) and all(test(i, value) for name, test, value in self.tests if name == "record"):
                wanted.append((i, row))
        if not wanted:
            return
        index = _opened(partition.stem + ".shx").read_at((partition.stop - partition.start) * 8, 100 + partition.start * 8)
        place = lambda i: [2 * v for v in struct.unpack_from(">2i", index, (i - partition.start) * 8)]
        shapes = _opened(partition.stem + ".shp")
        rest = [t for t in self.tests if t[0] in late]
        for i, row in wanted:
            at, size = place(i)
            raw = shapes.read_at(min(size, 36), at + 8)
            kind = struct.unpack_from("<i", raw, 0)[0]
            self.bounded += 1
            box = (None,) * 4
            if kind % 10 == 1:
                x, y = struct.unpack_from("<2d", raw, 4)
                box = (x, y, x, y)
            elif kind % 10 in (3, 5):
                box = struct.unpack_from("<4d", raw, 4)
            facts = {"kind": kind, **dict(zip(BOUNDS, box))}
            if not all(test(facts[name], value) for name, test, value in rest):
                continue
            if self.box and (box[0] is None or box[0] > self.box[2] or box[2] < self.box[0] or box[1] > self.box[3] or box[3] < self.box[1]):
                continue
            self.decoded += 1
            yield (i, kind, *box, self._parts(kind, box, shapes.read_at(size, at + 8) if kind % 10 in (3, 5) else raw), *(row[name] for name, _, _ in table.fields))

    @staticmethod
    def _parts(kind: int, box: tuple, raw: bytes) -> list[list[tuple[float, float]]]:
        if kind % 10 == 1:
            return [[box[:2]]]
        if kind % 10 not in (3, 5):
            return []
        n, m = struct.unpack_from("<2i", raw, 36)
        starts = [*struct.unpack_from(f"<{n}i", raw, 44), m]
        flat = struct.unpack_from(f"<{2 * m}d", raw, 44 + 4 * n)
        points = list(zip(flat[::2], flat[1::2]))
        return [points[a:b] for a, b in zip(starts, starts[1:])]


class ShapeSource(ds.DataSource):
    """``spark.read.format("shapes").option("path", stems)``: record, kind, bounds, parts and every attribute as text, blank ones null.

    ``path`` names one file or several shards of one layout, separated by commas;
    beside each .shp stand its .shx and .dbf. ``step`` is the records of a
    partition, ``box`` (west,south,east,north) leaves out shapes that do not meet
    it and empty ones, ``encoding`` is of the attributes. An attribute named as a
    column of the source gets an underscore behind it.
    """

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        table = Table(self.options["path"].split(",")[0].removesuffix(".shp") + ".dbf", "latin-1")
        own = "record int, kind int, west double, south double, east double, north double, parts array<array<struct<x:double,y:double>>>"
        return ", ".join([own, *(f"`{name}` string" for name, _, _ in table.fields)])

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(self.options)


def scan(spark: SparkSession, *stems: str, box: tuple[float, float, float, float] | None = None, step: int = 10_000) -> DataFrame:
    """Shards of one layout as one table; filters of the result reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShapeSource)
    reader = spark.read.format("shapes").option("path", ",".join(stems)).option("step", step)
    return (reader.option("box", ",".join(map(str, box))) if box else reader).load()


def _whole(c: str) -> Column:
    return F.col(c).try_cast("double").cast("int")


def roads(shards: DataFrame) -> DataFrame:
    """(class, name, ref, lines): roads by rank, without the codes that are no roads; a shield is the name people go by."""
    ref = shield(F.col("interstate"), F.col("us_route"), F.col("state_route"))
    made = shards.withColumn("ref", ref).withColumn("class", road_class(_whole("tnmfrc"), F.col("mtfcc_code"), F.col("ref"))).withColumn("lines", polylines(F.col("parts")))
    name = F.coalesce(F.nullif("ref", F.lit("")), F.trim("name"))
    return made.where(F.col("class").isNotNull() & (F.size("lines") > 0)).select("class", name.alias("name"), F.nullif("ref", F.lit("")).alias("ref"), "lines")


def rail(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("lines", polylines(F.col("parts"))).where(F.size("lines") > 0).select(F.lit("rail").alias("class"), "lines")


def water(bodies: DataFrame, areas: DataFrame) -> DataFrame:
    """(kind, name, first_zoom, polygons): bodies, and those areas that are open water."""
    some = [bodies.select(F.lit("body").alias("kind"), "gnis_name", "visibility", "parts"), areas.where(_whole("ftype").isin(*OPEN_WATER)).select(F.lit("area").alias("kind"), "gnis_name", "visibility", "parts")]
    made = some[0].unionByName(some[1]).withColumn("polygons", polygons(F.col("parts")))
    return made.where(F.size("polygons") > 0).select("kind", F.trim("gnis_name").alias("name"), first_zoom(_whole("visibility")).alias("first_zoom"), "polygons")


def waterways(flows: DataFrame) -> DataFrame:
    """(name, first_zoom, major, lines): streams above ground; the great rivers show before anything else."""
    name = F.trim("gnis_name")
    great = F.coalesce(name.isin(*GREAT_RIVERS), F.lit(False))
    made = flows.where(~F.coalesce(_whole("ftype").isin(*UNDERGROUND), F.lit(False))).withColumn("lines", polylines(F.col("parts"))).where(F.size("lines") > 0)
    return made.select(name.alias("name"), F.when(great, GREAT_ZOOM).otherwise(first_zoom(_whole("visibility"))).alias("first_zoom"), great.alias("major"), "lines")


def public_land(lands: DataFrame) -> DataFrame:
    """(name, polygons) of forests, parks, wilderness and refuges; the list reaches the file."""
    made = lands.where(F.col("feature1").isin(*PUBLIC_LAND)).withColumn("polygons", polygons(F.col("parts")))
    return made.where(F.size("polygons") > 0).select(F.coalesce(F.trim("gnis_name1"), F.lit("")).alias("name"), "polygons")


def within(frame: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Shapes whose bounds meet a box: comparisons of bounds, which reach the file."""
    return frame.where(overlaps(F.col("west"), F.col("south"), F.col("east"), F.col("north"), box))
