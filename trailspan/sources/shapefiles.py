"""Shapefiles as DataFrames: records of points, lines and rings with their attributes, one file a task."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspan.functions.geometry import signed_area

SCHEMA = "file string, record int, kind int, parts array<array<struct<x:double,y:double>>>, attributes map<string,string>"


def _shapes(raw: bytes) -> Iterator[tuple[int, list]]:
    at = 100
    while at + 12 <= len(raw):
        size = 2 * struct.unpack_from(">i", raw, at + 4)[0]
        kind = struct.unpack_from("<i", raw, at + 8)[0]
        body, parts = at + 12, []
        if kind % 10 == 1:
            parts = [[struct.unpack_from("<2d", raw, body)]]
        elif kind % 10 in (3, 5):
            n, m = struct.unpack_from("<2i", raw, body + 32)
            starts = [*struct.unpack_from(f"<{n}i", raw, body + 40), m]
            flat = struct.unpack_from(f"<{2 * m}d", raw, body + 40 + 4 * n)
            points = list(zip(flat[::2], flat[1::2]))
            parts = [points[a:b] for a, b in zip(starts, starts[1:])]
        yield kind, parts
        at += 8 + size


def _attributes(raw: bytes) -> Iterator[dict[str, str]]:
    count, head, width = struct.unpack_from("<I2H", raw, 4)
    fields, at, place = [], 32, 1
    while raw[at] != 0x0D:
        name = raw[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, place, place + raw[at + 16]))
        place += raw[at + 16]
        at += 32
    for i in range(count):
        row = raw[head + i * width : head + (i + 1) * width]
        yield {name: text for name, a, b in fields if (text := row[a:b].decode("utf-8", "replace").strip(" \0"))}


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, kind, parts, attributes) of every .shp under ``path`` (a glob or folder), with the .dbf of the same name.

    Kinds are the format's: 0 none, 1 points, 3 lines, 5 rings; third and fourth
    coordinates are left out. Blank attributes are missing. Shards are read in
    parallel; a file, 2 GB at most, is one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_replace("path", r"\.[A-Za-z]+$", "")
    of = lambda end, name: files.where(F.lower("path").endswith(end)).select(stem.alias("file"), F.col("content").alias(name))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                facts = _attributes(r.dbf) if r.dbf is not None else iter(())
                rows = [(r.file, i, kind, [[{"x": x, "y": y} for x, y in part] for part in parts], next(facts, {})) for i, (kind, parts) in enumerate(_shapes(r.shp))]
                for at in range(0, max(1, len(rows)), 5000):
                    yield pd.DataFrame(rows[at : at + 5000], columns=["file", "record", "kind", "parts", "attributes"])

    return of(".shp", "shp").join(of(".dbf", "dbf"), "file", "left").mapInPandas(run, SCHEMA)


def polygons(parts: Column) -> Column:
    """Rings as array of polygons, each an outer ring and its holes: clockwise rings begin one, the others are holes of the one
    before. Rings of fewer than four points, and holes before any outer ring, are left out."""
    ring = "array<struct<x:double,y:double>>"
    good = F.filter(parts, lambda r: F.size(r) >= 4)

    def add(acc: Column, r: Column) -> Column:
        last = F.size(acc)
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.array(r))))
        return F.when(signed_area(r) < 0, F.concat(acc, F.array(F.array(r)))).when(last > 0, grown).otherwise(acc)

    return F.aggregate(good, F.array().cast(f"array<array<{ring}>>"), add)


def polylines(parts: Column) -> Column:
    """Parts of two points or more."""
    return F.filter(parts, lambda p: F.size(p) >= 2)


def meets_box(parts: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether the bounds of a shape meet a box."""
    points = F.flatten(parts)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return ~((F.array_max(xs) < west) | (F.array_min(xs) > east) | (F.array_max(ys) < south) | (F.array_min(ys) > north))
