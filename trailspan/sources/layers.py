"""Layers of features: GeoJSON and delimited files in, snapshots with their manifest out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspan.functions.geometry import Lambert, point
from trailspan.shared import stored


def read_features(spark: SparkSession, path: str, properties: T.StructType, projection: Lambert | None = None) -> DataFrame:
    """Features of line layers: the given properties, and ``lines``, an array of lines of points.

    Features without geometry or with an empty one are dropped; a LineString
    is one line, a MultiLineString several; with a projection, degrees become
    metres. The file is read as whole JSON documents with a declared schema.
    """
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", geometry)])
    whole = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).option("multiLine", True).json(path)
    rows = whole.select(F.explode("features").alias("f")).where("f.geometry.coordinates IS NOT NULL").select("f.properties.*", F.col("f.geometry.type").alias("_t"), F.col("f.geometry.coordinates").alias("_c"))
    one, many = F.from_json("_c", "array<array<double>>"), F.from_json("_c", "array<array<array<double>>>")
    raw = F.when(F.col("_t") == "LineString", F.array(one)).when(F.col("_t") == "MultiLineString", many)
    place = (lambda c: projection.forward(c[0], c[1])) if projection else (lambda c: point(c[0], c[1]))
    lines = F.filter(F.transform(raw, lambda line: F.transform(line, place)), lambda line: F.size(line) > 1)
    return rows.withColumn("lines", lines).drop("_t", "_c").where(F.size("lines") > 0)


def exploded_lines(features: DataFrame, id_col: str) -> DataFrame:
    """One row (line_id, line) a line; line_id is a running number by id and position."""
    return features.select(id_col, F.posexplode("lines").alias("part", "line"))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|") -> DataFrame:
    """Delimited text with a header. Ragged rows and rows with bad numbers are dropped."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def split_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of delimited text with a header: ragged rows and rows with bad numbers are kept whole as (line). The text is
    parsed once and stored, so both sides, and their counts, are of the same rows."""
    with_line = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    parsed = spark.read.schema(with_line).option("sep", sep).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    held = stored(parsed, "delimited")
    return held.where("_line IS NULL").drop("_line"), held.where("_line IS NOT NULL").select(F.col("_line").alias("line"))


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest rows of all layers and dates that ``write_snapshot`` left in a folder."""
    schema = "layer string, snapshot_date string, feature_count long, field_names array<string>, facts map<string,string>"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/_manifest")


def source_manifest(manifests: DataFrame, registry: DataFrame, date: str) -> DataFrame:
    """(layer, snapshot_date, feature_count, status, note) of one date for every registered source (layer, blocked, note): ``fetched``
    with its count, ``blocked`` with its note, or ``missing``; a layer that nobody registered is ``unregistered``."""
    here = manifests.where(F.col("snapshot_date") == date).select("layer", "feature_count")
    both = registry.select("layer", "blocked", "note").withColumn("_known", F.lit(True)).join(here, "layer", "full")
    status = F.when(F.col("_known").isNull(), "unregistered").when(F.col("feature_count").isNotNull(), "fetched").when(F.coalesce("blocked", F.lit(False)), "blocked").otherwise("missing")
    return both.select("layer", F.lit(date).alias("snapshot_date"), "feature_count", status.alias("status"), F.when(status == "blocked", F.col("note")).alias("note"))


def write_ndjson(frame: DataFrame, path: str) -> None:
    """One JSON object a line."""
    frame.write.mode("overwrite").json(path)


def write_snapshot(frame: DataFrame, folder: str, layer: str, date: str, expected: int | None = None, **facts: str) -> DataFrame:
    """Store a layer as Parquet under ``layer`` and ``snapshot_date``, and its manifest row beside it; a count that is not the
    expected one is an error. Returns the manifest."""
    spark = frame.sparkSession
    path = f"{folder}/{layer}/snapshot_date={date}"
    frame.write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path).count()
    if expected is not None and rows != expected:
        raise ValueError(f"{layer}: {rows} rows, {expected} expected")
    manifest = spark.createDataFrame([(layer, date, rows, frame.columns, {k: str(v) for k, v in facts.items()})], "layer string, snapshot_date string, feature_count long, field_names array<string>, facts map<string,string>")
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest/{layer}/{date}")
    return manifest


def latest(frame: DataFrame, date: str | Column = "snapshot_date") -> DataFrame:
    """Rows of the last snapshot: one aggregate over the partition column, then a filter on it."""
    column = F.col(date) if isinstance(date, str) else date
    last = frame.agg(F.max(column)).first()[0]
    return frame.where(column == F.lit(last)) if last is not None else frame.limit(0)
