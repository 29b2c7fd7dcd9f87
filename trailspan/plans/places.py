"""Geometry over the driver's tables: embeddings as points, parts as places."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.plans.registry import load, query


@query("""
WITH p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT label, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d, x * lead(y) OVER w - lead(x) OVER w * y AS c FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, (SELECT count(*) FROM p q WHERE q.label IS NOT DISTINCT FROM s.label) AS points, round(sum(d), 4) AS length, round(sum(c) / 2, 4) AS area FROM s GROUP BY label
""")
def polyline_metrics(spark, sf_dir):
    """Length and signed area of each label's line through its points."""
    points = load(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    w = Window.partitionBy("label").orderBy("vec_id")
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    # one pass over each line in order; no line is an array
    parts = points.select("label", F.hypot(nx - F.col("x"), ny - F.col("y")).alias("d"), (F.col("x") * ny - nx * F.col("y")).alias("c"))
    return parts.groupBy("label").agg(F.count("*").alias("points"), F.round(F.sum("d"), 4).alias("length"), F.round(F.sum("c") / 2, 4).alias("area"))


RING = [(5.5, 905.5), (40.5, 905.5), (40.5, 1500.5), (25.5, 1200.25), (5.5, 1500.5), (5.5, 905.5)]


@query(f"""
WITH edges(ax, ay, bx, b_y) AS (VALUES {", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(RING, RING[1:]))})
SELECT p_partkey, count_if((ay > p_retailprice) <> (b_y > p_retailprice) AND p_size < (bx - ax) * (p_retailprice - ay) / (b_y - ay) + ax) % 2 = 1 AS inside FROM part, edges GROUP BY p_partkey
""")
def point_in_polygon(spark, sf_dir):
    """Parts as points, inside a ring or not."""
    ring = F.array(*(geometry.point(F.lit(x), F.lit(y)) for x, y in RING))
    return load(spark, sf_dir, "part").select("p_partkey", geometry.contains(ring, geometry.point(F.col("p_size"), F.col("p_retailprice"))).alias("inside"))
