"""Layers of polygons, links and roads made of the rows of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.operators import network, polygons
from trailspan.plans.registry import load, query
from trailspan.shared import stored

#: Every nation is a polygon around a place of its own, with a corner for each of its customers, in the order of their keys.
CORNER_SQL = """
cor AS (SELECT c_nationkey AS poly_id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_nationkey) AS n, 250 + (c_acctbal + 1000) / 20 AS size FROM customer),
pts AS (SELECT poly_id, r, n, (poly_id % 5) * 1500 + size * cos(2 * pi() * r / n) AS x, floor(poly_id / 5) * 1500 + size * sin(2 * pi() * r / n) AS y FROM cor),
edg AS (SELECT p.poly_id, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS b_y FROM pts p JOIN pts q ON p.poly_id = q.poly_id AND q.r = (p.r + 1) % p.n WHERE p.n > 2)"""
#: A straight line for each order, and its middle.
LINE_SQL = """
lin AS (SELECT o_orderkey AS line_id, (o_orderkey * 37) % 7500 - 749.75 AS x1, (o_orderkey * 91) % 7500 - 749.75 AS y1, (o_orderkey * 37) % 7500 - 749.75 + o_custkey % 801 - 400.5 AS x2, (o_orderkey * 91) % 7500 - 749.75 + o_custkey % 603 - 301.5 AS y2 FROM orders),
mid AS (SELECT *, x1 + (x2 - x1) / 2 AS mx, y1 + (y2 - y1) / 2 AS my FROM lin)"""
INSIDE = "count_if((ay > my) <> (b_y > my) AND mx < (bx - ax) * (my - ay) / (b_y - ay) + ax) % 2 = 1"
CROSS = "((bx - ax) * (y2 - y1) - (b_y - ay) * (x2 - x1))"
MEETS = f"""bool_or({CROSS} <> 0 AND ((ax - x1) * (b_y - ay) - (ay - y1) * (bx - ax)) / -{CROSS} BETWEEN 0 AND 1
    AND ((ax - x1) * (y2 - y1) - (ay - y1) * (x2 - x1)) / -{CROSS} BETWEEN 0 AND 1)"""


def nation_edges(spark, sf_dir):
    w = Window.partitionBy("c_nationkey")
    corner = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("poly_id"), (F.row_number().over(w.orderBy("c_custkey")) - 1).alias("r"), F.count("*").over(w).alias("n"), (250 + (F.col("c_acctbal") + 1000) / 20).alias("size"))
    angle = 2 * F.pi() * F.col("r") / F.col("n")
    place = geometry.point((F.col("poly_id") % 5) * 1500 + F.col("size") * F.cos(angle), F.floor(F.col("poly_id") / 5) * 1500 + F.col("size") * F.sin(angle))
    p = corner.where("n > 2").select("poly_id", "r", "n", place.alias("p"))
    order = Window.partitionBy("poly_id").orderBy("r")
    first = F.first("p").over(order)
    return p.select("poly_id", F.col("p").alias("a"), F.coalesce(F.lead("p").over(order), first).alias("b"))


def order_lines(spark, sf_dir):
    x, y = F.col("o_orderkey") * 37 % 7500 - 749.75, F.col("o_orderkey") * 91 % 7500 - 749.75
    line = F.array(geometry.point(x, y), geometry.point(x + F.col("o_custkey") % 801 - 400.5, y + F.col("o_custkey") % 603 - 301.5))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_id"), line.alias("line"))


@query(f"WITH {CORNER_SQL}, {LINE_SQL} SELECT line_id AS point_id, poly_id FROM mid, edg GROUP BY line_id, poly_id, mx, my HAVING {INSIDE}")
def points_in_polygons(spark, sf_dir):
    """Orders as points, nations as polygons with a corner for each customer."""
    middle = polygons.middles(order_lines(spark, sf_dir)).withColumnRenamed("line_id", "point_id")
    return polygons.points_in(middle, nation_edges(spark, sf_dir))


@query(f"""
WITH {CORNER_SQL}, {LINE_SQL}, met AS (SELECT line_id, poly_id, {INSIDE} AS middle_inside, {MEETS} AS crosses FROM mid, edg GROUP BY line_id, poly_id)
SELECT line_id, poly_id, middle_inside, crosses, NOT crosses AS contains, true AS intersects FROM met WHERE middle_inside OR crosses
""")
def lines_and_polygons(spark, sf_dir):
    """Which polygons contain, cross or meet each order's line."""
    return polygons.lines_against(order_lines(spark, sf_dir), nation_edges(spark, sf_dir))


@query(f"""
WITH {CORNER_SQL}, {LINE_SQL}, met AS (SELECT line_id, poly_id, {INSIDE} AS inn, {MEETS} AS over_ FROM mid, edg GROUP BY line_id, poly_id)
SELECT line_id, bool_or(inn AND poly_id % 5 IN (0, 3, 4)) AS inside_boundary, bool_or(over_ AND poly_id % 5 IN (0, 3, 4)) AS crosses_boundary,
    bool_or(inn AND poly_id % 5 = 1) AS in_campus, bool_or(inn AND poly_id % 5 = 2) AS in_private FROM met GROUP BY line_id
""")
def layer_flags(spark, sf_dir):
    """Flags of each order's line from three layers of nations."""
    edges = nation_edges(spark, sf_dir)
    part = lambda c: edges.where(c)
    return polygons.layer_flags(order_lines(spark, sf_dir), part("poly_id % 5 IN (0, 3, 4)"), part("poly_id % 5 = 1"), part("poly_id % 5 = 2"))


@query("""
WITH link AS (SELECT c_custkey AS line_id, (c_custkey * 53) % 5000 + 0.25 AS x1, (c_custkey * 71) % 5000 + 0.25 AS y1, (c_custkey * 53) % 5000 + 0.25 + c_custkey % 401 - 200.5 AS x2, (c_custkey * 71) % 5000 + 0.25 + c_custkey % 307 - 153.5 AS y2 FROM customer),
corner AS (SELECT s_suppkey AS other_id, s_nationkey, unnest([1, 2]) AS k, (s_suppkey * 211) % 5000 + 0.5 AS px, (s_suppkey * 373) % 5000 + 0.5 AS qx, (s_suppkey * 499) % 5000 + 0.5 AS rx FROM supplier),
road AS (SELECT other_id, s_nationkey, CASE k WHEN 1 THEN px ELSE qx END AS ax, CASE k WHEN 1 THEN 0.0 ELSE 2500.0 END AS ay, CASE k WHEN 1 THEN qx ELSE rx END AS bx, CASE k WHEN 1 THEN 2500.0 ELSE 5000.0 END AS b_y FROM corner),
hit AS (SELECT *, (x2 - x1) * (b_y - ay) - (y2 - y1) * (bx - ax) AS d FROM link, road),
found AS (SELECT DISTINCT line_id, other_id, s_nationkey, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS size, round(((ax - x1) * (b_y - ay) - (ay - y1) * (bx - ax)) / d * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 3) AS m FROM hit
    WHERE d <> 0 AND ((ax - x1) * (b_y - ay) - (ay - y1) * (bx - ax)) / d BETWEEN 0 AND 1 AND ((ax - x1) * (y2 - y1) - (ay - y1) * (x2 - x1)) / d BETWEEN 0 AND 1)
SELECT line_id, count(*) AS crossed, count_if(s_nationkey % 3 = 0) AS crossed_limited, min(m) AS first_at FROM found WHERE m > 0.5 AND m < size - 0.5 GROUP BY line_id
""")
def link_crossings(spark, sf_dir):
    """Roads of two pieces through the whole area, one a supplier, that the link of each customer crosses away from its ends."""
    key = F.col("c_custkey")
    x, y = key * 53 % 5000 + 0.25, key * 71 % 5000 + 0.25
    links = load(spark, sf_dir, "customer").select(key.alias("line_id"), F.array(geometry.point(x, y), geometry.point(x + key % 401 - 200.5, y + key % 307 - 153.5)).alias("line"))
    at = lambda m, up: geometry.point(F.col("s_suppkey") * m % 5000 + 0.5, F.lit(up))
    supplier = load(spark, sf_dir, "supplier")
    roads = supplier.select("s_suppkey", "s_nationkey", F.array(at(211, 0.0), at(373, 2500.0), at(499, 5000.0)).alias("line"))
    # roads on one line are crossed together: one of them is met and counts for all
    kinds = stored(roads.groupBy("line").agg((-1 - F.min("s_suppkey")).alias("other_id"), F.count("*").alias("n"), F.count_if(F.col("s_nationkey") % 3 == 0).alias("limited")), "roads")
    met = network.crossings(links, kinds.select(F.col("other_id").alias("line_id"), "line")).join(kinds.drop("line"), "other_id")
    return met.groupBy("line_id").agg(F.sum("n").alias("crossed"), F.sum("limited").alias("crossed_limited"), F.min("at").alias("first_at"))
