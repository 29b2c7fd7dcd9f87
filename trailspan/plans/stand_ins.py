"""The driver's tables seen as segments, walks and bands, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspan.plans.registry import load

#: Column of a segment and its expression over lineitem, in words that both engines know.
SEGMENT = {
    "segment_id": "l_orderkey * 10 + l_linenumber",
    "u": "l_orderkey * 100",
    "v": "l_orderkey * 100 + l_linenumber",
    "length_m": "l_extendedprice / 100",
    "dataset": "CASE l_returnflag WHEN 'R' THEN 'DERIVED' WHEN 'A' THEN 'roads' ELSE 'paths' END",
    "connector_class": "CASE WHEN l_returnflag = 'R' THEN CASE l_partkey % 4 WHEN 0 THEN 'HIGH_CONFIDENCE' WHEN 1 THEN 'CROSSING_REVIEW_REQUIRED' WHEN 2 THEN 'LIKELY_FALSE' END END",
    "routable_by_default": "l_partkey % 4 = 0",
    "role": "CASE WHEN l_discount < 0.015 THEN 'EXCLUDED' WHEN l_discount < 0.065 THEN 'REQUIRED' WHEN l_discount < 0.085 THEN 'OPTIONAL_CONNECTOR' END",
    "role_status": "CASE WHEN l_tax < 0.025 THEN 'NEEDS_REVIEW' WHEN l_tax < 0.045 THEN 'PROVISIONAL' ELSE 'AUTOMATIC' END",
    "segment_type": "CASE l_linenumber % 3 WHEN 0 THEN 'STREET' WHEN 1 THEN 'TRAIL' ELSE 'PEDESTRIAN_CONNECTOR' END",
    "walkable": "l_quantity > 10",
    "households": "CAST(l_quantity AS BIGINT)",
    "display_name": "CASE WHEN l_partkey % 11 > 0 THEN concat('street ', CAST(l_partkey % 40 AS STRING)) END",
    "normalized_name": "CASE WHEN l_partkey % 11 > 0 THEN concat('street ', CAST(l_partkey % 40 AS STRING)) END",
    "access_type": "CASE l_suppkey % 9 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'GATED' ELSE 'PUBLIC' END",
    "label": "CASE WHEN l_suppkey % 7 > 0 THEN concat('area ', CAST(l_suppkey % 7 AS STRING)) END",
    "in_campus": "l_suppkey % 5 = 0",
    "campus_obligation": "CASE WHEN l_suppkey % 5 = 0 THEN CASE l_partkey % 3 WHEN 0 THEN 'CANONICAL' WHEN 1 THEN 'ALTERNATIVE' END END",
    "road_class": "CASE l_partkey % 7 WHEN 0 THEN 'Ramp' WHEN 1 THEN 'Arterial' WHEN 2 THEN 'Collector' WHEN 3 THEN 'Local' END",
    "speed": "CAST(l_suppkey % 10 AS INT) * 5",
    "done": "l_quantity > 40",
    "number": "l_linenumber",
    "route": "l_orderkey",
}
SEG = "seg AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in SEGMENT.items()) + " FROM lineitem)"
#: Members of the network, as SQL.
MEMBERS = SEG + ", mem AS (SELECT * FROM seg WHERE CASE WHEN dataset = 'DERIVED' THEN coalesce(connector_class = 'HIGH_CONFIDENCE', false) ELSE walkable AND coalesce(role IN ('REQUIRED', 'OPTIONAL_CONNECTOR'), false) END)"
WALKS = """
wal AS (SELECT o_orderkey AS walk, o_custkey AS person, CASE o_orderstatus WHEN 'F' THEN 'AS_PLANNED' WHEN 'O' THEN 'EDITED' ELSE 'DID_NOT_COMPLETE' END AS outcome, o_totalprice / 100000 AS distance FROM orders),
plan AS (SELECT DISTINCT l_orderkey AS walk, l_orderkey * 10 + l_linenumber AS segment_id FROM lineitem WHERE l_linenumber <= 4),
chos AS (SELECT DISTINCT l_orderkey AS walk, l_orderkey * 10 + l_linenumber AS segment_id FROM lineitem WHERE l_linenumber >= 3),
comp AS (SELECT DISTINCT l_orderkey AS walk, l_orderkey * 10 + l_linenumber AS segment_id FROM lineitem WHERE l_returnflag = 'A')"""
BANDS = """ban AS (SELECT o_custkey AS request, o_orderpriority AS band, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 2.0 WHEN '3' THEN 3.5 WHEN '4' THEN 5.0 ELSE 7.5 END AS target,
    count_if(o_totalprice > 150000) > 0 AS has_route, round(sum(o_totalprice) / 1000000, 3) AS new_miles, round(sum(o_totalprice) / 500000, 2) AS total_miles, round(min(o_totalprice) / 400000, 3) AS efficiency,
    CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 10) / 2.0 END AS nearest_miles FROM orders GROUP BY ALL)"""


def segments(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {c}" for c, e in SEGMENT.items()))


def members(spark, sf_dir):
    from trailspan.operators.membership import membership

    keep = membership(F.col("dataset"), F.col("connector_class"), F.col("role"), F.col("walkable"))["keep"]
    return segments(spark, sf_dir).where(keep)


def walks(spark, sf_dir):
    """walks, planned, chosen and existing completions."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("walk"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("segment_id"), "l_linenumber", "l_returnflag")
    outcome = F.when(F.col("o_orderstatus") == "F", "AS_PLANNED").when(F.col("o_orderstatus") == "O", "EDITED").otherwise("DID_NOT_COMPLETE")
    head = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("walk"), F.col("o_custkey").alias("person"), outcome.alias("outcome"), (F.col("o_totalprice") / 100000).alias("distance"))
    some = lambda c: lines.where(c).select("walk", "segment_id").distinct()
    return head, some("l_linenumber <= 4"), some("l_linenumber >= 3"), some("l_returnflag = 'A'")


def bands(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    target = F.when(first == "1", 1.0).when(first == "2", 2.0).when(first == "3", 3.5).when(first == "4", 5.0).otherwise(7.5)
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request"), F.col("o_orderpriority").alias("band"), target.alias("target"))
    out = rows.agg(
        (F.count_if(F.col("o_totalprice") > 150000) > 0).alias("has_route"), F.round(F.sum("o_totalprice") / 1000000, 3).alias("new_miles"),
        F.round(F.sum("o_totalprice") / 500000, 2).alias("total_miles"), F.round(F.min("o_totalprice") / 400000, 3).alias("efficiency"),
    )
    return out.withColumn("nearest_miles", F.when(F.col("request") % 3 > 0, (F.col("request") % 10) / 2.0))
