"""Homes, sites, base-map rules and minutes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspan.functions import geometry, identity
from trailspan.operators import cartography, missions, places
from trailspan.plans.registry import load, query


@query("""
WITH h AS (SELECT c_custkey, c_acctbal / 20 AS x, (c_custkey * 37 % 500)::DOUBLE AS y, c_nationkey AS n FROM customer),
l AS (SELECT s_suppkey, s_acctbal / 20 AS x, (s_suppkey * 53 % 500)::DOUBLE AS y, s_nationkey AS n, s_suppkey % 2 = 0 AS owed FROM supplier),
d AS (SELECT c_custkey, s_suppkey, sqrt((h.y - l.y) ** 2 + (h.x - greatest(l.x, least(l.x + 60, h.x))) ** 2) AS d, h.n = l.n AS same, owed FROM h, l),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d - CASE WHEN same THEN 12.0 ELSE 0.0 END - CASE WHEN owed THEN 1000.0 ELSE 0.0 END, d, NOT same, s_suppkey) AS r FROM d WHERE d <= 75)
SELECT h.c_custkey AS home_id, max(CASE WHEN r = 1 THEN s_suppkey END) AS main, round(max(CASE WHEN r = 1 THEN d END), 4) AS distance,
    coalesce(string_agg(CASE WHEN r BETWEEN 2 AND 4 THEN s_suppkey::VARCHAR END, ',' ORDER BY r), '') AS others, CASE WHEN max(CASE WHEN r = 1 THEN s_suppkey END) IS NULL THEN 'BEYOND_CAP' ELSE '' END AS reason
FROM h LEFT JOIN r USING (c_custkey) GROUP BY 1
""")
def household_association(spark, sf_dir):
    """Customers as homes, suppliers as streets of 60 m: best street within 75 m, with bonuses, and the next three."""
    homes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("home_id"), (F.col("c_acctbal") / 20).alias("x"), (F.col("c_custkey") * 37 % 500).cast("double").alias("y"), F.col("c_nationkey").cast("string").alias("name"))
    x, y = F.col("s_acctbal") / 20, (F.col("s_suppkey") * 53 % 500).cast("double")
    lines = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line_id"), F.array(geometry.point(x, y), geometry.point(x + 60, y)).alias("line"), F.col("s_nationkey").cast("string").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("owed"))
    return places.associated(homes, lines).select("home_id", "main", F.round("distance", 4).alias("distance"), F.concat_ws(",", F.col("others").cast("array<string>")).alias("others"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("""
WITH s AS (SELECT c_nationkey, count(*) AS units, count_if(c_acctbal < 0) AS beyond, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5 ELSE 0 END) AS net, count(*) * 450.0 AS area FROM customer GROUP BY 1)
SELECT c_nationkey, units, CASE WHEN beyond / units > 0.35 OR (net < 25 AND beyond / units > 0.10 AND area / 4046.86 > 6) THEN 'ADD_AUTHORITATIVE_PEDESTRIAN_NETWORK' WHEN beyond / units > 0.10 THEN 'ASSOCIATE_WITH_FRONTAGE_STREETS' ELSE 'ACCEPT_AUTOMATIC_ASSOCIATION' END AS disposition,
    CASE WHEN beyond / units > 0.35 OR (net < 25 AND beyond / units > 0.10 AND area / 4046.86 > 6) THEN 'ALL' WHEN beyond / units > 0.10 THEN 'BEYOND_CAP_ONLY' ELSE 'NONE' END AS hold FROM s
""")
def site_dispositions(spark, sf_dir):
    """What becomes of each nation's site by its units beyond reach."""
    per = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("units"), F.count_if(F.col("c_acctbal") < 0).alias("beyond"), F.sum(F.when(F.col("c_mktsegment") == "BUILDING", 1.5).otherwise(0)).alias("net"))
    made = places.site_disposition(F.col("units"), F.col("beyond"), F.col("net"), F.col("units") * 450.0)
    return per.select("c_nationkey", "units", made["disposition"].alias("disposition"), made["hold"].alias("hold"))


@query("""
WITH p AS (SELECT p_partkey, p_size % 9 AS frc, ['S1400', 'S1200', 'S1630', 'S1100', 'S1500'][p_size % 5 + 1] AS code, CASE WHEN p_size % 7 = 0 THEN 'US 460 Bus' WHEN p_size % 11 = 0 THEN 'VA 114' ELSE '' END AS ref FROM part),
c AS (SELECT *, CASE WHEN code = 'S1630' THEN 'link' ELSE CASE frc WHEN 1 THEN 'motorway' WHEN 2 THEN 'motorway' WHEN 3 THEN 'trunk' WHEN 4 THEN 'primary' WHEN 5 THEN 'secondary' WHEN 6 THEN 'tertiary' ELSE 'minor' END END AS base FROM p)
SELECT p_partkey, ref, CASE WHEN code = 'S1500' THEN NULL WHEN ref = '' AND code = 'S1400' AND base NOT IN ('minor', 'link') THEN 'minor' WHEN ref = '' AND code = 'S1200' AND base IN ('motorway', 'trunk', 'primary') THEN 'secondary' ELSE base END AS class,
    CASE WHEN p_partkey * 1000 >= 1000000 THEN 7 WHEN p_partkey * 1000 >= 500000 THEN 9 WHEN p_partkey * 1000 >= 250000 THEN 10 WHEN p_partkey * 1000 >= 100000 THEN 11 ELSE 13 END AS zoom FROM c
""")
def road_classes(spark, sf_dir):
    """Classes of roads with the demotions by feature code, shields, and first zooms."""
    part = load(spark, sf_dir, "part")
    code = F.element_at(F.array(*map(F.lit, ("S1400", "S1200", "S1630", "S1100", "S1500"))), (F.col("p_size") % 5 + 1).cast("int"))
    us, va = F.when(F.col("p_size") % 7 == 0, "Bus,460"), F.when(F.col("p_size") % 11 == 0, "114,733")
    rows = part.withColumn("ref", cartography.shield(F.lit(None).cast("string"), us, va))
    return rows.select("p_partkey", "ref", cartography.road_class(F.col("p_size") % 9, code, F.col("ref")).alias("class"), cartography.first_zoom(F.col("p_partkey") * 1000).alias("zoom"))


@query("""
WITH m AS (SELECT event_id, value AS v, greatest(20, least(90, (round_even(value / 5, 0) * 5)::INTEGER)) AS minutes FROM events)
SELECT event_id, minutes, round(minutes * 3.0 / 60, 4) AS miles, greatest(3, least(14, round_even(v / 10, 0)::INTEGER)) AS starts FROM m
""")
def minutes_and_miles(spark, sf_dir):
    """Values as minutes on the slider, as miles, and as a number of starts."""
    m = missions.clamped_minutes(F.col("value"))
    return load(spark, sf_dir, "events").select("event_id", m.alias("minutes"), F.round(missions.miles_of(m), 4).alias("miles"), missions.starts_wanted(F.col("value") / 10).alias("starts"))


@query("""
SELECT c_custkey, lower(trim(' ' || c_name || '+walk@Example.com ')) AS email, replace(lower(c_name), ' ', '') || '@example.com' AS box, true AS valid FROM customer
""")
def emails(spark, sf_dir):
    """Normal form and mailbox of addresses made from names."""
    raw = F.concat(F.lit(" "), F.col("c_name"), F.lit("+walk@Example.com "))
    return load(spark, sf_dir, "customer").select("c_custkey", identity.normal_email(raw).alias("email"), identity.mailbox(raw).alias("box"), identity.valid_email(raw).alias("valid"))


@query("""
WITH u AS (SELECT user_id, sum(value) / 100 AS total, sum(CASE WHEN event_type = 'error' THEN value END) / 100 AS avoid, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / 100 AS stress, count_if(event_type = 'error')::DOUBLE AS u, count(*)::DOUBLE AS t, count(DISTINCT event_type) / 5.0 AS loop FROM events GROUP BY 1)
SELECT user_id, round(greatest(0, 100 - (least(1, coalesce(avoid, 0) / greatest(total, 0.01)) * 45 + least(1, stress / greatest(total, 0.01)) * 25 + least(1, u / 4) * 15 + least(1, t / greatest(total * 8, 1)) * 15)) * (0.6 + 0.4 * loop), 1) AS quality FROM u
""")
def walk_quality(spark, sf_dir):
    """Readable quality of each user's walk."""
    v, kind = F.col("value"), F.col("event_type")
    u = load(spark, sf_dir, "events").groupBy("user_id").agg((F.sum(v) / 100).alias("total"), (F.coalesce(F.sum(F.when(kind == "error", v)), F.lit(0.0)) / 100).alias("avoid"), (F.sum(F.when(kind == "click", v).otherwise(0)) / 100).alias("stress"), F.count_if(kind == "error").alias("u"), F.count("*").alias("t"), (F.count_distinct("event_type") / 5.0).alias("loop"))
    return u.select("user_id", missions.walk_quality(F.col("total"), F.col("avoid"), F.lit(0.0), F.col("stress"), F.col("u"), F.col("t"), F.col("loop")).alias("quality"))
