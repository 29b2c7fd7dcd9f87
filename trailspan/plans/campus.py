"""Parts as ways beside each other: which carry the duty, what the others earn, and totals of both."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.operators import corridors
from trailspan.plans.registry import load, query
from trailspan.plans.stand_ins import SEG, segments
from trailspan.shared import stored

WAYS = """
w AS (
    SELECT p_partkey AS id, (p_partkey % 50) * 61.7 AS x0, floor(p_partkey / 50) * 30.4 + p_size % 7 AS y0, p_size * 4.31 + 20.07 AS s, p_size % 5 AS up, p_type, p_name,
        CASE WHEN p_size % 3 <> 0 THEN p_brand END AS corridor, CASE WHEN p_size % 4 = 1 THEN 'ALTERNATIVE' ELSE 'CANONICAL' END AS given FROM part),
way AS (SELECT *, x0 + s AS x1, y0 + up AS y1, sqrt(s * s + up * up) AS len, greatest(4, floor(sqrt(s * s + up * up) / 5))::BIGINT AS n FROM w),
sample AS (SELECT id, n, k, x0 + s * k / n AS px, y0 + up * k / n AS py FROM (SELECT *, unnest(range(n + 1)) AS k FROM way))"""
NEAR = """(p.py - o.y0 BETWEEN -50 AND 55 AND p.px BETWEEN o.x0 - 46 AND o.x1 + 46
    AND sqrt((p.px - o.x0 - o.s * greatest(0, least(1, ((p.px - o.x0) * o.s + (p.py - o.y0) * o.up) / (o.len * o.len)))) ** 2
        + (p.py - o.y0 - o.up * greatest(0, least(1, ((p.px - o.x0) * o.s + (p.py - o.y0) * o.up) / (o.len * o.len)))) ** 2) <= 45)"""
DUTIES = f"""{WAYS},
beside AS (SELECT p.id, count(DISTINCT p.k) / (any_value(p.n) + 1) AS share FROM sample p JOIN way me ON me.id = p.id AND me.corridor IS NULL JOIN way o ON o.corridor IS NOT NULL AND o.given = 'CANONICAL' AND {NEAR} GROUP BY p.id),
duty AS (SELECT way.*, CASE WHEN corridor IS NOT NULL THEN given WHEN coalesce(share, 0) >= 0.7 THEN 'ALTERNATIVE' ELSE 'CANONICAL' END AS obligation FROM way LEFT JOIN beside USING (id))"""
CREDITS = f"""{DUTIES},
met AS (SELECT o.id AS alternative, p.id AS canonical, count(*) / (any_value(p.n) + 1) AS share FROM sample p JOIN duty c ON c.id = p.id AND c.obligation = 'CANONICAL'
    JOIN duty o ON o.obligation = 'ALTERNATIVE' AND (o.corridor IS NULL OR o.corridor = c.corridor) AND {NEAR} GROUP BY o.id, p.id),
credit AS (SELECT alternative, canonical, round(share, 4) AS fraction FROM met WHERE share >= 0.05)"""


def _ways(spark, sf_dir):
    """(ways, duties): ways beside each other, where the duty of those with a corridor is given."""
    x, y, size, up = F.col("p_partkey") % 50 * 61.7, F.floor(F.col("p_partkey") / 50) * 30.4 + F.col("p_size") % 7, F.col("p_size") * 4.31 + 20.07, F.col("p_size") % 5
    line = F.array(geometry.point(x, y), geometry.point(x + size, y + up))
    ways = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("segment_id"), line.alias("line"), F.hypot(size, up.cast("double")).alias("length_m"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("corridor"),
        F.when(F.col("p_size") % 4 == 1, "ALTERNATIVE").otherwise("CANONICAL").alias("given"), F.col("p_type").alias("segment_type"), F.col("p_name").alias("surface"), F.col("p_brand").alias("display_name"),
    )
    named = ways.where("corridor IS NOT NULL")
    duties = named.select("segment_id", "corridor", F.col("given").alias("obligation"))
    unnamed = corridors.unnamed_duties(ways.where("corridor IS NULL"), named.where("given = 'CANONICAL'"))
    return ways, stored(duties.unionByName(unnamed), "duties")  # read more than once


@query(f"WITH {DUTIES} SELECT id AS segment_id, corridor, obligation FROM duty")
def unnamed_ways(spark, sf_dir):
    """Duties, of ways without a name by what they run beside."""
    return _ways(spark, sf_dir)[1]


@query(f"WITH {CREDITS} SELECT * FROM credit")
def campus_credits(spark, sf_dir):
    """What walking an alternative earns of each canonical way."""
    return corridors.credits(*_ways(spark, sf_dir))


@query(f"""WITH {CREDITS}, d AS (SELECT *, id IN (SELECT alternative FROM credit) AS earns, id IN (SELECT canonical FROM credit) AS served, obligation = 'ALTERNATIVE' AS alt, corridor IS NOT NULL AS named FROM duty)
SELECT count(DISTINCT corridor) AS corridors, count(*) AS segments, count_if(NOT alt) AS canonical_segments, count_if(alt) AS alternative_segments, count_if(alt AND earns) AS alternatives_with_credit,
    count_if(alt AND NOT earns) AS alternatives_without_credit, count_if(NOT alt AND served) AS canonical_with_an_alternative,
    round(coalesce(sum(len) FILTER (NOT alt), 0) / 1609.344, 3) AS canonical_miles, round(coalesce(sum(len) FILTER (alt), 0) / 1609.344, 3) AS duplicate_miles,
    round(coalesce(sum(len) FILTER (NOT alt AND named), 0) / 1609.344, 3) AS named_canonical_miles, round(coalesce(sum(len) FILTER (alt AND named), 0) / 1609.344, 3) AS named_duplicate_miles,
    round(coalesce(sum(len) FILTER (NOT alt AND NOT named), 0) / 1609.344, 3) AS unnamed_distinct_miles, round(coalesce(sum(len) FILTER (alt AND NOT named), 0) / 1609.344, 3) AS unnamed_duplicate_miles,
    round(coalesce(sum(len), 0) / 1609.344, 3) AS miles FROM d""")
def campus_totals(spark, sf_dir):
    """Both sides in numbers and miles."""
    ways, duties = _ways(spark, sf_dir)
    return corridors.campus_totals(ways, duties, corridors.credits(ways, duties))


@query(f"""WITH {WAYS} SELECT corridor, given AS obligation, count(*) AS segments, round(sum(len) / 1609.344, 4) AS miles, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS surfaces,
corridor AS names FROM way WHERE corridor IS NOT NULL GROUP BY corridor, given""")
def corridor_sides(spark, sf_dir):
    """Each side of each corridor with its kinds, surfaces and names."""
    ways, _ = _ways(spark, sf_dir)
    sides = corridors.corridor_sides(ways, ways.where("corridor IS NOT NULL").select("segment_id", "corridor", F.col("given").alias("obligation")))
    return sides.select("corridor", "obligation", "segments", "miles", *(F.concat_ws(",", c).alias(c) for c in ("types", "surfaces", "names")))


@query(f"""WITH {WAYS}, k AS (SELECT 'type' AS kind, p_type AS value, len FROM way UNION ALL SELECT 'owner', coalesce(corridor, '(blank)'), len FROM way UNION ALL SELECT 'name', p_name, len FROM way),
g AS (SELECT kind, value, count(*) AS features, round(sum(len) / 1609.344, 3) AS miles FROM k GROUP BY ALL)
SELECT kind, value, features, miles FROM g QUALIFY kind <> 'name' OR row_number() OVER (PARTITION BY kind ORDER BY miles DESC, value) <= 40""")
def campus_coverage(spark, sf_dir):
    """Ways by type, owner and the 40 longest names."""
    ways, _ = _ways(spark, sf_dir)
    return corridors.coverage_by(ways.select("length_m", "segment_type", F.col("corridor").alias("owner"), F.col("surface").alias("name")))


@query(f"""WITH {SEG}, r AS (SELECT * FROM seg WHERE role = 'REQUIRED'), n AS (SELECT number, segment_type AS name, round(sum(length_m), 6) AS m FROM r GROUP BY ALL),
t AS (SELECT number, string_agg(name, ',' ORDER BY m DESC, name) AS top_streets FROM n GROUP BY 1)
SELECT number, round(coalesce(sum(length_m) FILTER (campus_obligation = 'CANONICAL'), 0) / 1609.344, 3) AS campus_miles, round(coalesce(sum(length_m) FILTER (campus_obligation IS DISTINCT FROM 'CANONICAL'), 0) / 1609.344, 3) AS other_miles,
    sum(households)::BIGINT AS households, any_value(t.top_streets) AS top_streets FROM r JOIN t USING (number) GROUP BY number""")
def component_split(spark, sf_dir):
    """Required length of each component on the campus and off it, homes and longest streets."""
    split = corridors.component_split(segments(spark, sf_dir).withColumn("display_name", F.col("segment_type")), "number")
    return split.withColumn("top_streets", F.concat_ws(",", "top_streets"))
