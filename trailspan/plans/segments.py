"""Membership, areas, layer rules and gates over lines seen as segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspan.operators import gates, layer_rules, membership, routing_areas
from trailspan.operators.graph import connected_components
from trailspan.plans.registry import load, query
from trailspan.plans.stand_ins import MEMBERS, SEG, members, segments

REASON = """CASE WHEN dataset = 'DERIVED' THEN concat('derived link: ', coalesce(connector_class, 'unclassified')) WHEN role = 'EXCLUDED' THEN 'excluded' WHEN NOT walkable THEN 'not walkable'
    WHEN role = 'REQUIRED' THEN 'required' WHEN role = 'OPTIONAL_CONNECTOR' THEN 'connector of a source' ELSE concat('role ', coalesce(role, 'none')) END"""
KEEP = "CASE WHEN dataset = 'DERIVED' THEN coalesce(connector_class = 'HIGH_CONFIDENCE', false) ELSE walkable AND coalesce(role IN ('REQUIRED', 'OPTIONAL_CONNECTOR'), false) END"
MI = "1609.344"


def _facts(*names):
    return [F.col(n) for n in names]


@query(f"WITH {SEG} SELECT {KEEP} AS keep, {REASON} AS reason, count(*) AS n FROM seg GROUP BY ALL")
def graph_membership(spark, sf_dir):
    """Which segments are in the network, and why or why not."""
    m = membership.membership(*_facts("dataset", "connector_class", "role", "walkable"))
    return segments(spark, sf_dir).groupBy(m["keep"].alias("keep"), m["reason"].alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {SEG} SELECT {REASON} AS reason, count(*) AS segments FROM seg WHERE NOT {KEEP} GROUP BY ALL")
def excluded_reasons(spark, sf_dir):
    """Segments outside the network by reason."""
    return membership.excluded_reasons(segments(spark, sf_dir))


@query(f"""WITH {SEG} SELECT dataset, role, count(*) AS n, round(sum(length_m) / {MI}, 3) AS miles FROM seg
WHERE CASE WHEN dataset = 'DERIVED' THEN segment_id IN (SELECT segment_id FROM seg WHERE connector_class IN ('HIGH_CONFIDENCE', 'CROSSING_REVIEW_REQUIRED')) ELSE walkable AND coalesce(role, '') <> 'EXCLUDED' END GROUP BY ALL""")
def whatif_members(spark, sf_dir):
    """The network if crossings to be reviewed were open."""
    seg = segments(spark, sf_dir)
    routable = seg.where("connector_class IN ('HIGH_CONFIDENCE', 'CROSSING_REVIEW_REQUIRED')").select("segment_id")
    return membership.what_if(seg, routable, "segment_id").groupBy("dataset", "role").agg(F.count("*").alias("n"), membership.miles(F.sum("length_m")).alias("miles"))


@query(f"""WITH {SEG} SELECT CASE WHEN dataset = 'DERIVED' THEN 'derived' WHEN role = 'EXCLUDED' THEN 'excluded' WHEN role = 'REQUIRED' AND segment_type = 'TRAIL' THEN 'required_trail' WHEN role = 'REQUIRED' THEN 'required_street' ELSE 'connector' END AS layer,
walkable AND coalesce(role, '') <> 'EXCLUDED' AND (dataset <> 'DERIVED' OR routable_by_default) AS frozen, coalesce(role IN ('REQUIRED', 'EXCLUDED') AND role_status IN ('NEEDS_REVIEW', 'PROVISIONAL'), false) AS affects, count(*) AS n FROM seg GROUP BY ALL""")
def map_layers(spark, sf_dir):
    """Map layer, membership when frozen, and whether a decision on it moves the coverage."""
    at = membership.layer(*_facts("dataset", "role", "segment_type")).alias("layer")
    frozen = membership.frozen(*_facts("dataset", "routable_by_default", "role", "walkable")).alias("frozen")
    affects = F.coalesce(membership.affects_coverage(*_facts("role", "role_status")), F.lit(False)).alias("affects")
    return segments(spark, sf_dir).groupBy(at, frozen, affects).agg(F.count("*").alias("n"))


_PART = {
    "required": "role = 'REQUIRED'", "required_street": "role = 'REQUIRED' AND segment_type = 'STREET' AND coalesce(campus_obligation, '') <> 'CANONICAL'", "required_trail": "role = 'REQUIRED' AND segment_type = 'TRAIL' AND coalesce(campus_obligation, '') <> 'CANONICAL'",
    "required_campus": "role = 'REQUIRED' AND campus_obligation = 'CANONICAL'", "connector": "role = 'OPTIONAL_CONNECTOR' AND dataset <> 'DERIVED'", "derived": "dataset = 'DERIVED'", "campus_alternative": "campus_obligation = 'ALTERNATIVE'",
}


@query(f"WITH {MEMBERS} SELECT count(*) AS segments, round(sum(length_m) / {MI}, 3) AS miles, sum(households)::BIGINT AS households, " + ", ".join(f"count_if({c}) AS {k}_segments, round(coalesce(sum(length_m) FILTER ({c}), 0.0) / {MI}, 3) AS {k}_miles" for k, c in _PART.items()) + " FROM mem")
def network_totals(spark, sf_dir):
    """Segments and miles of the network by kind."""
    return membership.network_stats(members(spark, sf_dir))


@query(f"""WITH {SEG}, r AS (SELECT sha256(concat_ws('|', CAST(segment_id AS VARCHAR), coalesce(role, ''), CAST(households AS VARCHAR))) AS h FROM seg),
s AS (SELECT count(*) AS n, """ + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 12 * k}, 12) AS BIGINT)) AS s{k}" for k in range(4)) + """ FROM r)
SELECT n, substr(sha256(concat_ws(':', CAST(n AS VARCHAR), CAST(s0 AS VARCHAR), CAST(s1 AS VARCHAR), CAST(s2 AS VARCHAR), CAST(s3 AS VARCHAR))), 1, 16) AS hash FROM s""")
def content_digest(spark, sf_dir):
    """A hash of the network's content that does not depend on the order of rows."""
    return membership.content_hash(segments(spark, sf_dir), ["segment_id", "role", "households"])


@query(f"""WITH {MEMBERS}, c AS (SELECT segment_id AS canonical FROM mem GROUP BY 1), a AS (SELECT segment_id AS alternative, segment_id - number + (number % 7) + 1 AS canonical, 0.4 AS fraction FROM mem WHERE campus_obligation = 'ALTERNATIVE')
SELECT found, count(*) AS n FROM (SELECT a.*, c.canonical IS NOT NULL AS found FROM a LEFT JOIN c USING (canonical)) GROUP BY 1""")
def credit_links(spark, sf_dir):
    """Credits of alternatives, and those that point out of the network."""
    mem = members(spark, sf_dir)
    credits = mem.where("campus_obligation = 'ALTERNATIVE'").select(F.col("segment_id").alias("alternative"), (F.col("segment_id") - F.col("number") + F.col("number") % 7 + 1).alias("canonical"), F.lit(0.4).alias("fraction"))
    return membership.resolved_credits(mem.dropDuplicates(["segment_id"]), credits).groupBy("found").agg(F.count("*").alias("n"))


FACTS = MEMBERS + f""", f AS (SELECT u AS component, 1 + count(DISTINCT v) AS nodes, count(*) AS segments, round(sum(length_m) / {MI}, 4) AS miles, round(coalesce(sum(length_m) FILTER (role = 'REQUIRED'), 0.0) / {MI}, 4) AS required_miles,
    coalesce(sum(households) FILTER (role = 'REQUIRED'), 0)::BIGINT AS households, count(*) >= 1 + count(DISTINCT v) AS has_cycle, count_if(coalesce(role, '') = 'REQUIRED' AND access_type IN ('PRIVATE', 'GATED')) > 0 AS restricted, round(sum(length_m) / {MI} * 2, 3) AS max_walk_miles FROM mem GROUP BY 1),
facts AS (SELECT *, component = (SELECT component FROM f ORDER BY nodes DESC, component LIMIT 1) AS main FROM f),
cl AS (SELECT *, CASE WHEN main THEN 'VALID_INDEPENDENT_ROUTING_AREA' WHEN required_miles <= 0.0005 THEN 'CONNECTOR_ONLY' WHEN restricted THEN 'INACCESSIBLE_OR_RESTRICTED' WHEN required_miles >= 0.25 THEN 'VALID_INDEPENDENT_ROUTING_AREA' ELSE 'DATA_ERROR_OR_REVIEW_REQUIRED' END AS class,
    main OR required_miles <= 0.0005 OR NOT restricted AS in_denominator, main OR (required_miles > 0.0005 AND NOT restricted AND required_miles >= 0.25) AS start_allowed FROM facts)"""


def _areas(spark, sf_dir):
    mem = members(spark, sf_dir)
    parts = connected_components(mem, "u", "v")
    facts = routing_areas.facts(mem, parts)
    c = routing_areas.area_class(*_facts("main", "required_miles", "has_cycle", "restricted"), F.lit(None).cast("double"), F.col("max_walk_miles"))
    return mem, parts, facts.withColumn("c", c).select(*facts.columns, "c.class", "c.in_denominator", "c.start_allowed", "c.reasons")


@query(f"WITH {FACTS} SELECT component, nodes, segments, miles, required_miles, households, has_cycle, restricted, max_walk_miles, main FROM facts")
def area_facts(spark, sf_dir):
    """Components of the network and what they hold."""
    mem = members(spark, sf_dir)
    return routing_areas.facts(mem, connected_components(mem, "u", "v"))


@query(f"WITH {FACTS} SELECT class, count(*) AS components, round(sum(required_miles), 4) AS required_miles, sum(households)::BIGINT AS households, round(sum(CASE WHEN in_denominator THEN required_miles ELSE 0 END), 4) AS in_denominator_miles FROM cl GROUP BY 1")
def area_summary(spark, sf_dir):
    """Classes of components."""
    return routing_areas.area_summary(_areas(spark, sf_dir)[2])


@query(f"""WITH {FACTS}, n AS (SELECT u AS component, coalesce(display_name, '(unnamed)') AS name, round(sum(length_m), 3) AS m FROM mem WHERE role = 'REQUIRED' GROUP BY ALL),
t AS (SELECT component, list(name ORDER BY m DESC, name)[1:5] AS names FROM n GROUP BY 1)
SELECT component, class, start_allowed, CASE WHEN main THEN 'Main network' WHEN names IS NULL THEN 'Connector-only fragment' WHEN len(names) > 1 THEN concat(names[1], ' area (', array_to_string(names[2:3], ', '), ')') ELSE names[1] END AS description,
concat_ws(',', CASE WHEN max_walk_miles >= 1 THEN 'Quick' END, CASE WHEN max_walk_miles >= 2 THEN 'Short' END, CASE WHEN max_walk_miles >= 3.5 THEN 'Medium' END, CASE WHEN max_walk_miles >= 5 THEN 'Long' END, CASE WHEN max_walk_miles >= 7.5 THEN 'Extended' END) AS bands
FROM cl LEFT JOIN t USING (component)""")
def area_descriptions(spark, sf_dir):
    """Class, name and walks on offer of each component."""
    mem, parts, areas = _areas(spark, sf_dir)
    out = areas.join(routing_areas.top_names(mem, parts), "component", "left")
    return out.select("component", "class", "start_allowed", routing_areas.described(F.col("main"), F.col("names")).alias("description"), F.array_join(routing_areas.bands_within(F.col("max_walk_miles")), ",").alias("bands"))


@query(f"""WITH {FACTS}, m AS (SELECT u, v FROM mem WHERE u = (SELECT component FROM cl WHERE main)), nodes AS (SELECT u AS n FROM m UNION SELECT v FROM m), r AS (SELECT length_m, n IS NOT NULL AS on_main FROM seg LEFT JOIN nodes ON u = n WHERE role = 'REQUIRED')
SELECT round(sum(length_m) / {MI}, 3) AS required_miles, round(sum(CASE WHEN on_main THEN length_m ELSE 0 END) / {MI}, 3) AS main_miles, round(sum(CASE WHEN on_main THEN length_m ELSE 0 END) / sum(length_m), 4) AS main_share, count_if(NOT on_main) AS stranded_segments, (SELECT count(*) FROM cl) AS components FROM r""")
def network_connectivity(spark, sf_dir):
    """How much of the required length the main component reaches."""
    _, parts, areas = _areas(spark, sf_dir)
    return routing_areas.connectivity(segments(spark, sf_dir), areas, parts)


@query("""WITH p AS (SELECT s_nationkey AS component, s_acctbal / 10 AS x, (s_suppkey % 50) * 4.0 AS y FROM supplier),
g AS (SELECT a.component, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS gap FROM p a JOIN p b ON a.component <> b.component GROUP BY 1)
SELECT component, round(gap, 6) AS gap, CASE WHEN component = 0 THEN 'main' WHEN gap <= 30 THEN 'untrusted link' ELSE 'missing link' END AS cause FROM g WHERE gap <= 150""")
def area_gaps(spark, sf_dir):
    """Distance from each component to the nearest other one, and its likely cause."""
    points = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("component"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_suppkey") % 50 * 4.0).alias("y"))
    gaps = routing_areas.separation(points)
    return gaps.select("component", F.round("gap", 6).alias("gap"), routing_areas.gap_cause(F.col("component") == 0, F.col("gap")).alias("cause"))


@query(f"""WITH {MEMBERS}, e AS (SELECT u AS node, display_name FROM mem UNION ALL SELECT v, display_name FROM mem WHERE v <> u), d AS (SELECT node, count(*) AS degree, count(DISTINCT display_name) AS streets FROM e GROUP BY 1)
SELECT degree, streets, count(*) AS nodes, round(degree * 2.0 + streets * 3.0 + CASE WHEN streets >= 2 THEN 4.0 ELSE 0.0 END, 3) AS score FROM d WHERE degree >= 2 GROUP BY ALL""")
def start_scores(spark, sf_dir):
    """Nodes by degree, names that meet and score as a place to start; dead ends are none."""
    from trailspan.operators.slates import start_score

    d = routing_areas.node_degrees(members(spark, sf_dir)).where("degree >= 2")
    return d.groupBy(F.col("degree"), F.size("streets").cast("long").alias("streets"), F.round(start_score(F.col("degree"), F.col("streets")), 3).alias("score")).agg(F.count("*").alias("nodes"))


@query(f"""WITH {MEMBERS}, m AS (SELECT DISTINCT segment_id, u, v, role, done FROM mem), k AS (SELECT segment_id, min(role) AS role, min(u) AS u, max(v) AS v, bool_or(done) AS done FROM m GROUP BY 1),
o AS (SELECT u, v, segment_id FROM k WHERE role = 'REQUIRED' AND NOT done), n AS (SELECT node, count(*) AS c FROM (SELECT u AS node FROM o UNION ALL SELECT v FROM o) GROUP BY 1),
s AS (SELECT k.segment_id, coalesce(a.c, 0) + coalesce(b.c, 0) - CASE WHEN o.segment_id IS NOT NULL THEN 2 ELSE 0 END AS neighbours FROM k LEFT JOIN n a ON k.u = a.node LEFT JOIN n b ON k.v = b.node LEFT JOIN o USING (segment_id))
SELECT neighbours, count(*) AS segments FROM s GROUP BY 1""")
def open_neighbours(spark, sf_dir):
    """Segments by how many open required ones share an end with them."""
    k = members(spark, sf_dir).groupBy("segment_id").agg(F.min("role").alias("role"), F.min("u").alias("u"), F.max("v").alias("v"), F.bool_or("done").alias("done"))
    return routing_areas.open_neighbours(k, k.where("done").select("segment_id")).groupBy("neighbours").agg(F.count("*").alias("segments"))


@query(f"""WITH {MEMBERS}, k AS (SELECT segment_id, min(normalized_name) AS nm, min(role) AS role, bool_or(done) AS done, min(route) % 50 AS route FROM mem GROUP BY 1),
t AS (SELECT nm, count(*) AS n, count_if(NOT done) AS op FROM k WHERE role = 'REQUIRED' AND nm IS NOT NULL GROUP BY 1), p AS (SELECT route, nm, count_if(role = 'REQUIRED' AND NOT done) AS new FROM k WHERE nm IS NOT NULL GROUP BY ALL)
SELECT route, count(*) AS touched, count_if(n IS NOT NULL AND new = op) AS completed FROM p LEFT JOIN t USING (nm) GROUP BY 1""")
def corridor_progress(spark, sf_dir):
    """Street names that each route touches and completes."""
    k = members(spark, sf_dir).groupBy("segment_id").agg(F.min("normalized_name").alias("normalized_name"), F.min("role").alias("role"), F.bool_or("done").alias("done"), (F.min("route") % 50).alias("route"))
    return routing_areas.corridor_progress(k, k.where("done").select("segment_id"), k.select("route", "segment_id"))


@query(f"""WITH {SEG}, r AS (SELECT CASE number WHEN 1 THEN 'Trail' WHEN 2 THEN 'Sidewalk' ELSE ' Other ' END AS kind, CASE speed % 4 WHEN 0 THEN 'VT' WHEN 1 THEN 'PRIV ' WHEN 2 THEN '' END AS owner, in_campus AS campus, CASE WHEN households % 5 = 0 THEN 'REQUIRED' END AS listed FROM seg)
SELECT CASE WHEN kind = 'Trail' THEN 'TRAIL' ELSE 'PEDESTRIAN_CONNECTOR' END AS segment_type, CASE trim(owner) WHEN 'VT' THEN 'PUBLIC' WHEN 'PRIV' THEN 'PRIVATE' ELSE 'UNKNOWN' END AS access,
CASE WHEN trim(owner) = 'PRIV' THEN 'EXCLUDED' WHEN kind = 'Trail' AND listed IS NOT NULL THEN listed ELSE 'OPTIONAL_CONNECTOR' END AS role, CASE WHEN coalesce(trim(owner), '') <> 'PRIV' AND kind = 'Trail' AND listed IS NOT NULL THEN 'CONFIRMED' ELSE 'NEEDS_REVIEW' END AS status,
CASE WHEN kind = 'Trail' THEN CASE WHEN listed IS NOT NULL THEN 'curated trail' WHEN campus THEN 'campus path to be selected' ELSE 'trail not on the list' END WHEN kind = 'Sidewalk' THEN CASE WHEN campus THEN 'campus walk without a street' ELSE 'walk without a street' END ELSE 'no rule for this kind' END AS reason, count(*) AS n FROM r GROUP BY ALL""")
def path_classes(spark, sf_dir):
    """Kind, access, role and first reason of paths."""
    r = segments(spark, sf_dir).select(
        F.when(F.col("number") == 1, "Trail").when(F.col("number") == 2, "Sidewalk").otherwise(" Other ").alias("kind"), F.when(F.col("speed") % 4 == 0, "VT").when(F.col("speed") % 4 == 1, "PRIV ").when(F.col("speed") % 4 == 2, "").alias("owner"),
        F.col("in_campus").alias("campus"), F.when(F.col("households") % 5 == 0, "REQUIRED").alias("listed"),
    )
    p = layer_rules.path(F.col("kind"), F.col("owner"), F.col("campus"), F.col("listed"), F.lit("CONFIRMED"), ["Trail"], ["Sidewalk"])
    return r.select(p.alias("p")).groupBy("p.segment_type", "p.access", "p.role", "p.status", F.element_at("p.reasons", 1).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT list_extract(['aspahlt', 'Concrete', ' brick ', 'MIX', 'review', '', 'Rubber', 'green lane'], (p_partkey % 8)::INT + 1) AS raw FROM part)
SELECT CASE lower(trim(raw)) WHEN '' THEN NULL WHEN 'review' THEN NULL WHEN 'aspahlt' THEN 'Asphalt' WHEN 'mix' THEN 'Mixed' WHEN 'concrete' THEN 'Concrete' WHEN 'brick' THEN 'Brick' WHEN 'green lane' THEN 'Green Lane' ELSE trim(raw) END AS value, raw = 'aspahlt' AS fixed, count(*) AS n FROM r GROUP BY ALL""")
def materials(spark, sf_dir):
    """Canonical words of surfaces."""
    raw = F.element_at(F.array(*map(F.lit, ["aspahlt", "Concrete", " brick ", "MIX", "review", "", "Rubber", "green lane"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    return load(spark, sf_dir, "part").select(layer_rules.material(raw).alias("m")).groupBy("m.value", "m.fixed").agg(F.count("*").alias("n"))


@query(f"""WITH {SEG}, p AS (SELECT DISTINCT segment_id FROM seg WHERE speed = 25), s AS (SELECT seg.*, p.segment_id IS NOT NULL AND segment_type = 'STREET' AND role = 'REQUIRED' AS doubt, speed <> 0 AS inside FROM seg LEFT JOIN p USING (segment_id))
SELECT CASE WHEN NOT inside THEN 'OUT_OF_AREA_CONNECTOR' ELSE segment_type END AS segment_type, CASE WHEN NOT inside THEN 'OPTIONAL_CONNECTOR' ELSE role END AS role, CASE WHEN doubt AND inside THEN 'NEEDS_REVIEW' WHEN NOT inside THEN 'AUTOMATIC' ELSE role_status END AS role_status,
CASE WHEN NOT inside THEN 1 ELSE 0 END + CASE WHEN doubt AND inside THEN 1 ELSE 0 END AS reasons, count(*) AS n FROM s GROUP BY ALL""")
def area_rules(spark, sf_dir):
    """Segments outside the area, and streets in private land."""
    seg = segments(spark, sf_dir).withColumn("review_reasons", F.array().cast("array<string>"))
    out = layer_rules.corroborated(layer_rules.outside(seg, F.col("speed") != 0), seg.where("speed = 25").select("segment_id"), "segment_id")
    return out.groupBy("segment_type", "role", "role_status", F.size("review_reasons").alias("reasons")).agg(F.count("*").alias("n"))


@query(f"""WITH {SEG}, o(normalized_name, new_role, new_access) AS (VALUES ('street 3', 'EXCLUDED', 'GATED'), ('street 5', 'REQUIRED', NULL))
SELECT CASE WHEN new_role IS NOT NULL THEN role END AS from_role, coalesce(new_role, role) AS role, CASE WHEN new_role IS NOT NULL THEN coalesce(new_access, access_type) ELSE access_type END AS access_type, CASE WHEN new_role IS NOT NULL THEN new_role <> 'EXCLUDED' ELSE walkable END AS walkable, count(*) AS n FROM seg LEFT JOIN o USING (normalized_name) GROUP BY ALL""")
def role_overrides(spark, sf_dir):
    """People's decisions by name, with the role before."""
    rules = spark.createDataFrame([("street 3", "EXCLUDED", "GATED", "closed"), ("street 5", "REQUIRED", None, "public")], "normalized_name string, new_role string, new_access string, why string")
    seg = segments(spark, sf_dir).withColumn("review_reasons", F.array().cast("array<string>"))
    return layer_rules.overridden(seg, rules).groupBy("from_role", "role", "access_type", "walkable").agg(F.count("*").alias("n"))


LINK = f"""l AS (SELECT *, CASE WHEN segment_id % 5 = 0 THEN 1 ELSE 0 END AS crossed, segment_id % 35 = 0 AS limited, coalesce(starts_with(lower(trim(coalesce(display_name, ''))), 'street 1') AND coalesce(display_name, '') <> '', false) AS named, (segment_id % 3)::INT AS streets, (segment_id % 2)::INT AS peds, households::DOUBLE AS len FROM seg),
k AS (SELECT *, CASE WHEN road_class = 'Ramp' OR limited OR (role = 'EXCLUDED' AND NOT named AND streets > 0) THEN 'LIKELY_FALSE' WHEN (streets = 0 AND peds > 0) OR (named AND crossed = 0) OR (len <= 10 AND crossed = 0 AND coalesce(road_class, '') NOT IN ('Arterial', 'Collector') AND speed <= 25) THEN 'HIGH_CONFIDENCE'
    WHEN crossed > 0 OR road_class IN ('Arterial', 'Collector') OR speed >= 35 OR len > 15 THEN 'CROSSING_REVIEW_REQUIRED' ELSE 'UNRESOLVED' END AS class FROM l)"""


def _links(spark, sf_dir):
    return segments(spark, sf_dir).withColumns({
        "crossed": F.when(F.col("segment_id") % 5 == 0, 1).otherwise(0), "limited": F.col("segment_id") % 35 == 0, "named": layer_rules.same_start(F.col("display_name"), F.lit("street 1")) & F.startswith("display_name", F.lit("street 1")),
        "streets": F.col("segment_id") % 3, "peds": F.col("segment_id") % 2, "len": F.col("households").cast("double"),
    })


@query(f"WITH {SEG}, {LINK} SELECT class, count(*) AS n, round(sum(length_m) / {MI}, 3) AS miles FROM k GROUP BY 1")
def link_classes(spark, sf_dir):
    """Trust in derived links."""
    links = _links(spark, sf_dir)
    named = F.coalesce(F.col("named"), F.lit(False))
    c = layer_rules.link_class(*_facts("road_class", "role", "speed", "crossed", "limited"), named, *_facts("streets", "peds", "len"))
    return links.groupBy(c.alias("class")).agg(F.count("*").alias("n"), membership.miles(F.sum("length_m")).alias("miles"))


@query(f"""WITH {SEG}, c AS (SELECT segment_id, max(CASE WHEN segment_id % 4 = 0 THEN 'HIGH_CONFIDENCE' ELSE 'UNRESOLVED' END) AS connector_class FROM seg WHERE dataset = 'DERIVED' GROUP BY 1)
SELECT c.connector_class, coalesce(c.connector_class, 'HIGH_CONFIDENCE') = 'HIGH_CONFIDENCE' AS routable_by_default, walkable AND coalesce(c.connector_class, 'HIGH_CONFIDENCE') = 'HIGH_CONFIDENCE' AS walkable, count(*) AS n FROM seg LEFT JOIN c USING (segment_id) GROUP BY ALL""")
def link_write_back(spark, sf_dir):
    """Classes written back onto the segments."""
    seg = segments(spark, sf_dir)
    classes = seg.where("dataset = 'DERIVED'").select("segment_id", F.when(F.col("segment_id") % 4 == 0, "HIGH_CONFIDENCE").otherwise("UNRESOLVED").alias("connector_class")).distinct()
    return layer_rules.with_link_classes(seg, classes, "segment_id").groupBy("connector_class", "routable_by_default", "walkable").agg(F.count("*").alias("n"))


@query(f"""WITH {SEG}, p AS (SELECT *, in_campus AND dataset <> 'DERIVED' AND coalesce(campus_obligation, '') = 'CANONICAL' AND coalesce(role, '') <> 'EXCLUDED' AND walkable AS up FROM seg)
SELECT CASE WHEN up THEN role END AS from_role, CASE WHEN up THEN 'REQUIRED' ELSE role END AS role, CASE WHEN up THEN 'CONFIRMED' ELSE role_status END AS role_status, count(*) AS n FROM p GROUP BY ALL""")
def campus_promotion(spark, sf_dir):
    """Canonical campus segments become required."""
    return layer_rules.promoted(segments(spark, sf_dir)).groupBy("from_role", "role", "role_status").agg(F.count("*").alias("n"))


@query(f"""WITH {SEG}, w AS (SELECT role_status, CASE WHEN role_status = 'NEEDS_REVIEW' THEN concat('reason::reason ', CAST(number AS VARCHAR)) END AS r FROM seg WHERE role_status IN ('NEEDS_REVIEW', 'PROVISIONAL'))
SELECT queue, count(*) AS n FROM (SELECT role_status AS queue FROM w UNION ALL SELECT r FROM w WHERE r IS NOT NULL) GROUP BY 1""")
def review_queue(spark, sf_dir):
    """What waits for review."""
    why = F.when(F.col("role_status") == "NEEDS_REVIEW", F.array(F.concat(F.lit("reason "), F.col("number").cast("string")))).otherwise(F.array().cast("array<string>"))
    return layer_rules.review_queue(segments(spark, sf_dir).withColumn("review_reasons", why))


@query("""WITH h AS (SELECT o_custkey AS home, o_orderkey % 200 AS main FROM orders) SELECT s_suppkey AS segment_id, count(DISTINCT home) AS estimated_households FROM supplier LEFT JOIN h ON s_suppkey = main GROUP BY 1""")
def homes_per_segment(spark, sf_dir):
    """Distinct homes of each segment."""
    links = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("home"), (F.col("o_orderkey") % 200).alias("main"))
    return layer_rules.homes_per_segment(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("segment_id")), links)


@query(f"""WITH {SEG}, f AS (SELECT normalized_name, bool_or(done) AS d, bool_or(in_campus) AS c FROM seg WHERE segment_type <> 'STREET' AND length_m > 900 GROUP BY 1), s AS (SELECT DISTINCT normalized_name FROM seg WHERE segment_type = 'STREET')
SELECT s.normalized_name, coalesce(d, false) AS has_done, coalesce(c, false) AS has_in_campus FROM s LEFT JOIN f ON s.normalized_name = f.normalized_name""")
def street_flags(spark, sf_dir):
    """What paths of the same name say of a street."""
    seg = segments(spark, sf_dir)
    return layer_rules.street_rollup(seg.where("segment_type <> 'STREET' AND length_m > 900"), seg.where("segment_type = 'STREET'").select("normalized_name").distinct(), "normalized_name", ["done", "in_campus"])


SITES = """s AS (SELECT s_nationkey, count(*) AS units, count_if(s_acctbal < 1000) AS beyond, (s_nationkey * 7 % 60)::DOUBLE AS network_m, s_nationkey * 3000.0 AS area_m2, s_nationkey % 6 = 0 AS named FROM supplier GROUP BY 1),
d AS (SELECT *, network_m < 25 OR beyond / units > 0.25 AS auto, beyond / units > 0.35 OR (network_m < 25 AND beyond / units > 0.10 AND area_m2 / 4046.86 > 6.0) AS hold_all, beyond / units > 0.10 AS part_of FROM s),
t AS (SELECT *, CASE WHEN hold_all THEN 'ALL' WHEN part_of THEN 'BEYOND_CAP_ONLY' ELSE 'NONE' END AS hold, CASE WHEN auto OR named THEN 'UNRESOLVED' ELSE 'OK' END AS first_status, CASE WHEN named AND auto THEN 'INSTRUCTION_AND_AUTOMATIC' WHEN named THEN 'INSTRUCTION_ONLY' WHEN auto THEN 'AUTOMATIC' END AS trigger,
    CASE WHEN units >= 100 THEN 'ADD_AUTHORITATIVE_PEDESTRIAN_NETWORK' WHEN area_m2 > 20000 THEN 'ASSOCIATE_WITH_FRONTAGE_STREETS' ELSE 'TREAT_AS_UNRESOLVED' END AS advice FROM d)"""


def _sites(spark, sf_dir):
    from trailspan.operators.places import site_disposition

    s = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("units"), F.count_if(F.col("s_acctbal") < 1000).alias("beyond"))
    s = s.withColumn("network_m", (F.col("s_nationkey") * 7 % 60).cast("double")).withColumn("area_m2", F.col("s_nationkey") * 3000.0).withColumn("named", F.col("s_nationkey") % 6 == 0)
    first, then = layer_rules.site_status(*_facts("units", "beyond", "network_m", "named")), site_disposition(*_facts("units", "beyond", "network_m", "area_m2"))
    return s.withColumn("first_status", first["status"]).withColumn("trigger", first["trigger"]).withColumn("hold", then["hold"]).withColumn("advice", layer_rules.site_advice(*_facts("units", "area_m2")))


@query(f"WITH {SITES} SELECT s_nationkey, hold, first_status, trigger, advice FROM t")
def site_rules(spark, sf_dir):
    """Sites by the first and the second rule, with what set the first off."""
    return _sites(spark, sf_dir).select("s_nationkey", "hold", "first_status", "trigger", "advice")


@query(f"WITH {SITES} SELECT count(*) AS profiled, count_if(hold = 'ALL') AS held, count_if(hold = 'BEYOND_CAP_ONLY') AS held_in_part, count_if(hold = 'NONE') AS accepted, coalesce(sum(units) FILTER (hold = 'ALL'), 0)::BIGINT AS units_held, count_if((first_status = 'UNRESOLVED') <> (hold = 'ALL')) AS changed FROM t")
def site_rollup(spark, sf_dir):
    """Sites held, held in part and accepted."""
    return layer_rules.site_rollup(_sites(spark, sf_dir))


@query(f"""WITH {SEG}, {LINK}, r AS (SELECT *, number % 2 = 0 AS opposed, number % 3 = 0 AS junction, segment_id % 7 = 0 AS forms, in_campus AS focus FROM k)
SELECT CASE WHEN road_class = 'Ramp' THEN 'REJECT' WHEN opposed OR junction OR forms THEN 'REVIEW_ON_SITE' ELSE 'DO_NOT_PROMOTE_WITHOUT_EVIDENCE' END AS recommendation,
CASE WHEN road_class = 'Ramp' THEN 'HIGH' WHEN (opposed AND (junction OR forms)) OR ((junction OR forms) AND len <= 15 AND CASE WHEN speed = 0 THEN 99 ELSE speed END <= 30) THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
CASE WHEN segment_type = 'STREET' THEN true ELSE in_campus AND coalesce(regexp_matches(lower(display_name), ' (dr|drive|st|street|ave|avenue|rd|road|ln|lane)'), false) END AS street_like,
count(*) AS n, round(sum(length_m / {MI} * 100 + CASE WHEN focus THEN 2 ELSE 0 END + least(households * 100, 2000) / 200 + CASE WHEN opposed THEN 3 ELSE 0 END + CASE WHEN junction THEN 2 ELSE 0 END + CASE WHEN forms THEN 3 ELSE 0 END) / count(*), 1) AS priority FROM r GROUP BY ALL""")
def link_reviews(spark, sf_dir):
    """What to do about links, how sure that is, and their mean priority."""
    links = _links(spark, sf_dir).withColumns({"opposed": F.col("number") % 2 == 0, "junction": F.col("number") % 3 == 0, "forms": F.col("segment_id") % 7 == 0})
    r = layer_rules.link_review(F.col("length_m") / membership.MILE, F.col("in_campus"), F.col("households") * 100, *_facts("opposed", "junction", "forms", "road_class", "len", "speed"))
    like = layer_rules.street_like(*_facts("segment_type", "in_campus", "display_name"))
    return links.select(r.alias("r"), like.alias("street_like")).groupBy("r.recommendation", "r.confidence", "street_like").agg(F.count("*").alias("n"), F.round(F.sum("r.priority") / F.count("*"), 1).alias("priority"))


@query("""WITH p AS (SELECT p_brand, count_if(p_size > 45) AS features, round(sum(CASE WHEN p_size > 45 THEN p_size * 3.0 ELSE 0 END), 3) AS m FROM part GROUP BY 1)
SELECT p_brand, CASE WHEN features = 0 THEN 'ABSENT' WHEN m < 100 THEN 'STUB_ONLY' ELSE 'PRESENT' END AS verdict, CASE WHEN features = 0 THEN 'NO_REPRESENTATION' WHEN m / 1609.344 >= 0.05 THEN 'REPRESENTED' ELSE 'THIN' END AS representation FROM p""")
def street_probes(spark, sf_dir):
    """How well each name is represented."""
    big = F.col("p_size") > 45
    p = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(big).alias("features"), F.round(F.sum(F.when(big, F.col("p_size") * 3.0).otherwise(0.0)), 3).alias("m"))
    return p.select("p_brand", layer_rules.probe_verdict(F.col("features"), F.col("m")).alias("verdict"), layer_rules.representation(F.col("m") / membership.MILE, F.col("features") > 0).alias("representation"))


@query(f"""WITH {SEG}, a AS (SELECT count_if(length_m <= 0.05) = 0 AS p0, count(DISTINCT segment_id) = count(*) AS p1 FROM seg), h AS (SELECT count(*) AS n, count(DISTINCT c_name) AS k FROM customer), l AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS k FROM orders)
SELECT unnest([{{'name': 'no_zero_length_segments', 'passed': p0, 'fatal': true}}, {{'name': 'segment_ids_unique', 'passed': p1, 'fatal': true}}, {{'name': 'home_keys_unique', 'passed': h.n = h.k, 'fatal': true}}, {{'name': 'one_main_segment_per_home', 'passed': l.n = l.k, 'fatal': true}},
{{'name': 'homes_plausible', 'passed': h.n BETWEEN 12000 AND 24000, 'fatal': false}}, {{'name': 'association_rate', 'passed': 1 - l.n / h.n <= 0.20, 'fatal': false}}], recursive := true) FROM a, h, l""")
def build_gates(spark, sf_dir):
    """Gates of a build."""
    homes = load(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))
    return gates.build_gates(segments(spark, sf_dir), homes, load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")))


@query(f"""WITH {SEG}, g AS (SELECT count_if(dataset = 'DERIVED' AND coalesce(connector_class, '') <> 'HIGH_CONFIDENCE' AND (routable_by_default OR walkable)) = 0 AS p0, count_if(in_campus AND dataset <> 'DERIVED' AND campus_obligation IS NULL) = 0 AS p1,
sum(CASE WHEN role = 'REQUIRED' AND number < 7 THEN length_m ELSE 0 END) / sum(length_m) FILTER (role = 'REQUIRED') >= 0.8 AS p2, count_if(role = 'REQUIRED' AND campus_obligation = 'ALTERNATIVE') = 0 AS p3, count_if(role = 'REQUIRED' AND NOT (coalesce(campus_obligation, '') = 'CANONICAL' OR segment_type IN ('STREET', 'TRAIL'))) = 0 AS p4 FROM seg)
SELECT unnest([{{'name': 'no_unresolved_connector_routed_by_default', 'passed': p0, 'fatal': true}}, {{'name': 'campus_duplicate_obligations_removed', 'passed': p1, 'fatal': true}}, {{'name': 'required_mileage_reachable', 'passed': p2, 'fatal': false}},
{{'name': 'alternatives_not_required', 'passed': p3, 'fatal': true}}, {{'name': 'required_mileage_partitions', 'passed': p4, 'fatal': true}}], recursive := true) FROM g""")
def candidate_gates(spark, sf_dir):
    """Gates of a candidate and of an integration over its segments."""
    seg = segments(spark, sf_dir).withColumn("in_main", F.col("number") < 7)
    areas = load(spark, sf_dir, "nation").select(F.lit("VALID_INDEPENDENT_ROUTING_AREA").alias("class"), F.lit(1.0).alias("required_miles"), F.lit(False).alias("restricted"))
    return gates.candidate_gates(seg, 0.8).unionByName(gates.integration_gates(seg, areas).where("name IN ('alternatives_not_required', 'required_mileage_partitions')"))
