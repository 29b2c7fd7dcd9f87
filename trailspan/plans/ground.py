"""A network in the plane whose nodes and segments are the rows of part: a lattice in the order of the keys, with places, lengths,
gaps and duties taken from each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.operators import cluster_search, graph, ledger, merging, nearest, network, routing_areas, sites, whatif
from trailspan.operators.membership import MILE
from trailspan.operators.missions import ROUTE_WEIGHTS
from trailspan.plans.registry import load, query
from trailspan.streaming import people

#: Nodes, and segments to the right and up, as SQL.
GROUND_SQL = """
node AS (SELECT p_partkey AS node, p_size, p_brand, (p_partkey % 50) * 200.0 + p_size - 25 AS x, floor(p_partkey / 50) * 200.0 + (p_size * 7) % 50 - 25 AS y FROM part),
edge AS (
    SELECT a.node * 2 + k AS seg, a.node AS u, b.node AS v, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) * (1 + (a.p_size % 4) / 10.0) AS length, a.p_size
    FROM node a, (VALUES (0, 1), (1, 50)) s(k, step) JOIN node b ON b.node = a.node + step
    WHERE CASE k WHEN 0 THEN a.node % 50 < 49 AND a.p_size % 7 <> 0 ELSE a.p_size % 5 <> 0 END)"""
#: Components by recursion: a node takes the smallest component of its neighbours until none is smaller.
COMPONENT_SQL = """
both AS (SELECT u, v FROM {edges} UNION ALL SELECT v, u FROM {edges}),
cc(node, component) USING KEY (node) AS (
    SELECT node, node FROM {nodes}
    UNION
    (SELECT e.v, min(c.component) FROM cc c JOIN bo e ON c.node = e.u JOIN recurring.cc r ON r.node = e.v WHERE c.component < r.component GROUP BY e.v))""".replace("both AS", "bo AS")


def ground(spark, sf_dir):
    """(nodes, segments): nodes (node, x, y), segments as cluster_search.with_facts takes them."""
    part = load(spark, sf_dir, "part")
    x, y = F.col("p_partkey") % 50 * 200.0 + F.col("p_size") - 25, F.floor(F.col("p_partkey") / 50) * 200.0 + F.col("p_size") * 7 % 50 - 25
    nodes = part.select(F.col("p_partkey").alias("node"), x.alias("x"), y.alias("y"), "p_size", "p_brand", "p_type")
    right = (F.col("node") % 50 < 49) & (F.col("p_size") % 7 != 0)
    ways = nodes.select("*", F.explode(F.array(F.struct(F.lit(0).alias("k"), right.alias("on"), (F.col("node") + 1).alias("v")), F.struct(F.lit(1).alias("k"), (F.col("p_size") % 5 != 0).alias("on"), (F.col("node") + 50).alias("v")))).alias("s")).where("s.on")
    ends = ways.join(nodes.select(F.col("node").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2")), F.col("s.v") == F.col("v"))
    size = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")) * (1 + F.col("p_size") % 4 / 10.0)
    segments = ends.select(
        (F.col("node") * 2 + F.col("s.k")).alias("segment_id"), F.col("node").alias("u"), "v", size.alias("length_m"), F.when(F.col("p_size") % 3 != 0, "REQUIRED").otherwise("OPTIONAL_CONNECTOR").alias("role"),
        F.col("p_size").alias("households"), F.col("p_brand").alias("display_name"), F.col("p_brand").alias("normalized_name"), F.lit(False).alias("dead_end"), (F.col("p_type") == "PROMO").alias("derived"),
        (F.col("p_size") % 5 + 1).alias("stress"), F.array(geometry.point(F.col("x"), F.col("y")), geometry.point(F.col("x2"), F.col("y2"))).alias("line"), "p_size",
    )
    return nodes.select("node", "x", "y"), segments


@query()
def cluster_walks(spark, sf_dir):
    """The best walk of 3.5 miles by the route's score from the part of the first supplier of each nation, over the best clusters."""
    nodes, segments = ground(spark, sf_dir)
    facts = cluster_search.with_facts(segments, segments.where("p_size > 35").select("segment_id"), nodes)
    starts = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg((F.min("s_suppkey") * 20).alias("start")).select("start", F.lit(3.5).alias("target"))
    best = cluster_search.best_of_clusters(cluster_search.cluster_routes(facts, starts))
    return best.groupBy("start", "target", "cluster", "seed").agg(F.round(F.first("score"), 3).alias("score"), F.round(F.first("length"), 3).alias("length"), F.count("*").alias("steps"), F.count_distinct("seg").alias("segments"))


@query(f"""
WITH {GROUND_SQL}, run AS (SELECT *, u - row_number() OVER (ORDER BY u) AS island FROM edge WHERE seg % 2 = 0)
SELECT min(seg) AS merged_id, count(*) AS pieces, false AS closed, round(sum(length / (1 + (p_size % 4) / 10.0)), 6) AS length FROM run GROUP BY island
""")
def merged_ways(spark, sf_dir):
    """Segments to the right, every third one drawn backwards, merged to the longest lines."""
    _, segments = ground(spark, sf_dir)
    lines = segments.where("segment_id % 2 = 0").select(F.col("segment_id").alias("line_id"), F.when(F.col("u") % 3 == 0, F.reverse("line")).otherwise(F.col("line")).alias("line"))
    return merging.merged_lines(lines).select("merged_id", "pieces", "closed", F.round(geometry.length(F.col("line")), 6).alias("length"))


@query(f"""
WITH RECURSIVE {GROUND_SQL}, {COMPONENT_SQL.format(edges="edge", nodes="node")}
SELECT component, count(*) AS nodes FROM cc GROUP BY component
""")
def ground_components(spark, sf_dir):
    """Components of the whole network, lone nodes too."""
    nodes, segments = ground(spark, sf_dir)
    edges = segments.select("u", "v").unionByName(nodes.select(F.col("node").alias("u"), F.col("node").alias("v")))
    return graph.connected_components(edges, "u", "v").groupBy("component").agg(F.count("*").alias("nodes"))


@query(f"""
WITH RECURSIVE {GROUND_SQL}, slim AS (SELECT * FROM edge WHERE p_size % 4 = 0), {COMPONENT_SQL.format(edges="slim", nodes="(SELECT u AS node FROM slim UNION SELECT v FROM slim)")},
area AS (SELECT component, round(sum(CASE WHEN p_size % 3 <> 0 THEN length ELSE 0 END) / {MILE}, 4) AS required_miles, round(sum(length) / {MILE} * 2, 3) AS max_walk_miles FROM slim JOIN cc ON node = u GROUP BY component),
may AS (SELECT node, component, x, y, required_miles, max_walk_miles FROM node JOIN cc USING (node) JOIN area USING (component) WHERE required_miles >= 0.25),
pt AS (SELECT c_custkey AS point_id, (c_custkey * 97) % 20000 - 5000 + 0.25 AS px, (c_custkey * 61) % 15000 - 3000 + 0.75 AS py FROM customer)
SELECT point_id, node, round(sqrt((px - x) ** 2 + (py - y) ** 2), 6) AS distance, component, required_miles, CASE WHEN required_miles < 1 THEN round(max_walk_miles, 2) END AS complete_miles
FROM pt, may QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY sqrt((px - x) ** 2 + (py - y) ** 2), node) = 1
""")
def snapped_starts(spark, sf_dir):
    """Every customer's nearest node of a valid area in a thinned network, near or far, and what completes a small area."""
    nodes, segments = ground(spark, sf_dir)
    slim = segments.where("p_size % 4 = 0").withColumn("access_type", F.lit("PUBLIC"))
    parts = graph.connected_components(slim, "u", "v")
    facts = routing_areas.facts(slim, parts)
    areas = parts.join(facts.select("component", (F.col("required_miles") >= routing_areas.AREA_MILES).alias("snap_allowed"), "required_miles", "max_walk_miles"), "component")
    key = F.col("c_custkey")
    points = load(spark, sf_dir, "customer").select(key.alias("point_id"), (key * 97 % 20000 - 5000 + 0.25).alias("x"), (key * 61 % 15000 - 3000 + 0.75).alias("y"))
    return nearest.snapped_starts(points, nodes, areas).withColumn("distance", F.round("distance", 6))


#: Base: supplier and part of a line of 50 pieces without discount; links: lines of 46 to 49 pieces; scenarios by the order's number.
LINK_SQL = """
base AS (SELECT l_suppkey AS u, 1000000 + l_partkey AS v FROM lineitem WHERE l_quantity = 50 AND l_discount = 0),
link AS (SELECT l_orderkey * 10 + l_linenumber AS link_id, l_orderkey, l_suppkey AS u, 1000000 + l_partkey AS v FROM lineitem WHERE l_quantity BETWEEN 46 AND 49),
sets AS (SELECT 'sure' AS scenario, link_id FROM link WHERE l_orderkey % 40 = 0 UNION ALL SELECT 'likely', link_id FROM link WHERE l_orderkey % 8 = 0 UNION ALL SELECT 'all', link_id FROM link)"""


def link_tables(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    ends = [F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1_000_000).alias("v")]
    base = lines.where("l_quantity = 50 AND l_discount = 0").select(*ends)
    links = lines.where("l_quantity BETWEEN 46 AND 49").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link_id"), "l_orderkey", *ends)
    some = lambda name, c: links.where(c).select(F.lit(name).alias("scenario"), "link_id")
    sets = some("sure", "l_orderkey % 40 = 0").unionByName(some("likely", "l_orderkey % 8 = 0")).unionByName(some("all", "true"))
    return graph.connected_components(base, "u", "v"), links, sets


@query(f"""
WITH RECURSIVE {LINK_SQL}, sce AS (SELECT unnest(['base', 'sure', 'likely', 'all']) AS scenario),
nodes AS (SELECT u AS node FROM base UNION SELECT v FROM base),
use AS (SELECT scenario, u, v FROM sce, base UNION ALL SELECT scenario, u, v FROM sets JOIN link USING (link_id) WHERE u IN (SELECT node FROM nodes) AND v IN (SELECT node FROM nodes)),
bo AS (SELECT scenario, u, v FROM use UNION ALL SELECT scenario, v, u FROM use),
cc(scenario, node, component) USING KEY (scenario, node) AS (
    SELECT scenario, node, node FROM sce, nodes
    UNION
    (SELECT e.scenario, e.v, min(c.component) FROM cc c JOIN bo e ON c.node = e.u AND c.scenario = e.scenario JOIN recurring.cc r ON r.node = e.v AND r.scenario = e.scenario WHERE c.component < r.component GROUP BY e.scenario, e.v)),
size AS (SELECT scenario, component, count(*) AS n FROM cc GROUP BY scenario, component),
joining AS (SELECT s.scenario, count(*) AS joining FROM (SELECT DISTINCT scenario, link_id FROM sets) s JOIN link USING (link_id) JOIN cc a ON a.scenario = 'base' AND a.node = u JOIN cc b ON b.scenario = 'base' AND b.node = v WHERE a.component <> b.component GROUP BY s.scenario)
SELECT scenario, count(*) AS components, max(n) AS largest, coalesce(any_value(joining), 0) AS joining, (SELECT count(*) FROM size WHERE scenario = 'base') - count(*) AS saved FROM size LEFT JOIN joining USING (scenario) GROUP BY scenario
""")
def link_scenarios(spark, sf_dir):
    """Three sets of links against the base network: components, the largest, and what each set saves."""
    return whatif.scenario_summary(*link_tables(spark, sf_dir))


@query()
def links_needed(spark, sf_dir):
    """Which components each link joins in each scenario, what lies beside it, and whether it is needed."""
    return whatif.joined_by(*link_tables(spark, sf_dir))


@query()
def budget_sweep(spark, sf_dir):
    """Two states of the town, two sets of weights and the five walks on offer, for the part of the first supplier of each nation."""
    nodes, segments = ground(spark, sf_dir)
    done = lambda c: segments.where(c).select("segment_id")
    facts = cluster_search.in_contexts(segments, {"early": done("p_size > 45"), "late": done("p_size > 15")}, nodes)
    starts = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg((F.min("s_suppkey") * 20).alias("start")).select("start")
    kinds = {"usual": ROUTE_WEIGHTS, "homes": {**ROUTE_WEIGHTS, "households": 2.0}}
    rows = cluster_search.sweep(facts, starts, [b for _, b in routing_areas.BANDS], kinds)
    return cluster_search.sweep_summary(rows)


@query(f"""
WITH {GROUND_SQL}, pt AS (SELECT c_custkey AS point_id, (c_custkey * 97) % 20000 - 5000 + 0.25 AS px, (c_custkey * 61) % 15000 - 3000 + 0.75 AS py FROM customer),
piece AS (SELECT e.seg, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM edge e JOIN node a ON a.node = u JOIN node b ON b.node = v WHERE e.p_size % 6 = 1),
gap AS (SELECT point_id, seg, greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx ** 2 + dy ** 2))) AS t, px, py, ax, ay, dx, dy FROM pt, piece)
SELECT point_id, seg AS line_id, round(sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2), 6) AS distance FROM gap
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2), seg) = 1
""")
def nearest_ways(spark, sf_dir):
    """Every customer's nearest segment of a thin network, however far."""
    _, segments = ground(spark, sf_dir)
    key = F.col("c_custkey")
    points = load(spark, sf_dir, "customer").select(key.alias("point_id"), (key * 97 % 20000 - 5000 + 0.25).alias("x"), (key * 61 % 15000 - 3000 + 0.75).alias("y"))
    lines = segments.where("p_size % 6 = 1").select(F.col("segment_id").alias("line_id"), "line")
    return nearest.nearest_line(points, lines).withColumn("distance", F.round("distance", 6))


@query()
def site_profiles(spark, sf_dir):
    """Customers as homes on the ground of their nations' sites, against the network of parts."""
    _, segments = ground(spark, sf_dir)
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    homes = load(spark, sf_dir, "customer").select(key.alias("home_id"), F.concat(F.lit("site "), nation.cast("string")).alias("site"), (nation % 5 * 2000 + key * 53 % 700).cast("double").alias("x"), (F.floor(nation / 5) * 1500 + key * 71 % 600).cast("double").alias("y"))
    lines = segments.select(F.col("segment_id").alias("line_id"), "line", F.when(F.col("p_size") % 4 == 0, "TRAIL").otherwise("STREET").alias("segment_type"), "role", F.when(F.col("p_size") % 11 == 0, "PRIVATE").otherwise("PUBLIC").alias("access_type"), (F.col("p_size") % 6 < 4).alias("walkable"), "display_name")
    return sites.site_profiles(homes, lines, ["site 7"])


@query()
def stitched_ways(spark, sf_dir):
    """Segments shortened by what their parts say, so that gaps of metres are left, stitched again: links and pieces."""
    _, segments = ground(spark, sf_dir)
    cut = (F.col("p_size") % 9 + 1) * 3.0
    shorter = network.substring(F.col("line"), F.lit(0.0), geometry.length(F.col("line")) - cut)
    pieces = segments.select(F.col("segment_id").cast("string").alias("piece_id"), F.col("u"), F.when(F.col("p_size") % 3 == 0, F.col("segment_id") + 1_000_000_000).otherwise(F.col("v")).alias("v"), F.when(F.col("p_size") % 3 == 0, shorter).otherwise(F.col("line")).alias("line"))
    made, links = network.stitched_pieces(pieces, passes=3)
    return links.select("pass", "node", "to_node", "piece_id", "at", F.round("distance", 6).alias("distance"))


@query("""
SELECT l_orderkey * 10 + l_linenumber AS segment_id, bool_or(l_quantity > 40) AS done, bool_or(o_custkey <> 7 AND l_tax > 0.05) AS reserved,
    CASE WHEN bool_or(l_quantity > 40) THEN 0.0 WHEN bool_or(o_custkey <> 7 AND l_tax > 0.05) THEN 0.15 ELSE 1.0 END AS worth
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber
""")
def request_snapshot(spark, sf_dir):
    """The lines of all orders as customer 7 sees them: done, held by other customers, and what is left of their worth."""
    lines = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("segment_id"), "l_orderkey", "l_quantity", "l_tax")
    holds = lines.where("l_tax > 0.05").join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person")), "l_orderkey").select("segment_id", "person")
    return ledger.snapshot(lines, lines.where("l_quantity > 40"), holds, 7, 0.15)


@query()
def guarded_walks(spark, sf_dir):
    """Events as commands of their users, folded with guards: how many of each kind ended how."""
    e = load(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    turn = F.pmod(F.col("event_id"), F.lit(7))
    kind = F.when(turn < 2, "register").when(turn < 4, "preview").when(turn == 4, "start").when(turn == 5, "complete").otherwise("discard")
    token = F.concat(F.lit("t"), user)
    rows = e.select(F.concat(user, F.lit("@example.org")).alias("email"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(turn > 1, user).alias("walk"), token.alias("token"), F.when(turn < 2, token).alias("new_token"))
    return people.folded(rows).groupBy("kind", "outcome", "reason").agg(F.count("*").alias("n"))
