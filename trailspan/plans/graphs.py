"""Networks over the driver's tables: the lines of each order, and suppliers and parts joined by all lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspan.operators import graph
from trailspan.plans.registry import load, query

EDGES = "e AS (SELECT l_orderkey * 10 + l_linenumber AS u, l_orderkey * 10 + (l_linenumber * 3 + l_partkey) % 8 AS v, l_quantity::BIGINT AS w FROM lineitem)"
WAYS = "g AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, seen) AS (SELECT u, u FROM g UNION SELECT r.node, g.v FROM r JOIN g ON g.u = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)"


def _edges(spark, sf_dir):
    """(src, dst, w, strict) of every line: the lines of an order make a small network of their own, with loops, parallel edges
    of unlike weight and parts that hang together or not."""
    lines = load(spark, sf_dir, "lineitem")
    at = lambda k: (F.col("l_orderkey") * 10 + k).alias
    return lines.select(at(F.col("l_linenumber"))("src"), at((F.col("l_linenumber") * 3 + F.col("l_partkey")) % 8)("dst"), F.col("l_quantity").cast("long").alias("w"), (F.col("l_discount") < 0.05).alias("strict"))


@query(f"WITH RECURSIVE {EDGES}, {WAYS} SELECT node, component FROM c")
def components(spark, sf_dir):
    """Connected components of the network."""
    return graph.connected_components(_edges(spark, sf_dir))


@query(f"""
WITH RECURSIVE {EDGES}, {WAYS}, n AS (SELECT component, count(*) AS nodes FROM c GROUP BY 1), p AS (SELECT component, count(*) AS edges, sum(w)::BIGINT AS weight FROM e JOIN c ON e.u = c.node GROUP BY 1)
SELECT component, edges, weight, nodes, edges - nodes + 1 AS cycles, edges >= nodes AS has_cycle FROM p JOIN n USING (component)
""")
def component_profile(spark, sf_dir):
    """Nodes, edges, cycles and weight of each component."""
    edges = _edges(spark, sf_dir)
    return graph.component_profile(edges, "src", "dst", "w", graph.connected_components(edges))


@query(f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e WHERE u <> v) GROUP BY 1")
def degree(spark, sf_dir):
    """Edges at each node."""
    return graph.degrees(_edges(spark, sf_dir), "src", "dst")


WALKS = """k AS (SELECT u, v, min(w) AS w FROM (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e) GROUP BY 1, 2),
b(source, node, distance, seen) AS (SELECT component, component, 0::BIGINT, [component] FROM c GROUP BY 1 UNION ALL SELECT b.source, k.v, b.distance + {w}, list_append(b.seen, k.v) FROM b JOIN k ON k.u = b.node WHERE NOT list_contains(b.seen, k.v))
SELECT source, node, min(distance)::BIGINT AS distance FROM b GROUP BY 1, 2"""


def _lowest(edges):
    return graph.connected_components(edges).select(F.col("component").alias("node")).distinct()


@query(f"WITH RECURSIVE {EDGES}, {WAYS}, " + WALKS.format(w="1"))
def bfs_levels(spark, sf_dir):
    """Hops from the smallest node of every component at once."""
    edges = _edges(spark, sf_dir).withColumn("hop", F.lit(1).cast("long"))
    return graph.shortest_distances(edges, "src", "dst", "hop", _lowest(edges))


@query(f"WITH RECURSIVE {EDGES}, {WAYS}, " + WALKS.format(w="k.w"))
def weighted_sssp(spark, sf_dir):
    """Shortest distances by weight from the smallest node of every component at once."""
    edges = _edges(spark, sf_dir)
    return graph.shortest_distances(edges, "src", "dst", "w", _lowest(edges))


@query(f"""
WITH RECURSIVE {EDGES}, {WAYS}, e2 AS (SELECT l_orderkey * 10 + l_linenumber AS u, l_orderkey * 10 + (l_linenumber * 3 + l_partkey) % 8 AS v FROM lineitem WHERE l_discount < 0.05),
g2 AS (SELECT u, v FROM e2 UNION SELECT v, u FROM e2), r2(node, seen) AS (SELECT u, u FROM g2 UNION SELECT r2.node, g2.v FROM r2 JOIN g2 ON g2.u = r2.seen), c2 AS (SELECT node, min(seen) AS component FROM r2 GROUP BY 1)
SELECT c.component, count(*) AS nodes, count(c2.node) AS nodes_before, count(DISTINCT c2.component) AS components_before FROM c LEFT JOIN c2 USING (node) GROUP BY 1
""")
def whatif_attribution(spark, sf_dir):
    """Components with all edges, and how many of those with the strict ones each unites."""
    edges = _edges(spark, sf_dir)
    strict = graph.connected_components(edges.where("strict")).select("node", F.col("component").alias("before"))
    return graph.connected_components(edges).join(strict, "node", "left").groupBy("component").agg(F.count("*").alias("nodes"), F.count("before").alias("nodes_before"), F.count_distinct("before").alias("components_before"))


# The queries above take all lines as many small networks, so that their recursive SQL ends. Those below take them as one
# large network of suppliers and parts with hot nodes; recursive SQL over it is too slow to be registered.


def _network(spark, sf_dir):
    """(src, dst, w, whole) of every line; the weight is its price in cents."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_suppkey").alias("src"), (1000000 + F.col("l_partkey")).alias("dst"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("w"), (F.col("l_quantity") == 50).alias("whole"))


def _sources(spark, sf_dir):
    """The smallest supplier of each nation that has a line."""
    used = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return load(spark, sf_dir, "supplier").join(used, "s_suppkey", "left_semi").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("node")).select("node")


@query()
def network_components(spark, sf_dir):
    """Connected components of the network of all lines."""
    return graph.connected_components(_network(spark, sf_dir))


@query()
def network_profile(spark, sf_dir):
    """Nodes, edges, cycles and weight of each component of the network of all lines."""
    edges = _network(spark, sf_dir)
    return graph.component_profile(edges, "src", "dst", "w", graph.connected_components(edges))


@query("SELECT node, count(*) AS degree FROM (SELECT l_suppkey AS node FROM lineitem UNION ALL SELECT 1000000 + l_partkey FROM lineitem) GROUP BY 1")
def network_degree(spark, sf_dir):
    """Edges at each node of the network of all lines."""
    return graph.degrees(_network(spark, sf_dir), "src", "dst")


@query()
def network_levels(spark, sf_dir):
    """Hops from one supplier of each nation in the network of all lines."""
    edges = _network(spark, sf_dir).withColumn("hop", F.lit(1).cast("long"))
    return graph.shortest_distances(edges, "src", "dst", "hop", _sources(spark, sf_dir))


@query()
def network_distances(spark, sf_dir):
    """Shortest distances by price from one supplier of each nation in the network of all lines."""
    return graph.shortest_distances(_network(spark, sf_dir), "src", "dst", "w", _sources(spark, sf_dir))


@query()
def network_whatif(spark, sf_dir):
    """Components with all lines, and how many of those with lines of full quantity each unites."""
    edges = _network(spark, sf_dir)
    loose = graph.connected_components(edges)
    strict = graph.connected_components(edges.where("whole")).select("node", F.col("component").alias("before"))
    return loose.join(strict, "node", "left").groupBy("component").agg(F.count("*").alias("nodes"), F.count("before").alias("nodes_before"), F.count_distinct("before").alias("components_before"))
