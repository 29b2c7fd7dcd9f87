"""Reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspan.operators import ledger, reports
from trailspan.plans.registry import load, query
from trailspan.plans.stand_ins import SEG, segments
from trailspan.plans.walks import LEDGER, _ledger

_PARTS = {
    "required": "role = 'REQUIRED'", "required_street": "role = 'REQUIRED' AND segment_type = 'STREET'", "required_trail": "role = 'REQUIRED' AND segment_type = 'TRAIL'",
    "connector": "role = 'OPTIONAL_CONNECTOR'", "excluded": "role = 'EXCLUDED'", "main": "role = 'REQUIRED' AND number < 6",
}

#: Lines that one task sorts and counts together.
TASK_ROWS = 500_000


@query(f"WITH {SEG} SELECT count(*) AS segments, count_if(dataset = 'DERIVED') AS derived_segments, " + ", ".join(f"count_if({c}) AS {k}_segments, round(coalesce(sum(length_m) FILTER ({c}), 0) / 1609.344, 3) AS {k}_miles" for k, c in _PARTS.items()) + ", round(sum(length_m) FILTER (role = 'REQUIRED' AND number < 6) / sum(length_m) FILTER (role = 'REQUIRED'), 4) AS main_share FROM seg")
def freeze_metrics(spark, sf_dir):
    """A candidate in numbers."""
    return reports.freeze_metrics(segments(spark, sf_dir).withColumn("in_main", F.col("number") < 6))


@query(f"""WITH {LEDGER}, f AS (SELECT DISTINCT walk, segment_id FROM fin), a AS (SELECT walk, array_to_string(list(segment_id ORDER BY segment_id), ',') AS added FROM f WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.walk = f.walk AND p.segment_id = f.segment_id) GROUP BY 1),
r AS (SELECT walk, array_to_string(list(segment_id ORDER BY segment_id), ',') AS removed FROM plan WHERE walk IN (SELECT walk FROM wal) AND NOT EXISTS (SELECT 1 FROM f WHERE f.walk = plan.walk AND f.segment_id = plan.segment_id) GROUP BY 1)
SELECT coalesce(a.walk, r.walk) AS walk, coalesce(added, '') AS added, coalesce(removed, '') AS removed FROM a FULL JOIN r ON a.walk = r.walk""")
def edit_lists(spark, sf_dir):
    """Added and removed segments of each walk."""
    head, planned, _, _, _, final = _ledger(spark, sf_dir)
    e = reports.edit_lists(ledger.edits(final, planned, head))
    return e.select("walk", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("""SELECT 'done' AS question, count_if(l_quantity > 40) AS yes, count_if(NOT l_quantity > 40) AS no, 0::BIGINT AS unanswered FROM lineitem
UNION ALL SELECT 'liked', count_if(l_returnflag = 'R'), count_if(l_returnflag = 'A'), count_if(l_returnflag = 'N') FROM lineitem""")
def answer_tally(spark, sf_dir):
    """Answers yes, no and none."""
    liked = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    return reports.tally(load(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 40).alias("done"), liked.alias("liked")), ["done", "liked"])


@query("SELECT o_orderpriority AS state, count(*) AS served FROM orders GROUP BY 1")
def served_states(spark, sf_dir):
    """States of all answers nested in requests."""
    nested = load(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderkey") % 64).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("state"))).alias("variants"))
    return reports.served_states(nested)


@query("SELECT l_orderkey AS walk, count(DISTINCT l_partkey) AS segments, min(l_shipdate) AS expires_at FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def holds_by_walk(spark, sf_dir):
    """Holds of each walk."""
    live = load(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("walk"), F.col("l_partkey").alias("segment_id"), F.col("l_shipdate").alias("expires_at"))
    return reports.holds_by_walk(live)


@query("SELECT p_brand, count(*) AS n, round(avg(p_size), 3) AS p_size, NULL::DOUBLE AS p_type FROM part GROUP BY 1")
def group_means(spark, sf_dir):
    """Means of each brand; words have none."""
    return reports.means(load(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_type"])


@query("""WITH d AS (SELECT DISTINCT o_orderstatus, floor(o_totalprice / 100)::BIGINT AS ms FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM d)
SELECT o_orderstatus, max(n) AS n, max(ms) FILTER (i = n // 2) AS median, max(ms) FILTER (i = floor(0.9 * (n - 1))) AS p90, max(ms) AS most FROM r GROUP BY 1""")
def timing_summary(spark, sf_dir):
    """Median and 90th percentile of distinct timings."""
    return reports.timing_summary(load(spark, sf_dir, "orders").withColumn("ms", F.floor(F.col("o_totalprice") / 100)), ["o_orderstatus"], "ms")


@query(f"""WITH {SEG}, l AS (SELECT segment_id AS link, display_name, label, u % 700 AS ca, v % 700 AS cb, round(length_m, 2) AS recovered, coalesce(contains(display_name, 'street 1') OR contains(display_name, 'street 7'), false) OR coalesce(contains(label, 'street 1') OR contains(label, 'street 7'), false) AS t FROM seg WHERE dataset = 'DERIVED')
SELECT t AS touches, t AND ca <> cb AS bridges, count(*) AS n FROM l WHERE t GROUP BY ALL""")
def crossing_review(spark, sf_dir):
    """Links at marked places, and those that join them to another component."""
    links = segments(spark, sf_dir).where("dataset = 'DERIVED'").select(F.col("segment_id").alias("link"), F.col("display_name").alias("a_name"), F.col("label").alias("b_name"), (F.col("u") % 700).alias("a_component"), (F.col("v") % 700).alias("b_component"), F.round("length_m", 2).alias("recovered"))
    return reports.crossings(links, ["Street 1", "STREET 7"]).groupBy("touches", "bridges").agg(F.count("*").alias("n"))


@query(f"WITH {SEG} SELECT road_class, role, count(*) AS n FROM seg WHERE access_type NOT IN ('PRIVATE', 'GATED') AND (coalesce(road_class IN ('Arterial', 'Collector'), false) OR coalesce(role, '') = 'OPTIONAL_CONNECTOR') GROUP BY ALL")
def context_roads(spark, sf_dir):
    """Roads shown around the network."""
    return reports.context_roads(segments(spark, sf_dir), ["Arterial", "Collector"]).groupBy("road_class", "role").agg(F.count("*").alias("n"))


@query("SELECT 'roads' AS source, count(*) AS n, count(p_name) AS named FROM part UNION ALL SELECT 'paths', count(*), 0 FROM supplier")
def source_union(spark, sf_dir):
    """Rows of two sources in one table."""
    both = reports.tagged_union({"roads": load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "paths": load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))}, ["id", "name"])
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("name").alias("named"))


@query(f"""WITH {SEG}, k AS (SELECT segment_id, min(length_m) AS length_m, min(role) AS role FROM seg GROUP BY 1), s AS (SELECT route % 400 AS route, segment_id FROM seg)
SELECT route, count(*) AS steps, count(DISTINCT segment_id) AS segments, round(sum(length_m) / 1609.344, 3) AS miles, count(DISTINCT segment_id) FILTER (coalesce(role, '') = 'REQUIRED') AS required, count(DISTINCT segment_id) FILTER (coalesce(role, '') <> 'REQUIRED') AS connectors FROM s JOIN k USING (segment_id) GROUP BY 1""")
def route_summaries(spark, sf_dir):
    """Length and segments of each route."""
    seg = segments(spark, sf_dir)
    # dealt by their number: the memory of a task is that of TASK_ROWS lines, however many there are
    tasks = seg.count() // TASK_ROWS + 1
    k = seg.select("segment_id", "length_m", "role").repartition(tasks, "segment_id").groupBy("segment_id").agg(F.min("length_m").alias("length_m"), F.min("role").alias("role"))
    return reports.route_summary(seg.select((F.col("route") % 400).alias("route"), "segment_id").repartition(tasks, "segment_id"), k)


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49) SELECT p_type AS kind, count(*) AS paths, count(l_partkey) AS absorbed, count_if(l_partkey IS NULL) AS kept FROM part LEFT JOIN a ON p_partkey = l_partkey GROUP BY 1""")
def absorption(spark, sf_dir):
    """Paths taken in by streets, by kind."""
    taken = load(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return reports.absorption(load(spark, sf_dir, "part").withColumn("kind", F.col("p_type")), taken, "p_partkey")
