"""Gates that rest on evidence, and summaries of walks, benchmarks and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspan.functions import shapes
from trailspan.operators import coverage, gates, places, reports, validation
from trailspan.operators.membership import resolved_credits
from trailspan.plans.ground import GROUND_SQL, ground
from trailspan.plans.registry import load, query
from trailspan.plans.stand_ins import MEMBERS, SEG, members, segments

MI = "1609.344"


def _routes(spark, sf_dir):
    """Orders as routes of a benchmark."""
    state = F.when(F.col("o_orderstatus") == "F", "ROUTE_AVAILABLE").when(F.col("o_orderstatus") == "O", "LIMITED_LOCAL_COVERAGE").otherwise("LONGER_ROUTE_REQUIRED")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("location"), (F.col("o_custkey") % 7).alias("households"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_totalprice") / 100000).alias("distance_miles"),
        state.alias("state"), (F.col("o_totalprice") / 4000).alias("single_ms"), "o_orderdate",
    )


@query(f"""WITH {MEMBERS}, ab AS (SELECT 'avoidable_repeat_miles' AS m, sum(l_discount) AS b, 0.8 * sum(l_discount) AS a FROM lineitem UNION ALL SELECT 'new_required_miles', sum(l_quantity), 0.97 * sum(l_quantity) FROM lineitem),
alt AS (SELECT segment_id, CASE WHEN segment_id % 2 = 0 THEN segment_id ELSE -1 END AS canonical FROM mem WHERE campus_obligation = 'ALTERNATIVE'),
g AS (
    SELECT 'repeat_traversal_improved_without_coverage_loss' AS name, bool_and(CASE m WHEN 'new_required_miles' THEN 100 * (a - b) / b >= -5 ELSE 100 * (a - b) / b <= -10 END) AS passed, true AS fatal FROM ab
    UNION ALL SELECT 'override_applied', (SELECT count(*) > 0 FROM seg WHERE role = 'EXCLUDED' AND normalized_name = 'street 7') AND count_if(normalized_name = 'street 7') = 0, true FROM mem
    UNION ALL SELECT 'location_explained', max(o_custkey % 7) FILTER (o_orderpriority = '1-URGENT' AND o_custkey % 5 > 0) > 0, true FROM orders
    UNION ALL SELECT 'late_opportunity_states_defined', true, true
    UNION ALL SELECT 'performance_interactive', quantile_cont(o_totalprice / 4000, 0.5) < 100, false FROM orders
    UNION ALL SELECT 'campus_promoted_without_duplicate_obligation', (SELECT sum(length_m) / {MI} > 10 FROM mem WHERE role = 'REQUIRED' AND campus_obligation = 'CANONICAL') AND (SELECT count(*) = 0 FROM mem WHERE role = 'REQUIRED' AND campus_obligation = 'ALTERNATIVE')
        AND count_if(canonical NOT IN (SELECT segment_id FROM mem)) = 0, true FROM alt
    UNION ALL SELECT 'crossings_catalogued_not_promoted', count(*) > 0 AND count_if(segment_id IN (SELECT segment_id FROM mem)) = 0, true FROM seg WHERE connector_class = 'CROSSING_REVIEW_REQUIRED' AND in_campus
    UNION ALL SELECT 'off_main_required_mileage_attributed', coalesce(sum(length_m) FILTER (role = 'REQUIRED' AND number >= 7), 0) / {MI} <= 2, false FROM mem)
SELECT name, coalesce(passed, false) AS passed, fatal FROM g""")
def evidence_gates(spark, sf_dir):
    """The gates of an integration that rest on comparisons, overrides, benchmarks, credits and crossings."""
    seg, mem, lines = segments(spark, sf_dir), members(spark, sf_dir), load(spark, sf_dir, "lineitem")
    sums = lines.agg(F.sum("l_discount").alias("d"), F.sum("l_quantity").alias("q"))
    both = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("before"), (F.col(c) * k).alias("after")) for m, c, k in (("avoidable_repeat_miles", "d", 0.8), ("new_required_miles", "q", 0.97))))
    compared = sums.select(F.explode(both).alias("r")).select("r.*")
    given = mem.where("campus_obligation = 'ALTERNATIVE'").select(F.col("segment_id").alias("alternative"), F.when(F.col("segment_id") % 2 == 0, F.col("segment_id")).otherwise(-1).alias("canonical"), F.lit(1.0).alias("fraction"))
    crossings = seg.where("connector_class = 'CROSSING_REVIEW_REQUIRED'").select("segment_id", F.col("in_campus").alias("touches"))
    areas = load(spark, sf_dir, "region").select(F.concat(F.lit("Park "), F.col("r_name")).alias("description"), F.lit("VALID_INDEPENDENT_ROUTING_AREA").alias("class"))
    parts = [
        gates.comparison_gates(compared), gates.override_gates(seg.where("role = 'EXCLUDED' AND normalized_name = 'street 7'"), mem, "street 7"), gates.benchmark_gates(_routes(spark, sf_dir), "1-URGENT"),
        gates.promotion_gates(mem, resolved_credits(mem, given)), gates.crossing_gates(crossings, mem, areas, "Park"), gates.stranded_gates(mem.withColumn("in_main", F.col("number") < 7)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
WITH r AS (SELECT o_orderdate >= TIMESTAMP '1998-01-01' AS late, o_totalprice / 100000 AS d, o_custkey % 7 AS h FROM orders WHERE o_custkey % 5 > 0),
m AS (SELECT late, count(*) AS n, round(sum(d::DECIMAL(28,6))::DOUBLE / count(*), 3) AS d, round(sum(h)::DOUBLE / count(*), 3) AS h FROM r GROUP BY 1)
SELECT 'distance_miles' AS metric, b.d AS before, a.d AS after, b.n AS routes_before, a.n AS routes_after FROM m b, m a WHERE NOT b.late AND a.late
UNION ALL SELECT 'households', b.h, a.h, b.n, a.n FROM m b, m a WHERE NOT b.late AND a.late
""")
def benchmark_means(spark, sf_dir):
    """Means of a benchmark before and after."""
    routes, cut = _routes(spark, sf_dir), F.lit("1998-01-01").cast("timestamp")
    return validation.means_compared(routes.where(F.col("o_orderdate") < cut), routes.where(F.col("o_orderdate") >= cut), ["distance_miles", "households"])


@query("""SELECT l_orderkey AS walk, coalesce(sum(p_size), 0)::BIGINT AS households FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey GROUP BY 1""")
def walk_homes(spark, sf_dir):
    """Homes of each walk; segments of few homes are unknown."""
    planned = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("walk"), F.col("l_partkey").alias("segment_id"))
    return validation.walk_homes(planned, load(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("segment_id"), F.col("p_size").cast("long").alias("households")))


@query(f"""WITH {SEG}, k AS (SELECT length_m, CASE WHEN dataset = 'DERIVED' THEN 'derived' WHEN role = 'EXCLUDED' THEN 'excluded' WHEN role = 'REQUIRED' AND segment_type = 'TRAIL' THEN 'required_trail' WHEN role = 'REQUIRED' THEN 'required_street' ELSE 'connector' END AS layer FROM seg
UNION ALL SELECT length_m, 'review' FROM seg WHERE role IN ('REQUIRED', 'EXCLUDED') AND role_status IN ('NEEDS_REVIEW', 'PROVISIONAL'))
SELECT layer, count(*) AS segments, round(sum(length_m) / {MI}, 3) AS miles FROM k GROUP BY 1""")
def layer_stats(spark, sf_dir):
    """Segments and miles of each map layer and of what is to be reviewed."""
    return validation.layer_stats(segments(spark, sf_dir))


@query("""
WITH b AS (SELECT o_custkey AS l, o_orderpriority AS band, count_if(o_totalprice > 150000) > 0 AS a, max(o_totalprice) > 300000 AS c FROM orders GROUP BY ALL),
p AS (SELECT c_custkey AS l, c_nationkey AS component, c_acctbal AS snap, c_custkey % 3 = 0 AS campus, c_acctbal > 5000 AS reach FROM customer),
s AS (SELECT l, count_if(a) AS o, count_if(a AND c) AS k FROM b GROUP BY 1)
SELECT count(*) AS locations, count_if(component = 0) AS landed_in_main, count(DISTINCT component) AS components, max(snap) AS max_snap_m, count_if(coalesce(o, 0) = 0) AS without_route, count_if(coalesce(o, 0) = 5) AS with_all,
    round(coalesce(sum(k), 0) / greatest(coalesce(sum(o), 0), 1), 3) AS coherent_loop_rate, count_if(campus AND reach) AS campus_reaching_both FROM p LEFT JOIN s USING (l)
""")
def walks_validated(spark, sf_dir):
    """Customers as starts, their priorities as bands."""
    bands = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("location"), F.col("o_orderpriority").alias("band")).agg((F.count_if(F.col("o_totalprice") > 150000) > 0).alias("available"), (F.max("o_totalprice") > 300000).alias("coherent"))
    starts = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("location"), F.col("c_nationkey").alias("component"), F.col("c_acctbal").alias("snap_m"), (F.col("c_custkey") % 3 == 0).alias("campus"), (F.col("c_acctbal") > 5000).alias("reaches_both"))
    return validation.validated(starts, bands)


@query(f"""WITH {GROUND_SQL}, d AS (SELECT node FROM (SELECT u AS node FROM edge UNION ALL SELECT v FROM edge) GROUP BY 1 HAVING count(*) = 1)
SELECT seg AS segment_id FROM edge WHERE p_size % 3 <> 0 AND u NOT IN (SELECT node FROM d) AND v NOT IN (SELECT node FROM d)""")
def dead_ends_left(spark, sf_dir):
    """What is done when only dead ends are left."""
    return validation.only_dead_ends_left(ground(spark, sf_dir)[1])


@query("""
WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS main, abs(c_acctbal) / 100 AS d, c_custkey % 3 = 0 AS same FROM customer),
k AS (SELECT unnest([CASE WHEN main IS NULL THEN 'unassociated' ELSE 'associated' END,
    CASE WHEN main IS NOT NULL THEN CASE WHEN same AND d <= 40 THEN 'confidence_high' WHEN same OR d <= 25 THEN 'confidence_medium' ELSE 'confidence_low' END END,
    CASE WHEN main IS NOT NULL THEN CASE main % 3 WHEN 0 THEN 'role_required' WHEN 1 THEN 'role_excluded' ELSE 'role_none' END END]) AS stat FROM l)
SELECT stat, count(*) AS n FROM k WHERE stat IS NOT NULL GROUP BY 1
""")
def association_confidence(spark, sf_dir):
    """How far attachments of customers to nations can be trusted."""
    links = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("home_id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).alias("main"), (F.abs("c_acctbal") / 100).alias("distance"), (F.col("c_custkey") % 3 == 0).alias("same_name"))
    lines = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line_id"), F.when(F.col("n_nationkey") % 3 == 0, "REQUIRED").when(F.col("n_nationkey") % 3 == 1, "EXCLUDED").alias("role"))
    return places.association_stats(links, lines)


@query("""SELECT o_orderkey AS walk, o_custkey AS person, true AS found FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1, false FROM orders""")
def owned_walks(spark, sf_dir):
    """Each walk asked for by its owner and by another."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("walk"), F.col("o_custkey").alias("person"))
    return gates.owned(rows, rows.unionByName(rows.withColumn("person", F.col("person") + 1)), "walk", "person")


@query("""
WITH s AS (SELECT l_orderkey AS route, l_linenumber AS pos, max(l_discount) >= 0.05 AS c FROM lineitem GROUP BY ALL), e AS (SELECT route, c AND NOT coalesce(lag(c) OVER (PARTITION BY route ORDER BY pos), false) AS up FROM s)
SELECT route, count_if(up) AS runs FROM e GROUP BY 1
""")
def connector_runs(spark, sf_dir):
    """How often each order's lines begin to be connectors."""
    steps = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("pos")).agg(F.max("l_discount").alias("d"))
    return coverage.rising_runs(steps, "route", "pos", F.col("d") >= 0.05)


@query("""
WITH p AS (SELECT c_nationkey, c_acctbal / 100000 AS lon, (c_custkey % 997) / 10000.0 + 37 AS lat, c_mktsegment = 'BUILDING' AND c_acctbal > 9000 AS done FROM customer),
b AS (SELECT c_nationkey, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n, min(lon) FILTER (done) AS cw, min(lat) FILTER (done) AS cs, max(lon) FILTER (done) AS ce, max(lat) FILTER (done) AS cn FROM p GROUP BY 1),
x AS (SELECT *, greatest(cn - cs, 1e-9) AS tall, greatest(ce - cw, 1e-9) AS wide, greatest(0.010 - 2.5 * greatest(cn - cs, 1e-9), 0) / 2 AS extra FROM b),
f AS (SELECT *, greatest(cw - 0.75 * wide - extra / cos(radians(cn)), w) AS fw, least(ce + 0.75 * wide + extra / cos(radians(cn)), e) AS fe, greatest(cs - 0.75 * tall - extra, s) AS fs, least(cn + 0.75 * tall + extra, n) AS fn FROM x)
SELECT c_nationkey, round(CASE WHEN fe > fw AND fn > fs AND cw IS NOT NULL THEN fw ELSE w END, 7) AS west, round(CASE WHEN fe > fw AND fn > fs AND cw IS NOT NULL THEN fs ELSE s END, 7) AS south,
    round(CASE WHEN fe > fw AND fn > fs AND cw IS NOT NULL THEN fe ELSE e END, 7) AS east, round(CASE WHEN fe > fw AND fn > fs AND cw IS NOT NULL THEN fn ELSE n END, 7) AS north FROM f
""")
def progress_frames(spark, sf_dir):
    """The box to show of each nation's customers, of whom some are covered."""
    lat = (F.col("c_custkey") % 997) / 10000.0 + 37
    points = load(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_acctbal") / 100000).alias("lon"), lat.alias("lat"), ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000)).alias("done"))
    whole = shapes.bounds(points, ["c_nationkey"], "lon", "lat", "whole")
    covered = shapes.bounds(points.where("done"), ["c_nationkey"], "lon", "lat", "covered")
    box = whole.join(covered, "c_nationkey", "left").select("c_nationkey", shapes.progress_frame(F.col("covered"), F.col("whole")).alias("f"))
    return box.select("c_nationkey", *(F.round(f"f.{c}", 7).alias(c) for c in ("west", "south", "east", "north")))


@query("""
WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS segment_id, l_suppkey AS u, l_partkey AS v, nullif(l_suppkey % 5, 4) AS a, l_partkey % 5 AS b, l_quantity AS ma, l_tax * 100 AS mb, l_returnflag AS f, l_linestatus AS s FROM lineitem),
t AS (SELECT *, coalesce(a <> b, false) AS bridges, u IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000) OR v IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000) AS touches FROM k)
SELECT segment_id, bridges, touches, round(CASE WHEN bridges THEN least(ma, mb) ELSE 0 END, 3) AS smaller_miles,
    concat_ws(';', CASE WHEN f = 'R' THEN 'Crosses a roadway' END, CASE WHEN s = 'O' THEN '4 m gap' END) AS reasons FROM t WHERE bridges OR touches
""")
def crossings_to_review(spark, sf_dir):
    """Links between suppliers and parts that join components or touch a marked node."""
    reasons = F.filter(F.array(F.when(F.col("l_returnflag") == "R", "Crosses a roadway"), F.lit("short"), F.when(F.col("l_linestatus") == "O", "4 m gap")), lambda r: r.isNotNull())
    links = load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("segment_id"), F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.expr("nullif(l_suppkey % 5, 4)").alias("a"),
        (F.col("l_partkey") % 5).alias("b"), F.col("l_quantity").alias("miles_a"), (F.col("l_tax") * 100).alias("miles_b"), reasons.alias("reasons"),
    )
    marked = load(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("node"))
    found = reports.crossings_to_review(links, marked)
    return found.withColumn("reasons", F.concat_ws(";", "reasons"))
