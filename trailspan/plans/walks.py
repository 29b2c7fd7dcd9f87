"""Answers, missions and completions over orders seen as walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspan.functions import identity
from trailspan.operators import answers, gates, ledger, slates
from trailspan.plans.registry import load, query
from trailspan.plans.stand_ins import BANDS, MEMBERS, SEG, WALKS, bands, members, segments, walks

GOOD = "has_route AND new_miles >= 0.25"
STATES = BANDS + f""", nx AS (SELECT a.*, (SELECT min(b.target) FROM ban b WHERE b.request = a.request AND b.target > a.target AND b.has_route AND b.new_miles >= 0.25) AS any_, (SELECT min(b.target) FROM ban b WHERE b.request = a.request AND b.target > a.target AND b.has_route AND b.new_miles >= 0.25 AND b.efficiency >= 0.3) AS good_ FROM ban a),
st AS (SELECT *, CASE WHEN has_route THEN CASE WHEN {GOOD} AND efficiency >= 0.3 THEN 'ROUTE_AVAILABLE' WHEN good_ IS NULL AND coalesce(nearest_miles > 2.5, false) THEN 'SELECT_DIFFERENT_START_AREA' ELSE 'LIMITED_LOCAL_COVERAGE' END
    WHEN any_ IS NOT NULL THEN 'LONGER_ROUTE_REQUIRED' WHEN coalesce(nearest_miles > 2.5, false) THEN 'SELECT_DIFFERENT_START_AREA' ELSE 'NO_USEFUL_ROUTE_NEAR_START' END AS state FROM nx)"""


@query(f"WITH {STATES} SELECT request, band, state, CASE state WHEN 'LONGER_ROUTE_REQUIRED' THEN any_ WHEN 'LIMITED_LOCAL_COVERAGE' THEN good_ END AS suggested_target FROM st")
def band_states(spark, sf_dir):
    """What each request is told about each band, and the longer band that would do."""
    return answers.assessed(bands(spark, sf_dir)).select("request", "band", "state", "suggested_target")


@query(f"WITH {STATES} SELECT state, count(*) AS answers FROM st GROUP BY 1")
def band_state_counts(spark, sf_dir):
    """Answers by state."""
    return answers.state_counts(answers.assessed(bands(spark, sf_dir)))


@query(f"WITH {BANDS} SELECT request, arg_min(band, target) AS band, min(target) AS target FROM ban WHERE has_route GROUP BY 1")
def first_bands(spark, sf_dir):
    """The shortest band of each request that has a route."""
    return answers.first_bands(bands(spark, sf_dir))


@query(f"WITH {STATES} SELECT request, band, target, has_route AS available, state, CASE WHEN has_route THEN round(total_miles, 2) END AS total_miles, CASE WHEN has_route THEN round(efficiency, 3) END AS efficiency FROM st")
def band_payloads(spark, sf_dir):
    """What a client sees of each band."""
    return answers.band_payload(answers.assessed(bands(spark, sf_dir))).select("request", "band", "target", "available", "state", "total_miles", "efficiency")


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS request, l_linenumber AS target, l_partkey % 12 AS segment_id FROM lineitem), t AS (SELECT request, target, lag(target) OVER (PARTITION BY request ORDER BY target) AS before FROM (SELECT DISTINCT request, target FROM c))
SELECT t.request, t.target, t.before IS NULL OR NOT EXISTS (SELECT 1 FROM c a WHERE a.request = t.request AND a.target = t.before AND a.segment_id NOT IN (SELECT segment_id FROM c b WHERE b.request = t.request AND b.target = t.target)) AS nested FROM t""")
def band_nesting(spark, sf_dir):
    """Whether each band covers what the shorter one does."""
    return answers.nesting(load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("request"), F.col("l_linenumber").alias("target"), (F.col("l_partkey") % 12).alias("segment_id")))


@query("""SELECT CASE WHEN o_orderstatus <> 'P' AND o_totalprice / 300000 >= 0.55 AND (o_custkey % 10) / 20 <= 0.25 THEN 'coherent loop' WHEN o_orderstatus <> 'P' THEN 'returns to start but retraces heavily' ELSE 'does not close' END AS verdict, o_totalprice BETWEEN 50000 AND 200000 AND o_custkey BETWEEN 10 AND 90 AS inside, count(*) AS n FROM orders GROUP BY ALL""")
def loop_verdicts(spark, sf_dir):
    """Loops, and starts inside a box."""
    v = answers.loop_verdict(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 300000, (F.col("o_custkey") % 10) / 20)
    box = answers.within_box(F.col("o_totalprice"), F.col("o_custkey"), 50000, 10, 200000, 90)
    return load(spark, sf_dir, "orders").groupBy(v.alias("verdict"), box.alias("inside")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT list_extract(['uturns_per_mile', 'turns_per_mile', 'runs_per_street', 'avoidable_repeat_share', 'extra_traversals', 'cohesion', 'derived_connectors'], o_custkey % 7 + 1) AS statistic, round(avg(o_totalprice) / 100000, 3) AS mean, round(min(o_totalprice) / 100000, 3) AS median, round(count(*) / 100.0, 3) AS p90, round(max(o_totalprice) / 100000, 3) AS max FROM orders GROUP BY 1),
r AS (SELECT *, CASE statistic WHEN 'uturns_per_mile' THEN p90 > 1 WHEN 'turns_per_mile' THEN p90 > 14 WHEN 'runs_per_street' THEN mean > 1.6 WHEN 'avoidable_repeat_share' THEN p90 > 0.2 WHEN 'extra_traversals' THEN max > 2 WHEN 'cohesion' THEN median < 0.7 ELSE max > 0 END AS hit FROM s)
SELECT statistic, CASE WHEN NOT hit THEN 'INFO' WHEN statistic IN ('uturns_per_mile', 'turns_per_mile', 'avoidable_repeat_share') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM r WHERE hit OR statistic = 'avoidable_repeat_share'""")
def quality_findings(spark, sf_dir):
    """Statistics beyond their limits."""
    names = F.array(*map(F.lit, ["uturns_per_mile", "turns_per_mile", "runs_per_street", "avoidable_repeat_share", "extra_traversals", "cohesion", "derived_connectors"]))
    s = load(spark, sf_dir, "orders").groupBy(F.element_at(names, (F.col("o_custkey") % 7 + 1).cast("int")).alias("statistic")).agg(
        F.round(F.avg("o_totalprice") / 100000, 3).alias("mean"), F.round(F.min("o_totalprice") / 100000, 3).alias("median"), F.round(F.count("*") / 100.0, 3).alias("p90"), F.round(F.max("o_totalprice") / 100000, 3).alias("max"),
    )
    title = F.create_map(*(F.lit(x) for r in answers.FINDINGS for x in (r[4], r[0])))
    return answers.quality_findings(s).select(F.coalesce(F.element_at(title, F.col("finding")), F.lit("avoidable_repeat_share")).alias("statistic"), "severity")


@query(f"""WITH {MEMBERS}, k AS (SELECT u, v, length_m, households FROM mem WHERE role = 'REQUIRED' AND segment_id NOT IN (SELECT segment_id FROM seg WHERE done)), c AS (SELECT u AS cluster, round(sum(length_m) / 1609.344, 6) AS miles, sum(households)::BIGINT AS value, count(*) AS segments FROM k GROUP BY 1 HAVING miles >= 0.15)
SELECT cluster, miles, value, segments, round(least(miles, 3.5) / 3.5 * 100 + CASE WHEN miles <= 3.5 * 0.95 THEN 35 ELSE 0 END + least(value, 1500) * 0.05 + least(miles, 10) * 2, 6) AS score FROM c""")
def open_clusters(spark, sf_dir):
    """Clusters of open required segments and how well a walk of 3.5 miles suits them."""
    done = segments(spark, sf_dir).where("done").select("segment_id").distinct()
    c = slates.open_clusters(members(spark, sf_dir), done)
    return c.withColumn("score", F.round(slates.cluster_score(F.col("miles"), F.col("value"), 3.5), 6))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT o_orderkey, substr(sha256(concat('net-1', o_custkey::VARCHAR, '3.50', array_to_string(parts, ''))), 1, 16) AS mission FROM s""")
def mission_ids(spark, sf_dir):
    """Ids of missions from what they are."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("parts"))
    o = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", slates.mission_id(F.lit("net-1"), F.col("o_custkey"), F.lit(3.5), F.col("parts")).alias("mission"))


WORDS = SEG + """, cov AS (SELECT route % 300 AS mission, label, display_name, length_m, households FROM seg), l AS (SELECT mission, label, round(sum(length_m), 3) AS m FROM cov GROUP BY 1, 2), lt AS (SELECT mission, list({'m': -m, 'label': label} ORDER BY -m, label) FILTER (label IS NOT NULL) AS l, sum(m) AS total FROM l GROUP BY 1),
ar AS (SELECT mission, l[1].label AS dominant, coalesce(round(-l[1].m / total, 6), 0.0) AS share, l[2].label AS second FROM lt),
d AS (SELECT mission, display_name, round(sum(length_m), 3) AS m FROM cov WHERE display_name IS NOT NULL GROUP BY 1, 2), hs AS (SELECT mission, list(display_name ORDER BY m DESC, display_name)[1:3] AS streets FROM d GROUP BY 1), v AS (SELECT mission, sum(households)::BIGINT % 40 AS value FROM cov GROUP BY 1)"""


@query(f"""WITH {WORDS} SELECT mission, dominant, share, second, array_to_string(streets, ',') AS streets,
CASE WHEN mission % 4 = 0 AND dominant IS NOT NULL THEN concat('Finish what is left in ', dominant) WHEN mission % 4 = 0 AND streets IS NOT NULL THEN concat('Finish what is left around ', streets[1]) WHEN dominant IS NOT NULL AND (share >= 0.6 OR second IS NULL) THEN concat('Continue through ', dominant)
    WHEN dominant IS NOT NULL THEN concat('Walk through ', dominant, ' and ', second) WHEN streets IS NOT NULL THEN concat('Walk the streets around ', streets[1]) ELSE 'Walk through this area' END AS title,
CASE WHEN value >= 25 THEN concat('Approximately ', value::VARCHAR, ' households') WHEN value > 0 THEN concat('About ', value::VARCHAR, ' households') ELSE 'No homes on this route' END AS homes,
CASE WHEN len(streets) >= 2 THEN concat(streets[1], ' at ', streets[2]) ELSE coalesce(streets[1], 'the start of the route') END AS start FROM v LEFT JOIN ar USING (mission) LEFT JOIN hs USING (mission)""")
def mission_words(spark, sf_dir):
    """What is said about a mission: areas, streets, title, homes and start."""
    cov = segments(spark, sf_dir).select((F.col("route") % 300).alias("mission"), "label", "display_name", "length_m", "households")
    value = cov.groupBy("mission").agg((F.sum("households") % 40).alias("value"))
    m = value.join(slates.areas(cov), "mission", "left").join(slates.headline_streets(cov), "mission", "left")
    head = slates.title(F.col("mission") % 4 == 0, *map(F.col, ("dominant", "share", "second", "streets")))
    return m.select("mission", "dominant", "share", "second", F.array_join("streets", ",").alias("streets"), head.alias("title"), slates.homes_line(F.col("value")).alias("homes"), slates.start_line(F.col("streets")).alias("start"))


@query()
def start_spread(spark, sf_dir):
    """Up to four suppliers of each nation, best first, 250 m apart."""
    c = load(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("score"), (F.col("s_suppkey") % 13 * 0.001).alias("lon"), (F.col("s_suppkey") % 7 * 0.001).alias("lat"))
    return slates.spread(c, "s_nationkey", 4)


LEDGER = WALKS + f""", {SEG}, sg AS (SELECT segment_id, min(role) AS role, min(length_m) AS length_m, min(campus_obligation) AS campus_obligation, min(segment_type) AS segment_type FROM seg GROUP BY 1),
asked AS (SELECT walk, segment_id FROM plan WHERE walk IN (SELECT walk FROM wal WHERE outcome = 'AS_PLANNED') UNION SELECT walk, segment_id FROM chos WHERE walk IN (SELECT walk FROM wal WHERE outcome = 'EDITED')),
cr AS (SELECT segment_id AS alternative, segment_id // 10 * 10 + (segment_id % 7) + 1 AS canonical, 0.7 AS fraction FROM sg WHERE campus_obligation = 'ALTERNATIVE'),
own AS (SELECT walk, segment_id, false AS via FROM asked JOIN sg USING (segment_id) WHERE role = 'REQUIRED'),
ern AS (SELECT walk, canonical AS segment_id FROM asked JOIN cr ON segment_id = alternative GROUP BY 1, 2 HAVING sum(fraction) >= 0.6),
fin AS (SELECT * FROM own UNION ALL SELECT walk, segment_id, true FROM ern JOIN sg USING (segment_id) WHERE role = 'REQUIRED' AND (walk, segment_id) NOT IN (SELECT (walk, segment_id) FROM asked JOIN sg USING (segment_id)))"""


def _ledger(spark, sf_dir):
    head, planned, chosen, existing = walks(spark, sf_dir)
    sg = segments(spark, sf_dir).groupBy("segment_id").agg(*(F.min(c).alias(c) for c in ("role", "length_m", "campus_obligation", "segment_type")))
    credits = sg.where("campus_obligation = 'ALTERNATIVE'").select(F.col("segment_id").alias("alternative"), (F.floor(F.col("segment_id") / 10) * 10 + F.col("segment_id") % 7 + 1).alias("canonical"), F.lit(0.7).alias("fraction"))
    return head, planned, chosen, existing, sg, ledger.final_segments(head, planned, chosen, sg, credits)


@query(f"""WITH {LEDGER} SELECT CASE WHEN w.outcome = 'AS_PLANNED' THEN 'AS_PLANNED' WHEN p.walk IS NULL THEN 'MANUAL_ADDITION' ELSE 'EDITED' END AS source, via AS via_alternative, count(*) AS n FROM fin f JOIN wal w USING (walk) LEFT JOIN plan p ON p.walk = f.walk AND p.segment_id = f.segment_id
WHERE NOT EXISTS (SELECT 1 FROM comp c WHERE c.walk = f.walk AND c.segment_id = f.segment_id) GROUP BY ALL""")
def walk_completions(spark, sf_dir):
    """Completions that the walks add, by how they came about."""
    head, planned, _, existing, _, final = _ledger(spark, sf_dir)
    return ledger.new_completions(final, planned, head, existing).groupBy("source", "via_alternative").agg(F.count("*").alias("n"))


@query(f"""WITH {LEDGER}, f AS (SELECT DISTINCT walk, segment_id FROM fin), e AS (SELECT walk, segment_id, 'ADDED' AS kind FROM f WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.walk = f.walk AND p.segment_id = f.segment_id)
UNION ALL SELECT walk, segment_id, 'REMOVED' FROM plan WHERE walk IN (SELECT walk FROM wal) AND NOT EXISTS (SELECT 1 FROM f WHERE f.walk = plan.walk AND f.segment_id = plan.segment_id)) SELECT walk, kind, count(*) AS n FROM e GROUP BY ALL""")
def walk_edits(spark, sf_dir):
    """What was added to and removed from each plan."""
    head, planned, _, _, _, final = _ledger(spark, sf_dir)
    return ledger.edits(final, planned, head).groupBy("walk", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {LEDGER}, x AS (SELECT walk, length_m FROM fin JOIN sg USING (segment_id) WHERE NOT via UNION ALL SELECT walk, length_m FROM plan JOIN sg USING (segment_id) WHERE role <> 'REQUIRED'), s AS (SELECT walk, sum(length_m) AS m FROM x GROUP BY 1)
SELECT outcome, count(*) AS walks, round(sum(CASE outcome WHEN 'AS_PLANNED' THEN distance WHEN 'EDITED' THEN round(coalesce(m, 0) / 1609.344, 3) ELSE 0.0 END), 2) AS miles FROM wal LEFT JOIN s USING (walk) GROUP BY 1""")
def walk_distances(spark, sf_dir):
    """Miles walked by outcome."""
    head, planned, _, _, sg, final = _ledger(spark, sf_dir)
    return ledger.final_distance(head, final, planned, sg).join(head.select("walk", "outcome"), "walk").groupBy("outcome").agg(F.count("*").alias("walks"), F.round(F.sum("miles"), 2).alias("miles"))


@query(f"""WITH {WALKS}, q AS (SELECT segment_id FROM comp WHERE segment_id % 10 = 3 GROUP BY 1) SELECT 'reverse_completion' AS action, count(*) AS subjects, sum(n)::BIGINT AS rows, (SELECT count(*) FROM comp WHERE segment_id NOT IN (SELECT segment_id FROM q)) AS left_over FROM (SELECT segment_id, count(*) AS n FROM comp JOIN q USING (segment_id) GROUP BY 1)""")
def reversals(spark, sf_dir):
    """Completions taken back, with their audit."""
    _, _, _, existing = walks(spark, sf_dir)
    asked = existing.where("segment_id % 10 = 3").select("segment_id", F.lit("wrong street").alias("reason")).unionByName(existing.where("segment_id % 10 = 4").select("segment_id", F.lit(" no ").alias("reason")))
    left, audit = ledger.reversed_segments(existing, asked)
    return audit.groupBy("action").agg(F.count("*").alias("subjects"), F.sum("rows").alias("rows")).crossJoin(left.agg(F.count("*").alias("left_over")))


@query(f"""WITH {LEDGER}, c AS (SELECT walk, CASE walk % 3 WHEN 0 THEN 'AS_PLANNED' WHEN 1 THEN 'EDITED' ELSE 'DID_NOT_COMPLETE' END AS outcome FROM wal WHERE walk % 5 = 0),
a AS (SELECT walk, segment_id FROM plan WHERE walk IN (SELECT walk FROM c WHERE outcome = 'AS_PLANNED') UNION SELECT walk, segment_id FROM chos WHERE walk IN (SELECT walk FROM c WHERE outcome = 'EDITED')),
r AS (SELECT walk, segment_id FROM comp WHERE walk NOT IN (SELECT walk FROM c) UNION ALL SELECT walk, segment_id FROM a JOIN sg USING (segment_id) WHERE role = 'REQUIRED') SELECT walk % 5 = 0 AS corrected, count(*) AS completions FROM r GROUP BY 1""")
def corrections(spark, sf_dir):
    """Completions after some walks were recorded anew."""
    head, planned, chosen, existing, sg, _ = _ledger(spark, sf_dir)
    k = F.col("walk") % 3
    asked = head.where("walk % 5 = 0").select("walk", F.when(k == 0, "AS_PLANNED").when(k == 1, "EDITED").otherwise("DID_NOT_COMPLETE").alias("outcome"), F.lit("counted twice").alias("reason"))
    after, _ = ledger.corrected(existing, head, asked, planned, chosen, sg)
    return after.groupBy((F.col("walk") % 5 == 0).alias("corrected")).agg(F.count("*").alias("completions"))


@query(f"""WITH {LEDGER}, d AS (SELECT DISTINCT segment_id FROM comp), h AS (SELECT DISTINCT segment_id FROM plan WHERE walk % 4 = 0)
SELECT CASE WHEN campus_obligation = 'CANONICAL' THEN 'campus' WHEN segment_type = 'TRAIL' THEN 'trail' ELSE 'street' END AS kind, d.segment_id IS NOT NULL AS done, h.segment_id IS NOT NULL AND d.segment_id IS NULL AS held, count(*) AS n FROM sg LEFT JOIN d USING (segment_id) LEFT JOIN h USING (segment_id) WHERE role = 'REQUIRED' AND coalesce(campus_obligation, '') <> 'ALTERNATIVE' GROUP BY ALL""")
def progress_map(spark, sf_dir):
    """What the map shows as done and as held."""
    _, planned, _, existing, sg, _ = _ledger(spark, sf_dir)
    return ledger.progress(sg, existing, planned.where("walk % 4 = 0")).groupBy("kind", "done", "held").agg(F.count("*").alias("n"))


@query(f"""WITH {LEDGER}, d AS (SELECT DISTINCT segment_id FROM comp) SELECT round(count(d.segment_id) / count(*), 6) AS fraction, round(coalesce(sum(length_m) FILTER (d.segment_id IS NULL), 0) / 1609.344, 3) AS open_miles FROM sg LEFT JOIN d USING (segment_id) WHERE role = 'REQUIRED'""")
def completion_share(spark, sf_dir):
    """How much of the required network is done."""
    _, _, _, existing, sg, _ = _ledger(spark, sf_dir)
    return ledger.completion_share(sg, existing)


@query("SELECT c_custkey AS person, count(o_orderkey) FILTER (o_orderstatus = 'F') AS completed_walks FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def people_walks(spark, sf_dir):
    """Completed walks of everybody."""
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"))
    w = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").alias("status"))
    return ledger.people_walks(people, w)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def latest_failures(spark, sf_dir):
    """The newest failed requests, 500 at most whatever is asked for."""
    return ledger.latest(load(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_orderdate", "o_orderkey", 2000).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey AS walk, concat('v', o_custkey % 3) AS network, o_custkey % 3 = 2 AS current FROM orders")
def network_versions(spark, sf_dir):
    """Walks that were planned on the network in use."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("walk"), F.concat(F.lit("v"), (F.col("o_custkey") % 3).cast("string")).alias("network"))
    return gates.same_version(rows, spark.range(1).select(F.lit("v2").alias("network")), "walk")


@query("""WITH e AS (SELECT c_custkey, list_extract([' A@b.c ', 'a@b..c', 'a@.b.c', 'a@b.c.', '@b.c', 'a b@c.d', 'a@b', 'a@@b.c', 'joe+x@mail.example.org'], c_custkey % 9 + 1) AS email FROM customer), t AS (SELECT c_custkey, trim(email) AS e, split_part(trim(email), '@', 2) AS d FROM e)
SELECT c_custkey, length(e) BETWEEN 3 AND 320 AND length(e) - length(replace(e, '@', '')) = 1 AND e[1] <> '@' AND contains(d, '.') AND d[1] <> '.' AND d[-1] <> '.' AND NOT contains(e, ' ') AS valid FROM t""")
def email_validity(spark, sf_dir):
    """Addresses good and bad."""
    some = F.array(*map(F.lit, [" A@b.c ", "a@b..c", "a@.b.c", "a@b.c.", "@b.c", "a b@c.d", "a@b", "a@@b.c", "joe+x@mail.example.org"]))
    return load(spark, sf_dir, "customer").select("c_custkey", identity.valid_email(F.element_at(some, (F.col("c_custkey") % 9 + 1).cast("int"))).alias("valid"))
