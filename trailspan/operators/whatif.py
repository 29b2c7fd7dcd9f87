"""What links would join: components are found once, and each set of links is answered on the small graph of components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspan.operators.graph import connected_components
from trailspan.operators.rules import first_match, reasons
from trailspan.shared import stored

#: Fixed value: metres up to which a link is short.
NEAR_M = 25.0


def contracted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(link_id, low, high): the two components that each link (link_id, u, v) joins; links within one component are left out, and so
    are those with an end that is no node. ``nodes`` has node and component."""
    at = lambda k: nodes.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    both = links.select("link_id", "u", "v").join(at("u"), "u").join(at("v"), "v").where("cu <> cv")
    return both.select("link_id", F.least("cu", "cv").alias("low"), F.greatest("cu", "cv").alias("high"))


def scenario_components(nodes: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """(scenario, component, merged): for every scenario of ``sets`` (scenario, link_id) the component that each of the base network's
    becomes, named after the smallest in it; a scenario without a link that joins anything is not among the rows.

    ``nodes`` has node and component of the base network, which is contracted
    once: all scenarios together are one run over the links that join, each
    scenario's components being nodes of their own.
    """
    joins = contracted(nodes, links).join(sets.select("scenario", "link_id").distinct(), "link_id")
    end = lambda k: F.struct("scenario", F.col(k).alias("component"))
    parts = connected_components(stored(joins.select(end("low").alias("src"), end("high").alias("dst")), "whatif-links"))
    return parts.select(F.col("node.scenario").alias("scenario"), F.col("node.component").alias("component"), F.col("component.component").alias("merged"))


def scenario_summary(nodes: DataFrame, links: DataFrame, sets: DataFrame, base: str = "base") -> DataFrame:
    """One row for each scenario and one for ``base``, without links: components, largest (nodes of the largest component), links that
    join, and saved (components fewer than in ``base``)."""
    merged = stored(scenario_components(nodes, links, sets), "whatif-merged")
    sizes = stored(nodes.groupBy("component").agg(F.count("*").alias("nodes")), "whatif-sizes")
    all_ = sizes.agg(F.count("*").alias("parts"), F.max("nodes").alias("most"))
    grown = merged.join(sizes, "component").groupBy("scenario", "merged").agg(F.sum("nodes").alias("nodes"), F.count("*").alias("of"))
    per = grown.groupBy("scenario").agg(F.max("nodes").alias("most"), F.sum(F.col("of") - 1).alias("saved"))
    used = contracted(nodes, links).join(sets.select("scenario", "link_id").distinct(), "link_id").groupBy("scenario").agg(F.count("*").alias("joining"))
    named = sets.select("scenario").distinct().unionByName(all_.select(F.lit(base).alias("scenario")))
    out = named.join(per, "scenario", "left").join(used, "scenario", "left").crossJoin(all_.withColumnRenamed("most", "all_most"))  # one row
    saved = F.coalesce("saved", F.lit(0))
    return out.select("scenario", (F.col("parts") - saved).alias("components"), F.greatest(F.coalesce("most", F.lit(0)), "all_most").alias("largest"), F.coalesce("joining", F.lit(0)).alias("joining"), saved.alias("saved"))


def joined_by(nodes: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """(scenario, link_id, low, high, low_nodes, high_nodes, beside, needed): what each link joins in each scenario: the two base
    components with their nodes, how many other links of the scenario join the same two, and whether the two would hang together
    without any link between them, by way of other components (then it is not ``needed``).

    Only pairs whose two components both have links to a third one can hang
    together otherwise; other_ways tells which of them do.
    """
    joins = stored(contracted(nodes, links).join(sets.select("scenario", "link_id").distinct(), "link_id"), "whatif-joins")
    sizes = nodes.groupBy("component").agg(F.count("*").alias("nodes"))
    pairs = stored(joins.groupBy("scenario", "low", "high").agg(F.count("*").alias("same")), "whatif-pairs")
    ends = pairs.select("scenario", F.explode(F.array("low", "high")).alias("component")).groupBy("scenario", "component").agg(F.count("*").alias("degree"))
    at = lambda k: ends.select("scenario", F.col("component").alias(k), F.col("degree").alias(f"{k}_degree"))
    doubt = pairs.join(at("low"), ["scenario", "low"]).join(at("high"), ["scenario", "high"]).where("low_degree > 1 AND high_degree > 1").select("scenario", "low", "high")
    around = other_ways(stored(doubt, "whatif-doubt"), pairs.select("scenario", "low", "high"))
    size = lambda k: sizes.select(F.col("component").alias(k), F.col("nodes").alias(f"{k}_nodes"))
    out = joins.join(pairs, ["scenario", "low", "high"]).join(around.withColumn("around", F.lit(True)), ["scenario", "low", "high"], "left").join(size("low"), "low").join(size("high"), "high")
    return out.select("scenario", "link_id", "low", "high", "low_nodes", "high_nodes", (F.col("same") - 1).alias("beside"), F.col("around").isNull().alias("needed"))


def other_ways(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``asked`` (scenario, low, high), pairs of a graph, whose two ends hang together without that pair: those that are no
    bridges. A spanning forest is made of the first pair that reaches each component from a root, level by level; a pair beside the
    forest closes a ring, and every pair of the forest on that ring is no bridge either, which is found by the sums of random
    numbers of 128 bits: each pair beside the forest adds its number at both of its ends, and a forest pair is a bridge where
    nothing of what was added below it is left over. There is one round down and one up for each level of the forest."""
    spark = asked.sparkSession
    both = stored(pairs.select("scenario", F.col("low").alias("a"), F.col("high").alias("b")).unionByName(pairs.select("scenario", F.col("high").alias("a"), F.col("low").alias("b"))), "bridge-both")
    key = F.struct("scenario", "a")
    parts = connected_components(both.select(key.alias("src"), F.struct("scenario", F.col("b").alias("a")).alias("dst")))
    roots = parts.select(F.col("component").alias("n")).distinct()
    tree = stored(roots.select(F.col("n.scenario").alias("scenario"), F.col("n.a").alias("node"), F.lit(None).cast(both.schema["a"].dataType).alias("up"), F.lit(0).alias("level")), "bridge-tree")
    levels = [tree]
    while True:
        known = levels[-1] if len(levels) == 1 else levels[-1].unionByName(levels[-2])
        far = levels[-1].select("scenario", F.col("node").alias("a")).join(both, ["scenario", "a"]).groupBy("scenario", F.col("b").alias("node")).agg(F.min("a").alias("up"))
        new = stored(far.join(known.select("scenario", "node"), ["scenario", "node"], "left_anti").withColumn("level", F.lit(len(levels))), "bridge-tree")
        if new.isEmpty():
            break
        levels.append(new)
    whole = levels[0]
    for some in levels[1:]:
        whole = whole.unionByName(some)
    own = whole.where("up IS NOT NULL").select("scenario", F.least("node", "up").alias("low"), F.greatest("node", "up").alias("high"))
    beside = stored(pairs.select("scenario", "low", "high").join(own, ["scenario", "low", "high"], "left_anti"), "bridge-beside")
    mark = [F.xxhash64(F.lit(k), "scenario", "low", "high").alias(f"m{k}") for k in range(2)]
    sums = beside.select("scenario", F.explode(F.array("low", "high")).alias("node"), *mark).groupBy("scenario", "node").agg(*(F.bit_xor(f"m{k}").alias(f"m{k}") for k in range(2)))
    below, rings = sums, []
    for some in reversed(levels[1:]):
        here = stored(some.join(below, ["scenario", "node"]).select("scenario", "node", "up", "m0", "m1"), "bridge-sums")
        rings.append(here.where("m0 <> 0 OR m1 <> 0").select("scenario", F.least("node", "up").alias("low"), F.greatest("node", "up").alias("high")))
        up = here.select("scenario", F.col("up").alias("node"), "m0", "m1")
        below = stored(below.unionByName(up).groupBy("scenario", "node").agg(F.bit_xor("m0").alias("m0"), F.bit_xor("m1").alias("m1")), "bridge-below")
    ringed = beside
    for some in rings:
        ringed = ringed.unionByName(some)
    return asked.join(ringed.distinct(), ["scenario", "low", "high"], "left_semi") if not asked.isEmpty() else spark.createDataFrame([], asked.schema)


def link_priority(joined: DataFrame, facts: DataFrame) -> DataFrame:
    """(scenario, link_id, gain_nodes, evidence_for, evidence_against, priority) of links that join (see joined_by), with the evidence of
    ``facts`` (link_id, length, junction_near, opposed_ends, homes_near, worst_class, worst_speed, crossed).

    For it speak a junction beside it, ways that end on both sides, homes
    around; against it busy or fast roads beside it, roadways that it crosses, and
    that it is not needed. A link that nothing speaks against and that alone
    brings a whole part of the network comes first.
    """
    f = joined.join(facts, "link_id", "left")
    gain = F.least("low_nodes", "high_nodes")
    pro = reasons([("junction beside it", F.col("junction_near") > 0), ("ways end on both sides", F.col("opposed_ends") >= 2), ("homes around", F.col("homes_near") > 0), ("short", F.col("length") <= NEAR_M)])
    con = reasons([("busy road beside it", F.col("worst_class").isin("Arterial", "Primary", "Ramp")), ("fast road beside it", F.col("worst_speed") >= 35), ("crosses a roadway", F.col("crossed") > 0), ("not needed", ~F.col("needed"))])
    priority = first_match([("REJECT", (F.size(pro) == 0) & (F.size(con) > 1)), ("HIGH", (F.size(con) == 0) & F.col("needed") & (F.size(pro) > 0)), ("MEDIUM", F.col("needed") & (F.size(pro) >= F.size(con)))], "LOW")
    return f.select("scenario", "link_id", gain.alias("gain_nodes"), pro.alias("evidence_for"), con.alias("evidence_against"), priority.alias("priority"))
