"""Mixing sources to target weights: budgets flow down a tree of domain, language and source, and each leaf gives a prefix of seeded epochs.

Everything here is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspan.llm.common import WORD, table
from trailspan.shared import stored

PATH = ("domain", "lang", "source")
#: A leaf's documents are dealt to this many buckets by the first hex digits of their hash.
HEX = 3


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def domain_of(source: str = "source") -> Column:
    """The domain of a source without a given one: its number modulo 4; sources without a number are of domain d0."""
    return F.concat(F.lit("d"), F.pmod(F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("999999999")).cast("long"), F.lit(0)), F.lit(4)).cast("string"))


def draw(seed: int, epoch: Column) -> Column:
    """Order of a document in an epoch: the same in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def water_filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (parent columns, name, weight, cap, budget of the parent) with ``share``, in whole tokens.

    Siblings get weight-proportional shares; what one cannot take goes to the
    others by weight until all are full or the budget is spent. In the order of
    cap / weight the full ones come first, so the level at which the rest stand
    follows from two running sums. Rounding leaves go by largest fraction.
    """
    w = Window.partitionBy(*parent)
    by = w.orderBy(F.col("cap") / F.col("weight"), name)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    flow = F.least("budget", F.sum("cap").over(w))
    nodes = nodes.withColumn("flow", flow).withColumn("level", (F.col("flow") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    nodes = nodes.withColumn("open", F.col("cap") / F.col("weight") >= F.col("level") - 1e-9)
    whole_group = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nodes = nodes.withColumn("height", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole_group))
    exact = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("height"), F.col("cap").cast("double")))
    nodes = nodes.withColumn("exact", exact).withColumn("whole", F.least(F.floor(F.col("exact") + 1e-6), F.col("cap")))
    left = F.col("flow") - F.sum("whole").over(w)
    rank = F.row_number().over(w.orderBy(F.col("whole") >= F.col("cap"), F.desc(F.round(F.col("exact") - F.col("whole"), 6)), name))
    return nodes.withColumn("share", (F.col("whole") + F.when((F.col("whole") < F.col("cap")) & (rank <= left), 1).otherwise(0)).cast("long")).drop("flow", "level", "open", "height", "exact", "whole")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``leaves`` (PATH columns, cap) with ``share``, the tokens that each leaf gives.

    ``weights`` maps a path such as "d0", "d0/en" or "d0/en/src3" to its weight
    among its siblings; other nodes weigh 1, and a weight must be positive. A
    node's cap is what all its leaves can give, so a shortage is made up by a
    leaf's siblings first, and by the siblings of an ancestor only for what the
    whole subtree lacks.
    """
    spark = leaves.sparkSession
    rows = [(k, float(v)) for k, v in (weights or {}).items()] or [("", 1.0)]
    given = spark.createDataFrame(rows, "node string, given double")
    leaves = leaves.withColumn("root", F.lit(0))
    now = leaves.groupBy("root").agg(budget.cast("long").alias("budget"))
    for depth, name in enumerate(PATH):
        parent, own = ["root", *PATH[:depth]], ["root", *PATH[: depth + 1]]
        nodes = leaves.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("node", F.concat_ws("/", *PATH[: depth + 1]))
        nodes = nodes.join(F.broadcast(given), "node", "left").withColumn("weight", F.coalesce("given", F.lit(1.0))).drop("node", "given")
        now = water_filled(nodes.join(now, parent), parent, name).select(*own, F.col("share").alias("budget"))
    now = now.drop("root")
    return now.withColumnRenamed("budget", "share")


def plan_mix(docs: DataFrame, share_of_all: float, epochs: int, weights: Mapping[str, float] | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(units, cuts): what each document is worth, and how much of which epoch each leaf gives.

    units: doc_id, PATH, tokens. cuts: PATH, epoch, need (tokens left for this
    epoch), full (the whole epoch is taken), last (hash of the document that
    reaches the budget; all smaller ones are taken whole) and before (tokens of
    the smaller ones). A leaf's order is never put into one task: sums by hash
    bucket find the bucket that reaches the budget, and only that one's
    documents, 1 in 4096, are put in order.
    """
    units = stored(docs.select(F.col("doc_id"), *PATH, n_words("text").alias("tokens")).groupBy("doc_id", *PATH).agg(F.sum("tokens").alias("tokens")), "mix-units")
    leaves = units.groupBy(*PATH).agg(F.sum("tokens").alias("size")).where("size > 0").withColumn("cap", F.col("size") * epochs)
    leaves = stored(leaves, "mix-leaves")
    budgets = leaf_budgets(leaves, F.floor(F.lit(share_of_all) * F.sum("size")), weights)
    asked = stored(budgets.join(leaves, list(PATH)).where("share > 0"), "mix-budgets")
    need = F.col("share") - F.col("epoch") * F.col("size")
    tries = asked.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("need", need.cast("long")).where("need > 0").withColumn("full", F.col("need") >= F.col("size")).select(*PATH, "epoch", "need", "full")
    tries = stored(tries, "mix-epochs")
    part = tries.where("NOT full")
    drawn = units.where("tokens > 0").join(part, list(PATH)).withColumn("h", draw(seed, F.col("epoch"))).withColumn("bucket", F.substring("h", 1, HEX))
    key = [*PATH, "epoch"]
    sums = stored(drawn.groupBy(*key, "bucket").agg(F.sum("tokens").alias("tokens"), F.first("need").alias("need")), "mix-buckets")
    upto = F.sum("tokens").over(Window.partitionBy(*key).orderBy("bucket"))
    hit = sums.withColumn("upto", upto).withColumn("low", F.col("upto") - F.col("tokens")).where("low < need AND upto >= need").select(*key, "bucket", "low")
    inside = drawn.join(hit, [*key, "bucket"])
    order = Window.partitionBy(*key).orderBy("h")
    inside = inside.withColumn("upto", F.col("low") + F.sum("tokens").over(order)).withColumn("before", F.col("upto") - F.col("tokens"))
    cut = inside.where("before < need AND upto >= need").select(*key, F.col("h").alias("last"), "before")
    cuts = tries.join(cut, key, "left")
    return units, stored(cuts, "mix-cuts")


def taken(frame: DataFrame, cuts: DataFrame, seed: int = 7, tokens: str = "tokens") -> DataFrame:
    """``frame`` (doc_id, PATH, tokens) once for every epoch that takes it, with epoch and take_tokens. No shuffle while the leaves' cuts are few."""
    h = draw(seed, F.col("epoch"))
    take = F.when(F.col("full") | (F.col("h") < F.col("last")), F.col(tokens)).when(F.col("h") == F.col("last"), F.col("need") - F.col("before")).otherwise(F.lit(0))
    out = frame.join(cuts, list(PATH)).withColumn("h", h).withColumn("take_tokens", take.cast("long"))
    return out.where("take_tokens > 0").drop("h", "full", "need", "last", "before")


def mixed(docs: DataFrame, share_of_all: float = 0.5, epochs: int = 2, weights: Mapping[str, float] | None = None, seed: int = 7) -> DataFrame:
    """doc_id, PATH, epoch, tokens and take_tokens of the mix: each leaf's budget in whole tokens.

    ``docs`` needs doc_id, text and the PATH columns (null ones count as empty
    names). The budget is ``share_of_all`` of all tokens, a token being a word;
    a leaf can give each of its documents ``epochs`` times. In every epoch its
    documents stand in the order of a seeded hash, and the leaf gives them from
    the first on; the last one taken is cut to what is needed. Null, empty and
    wordless texts have no token and are not taken; rows that share doc_id and
    leaf are one document of their joint length; a budget beyond what all
    leaves can give takes everything ``epochs`` times; an empty table gives no
    rows; extra columns are ignored.
    """
    docs = docs.select("doc_id", "text", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in PATH))
    units, cuts = plan_mix(docs, share_of_all, epochs, weights, seed)
    return taken(units.where("tokens > 0"), cuts, seed)


WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0, "d0/en": 3.0, "d1/en": 3.0, "d2/en": 3.0, "d3/en": 3.0, "d0/en/src0": 2.0}


def op1_token_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain_of())
    return mixed(docs, 0.5, 2, WEIGHTS, 7)


def _level(n: int) -> str:
    """SQL of one level of the tree: names of nodes at depth n, with their share."""
    cols, up = ", ".join(PATH[:n]), PATH[: n - 1]
    over = f"PARTITION BY {', '.join(up)} " if up else ""
    join = f"JOIN b{n - 1} USING ({', '.join(up)})" if up else "CROSS JOIN b0"
    name = PATH[n - 1]
    path = " || '/' || ".join(PATH[:n])
    return f"""
    n{n} AS (SELECT {cols}, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL),
    w{n} AS (SELECT x.*, coalesce(g.given, 1.0)::DOUBLE AS weight, budget FROM n{n} x {join} LEFT JOIN given g ON g.node = {path}),
    f{n} AS (SELECT *, least(budget, sum(cap) OVER ({over}))::BIGINT AS flow FROM w{n}),
    l{n} AS (SELECT *, (flow - coalesce(sum(cap) OVER ({over}ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER ({over}ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f{n}),
    h{n} AS (SELECT *, first_value(CASE WHEN cap / weight >= level - 1e-9 THEN level END IGNORE NULLS)
        OVER ({over}ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS height FROM l{n}),
    e{n} AS (SELECT *, least(cap::DOUBLE, coalesce(weight * height, cap::DOUBLE)) AS exact FROM h{n}),
    i{n} AS (SELECT *, least(floor(exact + 1e-6)::BIGINT, cap) AS whole FROM e{n}),
    r{n} AS (SELECT *, row_number() OVER ({over}ORDER BY whole >= cap, round(exact - whole, 6) DESC, {name}) AS rk, flow - sum(whole) OVER ({over}) AS spare FROM i{n}),
    b{n} AS (SELECT {cols}, (whole + CASE WHEN whole < cap AND rk <= spare THEN 1 ELSE 0 END)::BIGINT AS budget FROM r{n})"""


OP1_SQL = f"""
WITH units AS (
    SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 4) AS domain,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::BIGINT AS tokens
    FROM documents GROUP BY ALL),
    given(node, given) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())}),
    leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS size, (2 * sum(tokens))::BIGINT AS cap FROM units GROUP BY ALL HAVING sum(tokens) > 0),
    b0 AS (SELECT floor(0.5::DOUBLE * sum(size))::BIGINT AS budget FROM leaves),
    {_level(1)},{_level(2)},{_level(3)},
    tries AS (SELECT domain, lang, source, epoch, size, budget - epoch * size AS need FROM b3 JOIN leaves USING (domain, lang, source), (VALUES (0), (1)) e(epoch)),
    drawn AS (SELECT u.*, epoch, need, md5('7|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')) AS h FROM units u JOIN tries USING (domain, lang, source) WHERE need > 0 AND tokens > 0),
    placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY h) - tokens AS before FROM drawn)
SELECT doc_id, domain, lang, source, tokens, epoch, least(tokens, need - before)::BIGINT AS take_tokens FROM placed WHERE before < need
"""
