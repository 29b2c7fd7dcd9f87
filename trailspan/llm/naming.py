"""Exact duplicates by deterministic block naming: texts are cut into blocks of fixed size, blocks are sorted into integer names,
and neighbouring names are named again, pair by pair, until one name is left of each text.

Everything here is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspan.llm.common import LOWER, UPPER, table
from trailspan.shared import stored

BLOCK_BYTES = 2048
#: A key with more than one of SHARES of all rows is heavy. There are at most SHARES of them, so their names may be broadcast.
SHARES = 20_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of single bytes take the faster way to the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def two_hashes(block: Column) -> tuple[Column, Column]:
    return F.xxhash64(block), F.xxhash64(F.lit(1), block)


def blocks_of(binary: str, size: int) -> Column:
    """The blocks of a binary column; an empty one is one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(binary) / size)).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.col(binary), (i - 1) * size + 1, F.lit(size)))


def in_order(kinds: DataFrame, key: list[str], after: int) -> DataFrame:
    """``kinds`` (key, n), one row a key, with ``name``: after + 1 and so on in the order of the key. Ranges are cut first, each
    task numbers its own, and only the counts of the ranges are summed up in one place."""
    parts = stored(kinds.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "naming-ranges")
    counts = parts.groupBy("part").count()
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*key))
    return parts.withColumn("own", own).join(F.broadcast(before), "part").withColumn("name", F.lit(after) + F.col("before") + F.col("own")).drop("part", "own", "before")


def looked_up(items: DataFrame, named: DataFrame, key: list[str], values: list[str], total: int) -> DataFrame:
    """``items`` with the ``values`` of their key in ``named`` (key, n, values), whose n says how many items have the key and sums to
    ``total``. Heavy keys are met by broadcast, at most SHARES of them; in the shuffle of the rest no key is heavy."""
    heavy = named.where(F.col("n") * SHARES > total).select(*key, *values, F.lit(True).alias("heavy"))
    light = named.where(F.col("n") * SHARES <= total).select(*key, *values)
    seen = items.join(F.broadcast(heavy), key, "left")
    rest = seen.where("heavy IS NULL").drop("heavy", *values).join(light, key)
    return seen.where("heavy").drop("heavy").unionByName(rest)


def with_names(items: DataFrame, kinds: DataFrame, key: list[str], after: int) -> tuple[DataFrame, int]:
    """(``items`` with ``name`` in place of the key, the greatest name): equal keys have equal names, others other ones."""
    kinds = stored(kinds, "naming-kinds")
    seen = kinds.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    named = stored(in_order(kinds, key, after), "naming-names")
    return looked_up(items, named, key, ["name"], seen.total).drop(*key), after + seen.kinds


def identities(texts: DataFrame, size: int = BLOCK_BYTES, hashes: Callable[[Column], tuple[Column, Column]] = two_hashes) -> tuple[DataFrame, DataFrame]:
    """(rows, ids) of ``texts`` (doc_id, t binary): rows are (row, doc_id, sha256), ids (row, identity), with equal identities
    for equal texts and no others.

    Distinct blocks are found by their content. They are told apart by two
    hashes from then on, if these are found to be different for all different
    blocks of the table; if not, by their content. A text of n blocks has one
    name after log2(n) rounds, rounded up; names of later rounds are greater
    than all of earlier ones, so texts of unlike numbers of blocks never agree.
    """
    cut = texts.select(F.explode(blocks_of("t", size)).alias("b")).select(*(h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("b")))), "b")
    found = cut.groupBy("h0", "h1", "b").agg(F.count("*").alias("n"))
    key = ["h0", "h1"]
    kinds = stored(found.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("contents")), "naming-blocks")
    if not kinds.where("contents > 1").isEmpty():
        kinds, key = found, ["h0", "h1", "b"]
    parts = F.transform(blocks_of("t", size), lambda b: F.struct(*(h.alias(f"h{i}") for i, h in enumerate(hashes(b))), *([b.alias("b")] if "b" in key else [])))
    rows = stored(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("t", 256).alias("sha256"), parts.alias("parts")), "naming-rows")
    now = rows.select("row", F.size("parts").alias("size"), F.posexplode("parts").alias("pos", "p")).select("row", "size", "pos", "p.*")
    now, top = with_names(now, kinds.select(*key, "n"), key, 0)
    done = None
    while True:
        now = stored(now, "naming-round")
        whole = now.where("size = 1").select("row", F.col("name").alias("identity"))
        done = whole if done is None else done.unionByName(whole)
        more = now.where("size > 1")
        if more.isEmpty():
            return rows.select("row", "doc_id", "sha256"), done
        at = lambda k: F.coalesce(F.max(F.when(F.col("pos") % 2 == k, F.col("name"))), F.lit(0)).alias(f"n{k}")
        half = more.groupBy("row", F.ceil(F.col("size") / 2).cast("int").alias("size"), F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(at(0), at(1))
        pairs = stored(half.withColumnRenamed("half", "pos"), "naming-pairs")
        now, top = with_names(pairs, pairs.groupBy("n0", "n1").agg(F.count("*").alias("n")), ["n0", "n1"], top)


def exact_duplicates(docs: DataFrame, size: int = BLOCK_BYTES, hashes: Callable[[Column], tuple[Column, Column]] = two_hashes) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs`` (doc_id, text).

    Texts are equal when they are identical after lower-casing A-Z; a null text
    is an empty one, and empty texts equal each other. Of equal texts the row
    with the largest doc_id stays; of rows that share that doc_id too, one; a
    null doc_id is smaller than all others. Every row comes back once, also
    repeated ones; texts of any length are read whole; other columns are
    ignored; an empty table gives no rows.
    """
    texts = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).cast("binary").alias("t"))
    rows, ids = identities(texts, size, hashes)
    full = stored(rows.join(ids, "row"), "naming-ids")
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("r"))).alias("best")
    groups = stored(full.groupBy("identity").agg(F.count("*").alias("n"), best), "naming-groups")
    groups = groups.select("identity", "n", F.col("n").alias("group_size"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.r")).alias("keep_row"))
    out = looked_up(full, groups, ["identity"], ["group_size", "keep_id", "keep_row"], full.count())
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256"))


def op11_block_names(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, (count(*) OVER same)::BIGINT AS group_size, doc_id = max(doc_id) OVER same AS kept,
    sha256(x) AS text_sha256
FROM t WINDOW same AS (PARTITION BY x)
"""
