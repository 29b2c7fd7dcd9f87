"""Checks over tables: one row each, fatal or not."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspan.shared import stored


@dataclass(frozen=True)
class Check:
    """``passed`` is an aggregate expression that gives one boolean; null counts as failed."""

    name: str
    passed: Column
    fatal: bool = True


def run_checks(frame: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks over one table in one pass: name, passed, fatal."""
    one = frame.agg(*(F.coalesce(c.passed, F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(c.name).alias("name"), F.col(f"c{i}").alias("passed"), F.lit(c.fatal).alias("fatal")) for i, c in enumerate(checks)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def verdict(results: DataFrame) -> DataFrame:
    """GO, CONDITIONS (only warnings failed) or NO-GO."""
    failed = lambda fatal: F.count_if(~F.col("passed") & (F.col("fatal") == fatal))
    return results.agg(F.when(failed(True) > 0, "NO-GO").when(failed(False) > 0, "CONDITIONS").otherwise("GO").alias("verdict"), failed(True).alias("fatal_failures"), failed(False).alias("warnings"))


def _char_runs(word: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` characters of a word."""
    chars = F.split(word, "")
    at = F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: F.xxhash64(F.lit(n), F.concat_ws("", F.slice(chars, i, F.lit(n)))))
    return F.when(F.size(chars) >= n, at).otherwise(F.array().cast("array<bigint>"))


def _holders(vocabulary: DataFrame, anchors: DataFrame) -> DataFrame:
    """(word, anchor) of words (word) that hold an anchor (anchor) anywhere: words meet anchors by the hash of the anchor's first 1, 2,
    4 or 8 characters, the most it has, and are verified."""
    n = F.length("anchor")
    size = F.when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1)
    # its own characters, as the words' are cut, so that both sides hash the same
    first = lambda k: F.try_element_at(_char_runs(F.col("anchor"), k), F.lit(1))
    keyed = anchors.withColumn("_gram", F.when(size == 8, first(8)).when(size == 4, first(4)).when(size == 2, first(2)).otherwise(first(1)))
    runs = F.array_distinct(F.flatten(F.array(*(_char_runs(F.col("word"), k) for k in (1, 2, 4, 8)))))
    return vocabulary.withColumn("_gram", F.explode(runs)).join(keyed, "_gram").where(F.contains("word", F.col("anchor"))).select("word", "anchor").distinct()


def leaked(texts: DataFrame, text: str, secrets: DataFrame, secret: str, few: int = 100_000, any_case: bool = True) -> DataFrame:
    """Pairs (text row, secret) where the text holds the secret whole, in any case of letters or, without ``any_case``, as it is
    written, wherever it begins. A secret listed twice is found once.

    A secret of three words or more is sought by its second word and those after
    it, but the last, up to three: a holder must have them as words of its own.
    A shorter one has no inner word, so the longer of its words may be part of a
    word: it is sought in the distinct words of all texts, which are far fewer
    than their words, and texts that have such a word are candidates. Texts give
    only a row number and hashes of their words; the few that meet are read again
    and verified. Up to ``few`` hashes are broadcast, more are shuffled. Null and
    blank secrets are found nowhere, nor is anything in null texts.
    """
    fold = F.lower if any_case else F.col
    words = lambda c: F.filter(F.split(fold(c), "[ \\t-\\r]+"), lambda w: w != "")
    known = secrets.distinct().where(F.trim(secret) != "").withColumn("_w", words(secret)).where(F.size("_w") > 0)
    run = F.least(F.lit(3), F.size("_w") - 2)
    long_ = known.where(F.size("_w") >= 3).select(*secrets.columns, run.alias("_n"), F.xxhash64(run, F.concat_ws(" ", F.slice("_w", F.lit(2), run))).alias("_gram"))
    rows = texts.withColumn("_row", F.xxhash64(text))
    kinds = [r[0] for r in long_.select("_n").distinct().collect()]  # three at most

    def runs(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.xxhash64(F.lit(n), F.concat_ws(" ", F.slice(F.col("_w"), i, F.lit(n)))))
        return F.when(F.size("_w") >= n, at).otherwise(F.array().cast("array<bigint>"))

    in_words = rows.select("_row", words(text).alias("_w"))
    small = lambda d: F.broadcast(d) if d.count() <= few else d
    met = None
    if kinds:
        grams = F.array_distinct(F.flatten(F.array(*map(runs, kinds))))
        met = in_words.select("_row", F.explode(grams).alias("_gram")).join(small(long_), "_gram").drop("_n", "_gram")
    one, two = F.get("_w", F.lit(0)), F.get("_w", F.lit(1))
    longer = F.when(F.length(one) >= F.coalesce(F.length(two), F.lit(0)), one).otherwise(two)
    short = known.where(F.size("_w") < 3).select(*secrets.columns, longer.alias("anchor"))
    if not short.isEmpty():
        own = in_words.select("_row", F.explode(F.array_distinct("_w")).alias("word"))
        hits = _holders(own.select("word").distinct(), small(short.select("anchor").distinct()))
        by_word = stored(hits.join(short, "anchor").select(F.xxhash64("word").alias("_word"), *secrets.columns), "leak-words")
        short_met = own.select("_row", F.xxhash64("word").alias("_word")).join(small(by_word), "_word").drop("_word")
        met = short_met if met is None else met.unionByName(short_met)
    if met is None:
        met = rows.select("_row").join(known.select(*secrets.columns).limit(0))
    return rows.join(met.distinct(), "_row").where(F.contains(fold(text), fold(secret))).drop("_row")
