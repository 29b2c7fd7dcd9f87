"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``docs``, whatever those are
called. ORACLE_SQL is None: SQL expresses none of the models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspan.llm import minhash, mixing, pieces, pii, toxicity
from trailspan.llm.common import table
from trailspan.shared import stored

TOXIC_AT = 0.3
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores below TOXIC_AT; null and empty texts count as empty and stay unless empty texts are toxic."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct("*").alias("row"), "text")
    return toxicity.with_scores(whole, model, ["row", "text"]).where(F.col("tox_score") < TOXIC_AT).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, that of the smallest doc_id; of equal rows, one.

    A doc_id goes if none of its rows is kept; rows without a doc_id stay.
    """
    judged = stored(minhash.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "kept"), "pipeline-near")
    ids = judged.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("kept").alias("any_kept"), F.count("*").alias("times"))
    odd = stored(ids.where("NOT any_kept OR times > 1"), "pipeline-odd")
    few = odd.count() <= minhash.BROADCAST_IDS
    # the documents' own columns stand in one struct, so no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))
    marked = rows.join(F.broadcast(odd) if few else odd, "id", "left").where(F.coalesce("any_kept", F.lit(True)))
    once = marked.where(F.coalesce("times", F.lit(1)) == 1).select("row.*")
    if odd.where("times > 1 AND any_kept").isEmpty():
        return once
    return once.unionByName(marked.where("times > 1").select("row.*").distinct())


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs, pii.fit_pii(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents up to 90 % of all tokens, equal weights among siblings, one epoch; documents without a token are not taken."""
    path = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    units = docs.select(F.struct("*").alias("row"), "doc_id", "text", mixing.domain_of().alias("domain"), *path)
    _, cuts = mixing.plan_mix(units, 0.9, 1)
    return mixing.taken(units.withColumn("tokens", mixing.n_words("text")), cuts).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the pieces, and whether decoding them gives the text again."""
    return pieces.with_pieces(docs, ["doc_id", "lang", "source", "text"]).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", redact_pii),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
