import random

import corpus_pipeline
from trailspan.llm import minhash


#: Extra columns named like the stages' own.
OWN = ["tox_score", "tox_words", "any_kept", "times", "out_id", "id", "row", "kept", "pii_base", "tokens", "domain", "pieces"]


def corpus(spark):
    rng = random.Random(9)
    words = "the of thon ansh erly onti heat blen tion ede".split()
    rows = []
    for i in range(300):
        w = [rng.choice(words) + rng.choice(words) for _ in range(60)]
        if i % 5 == 0:
            w[rng.randrange(60)] = "scumm"
        if i % 7 == 0:
            w[30] = f"joe{i}@mail.example.com"
        rows.append((i, " ".join(w), "en", f"src{i % 4}", 0))
    rows += [(1000 + i, rows[1][1], "en", "src1", 0) for i in range(40)] + [(2000, rows[2][1] + " tail", "en", "src2", 0), (3000, None, None, None, None), (3001, "", "en", "src0", 0), (None, "lone text", "en", "src0", 0), (3, rows[3][1], "en", "src3", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(minhash.F.lit("own").alias(c) for c in OWN))


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    columns = docs.columns
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = dict(corpus_pipeline.STAGES)
    one = kept["toxicity"](spark, docs, str(tmp_path)).cache()
    assert one.columns == columns
    assert one.where("text LIKE '%scumm%'").count() == 0 and one.where("doc_id < 300 AND doc_id % 5 <> 0").count() >= 240
    two = kept["near duplicates"](spark, one, str(tmp_path)).cache()
    ids = [r.doc_id for r in two.collect()]
    assert two.columns == columns and sorted(i for i in ids if i is not None and i >= 1000) == [3000, 3001] and 1 in ids and 2 in ids and None in ids and ids.count(3) == 1
    three = kept["personal data"](spark, two, str(tmp_path)).cache()
    assert three.columns == columns and three.count() == two.count() and three.where("text LIKE '%@mail%'").count() == 0 and three.where("text LIKE '%<email>%'").count() > 0
    four = kept["mixing"](spark, three, str(tmp_path)).cache()
    assert four.columns == columns and 0.8 < four.count() / three.count() <= 1 and four.exceptAll(three).count() == 0
    five = kept["pieces"](spark, four, str(tmp_path))
    assert five.where("NOT round_trip").count() == 0 and five.count() == four.count()


def test_empty_documents(spark, tmp_path):
    docs = corpus(spark).drop(*OWN)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
