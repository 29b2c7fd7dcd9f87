import hashlib
import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from trailspan.llm import naming


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def check(rows, got):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lowered(text)].append(i)
    assert len(got) == len(rows)
    stay = defaultdict(int)
    for r in got:
        stay[r.text_sha256] += r.kept
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        assert sorted(map(str, (r.doc_id for r in mine))) == sorted(map(str, ids))
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        assert all(r.keep_id == keep and r.group_size == len(ids) for r in mine)
        assert stay[sha] == 1 and all(r.doc_id == keep for r in mine if r.kept)


HARD = [(1, "abcdefgh"), (2, "ABCDEFGH"), (3, "abcdefg"), (4, None), (5, ""), (6, "abcdabcd"), (7, "abcdabcdabcd"), (8, "abcdabcdabc"), (9, "abcd"), (10, "É"), (11, "é"), (12, "\x00" * 4), (13, "\x00" * 5),
        (14, "x" * 300), (15, "X" * 300), (16, "x" * 299 + "y"), (None, "abcd"), (None, None), (9, "abcd"), (17, "abcd" * 9), (18, "abcd" * 8)]


@pytest.mark.parametrize("size", [1, 3, 4, 2048])
def test_equals_grouping_by_text(spark, size):
    docs = spark.createDataFrame([(i, t, "x") for i, t in HARD], "doc_id long, text string, identity string")
    check(HARD, naming.exact_duplicates(docs, size).collect())


def test_clashing_hashes_are_told_apart_by_content(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string")
    few = lambda b: (F.octet_length(b) % 2, F.lit(0))
    check(HARD, naming.exact_duplicates(docs, 4, few).collect())


def test_heavy_and_light_keys(spark, monkeypatch):
    monkeypatch.setattr(naming, "SHARES", 3)
    rows = [(i, "same text of many" if i % 2 else f"text {i // 3}") for i in range(200)]
    check(rows, naming.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())


def test_empty_table(spark):
    assert naming.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_names_do_not_depend_on_partitions(spark):
    rows = [(i, f"{'a' * (i % 7)}{i % 5}" * 3) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, t string").withColumn("t", F.col("t").cast("binary"))
    def names(frame):
        known, ids = naming.identities(frame, 4)
        return sorted((r.doc_id, r.identity) for r in known.join(ids, "row").collect())

    assert names(docs.repartition(1)) == names(docs.repartition(7))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query_equals_its_sql_without_python(spark):
    sf = "/root/testdata/sf0.001"
    got = naming.op11_block_names(spark, sf)
    assert "Python" not in got._jdf.queryExecution().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(naming.OP11_SQL).df()
    assert sorted(map(tuple, got.toPandas()[sorted(got.columns)].to_numpy().tolist())) == sorted(map(tuple, want[sorted(want.columns)].to_numpy().tolist()))
