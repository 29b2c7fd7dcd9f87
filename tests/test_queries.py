"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from trailspan.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: "-" if pd.api.types.is_scalar(x) and pd.isna(x) else f"{x:.9g}" if isinstance(x, float) and math.isfinite(x) else str(x)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    if name not in ORACLES:
        assert got.count() >= 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)
