import os

import duckdb
import numpy as np
import pytest

from trailspan.llm import vafile

LOW, HIGH = -(2**63), 2**63 - 1


def brute(rows, anchors, k=5, percent=80):
    """rows and anchors: (vec_id, label, [ints])."""
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows})
    first = {}
    for i, lab, v in sorted((i, lab, tuple(v)) for i, lab, v in anchors):
        first.setdefault(i, (lab, v))
    out = []
    for a, (lab, q) in first.items():
        score = [min(max(sum(x * y for x, y in zip(q, v)), LOW), HIGH) for _, _, v in rows]
        mine = sorted((-s, i) for (i, other, _), s in zip(rows, score) if other == lab and i != a)[:k]
        for s, p in mine:
            s = -s
            near = sorted((-t, i) for (i, other, _), t in zip(rows, score) if other != lab and percent * s <= 100 * t <= 100 * s)[:k]
            out += [(a, p, r + 1, i, s, -t) for r, (t, i) in enumerate(near)]
    return sorted(out)


def drawn(seed, n, d, labels, spread):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, spread, (labels, d))
    lab = rng.choice(labels, n, p=np.arange(1, labels + 1)[::-1] / sum(range(labels + 1)))
    v = np.floor(centre[lab] * rng.uniform(0, 1, (n, 1)) + rng.normal(0, spread / 2, (n, d))).astype(int)
    return [(i, int(x), [int(y) for y in r]) for i, (x, r) in enumerate(zip(lab, v))]


@pytest.mark.parametrize("seed,n,d,labels,spread", [(1, 300, 4, 3, 30), (2, 500, 12, 6, 8), (3, 200, 2, 40, 2), (4, 90, 1, 2, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, n, d, labels, spread):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 60)
    monkeypatch.setattr(vafile, "PACK_ROWS", 7)
    monkeypatch.setattr(vafile, "ANCHORS", 4)
    rows = drawn(seed, n, d, labels, spread)
    rows += [(7, 0, rows[7][2]), rows[9], (20, 1, [1] * (d - 1))]
    asked = [r for r in rows if r[0] % 10 == 0]
    made = lambda x: spark.createDataFrame([(*r, 0) for r in x], "vec_id long, label long, v array<bigint>, block int")
    got = vafile.mined(made(rows).drop("block"), made(asked).drop("block")).collect()
    assert sorted(map(tuple, got)) == brute(rows, asked)


def test_bounds_hold_every_score_and_leave_few_rows():
    rng = np.random.default_rng(3)
    v = rng.normal(0, 100, (2000, 16)).astype(np.int64)
    codes = vafile.cells_of(v)
    assert codes.max() < vafile.CELLS
    block = vafile.Approximation(np.arange(2000), np.zeros(2000, np.int64), v, codes)
    q = rng.normal(0, 100, (5, 16)).astype(np.int64)
    below, above = block.bounds(q.astype(float))
    exact = v @ q.T
    assert (below <= exact).all() and (exact <= above).all()
    may = [(above[:, i] >= vafile.kth(below[:, i], 5)).sum() for i in range(5)]
    assert max(may) < 400


def test_rows_that_take_no_part_and_wide_values(spark):
    rows = [(1, [0.5, 1.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (6, [1e17, 1.0], 1), (7, [1e17, -2.0], 2), (8, [1e300, 1.0], 2), (9, [0.4, 0.9], 2), (10, [], 2), (11, [0.001], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    v = vafile.labelled_vectors(frame)
    data = [(r.vec_id, r.label, list(r.v)) for r in v.collect()]
    assert sorted(r[0] for r in data) == [1, 6, 7, 8, 9, 10, 11]
    got = vafile.mined(v, v).collect()
    assert sorted(map(tuple, got)) == brute(data, data)
    assert vafile.mined(v.limit(0), v).count() == 0 and vafile.mined(v, v.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = vafile.op13_va_negatives(spark, sf).toPandas()
    want = con.execute(vafile.OP13_SQL).df()
    assert len(want) > 50
    assert sorted(map(tuple, got[sorted(got.columns)].to_numpy().tolist())) == sorted(map(tuple, want[sorted(want.columns)].to_numpy().tolist()))
