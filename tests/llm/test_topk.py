import numpy as np
import pytest

from trailspan.llm import topk


def brute(ids, v, q, own, k):
    s = v @ q
    rows = [i for i in np.lexsort((ids, -s)) if ids[i] != own][:k]
    return [(int(ids[i]), int(s[i])) for i in rows]


@pytest.mark.parametrize("n,d,spread", [(1, 3, 5), (7, 4, 3), (300, 16, 20), (900, 8, 2), (500, 64, 9)])
def test_search_equals_brute_force(n, d, spread):
    rng = np.random.default_rng(n)
    v = rng.integers(-spread, spread + 1, (n, d))
    ids = rng.permutation(n) + 5
    index = topk.Index.unpack(topk.Index.build(ids, v).pack())
    some = rng.integers(0, n, 12)
    at, found, scores = index.search(v[some], ids[some], 20)
    for i in range(len(some)):
        got = [(int(a), int(b)) for a, b in zip(found[at == i], scores[at == i])]
        assert got == brute(ids, v, v[some[i]], ids[some[i]], 20)


def test_early_stop_is_exact_on_clustered_vectors():
    rng = np.random.default_rng(8)
    v = np.zeros((2000, 32), np.int64)
    for i in range(2000):
        v[i, rng.integers(0, 32, 3)] = rng.integers(1, 60, 3)
    ids = np.arange(2000)
    index = topk.Index.build(ids, v)
    at, found, scores = index.search(v[:5], ids[:5], 20)
    for i in range(5):
        assert [(int(a), int(b)) for a, b in zip(found[at == i], scores[at == i])] == brute(ids, v, v[i], i, 20)


def test_rows(spark):
    rows = [(i, [float(i % 5), -1.0, 0.5 * (i % 3)]) for i in range(60)] + [(60, None), (61, [1.0, None, 2.0]), (62, [float("nan"), 1.0, 1.0]), (63, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (5, [4.0, 4.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", topk.F.lit(1))
    vectors = topk.whole_vectors(frame)
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    data = [(r.vec_id, np.array(r.v)) for r in vectors.collect()]
    assert len(data) == 61
    ids, v = np.array([i for i, _ in data]), np.stack([x for _, x in data])
    for q in (0, 20, 40):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(i, s) for _, i, s in mine] == brute(ids, v, v[list(ids).index(q)], q, 20)
        assert [r for r, _, _ in mine] == list(range(1, 21))
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_wide_components_keep_their_value_and_huge_scores_stop_at_a_long(spark):
    index = topk.Index.unpack(topk.Index.build(np.array([1, 2]), np.array([[2**33 + 5, 1], [3, 4]])).pack())
    assert index.v.tolist() == [[2**33 + 5, 1], [3, 4]]
    rows = [(1, [1e17, 1.0]), (2, [1e17, 2.0]), (3, [-1e300, 0.0]), (4, [1e300, 0.0]), (5, [0.0, 0.0])]
    v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    data = {r.vec_id: [int(x) for x in r.v] for r in v.collect()}
    low, high = -(2**63), 2**63 - 1
    got = {}
    for r in topk.top_k(v, v, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, x in data.items():
        scores = [(i, min(max(sum(a * b for a, b in zip(x, y)), low), high)) for i, y in data.items() if i != q]
        assert got[q] == sorted(scores, key=lambda s: (-s[1], s[0]))[:3]


def test_bounds_of_other_blocks_skip_rows_but_never_a_result(spark, monkeypatch):
    """Norms of all sizes in small blocks and packs, repeated queries."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "PACK", 8)
    monkeypatch.setattr(topk, "SEEDS", 30)
    rng = np.random.default_rng(6)
    v = (rng.normal(0, 1, (400, 6)) * rng.lognormal(0, 1.2, (400, 1)) * 20).astype(int)
    frame = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(v)], "vec_id long, v array<bigint>")
    ask = frame.where("vec_id % 9 = 0")
    got = topk.top_k(frame, ask.unionByName(ask), 5).collect()
    ids = np.arange(400)
    for q in range(0, 400, 9):
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == brute(ids, v, v[q], q, 5)
