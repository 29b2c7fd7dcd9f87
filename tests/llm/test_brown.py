import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trailspan.llm import brown
from trailspan.llm.common import remainder


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(4)
    pairs = np.zeros((61, 61), np.int64)
    last = 0
    for _ in range(60000):
        group = (last % 3 + 1) % 3 if last else 0
        new = 1 + 3 * int(rng.integers(20)) + group
        pairs[last, new] += 1
        last = new if rng.random() > 0.02 else 0
        if last == 0:
            pairs[new, 0] += 1
    cls = brown.exchange(pairs, 10)
    assert cls[0] == 0 and 0 not in cls[1:]
    for c in range(1, 10):
        assert len({u % 3 for u in np.flatnonzero(cls == c)}) <= 1
    counts = np.zeros((10, 10))
    np.add.at(counts, (cls[:, None], cls[None, :]), pairs)
    fit = lambda n: brown._f(n).sum() - brown._f(n.sum(0)).sum() - brown._f(n.sum(1)).sum()
    other = np.zeros((10, 10))
    some = np.concatenate([[0], rng.integers(1, 10, 60)])
    np.add.at(other, (some[:, None], some[None, :]), pairs)
    assert fit(counts) > fit(other)


def test_chances_add_up_to_one():
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 5, (brown.ITEMS, brown.ITEMS))
    pairs[40:] = 0
    pairs[:, 40:] = 0
    tokens, kinds = pairs.sum(0).astype(float), np.minimum(pairs.sum(0), 7).astype(float)
    cls = brown.exchange(pairs, 8)
    counts = np.zeros((8, 8))
    np.add.at(counts, (cls[:, None], cls[None, :]), pairs)
    size = np.bincount(cls, tokens, 8)
    m = brown.fit_emissions(size, np.bincount(cls, kinds, 8), 30, 10)
    assert np.allclose((10 ** brown.fit_transitions(counts).trans).sum(1), 1)
    known = np.bincount(cls, np.where(tokens > 0, tokens - m.discount * kinds, 0), 8)
    for c in range(8):
        if size[c]:
            assert abs(known[c] / size[c] + 10 ** m.unseen[c] - 1) < 1e-9


def likelihood(pairs, cls, classes):
    counts = np.zeros((classes, classes))
    np.add.at(counts, (cls[:, None], cls[None, :]), pairs)
    return brown._f(counts).sum() - brown._f(counts.sum(0)).sum() - brown._f(counts.sum(1)).sum()


def test_a_word_goes_where_likelihood_gains_most():
    rng = np.random.default_rng(8)
    for _ in range(40):
        pairs = rng.poisson(0.4 * rng.integers(1, 6, (30, 1)) * rng.integers(1, 6, (1, 30)))
        cls = np.concatenate([[0], rng.integers(1, 5, 29)])
        w = int(rng.integers(1, 30))
        pairs[w, w] = 0
        by = np.eye(5)[cls]
        left, right = pairs[:, w] @ by, pairs[w] @ by
        got = int(brown.best_class(left[None], right[None], cls[w : w + 1], by.T @ pairs @ by)[0])
        all_ = [-np.inf] + [likelihood(pairs, np.where(np.arange(30) == w, c, cls), 5) for c in range(1, 5)]
        assert all_[got] >= max(all_) - 1e-6


def test_every_word_is_clustered_by_its_neighbours(spark, monkeypatch):
    """Words of two kinds take turns, endings say nothing; few are in the core and few in memory."""
    monkeypatch.setattr(brown, "TOP", 40)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    kinds = [[word() for _ in range(1500)] for _ in range(2)]
    pick = lambda k: kinds[k][min(int(rng.expovariate(1 / 200)), 1499)]
    rows = [(i, " ".join(pick(j % 2) for j in range(30))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = brown.stored(brown.blocks(docs.withColumn("held", F.col("doc_id") % 5 == 2)), "t")
    core, item = np.zeros(0, np.int64), np.zeros(0, np.int32)
    unit_cls = np.concatenate([[0], 1 + np.arange(brown.ITEMS - 1) % 5])
    pairs = brown.pair_counts(made, core, item)
    before = np.zeros((6, 6))
    np.add.at(before, (unit_cls[:, None], unit_cls[None, :]), pairs)
    vocabulary = brown.train_words(made).groupBy("hash").agg(F.sum("n").alias("c"))
    top = brown.frequent(vocabulary)
    assert 0 < len(top) <= 40
    got = {r.hash: (r.c, r.cls) for r in brown.assigned(brown.contexts(made, top, core, item, unit_cls, 6), before).collect()}
    c = Counter(w for i, t in rows if i % 5 != 2 for w in [*t.split(), ""])
    signed = lambda w: int(np.uint64(brown.word_hash(w.encode())).astype(np.int64))
    assert {h: n for h, (n, _) in got.items()} == {signed(w): n for w, n in c.items()}
    assert [h for h, (_, k) in got.items() if k == 0] == [signed("")]
    # against the same by hand
    unit = lambda w: int(unit_cls[brown.tail_of(w.encode())]) if w else 0
    left, right = {w: np.zeros(6) for w in c}, {w: np.zeros(6) for w in c}
    for i, t in rows:
        if i % 5 != 2:
            x = ["", *t.split(), ""]
            for p, q in zip(x, x[1:]):
                left[q][unit(p)] += 1
                right[p][unit(q)] += q != "" or p != ""
    for w in c:
        if w:
            want = brown.best_class(left[w][None], right[w][None], np.array([unit(w)]), before)[0]
            assert got[signed(w)][1] == want
    out = brown.score_corpus(docs, F.col("doc_id") % 5 == 2, 6).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        stem = rng.choice([["the", "of", "and", "thon"], ["der", "und", "ein", "keit"], ["los", "que", "ción", "ez"]])
        out.append(" ".join(rng.choice(stem) + rng.choice(["", "", rng.choice(stem)]) for _ in range(rng.randrange(20, 60))))
    return out


def test_query_equals_brute_force_base_and_beats_it(spark):
    rows = [(i, t) for i, t in enumerate(texts(400, 1))] + [(900, None), (901, ""), (902, "The THE"), (902, "The THE"), (None, "der und")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.lit(7)).withColumn("hash", F.lit("x"))
    got = brown.score_corpus(docs, F.coalesce(F.col("doc_id") % 5 == 2, F.lit(False)), 8).collect()
    assert len(got) == len(rows)
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: i is not None and i % 5 == 2
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert brown.score_corpus(docs.limit(0), F.lit(False), 8).count() == 0
    assert all(math.isfinite(r.score) for r in brown.score_corpus(docs, F.lit(True), 8).collect())


def test_held_out_perplexity_on_documents(spark):
    """On texts not learned from, the perplexity is less than a half of the unigrams'."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = brown.score_corpus(docs, remainder(F.col("doc_id"), 7) == 2).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    base, model = (10 ** (-x / r[0]) for x in r[1:])
    assert model < base / 2
