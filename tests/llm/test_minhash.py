import random

import numpy as np

from trailspan.llm import minhash


def sets_of(texts, width):
    sets, counts = minhash.shingles(texts, width)
    return [set(x.tolist()) for x in np.split(sets, np.cumsum(counts)[:-1])]


def brute_components(docs, width, percent):
    def shingle(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingle(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)}


def test_shingles_equal_plain_sets():
    texts = ["a b c a b", "", "x", "A b", "b a", "  a\tb\nc  ", "é b"]
    for width in (1, 2, 3, 5):
        got = sets_of(texts, width)
        plain = []
        for t in texts:
            w = t.encode().lower().split()
            plain.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
        assert [len(s) for s in got] == [len(p) for p in plain]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(got[i] & got[j]) == len(plain[i] & plain[j])


def test_signatures_estimate_similarity_and_ignore_order():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    for n in (1, 3, 20, 200):
        a, b = np.sort(pool[: 2 * n][:n]), np.sort(np.concatenate([pool[: n // 2], pool[n : n + n - n // 2]]))
        sig = minhash.super_minhash(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert np.isfinite(sig).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.17
        again = minhash.super_minhash(a[::-1].copy(), np.array([len(a)]))
        assert (again[0] == sig[0]).all()


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(2, 80))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append(" ".join(w))
    docs += ["", None, "  ", "one", "one", "ONE"]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", minhash.F.lit("x")).withColumn("key", minhash.F.lit(1))
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, width, 80).collect()}
        assert got == brute_components(rows, width, 80)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_near_copies_without_ids_are_linked(spark):
    words = [f"w{i}" for i in range(40)]
    # 7 and 9 are alike to the row between them only
    left, middle, right = " ".join(words), " ".join([*words[3:], *"xyz"]), " ".join([*words[6:], *"xyzuvw"])
    lone = [" ".join(f"v{i}" for i in range(40)), " ".join(f"v{i}" for i in range(1, 41))]
    rows = [(7, left), (None, middle), (9, right), (3, lone[0]), (None, lone[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in minhash.near_duplicates(docs, 2, 80).collect())
    assert got == [(0, 3), (0, 7), (3, 3), (7, 7), (9, 7)]
    nameless = docs.where("doc_id IS NULL OR doc_id <> 3")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in minhash.near_duplicates(nameless, 2, 80).collect()) == [(0, 0), (0, 7), (7, 7), (9, 7)]


def test_hot_mixed_buckets_equal_brute_force(spark, monkeypatch):
    """Chains of drifting copies, so that no one copy is like all others; cells so small that every bucket is dealt to several."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(4):
        w = [rng.choice(words) for _ in range(60)]
        for _ in range(25):
            docs.append(" ".join(w))
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(60)] = rng.choice(words)
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2, 80)
    assert len({c for _, c in want.values()}) < 40
    for signed, whole in ((2048, 256), (4, 3)):
        monkeypatch.setattr(minhash, "SIGNED_ROWS", signed)
        monkeypatch.setattr(minhash, "WHOLE_ROWS", whole)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, 2, 80).collect()} == want


def test_recall_of_banding_and_signature_filter():
    """Pairs at a similarity of 0.8 that share a band and have NEED equal bytes: all but one in a million."""
    rng = np.random.default_rng(2)
    kept = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.sort(np.concatenate([both, rng.integers(0, 2**63, 10).astype(np.uint64)])) for _ in range(2))
        sig = minhash.super_minhash(np.concatenate([a, b]), np.array([90, 90]))
        keys = minhash.band_keys(sig)
        small = (minhash.mix64(sig.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
        kept += (keys[0] == keys[1]).any() and (small[0] == small[1]).sum() >= minhash.NEED
    assert kept == 300
