import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailspan.llm import resampling as R


def features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature, n=10_000):
    return zlib.crc32(feature.encode()) % n


def brute(docs, target):
    have, want = Counter(), Counter()
    for out, texts in ((have, [t for _, t in docs]), (want, target)):
        for t in texts:
            out.update(map(bucket, features(t)[1]))
    s, t = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1.0) * (s + 10000.0) / ((have[b] + 1.0) * (t + 10000.0)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        words, some = features(text)
        weight = sum(gain[bucket(f)] for f in some)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(some), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(may[: 5 * len(may) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abAB19 .é\n", max_size=40), st.just(0)), min_size=1, max_size=6))
def test_nodes_are_the_features_and_their_crc(texts):
    trie = R.Trie.build([(R.folded(t), 0) for t, _ in texts], R.Shift())
    want = Counter(zlib.crc32(f.encode()) for t, _ in texts for f in features(t)[1])
    got = Counter()
    for count, crc in zip(trie.counts, trie.crcs):
        for n, c in zip(count.tolist(), crc.tolist()):
            got[c] += n
    assert +got == want
    assert trie.words.tolist() == [len(features(t)[0]) for t, _ in texts]


@settings(max_examples=60, deadline=None)
@given(st.text("ab .", max_size=80), st.integers(1, 20))
def test_parts_of_a_long_text_lose_nothing(text, limit):
    parts = list(R.pieces(R.folded(text), limit))
    total, shift = np.zeros(97, np.int64), R.Shift()
    for p in parts:
        total += R.Trie.build([p], shift).buckets(97)
    assert total.tolist() == R.Trie.build([(R.folded(text), 0)], shift).buckets(97).tolist()


def test_states_move_by_any_length():
    shift = R.Shift()
    tails = [b"x" * n for n in (0, 1, 2, 3, 8, 31, 255, 256, 1000, 70_001)]
    got = shift.joined(np.full(len(tails), zlib.crc32(b"head"), np.uint32), np.array([len(t) for t in tails]), np.array([zlib.crc32(t) for t in tails], np.uint32))
    assert got.tolist() == [zlib.crc32(b"head" + t) for t in tails]


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "naïve", "42"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 70)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, ".,;"), (None, "one two " * 15), (5, docs[5][1]), (6, "another text " * 12), (303, "Long " * 4000 + "x" * 70_000)]
    return docs, [" ".join(rng.choice(words[:20], 30)) for _ in range(40)] + [None, ""]


def test_equals_brute_force(spark, monkeypatch):
    docs, target = corpus()
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, rank int, part string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in R.resampled(frame, goal).collect()), key=str)
    assert got == brute(docs, target)
    assert sum(r[5] is not None for r in got) > 5


def test_long_texts_are_read_part_by_part(spark, monkeypatch):
    docs, _ = corpus()
    shift, gain = R.Shift(), np.arange(-50, 47)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in docs]})
    def total(limit):
        out = np.zeros((len(docs), 3), np.int64)
        base = 0
        last = None
        for trie, at, rows in R.tries(batch, shift, limit):
            if rows is not last:
                base += last.num_rows if last is not None else 0
                last = rows
            some, weight = trie.sums(gain)
            np.add.at(out, base + np.array(at, int), np.stack([trie.words, some, weight], 1))
        return out

    assert (total(100) == total(1 << 30)).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert R.resampled(none, some).count() == 0
    assert [(r.n_features, r["rank"]) for r in R.resampled(some, none).collect()] == [(87, None)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_whole_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in R.op12_trie_resampling(spark, sf).collect()), key=str) == brute(docs, target)
