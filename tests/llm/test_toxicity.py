import itertools
import random

import numpy as np

from trailspan.llm import toxicity


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    lines = np.array([1, 4, 2])
    e, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    p, pair, logz = toxicity.forward_backward(e, lines, trans)
    want, total, pairs, at = np.zeros(7), 0.0, np.zeros((2, 2)), 0
    for n in lines:
        mass, ones, mine = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + i] for i in range(n) if y[i]) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            mass += w
            ones += w * np.array(y)
            for i in range(n - 1):
                mine[y[i], y[i + 1]] += w
        want[at : at + n], total, pairs, at = ones / mass, total + np.log(mass), pairs + mine / mass, at + n
    assert np.allclose(p, want) and np.allclose(pair, pairs) and abs(logz - total) < 1e-9


def make(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice("the of thon ansh erly onti heat blen tion ede".split()) + rng.choice(["", "re", "an", "st"]) for _ in range(rng.randrange(30, 90))]
        bad = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["scumm", "morron", "lowei" + rng.choice(["a", "bb", "chen", "ent"])])
        texts.append(" ".join(w[:20]) + "\n" + " ".join(w[20:]))
        labels.append(float(bad))
    return texts, np.array(labels)


def test_held_out_accuracy_and_spans():
    texts, y = make(800, 1)
    model = toxicity.train(texts, y, 0.25)
    other, z = make(400, 2)
    score, count, spans = toxicity.score_texts(model, other)
    assert ((score >= 0.3) == (z > 0)).mean() > 0.98
    for t, s, bad in zip(other, spans, z):
        found = [t[int(a) : int(b)] for a, b in (x.split(":") for x in s.split(",") if x)]
        assert bad or not found
        assert all(w[:4] in ("scum", "morr", "lowe") for w in found)
    assert (count[z > 0] > 0).mean() > 0.95
    odd, n, _ = toxicity.score_texts(model, ["", " \n ", "x " * 50000, "Ünï\tcode"])
    assert ((odd >= 0) & (odd < 0.3)).all() and n.tolist() == [0, 0, 0, 0]


def test_without_labels_or_words():
    assert 0 <= toxicity.score_texts(toxicity.train([], np.zeros(0), 0.1), ["a b"])[0][0] <= 1
    assert toxicity.score_texts(toxicity.train(["", ""], np.array([0.0, 1.0]), 0.1), [])[0].tolist() == []


def test_rows(spark):
    texts, y = make(200, 5)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (0, texts[0], "x")], "doc_id long, text string, tox_score string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(7777, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.with_scores(docs, model, ["doc_id", "text"]).collect()
    assert len(got) == 203 and all(0 <= r.tox_score <= 1 for r in got)
    assert sum((r.tox_score >= 0.3) == (y[r.doc_id] > 0) for r in got if r.doc_id < 200) > 190
    assert toxicity.with_scores(docs.limit(0), toxicity.fit_toxicity(docs.limit(0), labels.limit(0)), ["doc_id", "text"]).count() == 0
