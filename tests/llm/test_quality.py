import random
import re

import numpy as np

from trailspan.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_counts_equal_brute_force():
    rng = random.Random(6)
    parts = ["a", "b", "é", "😀", " ", "\n", "\t", " ", "#", "|", "\x0b", "x y z", "\x85"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert quality.text_stats(text)[:5] == brute(text), repr(text)


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(1)
    points = rng.normal(0, 1, (2000, 2))
    forest = quality.fit_forest(points, 100, 256, 3)
    inner, outer = quality.anomaly(forest, rng.normal(0, 0.3, (50, 2))), quality.anomaly(forest, rng.normal(0, 0.3, (50, 2)) + 6)
    assert inner.max() < outer.min()


def make(n, rng):
    words = "the of thon ansh erly onti heat blen tion".split()
    good = [" ".join(rng.choice(words) + str(rng.randrange(50)) if rng.random() < 0.02 else rng.choice(words) + rng.choice(words) for _ in range(rng.randrange(80, 300))) for _ in range(n)]
    junk = [" ".join(rng.choice(["|||", "##", "%%$", "word"]) + str(rng.randrange(9999)) for _ in range(rng.randrange(80, 300))) for _ in range(n // 5)]
    return good, junk


def test_judge(spark):
    good, junk = make(150, random.Random(2))
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 1) for i, t in enumerate(junk)] + [(5000, None, 1), (5001, "", 1), (5002, "w " * 40000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(1000 + i, 0) for i in range(20)] + [(9, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].kept for i in range(150)) >= 143
    assert sum(got[1000 + i].kept for i in range(30)) <= 3
    assert not any(got[i].kept for i in (5000, 5001, 5002)) and got[5002].n_repeat_words == 40000
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).where("kept").count() > 100
