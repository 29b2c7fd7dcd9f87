"""Operators that may meet any number of rows in a group, against brute force."""

import random

import numpy as np
import pandas as pd

from trailspan.operators import checks, coverage, joins, network


def test_short_secrets_equal_brute_force_whatever_their_number(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abÄ😀é1") for _ in range(r.randint(1, 12)))
    texts = [(i, " ".join(word() for _ in range(r.randint(0, 12)))) for i in range(120)] + [(900, None), (901, "   ")]
    secrets = [(j, " ".join(word() for _ in range(r.randint(1, 2)))) for j in range(60)] + [(60, "A"), (61, "b a"), (62, "\t"), (63, " "), (64, None), (65, texts[0][1][2:9].strip() or "a"), (65, texts[0][1][2:9].strip() or "a")]
    for i in (5, 9, 17):  # short pieces of real texts, cut inside words
        secrets.append((70 + i, " ".join(texts[i][1].split()[:2])[1:]))
    want = {(i, j) for i, t in texts for j, s in secrets if t and s and s.strip() and s.lower() in t.lower()}
    for few in (100_000, 0):  # hashes broadcast, or shuffled
        got = checks.leaked(spark.createDataFrame(texts, "i long, t string"), "t", spark.createDataFrame(secrets, "j long, s string"), "s", few=few)
        pairs = [(x.i, x.j) for x in got.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    none = spark.createDataFrame([], "j long, s string")
    assert checks.leaked(spark.createDataFrame(texts, "i long, t string"), "t", none, "s").count() == 0


def test_slates_equal_a_fold_over_the_sorted_group(spark):
    r = random.Random(5)
    rows = [(g, k, float(r.randint(50, 100)), r.sample(range(30), r.randint(1, 12))) for g in range(6) for k in range(40)] + [(7, 1, None, [1]), (None, 1, 5.0, [1]), (8, 1, 5.0, []), (8, 2, 4.0, None)]
    want = set()
    for g in range(6):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1]))
        taken = []
        for _, k, s, items in (x for x in mine if x[2] >= 0.7 * mine[0][2]):
            if len(taken) < 5 and all(len(set(items) & set(t)) / min(len(items), len(t)) <= 0.35 for _, _, t in taken):
                taken.append((k, s, items))
        want |= {(g, n + 1, k, s) for n, (k, s, _) in enumerate(taken)}
    kind = "g long, k long, s double, items array<bigint>"
    got = coverage.slate(spark.createDataFrame(rows, kind), "g", "k", "s", "items", 5, 0.7, 0.35)
    assert {tuple(x) for x in got.collect()} == want
    assert coverage.slate(spark.createDataFrame([], kind), "g", "k", "s", "items", 5, 0.7, 0.35).count() == 0


def test_overlap_of_an_item_that_all_groups_have(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 4)
    r = random.Random(7)
    sets = {g: {0} | {r.randint(1, 20) for _ in range(r.randint(0, 6))} for g in range(30)}
    rows = [(g, i) for g, s in sets.items() for i in s] + [(1, 0), (None, 0), (3, None)]
    got = {(x.a, x.b): (x.shared, x.size_a, x.size_b, x.overlap) for x in joins.overlap(spark.createDataFrame(rows, "g int, i int"), "g", "i").collect()}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])):
                want[a, b] = (n, len(sets[a]), len(sets[b]), n / min(len(sets[a]), len(sets[b])))
    assert got == want


def test_a_dense_blob_is_snapped_as_if_all_its_points_were_compared():
    r = np.random.default_rng(2)
    n = 3_000
    blob = pd.DataFrame({"ordinal": r.permutation(n) * 3, "x": r.uniform(-20, 20, n), "y": r.uniform(-20, 20, n)})
    got = network._snap_blob(blob, 1.0)
    ordered = blob.sort_values("ordinal", ignore_index=True)
    x, y, node = ordered["x"].to_numpy(), ordered["y"].to_numpy(), np.full(n, -1)
    for i in range(n):
        if node[i] < 0:
            mine = (node < 0) & (np.hypot(x - x[i], y - y[i]) <= 1.0)
            node[mine] = ordered["ordinal"][i]
    assert (got["node_id"].to_numpy() == node).all() and (got["ordinal"].to_numpy() == ordered["ordinal"]).all()
    centre = ordered.assign(node=node).groupby("node")[["x", "y"]].transform("mean")
    assert np.allclose(got[["node_x", "node_y"]], centre) and (got["moved"] <= 1.0).all()
