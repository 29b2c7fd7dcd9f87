import hashlib
from collections import defaultdict

from trailspan.llm import mixing


def fill(budget, nodes):
    """Water filling in exact arithmetic by repetition: nodes are (weight, cap)."""
    share = [0.0] * len(nodes)
    left = min(budget, sum(c for _, c in nodes))
    free = set(range(len(nodes)))
    while left > 1e-9 and free:
        w = sum(nodes[i][0] for i in free)
        full = {i for i in free if share[i] + left * nodes[i][0] / w >= nodes[i][1] - 1e-9}
        if not full:
            for i in free:
                share[i] += left * nodes[i][0] / w
            break
        for i in full:
            left -= nodes[i][1] - share[i]
            share[i] = nodes[i][1]
        free -= full
    return share


def brute(docs, share, epochs, weights, seed):
    size = defaultdict(int)
    for _, n, *path in docs:
        size[tuple(path)] += n
    size = {k: v for k, v in size.items() if v}
    budgets = {(): int(share * sum(size.values()))}
    for depth in (1, 2, 3):
        nodes = sorted({k[:depth] for k in size})
        for up in {k[:-1] for k in nodes}:
            kids = [k for k in nodes if k[:-1] == up]
            caps = [epochs * sum(v for p, v in size.items() if p[:depth] == k) for k in kids]
            got = fill(budgets[up], [(weights.get("/".join(k), 1.0), c) for k, c in zip(kids, caps)])
            whole = [min(int(g + 1e-6), c) for g, c in zip(got, caps)]
            spare = min(budgets[up], sum(caps)) - sum(whole)
            for i in sorted(range(len(kids)), key=lambda i: (whole[i] >= caps[i], -round(got[i] - whole[i], 6), kids[i][-1])):
                if spare > 0 and whole[i] < caps[i]:
                    whole[i] += 1
                    spare -= 1
            budgets |= dict(zip(kids, whole))
    out = []
    for leaf, total in size.items():
        for e in range(epochs):
            need = budgets[leaf] - e * total
            for _, i, n in sorted((hashlib.md5(f"{seed}|{e}|{i}".encode()).hexdigest(), i, n) for i, n, *p in docs if tuple(p) == leaf and n):
                if need > 0:
                    out.append((i, e, min(n, need)))
                    need -= n
    return sorted(out)


def test_mix_equals_brute_force(spark):
    rows = []
    for i in range(600):
        rows.append((i, (i * 7919) % 23, f"d{i % 3}", "en" if i % 2 else "de", "hot" if i % 3 else f"s{i % 7}"))
    docs = spark.createDataFrame([(i, "w " * n, d, l_, s, 0) for i, n, d, l_, s in rows], "doc_id long, text string, domain string, lang string, source string, tokens int")
    weights = {"d0": 5.0, "d1/en": 3.0, "d2/de/hot": 0.5, "d0/de/s0": 40.0}
    for share, epochs in ((0.5, 2), (0.9, 1), (1.7, 2), (9.0, 2), (0.0, 1)):
        got = sorted((r.doc_id, r.epoch, r.take_tokens) for r in mixing.mixed(docs, share, epochs, weights, 11).collect())
        assert got == brute(rows, share, epochs, weights, 11), (share, epochs)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "d", "en", "a"), (2, "", None, None, None), (3, "x y", None, "en", None), (3, "z", None, "en", None), (None, "k", "d", "en", "a")], "doc_id long, text string, domain string, lang string, source string")
    got = sorted((r.doc_id or 0, r.take_tokens) for r in mixing.mixed(docs, 5.0, 1).collect())
    assert got == [(0, 1), (3, 3)]
    assert mixing.mixed(docs.limit(0)).count() == 0
