import heapq
import random
from collections import Counter

import pandas as pd

from trailspan.plans.registry import QUERIES


def test_network_of_all_lines_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    # a hot supplier, parallel lines of unlike price, and two parts of the network that no line joins
    pairs = [(1, rng.randrange(1, 15)) for _ in range(25)] + [(rng.randrange(2, 8), rng.randrange(1, 15)) for _ in range(25)] + [(s, p) for s, p in ((20, 90), (20, 91), (21, 91), (20, 90))]
    rows = [(s, p, float(rng.choice([1, 20, 50, 50])), rng.randrange(100, 90000) / 100, rng.choice([0.0, 0.05, 0.1])) for s, p in pairs]
    pd.DataFrame(rows, columns="l_suppkey l_partkey l_quantity l_extendedprice l_discount".split()).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame([(s, s % 3) for s in (*range(1, 9), 20, 21, 30)], columns=["s_suppkey", "s_nationkey"]).to_parquet(tmp_path / "supplier.parquet")
    run = lambda name: [r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()]
    edges = [(s, 1000000 + p, round(price * 100), q == 50) for s, p, q, price, _ in rows]

    def distances(source, some, weight):
        best, queue = {}, [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if u in best:
                continue
            best[u] = d
            for a, b, w, _ in some:
                for x, y in ((a, b), (b, a)):
                    if x == u and y not in best:
                        heapq.heappush(queue, (d + weight(w), y))
        return best

    def parts(some):
        return {n: min(distances(n, some, lambda w: 1)) for e in some for n in e[:2]}

    whole = parts(edges)
    assert {r["node"]: r["component"] for r in run("network_components")} == whole and len(set(whole.values())) == 2
    nodes = Counter(whole.values())
    profile = {r["component"]: (r["nodes"], r["edges"], r["weight"], r["cycles"], r["has_cycle"]) for r in run("network_profile")}
    for c, n in nodes.items():
        mine = [w for a, _, w, _ in edges if whole[a] == c]
        assert profile.pop(c) == (n, len(mine), sum(mine), len(mine) - n + 1, len(mine) >= n)
    assert not profile
    assert {r["node"]: r["degree"] for r in run("network_degree")} == Counter(n for e in edges for n in e[:2])
    used = {e[0] for e in edges}
    sources = {min(s for s in used if s % 3 == k) for k in range(3)}
    for name, weight in (("network_levels", lambda w: 1), ("network_distances", lambda w: w)):
        got = {(r["source"], r["node"]): r["distance"] for r in run(name)}
        assert got == {(s, n): d for s in sources for n, d in distances(s, edges, weight).items()}
    before = parts([e for e in edges if e[3]])
    want = {c: (n, sum(whole[x] == c for x in before), len({before[x] for x in before if whole[x] == c})) for c, n in nodes.items()}
    assert {r["component"]: (r["nodes"], r["nodes_before"], r["components_before"]) for r in run("network_whatif")} == want
