"""Shortest paths from both ends against a search over all paths."""

import random

from lodestrata.operators import graph as G
from lodestrata.operators.graph import shortest_path


def brute_force(edges, a, b, hops):
    best = {}
    for s, d, w in edges:
        for x, y in ((s, d), (d, s)):
            best[x, y] = max(best.get((x, y), 0), w)
    front = [[a]]
    for depth in range(hops + 1):
        done = sorted(p for p in front if p[-1] == b)
        if done:
            p = done[0]
            ws = [best[e] for e in zip(p, p[1:])]
            return depth, p, sum(ws) / len(ws) if ws else None
        front = [[*p, y] for p in front for x, y in best if x == p[-1] and y not in p]
    return -1, [], None


def test_paths_equal_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(14), rng.randrange(14), rng.randrange(1, 9) / 10) for _ in range(20)] + [(20, 21, 0.5), (21, 20, 0.9), (30, 30, 0.1)]
    pairs = [(rng.randrange(14), rng.randrange(14)) for _ in range(25)] + [(20, 21), (21, 21), (99, 99), (99, 1), (1, 30), (20, 21)]
    e, p = spark.createDataFrame(edges, "src long, dst long, strength double"), spark.createDataFrame(pairs, "a long, b long")
    for hops in (0, 1, 4, 5):
        got = sorted((r.a, r.b, r.distance, tuple(r.vertices), None if r.strength is None else round(r.strength, 9)) for r in shortest_path(e, p, hops).collect())
        want = []
        for a, b in pairs:
            d, path, w = brute_force(edges, a, b, hops)
            want.append((a, b, d, tuple(path), None if w is None else round(w, 9)))
        assert got == sorted(want, key=lambda r: r[:4])
    weak = shortest_path(e, p.filter("a = 20"), 3, least=0.8).collect()
    assert {(r.distance, r.strength) for r in weak} == {(1, 0.9)}


def test_two_frontiers_hold_fewer_rows(spark, monkeypatch):
    """A tree of four branches a vertex, both ends leaves: half the hops from each end."""
    edges = spark.createDataFrame([((i - 1) // 4, i, 1.0) for i in range(1, 1365)], "src long, dst long, strength double")
    pairs = spark.createDataFrame([(341 + 0, 341 + 5), (341, 1364)], "a long, b long")
    rows, stored = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, name, **kw: (out := stored(df, name, **kw), rows.append(out.count()) if name == "frontier" else None)[0])
    found = sorted(r.distance for r in shortest_path(edges, pairs, 10).collect())
    two = sum(rows)
    rows.clear()
    both = edges.union(edges.selectExpr("dst", "src", "strength"))
    G.distances(both, pairs.select("a").distinct(), 10).count()
    assert found == [4, 10] and two < sum(rows) / 2
