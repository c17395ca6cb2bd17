"""Betweenness against counting all shortest paths, and the graph that the query takes."""

from __future__ import annotations

import random
from collections import deque


def by_paths(edges):
    """Of each node: the share of the shortest paths between every two others that it lies on."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)

    def search(s):
        dist, paths, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            v = queue.popleft()
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        return dist, paths

    found, n = {v: search(v) for v in near}, len(near)
    total = dict.fromkeys(near, 0.0)
    for s, (ds, ps) in found.items():
        for t in ds:
            for v in near:
                if v not in (s, t) and v in ds and ds[v] + found[v][0][t] == ds[t]:
                    total[v] += ps[v] * found[v][1][t] / ps[t]
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_against_all_shortest_paths(spark):
    from caseloom.operators import graph

    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample("abcdefghijklm", 2))) for _ in range(18)} | {("x", "y"), ("y", "z")}
    found = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(sorted(edges), "a string, b string")).collect()}
    want = by_paths(edges)
    assert found.keys() == want.keys() and all(abs(found[v] - want[v]) < 1e-6 for v in want)


def test_registered_query_covers_people(spark, tmp_path):
    from caseloom.plans.core import REGISTRY

    rows = [(1, ["Ann", "Bo"], "Grenby", "theft", False), (2, ["Bo", "Cy"], "Grenby", "fraud", False), (3, ["Cy", "Di"], "Grenby", "fraud", True)]
    spark.createDataFrame(rows, "id bigint, people array<string>, location string, identified_crime string, is_deleted boolean").write.parquet(str(tmp_path / "facts.parquet"))
    assert {r.node: r.betweenness for r in REGISTRY.queries["g8_betweenness"](spark, str(tmp_path)).collect()} == {"Ann": 0.0, "Bo": 1.0, "Cy": 0.0}


def test_no_edges(spark):
    from caseloom.operators import graph

    assert graph.betweenness(spark.createDataFrame([], "a string, b string")).collect() == []


def test_sampled_sources(spark):
    """As many sources as nodes give the exact values; fewer an estimate that is near on average."""
    import random

    from caseloom.operators import graph

    rng = random.Random(1)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 1) for a, b in {(rng.randrange(40), rng.randrange(40)) for _ in range(90)} if a < b], "a string, b string, n long")
    exact = {r["node"]: r["betweenness"] for r in graph.betweenness(edges).collect()}
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(edges, sources=1000).collect()} == exact
    part = {r["node"]: r["betweenness"] for r in graph.betweenness(edges, sources=20).collect()}
    assert part.keys() == exact.keys() and abs(sum(part.values()) - sum(exact.values())) < 0.3 * sum(exact.values())


def test_leaves_are_no_sources(spark, monkeypatch):
    """Trees hung on a graph, stars and lone edges: no search from a leaf, the same values."""
    from caseloom.operators import graph

    rng = random.Random(6)
    edges = {tuple(sorted(rng.sample("abcdefgh", 2))) for _ in range(14)} | {("a", "p"), ("a", "q"), ("q", "r"), ("b", "s"), ("y", "z"), ("u", "v"), ("u", "w"), ("u", "x")}
    started = []
    ranged = type(spark).range
    monkeypatch.setattr(type(spark), "range", lambda self, *a: started.append(a[1]) or ranged(self, *a))
    found = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(sorted(edges), "a string, b string")).collect()}
    want = by_paths(edges)
    assert found.keys() == want.keys() and all(abs(found[v] - want[v]) < 1e-6 for v in want)
    assert started == [len(want) - 6]  # p, r, s, and three of the star; y and z are each other's neighbour
