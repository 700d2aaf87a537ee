"""Components against a plain search."""

import random

from plumeria.llm.components import components


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_random_graphs_chains_and_stars(spark):
    random.seed(5)
    edges = [(random.randrange(90), random.randrange(90)) for _ in range(60)]
    edges += [(200 + k, 201 + k) for k in range(40)] + [(300, 300 + k) for k in range(1, 40)] + [(5, 5), (None, 1), (2, None), (7, 3), (3, 7)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
