import random

import pytest

from paxcast.llm import graph


def smallest(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {(x, root(x)) for x in list(parent) if root(x) != x}


def made(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(90)]
    edges += [(500, 600 + i) for i in range(80)] + [(900 + i, 901 + i) for i in range(40)] + [(600, 900), (7, 7), (500, 601)]
    return edges


@pytest.mark.parametrize("seed", [1, 6])
def test_components_of_stars_chains_and_random_links(spark, seed):
    edges = made(seed)
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.id for r in got}) and {tuple(r) for r in got} == smallest(edges)


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
