import random

import pytest

import llm.components as module
from llm.components import connected


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    return sorted((x, find(x)) for x in nodes)


@pytest.mark.parametrize("chunk,hot", [(2_000_000, 100_000), (7, 5)])
def test_against_union_find(spark, monkeypatch, chunk, hot):
    """Long paths, hubs of any id and random links; small chunks leave the work to the rounds, and make hubs hot."""
    monkeypatch.setattr(module, "HOT_EDGES", hot)
    rnd = random.Random(3)
    path = rnd.sample(range(1000, 2000), 300)
    links = list(zip(path, path[1:]))
    links += [(5000, x) for x in rnd.sample(range(4000, 6000), 200)] + [(rnd.randrange(8000, 9000), rnd.randrange(8000, 9000)) for _ in range(500)]
    links += [(7, 7), (-3, 9), (9, -3), (2**63 - 1, 2**63 - 2)] * 3
    rnd.shuffle(links)
    got = connected(spark.createDataFrame(links, "x long, y long").repartition(8), chunk).collect()
    assert sorted(tuple(r) for r in got) == brute(links)


def test_empty(spark):
    assert connected(spark.createDataFrame([], "x long, y long")).count() == 0
