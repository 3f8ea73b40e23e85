import random
import re

import pytest

from llm.components import connected
from llm.jaccard_join import jaccard_components, one_of_each_group


def sets_of(text, shingle):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])


def brute(rows, shingle, percent):
    sets = [sets_of(t, shingle) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)]


@pytest.mark.parametrize("shingle,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_against_brute_force(spark, shingle, percent, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 90))] for _ in range(12)]
    rows = []
    for i in range(260):
        words = list(rnd.choice(bases)) if rnd.random() < 0.7 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(9))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            if words:
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary).upper()
        rows.append((i, " ".join(words[: rnd.choice([len(words), len(words) - 1, len(words)])])))
    rows += [(300, None), (301, " "), (302, "  "), (303, "one Word"), (304, "ONE word"), (None, rows[0][1]), (5, rows[5][1]), (305, "z " * 4000)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, x string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, shingle, percent).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(rows, shingle, percent), key=key)
    if seed == 1:
        left = {r.doc_id for r in one_of_each_group(docs, shingle, percent).collect()}
        assert left == {c for _, _, c in got}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 499)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 499: 499, 500: 499}


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
