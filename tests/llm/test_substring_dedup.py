import hashlib
import random
import re

import pytest

import llm.batches

from llm.substring_dedup import remove_repeated_passages


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (2**63 - 1 if i is None else i):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept.encode()))
    return out


@pytest.mark.parametrize("window,levels,batches", [(8, 1, 64), (10, 2, 2), (12, 3, 64), (50, 3, 64), (50, 3, 2)])
def test_against_brute_force(spark, monkeypatch, window, levels, batches):
    """Also with the registered window, and in batches of several chunks."""
    monkeypatch.setattr(llm.batches, "LEAST_BATCHES", batches)
    rnd = random.Random(window)
    vocabulary = [f"w{k}é" for k in range(40)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(window // 2, 4 * window))] for _ in range(6)]
    rows = []
    for i in range(250):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(20))] for _ in range(rnd.randrange(4))]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(w for p in parts for w in p)))
    rows += [(250, None), (251, " \n "), (252, "one"), (None, " ".join(passages[0] * 2)), (rows[9][0], rows[8][1]), rows[10], (253, " ".join(["same"] * 3000)), (254, " ".join(["same"] * 500))]
    if batches == 2:
        rows += [(1000 + i, " ".join([*rnd.choice(passages), f"x{i % 40}", *rnd.choice(passages), *(rnd.choice(vocabulary) for _ in range(900))])) for i in range(120)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int")
    got = [tuple(r) for r in remove_repeated_passages(docs, window=window, levels=levels).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sum(r[2] for r in got) > 1000
    assert sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in got), key=key) == sorted(brute(rows, window), key=key)


def test_empty(spark):
    assert remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
