import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import llm.spelling as sp
from llm.spelling import near_pairs, neighbour_names, reduced_names, spelling_variants

LOW = str.maketrans(sp.UPPER, sp.LOWER)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            k = h % len(low)
            counts[low[:k] + low[k + 1 :] if h % 199 == 0 else low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w, n in words.items():
        met = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if near(w, v)]
        best = min(met, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out[w] = [n, len(met), words[best] if form[w] else None]
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), *out[w]) for w in words}


def cases(seed, size):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("aebéÿÀ") for _ in range(rnd.randrange(5, 9))) for _ in range(25)]
    def one():
        w = rnd.choice(stems[: 1 + int(rnd.expovariate(0.3)) % 25])
        for _ in range(rnd.choice([0, 0, 0, 0, 1, 1, 2, 3])):
            k = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("aebéÿÀz") + w[k:], w[:k] + rnd.choice("aAé") + w[k + 1 :]])
        return w
    return [(i, rnd.choice([" ", "\n", "_", "1"]).join(one() for _ in range(rnd.randrange(60)))) for i in range(size)]


def test_against_brute_force(spark):
    rows = cases(1, 600)
    rows += [(None, rows[0][1]), (None, None), (901, ""), (902, "12 ,."), (3, rows[3][1]), (3, rows[3][1]), *((1000 + i, "Y" * 3000 + "é" * (i % 2)) for i in range(14))]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n int, near string")
    got = spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == want
    assert sum(w[1] is not None and w[1] != w[2] for w in want) > 5, "chains of forms"
    assert {len(w[0]) for w in want} >= {6, 7, 8, 9, 3000, 3001} and got.count() == len(want)


def test_ties_and_long_chains(spark):
    """Of near words of equal n the first by code points; a chain of several forms ends in one root."""
    chain = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zzzzzz": 5, "zzzzzé": 30, "zzzzzy": 30}
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(chain.items())], "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling_variants(docs, dropped=None).collect()}
    assert got["aaaaaa"] == ("aaaaab", "aabbbb", 1) and got["aabbbb"] == (None, "aabbbb", 1)
    assert got["zzzzzz"] == ("zzzzzy", "zzzzzy", 2) and got["zzzzzy"] == (None, "zzzzzy", 2)


@pytest.mark.parametrize("symbols", [2, 8, 64])
def test_all_near_words_meet(spark, symbols):
    rnd = random.Random(symbols)
    words = sorted({"".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 6))) for _ in range(500)})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(r.near, r.word) for r in near_pairs(frame, symbols).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if near(a, b))


def test_names_of_neighbours():
    """A form's name follows from the word's sums as from the form itself."""
    words = ["abcabc", "zzzzzz", "aébcdÿ"]
    points = lambda ws: np.array([[ord(c) for c in w] for w in ws], np.uint32)
    letters = {zlib.crc32(c.encode()) % 8: c for c in "abcdefghijklmnopqrstuvwxyz"}
    for at, names in neighbour_names(points(words), 8):
        for i, w in enumerate(words):
            forms = {w} | {w[:k] + w[k + 1 :] for k in range(6)} | {w[:k] + c + w[k + d :] for k in range(7) for d in (0, 1) for c in letters.values()}
            assert set(names[at == i].tolist()) == {int(reduced_names(points([f]), 8)[0]) for f in forms}


def test_empty(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "one two")], "doc_id long, text string")).count() == 0
