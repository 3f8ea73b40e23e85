import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import llm.collocations as co
from llm.collocations import _score, collocations


def brute(rows, top, longest, least, inside):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = defaultdict(int)
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                held[lang, p[i : i + m]] = max(held[lang, p[i : i + m]], a)
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        if 100 * held[lang, p] < inside * a:
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for lang, found in out.items() for i, r in enumerate(sorted(found)[:top]))


def cases(seed, size):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "é", "x\xa0y", "Ab", "ab", "\x85", "z" * 70, "z" * 69 + "y"]
    fixed = [[rnd.choice(words) for _ in range(rnd.randrange(2, 8))] for _ in range(8)]
    rows = []
    for _ in range(size):
        parts = [rnd.choice(fixed) if rnd.random() < 0.6 else [rnd.choice([*words, f"rare{rnd.randrange(900)}"]) for _ in range(rnd.randrange(5))] for _ in range(rnd.randrange(6))]
        text = "".join(w + rnd.choice([" ", " ", " ", " \t", ". ", "\n", ",", "\r", "!"]) for p in parts for w in p)
        rows.append((rnd.choice(["en", "en", "fr", None, "und", ""]), text))
    return rows


@pytest.mark.parametrize("seed,top,longest,least,inside,bits,chunk", [(1, 2000, 5, 10, 100, 16, 1 << 22), (2, 7, 4, 5, 80, 3, 500), (3, 2000, 2, 3, 100, 16, 1 << 22), (4, 2000, 6, 2, 50, 4, 2000)])
def test_against_brute_force(spark, monkeypatch, seed, top, longest, least, inside, bits, chunk):
    """Also with so few counters that they rule out next to nothing, and in several chunks a batch."""
    monkeypatch.setattr(co, "_bits", lambda total, share: bits)
    monkeypatch.setattr(co, "CHUNK", chunk)
    rows = cases(seed, 500) + [("en", None), (None, None), ("en", ""), ("fr", " \t\n..,"), ("en", "same " * 5000), ("en", "a b c d e f g " * 40)] + [("es", "one two three.")] * 30
    docs = spark.createDataFrame([(lang, t, "x", 1, 2) for lang, t in rows], "lang string, text string, phrase string, n int, rank int")
    got = collocations(docs, top, longest, least, inside)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, top, longest, least, inside)
    assert len(want) > 20 and {r[0] for r in want} == {"en", "fr", "und", "", "es"}
    assert sorted(map(tuple, got.collect())) == want


def given_windows(monkeypatch, docs):
    """Result of a small run, and the windows that its tasks gave to the rollup."""
    frames, rollup = [], type(docs).rollup
    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "rollup", lambda self, *cols: (frames.append(self), rollup(self, *cols))[1])
        rows = collocations(docs, 2000, 5, 10, 100).collect()
    return sorted(map(tuple, rows)), frames[0]


def test_windows_are_given_once_a_task(spark, monkeypatch):
    """Neither chunks nor splits multiply them: before, every chunk of every split gave its own."""
    monkeypatch.setattr(co, "CHUNK", 500)
    rows = cases(6, 600)
    schema, tasks = "lang string, text string", co.CORE_TASKS * spark.sparkContext.defaultParallelism
    got, windows = given_windows(monkeypatch, spark.createDataFrame(rows, schema).repartition(8 * tasks))
    assert got == brute(rows, 2000, 5, 10, 100)
    assert windows.rdd.getNumPartitions() == tasks
    kinds = windows.drop("n").distinct().count()
    assert windows.groupBy(*windows.columns[:-1], F.spark_partition_id()).count().where("count > 1").count() == 0
    assert windows.count() <= tasks * kinds
    _, one = given_windows(monkeypatch, spark.createDataFrame(rows, schema).repartition(1))
    assert one.count() == kinds


@pytest.mark.parametrize("held,held_bytes", [(40, 1 << 20), (1 << 20, 60)])
def test_windows_beyond_what_a_task_holds(spark, monkeypatch, held, held_bytes):
    """They are given out early, none lost and none twice."""
    monkeypatch.setattr(co, "CHUNK", 500)
    monkeypatch.setattr(co, "HELD", held)
    monkeypatch.setattr(co, "HELD_BYTES", held_bytes)
    monkeypatch.setattr(co, "GIVEN", 7)
    rows = cases(7, 400)
    got, windows = given_windows(monkeypatch, spark.createDataFrame(rows, "lang string, text string").repartition(1))
    assert got == brute(rows, 2000, 5, 10, 100)
    assert windows.count() > windows.drop("n").distinct().count()


def test_scores_beyond_64_bits(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(200):
        left, right = rnd.randrange(100, 10 ** rnd.randrange(3, 15)), rnd.randrange(100, 10 ** rnd.randrange(3, 15))
        a = rnd.randrange(1, min(left, right) + 1)
        rows.append((a, rnd.randrange(max(left, right), 10**15), left, right))
    rows += [(10**14, 10**15, 10**14, 10**14), (3, 7, 3, 7)]
    frame = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r.s for r in frame.select(_score(*map(F.col, "anlr")).alias("s")).collect()]
    assert got == [1000 * a * n // (left * right) for a, n, left, right in rows]


def test_empty(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([("en", "a b a b")], "lang string, text string")).count() == 0
