import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import llm.quality as module
from llm.packing import vocabulary_path
from llm.quality import WordCounter, _scripts, measure, passing, quality_rules

PATHS = {name: vocabulary_path(file) for name, file in module.VOCABULARIES.items()}


def brute(text, counters):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    chars = sum(map(len, words))
    out = [len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, sum(hit)]
    for counter in counters.values():
        tokens = [t for w in words for t in counter.encode([w])[0]]
        n = len(tokens)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(tokens).values()) if n else 0
        fallback = sum(bool(counter.fallback[t]) for t in tokens)
        out += [n, chars / max(n, 1), fallback / max(n, 1), entropy]
    return out


def test_measures_against_brute_force():
    rnd = random.Random(1)
    alphabet = ["a", "bb", "C#", "é", "日本", " ", " ", "\n", "\t", "\x0b", "$%", "λ", "\x85", "😀", "𐍈"]
    texts = ["", " ", "\n\n", "one", "a b c a b c a", "x\nx\nx \nx", "\n a\n a"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(90))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    counters = {name: WordCounter(path) for name, path in PATHS.items()}
    got = measure(np.frombuffer(b"".join(raw), np.uint8), bounds, counters)
    assert all(got[f"{name}_fallback_share"].max() > 0 for name in PATHS)
    for i, text in enumerate(texts):
        assert [float(got[k][i]) for k in got] == pytest.approx(brute(text, counters)), repr(text)


def test_long_ranges_by_other_hash():
    """Lines that sums modulo 2**64 can't tell apart (Thue-Morse) count as different."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    raw = f"{a}\n{b}\n{a}".encode()
    got = measure(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), {})
    assert got["n_dup_lines"][0] == 1


def verdicts(rows, counters):
    """The bands, from scratch: medians by (language, script), else by script."""
    own, out = [], []
    for i, text, lang in rows:
        m = brute(text or "", counters)
        script = _scripts(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0]
        own.append((i, m, lang or "", script, m[0] < 50 or 2 * m[4] > m[0]))
    middle = lambda values: sorted(values)[(len(values) - 1) // 2]
    three = lambda x: math.floor(x * 1000 + 0.5) / 1000
    for i, m, lang, script, failed in own:
        group = [o[1] for o in own if not o[4] and o[2] == lang and o[3] == script]
        if len(group) < module.LEAST_ROWS:
            group = [o[1] for o in own if not o[4] and o[3] == script]
        fine = not failed
        for v in range(len(counters)):
            for k, (name, floor) in enumerate(module.FLOORS.items()):
                place, steady = 6 + 4 * v + k, lambda x, v=v: math.sqrt(x[5 + 4 * v] / (x[5 + 4 * v] + module.STEADY))
                if fine:
                    mid = middle([three(g[place]) for g in group])
                    dev = middle([three(abs(g[place] - mid) * steady(g)) for g in group])
                    fine = (name == "token_entropy" and m[place] > mid) or abs(m[place] - mid) * steady(m) <= max(module.SPREADS * dev, floor * mid if name == "chars_per_token" else floor)
        out.append((i, failed, fine))
    return out


def test_verdicts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAST_ROWS", 20)
    rnd = random.Random(7)
    vocabularies = {"en": ["the", "people", "house", "water", "every", "great", "care", "before"], "de": ["das", "Haus", "Wasser", "jeden", "größe", "Sorgfalt", "früher"], "ru": ["вода", "дом", "люди", "каждый", "раньше"]}
    rows = []
    for i in range(160):
        lang = rnd.choice(["en", "en", "de", "ru", None])
        words = [rnd.choice(vocabularies[lang or "en"]) + str(rnd.randrange(40) if rnd.random() < 0.3 else "") for _ in range(rnd.choice([30, 60, 120, 900]))]
        if rnd.random() < 0.2:
            words = [w + rnd.choice(["###", "&&&", "%%%"]) for w in words]
        rows.append((i, " ".join(words), lang))
    rows += [(500, None, "en"), (501, "", None)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = {i: (failed, kept) for i, failed, kept in verdicts(rows, {name: WordCounter(path) for name, path in PATHS.items()})}
    assert got == want and 5 < sum(not f and not k for f, k in want.values()) < 60


def test_scripts():
    texts = ["plain words", "ελληνικά", "Привет мир", "日本語の文", "漢字文字", "123 !?", ""]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    assert _scripts(np.frombuffer(b"".join(raw), np.uint8), bounds) == ["latin", "greek", "cyrillic", "han", "han", "none", "none"]


def test_bands_and_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAST_ROWS", 20)
    rnd = random.Random(2)
    common = ["the", "people", "of", "this", "house", "see", "water", "every", "day", "and", "work", "with", "great", "care", "before", "night"]
    rows = [(i, " ".join(rnd.choice(common) for _ in range(80)), "en") for i in range(100)]
    rows += [(200, " ".join("".join(chr(rnd.randrange(0x2600, 0x26FF)) for _ in range(4)) for _ in range(80)), "en"), (201, None, "en"), (202, "", None), (203, "w " * 60, "en"), (None, rows[3][1], "en"), (4, rows[4][1], "en"), (204, rows[5][1], None), (205, "x" * 100000, "en")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, kept string")
    got = {}
    for r in quality_rules(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[4]) == 2
    kept = {i for i, rs in got.items() if rs[0].kept}
    assert kept == {*range(100), None, 204}
    assert got[203][0].base_failed and not got[200][0].base_failed and got[201][0].n_words == 0
    left = passing(docs)
    assert left.columns == docs.columns and left.count() == 103


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
