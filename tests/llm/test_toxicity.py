import math
import random
import zlib

import pytest

from llm.toxicity import _EDGE, REPORTING, STEMS, WINDOW, Lexicon, attributed, fit_toxicity, quoted, score_toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_distances():
    rnd = random.Random(1)
    terms = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 9))) for _ in range(60)}
    lexicon = Lexicon(sorted(terms), [])
    for _ in range(1500):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 10)))
        near = {t for t in terms if len(t) >= 5 and edits(t, word) == 1}
        found = lexicon.near(word)
        assert (found in near) if near else found is None
        hit = lexicon.look_up(word)
        assert (hit is not None) == (word in terms or (bool(near)))


def test_weak_terms_at_one_edit():
    """Terms far down a full lexicon are found misspelled, too."""
    rnd = random.Random(3)
    terms = ["".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(4000)]
    lexicon = Lexicon(terms, [])
    for term in terms[::400] + terms[-5:]:
        for word in (term[:4] + "z" + term[5:], term[:4] + term[5:], term[:4] + "z" + term[4:]):
            assert lexicon.look_up(word) and edits(lexicon.look_up(word)[1], word) == 1


def test_quotation():
    tokens = 'he said "you idiot there" and left you idiot'.split()
    assert [quoted(tokens, i) for i, t in enumerate(tokens) if "idiot" in t] == [True, False]
    assert quoted(['"idiot"'], 0) and not quoted(["idiot"], 0)


def test_attribution():
    tokens = "she said he was an idiot . You idiot".split()
    assert [attributed(tokens, i) for i, t in enumerate(tokens) if t == "idiot"] == [True, False]
    assert not attributed("they said yes. you idiot".split(), 4) and not attributed(["idiot"], 0)


def score(text, lexicon, beta):
    """The score from scratch: every word against every term."""
    tokens = (text or "").lower().split()
    counts = {(kind, how): 0 for kind in range(3) for how in range(3)}
    for i, token in enumerate(tokens):
        word = token.strip(_EDGE)
        if word in lexicon.terms:
            kind = 0
        elif any(word[:k] in lexicon.stems and len(word) >= k for k in STEMS):
            kind = 1
        elif any(len(t) >= 5 and edits(t, word) == 1 for t in lexicon.terms):
            kind = 2
        else:
            continue
        said = False
        for before in tokens[max(0, i - WINDOW) : i]:
            said = before[-1] not in ".!?" and (said or before.strip(_EDGE) in REPORTING)
        counts[kind, 2 if quoted(tokens, i) else 1 if said else 0] += 1
    plain = sum(n for (_, how), n in counts.items() if how == 0)
    x = [math.log1p(counts[k, h]) for k in range(3) for h in range(3)] + [100 * plain / max(len(tokens), 1)]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, beta)) + beta[-1]))))


def test_scores_against_brute_force(spark):
    rnd = random.Random(9)
    plain = ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randrange(3, 8))) for _ in range(150)]
    bad = ["grobnik", "smurgle", "fazzock"]
    rows, labels = [], []
    for i in range(500):
        words, toxic = [rnd.choice(plain) for _ in range(rnd.randrange(5, 40))], rnd.random() < 0.3
        for _ in range(rnd.randrange(1, 4) if toxic or rnd.random() < 0.06 else 0):
            term = rnd.choice(bad)
            term = rnd.choice([term, term, term[:3] + term[4:], term + "s", f"{term}!"])
            words.insert(rnd.randrange(len(words)), term if toxic else rnd.choice([f'"{term}"', f"said {term}"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows + [(600, None)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon, beta = fit_toxicity(docs, known)
    assert lexicon.terms and lexicon.stems
    got = {r.doc_id: r.score for r in score_toxicity(docs, known).collect()}
    assert got == pytest.approx({i: score(t, lexicon, beta) for i, t in rows + [(600, None)]})


def test_held_out_accuracy(spark):
    rnd = random.Random(2)
    plain = ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randrange(3, 8))) for _ in range(300)]
    bad = ["grobnik", "smurgle", "fazzock", "quimber"]
    rows, labels = [], []
    for i in range(1200):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(5, 60))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        elif rnd.random() < 0.1:
            words.insert(2, f'"{rnd.choice(bad)}"')
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "oh grobnuk you"), (2003, "oh friend you"), (None, "smurgle smurgle"), (3, rows[3][1]), (2004, "x " * 50000)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if by[i].held_out]
    assert {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0} == set(held) and len(held) > 150
    assert sum(by[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert by[2002].score > by[2003].score and by[2000].score == by[2001].score
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score < 1e-9 for r in score_toxicity(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).collect()] == [True]
    assert score_toxicity(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
