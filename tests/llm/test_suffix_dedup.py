import hashlib
import random

import pytest

import llm.batches
import llm.suffix_dedup as module
from llm.suffix_dedup import remove_repeated_bytes, without_repeated_bytes

NONE = 2**63 - 1


def brute(rows, length):
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), NONE if i is None else i
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], NONE), i)
    out = []
    for i, t in rows:
        b, me = (t or "").encode(), NONE if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < me:
                gone[p : p + length] = b"\x01" * length
        spans = bytes(gone).replace(b"\x00", b" ").split()
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), kept))
    return out


def rows_for(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rnd.randrange(3, 30))) for _ in range(8)]
    rows = [(i, " ".join((p := rnd.choice(passages))[rnd.randrange(len(p) // 2) :] if rnd.random() < 0.5 else word() for _ in range(rnd.randrange(8)))) for i in range(220)]
    rows += [(300, None), (301, "a" * 5000), (302, "a" * 700), (None, passages[0]), (8, rows[9][1]), rows[10], (303, "é" * 60), (304, "xé" + "é" * 60), (305, passages[1] + "\x00" * 90), (306, "\x00" * 80)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,seed,part,hot,batches", [(20, 1, 3 << 20, 20_000, 64), (50, 2, 3 << 20, 20_000, 64), (12, 3, 2000, 20_000, 2), (20, 5, 2000, 3, 64), (50, 6, 3 << 20, 0, 2)])
def test_against_brute_force(spark, monkeypatch, length, seed, part, hot, batches):
    """Also in small sorts, with anchors that are hot, and in batches of several chunks."""
    monkeypatch.setattr(module, "SORT_BYTES", part)
    monkeypatch.setattr(module, "HOT_SLICES", hot)
    monkeypatch.setattr(llm.batches, "LEAST_BATCHES", batches)
    rows = rows_for(seed)
    if batches == 2:
        rows += [(1000 + i, (rows[i][1] or "") + "é" * (i % 7) + f" line {i % 50} " * 200) for i in range(220)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, mark int")
    got = [tuple(r)[:5] for r in remove_repeated_bytes(docs, length).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted([r[:5] for r in brute(rows, length)], key=key)
    assert sum(r[2] for r in got) > 1000


def test_cleaned_documents(spark):
    rows = rows_for(4)
    docs = spark.createDataFrame([(i, t, len(t or ""), "src") for i, t in rows], "doc_id long, text string, n_chars long, source string")
    out = without_repeated_bytes(docs, 20)
    assert out.columns == docs.columns
    want = [(i, None if t is None else b[5].decode(errors="ignore")) for (i, t), b in zip(rows, brute(rows, 20))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = out.collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted(want, key=key)
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_empty(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
