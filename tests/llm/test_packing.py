import random
import zlib

import numpy as np
import pytest

from llm.packing import UnitEncoder, _Lengths, _segments, best_fit_pack, pack_lengths, vocabulary_path

PATH = vocabulary_path("word_bpe_49k.json")
ODD = ["", " ", "Don't, they'll: it's,'s <|endoftext|>x", "a" * 3000, "É,é;ß×÷é", "naïve—dash…", "é, ́,x", "x<|startoftext|>", "日本語。テスト 123,456 ＡＢ", "  a,b\x85c", "A.B.C. #tag @x --''--", "İI ſ K ,̸ ≠"]


def test_units_give_the_tokenizers_ids():
    rnd = random.Random(3)
    alphabet = "abzAZéÉß×'.,;<>|# \t\n19—日́ "
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(400)]
    tool = UnitEncoder(PATH)
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    ids, offsets = tool.encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once_and_fills_well(seed):
    rnd = np.random.default_rng(seed)
    capacity = 256
    counts = np.bincount(np.clip(rnd.lognormal(3.5, 1, 5000).astype(int), 1, capacity), minlength=capacity + 1)
    patterns = pack_lengths(counts, capacity)
    placed = np.zeros(capacity + 1, int)
    for pattern, number in patterns:
        assert sum(pattern) <= capacity
        np.add.at(placed, list(pattern), number)
    assert (placed == counts).all()
    sequences, least = sum(n for _, n in patterns), -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    assert least <= sequences <= least + max(2, least // 200)


def test_exact_triples_behind_many_that_the_counts_rule_out():
    """Twelve triples hold the only piece of 1200 once more; the one that counts allow comes after them."""
    counts = np.zeros(4097, np.int64)
    firsts = [1001 + 13 * i for i in range(12)]
    for n in [1200, 960, 966, 970, *firsts, *(1696 - a for a in firsts)]:
        counts[n] += 1
    assert _Lengths(counts).exact(1200, 2896) == ((970, 966, 960), 1)


def test_exact_complements_are_used():
    counts = np.zeros(11, int)
    counts[[7, 2, 1, 6, 4]] = [3, 3, 3, 2, 2]
    assert sorted(pack_lengths(counts, 10)) == [((6, 4), 2), ((7, 2, 1), 3)]


def test_segments_cover_ranks():
    assert _segments([((5, 5), 2), ((5, 3), 1)]) == [(5, 0, 2, 0, 0), (5, 2, 4, 0, 5), (5, 4, 5, 2, 0), (3, 0, 1, 2, 5)]


def test_pack_against_plain_tokenising(spark):
    rows = [(1, None), (2, ""), (3, "word, " * 30), (4, "many words here " * 40), (4, "many words here " * 40), (None, "nobody"), *((i, f"text number {i} " * (i % 9)) for i in range(5, 60))]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, sequence_id int")
    out = best_fit_pack(docs, capacity=64).collect()
    tool = UnitEncoder(PATH)
    want = []
    for i, text in rows:
        ids = tool.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            piece = ids[k : k + 64]
            want.append((i, k // 64, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(w[3] for w in want)
    assert len(by) <= -(-total // 64) + 2


def test_pack_empty_table(spark):
    assert best_fit_pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def optimum(lengths, capacity):
    """The least number of sequences, by trying all."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for gap in {g for g in room if g >= lengths[i]}:
            k = room.index(gap)
            go(i + 1, [*room[:k], gap - lengths[i], *room[k + 1 :]])
        go(i + 1, [*room, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_number_of_sequences_against_optimum():
    rnd, more = random.Random(1), 0
    for _ in range(1000):
        capacity = rnd.choice([10, 16, 24])
        lengths = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 10))]
        got = sum(n for _, n in pack_lengths(np.bincount(lengths, minlength=capacity + 1), capacity))
        over = got - optimum(lengths, capacity)
        assert 0 <= over <= 1
        more += over
    assert more <= 5
