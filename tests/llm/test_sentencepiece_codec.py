import random
import zlib

import numpy as np

from llm.packing import vocabulary_path
from llm.sentencepiece_codec import PieceAutomaton, decode_documents, encode_documents

TOOL = PieceAutomaton(vocabulary_path("piece_bpe_32k.model"))
PIECES = {s: i for i, s in enumerate(TOOL.surface) if s and not TOOL.is_fallback[i]}


def brute(text):
    """Best score by dynamic programming over all pieces, and the ids of the path that prefers longer last pieces."""
    raw = (" " + text).encode() if text else b""
    best = [(0.0, [])] + [None] * len(raw)
    for end in range(1, len(raw) + 1):
        found = []
        for size in range(min(end, 48), 0, -1):
            if best[end - size] and raw[end - size : end] in PIECES:
                i = PIECES[raw[end - size : end]]
                found.append((best[end - size][0] + TOOL.scores[i], best[end - size][1] + [i]))
        for size in range(1, 5):
            part = raw[end - size : end] if size <= end else b""
            try:
                if part and len(part.decode()) == 1 and best[end - size]:
                    found.append((best[end - size][0] + TOOL.fallback, best[end - size][1] + [int(TOOL.byte_ids[b]) for b in part]))
            except UnicodeDecodeError:
                pass
        top = None
        for f in found:
            if top is None or f[0] > top[0]:
                top = f
        best[end] = top
    return best[len(raw)]


def cases():
    rnd = random.Random(4)
    alphabet = ["a", "the", " ", " ", "\n", "é", "ing", "日", "☃", "▁", "\t", "😀", "x", "1", "  ", "ß", "\x00"]
    return ["", " ", "   ", "Hello  world\n\tfoo  ", "▁▁", "aaaaaaaaaaaaaaaaaaaa", *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(25))) for _ in range(250))]


def test_encoding_against_brute_force():
    texts = cases()
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    ids, offsets, scores = TOOL.encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert TOOL.units
    for i, text in enumerate(texts):
        want = brute(text)
        assert scores[i] == want[0], repr(text)
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want[1], repr(text)


def test_round_trip_in_spark(spark):
    rows = [(i, t) for i, t in enumerate(cases())] + [(900, None), (None, "nobody"), (3, "again"), (901, "long " * 30000), (902, "y" * 20000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    coded = encode_documents(docs)
    got = coded.collect()
    assert len(got) == len(rows) and all(r.roundtrip for r in got)
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.text) for r in decode_documents(coded).collect()], key=key) == sorted([(i, t or "") for i, t in rows], key=key)


def test_ids_are_those_of_sentencepiece(spark):
    """Word marks that stand in a text are left out: sentencepiece takes them for blanks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    rnd = random.Random(5)
    words = [s.decode().strip() for s in rnd.sample(sorted(PIECES), 3000)]
    texts = [t for t in cases() if "▁" not in t] + ["All", "All of this, unbelievably; re-tokenised!", "  " * 40 + "x" + " " * 33]
    texts += ["".join(rnd.choice(words) + rnd.choice(["", "", " ", "  ", "\n"]) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode_documents(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i] == model.encode(text), repr(text)


def test_empty(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
