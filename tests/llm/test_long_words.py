"""Long words that sums modulo 2**64 can't tell apart (the Thue-Morse sequence and its complement) are different words, lines and
units to every operator that names them by hashes."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece

from llm.jaccard_join import jaccard_components
from llm.packing import UnitEncoder, vocabulary_path
from llm.quality import measure
from llm.sentencepiece_codec import encode_documents
from llm.substring_dedup import remove_repeated_passages
from llm.vectext import BYTE_KEYS, OTHER_KEYS, prefix_sums, range_hash, text_hash

SIZES = [64, 512, 1024, 1025, 2048, 4096]


def twins(size):
    a, b = "a", "b"
    while len(a) < size // 2 * 2 and len(a) * 2 <= size:
        a, b = a + b, b + a
    return a + "z" * (size - len(a)), b + "z" * (size - len(b))


def laid(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def test_twins_collide_in_plain_sums():
    data, at = laid(twins(1024))
    assert len(set(range_hash(prefix_sums(BYTE_KEYS[data]), at[:-1], at[1:]).tolist())) == 1


@pytest.mark.parametrize("size", SIZES)
def test_hashes_lines_and_units(size):
    a, b = twins(size)
    data, at = laid([a, b])
    for keys, person in ((BYTE_KEYS, b""), (OTHER_KEYS, b"second")):
        assert len(set(text_hash(data, prefix_sums(keys[data]), at[:-1], at[1:], person).tolist())) == 2
    data, at = laid([f"{a}\n{b}\n{a}"])
    assert measure(data, at, {})["n_dup_lines"][0] == 1
    tool = UnitEncoder(vocabulary_path("word_bpe_49k.json"))
    data, at = laid([f"{a} {b}", b, a])
    ids, offsets = tool.encode(data, at)
    for i, text in enumerate([f"{a} {b}", b, a]):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids


def test_in_spark(spark):
    rows = [(10 * k + j, w) for k, size in enumerate(SIZES) for j, w in enumerate(twins(size))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(docs, shingle=4, percent=85).collect()} == {i: i for i, _ in rows}
    tool = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    for r in encode_documents(docs).collect():
        want = np.array(tool.encode(dict(rows)[r.doc_id]), "<u4")
        assert r.roundtrip and r.ids_crc32 == zlib.crc32(want.tobytes())
    passage = [f"w{i}" for i in range(49)]
    texts = [(i, " ".join([*passage, w])) for i, w in rows]
    got = remove_repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed, r.kept_sha256) for r in got} == {(i, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts}
