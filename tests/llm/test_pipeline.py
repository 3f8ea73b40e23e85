import random
import re
import zlib

import numpy as np

import corpus_pipeline
from llm.packing import UnitEncoder, vocabulary_path
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_suffix_dedup import brute as removals


def documents():
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 160))] for _ in range(40)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(120):
        words = list(rnd.choice(base)) if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 160))]
        for _ in range(rnd.choice([0, 0, 1, 2, 30])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        text = " ".join(words)
        if rnd.random() < 0.3:
            text += "\n" + passage
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    return rows + [(500, None, "en", "s", 0), (501, "", None, "s", 0), (502, "again " * 80, "en", "s", 480)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    # Quality: the base rules; the bands keep ordinary texts.
    good = set()
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {x for x in windows if windows.count(x) > 1}
        hit = {k + d for k, x in enumerate(windows) if x in again for d in range(3)}
        if len(w) >= 50 and 100 * len(hit) <= 50 * len(w):
            good.add(i)
    assert set(seen["quality_rules"]) == good
    # Exact copies: the longest text, then the smallest id, stays.
    groups = {}
    for i in good:
        groups.setdefault(re.sub(r"\s", "", texts[i]), []).append((-len(texts[i]), i))
    single = {min(g)[1] for g in groups.values()}
    assert set(seen["exact_dedup"]) == single
    near = components([(i, texts[i]) for i in sorted(single)], 5, 80)
    heads = {c for _, _, c in near}
    assert set(seen["ngram_jaccard_join"]) == heads and len(heads) < len(single)
    want = {i: kept.decode(errors="ignore") for i, *_, kept in removals([(i, texts[i]) for i in sorted(heads)], 50)}
    assert {i: r.text for i, r in seen["suffix_array_dedup"].items()} == want
    assert all(r.n_chars == len(r.text) for r in seen["suffix_array_dedup"].values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tool = UnitEncoder(vocabulary_path("word_bpe_49k.json")).tokenizer
    pieces = []
    for i, text in want.items():
        ids = tool.encode(text, add_special_tokens=False).ids + [1]
        pieces += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(pieces)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark long, kept boolean, batch int, row long, text_sha256 string"


def test_defined_cases(spark, tmp_path):
    """Null ids, null, empty and very long texts, repeated rows, ties, and columns whose names the stages use themselves."""
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randrange(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    a, b, c, d, long = text(150), text(150), text(150), text(150), text(60_000)
    rows = [(1, a), (2, a.replace(" ", "  ")), (None, b), (3, b), (None, c), (4, d), (4, d), (5, None), (6, ""), (7, long), (8, "short one")] + [(20 + i, text(150)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, False, 7, 7, "x") for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert all((r.mark, r.kept, r.batch, r.row, r.text_sha256) == (7, False, 7, 7, "x") for r in docs.collect())
        seen[name] = sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id < 20), key=str)
    expect = lambda *ids: sorted([x for x in {*rows} if x[0] in ids] + [(None, c)], key=str)
    assert seen["exact_dedup"] == seen["ngram_jaccard_join"] == expect(2, 3, 4, 7)
    assert seen["quality_rules"] == sorted([r for r in rows if r[0] not in (5, 6, 8) and (r[0] or 0) < 20], key=str)
    assert [i for i, _ in seen["suffix_array_dedup"]] == [i for i, _ in expect(2, 3, 4, 7)]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed if r.doc_id is None or r.doc_id < 20} == {2, 3, 4, 7, None} and sum(r.doc_id == 7 for r in packed) > 10


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
