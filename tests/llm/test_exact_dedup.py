import hashlib
import random
import re

from llm.exact_dedup import drop_copies, exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[bare], key=lambda g: g[:3])[3]
        out.append((i, keep, len(groups[bare]), hashlib.sha256(bare.encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["a", "b", "é ", "\tcc\n"]) for _ in range(rnd.randrange(4)))) for i in range(300)]
    rows += [(300, None), (301, "   "), (None, "lone"), (None, "a b"), (302, "x" * 50000), (303, "x " * 50000), (7, rows[7][1]), (7, rows[7][1])]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string").repartition(9)
    got = exact_dedup(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(brute(rows), key=key)
    per_group = {}
    for r in got:
        per_group[r.text_sha256] = per_group.get(r.text_sha256, 0) + r.kept
    assert set(per_group.values()) == {1}
    left = drop_copies(docs)
    assert left.columns == ["doc_id", "text", "kept"]
    assert left.count() == len(per_group)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
