import random

from pyspark.sql import functions as F

from incognita.operators import search
from incognita.operators.search import holding

PLAIN = search._term_grams


def test_terms_beyond_an_automaton(spark):
    rnd = random.Random(7)
    word = lambda least, most: "".join(rnd.choice("abé€\U0001f600.\0") for _ in range(rnd.randrange(least, most)))
    texts = [(i, None if i == 5 else word(0, 60)) for i in range(120)]
    terms = sorted({word(1, 14) for _ in range(150)} | {texts[i][1][2:25] for i in range(20, 40)} - {""}) + [""]
    got = holding(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), "k", few=0)
    assert sorted((r.k, r.term) for r in got.collect()) == sorted((k, t) for k, text in texts for t in terms if text and t and t in text)


def test_texts_give_out_few_grams_but_those_of_terms(spark):
    texts = spark.range(200).select(F.col("id").alias("k"), F.concat(*[F.md5(F.concat("id", F.lit(i))) for i in range(20)], F.lit(" srv1234.corp ")).alias("_text"))
    needles = spark.createDataFrame([("srv1234.corp",)], "_needle string")
    own = needles.mapInArrow(search._term_grams, "_needle string, _size int, _gram long")
    assert 200 * own.count() <= search._grams_met(texts, own.select("_needle", "_size", "_gram"), ("k",)).count() < 200 * own.count() + 200


def test_grams_of_terms_are_dealt_over_tasks(spark, monkeypatch):
    """Terms that fit one task don't put all their grams into it, and grams don't bring their terms along."""
    seen = []
    plain = search._grams_met
    monkeypatch.setattr(search, "TERM_CHARS", 1000)
    monkeypatch.setattr(search, "_term_grams", _counted)
    monkeypatch.setattr(search, "_grams_met", lambda texts, rarest, keys: seen.append(rarest.count()) or plain(texts, rarest, keys))
    terms = spark.range(400).select(F.concat(F.lit("srv"), F.col("id") + 1000, F.lit(".corp.local")).alias("term"))
    texts = spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("at srv"), F.col("id") + 1000, F.lit(".corp.local now")).alias("text"))
    assert holding(texts, terms, "k", few=0).count() == 400 and seen == [400]


def _counted(batches):
    """The grams, of less than 2,000 characters of terms a task."""
    chars = 0
    for batch in batches:
        assert batch.schema.names == ["_id", "_needle"]
        chars += sum(map(len, batch.column("_needle").to_pylist()))
        assert chars < 2000
        yield from PLAIN(iter([batch]))
