import pytest
from pyspark.sql import functions as F

from incognita.functions.spans import entities
from incognita.functions.text import chunks, percent_decoded, projected
from incognita.operators.entities import floor_entities, keep_entity, known_entities, merged_types, scope_entities, without_wrappers


def found(spark, texts, extra=False):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", entities(F.col("t"), extra).alias("e")).collect()
    return {r.t: sorted((e.value, e.entity_type) for e in r.e) for r in rows}


CASES = [
    ("card 4111 1111 1111 1111.", [("4111 1111 1111 1111", "PAYMENT_CARD")]),
    ("not a card 4111 1111 1111 1112", []),
    ("Authorization: Basic YWRtaW46c2VjcmV0", [("YWRtaW46c2VjcmV0", "CREDENTIAL")]),
    ("Authorization: Bearer abcdefgh.ijkl", [("abcdefgh.ijkl", "TOKEN")]),
    ("Cookie: a=b1c2; theme=dark1", [("b1c2", "TOKEN"), ("dark1", "TOKEN")]),
    ("Set-Cookie: wp_x=abcdef; HttpOnly", [("abcdef", "TOKEN")]),
    ("at 12:34:56 sharp", [("12:34:56", "IP_ADDRESS")]),
    ("fe80::1 is up", []),
    ("acme.local\\user on 127.0.0.1", [("acme.local", "DOMAIN")]),
    ("http://10.0.0.1/x", [("10.0.0.1", "IP_ADDRESS")]),
    ("10.1.0.0/16 and 10.1.2.3", [("10.1.0.0/16", "CIDR"), ("10.1.2.3", "IP_ADDRESS")]),
    ("password=hunter22&next=1", [("hunter22", "CREDENTIAL")]),
    ("aad3b435b51404eeaad3b435b51404ee:8846f7eaee8fb117ad06bdd830b7586c", [("aad3b435b51404eeaad3b435b51404ee:8846f7eaee8fb117ad06bdd830b7586c", "HASH")]),
    ("é10.1.2.3 is glued to a letter", []),
    ("123-45-6789", [("123-45-6789", "IDENTIFIER")]),
    ("", []),
]


def test_rules(spark):
    got = found(spark, [t for t, _ in CASES])
    assert got == {t: sorted(want) for t, want in CASES}


def test_extra_rules(spark):
    texts = ["fe80::1 is up", '{"password": "hunter2hunter"}']
    got = found(spark, texts, extra=True)
    assert got[texts[0]] == [("fe80::1", "IP_ADDRESS")] and ("hunter2hunter", "CREDENTIAL") in got[texts[1]]


def test_percent_decoding_rescues_values(spark):
    digest = "9f8a7b6c5d4e3f2a1b0c1d2e3f4a5b6c"
    texts = spark.createDataFrame([(1, f"auth=user%7C{digest}%7Cx"), (2, "100% sure"), (3, None)], "k int, text string")
    assert [(r.k, r.value) for r in floor_entities(texts, "k").collect()] == [(1, digest)]
    one = spark.createDataFrame([("a%20b%zz+%C3%A9%",)], "t string").select(percent_decoded(F.col("t")).alias("d")).first()
    assert one.d == "a b%zz+é%"


def test_chunks_cover(spark):
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    rows = spark.createDataFrame([(text,)], "t string").select(chunks(F.col("t"), 1500, 200).alias("c")).first().c
    assert all(len(c) <= 1500 for c in rows) and "".join(c[:1300] for c in rows[:-1]) + rows[-1] == text
    with pytest.raises(ValueError):
        chunks(F.col("t"), 0, 0)


def test_projection(spark):
    row = spark.createDataFrame([("A*b`~​C‑d \n\t E",)], "t string").select(projected(F.col("t")).alias("p")).first()
    assert row.p == "abc-d e"


def test_scope(spark):
    texts = spark.createDataFrame([(1, "ACME Corp. owns acme.com and acmespeak, not my-acme.")], "k int, text string")
    terms = spark.createDataFrame([("acme corp", "ORGANIZATION"), ("acme", "HOSTNAME"), ("acme.com", "DOMAIN")], "value string, entity_type string")
    got = {(r.value, r.entity_type) for r in scope_entities(texts, terms, "k").collect()}
    assert got == {("ACME Corp", "ORGANIZATION"), ("ACME", "HOSTNAME"), ("acme.com", "DOMAIN")}


def test_merge_filter_and_wrappers(spark):
    rows = [
        (1, "tok123456", "TOKEN", 0, True), (1, "tok123456", "PERSON", 1, False), (1, "SID=tok123456", "OTHER", 1, False), (1, "ann", "PERSON", 1, False),
        (1, "nmap", "OTHER", 1, False), (1, "Windows Server", "ORGANIZATION", 1, False), (1, "windows host", "OTHER", 1, False), (1, "Ann Lee", "PERSON", 1, False), (1, "Ann Lee", "ORGANIZATION", 2, False), (1, " ", "OTHER", 1, False),
    ]
    merged = merged_types(spark.createDataFrame(rows, "k int, value string, entity_type string, chain int, is_floor boolean"), "k")
    kept = without_wrappers(merged, "k").where(keep_entity(F.col("value"), F.col("is_floor")))
    assert {(r.value, r.entity_type) for r in kept.collect()} == {("tok123456", "TOKEN"), ("Windows Server", "ORGANIZATION"), ("Ann Lee", "ORGANIZATION")}


@pytest.mark.parametrize("few", [1000, 0])
def test_known_entities_in_both_ways(spark, few):
    texts = spark.createDataFrame([(1, "see srv01.corp and x"), (2, "nothing"), (3, "xsrv01.corpx ab"), (4, None), (5, "https://a/1 https://a/2"), (6, "é")], "k int, text string")
    terms = [("srv01.corp", "DOMAIN"), ("ab", "OTHER"), ("absent value", "OTHER"), ("https://a/2", "URL"), ("https://a/3", "URL"), ("é", "OTHER"), ("", "OTHER"), (None, "OTHER")]
    vault = spark.createDataFrame(terms, "original string, entity_type string")
    got = sorted((r.k, r.value) for r in known_entities(texts, vault, "k", few=few).collect())
    assert got == [(1, "srv01.corp"), (3, "ab"), (3, "srv01.corp"), (5, "https://a/2"), (6, "é")]
