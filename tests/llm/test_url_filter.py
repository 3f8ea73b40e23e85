import random
import re

import pytest

import llm.url_filter as uf
from llm.url_filter import ALLOW, BLOCK, compiled_rules, filter_urls, host_tokens, pattern_tokens, standard_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LABELS = ["com", "net", "a", "ads", "x-ads", "Ads2", "www", "cö"]
PARTS = ["", "en", "En", "ads", "e", "ads.html", "b?c=ads", "f#ads", "x ads"]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    return host.translate(LOW), re.match("[^?#]*", rest[len(host):]).group(), rest


def fits(pattern, text):
    """Whether a pattern fits, character by character."""
    body = pattern.translate(LOW)
    label, front = body.startswith("||"), body.startswith("|")
    body = body.lstrip("|")
    edge = body.endswith("|")
    body = body.rstrip("|")

    def closed(states, at_end):
        """With the places that need no character: behind a star, and behind a separator at the end."""
        for i in sorted(states):
            while i < len(body) and (body[i] == "*" or (at_end and body[i] == "^")):
                i += 1
                states.add(i)
        return states

    host = re.match("[^/?#]*", text).group()
    starts = [0, *(i + 1 for i, c in enumerate(host) if c == ".")] if label else [0] if front else range(len(text) + 1)
    states = set()
    for k in range(len(text) + 1):
        states = closed(states | ({0} if k in starts else set()), k == len(text))
        if len(body) in states and (not edge or k == len(text)):
            return True
        if k < len(text):
            c = text[k]
            states = {i + (body[i] != "*") for i in states if i < len(body) and (body[i] in ("*", c) or (body[i] == "^" and re.fullmatch("[^a-z0-9_.%-]", c, re.S)))}
    return False


def brute(rows, hosts, patterns):
    out = []
    for i, url in rows:
        host, path, rest = parts(url)
        own = [(len(h + p), v == BLOCK, h.translate(LOW) + p) for v, h, p in hosts if (host == h.translate(LOW) or host.endswith("." + h.translate(LOW))) and path.startswith(p)]
        met = {v: max(((len(p), p) for w, p in patterns if w == v and fits(p, rest.translate(LOW))), default=None) for v in (ALLOW, BLOCK)}
        pattern = met[ALLOW] or met[BLOCK]
        verdict = (BLOCK if max(own)[1] else ALLOW) if own else BLOCK if met[BLOCK] and not met[ALLOW] else ALLOW
        out.append((i, host, path, max(own)[2] if own else None, verdict, pattern[1] if pattern and not own else None))
    return sorted(out, key=repr)


def cases(seed):
    rnd = random.Random(seed)
    host = lambda: ".".join(rnd.choice(LABELS) for _ in range(rnd.randrange(1, 4)))
    path = lambda n: "".join("/" + rnd.choice(PARTS) for _ in range(rnd.randrange(n)))
    urls = [rnd.choice(["http://", "", "a:b://", "://", "HTTP://u@"]) + host() + path(4) for _ in range(300)]
    bits = ["ads", "x", "-", "/", "^", "*", ".", "com", "en", "html", "e"]
    patterns = {(rnd.choice([BLOCK, BLOCK, ALLOW]), rnd.choice(["", "", "|", "||"]) + "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 5))) + rnd.choice(["", "", "|"])) for _ in range(60)}
    hosts = {(rnd.choice([BLOCK, ALLOW]), host(), path(3).split("?")[0].split("#")[0]) for _ in range(40)}
    return urls, sorted(hosts), sorted(patterns)


@pytest.mark.parametrize("seed", range(3))
def test_tokens_are_sure(seed):
    urls, hosts, patterns = cases(seed)
    for url in urls:
        host, path, rest = parts(url)
        have = set(re.findall("[a-z0-9]+", rest.translate(LOW)))
        for _, p in patterns:
            assert not fits(p, rest.translate(LOW)) or have.issuperset(pattern_tokens(p)), (url, p)
        for _, h, p in hosts:
            assert not ((host == h.translate(LOW) or host.endswith("." + h.translate(LOW))) and path.startswith(p)) or have.issuperset(host_tokens(h, p)), (url, h, p)


@pytest.mark.parametrize("chars,hot_rows", [(uf.BROADCAST_CHARS, uf.HOT_ROWS), (0, 7)])
def test_against_brute_force(spark, monkeypatch, chars, hot_rows):
    """With a broadcast index, and with one that is met by a shuffle with hot tokens over salts and hot URLs apart."""
    monkeypatch.setattr(uf, "BROADCAST_CHARS", chars)
    monkeypatch.setattr(uf, "HOT_ROWS", hot_rows)
    urls, hosts, patterns = cases(7)
    rows = list(enumerate(urls)) + [(900, None), (900, None), (901, ""), (None, urls[0]), (3, urls[3]), (902, "http://ads.com/" + "ads/" * 500), *((903, urls[5]) for _ in range(40))]
    pages = spark.createDataFrame([(i, u, "t", 1, "r") for i, u in rows], "page_id long, url string, token string, copies int, rule string")
    got = filter_urls(pages, compiled_rules(spark, hosts, patterns))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]
    want = brute(rows, hosts, patterns)
    assert {r[4] for r in want} == {ALLOW, BLOCK} and sum(r[3] is not None for r in want) > 50 and sum(r[5] is not None for r in want) > 50
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_very_long_urls(spark):
    """Stars cost no more than a URL's length, even where many beginnings fit."""
    pages = spark.createDataFrame([(0, "http://a.org/" + "ads/" * 50000), (1, "http://" + "ads." * 50000 + "/y/x"), (2, "http://a.org/" + "ads/" * 50000 + "y/x")], "page_id long, url string")
    rules = compiled_rules(spark, [], [(BLOCK, "/ads/*a*/y*x|"), (BLOCK, "||ads.*ads*y/z*"), (ALLOW, "||ads*d*^x^")])
    assert [tuple(r) for r in filter_urls(pages, rules).select("page_id", "pattern").orderBy("page_id").collect()] == [(0, None), (1, "||ads*d*^x^"), (2, "/ads/*a*/y*x|")]


def test_standard_rules(spark):
    rows = [("http://a.com", None, ALLOW), ("http://Example.COM/en/1", "example.com/en/", BLOCK), ("http://www.example.com/en/", "www.example.com/en/", ALLOW), ("x://a.net/es/", "net/es/", BLOCK),
            ("http://a.net/de/", None, ALLOW), ("http://casino-win.example.net/de/", None, BLOCK), ("http://www.spam-farm.example.org/en/1", None, BLOCK), ("http://casino-win.example.org/robots.txt", None, ALLOW),
            ("http://a.org/x.exe", None, BLOCK), ("http://spam-farm.com/a.exe", "com/", ALLOW)]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(rows)], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, standard_rules(spark)).collect()} == {i: r[1:] for i, r in enumerate(rows)}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(pages, standard_rules(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert tuple(filter_urls(one, compiled_rules(spark, [], [])).first()) == (1, "a.com", "/", None, ALLOW, None)


def test_bad_rules(spark):
    with pytest.raises(ValueError):
        compiled_rules(spark, [(BLOCK, "com", "en")], [])
    with pytest.raises(ValueError):
        compiled_rules(spark, [("deny", "com", "/en")], [])
