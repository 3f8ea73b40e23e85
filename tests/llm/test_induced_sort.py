import random

import numpy as np
import pytest

import llm.induced_sort as module
from llm.induced_sort import common_prefixes, suffix_array


def naive(text):
    return sorted(range(len(text)), key=lambda i: list(text[i:]))


@pytest.fixture(params=[1 << 19, 40])
def base(request, monkeypatch):
    """With and without the recursion's base at work."""
    monkeypatch.setattr(module, "BASE", request.param)


@pytest.mark.parametrize("seed", range(6))
def test_small_texts(seed, base):
    rnd = random.Random(seed)
    for _ in range(120):
        sigma = rnd.choice([2, 3, 5, 40])
        body = [rnd.randrange(1, sigma) for _ in range(rnd.randrange(0, 90))]
        if rnd.random() < 0.3:
            body = body * rnd.randrange(1, 4)
        text = np.array([*body, 0])
        assert suffix_array(text, sigma).tolist() == naive(text.tolist())


def test_repetitive_and_large_alphabets(base):
    rnd = np.random.default_rng(1)
    for text in (np.ones(3000, int), np.tile([2, 1], 1500), np.repeat(rnd.integers(1, 4, 40), 60), np.tile(rnd.integers(1, 256, 300), 12), rnd.integers(1, 3000, 4000)):
        text = np.append(text, 0)
        raw = text.astype(">u2").tobytes()
        assert suffix_array(text, 3001).tolist() == sorted(range(len(text)), key=lambda i: raw[2 * i :])


def test_names_beyond_one_digit(base):
    rnd = np.random.default_rng(2)
    text = np.append(np.tile(rnd.integers(1, 256, 9000), 2), 0)
    raw = text.astype(np.uint8).tobytes()
    assert suffix_array(text, 256).tolist() == sorted(range(len(text)), key=lambda i: raw[i:])


def test_common_prefixes():
    rnd = np.random.default_rng(3)
    text = np.tile(rnd.integers(1, 4, 70), 5).astype(np.uint8)
    text[100] = 9
    text = np.append(text, 0).astype(np.uint8)
    array = suffix_array(text, 10)
    got = common_prefixes(text, array, 50)
    for a, b in zip(array[:-1], array[1:]):
        k = 0
        while k < 50 and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        assert got[b] == k
