"""Suffix arrays by induced sorting, vectorised, and permuted common prefixes.

``suffix_array`` classifies suffixes as S (smaller than the next) or L, sorts the
substrings between leftmost-S suffixes (LMS) by inducing, names them, sorts the
string of names recursively, and induces the whole array from the sorted LMS
suffixes in two linear scans. A scan goes through the buckets of the alphabet in
order and places all predecessors of a bucket's suffixes at once, in waves while
they fall into the same bucket; NumPy therefore works on whole buckets. Names can be
many, so a recursion writes each as two digits to keep the alphabet near the
square root of their number.
"""

from __future__ import annotations

import numpy as np

from llm.vectext import ragged

#: Names up to which a recursion ends in plain sorting: below, NumPy's cost per bucket outweighs linear time. A sort of
#: suffix_dedup.SORT_BYTES has some 300,000 names, and recurses.
BASE = 1 << 14


def _types(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; the last one (the sentinel) is S."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    out[-1] = True
    differs = np.flatnonzero(text[:-1] != text[1:])
    # The type of a position is decided at the next place where neighbours differ.
    smaller = text[differs] < text[differs + 1]
    lengths = np.diff(np.concatenate(([-1], differs)))
    out[: int(lengths.sum())] = np.repeat(smaller, lengths)
    return out


def _scatter(array: np.ndarray, at: np.ndarray, symbols: np.ndarray, values: np.ndarray, step: int) -> None:
    """Appends each value to its symbol's bucket, in order, moving the bucket's head (step 1) or tail (-1)."""
    if len(values) == 1:
        s = symbols[0]
        array[at[s]] = values[0]
        at[s] += step
        return
    order = np.argsort(symbols, kind="stable")
    symbols, values = symbols[order], values[order]
    head = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    count = np.diff(np.concatenate((head, [len(symbols)])))
    which = symbols[head]
    rank = np.arange(len(symbols)) - np.repeat(head, count)
    array[np.repeat(at[which], count) + step * rank] = values
    at[which] += step * count


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array from LMS suffixes in (assumed) order: L suffixes forward, then S suffixes backward."""
    n = len(text)
    array = np.full(n, -1, np.int64)
    symbols = text[lms]
    head, tail = starts.copy(), ends - 1
    by = np.argsort(symbols, kind="stable")
    in_bucket = lms[by]
    limits = np.searchsorted(symbols[by], np.arange(len(starts) + 1))
    used = np.flatnonzero(ends > starts)
    for c in used:
        done = starts[c]
        while done < head[c]:  # L suffixes of this bucket, also those that this bucket itself brings in
            wave = array[done : head[c]]
            done = head[c]
            before = wave[wave > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                _scatter(array, head, text[before], before, 1)
        own = in_bucket[limits[c] : limits[c + 1]]
        before = own[own > 0] - 1  # all of type L, since these are leftmost S
        if len(before):
            _scatter(array, head, text[before], before, 1)
    for c in used[::-1]:
        done = ends[c] - 1
        while True:
            if done > tail[c]:  # S suffixes of this bucket, from the end
                wave = array[tail[c] + 1 : done + 1][::-1]
                done = tail[c]
            else:
                break
            before = wave[wave > 0] - 1
            before = before[is_s[before]]
            if len(before):
                _scatter(array, tail, text[before], before, -1)
        wave = array[starts[c] : head[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[is_s[before]]
        if len(before):
            _scatter(array, tail, text[before], before, -1)
    # The sentinel, smallest and S, is induced by nothing.
    array[0] = n - 1
    return array


def _by_doubling(ranks: np.ndarray) -> np.ndarray:
    """The recursion's base: suffixes of a string of at most BASE names, sorted by pairs of ranks of doubled reach."""
    n, reach = len(ranks), 1
    ranks = ranks.astype(np.uint64)
    while True:
        behind = np.zeros(n, np.uint64)
        behind[: n - reach] = ranks[reach:] + np.uint64(1)
        key = ranks << np.uint64(32) | behind
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1]))).astype(np.uint64)
        ranks[order] = fresh
        reach *= 2
        if fresh[-1] == n - 1 or reach >= n:
            return order


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``text`` (integers below sigma). Its last symbol must be 0 and occur nowhere else."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    is_s = _types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    count = np.bincount(text, minlength=sigma)
    ends = np.cumsum(count)
    starts = ends - count
    if len(lms) < 2:
        return _induce(text, is_s, lms, starts, ends)
    first = _induce(text, is_s, lms, starts, ends)
    mask = np.zeros(n, dtype=bool)
    mask[lms] = True
    ranked = first[mask[first]]
    # LMS substrings run up to the next LMS suffix, included; equal neighbours in the order share a name.
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    length = np.diff(np.concatenate((lms, [n - 1]))) + 1
    length[-1] = 1
    a, b = ranked[:-1], ranked[1:]
    la, lb = length[place[a]], length[place[b]]
    same = la == lb
    at = np.flatnonzero(same)
    # Compare the candidates' symbols: first a few, then whole substrings of those still equal.
    for k in range(4):
        at = at[(text[np.minimum(a[at] + k, n - 1)] == text[np.minimum(b[at] + k, n - 1)]) | (la[at] <= k)]
    equal = np.zeros(len(a), dtype=bool)
    if len(at):
        sizes = la[at]
        unlike = text[ragged(a[at], sizes)] != text[ragged(b[at], sizes)]
        equal[at] = np.add.reduceat(unlike, np.cumsum(sizes) - sizes) == 0
    names = np.concatenate(([0], np.cumsum(~equal)))
    number = int(names[-1]) + 1
    if number < len(lms):
        named = np.empty(len(lms), np.int64)
        named[place[ranked]] = names
        if len(named) <= BASE:
            order = _by_doubling(named)
        elif number <= 1024:
            order = suffix_array(named, number)
        else:
            base = int(np.ceil(np.sqrt(number))) + 1
            digits = np.empty(2 * len(lms) + 1, np.int64)
            digits[0:-1:2] = named // base + 1
            digits[1:-1:2] = named % base + 1
            digits[-1] = 0
            order = suffix_array(digits.astype(np.uint16 if base < 65000 else np.int64), base + 2)
            order = order[(order % 2 == 0) & (order < 2 * len(lms))] // 2
        ranked = lms[order]
    return _induce(text, is_s, ranked, starts, ends)


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """Permuted longest common prefixes, cut at ``most``: for each suffix in text order, what it shares with
    its predecessor in the array. Eight bytes are compared at a time. ``text`` is uint8."""
    n = len(text)
    wide = np.zeros(n + most + 16, np.uint8)
    wide[:n] = text
    words = np.ndarray(n + most + 8, "<u8", wide, strides=(1,))
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(before >= 0)
    for done in range(0, most, 8):
        unlike = words[at + done] ^ words[before[at] + done]
        ended = unlike != 0
        low = unlike[ended] & (~unlike[ended] + np.uint64(1))
        out[at[ended]] = done + (np.frexp(low.astype(np.float64))[1] - 1) // 8
        at = at[~ended]
    out[at] = most
    return np.minimum(out, most)
