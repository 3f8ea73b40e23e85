"""Vectorised text primitives shared by the operators (NumPy inside tasks).

A *chunk* is a run of documents whose UTF-8 bytes lie end to end in one uint8
array; ``bounds`` holds the document limits (n + 1 offsets). All arithmetic on
hashes is modulo 2**64 on purpose.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
#: Ranges of so many bytes or more are named by BLAKE2b: sums modulo 2**64 collide on long structured ranges (two words of
#: the Thue-Morse sequence from some 1,000 bytes on), and the more bits agree by structure the longer a range may be.
LONG_RANGE = 64
_RNG = np.random.default_rng(20240229)
#: One random 64-bit value per byte value; fixed by the seed above, so every task agrees.
BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Values for a second hash that knows nothing of the first.
OTHER_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_ROOT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ROOT, -1, 2**64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.empty(size, dtype=np.uint64)
            have[0] = 1
            k = 1
            while k < size:
                have[k : 2 * k] = have[:k] * U64(pow(base, k, 2**64))
                k *= 2
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that all output bits depend on all input bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(29))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(32))


def prefix_sums(keys: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: out[i] = sum of keys[j] * ROOT**j for j < i."""
    out = np.empty(len(keys) + 1, dtype=np.uint64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(keys * _powers(_ROOT, len(keys)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end): equal ranges of keys have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _powers(_INV, len(sums))[start] + (end - start).astype(np.uint64))


def window_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """range_hash of every window of one length, without index arrays."""
    n = len(sums) - length
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return mix((sums[length:] - sums[:n]) * _powers(_INV, n) + U64(length))


def text_hash(data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray, person: bytes = b"") -> np.ndarray:
    """range_hash of byte ranges; those of LONG_RANGE bytes or more by BLAKE2b. ``person`` tells apart hashes that are to
    know nothing of each other."""
    out = range_hash(sums, start, end)
    long = np.flatnonzero(end - start >= LONG_RANGE)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        for i, lo, hi in zip(long.tolist(), start[long].tolist(), end[long].tolist(), strict=True):
            out[i] = int.from_bytes(hashlib.blake2b(raw[lo:hi], digest_size=8, person=person).digest(), "big")
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, sorted (by sorting: faster here than hashing)."""
    ranked = np.sort(values)
    if not len(ranked):
        return ranked
    head = np.ones(len(ranked), dtype=bool)
    head[1:] = ranked[1:] != ranked[:-1]
    return ranked[head]


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the offsets of each document's first word (n + 1).

    A word never crosses a document's limit.
    """
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each element between the bounds, the index of its document."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges [starts[i], starts[i] + lengths[i])."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    kind = np.int32 if max(total, int((starts + lengths).max())) < 2**31 else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts.astype(np.int64) - first).astype(kind), lengths)


def cover(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Mask over n elements: those inside any [start, start + length)."""
    diff = np.zeros(n + 1, dtype=np.int32)
    np.add.at(diff, starts, 1)
    np.subtract.at(diff, starts + length, 1)
    return np.cumsum(diff[:-1]) > 0


def unique_inverse(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values sorted, the index of one occurrence of each, and each value's place among them."""
    order = np.argsort(values)
    ranked = values[order]
    head = np.ones(len(values), dtype=bool)
    head[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.cumsum(head) - 1
    return ranked[head], order[head], place


class RaggedCache:
    """Integer rows by 64-bit key, kept in flat arrays: a sorted index, and a small dictionary of the newest keys
    that is merged into it now and then. Starts anew when ``limit`` rows are held."""

    def __init__(self, limit: int):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.slots = np.empty(0, np.int32)
        self.recent: dict[int, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int64)
        self.size = 0

    def _merge(self) -> None:
        keys = np.concatenate((self.keys, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))))
        slots = np.concatenate((self.slots, np.fromiter(self.recent.values(), np.int32, len(self.recent))))
        order = np.argsort(keys)
        self.keys, self.slots, self.recent = keys[order], slots[order], {}

    def rows(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``flat`` and length of the row of each key (keys are distinct); make(places of unknown keys)
        gives their rows as lists."""
        if self.size > self.limit:
            self._clear()
        slot = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == keys
            slot[hit] = self.slots[at[hit]]
        open_ = np.flatnonzero(slot < 0)
        slot[open_] = [self.recent.get(k, -1) for k in keys[open_].tolist()]
        new = open_[slot[open_] < 0]
        if len(new):
            made = make(new)
            counts = np.fromiter(map(len, made), np.int64, len(made))
            values = np.fromiter((x for row in made for x in row), np.int32, int(counts.sum()))
            begin, end = int(self.first[self.size]), self.size + len(made)
            while len(self.flat) < begin + len(values):
                self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
            while len(self.first) <= end:
                self.first = np.concatenate((self.first, np.empty_like(self.first)))
            self.flat[begin : begin + len(values)] = values
            self.first[self.size + 1 : end + 1] = begin + np.cumsum(counts)
            slot[new] = np.arange(self.size, end)
            self.recent.update(zip(keys[new].tolist(), range(self.size, end), strict=True))
            self.size = end
            if len(self.recent) > 1 << 16:
                self._merge()
        return self.first[slot], self.first[slot + 1] - self.first[slot]
