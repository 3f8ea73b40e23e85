"""Substring dedup by level-wise doubling (operator 2).

Words are named by 64-bit hashes. Level 0 takes every window of ``window / 2**levels``
words of every document and finds those that occur in more than one document;
only windows both of whose halves are repeated are extended to twice that
length, until the windows have full length or no candidate survives. At the
last level windows are named by 128 bits, the smallest document id of each is settled, and
each other document loses the words that the window covers.

Each level is one round between batches and hash buckets (see batches.py). A
batch asks once for each distinct window, whatever number of its documents
hold it, so a passage that a third of all documents share costs a bucket one
question per batch. With its questions it notes which words start a candidate, so
that the next level goes on from there; a batch without candidates asks nothing any more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.batches import (
    NOTE,
    answered_bits,
    batch_count,
    census_answer,
    census_width,
    chunks,
    dealt,
    exchange,
    isin_sorted,
    keyed,
    ordered_docs,
    pack_hashes,
    per_batch,
    shorten,
    split_runs,
    with_null_ids,
)
from llm.vectext import BYTE_KEYS, OTHER_KEYS, cover, distinct, owner, prefix_sums, text_hash, window_hash, words_of

#: Words of a window, and doublings that lead to them: windows of 7, 13, 25 and 50 words.
WINDOW, LEVELS = 50, 3
_RESULT = "doc_id long, no_id boolean, n_words long, n_removed long, kept_sha256 string, kept_text binary"


class _Words:
    """A batch's documents as word hashes, end to end; ``last`` is the end of the document of each word."""

    def __init__(self, table: pa.Table):
        self.ids, self.data, self.at, self.order = ordered_docs(table)
        self.table = table
        hashes, first, spans = [], [np.zeros(1, np.int64)], []
        seen = 0
        for lo, _, data, bounds in chunks(self.data, self.at):
            starts, ends, offsets = words_of(data, bounds)
            hashes.append(text_hash(data, prefix_sums(BYTE_KEYS[data]), starts, ends))
            spans.append(np.stack([starts, ends]) + self.at[lo])
            first.append(offsets[1:] + seen)
            seen += len(starts)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.first = np.concatenate(first)
        self.starts, self.ends = np.concatenate(spans, axis=1) if spans else np.empty((2, 0), np.int64)
        self.doc = owner(self.first)
        self.sums = prefix_sums(self.hashes | np.uint64(1))

    def windows(self, length: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows at these words."""
        return window_hash(self.sums, length)[at]

    def second_windows(self, length: int, at: np.ndarray) -> np.ndarray:
        """Other hashes of the same windows, from other hashes of the words themselves."""
        parts = [np.empty(0, np.uint64)]
        for lo, hi, data, _ in chunks(self.data, self.at):
            own = slice(self.first[lo], self.first[hi])
            parts.append(text_hash(data, prefix_sums(OTHER_KEYS[data]), self.starts[own] - self.at[lo], self.ends[own] - self.at[lo], b"second"))
        return window_hash(prefix_sums(np.concatenate(parts) | np.uint64(1)), length)[at]


def _distinct(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values sorted; the first document of each; whether a second document has it.

    Documents come in ascending order of ids, and equal ids count as one."""
    order = np.argsort(values, kind="stable")
    ranked, ranked_docs = values[order], docs[order]
    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.empty(0, np.int64)
    ends = np.concatenate((head[1:], [len(ranked)])) - 1 if len(head) else head
    return ranked[head], ranked_docs[head], ranked_docs[ends] != ranked_docs[head]


def _maybe_twice(values: np.ndarray) -> np.ndarray:
    """Places of the values that may occur twice: all that do, and few others. One sort of packed words,
    upper bits of the value before its place."""
    bits = np.uint64(max(1, (len(values) - 1).bit_length()))
    packed = np.sort((values >> bits << bits) | np.arange(len(values), dtype=np.uint64))
    same = (packed[1:] ^ packed[:-1]) >> bits == 0
    run = np.zeros(len(values), dtype=bool)
    run[1:] |= same
    run[:-1] |= same
    return np.sort((packed[run] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))


class _Doubling:
    """The levels of one removal; its methods run inside tasks."""

    def __init__(self, window: int, levels: int, buckets: int, width: int):
        self.lengths = [-(-window // 2**k) for k in range(levels, -1, -1)]
        self.window, self.buckets, self.width = window, buckets, width

    def _candidates(self, words: _Words, got: dict, level: int) -> np.ndarray:
        """Words at which a candidate of this level starts: a window inside its document that, beyond level 0,
        consists of two repeated windows of the level before."""
        n, length = len(words.hashes), self.lengths[level]
        last = words.first[1:][words.doc] if n else np.empty(0, np.int64)
        out = np.arange(n) + length <= last
        if level:
            shorter = self._repeated(words, got, level - 1)
            step = length - self.lengths[level - 1]
            whole = max(0, n - step)
            out[:whole] &= shorter[:whole] & shorter[step:]
            out[whole:] = False
        return np.flatnonzero(out)

    def _noted(self, words: _Words, got: dict) -> np.ndarray:
        """Candidates of the level before, as this batch noted them."""
        if NOTE not in got:
            return np.empty(0, np.int64)
        return np.flatnonzero(np.unpackbits(np.frombuffer(got[NOTE], np.uint8), count=len(words.hashes)))

    def _repeated(self, words: _Words, got: dict, level: int) -> np.ndarray:
        """Mask over the words: a candidate of this level starts there that a second document has, too."""
        at = self._noted(words, got)
        out = np.zeros(len(words.hashes), dtype=bool)
        if len(at):
            values = shorten(words.windows(self.lengths[level], at), self.width)
            sent = distinct(values)
            twice = _maybe_twice(values)
            own, _, many = _distinct(values[twice], words.ids[words.doc[at[twice]]])
            hot = distinct(np.concatenate((sent[answered_bits(sent, self.buckets, got)], own[many])))
            out[at] = isin_sorted(values, hot)
        return out

    @staticmethod
    def _note(words: _Words, at: np.ndarray) -> dict[int, bytes]:
        mask = np.zeros(len(words.hashes), dtype=bool)
        mask[at] = True
        return {NOTE: np.packbits(mask).tobytes()}

    def ask(self, level: int):
        """Asks for every distinct candidate window of a level whether another batch has it."""

        def ask(batch: int, table: pa.Table, got: dict) -> dict[int, bytes]:
            words = _Words(table)
            at = self._candidates(words, got, level)
            if not len(at):
                return {}
            sent = distinct(shorten(words.windows(self.lengths[level], at), self.width))
            return self._note(words, at) | {b: pack_hashes(sent[lo:hi], self.width) for b, lo, hi in split_runs(sent, self.buckets)}

        return ask

    def _last(self, words: _Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of full length among those at ``at``: both hashes, the smallest id, and each window's place
        among them. Windows come by ascending id."""
        one, two = words.windows(self.window, at), words.second_windows(self.window, at)
        order = np.lexsort((np.arange(len(at)), two, one))
        head = np.ones(len(order), dtype=bool)
        head[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(head) - 1
        first = order[head]
        return one[first], two[first], words.ids[words.doc[at[first]]], place

    def ask_last(self, batch: int, table: pa.Table, got: dict) -> dict[int, bytes]:
        """Each distinct candidate window of full length with this batch's smallest id."""
        words = _Words(table)
        at = self._candidates(words, got, len(self.lengths) - 1)
        if not len(at):
            return {}
        one, two, ids, _ = self._last(words, at)
        return self._note(words, at) | {b: one[lo:hi].tobytes() + two[lo:hi].tobytes() + ids[lo:hi].tobytes() for b, lo, hi in split_runs(one, self.buckets)}

    @staticmethod
    def answer_last(asked: dict[int, memoryview]) -> dict[int, bytes]:
        """For each window that a batch sent, a bit: another batch has it in a row of smaller id."""
        sent = {b: np.frombuffer(p, np.uint64).reshape(3, -1) for b, p in asked.items()}
        one, two, ids = np.concatenate(list(sent.values()), axis=1)
        ids = ids.view(np.int64)
        order = np.lexsort((ids, two, one))
        head = np.ones(len(order), dtype=bool)
        head[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        least = np.empty(len(order), np.int64)
        least[order] = ids[order][head][np.cumsum(head) - 1]
        out, at = {}, 0
        for batch, p in sent.items():
            n = p.shape[1]
            out[batch] = np.packbits(least[at : at + n] < ids[at : at + n]).tobytes()
            at += n
        return out

    def finish(self, batch: int, table: pa.Table, got: dict, with_text: bool) -> pa.Table:
        words = _Words(table)
        at = self._noted(words, got)
        removed = np.zeros(len(words.hashes), dtype=bool)
        if len(at):
            one, _, ids, place = self._last(words, at)
            elsewhere = answered_bits(one, self.buckets, got)
            # Another batch has the window in a row of smaller id, or this batch itself has.
            gone = elsewhere[place] | (ids[place] < words.ids[words.doc[at]])
            removed = cover(len(words.hashes), at[gone], self.window)
        return _kept_words(words, removed, with_text)


def _kept_words(words: _Words, removed: np.ndarray, with_text: bool) -> pa.Table:
    """Per document, its kept words joined by one space."""
    kept = np.flatnonzero(~removed)
    n_docs = len(words.ids)
    data = words.data.copy()
    mask = cover(len(data), words.starts[kept], words.ends[kept] - words.starts[kept])
    if len(kept) > 1:
        joined = words.doc[kept[1:]] == words.doc[kept[:-1]]
        gaps = words.ends[kept[:-1]][joined]
        data[gaps] = 0x20
        mask[gaps] = True
    ends = np.concatenate(([0], np.cumsum(mask)))[words.at]
    flat = memoryview(data[mask])
    texts = [flat[ends[i] : ends[i + 1]] for i in range(n_docs)]
    n_removed = np.bincount(words.doc[removed], minlength=n_docs) if n_docs else np.empty(0, np.int64)
    return pa.table(
        {
            "doc_id": pa.array(words.ids),
            "no_id": words.table.column("no_id").take(pa.array(words.order)),
            "n_words": pa.array(np.diff(words.first)),
            "n_removed": pa.array(n_removed.astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
            "kept_text": pa.array([bytes(t) for t in texts] if with_text else [None] * n_docs, pa.binary()),
        }
    )


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, levels: int = LEVELS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row.

    Removed is each word that lies in a window of ``window`` consecutive words whose sequence also starts
    in a row of smaller id; windows are judged on the input. ``levels`` doublings lead to the full length; the shortest
    windows have two words at least. Defined cases: a null or empty text has no words and an empty kept text; texts
    shorter than a window are kept whole; a null id counts as the largest id and comes back as null; rows that share an
    id don't remove each other's words; an empty table gives an empty result. Other columns are ignored.
    """
    batches, total = batch_count(docs, text_col)
    levels = max(0, min(levels, window.bit_length() - 2))
    steps = _Doubling(window, levels, batches, census_width(total // 4))
    texts = dealt(keyed(docs, id_col, text_col), batches)
    known = None
    for level in range(levels):
        known = exchange(texts, known, steps.ask(level), census_answer(steps.width))
    settled = exchange(texts, known, steps.ask_last, steps.answer_last)
    out = with_null_ids(per_batch(texts, settled, lambda b, table, got: steps.finish(b, table, got, with_text), _RESULT))
    return out if with_text else out.drop("kept_text")
