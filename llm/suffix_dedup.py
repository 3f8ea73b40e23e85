"""Suffix-array dedup on bytes (operator 4).

A repeated ``length``-byte string must meet its equals in one shard, without
shuffling every position. Each window of ``length`` bytes has an anchor, the
smallest-hashed GRAM-byte string in it, so equal windows have equal anchors at
equal places. A first round finds the anchors that several documents have. The
slices of text around those go to the shard of their anchor; a shard lays its
distinct slices end to end, builds their suffix array by induced sorting with
permuted common prefixes (induced_sort.py), reads off the groups of suffixes that
share ``length`` bytes and the smallest id of each, and answers with a bit per
window. An anchor with a single distinct slice has nothing to sort.

A batch sends each distinct slice once with its smallest id, so a passage that very
many documents share reaches its shard once per batch. An anchor that has very many different
slices (a frequent line edge or address in ever new surroundings) would crowd one shard;
the census of anchors counts slices, and windows of such anchors go to shards by their own 128-bit
hash instead, where equal ones meet, too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.batches import NO_ID, ROW_KEYS, as_row_keys, batch_count, by_bucket, census_width, chunks, dealt, exchange, isin_sorted, keyed, ordered_docs, pack_hashes, per_batch, shorten, split_runs, unpack_hashes, with_null_ids, with_row_keys
from llm.induced_sort import common_prefixes, suffix_array
from llm.substring_dedup import _distinct, _maybe_twice
from llm.vectext import BYTE_KEYS, cover, distinct, mix, owner, prefix_sums, ragged, range_hash, window_hash

LENGTH = 50
#: Share of a window that its anchor takes: longer ones are rarer by chance, shorter ones lie farther apart.
GRAM_SHARE = 0.48
#: Bytes of slices whose suffixes one sort takes; a larger shard is sorted in parts, by anchor.
SORT_BYTES = 1 << 20
#: Slices of one anchor, summed over the batches, beyond which its windows are dealt by their own hashes.
HOT_SLICES = 20_000
_RESULT = "doc_id long, no_id boolean, mark long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
#: A byte that UTF-8 never has stands between slices.
_BREAK = 0xFF


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class _Runs:
    """A batch's windows as runs with one anchor each: ``start`` and ``count`` of the run's windows, their
    document, the anchor's place and hash, and a key of the slice of text that the run covers."""

    def __init__(self, table: pa.Table, length: int):
        self.ids, self.data, self.at, self.order = ordered_docs(table)
        gram = max(1, int(length * GRAM_SHARE))
        cols: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)] + [[np.empty(0, np.uint64)] for _ in range(2)]
        for lo, _, data, bounds in chunks(self.data, self.at):
            if len(data) < length:
                continue
            sums = prefix_sums(BYTE_KEYS[data])
            grams = window_hash(sums, gram)
            low = np.uint64(0xFFFFFFFF)
            ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
            anchor = (_sliding_min(ranked, length - gram + 1) & low).astype(np.int64)
            n = len(data) - length + 1
            anchor = anchor[:n]
            doc = owner(bounds)[:n]
            inside = np.arange(n) + length <= bounds[1:][doc]
            edge = np.ones(n, dtype=bool)
            edge[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(edge & inside)
            changes = np.flatnonzero(np.concatenate((edge | ~inside, [True])))
            stop = changes[np.searchsorted(changes, start, side="right")]
            where = anchor[start]
            hashes = mix(grams[where])  # smallest hashes crowd at the lower end: spread them over the buckets
            with np.errstate(over="ignore"):
                key = mix(range_hash(sums, start, stop - 1 + length) ^ hashes)
            for col, value in zip(cols, (start + self.at[lo], stop - start, doc[start] + lo, where - start, hashes, key), strict=True):
                col.append(value)
        self.start, self.count, self.doc, self.offset, self.hash, self.key = (np.concatenate(c) for c in cols)

    def only(self, which: np.ndarray) -> None:
        for name in ("start", "count", "doc", "offset", "hash", "key"):
            setattr(self, name, getattr(self, name)[which])


def _window_names(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the window at each start."""
    one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    other = mix(BYTE_KEYS)
    with np.errstate(over="ignore"):
        for k in range(length):
            byte = data[starts + k]
            one = mix(one * np.uint64(0x9E3779B97F4A7C15) + BYTE_KEYS[byte])
            two = mix(two * np.uint64(0xD1B54A32D192ED03) + other[byte])
    return one, two


def _pairs_first(one: np.ndarray, two: np.ndarray, *later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (one, two, *later) and the mask of those that begin a pair (one, two) in it."""
    order = np.lexsort((*later[::-1], two, one))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    return order, head


class _Shards:
    """The rounds of one removal; its methods run inside tasks. Anchors have the buckets from 0 on, slices those from
    ``buckets`` on, and windows of hot anchors those from twice that on."""

    def __init__(self, length: int, buckets: int, width: int):
        self.length, self.buckets, self.width = length, buckets, width
        self.sort_bytes, self.hot_slices = SORT_BYTES, HOT_SLICES

    def ask(self, batch: int, table: pa.Table, got: dict) -> dict[int, bytes]:
        """Every distinct anchor, and its number of distinct slices where that is more than one."""
        runs = _Runs(table, self.length)
        order = np.argsort(runs.key)
        head = np.ones(len(order), dtype=bool)
        head[1:] = runs.key[order[1:]] != runs.key[order[:-1]]
        ranked = np.sort(shorten(runs.hash[order[head]], self.width))
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.empty(0, np.int64)
        sent, count = ranked[first], np.diff(np.concatenate((first, [len(ranked)]))).astype(np.uint32)
        out = {}
        for b, lo, hi in split_runs(sent, self.buckets):
            many = np.flatnonzero(count[lo:hi] > 1)
            out[b] = np.uint32([hi - lo]).tobytes() + pack_hashes(sent[lo:hi], self.width) + many.astype(np.uint32).tobytes() + count[lo:hi][many].tobytes()
        return out

    def answer(self, asked: dict[int, memoryview]) -> dict[int, bytes]:
        """For each anchor a bit: another batch has it; and the places of those that are hot."""
        sent, counts = {}, []
        for batch, payload in asked.items():
            n = int(np.frombuffer(payload[:4], np.uint32)[0])
            sent[batch] = unpack_hashes(payload[4 : 4 + n * self.width], self.width)
            many, number = np.frombuffer(payload[4 + n * self.width :], np.uint32).reshape(2, -1)
            own = np.ones(n, np.int64)
            own[many] = number
            counts.append(own)
        pool, count = np.concatenate(list(sent.values())), np.concatenate(counts)
        order = np.argsort(pool)
        pool = pool[order]
        head = np.flatnonzero(np.concatenate(([True], pool[1:] != pool[:-1])))
        twice = pool[head][np.diff(np.concatenate((head, [len(pool)]))) > 1]
        hot = pool[head][np.add.reduceat(count[order], head) > self.hot_slices]
        return {batch: np.packbits(isin_sorted(h, twice)).tobytes() + np.flatnonzero(isin_sorted(h, hot)).astype(np.uint32).tobytes() for batch, h in sent.items()}

    def _shared(self, table: pa.Table, got: dict) -> tuple[_Runs, np.ndarray]:
        """Runs whose anchor several documents have, and which of them are hot."""
        runs = _Runs(table, self.length)
        short = shorten(runs.hash, self.width)
        sent = distinct(short)
        shared, hot = np.zeros(len(sent), dtype=bool), np.zeros(len(sent), dtype=bool)
        for b, lo, hi in split_runs(sent, self.buckets):
            if b in got:
                size = -(-(hi - lo) // 8)
                shared[lo:hi] = np.unpackbits(np.frombuffer(got[b][:size], np.uint8), count=hi - lo).astype(bool)
                hot[lo + np.frombuffer(got[b][size:], np.uint32).astype(np.int64)] = True
        twice = _maybe_twice(short)
        own, _, many = _distinct(short[twice], runs.ids[runs.doc[twice]])
        which = isin_sorted(short, distinct(np.concatenate((sent[shared], own[many]))))
        runs.only(which)
        return runs, isin_sorted(short[which], sent[hot])

    def _slices(self, runs: _Runs, cold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct slices of the runs ``cold`` in the order in which they are sent, by example, and each run's place
        among them. Runs come by ascending id."""
        order, head = _pairs_first(runs.hash[cold], runs.key[cold], np.arange(len(cold)))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(head) - 1
        return cold[order[head]], place

    def _hot_windows(self, runs: _Runs, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows of the runs ``hot``: their starts; of the distinct ones both hashes and the smallest id; and each
        window's place among those."""
        starts = ragged(runs.start[hot], runs.count[hot])
        ids = np.repeat(runs.ids[runs.doc[hot]], runs.count[hot])
        one, two = _window_names(runs.data, starts, self.length)
        order, head = _pairs_first(one, two, ids)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(head) - 1
        first = order[head]
        return starts, one[first], two[first], ids[first], place

    def ask_slices(self, batch: int, table: pa.Table, got: dict) -> dict[int, bytes]:
        runs, hot = self._shared(table, got)
        example, _ = self._slices(runs, np.flatnonzero(~hot))
        sizes = runs.count[example] + self.length - 1
        ends = np.concatenate(([0], np.cumsum(sizes)))
        out = {}
        for b, lo, hi in split_runs(runs.hash[example], self.buckets):
            own = example[lo:hi]
            small = np.stack((sizes[lo:hi], runs.offset[own])).astype(np.uint16)
            flat = runs.data[ragged(runs.start[own], sizes[lo:hi])]
            out[self.buckets + b] = b"".join((np.int64([hi - lo]).tobytes(), runs.ids[runs.doc[own]].tobytes(), small.tobytes(), flat.tobytes()))
        if hot.any():
            _, one, two, ids, _ = self._hot_windows(runs, np.flatnonzero(hot))
            for b, lo, hi in split_runs(one, self.buckets):
                out[2 * self.buckets + b] = b"".join((np.int64([lo - hi]).tobytes(), one[lo:hi].tobytes(), two[lo:hi].tobytes(), ids[lo:hi].tobytes()))
        return out

    @staticmethod
    def _answer_windows(asked: dict[int, memoryview]) -> dict[int, bytes]:
        """For each window of a hot anchor that a batch sent, a bit: a row of smaller id has it."""
        sent = {batch: np.frombuffer(p[8:], np.uint64).reshape(3, -1) for batch, p in asked.items()}
        one, two, ids = np.concatenate(list(sent.values()), axis=1)
        ids = ids.view(np.int64)
        order, head = _pairs_first(one, two, ids)
        least = np.empty(len(order), np.int64)
        least[order] = ids[order][head][np.cumsum(head) - 1]
        out, at = {}, 0
        for batch, p in sent.items():
            n = p.shape[1]
            out[batch] = np.packbits(least[at : at + n] < ids[at : at + n]).tobytes()
            at += n
        return out

    def _names(self, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the slices' anchors and of the slices, some at a time."""
        gram = max(1, int(self.length * GRAM_SHARE))
        hashes, keys = np.empty(len(sizes), np.uint64), np.empty(len(sizes), np.uint64)
        for lo in range(0, len(sizes), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            base = begin[lo]
            sums = prefix_sums(BYTE_KEYS[flat[base : int(begin[part][-1] + sizes[part][-1])]])
            at = begin[part] - base
            hashes[part] = mix(range_hash(sums, at + offsets[part], at + offsets[part] + gram))
            keys[part] = range_hash(sums, at, at + sizes[part])
        return hashes, keys

    def answer_slices(self, asked: dict[int, memoryview]) -> dict[int, bytes]:
        """For each slice a batch sent, a bit for each window: a row of smaller id has it."""
        if int(np.frombuffer(next(iter(asked.values()))[:8], np.int64)[0]) < 0:
            return self._answer_windows(asked)
        count, ids, smalls, flats = {}, [], [], []
        for batch, payload in asked.items():
            n = count[batch] = int(np.frombuffer(payload[:8], np.int64)[0])
            ids.append(np.frombuffer(payload[8 : 8 + 8 * n], np.int64))
            smalls.append(np.frombuffer(payload[8 + 8 * n : 8 + 12 * n], np.uint16).reshape(2, n))
            flats.append(np.frombuffer(payload[8 + 12 * n :], np.uint8))
        ids, flat = np.concatenate(ids), np.concatenate(flats)
        del flats
        sizes, offsets = np.concatenate(smalls, axis=1).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        hashes, keys = self._names(flat, begin, sizes, offsets)
        order, head = _pairs_first(hashes, keys, ids)
        slot = np.empty(len(order), np.int64)
        slot[order] = np.cumsum(head) - 1
        first = order[head]  # each distinct slice, in its row of smallest id; by anchor
        windows = sizes[first] - self.length + 1
        offset = np.cumsum(windows) - windows
        least = np.repeat(ids[first], windows)
        anchor = np.cumsum(np.concatenate(([0], (hashes[first][1:] != hashes[first][:-1]).astype(np.int64))))
        crowded = np.flatnonzero(np.bincount(anchor)[anchor] > 1)
        # Whole anchors at a time, about SORT_BYTES of slices in each sort.
        group = np.cumsum(sizes[first][crowded]) // self.sort_bytes
        if len(crowded):
            starts_anchor = np.concatenate(([True], anchor[crowded][1:] != anchor[crowded][:-1]))
            group = group[np.maximum.accumulate(np.where(starts_anchor, np.arange(len(crowded)), 0))]
        for g in np.unique(group):
            part = crowded[group == g]
            found = self._least_ids(flat, begin[first[part]], sizes[first[part]], ids[first[part]])
            least[ragged(offset[part], windows[part])] = found
        # A slice was sent with its batch's smallest id: set a bit where another row's is smaller.
        wide = windows[slot]
        bits = least[ragged(offset[slot], wide)] < np.repeat(ids, wide)
        out, seen, at = {}, 0, np.concatenate(([0], np.cumsum(wide)))
        for batch, n in count.items():
            out[batch] = np.packbits(bits[at[seen] : at[seen + n]]).tobytes()
            seen += n
        return out

    def _least_ids(self, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each window of these slices, in order, the smallest id of a slice that has the same window."""
        at = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.full(int((sizes + 1).sum()) + 1, _BREAK, np.uint8)
        inner = ragged(at, sizes)
        text[inner] = flat[ragged(begin, sizes)]
        symbols = text.astype(np.uint16) + 1
        symbols[-1] = 0
        array = suffix_array(symbols, 258)
        shared = common_prefixes(text, array, self.length)
        windows = sizes - self.length + 1
        places = ragged(at, windows)
        least = np.full(len(text), NO_ID, np.int64)
        least[places] = np.repeat(ids, windows)
        is_window = np.zeros(len(text), dtype=bool)
        is_window[places] = True
        ranked = array[is_window[array]]
        # A window's predecessor in the array that shares ``length`` bytes with it is a window, too: breaks end
        # all other suffixes before.
        head = np.flatnonzero(shared[ranked] < self.length)
        if not len(head) or head[0]:
            head = np.concatenate(([0], head))
        best = np.minimum.reduceat(least[ranked], head)
        least[ranked] = np.repeat(best, np.diff(np.concatenate((head, [len(ranked)]))))
        return least[places]

    def finish(self, batch: int, table: pa.Table, got: dict, with_text: bool, unchanged: bool) -> pa.Table:
        runs, hot = self._shared(table, got)
        cold = np.flatnonzero(~hot)
        example, place = self._slices(runs, cold)
        windows = runs.count[example]
        ends = np.concatenate(([0], np.cumsum(windows)))
        bits = np.zeros(int(ends[-1]), dtype=bool)
        for b, lo, hi in split_runs(runs.hash[example], self.buckets):
            bits[ends[lo] : ends[hi]] = np.unpackbits(np.frombuffer(got[self.buckets + b], np.uint8), count=int(ends[hi] - ends[lo])).astype(bool)
        ids = runs.ids[runs.doc]
        gone = bits[ragged(ends[:-1][place], runs.count[cold])] | np.repeat(ids[cold] > ids[example][place], runs.count[cold])
        starts = ragged(runs.start[cold], runs.count[cold])[gone]
        if hot.any():
            hot = np.flatnonzero(hot)
            places, one, _, least, place = self._hot_windows(runs, hot)
            bits = np.zeros(len(one), dtype=bool)
            for b, lo, hi in split_runs(one, self.buckets):
                bits[lo:hi] = np.unpackbits(np.frombuffer(got[2 * self.buckets + b], np.uint8), count=hi - lo).astype(bool)
            starts = np.concatenate((starts, places[bits[place] | (np.repeat(ids[hot], runs.count[hot]) > least[place])]))
        removed = cover(len(runs.data), starts, self.length)
        n = len(runs.ids)
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        inner = runs.at[:-1][np.diff(runs.at) > 0]
        opens[inner] = removed[inner]
        total = lambda mask: np.concatenate(([0], np.cumsum(mask)))[runs.at]
        kept = memoryview(runs.data[~removed])
        cuts = total(~removed)
        texts = [kept[cuts[i] : cuts[i + 1]] for i in range(n)]
        n_removed = np.diff(total(removed))
        return pa.table(
            {
                "doc_id": pa.array(runs.ids),
                "no_id": table.column("no_id").take(pa.array(runs.order)),
                "mark": table.column("mark").take(pa.array(runs.order)),
                "n_bytes": pa.array(np.diff(runs.at)),
                "n_removed": pa.array(n_removed),
                "n_spans": pa.array(np.diff(total(opens))),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                "kept_text": pa.array([bytes(t).decode(errors="ignore") if with_text and (r or unchanged) else None for t, r in zip(texts, n_removed.tolist(), strict=True)], pa.string()),
            }
        )


def _removals(docs: DataFrame, length: int, id_col: str, text_col: str, with_text: bool, unchanged: bool = False) -> DataFrame:
    """remove_repeated_bytes with no_id and ``mark``, a hash of the text; with ``unchanged``, texts that lose nothing
    come along, too."""
    batches, total = batch_count(docs, text_col)
    steps = _Shards(length, batches, census_width(total // 10))
    texts = dealt(keyed(docs, id_col, text_col).withColumn("mark", F.xxhash64("text")), batches)
    known = exchange(texts, None, steps.ask, steps.answer)
    settled = exchange(texts, known, steps.ask_slices, steps.answer_slices)
    # The last pass needs both answers; their bucket numbers differ.
    return per_batch(texts, known.unionAll(settled), lambda batch, table, got: steps.finish(batch, table, got, with_text, unchanged), _RESULT)


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of every row.

    Texts are UTF-8 bytes. Removed is each byte that lies in a ``length``-byte string that also starts in a
    row of smaller id; strings never cross rows and are judged on the input. kept_text is null where nothing
    was removed; where a cut splits a character, it lacks the rest of that, while kept_sha256 is of all
    remaining bytes. Defined cases: a null text is empty; texts shorter than ``length`` are kept whole; a
    null id counts as the largest id and comes back as null; rows that share an id don't remove each
    other's bytes; an empty table gives an empty result. Other columns are ignored.
    """
    out = with_null_ids(_removals(docs, length, id_col, text_col, with_text).drop("mark"))
    return out if with_text else out.drop("kept_text")


def without_repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeated bytes of their texts, and with all their columns.

    n_chars, if there is one, is counted anew for changed texts. Where a cut splits a character, the rest of it goes, too.
    Defined cases: as in remove_repeated_bytes; a null text stays null; repeated rows stay, each with its cut text; an empty
    table stays empty. All texts come from the removal, so that the join moves each text once: the other side brings the
    other columns alone.
    """
    left = as_row_keys(_removals(docs, length, id_col, text_col, True, True), F.col("n_removed").alias("_n_cut"), F.col("kept_text").alias("_cut_text")).dropDuplicates(ROW_KEYS)
    own = with_row_keys(docs, id_col, text_col).withColumn("_has_text", F.col(text_col).cast("string").isNotNull()).drop(text_col)
    joined = own.join(left, ROW_KEYS, "left")
    cut = {text_col: F.when(F.col("_has_text"), F.col("_cut_text"))}
    if "n_chars" in docs.columns:
        cut["n_chars"] = F.when(F.col("_n_cut") > 0, F.char_length("_cut_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(cut).select(*docs.columns)
