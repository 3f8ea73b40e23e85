"""Best-fit packing with exact-complement hashing (operator 10).

Documents become token pieces of at most ``capacity`` tokens. Packing works on
the histogram of piece lengths, at most ``capacity`` numbers whatever the
corpus holds: lengths, pair sums and triple sums are indexed under their counts,
combinations that fill a gap exactly are consumed as often as the counts allow,
and what is left goes best-fit into the tightest gap. The plan says, for each
length, which ranks go where; pieces are ranked inside their length with a
salted, two-step rank, so that no length is gathered in one task.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.batches import chunks, column_bytes, cut, ids_and_texts
from llm.vectext import BYTE_KEYS, IS_SPACE, RaggedCache, prefix_sums, ragged, text_hash, unique_inverse
from llm.worker import give_back, kept_tool

CAPACITY = 4096
#: Id that closes each document.
END_ID = 1
#: Entries of a worker's cache of encoded units; it starts anew when full.
CACHE_UNITS = 1_000_000
#: Ranks inside one length are dealt over this many salts at least; each salt holds about SALT_ROWS of the longest list.
SALTS, SALT_ROWS = 64, 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Byte classes at which a text may be cut before tokenising: between a letter that is certainly one
# (ASCII, or Latin-1 as two bytes C3 xx) and ASCII punctuation, the tokenizer always ends a unit.
_LETTER, _PUNCT = 1, 2
_CLASS = np.zeros(256, np.uint8)
for _b in range(128):
    if chr(_b).isalpha():
        _CLASS[_b] = _LETTER
    elif not chr(_b).isdigit() and not IS_SPACE[_b] and chr(_b) != "'" and 0x20 < _b < 0x7F:
        _CLASS[_b] = _PUNCT


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Token ids of whole texts, each distinct unit being encoded once per worker.

    A unit is a run between white space and certain boundaries of the tokenizer's own pre-tokenizer, so
    the ids of a text are those of its units in order. Texts that contain a special token's string are
    encoded whole, and so are all texts under a tokenizer of other rules than these boundaries are made for.
    """

    #: The normaliser's steps and the pre-tokenizer's pattern that the boundaries are made for.
    STEPS = ["NFC", "Replace", "Lowercase"]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        patterns = [(p.get("pattern") or {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_units = steps == self.STEPS and patterns == [self.PATTERN, None]
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = RaggedCache(CACHE_UNITS)

    def _encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents in a chunk end to end, and their n + 1 offsets."""
        raw = data.tobytes()
        whole = np.full(len(bounds) - 1, not self.by_units)
        for token in self.special if self.by_units else []:
            at = raw.find(token)
            while at >= 0:
                whole[np.searchsorted(bounds, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        solid = ~IS_SPACE[low]
        kind = _CLASS[low]
        lead = np.flatnonzero(low[:-1] == 0xC3) if len(low) else np.empty(0, np.int64)
        lead = lead[~np.isin(low[lead + 1], (0x97, 0xB7))]
        kind[lead] = kind[lead + 1] = _LETTER
        limit = np.zeros(len(low) + 1, dtype=bool)
        limit[bounds] = True
        limit[1:-1] |= (kind[1:] | kind[:-1] == _LETTER | _PUNCT) & (kind[1:] > 0) & (kind[:-1] > 0)
        limit[1:] |= ~solid
        limit[:-1] |= ~solid
        cuts = np.flatnonzero(limit)
        starts, ends = cuts[:-1], cuts[1:]
        keep = solid[starts] if len(starts) else np.empty(0, dtype=bool)
        starts, ends = starts[keep], ends[keep]
        if whole.any():
            out = ~whole[np.searchsorted(bounds, starts, side="right") - 1]
            starts, ends = starts[out], ends[out]
        hashes = text_hash(low, prefix_sums(BYTE_KEYS[low]), starts, ends)
        distinct, example, place = unique_inverse(hashes)
        text = low.tobytes()

        def make(new: np.ndarray) -> list[list[int]]:
            at = example[new]
            return self._encode([text[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

        first, count = self.cache.rows(distinct, make)
        lengths = count[place]
        ids = self.cache.flat[ragged(first[place], lengths)].astype(np.uint32)
        total = np.concatenate(([0], np.cumsum(lengths)))
        offsets = total[np.searchsorted(starts, bounds)]
        if not whole.any():
            return ids, offsets
        rows = [ids[offsets[i] : offsets[i + 1]] for i in range(len(whole))]
        for i in np.flatnonzero(whole):
            rows[i] = np.array(self._encode([raw[bounds[i] : bounds[i + 1]].decode()])[0], np.uint32)
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document (ids, then END_ID)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = kept_tool(("units", vocabulary), lambda: UnitEncoder(vocabulary))
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            data, at = column_bytes(batch.column("text"))
            out: list[tuple] = []
            for lo, hi, part, bounds in chunks(data, at, 1 << 20):
                ids, offsets = tool.encode(part, bounds)
                for i in range(hi - lo):
                    row = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for k, start in enumerate(range(0, len(row), capacity)):
                        piece = row[start : start + capacity]
                        out.append((doc_ids[lo + i], k, start, len(piece), zlib.crc32(piece.tobytes())))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.mapInArrow(run, _PIECES)


class _Lengths:
    """Counts of lengths with an index of pair sums; a triple sum is a length plus an indexed pair sum."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64).copy()
        self.there = self.counts > 0
        n = len(counts)
        self.pairs = np.zeros(2 * n, np.int64)
        for x in np.flatnonzero(self.there):
            at = np.flatnonzero(self.there[x:]) + x
            self.pairs[x + at] += 1

    def take(self, combo: tuple[int, ...], times: int) -> None:
        for x in combo:
            self.counts[x] -= times
        for x in {*combo}:
            if not self.counts[x]:
                self.there[x] = False
                self.pairs[x + np.flatnonzero(self.there)] -= 1
                self.pairs[2 * x] -= 1

    def times(self, combo: tuple[int, ...]) -> int:
        return min(int(self.counts[x]) // combo.count(x) for x in {*combo})

    def exact(self, length: int, gap: int) -> tuple[tuple[int, ...], int] | None:
        """A combination of one, two or three available lengths that fills the gap beside ``length``."""
        if self.there[gap] and (n := self.times((length, gap))):
            return (gap,), n
        if self.pairs[gap] > 0 and (pair := self._pair(gap, (length,))):
            return pair
        firsts = np.flatnonzero(self.there[1:gap] & (self.pairs[gap - 1 : 0 : -1] > 0)) + 1
        for a in firsts[::-1]:
            if pair := self._pair(gap - int(a), (length, int(a))):
                return (int(a), *pair[0]), pair[1]
        return None

    def _pair(self, total: int, beside: tuple[int, ...]) -> tuple[tuple[int, ...], int] | None:
        if not self.times(beside):
            return None
        half = total // 2
        big = np.flatnonzero(self.there[total - half : total] & self.there[half:0:-1]) + total - half
        for a in big[::-1]:
            combo = (int(a), total - int(a))
            if n := self.times((*beside, *combo)):
                return combo, n
        return None


def pack_lengths(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their number of sequences: every counted piece is in exactly one.

    counts[n] is the number of pieces of length n, for n up to capacity.
    """
    index = _Lengths(counts)
    patterns: list[tuple[tuple[int, ...], int]] = []
    left: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while n := int(index.counts[length]):
            if length == capacity:
                found: tuple[tuple[int, ...], int] | None = ((), n)
            else:
                found = index.exact(length, capacity - length)
            if not found:
                left.append((length, n))
                index.take((length,), n)
                break
            combo, times = (length, *found[0]), found[1]
            patterns.append((combo, times))
            index.take(combo, times)
    bins: dict[int, list[list]] = {}  # by gap: [pattern, number]
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, pattern: tuple[int, ...], number: int) -> None:
        bins.setdefault(gap, []).append([pattern, number])
        gaps[gap] = True

    for length, n in left:
        while n:
            gap = length + int(np.argmax(gaps[length:])) if gaps[length:].any() else None
            if gap is None:
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - n % each * length, (length,) * (n % each), 1)
                break
            entry = bins[gap][-1]
            fit = min(n, entry[1])
            put(gap - length, (*entry[0], length), fit)
            entry[1] -= fit
            if not entry[1]:
                bins[gap].pop()
                gaps[gap] = bool(bins[gap])
            n -= fit
    return patterns + [(tuple(p), k) for rows in bins.values() for p, k in rows]


def _segments(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, offset): where the pieces of each length go."""
    given: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, number in patterns:
        offset = 0
        for length in pattern:
            rank = given.get(length, 0)
            out.append((length, rank, rank + number, sequence, offset))
            given[length] = rank + number
            offset += length
        sequence += number
    return out


def best_fit_pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Defined cases: a null or empty text is one piece that holds END_ID alone; a longer document than
    ``capacity`` is cut, and only such; a null id comes back as null; repeated rows are packed each;
    an empty table gives an empty result. Other columns are ignored. Only the histogram of lengths
    (at most ``capacity`` numbers) reaches the driver.
    """
    spark = docs.sparkSession
    pieces = token_pieces(ids_and_texts(docs, id_col, text_col), vocabulary or vocabulary_path("word_bpe_49k.json"), capacity)
    # A number for each piece, fixed by the written table, deals the pieces of a length over salts whatever repeats.
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    plan = _segments(pack_lengths(counts, capacity))
    salts = max(SALTS, -(-int(counts.max()) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row"))
    ranked = salted.withColumn("own", own).join(offsets, ["length", "salt"]).withColumn("rank", F.col("below") + F.col("own") - 1)
    schema = "length long, lo long, hi long, base long, offset long"
    # At most a few segments for each of ``capacity`` lengths: bounded by the capacity, not by the data.
    segments = spark.createDataFrame(plan, schema) if plan else spark.createDataFrame([], schema)
    return ranked.join(F.broadcast(segments), (ranked["length"] == segments["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
    )
