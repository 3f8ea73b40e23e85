"""Phrase collocations by language: top-order marginalisation (operator 13).

Each word of a piece leads one window of at most LONGEST words, padded where the piece ends. Only these windows are counted; a Spark ROLLUP
over their columns sums them into the counts of all shorter phrases, since a phrase begins exactly one window wherever it occurs.

So that rare windows, which are most of them, need not be shuffled, windows end where a word, a pair or a triple of words begins that can't be in any
phrase of LEAST occurrences, and words in no pair of that many lead none. Passes before count words, pairs and triples in hashed counters; a counter below LEAST rules out all that share it, one above
rules out nothing, so no phrase is lost and all counts that are reported are exact. The counters that reach LEAST are sent to the tasks as
one bit each, in maps whose size is bounded by MOST_BITS whatever the input; a corpus that outgrows them gets longer windows, not other results.

A task gives each distinct window once for all its text, not once a chunk. With more text more phrases reach LEAST, and each of them stands in
most tasks; if tasks were as many as files have splits, rows would grow with the product of both. Therefore a few splits make one task, as
long as all cores have some and no task gets more than TASK_BYTES.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.batches import chunks, column_bytes, cut, delete_tables, tables_written
from llm.vectext import BYTE_KEYS, distinct, mix, owner, prefix_sums, ragged, text_hash
from llm.worker import give_back

#: Words of a phrase at most, occurrences at least, and phrases reported for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Percent of a phrase's occurrences inside one longer candidate from which on it is dropped.
INSIDE = 100
#: Language of rows without one.
NO_LANG = "und"
#: Bytes of text for one counter of words, of pairs and of triples, and binary digits of their numbers at least and at most (at most 16 MB of bits).
COUNTER_BYTES, LEAST_BITS, MOST_BITS = (64, 16, 16), 16, 27
#: Text that is worked on at once inside a task, and counters that are summed at once there.
CHUNK, COUNTED = 1 << 20, 2_000_000
#: Distinct windows and bytes of their words that a task holds before it gives them out, rows that it gives at once, tasks for a core at least, and
#: bytes of text for a task that gathers windows.
HELD, HELD_BYTES, GIVEN, CORE_TASKS, TASK_BYTES = 1 << 19, 32 << 20, 1 << 15, 2, 256 << 20
_BREAK, _BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[[0x20, 0x09]] = True
_SECOND = np.uint64(0xD6E8FEB86659FD93)
#: Counters whose bits travel together.
_PART = 16
_TOTAL = -1
#: The counters' numbers from which on they tell of words in frequent pairs.
_PAIRED = 1 << 32


class _Chunk:
    """Lower-cased words of a run of documents: their limits, hashes that tell languages apart, and whether the next word stands in the
    same piece."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lang_keys: np.ndarray):
        self.low = low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        breaks = _BREAK[low]
        solid = ~(breaks | _BLANK[low])
        edge = np.zeros(len(low) + 1, dtype=bool)
        edge[bounds] = True
        before, after = np.zeros(len(low), dtype=bool), np.zeros(len(low), dtype=bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.doc = owner(np.searchsorted(self.starts, bounds))
        piece = np.cumsum(breaks)[self.starts]
        self.joined = np.zeros(len(self.starts), dtype=bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.hashes = mix(text_hash(low, prefix_sums(BYTE_KEYS[low]), self.starts, self.ends) ^ lang_keys[self.doc])

    def phrase_hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """A hash for the phrase of ``size`` words at each of these places."""
        out = self.hashes[at]
        with np.errstate(over="ignore"):
            for k in range(1, size):
                out = mix(out * _SECOND + self.hashes[at + k])
        return out

    def possible(self, maps: list[np.ndarray], bits: list[int]) -> list[np.ndarray]:
        """For phrases of 1, 2, ... words, as many as there are maps: at which words one starts that may be frequent."""
        out: list[np.ndarray] = []
        for k, (bitmap, digits) in enumerate(zip(maps, bits, strict=False)):
            at = self.candidates(out, k + 1)
            mask = np.zeros(len(self.hashes), dtype=bool)
            mask[at[_has(bitmap, _bucket(self.phrase_hashes(at, k + 1), digits))]] = True
            out.append(mask)
        return out

    def candidates(self, shorter: list[np.ndarray], size: int) -> np.ndarray:
        """Words at which a phrase of ``size`` words in one piece starts both of whose parts of one word less may be frequent."""
        if size == 1:
            return np.arange(len(self.hashes))
        part = shorter[size - 2]
        return np.flatnonzero(self.joined[:-1] & part[:-1] & part[1:]) if len(part) else np.empty(0, np.int64)

    def ids(self, which: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the words at these places, -1 elsewhere, and the words by number."""
        sizes = (self.ends - self.starts)[which]
        flat = self.low[ragged(self.starts[which], sizes)]
        at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(flat)).dictionary_encode()
        out = np.full(len(self.starts), -1, np.int64)
        out[which] = words.indices.to_numpy()
        return out, words.dictionary


def _chunked(batch: pa.RecordBatch, size: int) -> Iterator[tuple[_Chunk, np.ndarray, pa.Array]]:
    """Runs of documents, with the number of each one's language and the languages by number."""
    langs = batch.column("lang").dictionary_encode()
    keys = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in langs.dictionary.to_pylist()], np.uint64)
    number = langs.indices.to_numpy()
    data, at = column_bytes(batch.column("text"))
    for lo, hi, part, bounds in chunks(data, at, size):
        yield _Chunk(part, bounds, keys[number[lo:hi]]), number[lo:hi], langs.dictionary


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _has(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 > 0


def _counter(batches: Iterator[pa.RecordBatch], size: int, buckets_of: Callable[[_Chunk], np.ndarray], totals: bool) -> Iterator[pa.RecordBatch]:
    """Counters of some chunks, and with ``totals`` their words by language."""

    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        bucket, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.nulls(len(bucket), pa.string()), pa.array(bucket), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])

    parts: list[np.ndarray] = []
    for batch in batches:
        for chunk, number, langs in _chunked(batch, size):
            parts.append(buckets_of(chunk))
            if totals:
                by_lang = np.bincount(number[chunk.doc], minlength=len(langs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(langs), _TOTAL)), pa.array(by_lang)], names=["lang", "bucket", "n"])
            if sum(map(len, parts)) >= COUNTED:
                yield summed(parts)
                parts = []
    if parts:
        yield summed(parts)
    give_back()


def _counters(texts: DataFrame, run: Callable, least: int, name: str) -> DataFrame:
    """Counters that reach ``least``, and the words of each language under _TOTAL, as a table."""
    counted = texts.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return cut(counted.where((F.col("bucket") == _TOTAL) | (F.col("bucket") >= _PAIRED) | (F.col("n") >= least)), name)


def _bitmap(counters: DataFrame, bits: int) -> np.ndarray:
    """The counters of a table as one bit each: 2**bits of them, so that its size is known."""

    digits = min(bits, _PART)

    def pack(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket").to_numpy()
        flags = np.zeros(1 << digits, dtype=bool)
        flags[bucket & ((1 << digits) - 1)] = True
        return pa.table({"part": pa.array([int(bucket[0]) >> digits]), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()])})

    out = np.zeros((1 << bits) // 8, np.uint8)
    parts = counters.where(F.col("bucket") != _TOTAL).groupBy(F.shiftright("bucket", digits).alias("part")).applyInArrow(pack, "part long, flags binary")
    for row in parts.collect():  # 2**(bits - 16) rows of 8 KB at most
        out[row["part"] << (digits - 3) : (row["part"] + 1) << (digits - 3)] = np.frombuffer(row["flags"], np.uint8)
    return out


def _padded_windows(chunk: _Chunk, possible: list[np.ndarray], leads: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """The words that lead a chunk's windows, the numbers of their windows' first, second, ... words (-1 where padded), and the words by number."""
    ids, words = chunk.ids(np.flatnonzero(possible[0]))
    size = len(ids)
    lead = np.flatnonzero(leads)
    columns = [ids[lead]]
    for k in range(1, longest):
        # The phrase of k + 1 words: known to be possible, or else grown by the last words' phrase.
        further = possible[k].copy() if k < len(possible) else np.zeros(size, dtype=bool)
        if k >= len(possible):
            step = k + 1 - len(possible)
            further[: size - step] = alive[: size - step] & possible[-1][step:]
        alive = further
        column = np.full(size, -1, np.int64)
        place = np.flatnonzero(alive)
        column[place] = ids[place + k]
        columns.append(column[lead])
    return lead, columns, words


class _Held:
    """Distinct windows of a task's chunks so far, and how often each stands there; languages and words are numbered for the task."""

    def __init__(self, longest: int, most: int, most_bytes: int, given: int):
        self.keys, self.most, self.most_bytes, self.given = ["lang", *_columns(longest)], most, most_bytes, given
        self._clear()

    def _clear(self) -> None:
        self.langs: dict[bytes, int] = {}
        self.words: dict[bytes, int] = {}
        self.bytes = self.rows = self.merged = 0
        self.tables: list[pa.Table] = []

    def _numbered(self, names: dict[bytes, int], new: pa.Array) -> np.ndarray:
        """The task's numbers of a chunk's names, and -1 at the end, where -1 finds it."""
        known = len(names)
        out = [names.setdefault(x, len(names)) for x in new.cast(pa.large_binary()).to_pylist()]
        self.bytes += sum(map(len, list(names)[known:]))
        return np.array([*out, -1], np.int32)

    def _sum(self, tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(self.keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*self.keys, "n"])

    def add(self, number: np.ndarray, langs: pa.Array, columns: list[np.ndarray], words: pa.Array) -> Iterator[pa.RecordBatch]:
        """Takes windows by their languages' and words' numbers in the chunk; gives out all that are held when they are too many."""
        lang, word = self._numbered(self.langs, langs), self._numbered(self.words, words)
        new = [lang[number], *(word[c] for c in columns), np.ones(len(number), np.int64)]
        self.tables.append(self._sum([pa.table(dict(zip([*self.keys, "n"], new, strict=True)))]))
        self.rows += self.tables[-1].num_rows
        if self.rows >= max(self.most // 4, 2 * self.merged) or self.bytes >= self.most_bytes:
            self.tables = [self._sum(self.tables)]
            self.rows = self.merged = self.tables[0].num_rows
            if self.rows >= self.most or self.bytes >= self.most_bytes:
                yield from self.give()

    def give(self) -> Iterator[pa.RecordBatch]:
        if self.tables:
            summed = self._sum(self.tables).combine_chunks()
            names = [pa.array(list(x), pa.binary()) for x in (self.langs, self.words)]
            plain = pc.CastOptions(pa.string(), allow_invalid_utf8=True)
            for rows in summed.to_batches(self.given):
                laid = []
                for k, numbers in enumerate(rows.columns[:-1]):
                    at = numbers.to_numpy()
                    laid.append(pc.cast(names[k > 0].take(pa.array(at, mask=at < 0)), options=plain))
                yield pa.RecordBatch.from_arrays([*laid, rows.columns[-1]], names=[*self.keys, "n"])
        self._clear()


def _columns(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def _bits(total: int, share: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (total // share).bit_length()))


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables of (lang, phrase, words, f) for every phrase of 1 to ``longest`` words with f >= least occurrences, and of (lang, n) for the words of each
    language."""
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    bits = [_bits(total, share) for share in COUNTER_BYTES[:longest]]
    share, size, limits = docs.sparkSession.sparkContext.broadcast, CHUNK, (HELD, HELD_BYTES, GIVEN)
    maps: list = []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of one word more than there are maps; with the longest ones, the words of possible pairs."""
        level = len(maps)

        def buckets(chunk: _Chunk) -> np.ndarray:
            possible = chunk.possible([m.value for m in maps], bits)
            out = _bucket(chunk.phrase_hashes(chunk.candidates(possible, level + 1), level + 1), bits[level])
            if level < 2 or level + 1 < len(bits):
                return out
            pairs = np.flatnonzero(possible[1])
            paired = distinct(np.concatenate((pairs, pairs + 1)))
            return np.concatenate((out, _bucket(chunk.hashes[paired], bits[0]) + _PAIRED))

        return _counter(batches, size, buckets, level == 0)

    with tables_written() as paths:
        for level, digits in enumerate(bits):
            counters = _counters(texts, count, least, f"phrases-of-{level + 1}")
            if level == 0:
                totals = counters.where(F.col("bucket") == _TOTAL).select("lang", "n")
            if level == 2:
                paired = share(_bitmap(counters.where(F.col("bucket") >= _PAIRED).withColumn("bucket", F.col("bucket") - _PAIRED), bits[0]))
            maps.append(share(_bitmap(counters.where(F.col("bucket") < _PAIRED), digits)))
    delete_tables(docs.sparkSession, paths[1:])

    def lay_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(longest, *limits)
        for batch in batches:
            for chunk, number, langs in _chunked(batch, size):
                possible = chunk.possible([m.value for m in maps], bits)
                leads = possible[0] & _has(paired.value, _bucket(chunk.hashes, bits[0])) if len(maps) > 2 else possible[0]
                lead, columns, words = _padded_windows(chunk, possible, leads, longest)
                yield from held.add(number[chunk.doc[lead]], langs, columns, words)
        yield from held.give()
        give_back()

    names = _columns(longest)
    tasks = max(CORE_TASKS * docs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    windows = texts.coalesce(tasks).mapInArrow(lay_windows, f"lang string, {', '.join(f'{w} string' for w in names)}, n long")
    summed = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # A row of level k has the first k words of its windows; where the k-th is padding, shorter levels have the phrase.
    level = F.lit(longest) - F.length(F.regexp_replace(F.bin("level"), "0", ""))
    phrases = summed.where(F.col("f") >= least).withColumn("words", F.slice(F.array(*names), 1, F.greatest(level, F.lit(0))))
    phrases = phrases.where((level > 0) & F.get("words", level - 1).isNotNull())
    return cut(phrases.select("lang", F.array_join("words", " ").alias("phrase"), "words", "f"), "phrases"), totals


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in decimals of 38 digits: exact for counts up to 10**15."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(1000 * a, 19) * wide(n, 18), wide(left, 18) * wide(right, 18)).cast("long")


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of 2 to ``longest`` words with a >= least occurrences. A phrase's
    score is that of its weakest cut into two parts of l and r occurrences, n being all words of the language; phrases of which
    ``inside`` percent of the occurrences or more lie in one longer candidate are left out.

    Defined cases: null and empty texts have no words; texts and words of any length are taken whole; rows without a language are those of
    ``und``; repeated rows count each; an empty table gives no rows. Ids and other columns are ignored.
    """
    phrases, totals = phrase_counts(docs, longest, least, lang_col, text_col)
    candidates = phrases.where(F.size("words") > 1).withColumnRenamed("f", "a")
    whole = lambda words, at, n: F.array_join(F.slice(words, at, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", whole("words", F.lit(1), F.col("k")).alias("head"), whole("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= top else totals, "lang")
    weakest = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct(_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("c"))
    # The parts of longer candidates: spans of two words or more from each place.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda at: whole("words", at, n))))
    held = candidates.where(F.size("words") > 2).select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    open_ = weakest.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    rows = open_.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = rf"""
WITH pieces AS (SELECT lang, row_number() OVER () AS id, piece FROM (SELECT coalesce(lang, '{NO_LANG}') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
f AS MATERIALIZED (SELECT lang, p, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(flatten(list_transform(range(1, {LONGEST + 1}), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) AS p FROM w)
  GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
s AS (SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score FROM c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:] JOIN total ON total.lang = c.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (SELECT lang, q, max(f) AS f FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, len(p)), lambda m: list_transform(range(1, len(p) - m + 2), lambda i: p[i:i + m - 1])))) AS q FROM f WHERE len(p) > 2) GROUP BY ALL),
o AS (SELECT best.*, array_to_string(best.p, ' ') AS phrase FROM best LEFT JOIN held ON held.lang = best.lang AND held.q = best.p WHERE held.f IS NULL OR 100 * held.f < {INSIDE} * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= {TOP}
"""
