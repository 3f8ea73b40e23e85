"""Spelling variants: words at one edit by neighbourhoods in a reduced alphabet (operator 12).

Letters are hashed to a few symbols. Two words that differ by one inserted, deleted or replaced letter differ by one edit at
most in their reduced forms, too; so each word's reduced form is taken with all reduced forms at one edit (itself, every deletion,
replacement and insertion), and these meet the vocabulary's reduced forms in one join. In an alphabet of 8 symbols that are 15 L + 9 forms
at most for a word of L letters, where the full alphabet of 90 letters gives 180 L. What meets is verified on the words themselves.

Reduced forms are named by polynomial sums of random symbol values modulo 2**64, so that the name of every form at one edit follows from the word's
prefix sums, whatever its length; two forms of one name only cost a verification.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.batches import column_bytes, cut, delete_tables, ids_and_texts, tables_written
from llm.vectext import mix

#: Letters of words (fixed values), and those that are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Code points and occurrences that a word has at least, and how many times as frequent as a word its form is.
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: One occurrence in so many (by the checksum of document and word) loses a letter.
DROPPED = 199
#: Symbols of the reduced alphabet. More of them mean more forms and fewer candidates for each.
SYMBOLS = 8
#: Forms that a task lays out at once.
FORMS_AT_ONCE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of_texts(text: Column, doc_id: Column, dropped: int | None = DROPPED) -> Column:
    """The words of a text: runs of letters with A-Z lower-cased; of each occurrence whose checksum ``dropped`` divides, one letter goes."""
    runs = F.filter(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"([{LETTERS}]+)"), 1), lambda w: F.length(w) >= LEAST_LETTERS)
    if dropped is None:
        return runs
    head = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"))

    def one(word: Column) -> Column:
        checksum = F.crc32(F.concat(head, word).cast("binary"))
        at = (checksum % F.length(word)).cast("int")
        return F.when(checksum % dropped == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)

    return F.transform(runs, one)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped: int | None = DROPPED) -> DataFrame:
    """word and n of the words of all texts that have LEAST_LETTERS code points and LEAST_COUNT occurrences or more."""
    runs = ids_and_texts(docs, id_col, text_col).select(F.explode(words_of_texts(F.col("text"), F.col("doc_id"), dropped)).alias("word"))
    return runs.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length each time: their places, and their code points as a matrix."""
    data, at = column_bytes(column)
    if not len(data):
        return
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
    sizes = np.diff(first)
    for size in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == size)
        step = max(1, FORMS_AT_ONCE // (2 * size + 1))
        for lo in range(0, len(which), step):
            part = which[lo : lo + step]
            yield part, points[first[part][:, None] + np.arange(size)]


def _symbols(points: np.ndarray, symbols: int) -> np.ndarray:
    """A value for each code point's symbol."""
    known, place = np.unique(points, return_inverse=True)
    of = np.array([zlib.crc32(chr(p).encode()) % symbols for p in known.tolist()], np.int64)
    return _VALUES[of][place].reshape(points.shape)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, np.uint64(_BASE)))))


def reduced_names(points: np.ndarray, symbols: int) -> np.ndarray:
    """The name of each word's reduced form (words of one length)."""
    with np.errstate(over="ignore"):
        return mix((_symbols(points, symbols) * _powers(points.shape[1])[:-1]).sum(axis=1, dtype=np.uint64))


def neighbour_names(points: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word and name of every reduced form at one edit or none of each word (words of one length), each name of a word once; some
    words at a time."""
    values = _symbols(points, symbols)
    m, size = values.shape
    step = max(1, FORMS_AT_ONCE // ((2 * symbols + 1) * size + symbols + 1))
    for lo in range(0, m, step):
        own = values[lo : lo + step]
        with np.errstate(over="ignore"):
            powers = _powers(size + 1)
            sums = np.zeros((len(own), size + 1), np.uint64)
            np.cumsum(own * powers[:size], axis=1, out=sums[:, 1:])
            total, inverse = sums[:, -1:], np.uint64(pow(_BASE, -1, 2**64))
            letters = _VALUES[:symbols]
            names = [total, sums[:, :-1] + (total - sums[:, 1:]) * inverse]
            for letter in letters:
                names.append(total + (letter - own) * powers[:size])
                names.append(sums + letter * powers[: size + 1] + (total - sums) * np.uint64(_BASE))
        flat = np.sort(mix(np.concatenate(names, axis=1)), axis=1)
        keep = np.ones(flat.shape, dtype=bool)
        keep[:, 1:] = flat[:, 1:] != flat[:, :-1]
        yield lo + np.repeat(np.arange(len(own)), keep.sum(axis=1)), flat[keep]


def _named(words: DataFrame, symbols: int) -> DataFrame:
    """word, n and the name of the word's reduced form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.zeros(batch.num_rows, np.uint64)
            for part, points in _by_length(batch.column("word")):
                names[part] = reduced_names(points, symbols)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(names.view(np.int64))], names=["word", "n", "name"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, name long")


def _neighbourhoods(words: DataFrame, symbols: int) -> DataFrame:
    """word and the names of the reduced forms at one edit or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word")
            for part, points in _by_length(column):
                for word, names in neighbour_names(points, symbols):
                    yield pa.RecordBatch.from_arrays([column.take(pa.array(part[word])), pa.array(names.view(np.int64))], names=["near", "name"])

    return words.select("word").mapInArrow(run, "near string, name long")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """near, word and n for each two words (word, n; none null, each once) that differ by one inserted, deleted or replaced code
    point, both ways."""
    met = _neighbourhoods(words, symbols).join(_named(words, symbols).hint("shuffle_hash"), "name")
    return met.where((F.col("near") != F.col("word")) & (F.levenshtein("near", "word", 1) == 1)).select("near", "word", "n")


def variant_forms(words: DataFrame, times: int = TIMES, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, n_near (words at one edit), form (of those ``times`` as frequent, the most frequent; of equal ones the first by code points) and form_n
    for each word of words (word, n)."""
    pairs = near_pairs(words, symbols).select(F.col("near").alias("word"), F.lit(None).cast("long").alias("n"), F.lit(1).alias("near"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("w")).alias("best"))
    own = words.select("word", "n", F.lit(0).alias("near"), F.lit(None).cast("struct<n:bigint,w:string>").alias("best"))
    joined = own.unionAll(pairs).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    formed = -F.col("best.n") >= times * F.col("n")
    return joined.select("word", "n", "n_near", F.when(formed, F.col("best.w")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n"))


def with_roots(forms: DataFrame, times: int = TIMES) -> DataFrame:
    """forms with root: where following form after form ends. A form is ``times`` as frequent as its word, so that a
    chain has no more steps than the largest n allows; each round doubles the steps taken."""
    largest = forms.agg(F.max("n").alias("n")).first()["n"] or 1
    steps = ceil(log(largest, times)) + 1 if largest > 1 else 1
    links = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(1, ceil(log(steps, 2)))):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped: int | None = DROPPED, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary of all texts.

    Defined cases: null, empty and letterless texts have no words; texts and words of any length are taken whole (a word of L
    letters costs a task 15 L + 9 numbers); a null id counts as an empty string in checksums; repeated rows count each; an empty table
    gives no rows. Other columns are ignored.
    """
    with tables_written() as paths:
        words = cut(vocabulary(docs, id_col, text_col, dropped), "vocabulary")
        forms = cut(variant_forms(words, symbols=symbols), "forms")
    delete_tables(docs.sparkSession, paths[:1])
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


SPELLING_SQL = rf"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS t),
runs AS (SELECT translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS low, doc_id FROM documents),
d AS (SELECT low, doc_id, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || low AS s FROM runs WHERE length(low) >= {LEAST_LETTERS} GROUP BY ALL),
h AS (SELECT low, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM d, tab),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {DROPPED} = 0 THEN substr(low, 1, h % length(low)) || substr(low, h % length(low) + 2) ELSE low END AS word FROM h)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
f AS MATERIALIZED (SELECT w.word, w.n, count(other) AS n_near, first(other ORDER BY pairs.n DESC, other) AS o, max(pairs.n) AS o_n FROM w LEFT JOIN pairs ON pairs.word = w.word GROUP BY ALL),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN o_n >= {TIMES} * n THEN o END AS form, CASE WHEN o_n >= {TIMES} * n THEN o_n END AS form_n FROM f),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS root, 0 AS k FROM g UNION ALL SELECT c.word, g.form, k + 1 FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL) SELECT word, max_by(root, k) AS root FROM c GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM g JOIN chain USING (word)
"""
