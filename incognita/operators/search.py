"""Which texts hold which terms: one pass of an automaton where the terms are few, a join on rare grams beyond.

No text meets a term that it can't hold, and neither side is broadcast unless its size is known.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.sources.shared import cut

#: Terms, and characters of all of them, up to which an automaton is sent to the tasks.
FEW_TERMS, FEW_CHARS = 50_000, 2_000_000
#: Bytes of the grams by which more terms than that are looked up; bytes of text that are searched for them at once.
GRAM, CHUNK = 8, 1 << 20
#: Characters of terms whose grams one task makes.
TERM_CHARS = 1 << 18
#: The filter of the terms' grams has 2**MOST_BITS bits (16 MB) at most, and is put together in blocks of 2**BLOCK_BITS.
MOST_BITS, BLOCK_BITS = 27, 16
#: The automaton, or filter, of the last search that a worker took part in.
_AUTOMATON: dict[str, object] = {}


def holding(texts: DataFrame, terms: DataFrame, *keys: str, text: str = "text", term: str = "term", few: int = FEW_TERMS) -> DataFrame:
    """keys and all columns of terms for each pair of a text and a term that stands anywhere in it, each once.

    The keys tell the texts apart. Null texts hold nothing; null and empty terms stand nowhere. ``few``: the most terms for the automaton.
    """
    needles = terms.select(F.col(term).alias("_needle")).where(F.length("_needle") > 0).distinct()
    size = needles.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_needle")), F.lit(0)).alias("chars")).first()
    small = size["n"] <= few and size["chars"] <= FEW_CHARS
    held = texts.select(*keys, F.col(text).alias("_text")).where("_text IS NOT NULL")
    found = _by_automaton(held, [r["_needle"] for r in needles.collect()], keys) if small else _by_grams(held, needles, keys, size["chars"])
    return found.join(F.broadcast(terms) if small and _fits(terms, few) else terms, found["_needle"] == terms[term]).drop("_needle")


def _fits(rows: DataFrame, few: int) -> bool:
    """Whether rows are few enough, and short enough in all their columns together, to be sent to every task."""
    laid = F.length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in rows.columns]))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(laid), F.lit(0)).alias("chars")).first()
    return size["n"] <= few and size["chars"] <= 4 * FEW_CHARS


def _by_automaton(texts: DataFrame, needles: list[str], keys: tuple[str, ...]) -> DataFrame:
    spark = texts.sparkSession
    shared, name = spark.sparkContext.broadcast(needles), uuid.uuid4().hex
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if name not in _AUTOMATON:
            _AUTOMATON.clear()
            made = ahocorasick.Automaton()
            for needle in shared.value:
                made.add_word(needle, needle)
            made.make_automaton()
            _AUTOMATON[name] = made
        automaton = _AUTOMATON[name]
        for batch in batches:
            rows, found = [], []
            if len(automaton):
                for i, value in enumerate(batch.column("_text").to_pylist()):
                    hits = {needle for _, needle in automaton.iter(value)}
                    rows += [i] * len(hits)
                    found += hits
            kept = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(kept) for k in keys), pa.array(found, pa.string())], names=[*keys, "_needle"])

    return texts.mapInArrow(run, f"{kinds}, _needle string")


def _by_grams(texts: DataFrame, needles: DataFrame, keys: tuple[str, ...], chars: int) -> DataFrame:
    """Each term is looked up by that gram of it which fewest terms have, short ones by themselves. A text gives out only those of its grams that a filter of
    bounded size lets pass."""
    # Grams go with a number, not with their term, which compresses so well that Spark would lay very many of them in one task; and the terms, which are small
    # beside their grams, are dealt over as many tasks as those need.
    numbered = cut(needles.withColumn("_id", F.monotonically_increasing_id()), "needles").select("_id", "_needle")
    own = numbered.repartition(1 + chars // TERM_CHARS).mapInArrow(_term_grams, "_id long, _size int, _gram long")
    common = own.groupBy("_size", "_gram").agg(F.count("*").alias("_n"))
    rarest = own.join(common.hint("merge"), ["_size", "_gram"]).groupBy("_id").agg(F.min_by(F.struct("_size", "_gram"), F.struct("_n", "_gram")).alias("g"))
    rarest = cut(rarest.join(numbered.hint("merge"), "_id").select("_needle", "g.*"), "rarest-grams")
    met = _grams_met(texts, rarest, keys).join(rarest.hint("merge"), ["_size", "_gram"]).select(*keys, "_needle").distinct()
    # The grams go without their texts, which are met again by their keys for the check.
    return met.join(texts.hint("merge"), list(keys)).where(F.contains("_text", F.col("_needle"))).select(*keys, "_needle")


def _grams_at(data: np.ndarray) -> np.ndarray:
    """The GRAM bytes from each place on as one number; zeros stand behind the last."""
    laid = np.concatenate((data, np.zeros(GRAM, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for k in range(GRAM):
        out |= laid[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _shortened(grams: np.ndarray, size: int) -> np.ndarray:
    return grams & np.uint64((1 << 8 * size) - 1)


def _term_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column, and size and gram of each gram that a term, the last column, has."""
    for batch in batches:
        rows, sizes, grams = [], [], []
        for i, raw in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
            size = min(len(raw), GRAM)
            own = np.unique(_shortened(_grams_at(np.frombuffer(raw, np.uint8)), size)[: len(raw) - size + 1])
            rows.append(np.full(len(own), i, np.int64))
            sizes.append(np.full(len(own), size, np.int32))
            grams.append(own.view(np.int64))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(grams))], names=[batch.schema.names[0], "_size", "_gram"])


def _slots(grams: np.ndarray, size: int, bits: int) -> list[np.ndarray]:
    """The places of grams in a filter of 2**bits bits."""
    mixed = (grams ^ np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return [mixed >> np.uint64(64 - bits), (mixed ^ (mixed >> np.uint64(32))) & np.uint64((1 << bits) - 1)]


def _gram_filter(rarest: DataFrame) -> tuple[int, list[int], list]:
    """The bits of the filter, the grams' sizes, and the filter in blocks (number, bytes), which are put together on the tasks: 2**MOST_BITS bits at most come
    to the driver, however many terms there are."""
    sizes = {r["_size"]: r["n"] for r in rarest.groupBy("_size").agg(F.count("*").alias("n")).collect()}  # GRAM rows at most
    bits = min(max(sum(sizes.values()) * 32, 1 << BLOCK_BITS).bit_length(), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, grams = batch.column("_size").to_numpy(), batch.column("_gram").to_numpy().view(np.uint64)
            slots = [s for n in np.unique(size) for s in _slots(grams[size == n], int(n), bits)]
            slots = np.unique(np.concatenate(slots)).astype(np.int64) if slots else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots >> BLOCK_BITS), pa.array((slots & ((1 << BLOCK_BITS) - 1)).astype(np.int32))], names=["block", "place"])

    def block(table: pa.Table) -> pa.Table:
        laid = np.zeros(1 << BLOCK_BITS, dtype=bool)
        laid[table.column("place").to_numpy()] = True
        return pa.table({"block": table.column("block")[:1], "laid": pa.array([np.packbits(laid, bitorder="little").tobytes()], pa.binary())})

    blocks = rarest.select("_size", "_gram").distinct().mapInArrow(places, "block long, place int").groupBy("block").applyInArrow(block, "block long, laid binary")
    return bits, sorted(sizes), [(r["block"], bytes(r["laid"])) for r in blocks.collect()]


def _grams_met(texts: DataFrame, rarest: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, _size and _gram of the texts' grams that the filter lets pass: those of the terms, and few others."""
    bits, sizes, blocks = _gram_filter(rarest)
    shared, name = texts.sparkSession.sparkContext.broadcast(blocks), uuid.uuid4().hex
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _AUTOMATON:
            _AUTOMATON.clear()
            made = np.zeros(1 << bits - 3, np.uint8)
            for number, laid in shared.value:
                made[number << BLOCK_BITS - 3 : number + 1 << BLOCK_BITS - 3] = np.frombuffer(laid, np.uint8)
            _AUTOMATON[name] = made
        laid = _AUTOMATON[name]
        for batch in batches:
            plain = pa.concat_arrays([batch.column("_text")]).cast(pa.large_binary())
            _, offsets, data = plain.buffers()
            at = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            lo = 0
            while lo < len(plain):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
                rows, of_size, grams = _passing(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], sizes, bits, laid)
                kept = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(kept) for k in keys), pa.array(of_size), pa.array(grams)], names=[*keys, "_size", "_gram"])
                lo = hi

    return texts.mapInArrow(run, f"{kinds}, _size int, _gram long")


def _passing(data: np.ndarray, at: np.ndarray, sizes: list[int], bits: int, laid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, size and gram, each once, of the grams of some texts that pass the filter. ``at``: where each text begins in data, and the end."""
    whole, found = _grams_at(data), []
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    for size in sizes:
        grams = _shortened(whole, size)
        one, two = _slots(grams, size, bits)
        hits = np.flatnonzero((laid[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & 1 & (left >= size))
        two = two[hits]
        hits = hits[(laid[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        rows, own = np.searchsorted(at, hits, side="right") - 1, grams[hits].view(np.int64)
        order = np.lexsort((own, rows))
        rows, own = rows[order], own[order]
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (rows[1:] != rows[:-1]) | (own[1:] != own[:-1])
        found.append((rows[first].astype(np.int64), np.full(int(first.sum()), size, np.int32), own[first]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))
