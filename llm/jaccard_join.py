"""N-gram Jaccard self-join with set-relation skipping (operator 8).

Each document is its set of word shingles (64-bit hashes). Shingles are ordered
from rare to frequent, so that a document's *prefix* holds what it shares with
few others; two similar sets share a shingle of both prefixes. Index lists hold
(document, size, position) entries and are used in two ways:

* *Answers first.* Each list names a pivot, its most central set. Every entry is
  compared with its lists' pivots: a linear number of pairs, whose exact overlaps
  are the pivots' answers and whose links form first components.
* *Lists by block.* What may be left lies between different components. Lists
  are cut into blocks by component, size and position; two blocks are skipped at once
  if their sizes, their reach behind their positions or their overlaps with the list's pivot
  rule the overlap out. For the pairs of the others, answers are derived from the
  pivot's: what both share with it bounds what they share with each other from both
  sides. Only pairs that stay open are verified.

Identical sets are one class from the start, so copies cost one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.batches import batch_count, by_bucket, census_width, chunks, cut, dealt, exchange, keyed, ordered_docs, pack_hashes, per_batch, shorten, split_runs, unpack_hashes
from llm.components import connected
from llm.substring_dedup import _maybe_twice
from llm.vectext import BYTE_KEYS, distinct, mix, owner, prefix_sums, range_hash, text_hash, words_of

SHINGLE, PERCENT = 5, 80
#: Size and position classes of the blocks of an index list.
LEVELS, PLACES = 32, 16
_SETS = "doc_id long, no_id boolean, n_shingles long, mark1 long, mark2 long, n_alone long, shingles binary, prefix array<long>"


class _Sets:
    """A batch's shingle sets, end to end; ``first`` holds the offsets of the documents."""

    def __init__(self, table: pa.Table, shingle: int):
        self.ids, data, at, order = ordered_docs(table)
        self.no_id = table.column("no_id").to_numpy()[order]
        parts, sizes = [], []
        for _, _, part, bounds in chunks(data, at):
            low = part + ((part >= 65) & (part <= 90)).astype(np.uint8) * np.uint8(32)
            starts, ends, first = words_of(low, bounds)
            words = text_hash(low, prefix_sums(BYTE_KEYS[low]), starts, ends) | np.uint64(1)
            count = np.diff(first)
            n_windows = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
            doc = np.repeat(np.arange(len(count)), n_windows)
            rank = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
            begin = first[:-1][doc] + rank
            values = range_hash(prefix_sums(words), begin, begin + np.minimum(shingle, count)[doc])
            keep = np.ones(len(values), dtype=bool)
            twice = _maybe_twice(values)
            order = twice[np.lexsort((twice, values[twice], doc[twice]))]
            keep[order[1:][(values[order[1:]] == values[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])]] = False
            parts.append(values[keep])
            sizes.append(np.bincount(doc[keep], minlength=len(count)))
        self.values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.doc = owner(self.first)

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return (total[self.first[1:]] - total[self.first[:-1]]).view(np.int64)


class _Frequencies:
    """The census of shingles: for each that occurs in one document only, 0, else the bit length of its
    document count. Runs inside tasks."""

    def __init__(self, shingle: int, percent: int, buckets: int, width: int):
        self.shingle, self.percent, self.buckets, self.width = shingle, percent, buckets, width

    def ask(self, batch: int, table: pa.Table, got: dict) -> dict[int, bytes]:
        ranked = np.sort(shorten(_Sets(table, self.shingle).values, self.width))
        head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.empty(0, np.int64)
        sent, counts = ranked[head], np.diff(np.concatenate((head, [len(ranked)])))
        out = {}
        for b, lo, hi in split_runs(sent, self.buckets):
            many = np.flatnonzero(counts[lo:hi] > 1).astype(np.uint32)
            out[b] = np.uint32([hi - lo]).tobytes() + pack_hashes(sent[lo:hi], self.width) + many.tobytes() + counts[lo:hi][many].astype(np.uint32).tobytes()
        return out

    def answer(self, asked: dict[int, memoryview]) -> dict[int, bytes]:
        keys, counts = {}, []
        for batch, payload in asked.items():
            n = int(np.frombuffer(payload[:4], np.uint32)[0])
            keys[batch] = unpack_hashes(payload[4 : 4 + n * self.width], self.width)
            many, number = np.frombuffer(payload[4 + n * self.width :], np.uint32).reshape(2, -1)
            own = np.ones(n, np.int64)
            own[many] = number
            counts.append(own)
        pool = np.concatenate(list(keys.values()))
        order = np.argsort(pool)
        pool = pool[order]
        head = np.flatnonzero(np.concatenate(([True], pool[1:] != pool[:-1])))
        total = np.add.reduceat(np.concatenate(counts)[order], head)
        shared = total > 1
        pool, total = pool[head][shared], total[shared]
        grade = np.frexp(total.astype(float))[1].astype(np.uint8)
        out = {}
        for batch, own in keys.items():
            at = np.searchsorted(pool, own)
            at[at == len(pool)] = 0
            hit = pool[at] == own if len(pool) else np.zeros(len(own), dtype=bool)
            out[batch] = np.packbits(hit).tobytes() + grade[at[hit]].tobytes()
        return out

    def grades(self, values: np.ndarray, got: dict[int, memoryview]) -> np.ndarray:
        """The grade of each shingle from the buckets' answers."""
        short = shorten(values, self.width)
        sent = distinct(short)
        grade = np.zeros(len(sent), np.uint8)
        for b, lo, hi in split_runs(sent, self.buckets):
            if b in got:
                n = hi - lo
                bits = np.unpackbits(np.frombuffer(got[b][: -(-n // 8)], np.uint8), count=n).astype(bool)
                grade[lo:hi][bits] = np.frombuffer(got[b][-(-n // 8) :], np.uint8)
        hot = sent[grade > 0]
        grade = grade[grade > 0]
        if not len(hot):
            return np.zeros(len(values), np.uint8)
        at = np.searchsorted(hot, short)
        at[at == len(hot)] = 0
        return np.where(hot[at] == short, grade[at], np.uint8(0))

    def sets(self, batch: int, table: pa.Table, got: dict) -> pa.Table:
        """Every document's size and digest; of those whose prefix holds a shared shingle, the set and the
        prefix from there on. Of identical sets in a batch only the smallest id carries them."""
        sets = _Sets(table, self.shingle)
        grade = self.grades(sets.values, got)
        n = sets.sizes
        prefix = n - -(-self.percent * n // 100) + 1
        alone = np.bincount(sets.doc[grade == 0], minlength=len(n)) if len(n) else n
        mark1, mark2 = sets.sums(mix(sets.values)), sets.sums(mix(sets.values ^ np.uint64(0x5BD1E9955BD1E995)))
        shingles: list[bytes | None] = [None] * len(n)
        prefixes: list[np.ndarray | None] = [None] * len(n)
        seen = set()
        for i in np.flatnonzero((n > 0) & (alone < prefix) & ~sets.no_id).tolist():
            key = (mark1[i], mark2[i], n[i])
            if key in seen:
                continue
            seen.add(key)
            lo, hi = sets.first[i], sets.first[i + 1]
            own = np.sort(sets.values[lo:hi])
            order = np.lexsort((sets.values[lo:hi], grade[lo:hi]))
            shingles[i] = own.tobytes()
            prefixes[i] = sets.values[lo:hi][order[alone[i] : prefix[i]]].view(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(sets.ids),
                "no_id": pa.array(sets.no_id),
                "n_shingles": pa.array(n),
                "mark1": pa.array(mark1),
                "mark2": pa.array(mark2),
                "n_alone": pa.array(alone.astype(np.int64)),
                "shingles": pa.array(shingles, pa.binary()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())),
            }
        )


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("shingles_x").to_pylist(), batch.column("shingles_y").to_pylist()
        out = np.empty(len(a), np.int64)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            both.sort()
            out[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("x", "y", "n_x", "n_y")] + [pa.array(out)], names=["x", "y", "n_x", "n_y", "overlap"])


def _needed(percent: int):
    """Least overlap of two sets, from their sizes: overlap >= percent % of the union."""
    return F.ceil(F.lit(percent) * (F.col("n_x") + F.col("n_y")) / F.lit(100 + percent) - F.lit(1e-9))


def _fits(percent: int):
    """Size and position filters for two entries of one list."""
    reach = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    return (F.lit(100) * F.least("n_x", "n_y") >= F.lit(percent) * F.greatest("n_x", "n_y")) & (reach >= _needed(percent))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, n_x, n_y and the exact overlap of each pair."""
    for side in ("x", "y"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("shingles").alias(f"shingles_{side}")), side)
    return pairs.mapInArrow(_overlaps, "x long, y long, n_x long, n_y long, overlap long")


def _level(size: Column, percent: int) -> Column:
    """Size class: LEVELS of them span the sizes that can be similar to one."""
    return F.floor(F.log(F.greatest(size.cast("double"), F.lit(1.0))) / F.lit(float(np.log(100 / percent)) / LEVELS))


def _side(entries: DataFrame, side: str, *names: str) -> DataFrame:
    return entries.select("token", *[F.col(c).alias(f"{c}_{side}" if c != "doc_id" else side) for c in ("doc_id", "n", "pos", *names)])


def jaccard_links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links). members: doc_id, no_id, n_shingles and class_id (smallest id with an identical set) of every
    row; links: pairs x, y of classes that connect all classes that are connected by links. Rows with a null id
    have no class."""
    batches, total = batch_count(docs, text_col)
    steps = _Frequencies(shingle, percent, batches, census_width(total // 4))
    texts = dealt(keyed(docs, id_col, text_col), batches)
    counted = exchange(texts, None, steps.ask, steps.answer)
    table = cut(per_batch(texts, counted, steps.sets, _SETS), "shingle-sets")
    named = table.where("NOT no_id")
    carried = named.where(F.col("shingles").isNotNull())
    classes = carried.groupBy("mark1", "mark2", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    members = table.select("doc_id", "no_id", "n_shingles", "mark1", "mark2").join(classes, ["mark1", "mark2", "n_shingles"], "left").select(
        "doc_id", "no_id", "n_shingles", F.when(~F.col("no_id"), F.coalesce("class_id", "doc_id")).alias("class_id")
    )
    own = F.col("doc_id") == F.col("class_id")
    heads = classes.select(F.col("class_id").alias("doc_id"), "mark1", "mark2")
    entries = cut(
        carried.select("doc_id", "mark1", "mark2", F.col("n_shingles").alias("n"), "n_alone", F.posexplode("prefix").alias("k", "token"))
        .join(heads, ["doc_id", "mark1", "mark2"], "left_semi")
        .select("token", "doc_id", "n", "n_alone", (F.col("n_alone") + F.col("k")).alias("pos")),
        "index-lists",
    )
    sets = carried.select("doc_id", "n_shingles", "shingles")

    pivots = entries.groupBy("token").agg(F.min(F.struct("n_alone", "doc_id", "n", "pos")).alias("p"), F.count("*").alias("c")).where("c > 1")
    pivots = pivots.select("token", F.col("p.doc_id").alias("y"), F.col("p.n").alias("n_y"), F.col("p.pos").alias("pos_y"))
    first = _side(entries, "x").join(pivots, "token").where((F.col("x") != F.col("y")) & _fits(percent))
    answers = cut(_verify(first.select("x", "y").distinct(), sets), "answers")
    linked = F.col("overlap") >= _needed(percent)
    near = answers.where(linked).select("x", "y")
    parts = cut(connected(near), "components")

    # Each entry learns its overlap with its list's pivot P (in), and how many of its shingles that others have
    # lie outside P (out). Two entries overlap in at most least(in) + least(out), and in at least in + in - |P|.
    # An entry that was never compared may have all of its shared shingles on either side.
    common = F.col("n") - F.col("n_alone")
    labelled = (
        entries.join(pivots.select("token", F.col("y").alias("pivot"), F.col("n_y").alias("n_pivot")), "token")
        .join(answers.select(F.col("x").alias("doc_id"), F.col("y").alias("pivot"), "overlap"), ["doc_id", "pivot"], "left")
        .join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        .select(
            "token", "doc_id", "n", "pos", "n_pivot", F.coalesce("component", "doc_id").alias("part"),
            _level(F.col("n"), percent).alias("level"),
            F.floor(F.lit(PLACES) * F.col("pos") / (F.col("n") * F.lit(1 - percent / 100) + 1)).alias("place"),
            F.when(F.col("doc_id") == F.col("pivot"), F.col("n")).otherwise(F.coalesce("overlap", common)).alias("in"),
            F.when(F.col("doc_id") == F.col("pivot"), F.lit(0)).otherwise(F.coalesce(common - F.col("overlap"), common)).alias("out"),
            (F.col("overlap").isNotNull() | (F.col("doc_id") == F.col("pivot"))).alias("compared"),
        )
    )
    mixed = labelled.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("token")
    labelled = cut(labelled.join(mixed, "token", "left_semi"), "open-lists")
    keys = ["part", "level", "place"]
    blocks = labelled.groupBy("token", *keys).agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("reach"), F.max("in").alias("in"), F.max("out").alias("out"))
    one, two = (blocks.select("token", *[F.col(c).alias(f"{c}_{side}") for c in blocks.columns if c != "token"]) for side in ("x", "y"))
    # A block meets only blocks of sizes that its own size and reach allow.
    share = percent / 100
    largest = F.least(F.col("most_x") / F.lit(share), F.col("reach_x") * F.lit((1 + share) / share) - F.col("n_x"))
    one = one.withColumn("level_y", F.explode(F.sequence(_level(F.col("n_x") * F.lit(share), percent), F.greatest(_level(largest, percent), _level(F.col("n_x") * F.lit(share), percent)))))
    within = F.least("in_x", "in_y") + F.least("out_x", "out_y") >= _needed(percent)
    open_blocks = one.join(two, ["token", "level_y"]).where(
        (F.col("part_x") < F.col("part_y")) & (F.least("reach_x", "reach_y") >= _needed(percent)) & within
    ).select("token", *[f"{k}_{side}" for side in ("x", "y") for k in keys])
    rest = (
        _side(labelled, "x", *keys, "in", "out", "compared", "n_pivot")
        .join(open_blocks, ["token", *[f"{k}_x" for k in keys]])
        .join(_side(labelled, "y", *keys, "in", "out", "compared"), ["token", *[f"{k}_y" for k in keys]])
        .where(_fits(percent) & within)
    )
    certain = F.col("compared_x") & F.col("compared_y") & (F.col("in_x") + F.col("in_y") - F.col("n_pivot_x") >= _needed(percent))
    derived = cut(rest.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max(certain).alias("certain")), "open-pairs")
    checked = _verify(derived.where("NOT certain").select("x", "y"), sets).where(linked).select("x", "y")
    links = parts.select(F.col("node").alias("x"), F.col("component").alias("y")).unionAll(derived.where("certain").select("x", "y")).unionAll(checked)
    # An id that several rows share names one node.
    shared = members.where("class_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("x"), F.max("class_id").alias("most")).where("x < most")
    again = members.join(shared.select("doc_id", "x"), "doc_id").where(F.col("class_id") != F.col("x")).select("x", F.col("class_id").alias("y"))
    return members, links.unionAll(again)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row.

    A document's set: its distinct shingles of ``shingle`` words, ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased;
    the whole sequence if it has fewer words. Two documents link if their sets' overlap is at least
    ``percent`` % of their union. Defined cases: without words (null, empty or blank text) n_shingles is 0 and
    the document links with nothing; identical sets link; rows that share an id are one node; a row with a
    null id links with nothing and has a null component_id; an empty table gives an empty result. Other
    columns are ignored.
    """
    members, links = jaccard_links(docs, shingle, percent, id_col, text_col)
    parts = connected(links).select(F.col("node").alias("class_id"), "component")
    return members.join(parts, "class_id", "left").select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_shingles", F.coalesce("component", "class_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of their component, with all their columns.

    Defined cases: rows with a null id stay; rows without words are components of their own and stay; all rows that share a
    kept id stay, as one node; an empty table stays empty.
    """
    keep = jaccard_components(docs, shingle, percent, id_col, text_col).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(keep, docs[id_col].cast("long") == keep["_kept_id"], "left_semi").unionByName(docs.where(docs[id_col].cast("long").isNull()))
