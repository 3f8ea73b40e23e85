"""Exact dedup by a tree merge of sorted digest runs (operator 9).

Every input partition turns its texts into sorted runs of digests, each merged from what its Arrow batches
bring; runs are split by digest range, and in each range the partitions exchange runs in binomial rounds: in round r,
partition i takes the run of partition i + 2**r, until partition 0 has all. Every merge keeps per digest the row that stays
(most code points, then smallest id) and the group's size, and verifies that all runs agree on the normalised text's
length and on its second digest (BLAKE2b). A group of copies is one entry from the first run on, whatever its
size, and a range's run is bounded by the number of ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.batches import ROW_KEYS, as_row_keys, cut, keyed, with_null_ids, with_row_keys
from llm.worker import drop_tool, give_back

#: Rows that a partition gathers before it merges them into a run.
RUN_ROWS = 1_000_000
#: Digests that one range's final run holds on average.
RANGE_ROWS = 100_000
_DROP = bytes([0x20, *range(0x09, 0x0E)])
#: Groups of more rows than this, and than a thousandth of all, meet their rows by broadcast: a thousand at most.
HOT_ROWS = 10_000
_DIGESTS = "doc_id long, no_id boolean, mark long, n_points long, n_bytes long, digest binary, second binary"
#: Columns of a run besides its digests, end to end in one blob each: type and width.
_COLUMNS = {"seconds": (np.uint8, 16), "ids": (np.int64, 1), "nulls": (np.uint8, 1), "points": (np.int64, 1), "rows": (np.int64, 1), "sizes": (np.int64, 1), "lengths": (np.int64, 1)}
_RUNS = "part int, node int, digests binary, " + ", ".join(f"{c} binary" for c in _COLUMNS)
Run = dict[str, np.ndarray]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_tool()
    for batch in batches:
        digests, seconds, lengths = [], [], []
        for text in batch.column("text").cast(pa.large_binary()):
            bare = text.as_py().translate(None, _DROP)
            digests.append(hashlib.sha256(bare).digest())
            seconds.append(hashlib.blake2b(bare, digest_size=16).digest())
            lengths.append(len(bare))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "no_id", "mark")), pc.utf8_length(batch.column("text")).cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.binary()), pa.array(seconds, pa.binary())],
            names=["doc_id", "no_id", "mark", "n_points", "n_bytes", "digest", "second"],
        )
    give_back()


def _merged(run: Run) -> Run:
    """One sorted entry per digest: the best row of all, sizes added up, lengths and second digests verified."""
    keys = run["digests"].view(">u8").reshape(-1, 4)
    order = np.lexsort((run["rows"], run["ids"], run["nulls"], -run["points"], keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))
    run = {c: v[order] for c, v in run.items()}
    same = (run["digests"][1:] == run["digests"][:-1]).all(axis=1)
    unlike = (run["lengths"][1:] != run["lengths"][:-1]) | (run["seconds"][1:] != run["seconds"][:-1]).any(axis=1)
    if (same & unlike).any():
        raise ValueError("two different texts have one SHA-256 digest")
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    return {c: v[head] for c, v in run.items()} | {"sizes": np.add.reduceat(run["sizes"], head)}


def _run_rows(parts: np.ndarray, node: int, run: Run) -> pa.Table:
    """A run as rows, one for each range."""
    heads = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]))
    bounds = list(zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True))
    cols = {"part": pa.array(parts[heads[:-1]], pa.int32()), "node": pa.array([node] * len(bounds), pa.int32())}
    return pa.table(cols | {c: pa.array([v[lo:hi].tobytes() for lo, hi in bounds], pa.binary()) for c, v in run.items()})


def _leaf_runs(ranges: int):
    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = TaskContext.get().partitionId(), []

        def run() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            number = lambda c: table.column(c).to_numpy()
            raw = lambda c, width: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(-1, width)
            merged = _merged(
                {
                    "digests": raw("digest", 32), "seconds": raw("second", 16), "ids": number("doc_id"), "nulls": number("no_id").astype(np.uint8), "points": number("n_points"),
                    "rows": number("row"), "sizes": np.ones(table.num_rows, np.int64), "lengths": number("n_bytes"),
                }
            )
            first = merged["digests"].view(">u4").reshape(-1, 8)[:, 0].astype(np.int64)
            held.clear()
            return iter(_run_rows(first * ranges >> 32, node, merged).to_batches())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= RUN_ROWS:
                yield from run()
        if held:
            yield from run()

    return leaf


def _merge_runs(table: pa.Table) -> pa.Table:
    if table.num_rows == 1:
        return table
    joined = lambda c: b"".join(table.column(c).to_pylist())
    run = {"digests": np.frombuffer(joined("digests"), np.uint8).reshape(-1, 32)}
    for c, (kind, width) in _COLUMNS.items():
        flat = np.frombuffer(joined(c), kind)
        run[c] = flat.reshape(-1, width) if width > 1 else flat
    merged = _merged(run)
    return _run_rows(np.full(len(merged["ids"]), table.column("part")[0].as_py()), table.column("node")[0].as_py(), merged)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw, gone = row["digests"], np.frombuffer(row["nulls"], np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()),
                    pa.array(np.frombuffer(row["ids"], np.int64), mask=gone),
                    pa.array(np.frombuffer(row["rows"], np.int64)),
                    pa.array(np.frombuffer(row["sizes"], np.int64)),
                ],
                names=["digest", "keep_id", "keep_row", "group_size"],
            )


def _verdicts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """exact_dedup's rows with no_id, and ``mark``, a hash of the original text."""
    marked = keyed(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    # A number for each row, so that of rows that repeat id and text one is meant; the written table fixes it.
    rows = cut(marked.mapInArrow(_digest, _DIGESTS).withColumn("row", F.monotonically_increasing_id()), "digests")
    total = rows.count()
    ranges = max(64, -(-total // RANGE_ROWS))
    leaves = max(1, rows.rdd.getNumPartitions())
    runs = rows.mapInArrow(_leaf_runs(ranges), _RUNS)
    for _ in range(max(1, (leaves - 1).bit_length())):
        runs = runs.withColumn("node", F.shiftright("node", 1)).groupBy("part", "node").applyInArrow(_merge_runs, _RUNS)
    best = cut(runs.mapInArrow(_entries, "digest binary, keep_id long, keep_row long, group_size long"), "kept-rows")
    # At most a thousand groups hold a thousandth of the rows each: those are broadcast, so that no task gathers them.
    is_hot = F.col("group_size") > max(HOT_ROWS, total // 1000)
    hot = F.broadcast(best.where(is_hot))
    met = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(best.where(~is_hot), "digest"))
    return met.select("doc_id", "no_id", "mark", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal if they are identical without ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the
    most code points in its original text stays, then the smallest id. Defined cases: a null text is
    empty, and all empty or blank texts are one group; a null id is larger than any other and comes back
    as null, in keep_id, too; of rows that repeat id and text, all count, and one is kept; an empty table gives an empty
    result. Other columns are ignored.
    """
    return with_null_ids(_verdicts(docs, id_col, text_col).drop("mark"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Defined cases: null and blank texts are one group, of which one row stays; a row with a null id stays only if its group
    has no other; of repeated rows one stays; an empty table stays empty.
    """
    kept = as_row_keys(_verdicts(docs, id_col, text_col).where("kept"))
    return with_row_keys(docs, id_col, text_col).join(kept, ROW_KEYS, "left_semi").dropDuplicates(ROW_KEYS).select(*docs.columns)
