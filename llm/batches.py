"""Spark plumbing for operators that compare documents by content.

Documents are dealt by id into *batches* of bounded size; a batch keeps its
texts together so that NumPy can work on a few megabytes at a time. A *round*
(:func:`exchange`) lets every batch put questions to hash buckets and get one
packed answer from each: the questions are sorted, distinct hashes in binary
blobs, so that Spark shuffles a few rows of bounded size and a key that a
third of all documents share reaches its bucket once per batch, not once per
document. Everything is one lineage of shuffles; a lost executor costs only a
recomputation of its share.

Batches and buckets are as many, so the blobs of a round grow with their square. Batches therefore
grow with the root of the input (batch_size), and only buckets that a batch has hashes for get a blob: there are
never more blobs than hashes.

A null id counts as the largest id, NO_ID, wherever ids are compared; the column ``no_id`` tells it from a row that
has that id, and makes it null again in results.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from llm.vectext import distinct
from llm.worker import drop_tool, give_back

#: What a null id counts as in comparisons.
NO_ID = 2**63 - 1
#: Text bytes that one batch holds on average: at least and at most (what a Python worker can hold some thirty times
#: over; raise it with executor memory), and so many as give blobs of about BLOB_BYTES. And the least number of batches.
BATCH_BYTES, MOST_BATCH_BYTES, BLOB_BYTES, LEAST_BATCHES = 4 << 20, 32 << 20, 1 << 10, 64
#: Text bytes that NumPy works on at once inside a batch (a longer document is worked on whole).
CHUNK_BYTES = 1 << 18
#: The bucket under which a batch finds the note that it sent to itself.
NOTE = -1

BLOBS = "batch int, bucket int, payload binary"


def long_ids(docs: DataFrame, id_col: str) -> Column:
    """The ids as longs. Ids of another kind would all become null by a cast, and are an error."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"ids must be integers, but {id_col} is {kind.simpleString()}")
    return docs[id_col].cast("long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (null: NO_ID), no_id (whether it was null) and text (null: empty) alone, whatever other columns there are."""
    own = long_ids(docs, id_col)
    return docs.select(F.coalesce(own, F.lit(NO_ID)).alias("doc_id"), own.isNull().alias("no_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as it is) and text (null: empty) alone, for operators that compare no ids."""
    return docs.select(long_ids(docs, id_col).alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def with_null_ids(df: DataFrame) -> DataFrame:
    """doc_id null again where no_id says so; no_id goes."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


#: Columns that tell a row of documents by its id and text.
ROW_KEYS = ["_own_id", "_own_none", "_own_mark"]


def with_row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ROW_KEYS. Plain columns, none of them null, so that a join by them and what follows share one shuffle."""
    own = long_ids(docs, id_col)
    return docs.withColumns({"_own_id": F.coalesce(own, F.lit(NO_ID)), "_own_none": own.isNull(), "_own_mark": F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))})


def as_row_keys(rows: DataFrame, *others: Column) -> DataFrame:
    """ROW_KEYS from doc_id, no_id and mark, and other columns."""
    return rows.select(F.col("doc_id").alias("_own_id"), F.col("no_id").alias("_own_none"), F.col("mark").alias("_own_mark"), *others)


def batch_size(total: int) -> int:
    """Text bytes of a batch: blobs are about a batch's bytes divided by the number of batches."""
    return min(MOST_BATCH_BYTES, max(BATCH_BYTES, isqrt(total * BLOB_BYTES)))


def batch_count(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Number of batches (and of hash buckets) for these texts, and their bytes, counted over all rows."""
    total = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string"))).alias("b")).first()["b"] or 0
    return max(LEAST_BATCHES, -(-total // batch_size(total))), total


def dealt(docs: DataFrame, batches: int) -> DataFrame:
    """Adds the batch of each document, by id and text, so that neither a frequent id nor null ids crowd; one exchange by it
    serves every later pass."""
    return docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only in local mode where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables that cut has written and nothing has deleted yet.
_WRITTEN: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and each later use reads files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of cut that nothing will read again."""
    for path in paths:
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """The tables that cut writes inside the block, in order."""
    before, paths = len(_WRITTEN), []
    yield paths
    paths += _WRITTEN[before:]


def column_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and its n + 1 offsets."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``size`` bytes: (first, behind the last, bytes, bounds from 0)."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def ordered_docs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a batch's documents in a fixed order, and their places in the table.

    The order is by id, then by length and content, so that every pass over a batch
    sees the same sequence even where ids repeat.
    """
    ids = table.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    if len(ids) and (np.diff(ids[order]) == 0).any():
        texts = table.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), dtype=np.int64)
    data, at = column_bytes(table.column("text").take(pa.array(order)))
    return ids[order], data, at, order


def exchange(
    docs: DataFrame,
    answers: DataFrame | None,
    ask: Callable[[int, pa.Table, dict[int, bytes]], dict[int, bytes]],
    answer: Callable[[dict[int, bytes]], dict[int, bytes]],
) -> DataFrame:
    """One round. ask(batch, docs, earlier answers by bucket) -> questions by bucket;
    answer(questions by batch) -> answers by batch. Returns the answers (BLOBS). What a batch asks under NOTE comes back
    to it as it is.

    A batch or bucket is what one task holds: both are bounded by the choice of their number.
    """

    def send(batch: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        return blobs((batch, NOTE - batch if bucket == NOTE else bucket, payload) for bucket, payload in ask(batch, table, got).items())

    def reply(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket <= NOTE:
            return table
        drop_tool()
        asked = dict(zip(table.column("batch").to_pylist(), (memoryview(x.as_buffer()) for x in table.column("payload")), strict=True))
        out = blobs((batch, bucket, payload) for batch, payload in answer(asked).items())
        give_back()
        return out

    asked = per_batch(docs, answers, send, BLOBS)
    return asked.groupBy("bucket").applyInArrow(reply, BLOBS)


def per_batch(docs: DataFrame, answers: DataFrame | None, fn: Callable[[int, pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Applies fn(batch, its documents, answers by bucket) to every batch of documents."""

    def run(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        drop_tool()
        out = fn(table.column("batch")[0].as_py(), table, got)
        give_back()
        return out

    if answers is None:
        return docs.groupBy("batch").applyInArrow(lambda table: run(table, {}), schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip((max(NOTE, b) for b in right.column("bucket").to_pylist()), (memoryview(x.as_buffer()) for x in right.column("payload")), strict=True))
        return run(left, got)

    return docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(both, schema)


def blobs(rows: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    batch, bucket, payload = [list(x) for x in zip(*rows, strict=True)] or ([], [], [])
    return pa.table({"batch": pa.array(batch, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "payload": pa.array(payload, pa.binary())})


def by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash: ordered as the hashes, so sorted hashes fall into runs."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def split_runs(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) runs of sorted hashes."""
    if not len(hashes):
        return []
    own = by_bucket(hashes, buckets)
    limits = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
    return list(zip(own[limits[:-1]].tolist(), limits[:-1].tolist(), limits[1:].tolist(), strict=True))


# --- the first round of all: which hashes occur in more than one batch ---------------------------------------------------

def census_width(items: int) -> int:
    """Bytes of a hash's upper bits that a census ships. Two different hashes that share them only cost a
    needless candidate, at a share of about items / 256**width."""
    return min(8, max(5, -(-(max(items, 2).bit_length() + 12) // 8)))


def pack_hashes(hashes: np.ndarray, width: int) -> bytes:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_hashes(payload: memoryview, width: int) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def shorten(hashes: np.ndarray, width: int) -> np.ndarray:
    """The upper ``width`` bytes of each hash."""
    return hashes >> np.uint64(64 - 8 * width) << np.uint64(64 - 8 * width)


def census_answer(width: int) -> Callable[[dict[int, memoryview]], dict[int, bytes]]:
    """Answers, for each hash that a batch sent, with one bit: another batch sent it, too."""

    def answer(asked: dict[int, memoryview]) -> dict[int, bytes]:
        sent = {batch: unpack_hashes(p, width) for batch, p in asked.items()}
        pool = np.sort(np.concatenate(list(sent.values())))
        twice = distinct(pool[1:][pool[1:] == pool[:-1]])
        return {batch: np.packbits(isin_sorted(h, twice)).tobytes() for batch, h in sent.items()}

    return answer


def isin_sorted(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted pool."""
    if not len(pool):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(pool, values)
    at[at == len(pool)] = 0
    return pool[at] == values


def answered_bits(sent: np.ndarray, buckets: int, got: dict[int, memoryview]) -> np.ndarray:
    """The bits that answer the sorted hashes ``sent``, in their order."""
    out = np.zeros(len(sent), dtype=bool)
    for bucket, lo, hi in split_runs(sent, buckets):
        if bucket in got:
            out[lo:hi] = np.unpackbits(np.frombuffer(got[bucket], np.uint8), count=hi - lo).astype(bool)
    return out
