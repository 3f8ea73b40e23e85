import numpy as np
import pytest

from llm.batches import BATCH_BYTES, MOST_BATCH_BYTES, batch_size, by_bucket, cut, delete_tables, keyed, split_runs, tables_written, with_null_ids


def test_ids_of_other_kinds_are_refused(spark):
    with pytest.raises(TypeError, match="doc_id is string"):
        keyed(spark.createDataFrame([("x1", "a")], "doc_id string, text string"))


def test_null_ids_and_the_largest_id_stay_apart(spark):
    rows = keyed(spark.createDataFrame([(None, "a"), (2**63 - 1, "b")], "doc_id long, text string"))
    assert {r.text: r.doc_id for r in with_null_ids(rows).collect()} == {"a": None, "b": 2**63 - 1}


def test_batches_grow_with_the_input():
    assert batch_size(0) == batch_size(10**9) == BATCH_BYTES < batch_size(10**11) < batch_size(10**14) == MOST_BATCH_BYTES


def test_runs_of_buckets():
    hashes = np.sort(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    for buckets in (1, 7, 1000, 10**6):
        runs = split_runs(hashes, buckets)
        assert [b for b, _, _ in runs] == sorted({*by_bucket(hashes, buckets).tolist()}) and all(0 <= b < buckets for b, _, _ in runs)
        assert runs[0][1] == 0 and runs[-1][2] == 500 and all(a[2] == b[1] for a, b in zip(runs, runs[1:], strict=False))
    assert split_runs(hashes[:0], 9) == []


def test_tables_are_deleted(spark):
    with tables_written() as paths:
        table = cut(spark.range(5), "some")
    assert table.count() == 5 and len(paths) == 1
    delete_tables(spark, paths)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(paths[0]).count()
