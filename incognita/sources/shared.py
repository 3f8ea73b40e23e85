"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only in local mode where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="incognita-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


#: Tables that cut has written, with their folders, until they are deleted.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def delete_tables(*tables: DataFrame) -> None:
    """Deletes tables of cut that nothing will read again; other DataFrames are left alone."""
    for table in tables:
        if entry := _PATHS.pop(id(table), None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
