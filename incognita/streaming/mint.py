"""Minting from a stream of findings.

One writer takes micro-batch after micro-batch. What a batch mints is written as the table's part of that batch, over whatever an interrupted try of the same batch
has left, and is minted against the parts of earlier batches alone: a batch that is replayed mints the same again, and nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from incognita.operators.vault import mint

MINTED = "original string, entity_type string, surrogate string, batch long"


def read_minted(spark: SparkSession, path: str) -> DataFrame:
    """The rows (MINTED) of a vault that a stream has minted; none if it has minted nothing yet."""
    try:
        return spark.read.schema(MINTED).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], MINTED)


def mint_batch(path: str, engagement: str) -> Callable[[DataFrame, int], None]:
    """What a micro-batch of findings (value, entity_type) does to the vault."""

    def write(found: DataFrame, batch: int) -> None:
        spark = found.sparkSession
        known = read_minted(spark, path).where(F.col("batch") < batch).select("original", "entity_type", "surrogate")
        wanted = found.where("value IS NOT NULL").select("value", "entity_type").distinct().join(known.select(F.col("original").alias("value")), "value", "left_anti")
        minted = mint(wanted, known, engagement)
        minted.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def minting(found: DataFrame, path: str, marks: str, engagement: str, write: Callable[[DataFrame, int], None] | None = None, **trigger: object) -> StreamingQuery:
    """A started query that mints a streaming DataFrame of findings into the table at ``path``; ``marks`` is its checkpoint folder. By default all that is
    there is minted, then the query ends."""
    sink = found.writeStream.foreachBatch(write or mint_batch(path, engagement)).option("checkpointLocation", marks)
    return sink.trigger(**(trigger or {"availableNow": True})).start()
