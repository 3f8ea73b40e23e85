"""Replacement of originals by surrogates in one pass over each text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.functions.tolerant import replaced_text


def anonymized(texts: DataFrame, found: DataFrame, vault: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """texts with their column replaced under the vault; found: (keys, value)."""
    pairs = found.join(vault.select(F.col("original").alias("value"), "surrogate"), "value").groupBy(*keys).agg(
        F.collect_set(F.struct(F.col("value").alias("original"), "surrogate")).alias("_pairs")
    )
    joined = texts.join(pairs, list(keys), "left")
    blank = F.coalesce(F.col(text).rlike(r"(?U)^\s*$"), F.lit(True))
    return joined.withColumn(text, replaced_text(F.col(text), F.when(~blank, F.col("_pairs")))).drop("_pairs")
