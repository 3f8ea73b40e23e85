"""Corpus pipeline: the chosen operators in order, from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
folder and read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.batches import cut, delete_tables, tables_written
from llm.exact_dedup import drop_copies
from llm.jaccard_join import one_of_each_group
from llm.packing import best_fit_pack
from llm.quality import passing
from llm.suffix_dedup import without_repeated_bytes

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands. Null and empty texts go; a null id stays;
    repeated rows stay or go together; an empty table stays empty; very long texts are measured whole."""
    return passing(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id; a null id counts as larger than
    any other. Repeated rows are a group, too; null and blank texts are one group; an empty table stays empty."""
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates: five-word shingles, similarity 0.8 or more. Rows with a null id or
    without words stay; rows that share an id are one; an empty table stays empty."""
    return one_of_each_group(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document of smaller id has; all rows stay. A null text stays null, shorter
    texts stay whole, a null id counts as the largest; rows that share an id take nothing from each other."""
    return without_repeated_bytes(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in sequences of at most 4096: one row for each piece. A null or empty text is the end token alone;
    longer texts are cut into pieces; a null id stays null; an empty table gives no rows."""
    return best_fit_pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Tokenising, vocabulary measures and best-fit packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written on its way is deleted once its result is, and a stage's result once
    the next one's is; what the last stage reads stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with tables_written() as paths:
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        delete_tables(spark, before + paths[:-1])
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
