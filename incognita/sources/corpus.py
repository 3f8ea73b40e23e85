"""Sources: engagement vaults, scope files, text files, and tool-output lines derived from the tables."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.functions.text import scope_type

log = logging.getLogger(__name__)
VAULT_SCHEMA = "engagement string, original string, norm string, entity_type string, surrogate string, created_at timestamp"

#: One line of tool output for each customer, of a kind that depends on its key: every rule has lines. The text
#: is SQL that Spark and DuckDB share.
LINES_SQL = r"""
SELECT 'tool' AS source, c_custkey AS row_id, CASE c_custkey % 32
  WHEN 0 THEN 'card 4111 1111 1111 1111 paid, card 5500-0000-0000-0004 refused, order 4111111111111112'
  WHEN 1 THEN 'jwt eyJ' || substr(md5(c_name), 1, 16) || '.' || substr(md5(c_name), 5, 20) || '.' || md5(c_name) || ' end'
  WHEN 2 THEN 'key AKIA' || upper(substr(md5(c_name), 1, 16)) || ' in use'
  WHEN 3 THEN 'maps AIza' || md5(c_name) || 'a_B here'
  WHEN 4 THEN 'push ghp_' || md5(c_name) || 'Ab12 done'
  WHEN 5 THEN 'ci glpat-' || substr(md5(c_name), 1, 20) || ' ok'
  WHEN 6 THEN 'pay sk_live_' || substr(md5(c_name), 1, 24) || ' and pk_test_' || substr(md5(c_name), 3, 12)
  WHEN 7 THEN 'bot xoxb-' || substr(md5(c_name), 1, 12) || '-' || substr(md5(c_name), 13, 8) || ' joined'
  WHEN 8 THEN '-----BEGIN RSA PRIVATE KEY----- body ' || CAST(c_custkey AS STRING)
  WHEN 9 THEN 'Authorization: Bearer ' || md5(c_name) || '.sig ok'
  WHEN 10 THEN 'authorization: basic dXNlcjpw' || substr(md5(c_name), 1, 8) || '== ok'
  WHEN 11 THEN 'PHPSESSID=' || substr(md5(c_name), 1, 26) || ' csrf_token: "' || substr(md5(c_name), 2, 12) || '"'
  WHEN 12 THEN 'Set-Cookie: wp_' || CAST(c_custkey AS STRING) || '=v' || substr(md5(c_name), 1, 10) || '; Path=/admin'
  WHEN 13 THEN 'Cookie: own=' || substr(md5(c_name), 1, 9) || '; theme=dark' || CAST(c_custkey AS STRING)
  WHEN 14 THEN 'uid:' || CAST(c_custkey AS STRING) || ' ' || md5(c_name) || ':' || md5(upper(c_name)) || ':::'
  WHEN 15 THEN 'sum ' || md5(c_name) || md5(lower(c_name)) || ' file'
  WHEN 16 THEN 'commit ' || md5(c_name) || substr(md5(c_name), 1, 8) || ' pushed'
  WHEN 17 THEN 'shadow $6$' || substr(md5(c_name), 1, 8) || '$' || md5(c_name) || ' root'
  WHEN 18 THEN 'ntlm ' || upper(md5(c_name)) || ' cracked'
  WHEN 19 THEN 'ssn ' || lpad(CAST(c_custkey % 900 AS STRING), 3, '0') || '-45-' || lpad(CAST(c_custkey % 9973 AS STRING), 4, '0') || ' on file'
  WHEN 20 THEN 'mac 0a:1b:' || substr(md5(c_name), 1, 2) || ':' || substr(md5(c_name), 3, 2) || ':' || substr(md5(c_name), 5, 2) || ':ff seen'
  WHEN 21 THEN 'route 10.' || CAST(c_custkey % 200 AS STRING) || '.0.0/1' || CAST(c_custkey % 10 AS STRING) || ' up'
  WHEN 22 THEN 'host 10.' || CAST(c_custkey % 250 AS STRING) || '.' || CAST(c_nationkey AS STRING) || '.7 and 127.0.0.1 answer'
  WHEN 23 THEN 'at 12:34:56 peer fe80:0:0:' || substr(md5(c_name), 1, 4) || ':1:2:3:4 up'
  WHEN 24 THEN 'GET https://app' || CAST(c_custkey AS STRING) || '.shop.com:8443/cart?id=7#x then ftp://u:p@10.0.0.1/f'
  WHEN 25 THEN 'mail user' || CAST(c_custkey AS STRING) || '@corp' || CAST(c_nationkey AS STRING) || '.com now'
  WHEN 26 THEN 'dns srv' || CAST(c_custkey AS STRING) || '.corp.local and github.com, install.sh'
  WHEN 27 THEN 'login MARKET' || CAST(c_nationkey AS STRING) || '\user' || CAST(c_custkey AS STRING) || ' ok'
  WHEN 28 THEN 'password=' || substr(md5(c_name), 1, 9) || '!&next=1 api_key: ' || substr(md5(c_name), 9, 12)
  WHEN 29 THEN 'auth=user%7C' || md5(c_name) || '%7Cend, seen at /srv/x'
  WHEN 30 THEN 'customer of ' || c_mktsegment || ' rang about srv' || CAST(c_custkey - 4 AS STRING) || '.corp.local.'
  ELSE 'nothing to see for ' || CAST(c_custkey AS STRING)
END AS text
FROM {customer}
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, row_id, text) of documents, pages and tool lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("documents").alias("source"), F.col("doc_id").alias("row_id"), "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("source"), F.col("page_id").alias("row_id"), F.col("html").alias("text"))
    return docs.unionAll(pages).unionAll(tool_lines(spark, sf_dir))


#: Tool lines that one task makes.
LINES_A_TASK = 20_000


def tool_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # Very many customers fit one row group of a file, which is read by one task; their lines cost far more than the reading.
    if (tasks := 1 + customer.count() // LINES_A_TASK) > 1:
        customer = customer.repartition(tasks, "c_custkey")
    # A backslash in a literal is doubled for Spark.
    return spark.sql(LINES_SQL.replace("\\", "\\\\"), customer=customer)


def read_text_files(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(path, text): whole files, or their lines."""
    return spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_vault(spark: SparkSession, path: str, engagement: str | None = None) -> DataFrame:
    """A vault's rows; with an engagement, only its partition is read."""
    rows = spark.read.schema(VAULT_SCHEMA).parquet(path)
    return rows.where(F.col("engagement") == engagement) if engagement is not None else rows


def append_vault(rows: DataFrame, path: str) -> None:
    """Adds rows, partitioned by engagement and sorted by original for reads by value; an engagement's rows are dealt over tasks by ranges. Rows that would give
    an engagement an original or a surrogate twice are refused, and none is written; the message names no value."""
    spark = rows.sparkSession
    try:
        known = spark.read.schema(VAULT_SCHEMA).parquet(path)
    except AnalysisException:  # there is no table yet
        known = spark.createDataFrame([], VAULT_SCHEMA)
    for column in ("original", "surrogate"):
        keys = ["engagement", column]
        twice = rows.groupBy(*keys).count().where("count > 1").select(*keys)
        if not twice.unionByName(known.select(*keys).join(rows.select(*keys), keys, "left_semi")).isEmpty():
            raise ValueError(f"an engagement would have one {column} twice")
    rows.repartitionByRange("engagement", "original").sortWithinPartitions("engagement", "original").write.mode("append").partitionBy("engagement").parquet(path)


def save_look_up_tables(vault: DataFrame, name: str, folder: str, buckets: int = 32) -> tuple[str, str]:
    """The vault as two tables in the catalog, bucketed and sorted by original and by surrogate, so that look-ups either way join a vault's rows
    where they lie. The tables' names."""
    names = (f"{name}_by_original", f"{name}_by_surrogate")
    for table, column in zip(names, ("original", "surrogate"), strict=True):
        dealt = vault.repartition(buckets, column)  # one file a bucket
        dealt.write.bucketBy(buckets, column).sortBy(column).option("path", f"{folder}/{column}").saveAsTable(table)
    return names


def write_export_csv(export: DataFrame, path: str) -> None:
    export.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def parse_scope(entries: DataFrame, column: str = "value") -> DataFrame:
    """(value, entity_type) of scope entries: ``value``, ``value=TYPE``; blanks and # comments are skipped."""
    entry = F.trim(F.col(column))
    split = F.split(entry, "=", 2)
    value = F.trim(split[0])
    named = F.when(F.size(split) > 1, F.upper(F.trim(split[1]))).otherwise("")
    rows = entries.where(F.length(entry) > 0).where(~entry.startswith("#")).select(value.alias("value"), named.alias("named"))
    return rows.where("value <> ''").select("value", F.when(F.col("named") != "", F.col("named")).otherwise(scope_type(F.col("value"))).alias("entity_type"))


def inline_scope(spark: SparkSession, terms: str) -> DataFrame:
    """Scope entries from a comma list."""
    return parse_scope(spark.range(1).select(F.explode(F.split(F.lit(terms), ",")).alias("value")))


def scope_file(spark: SparkSession, path: str) -> DataFrame:
    """Scope entries of a file's lines. A file that can't be read gives none, with a warning: a run goes on without it."""
    try:
        lines = spark.read.text(path)
        lines.isEmpty()
    except Exception as error:
        log.warning("scope file %s can't be read: %s", path, str(error).splitlines()[0])
        lines = spark.createDataFrame([], "value string")
    return parse_scope(lines)


def write_text_files(texts: DataFrame, path: str, text: str = "text") -> None:
    """Texts as text files, one line for each line of a text; nulls are left out."""
    texts.where(F.col(text).isNotNull()).select(text).write.text(path)
