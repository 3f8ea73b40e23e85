"""Audit views of a vault, and checks of what was replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.operators.search import holding


def search(vault: DataFrame, query: str | None = None, entity_type: str | None = None) -> DataFrame:
    """Rows of a type that hold the query anywhere, whatever its case."""
    rows = vault.select("original", "entity_type", "surrogate")
    if entity_type:
        rows = rows.where(F.col("entity_type") == entity_type)
    if query:
        rows = rows.where(F.contains(F.lower(F.concat("original", "surrogate", "entity_type")), F.lower(F.lit(query))))
    return rows


def sorted_by(vault: DataFrame, column: str, descending: bool = False, collation: str = "UNICODE") -> DataFrame:
    """Rows in the order of a collation (UNICODE: letters before their accents and case), ties by the other columns."""
    if column not in ("original", "entity_type", "surrogate"):
        raise ValueError(f"no such column to sort by: {column}")
    rest = [c for c in ("original", "entity_type", "surrogate") if c != column]
    return vault.select("original", "entity_type", "surrogate").orderBy(F.collate(F.col(column), collation).desc() if descending else F.collate(F.col(column), collation), column, *rest)


def types(vault: DataFrame) -> DataFrame:
    return vault.select("entity_type").distinct().orderBy("entity_type")


def leaks(anonymised: DataFrame, secrets: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, value) of secrets (keys, value) that the row's text still holds."""
    return secrets.join(anonymised.select(*keys, F.col(text).alias("_text")), list(keys)).where(F.contains("_text", F.col("value"))).select(*keys, "value").distinct()


def echo_leaks(anonymised: DataFrame, secrets: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Secrets of any row that any row's text still holds: the probe that looks at all texts at once, as one."""
    values = secrets.select("value").distinct()
    return holding(anonymised, values, *keys, text=text, term="value").select("value").distinct()


def roundtrip(before: DataFrame, after: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys and whether the restored text equals the original."""
    return before.join(after.select(*keys, F.col(text).alias("_after")), list(keys)).select(*keys, F.col(text).eqNullSafe(F.col("_after")).alias("roundtrip_ok"))


def report(checks: DataFrame) -> DataFrame:
    """Sums over (n_secrets, n_leaks, roundtrip_ok) rows, and whether all is well."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    ok: Column = (count("n_leaks") == 0) & (count((~F.col("roundtrip_ok")).cast("long")) == 0)
    return checks.agg(F.count("*").alias("n_texts"), count("n_secrets").alias("n_secrets"), count("n_leaks").alias("n_leaks"), count((~F.col("roundtrip_ok")).cast("long")).alias("n_broken"), ok.alias("passed"))
