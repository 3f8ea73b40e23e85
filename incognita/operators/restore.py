"""Restoration of originals, exact and tolerant of rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.functions.text import projected
from incognita.functions.tolerant import restored_by, restored_text
from incognita.operators.search import FEW_CHARS, FEW_TERMS, holding


def restored(texts: DataFrame, vault: DataFrame, *keys: str, text: str = "text", few: int = FEW_TERMS) -> DataFrame:
    """texts with surrogates turned back, whatever their case, hyphens, white space or marks inside. A vault of at most ``few``
    mappings goes to the tasks as one automaton, which reads each text once, without a shuffle; of a larger one, only the mappings whose tolerant form
    stands in a text go to that text; keys tell its rows apart there."""
    size = vault.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("surrogate") + F.length("original")), F.lit(0)).alias("chars")).first()
    if size["n"] <= few and size["chars"] <= FEW_CHARS:
        pairs = [(r["surrogate"], r["original"]) for r in vault.select("surrogate", "original").collect()]
        return texts.withColumn(text, restored_by(texts.sparkSession, pairs, F.col(text)))
    forms = vault.select("surrogate", "original", projected(F.col("surrogate")).alias("_form"))
    hits = holding(texts.select(*keys, projected(F.col(text)).alias("_projected")), forms, *keys, text="_projected", term="_form", few=few)
    pairs = hits.groupBy(*keys).agg(F.collect_set(F.struct("surrogate", "original")).alias("_pairs"))
    joined = texts.join(pairs, list(keys), "left")
    return joined.withColumn(text, restored_text(F.col(text), F.col("_pairs"))).select(*texts.columns)


def restored_exactly(text: Column, pairs: Column) -> Column:
    """Plain replacement, mapping after mapping (surrogate, original) in their order; later ones see earlier results."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["surrogate"], p["original"]))


def json_safe(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Pairs whose originals are escaped for the inside of a JSON string."""
    import json

    return [(s, json.dumps(o, ensure_ascii=False)[1:-1]) for s, o in pairs]


MANGLERS = ["verbatim", "bold", "inline_code", "italic", "uppercase", "lowercase", "underscored", "in_sentence", "intra_code", "nbsp_hyphen", "bold_segment"]


def mangled(surrogate: Column, mangler: str) -> Column:
    """How a rewrite may echo a surrogate."""
    s = surrogate
    wrap = lambda a, b: F.concat(F.lit(a), s, F.lit(b))
    dot = F.instr(s, ".")
    return {
        "verbatim": s,
        "bold": wrap("**", "**"),
        "inline_code": wrap("`", "`"),
        "italic": wrap("*", "*"),
        "uppercase": F.upper(s),
        "lowercase": F.lower(s),
        "underscored": wrap("_", "_"),
        "in_sentence": wrap("the value ", " here"),
        "intra_code": F.when(F.length(s) > 4, F.concat(F.lit("`"), F.substring(s, 1, 4), F.lit("`"), F.expr("substr(surrogate, 5)"))).otherwise(wrap("`", "`")),
        "nbsp_hyphen": F.replace(s, F.lit("-"), F.lit("‑")),
        "bold_segment": F.when(dot > 0, F.concat(F.substring_index(s, ".", 1), F.lit("**.**"), F.expr("substr(surrogate, instr(surrogate, '.') + 1)"))).otherwise(wrap("**", "**")),
    }[mangler]
