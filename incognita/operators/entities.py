"""Detection relations, and the merging and filtering of what detectors find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incognita.functions.rules import ALLOWED_WORDS, STRUCTURED_TYPES
from incognita.functions.spans import entities_of
from incognita.functions.text import percent_decoded, quoted_literal
from incognita.operators.search import FEW_TERMS, holding

FLOOR_REGEX, FLOOR_SCOPE, VAULT = "regex", "scope", "vault"


def claimed_spans(texts: DataFrame, *keys: str, text: str = "text", extra: bool = False) -> DataFrame:
    """One row for each claimed span of each text."""
    spans = entities_of(texts.sparkSession, text, extra)
    return texts.select(*keys, F.explode(spans).alias("s")).select(*keys, "s.start", "s.end", "s.value", "s.entity_type")


def floor_entities(texts: DataFrame, *keys: str, text: str = "text", extra: bool = False) -> DataFrame:
    """Distinct (value, entity_type) of each text. If a text holds percent signs, its decoded copy is searched, too;
    what is found there counts if it stands verbatim in the text, and decides the type."""
    raw = F.col(text)
    decoded = percent_decoded(raw)
    copies = F.when(F.contains(raw, F.lit("%")) & (decoded != raw), F.array(raw, decoded)).otherwise(F.array(raw))
    forms = texts.select(*keys, raw.alias("_raw"), F.posexplode(copies).alias("_form", "_text"))
    found = forms.select(*keys, "_raw", "_form", F.posexplode(entities_of(texts.sparkSession, "_text", extra)).alias("_place", "e"))
    found = found.where((F.col("_form") == 0) | F.contains("_raw", F.col("e.value")))
    # The decoded copy's first claim of a value comes before the raw one's.
    return found.groupBy(*keys, F.col("e.value").alias("value")).agg(F.min_by("e.entity_type", F.struct(-F.col("_form"), "_place")).alias("entity_type"))


def scope_pattern(value: Column) -> Column:
    """A term as a whole token: in no word, address or host name; a full stop may follow."""
    return F.concat(F.lit(r"(?Uiu)(?<![\w@-])("), quoted_literal(value), F.lit(r")(?![\w-])(?!\.[\w-])"))


def scope_entities(texts: DataFrame, terms: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Distinct (value as it stands in the text, entity_type) for scope terms (value, entity_type); of terms that see the
    same value, the shortest decides, as the last one tried."""
    terms = terms.select(F.lower("value").alias("_low"), F.col("value").alias("term"), F.col("entity_type").alias("term_type"))
    met = holding(texts.select(*keys, F.lower(F.col(text)).alias("_low_text")), terms, *keys, text="_low_text", term="_low")
    seen = F.regexp_extract_all(F.col(text), scope_pattern(F.col("term")), F.lit(1))
    hits = met.join(texts.select(*keys, text), list(keys)).select(*keys, "term", "term_type", F.explode(seen).alias("value"))
    return hits.groupBy(*keys, "value").agg(F.min_by("term_type", F.struct(F.length("term"), "term")).alias("entity_type"))


def merged_types(found: DataFrame, *keys: str) -> DataFrame:
    """One type for each value of a row from (value, entity_type, chain, is_floor): in the order of the chain a later
    floor finding overwrites, a contextual one only if no structured type stands yet."""
    steps = F.array_sort(F.collect_list(F.struct("chain", "is_floor", "entity_type")))
    structured = F.array(*map(F.lit, STRUCTURED_TYPES))
    fold = F.aggregate(
        steps, F.lit(None).cast("string"),
        lambda acc, s: F.when(s["is_floor"] | acc.isNull() | ~F.array_contains(structured, acc), s["entity_type"]).otherwise(acc),
    )
    return found.groupBy(*keys, "value").agg(fold.alias("entity_type"), F.max("is_floor").alias("is_floor"))


def known_entities(texts: DataFrame, vault: DataFrame, *keys: str, text: str = "text", few: int = FEW_TERMS) -> DataFrame:
    """(value, entity_type) of all vault originals that stand anywhere in a text."""
    terms = vault.select(F.col("original").alias("value"), "entity_type")
    return holding(texts, terms, *keys, text=text, term="value", few=few).select(*keys, "value", "entity_type")


def without_wrappers(found: DataFrame, *keys: str) -> DataFrame:
    """Drops findings that wrap a precise floor value of the same row: ``label=value`` with a label of at most 24
    characters."""
    inner = found.where("is_floor").where(F.length("value") >= 6).select(*keys, F.col("value").alias("inner"))
    rest = F.expr("concat(substr(value, 1, instr(value, inner) - 1), substr(value, instr(value, inner) + length(inner)))")
    label = rest.rlike(r"""(?U)^[\w.\-]{0,24}\s*["']?\s*[:=]?\s*["']?$""")
    wraps = (~F.col("is_floor")) & F.contains(F.col("value"), F.col("inner")) & (F.col("value") != F.col("inner")) & label
    bad = found.join(inner, list(keys)).where(wraps).select(*keys, "value").distinct()
    return found.join(bad, [*keys, "value"], "left_anti")


def keep_entity(value: Column, is_floor: Column) -> Column:
    """The final filter: no blanks; of contextual findings no short single words and no allowed words."""
    w = F.trim(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    words = F.split(w, r"(?U)\s+")
    allowed = F.array(*map(F.lit, ALLOWED_WORDS))
    proper = (F.size(words) >= 2) & F.forall(words, lambda t: F.substring(t, 1, 1).rlike(r"^\p{Lu}$"))
    short = (F.size(words) == 1) & (F.length(w) < 4)
    listed = F.array_contains(allowed, F.lower(w)) | (~proper & F.array_contains(allowed, F.lower(words[0])))
    return (w != "") & (is_floor | ~(short | listed))


def entity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"))


def first_types(found: DataFrame, order: list[Column]) -> DataFrame:
    """One type for each value over all rows: that of the first row in the given order."""
    rank = F.row_number().over(Window.partitionBy("value").orderBy(*order))
    return found.withColumn("_r", rank).where("_r = 1").drop("_r")
