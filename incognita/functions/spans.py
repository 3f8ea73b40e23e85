"""Entity spans of a text.

The rules run as native expressions: a text is searched for a rule only if one scan for all rules has found what it needs, and where the rule matches, its values are marked in
place. Places, checks and claims are then read off the marked copies in one pass of an Arrow function, in time linear in text and matches.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from incognita.functions.claims import claims
from incognita.functions.rules import CARD, EXTRA_RULES, RULES, SAFE_WORDS, Rule
from incognita.functions.scan import possible_rules

#: A private-use character that marks values; one that a text itself holds is hidden during the search.
MARK = "\ue000"
_HIDDEN = "\ufffd"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("entity_type", pa.string())])
_SAFE = set(SAFE_WORDS)


def _java(rule: Rule) -> str:
    """Unicode classes, and lines that end with \\n alone, as the rules' definition has them."""
    return f"(?Ud{rule.flags})({rule.before})({rule.value})({rule.behind})"


def _likely(text: Column, rule: Rule) -> Column:
    """Whether a text holds what any match of the rule holds."""
    likely = reduce(or_, [F.contains(text, F.lit(n)) for n in rule.needs]) if rule.needs else F.lit(True)
    return likely & text.rlike(rule.hint) if rule.hint else likely


def luhn_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def rule_values(text: Column, rule: Rule) -> Column:
    """All values that one rule finds, left to right, with repeats."""
    found = F.regexp_extract_all(text, F.lit(_java(rule)), 2)
    good = luhn_valid if rule is CARD else lambda v: (v != "") & ~F.lower(v).isin(SAFE_WORDS)
    return F.when(_likely(text, rule), F.filter(found, good)).otherwise(F.array().cast("array<string>"))


def _sizes(marked: Column) -> Column:
    """Lengths of the pieces between marks: a copy itself would make Python hold the text once more for each rule."""
    return F.transform(F.split(marked, MARK), F.length)


def _card(value: str) -> bool:
    digits = [ord(c) - 48 for c in value if c not in " -"]
    doubled = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return 13 <= len(digits) <= 19 and all(0 <= d <= 9 for d in digits) and (doubled + sum(digits[::-2])) % 10 == 0


def _spans_of(text: str, copies: list[dict], rules: list[Rule]) -> list[dict]:
    """Claimed spans of a text, by priority, from its marked copies."""
    return _claimed(text, [{"rule": c["rule"], "sizes": [*map(len, c["marked"].split(MARK))]} for c in copies], rules)


def _claimed(text: str, copies: list[dict], rules: list[Rule]) -> list[dict]:
    """Claimed spans of a text, by priority, from the sizes of the pieces between the marks of its copies."""
    found = []
    for copy in copies:
        rule, at = rules[copy["rule"]], 0
        for k, size in enumerate(copy["sizes"]):
            if k % 2 and size:
                value = text[at : at + size]
                if _card(value) if rule.name == CARD.name else value.lower() not in _SAFE:
                    found.append((copy["rule"], at, at + size, value, rule.entity_type))
            at += size
    return [{"start": s, "end": e, "value": v, "entity_type": t} for _, s, e, v, t in sorted(claims(found))]


@lru_cache(maxsize=2)
def _reader(extra: bool):
    rules = [CARD, *RULES, *(EXTRA_RULES if extra else [])]

    @F.arrow_udf("array<struct<start:int,end:int,value:string,entity_type:string>>")
    def read(text: pa.Array, copies: pa.Array) -> pa.Array:
        # Row by row, so that Python holds one text of a batch at a time.
        return pa.array([_claimed(t.as_py(), c.as_py(), rules) if len(c.values or ()) else [] for t, c in zip(text, copies, strict=True)], pa.list_(_SPAN))

    return read


def entities(text: Column, extra: bool = False) -> Column:
    """Claimed spans of a text in the order of priority: cards first, then rule after rule, from left to right; a span
    that overlaps an earlier one is left out."""
    plain = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, _HIDDEN)).otherwise(text)
    could = possible_rules(text, extra)
    copies = [
        F.when((could.bitwiseAND(F.lit(1 << i)) != 0) & plain.rlike(_java(r)), F.struct(F.lit(i).alias("rule"), _sizes(F.regexp_replace(plain, _java(r), f"$1{MARK}$2{MARK}$3")).alias("sizes")))
        for i, r in enumerate([CARD, *RULES, *(EXTRA_RULES if extra else [])])
    ]
    hit = F.filter(F.array(*copies), lambda c: c.isNotNull())
    return _reader(extra)(F.when(F.size(hit) > 0, text), hit)


@lru_cache(maxsize=64)
def _entities_of(application: str, column: str, extra: bool) -> Column:
    return entities(F.col(column), extra)


def entities_of(spark: SparkSession, column: str, extra: bool = False) -> Column:
    """entities of a column by name. An expression over all rules takes a while to build, so that it is built once."""
    return _entities_of(spark.sparkContext.applicationId, column, extra)
