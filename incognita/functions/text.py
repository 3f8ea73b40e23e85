"""Small text functions as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a rewrite may put into a token, and hyphens that stand for "-".
NOISE = "*`~"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
HYPHENS = "\u2010\u2011\u2012\u2013\u2014"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def chunks(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Overlapping windows of a text; the text itself if it fits."""
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive, overlap not negative")
    step = max(1, size - overlap)
    last = F.greatest(F.length(text) - F.lit(1), F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(windows)


def scope_type(value: Column) -> Column:
    """The type that a scope term's shape suggests."""
    return (
        F.when(value.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}/\d{1,2}$"), "CIDR")
        .when(value.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "IP_ADDRESS")
        .when(F.contains(value, F.lit("@")), "EMAIL_ADDRESS")
        .when(value.rlike(r"\.[a-zA-Z]{2,}$"), "DOMAIN")
        .when(F.contains(value, F.lit(" ")), "ORGANIZATION")
        .otherwise("HOSTNAME")
    )


def model_type(value: Column) -> Column:
    """The type that the shape of a model's finding suggests."""
    v = F.trim(value)
    low = F.lower(v)
    return (
        F.when(F.contains(v, F.lit("@")) & F.contains(v, F.lit(".")), "EMAIL_ADDRESS")
        .when(v.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "IP_ADDRESS")
        .when(F.contains(v, F.lit("\\")) | low.rlike(r"^[a-z]+\.[a-z]+$"), "USERNAME")
        .when(low.rlike(r"[.](?:local|corp|com|net|org|lan)$"), "DOMAIN")
        .when(F.contains(v, F.lit(" ")), "PERSON")
        .otherwise("OTHER")
    )


def percent_decoded(text: Column) -> Column:
    """Lenient percent decoding: valid %HH runs become their bytes, everything else stays as it is."""
    codes = r"(?:%[0-9a-fA-F]{2})+"
    decode = lambda c: F.make_valid_utf8(F.unhex(F.replace(c, F.lit("%"), F.lit(""))).cast("string"))
    runs = F.regexp_extract_all(text, F.lit(f"({codes})"), 1)
    whole = F.transform(F.split(text, codes), lambda gap, i: F.concat(gap, F.coalesce(decode(F.get(runs, i)), F.lit(""))))
    return F.when(F.contains(text, F.lit("%")), F.array_join(whole, "")).otherwise(text)


def projected(text: Column, noise: bool = True) -> Column:
    """What a text looks like to a tolerant comparison: no noise or zero-width characters, runs of white space as
    one blank, one kind of hyphen, ASCII letters in lower case."""
    drop = re.escape(NOISE + ZERO_WIDTH) if noise else ""
    out = F.regexp_replace(text, f"[{drop}]", "") if noise else text
    out = F.regexp_replace(out, r"(?U)[\s\x1c-\x1f\x85]+", " ")
    return F.translate(out, HYPHENS + _UPPER, "-" * len(HYPHENS) + _LOWER)


def quoted_literal(value: Column) -> Column:
    """A Java pattern that matches the value literally."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
