"""Rewriting of texts in one pass: originals by surrogates, and surrogates back however a rewrite spelled them.

The terms of a text (or of a whole vault, where it is small) become one automaton, which reads the text once; the overlaps of what it finds are settled by a
sweep. Nothing is put into a text and looked at again, so that any character may stand in it, and the time is linear in text, terms and finds.

To a tolerant comparison noise marks and zero-width characters are nothing, a run of white space is a blank, any hyphen is ``-``, and ASCII case
counts for nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from incognita.functions.claims import claims
from incognita.functions.text import HYPHENS, NOISE, ZERO_WIDTH

PAIRS = "array<struct<surrogate:string,original:string>>"
_NOISE = NOISE + ZERO_WIDTH
_NOTHING = 0xFFFFFFFF
#: What each character of the basic plane is to a tolerant comparison.
_FORMS = np.arange(0x10000, dtype=np.uint32)
_FORMS[[i for i in range(0x10000) if chr(i).isspace()]] = ord(" ")
_FORMS[[ord(c) for c in HYPHENS]] = ord("-")
_FORMS[65:91] += 32
_FORMS[[ord(c) for c in _NOISE]] = _NOTHING
#: The rewriter of a whole vault that a worker used last.
_KEPT: dict[str, object] = {}


def tolerant_form(text: str) -> tuple[str, np.ndarray]:
    """The text's tolerant form, and the place in the text of each of its characters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    form = np.where(points < 0x10000, _FORMS[np.minimum(points, 0xFFFF)], points)
    kept = np.flatnonzero(form != _NOTHING)
    form = form[kept]
    first = np.ones(len(form), dtype=bool)
    first[1:] = (form[1:] != ord(" ")) | (form[:-1] != ord(" "))
    return form[first].tobytes().decode("utf-32-le"), kept[first]


def _automaton(terms: dict[str, object]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, value in terms.items():
        out.add_word(term, value)
    out.make_automaton()
    return out


def _put(text: str, spans: list[tuple]) -> str:
    """The text with (rank, start, end, new), which don't overlap and come by place, put in."""
    out, at = [], 0
    for _, start, end, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


class Restorer:
    """Surrogates and their originals. Longer surrogates take their places first, those of one length by their order."""

    def __init__(self, pairs: list[tuple[str, str]]):
        forms: dict[str, list] = {}
        known = dict(sorted(pairs, reverse=True))
        for rank, (surrogate, original) in enumerate(sorted(known.items(), key=lambda p: (-len(p[0]), p[0]))):
            core = surrogate.strip(_NOISE)
            lead, _, tail = surrogate.partition(core) if core else ("", "", "")
            if form := tolerant_form(core)[0]:
                forms.setdefault(form, []).append((rank, len(form), lead, tail, original))
        self.automaton = _automaton(forms)

    def rewrite(self, text: str) -> str:
        if not len(self.automaton):
            return text
        form, place = tolerant_form(text)
        found = []
        for last, own in self.automaton.iter(form):
            for rank, size, lead, tail, original in own:
                start, end = int(place[last - size + 1]), int(place[last]) + 1
                # Marks that belong to the surrogate itself go with it where they stand.
                start -= len(lead) if lead and text.endswith(lead, 0, start) else 0
                end += len(tail) if tail and text.startswith(tail, end) else 0
                found.append((rank, start, end, original))
        return _put(text, claims(found)) if found else text


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _is_edge(text: str, start: int, end: int) -> bool:
    """Whether a value stands as a whole token at those of its edges that are word characters; a percent code before it counts
    as an edge."""
    if start and _is_word(text[start]) and _is_word(text[start - 1]):
        code = text[max(0, start - 3) : start]
        if not (len(code) == 3 and code[0] == "%" and code[1:].isascii() and all(c in "0123456789abcdefABCDEF" for c in code[1:])):
            return False
    return end == len(text) or not (_is_word(text[end - 1]) and _is_word(text[end]))


class Replacer:
    """Originals and their surrogates: leftmost first, of those that start together the longest."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.automaton = _automaton({original: (original, surrogate) for original, surrogate in sorted(pairs, reverse=True) if original})

    def rewrite(self, text: str) -> str:
        if not len(self.automaton):
            return text
        found = []
        for last, (original, surrogate) in self.automaton.iter(text):
            start, end = last + 1 - len(original), last + 1
            if _is_edge(text, start, end):
                found.append((start, -end, surrogate))
        taken, at = [], 0
        for start, behind, surrogate in sorted(found):
            if start >= at:
                at = -behind
                taken.append((0, start, at, surrogate))
        return _put(text, taken) if taken else text


def _by_row(kind: Callable[[list[tuple[str, str]]], Restorer | Replacer], first: str, second: str) -> Callable[[Column, Column], Column]:
    @F.arrow_udf(StringType())
    def rewrite(text: pa.Array, pairs: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), pairs.to_pylist(), strict=True)
        return pa.array([t if t is None or not own else kind([(p[first], p[second]) for p in own]).rewrite(t) for t, own in rows], pa.string())

    return rewrite


_restore, _replace = _by_row(Restorer, "surrogate", "original"), _by_row(Replacer, "original", "surrogate")


def restored_text(text: Column, pairs: Column) -> Column:
    """The text with every surrogate of ``pairs`` (PAIRS) turned back."""
    return F.coalesce(_restore(F.when(F.size(pairs) > 0, text), pairs), text)


def replaced_text(text: Column, pairs: Column) -> Column:
    """The text with each original of ``pairs`` (original, surrogate) replaced."""
    return F.coalesce(_replace(F.when(F.size(pairs) > 0, text), pairs), text)


def restored_by(spark: SparkSession, pairs: list[tuple[str, str]], text: Column) -> Column:
    """The text with every surrogate of a vault turned back; the vault's automaton is built once a worker. The caller has checked its size."""
    shared, name = spark.sparkContext.broadcast(pairs), uuid.uuid4().hex

    @F.arrow_udf(StringType())
    def rewrite(texts: pa.Array) -> pa.Array:
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = Restorer(shared.value)
        return pa.array([None if t is None else _KEPT[name].rewrite(t) for t in texts.to_pylist()], pa.string())

    return rewrite(text)
