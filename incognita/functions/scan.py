"""One scan of a text before the rules: which of them could match at all.

A batch of texts is scanned as the bytes that Arrow lays end to end, for all rules' literals and shapes at once; what comes back is one bit a rule. A bit may be set
needlessly (a literal may stand across two texts), but is never missing where the rule matches.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from incognita.functions.rules import CARD, EXTRA_RULES, RULES, Rule

#: Bytes of text that are scanned at once.
CHUNK = 1 << 20
_DIGIT, _HEX, _ALNUM, _FAR, _LOWER = (np.zeros(256, dtype=bool) for _ in range(5))
_DIGIT[48:58] = True
_HEX[[*b"0123456789abcdefABCDEF"]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: First bytes of characters from U+0640 on, the blocks with digits other than 0 to 9, and with letters that ignoring case makes k.
_FAR[0xD9:0xF5] = True
_LOWER[65:91] = True


class _Part:
    """Some texts as bytes; each shape is a mask over the texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.raw = data, at, data.tobytes()
        self.low = (data + _LOWER[data].astype(np.uint8) * np.uint8(32)).tobytes()
        digit = _DIGIT[data]
        self.far = self.rows(_FAR[data]) | self.holds("ſ")
        self.digit, self.hex = digit, _HEX[data]
        #: Texts with 32 hexadecimal digits in a row.
        self.long_hex: np.ndarray | None = None

    def rows(self, mask: np.ndarray) -> np.ndarray:
        """Texts with a byte of the mask."""
        out = np.zeros(len(self.at) - 1, dtype=bool)
        out[np.searchsorted(self.at, np.flatnonzero(mask), side="right") - 1] = True
        return out

    def holds(self, literal: str, any_case: bool = False) -> np.ndarray:
        """Texts that hold a literal."""
        sought = literal.encode()
        if len(sought) == 1 and not any_case:
            return self.rows(self.data == sought[0])
        raw, places, at = self.low if any_case else self.raw, [], -1
        while (at := raw.find(sought, at + 1)) >= 0:
            places.append(at)
        out = np.zeros(len(self.at) - 1, dtype=bool)
        out[np.searchsorted(self.at, np.array(places, np.int64), side="right") - 1] = True
        return out

    def between(self, left: np.ndarray, char: str, right: np.ndarray) -> np.ndarray:
        """Texts with a character between bytes of two masks."""
        mid = np.zeros(len(self.data), dtype=bool)
        mid[1:-1] = left[:-2] & (self.data[1:-1] == ord(char)) & right[2:]
        mid[self.at[1:][self.at[1:] > 0] - 1] = False  # what stands behind a text's last byte is another text
        return self.rows(mid)

    def shape(self, name: str) -> np.ndarray:
        if name == "payment_card":
            return (np.diff(np.concatenate(([0], np.cumsum(self.digit)))[self.at]) >= 13) | self.far
        if name in ("sha256", "sha1", "md5", "lm_nt_hash"):
            if self.long_hex is None:
                others = np.concatenate(([0], np.cumsum(~self.hex, dtype=np.int32)))
                run = np.zeros(len(self.data), dtype=bool)
                run[31:] = others[32:] == others[:-32]
                self.long_hex = self.rows(run)
            return self.long_hex
        if name in ("ssn", "ipv4", "cidr"):
            return self.between(self.digit, "-" if name == "ssn" else ".", self.digit) | self.far
        if name == "domain":
            return self.between(_ALNUM[self.data], ".", _ALNUM[self.data])
        if name in ("mac", "ipv6"):
            found = self.between(self.hex, ":", self.hex)
            return found | self.between(self.hex, "-", self.hex) if name == "mac" else found
        if name in ("bearer", "basic", "set_cookie"):
            return self.holds({"set_cookie": "cookie:"}.get(name, name), any_case=True) | self.far
        return np.ones(len(self.at) - 1, dtype=bool)

    def mask(self, rules: list[Rule]) -> np.ndarray:
        known: dict[str, np.ndarray] = {}
        out = np.zeros(len(self.at) - 1, np.int64)
        for i, rule in enumerate(rules):
            some = np.zeros(len(out), dtype=bool) if rule.needs else np.ones(len(out), dtype=bool)
            for literal in rule.needs:
                if literal not in known:
                    known[literal] = self.holds(literal)
                some |= known[literal]
            if some.any():
                some &= self.shape(rule.name)
            out |= some.astype(np.int64) << i
        return out


def possible(texts: pa.Array, rules: list[Rule]) -> np.ndarray:
    """For each text, a bit for each rule that may match; none for a null."""
    plain = pa.concat_arrays([texts.fill_null("")]).cast(pa.large_string())
    _, offsets, data = plain.buffers()
    at = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out, lo = np.zeros(len(plain), np.int64), 0
    while lo < len(plain):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
        if at[hi] > at[lo]:
            out[lo:hi] = _Part(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]).mask(rules)
        lo = hi
    return out


@lru_cache(maxsize=2)
def _scanner(extra: bool):
    rules = [CARD, *RULES, *(EXTRA_RULES if extra else [])]

    @F.arrow_udf(LongType())
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array(possible(texts, rules), pa.int64())

    return scan


def possible_rules(text: Column, extra: bool = False) -> Column:
    """A bit for each rule, in their order, that could match the text."""
    return _scanner(extra)(text)
