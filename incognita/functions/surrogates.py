"""Deterministic, format-preserving surrogates as native column expressions.

A keystream is HMAC-SHA256 under the engagement's key over type, original and salt,
extended block by block with SHA-256 as far as a format needs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alphabets, pools, ranges and prefixes of the surrogates' formats.
HEX = "0123456789abcdef"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
ALNUM = LOWER + LOWER.upper() + DIGITS
FIRST_NAMES = ["Alex", "Jordan", "Taylor", "Morgan", "Casey", "Riley", "Quinn", "Avery", "Parker", "Reese", "Skyler", "Rowan", "Hayden", "Emerson", "Finley", "Sage"]
LAST_NAMES = ["Carter", "Bennett", "Harper", "Foster", "Reyes", "Brooks", "Sutton", "Nolan", "Pierce", "Dalton", "Mercer", "Sloane", "Vance", "Whitaker", "Lowell", "Ashford"]
COMPANY_NAMES = ["Vertex", "Northwind", "Aether", "Cobalt", "Lumen", "Granite", "Solstice", "Meridian", "Helix", "Cardinal", "Onyx", "Pinnacle"]
COMPANY_KINDS = ["Systems", "Dynamics", "Holdings", "Labs", "Industries", "Group", "Technologies", "Networks", "Solutions", "Partners"]
TEST_NETS = ["192.0.2.", "198.51.100.", "203.0.113."]
TOKEN_PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "sk_test_", "pk_live_", "xoxb-", "xoxp-", "glpat-", "AIza"]
INTERNAL_SUFFIXES = ["local", "corp", "lan", "internal", "intra"]
TYPES = [
    "IP_ADDRESS", "CIDR", "IPV6", "HASH", "MAC_ADDRESS", "TOKEN", "EMAIL_ADDRESS", "DOMAIN", "URL", "HOSTNAME", "USERNAME", "PERSON",
    "ORGANIZATION", "PAYMENT_CARD", "CREDENTIAL", "PATH", "IDENTIFIER", "OTHER",
]
STREAM_BYTES = 4096


def pads(key: str) -> tuple[str, str]:
    """HMAC's inner and outer pads of a key, in hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\x00")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def keystream(key: str, *parts: Column, size: Column | int = 32) -> Column:
    """Hex of at least ``size`` bytes."""
    inner, outer = pads(key)
    message = []
    for i, part in enumerate(parts):
        message += ([F.unhex(F.lit("00"))] if i else []) + [F.encode(part, "UTF-8")]
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), *message), 256)
    seed = F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)
    if isinstance(size, int) and size <= 32:
        return seed
    size = F.lit(size) if isinstance(size, int) else size
    blocks = F.ceil((F.least(size, F.lit(STREAM_BYTES)) - 32) / F.lit(32.0)).cast("int")
    more = F.transform(F.sequence(F.lit(1), F.greatest(blocks, F.lit(1))), lambda i: F.sha2(F.concat(F.unhex(seed), F.unhex(F.lpad(F.hex(i), 8, "0"))), 256))
    return F.when(blocks > 0, F.concat(seed, F.array_join(more, ""))).otherwise(seed)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(stream: Column, at: int | Column, width: int) -> Column:
    return F.conv(F.substring(stream, F.lit(2) * at + 1, F.lit(2 * width)), 16, 10).cast("long")


def pick(stream: Column, alphabet: str, count: Column | int, at: Column | int = 0) -> Column:
    """``count`` characters of an alphabet, one for each byte of the stream from ``at`` on."""
    count = F.lit(count) if isinstance(count, int) else count
    at = F.lit(at) if isinstance(at, int) else at
    chars = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.substring(F.lit(alphabet), (_number(stream, at + i, 1) % len(alphabet)).cast("int") + 1, F.lit(1)))
    return F.when(count > 0, F.array_join(chars, "")).otherwise("")


def _choice(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values)).cast("int") + 1)


def is_upper(value: Column) -> Column:
    """At least one cased letter, and none in lower case."""
    return (F.upper(value) == value) & (F.lower(value) != value)


def ipv6(s: Column) -> Column:
    return F.concat(F.lit("2001:db8:"), F.concat_ws(":", *[pick(s, HEX, 4, at) for at in (0, 4, 8, 12)]))


def is_ipv6(value: Column) -> Column:
    """A valid IPv6 literal (without the mixed notation)."""
    group = "[0-9a-fA-F]{1,4}"
    full = value.rlike(rf"^(?:{group}:){{7}}{group}$")
    parts = F.size(F.filter(F.split(value, ":"), lambda p: p != ""))
    short = value.rlike(rf"^(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?$") & (parts <= 7)
    return full | short


def _bench_address(s: Column) -> Column:
    """An address of 198.18.0.0/15, which is kept for tests of network devices."""
    return F.concat(_choice(["198.18.", "198.19."], _number(s, 0, 4)), (_number(s, 4, 2) % 256).cast("string"), F.lit("."), (_number(s, 6, 2) % 256).cast("string"))


def _reserved_address(s: Column) -> Column:
    """An address of 240.0.0.0/4, which is reserved and never routed."""
    return F.concat_ws(".", (_number(s, 0, 1) % 15 + 240).cast("string"), *[(_number(s, k, 1)).cast("string") for k in (1, 2, 3)])


#: Address spaces beyond the compatible one, by the number that ``wide`` gives.
WIDER = {1: _bench_address, 2: _reserved_address}


def ip_address(original: Column, s: Column, wide: int = 0) -> Column:
    v4 = WIDER[wide](s) if wide else F.concat(_choice(TEST_NETS, _number(s, 0, 4)), (_number(s, 4, 4) % 253 + 1).cast("string"))
    return F.when(is_ipv6(original), ipv6(s)).otherwise(v4)


def network_of(address: Column, prefix: Column) -> Column:
    """The network of an IPv4 address for a prefix length (text; what is no length from 0 to 32 masks nothing)."""
    parts = F.split(address, r"\.")
    number = sum((parts[k].cast("long") * 256 ** (3 - k) for k in range(1, 4)), parts[0].cast("long") * 256**3)
    bits = F.coalesce(F.when(prefix.rlike("^[0-9]{1,2}$"), prefix.cast("int")), F.lit(32))
    return _dotted(number - number % F.pow(F.lit(2), F.greatest(32 - bits, F.lit(0))).cast("long"))


def _dotted(number: Column) -> Column:
    return F.concat_ws(".", *[(F.floor(number / 256 ** (3 - k)) % 256).cast("string") for k in range(4)])


def _prefix(network: Column) -> Column:
    return F.when(F.contains(network, F.lit("/")), F.substring_index(network, "/", -1)).otherwise("24")


def cidr(original: Column, s: Column, wide: int = 0) -> Column:
    """A network of the same prefix length. Three are compatible; then come those of 198.18.0.0/15 (for /24 there are 512), and for prefixes
    shorter than 15, or after five more rounds, those of 240.0.0.0/4 (for /24 there are 983,040)."""
    prefix = _prefix(original)
    if not wide:
        return F.concat(_choice(TEST_NETS, _number(s, 0, 4)), F.lit("0/"), prefix)
    short = prefix.rlike("^[0-9]$|^1[0-4]$")
    return F.concat(network_of(F.when(short, _reserved_address(s)).otherwise(WIDER[wide](s)), prefix), F.lit("/"), prefix)


def hash_like(original: Column, s: Column) -> Column:
    def one(value: Column, stream: Column) -> Column:
        out = pick(stream, HEX, F.length(value))
        return F.when(is_upper(value), F.upper(out)).otherwise(out)

    parts = F.transform(F.split(original, ":"), lambda p: one(p, keystream("x", p, size=F.length(p))))
    joined = F.contains(original, F.lit(":")) & original.rlike("^[0-9a-fA-F:]+$")
    return F.when(joined, F.array_join(parts, ":")).otherwise(one(original, s))


def mac(s: Column) -> Column:
    first = F.lower(F.lpad(F.hex(_number(s, 0, 1).bitwiseAND(F.lit(0xFC)).bitwiseOR(F.lit(2))), 2, "0"))
    return F.concat_ws(":", first, *[F.substring(s, 2 * i + 1, 2) for i in range(1, 6)])


def token_like(original: Column, s: Column) -> Column:
    dots = F.length(original) - F.length(F.replace(original, F.lit("."), F.lit("")))
    out = F.when((dots == 2) & original.startswith("eyJ"), F.concat(F.lit("eyJ"), pick(s, ALNUM, 16), F.lit("."), pick(s, ALNUM, 20, 16), F.lit("."), pick(s, ALNUM, 20, 36)))
    for prefix in TOKEN_PREFIXES:
        out = out.when(original.startswith(prefix), F.concat(F.lit(prefix), pick(s, ALNUM, F.greatest(F.lit(8), F.length(original) - len(prefix)))))
    return out.otherwise(pick(s, ALNUM, F.greatest(F.lit(12), F.length(original))))


def domain(original: Column, s: Column) -> Column:
    labels = F.split(original, r"\.")
    count = F.size(labels) - 1
    subs = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: pick(s, LOWER, 6, i * 3)), ".")
    suffix = F.when(F.lower(F.element_at(labels, -1)).isin(INTERNAL_SUFFIXES), ".pentest.local").otherwise(".example")
    return F.when(count < 1, F.concat(pick(s, LOWER, 8), F.lit(".example"))).otherwise(F.concat(subs, suffix))


def url(original: Column, s: Column) -> Column:
    shape = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*://)([^/?#]+)(.*)$"
    part = lambda k: F.regexp_extract(original, shape, k)
    authority = part(2)
    user = F.when(F.contains(authority, F.lit("@")), F.concat(F.lit("u"), pick(s, LOWER, 4), F.lit("@"))).otherwise("")
    host = F.regexp_replace(authority, "^[^@]*@", "")
    has_port = F.contains(host, F.lit(":")) & ~host.startswith("[")
    port = F.when(has_port, F.regexp_replace(host, "^[^:]*", "")).otherwise("")
    name = F.when(has_port, F.substring_index(host, ":", 1)).otherwise(host)
    path = F.regexp_replace(part(3), "(?s)[?#].*$", "")
    return F.when(original.rlike(shape), F.concat(part(1), user, domain(name, s), port, path)).otherwise(domain(original, s))


def hostname(original: Column, s: Column) -> Column:
    out = F.concat(F.lit("host-"), pick(s, LOWER + DIGITS, 7))
    return F.when(is_upper(original), F.upper(out)).otherwise(out)


def payment_card(original: Column, s: Column) -> Column:
    """As many digits in the same layout; the last one makes the Luhn sum right."""
    def digits(size: Column) -> Column:
        return _with(pick(s, DIGITS, size - 1), lambda body: _with_check_digit(body, size))

    return _with(_with(F.length(F.regexp_replace(original, "[^0-9]", "")), digits), lambda d: _laid(original, d))


def _with_check_digit(body: Column, size: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        digit = F.substring(body, i + 1, F.lit(1)).cast("int")
        twice = F.when(digit * 2 > 9, digit * 2 - 9).otherwise(digit * 2)
        return acc + F.when(i % 2 == size % 2, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0))), F.lit(0), add)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _laid(original: Column, digits: Column) -> Column:
    """The digits in the places of the original's."""

    def lay(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct((acc["at"] + is_digit.cast("int")).alias("at"), F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["at"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    chars = F.regexp_extract_all(original, F.lit("(?s)(.)"), 1)
    return F.aggregate(chars, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lay, lambda acc: acc["out"])


def path(original: Column, s: Column) -> Column:
    def one(p: Column, i: Column) -> Column:
        keep = p.isin("", ".", "..", "~") | ((F.length(p) == 2) & p.endswith(":"))
        return F.when(keep, p).otherwise(pick(s, LOWER, F.least(F.greatest(F.length(p), F.lit(4)), F.lit(10)), i))

    back = F.array_join(F.transform(F.split(original, r"\\"), one), "\\")
    return F.when(F.contains(original, F.lit("\\")), back).otherwise(F.array_join(F.transform(F.split(original, "/"), one), "/"))


def _sized(least: int, most: int) -> Callable[[Column, Column], Column]:
    """As many letters and digits as the original has characters, within limits."""
    return lambda original, s: pick(s, ALNUM, F.greatest(F.lit(least), F.least(F.length(original), F.lit(most))))


#: How each type's surrogate is made from the original and its keystream.
MAKERS: dict[str, Callable[[Column, Column], Column]] = {
    "IP_ADDRESS": ip_address,
    "CIDR": cidr,
    "IPV6": lambda original, s: ipv6(s),
    "HASH": hash_like,
    "MAC_ADDRESS": lambda original, s: mac(s),
    "TOKEN": token_like,
    "EMAIL_ADDRESS": lambda original, s: F.concat(pick(s, LOWER, 6), F.lit("@"), pick(s, LOWER, 7, 6), F.lit(".example")),
    "DOMAIN": domain,
    "URL": url,
    "HOSTNAME": hostname,
    "USERNAME": lambda original, s: F.concat(F.lit("u"), pick(s, LOWER + DIGITS, 6)),
    "PERSON": lambda original, s: F.concat_ws(" ", _choice(FIRST_NAMES, _number(s, 0, 4)), _choice(LAST_NAMES, _number(s, 4, 4))),
    "ORGANIZATION": lambda original, s: F.concat_ws(" ", _choice(COMPANY_NAMES, _number(s, 0, 4)), _choice(COMPANY_KINDS, _number(s, 4, 4))),
    "PAYMENT_CARD": payment_card,
    "CREDENTIAL": lambda original, s: F.concat(F.lit("Pw"), pick(s, ALNUM, 10), F.lit("!7")),
    "PATH": path,
    "IDENTIFIER": _sized(8, 24),
    "OTHER": _sized(6, 16),
}
#: Bytes of keystream that a type needs beyond the first 32, from the original's length.
NEEDS: dict[str, Callable[[Column], Column]] = {
    "TOKEN": lambda n: F.greatest(n, F.lit(64)),
    "HASH": lambda n: n,
    "DOMAIN": lambda n: n * 3 + 6,
    "URL": lambda n: n * 3 + 6,
    "PATH": lambda n: n + 10,
}


def surrogate_for(entity_type: str, original: Column, engagement: str = "default", salt: Column | str = "", wide: int = 0) -> Column:
    """The surrogate of one type; unknown types count as OTHER. ``wide``: addresses and networks from a larger space (WIDER)."""
    kind = entity_type.upper()
    need = NEEDS[kind](F.length(original)) if kind in NEEDS else 32
    s = keystream(engagement, F.lit(kind), original, F.lit(salt) if isinstance(salt, str) else salt, size=need)
    if wide and kind in ("IP_ADDRESS", "CIDR"):
        return _with(s, lambda s: (ip_address if kind == "IP_ADDRESS" else cidr)(original, s, wide))
    return _with(s, lambda s: MAKERS.get(kind, MAKERS["OTHER"])(original, s))


def surrogate(entity_type: Column, original: Column, engagement: str = "default", salt: Column | str = "", kinds: list[str] | None = None, wide: int = 0) -> Column:
    """The surrogate of a row's own type: one branch is evaluated for each row. A type outside TYPES keys its
    keystream with its own name. ``kinds``: the types that can occur, if known, to keep the plan small."""
    kind = F.upper(F.coalesce(entity_type, F.lit("OTHER")))
    s = keystream(engagement, kind, original, F.lit(salt) if isinstance(salt, str) else salt)
    other = _with(s, lambda s: MAKERS["OTHER"](original, s))
    out = None
    for name in TYPES[:-1]:
        if kinds is None or name in kinds:
            own = surrogate_for(name, original, engagement, salt, wide)
            out = F.when(kind == name, own) if out is None else out.when(kind == name, own)
    return other if out is None else out.otherwise(other)


#: The first address of the wider spaces, and how many they have.
_RANGES = {1: (198 << 24 | 18 << 16, 1 << 17), 2: (240 << 24, 15 << 24)}


def space(entity_type: Column, original: Column) -> Column:
    """The name of the small space that an original's surrogates come from (a type, with the prefix length of a network); null if its space is large."""
    kind = F.upper(entity_type)
    named = F.when(kind == "CIDR", F.concat(F.lit("CIDR/"), _prefix(original)))
    return named.when(kind.isin("PERSON", "ORGANIZATION") | ((kind == "IP_ADDRESS") & ~is_ipv6(original)), kind)


def members(name: str, wide: int = 0) -> tuple[int, Callable[[Column], Column]]:
    """How many surrogates a small space has, and the one of a number from 0 on. ``wide``: as for surrogate_for."""
    pools = {"PERSON": (FIRST_NAMES, LAST_NAMES), "ORGANIZATION": (COMPANY_NAMES, COMPANY_KINDS)}
    if name in pools:
        first, last = pools[name]
        return len(first) * len(last), lambda i: F.concat_ws(" ", _choice(first, F.floor(i / len(last))), _choice(last, i))
    kind, slash, prefix = name.partition("/")
    if not wide and kind == "CIDR":
        return len(TEST_NETS), lambda i: F.concat(_choice(TEST_NETS, i), F.lit(f"0/{prefix}"))
    if not wide:
        return len(TEST_NETS) * 253, lambda i: F.concat(_choice(TEST_NETS, F.floor(i / 253)), (i % 253 + 1).cast("string"))
    bits = min(int(prefix), 32) if re.fullmatch("[0-9]{1,2}", prefix) else 32
    first, count = _RANGES[2 if re.fullmatch("[0-9]|1[0-4]", prefix) else wide]
    low, step = first >> 32 - bits, 1 << 32 - bits
    return (first + count - 1 >> 32 - bits) - low + 1, lambda i: F.concat(_dotted((i + low) * step), F.lit(slash + prefix))


@lru_cache(maxsize=64)
def _surrogate_of(application: str, engagement: str, kinds: tuple[str, ...] | None, wide: int) -> Column:
    return surrogate(F.col("entity_type"), F.col("original"), engagement, F.col("salt"), None if kinds is None else list(kinds), wide)


def with_surrogates(rows: DataFrame, engagement: str, salt: str = "", kinds: list[str] | None = None, wide: int = 0) -> DataFrame:
    """rows (original, entity_type) with their ``surrogate``. The expression over all types is built once."""
    made = _surrogate_of(rows.sparkSession.sparkContext.applicationId, engagement, None if kinds is None else tuple(sorted(kinds)), wide)
    return rows.withColumn("salt", F.lit(salt)).withColumn("surrogate", made).drop("salt")
