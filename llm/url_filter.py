"""URL filters: pattern rules found by their rarest literal token (operator 11).

A rule is either a host and a path (``example.com/en/``: the host and all its subdomains, paths that start with the path) or a
pattern of the kind that block lists have (see pattern_regex). Each rule is compiled to one regular expression, and indexed under one of
the tokens ``[a-z0-9]+`` that every URL which it fits must hold whole: the one that fewest URLs of the table hold. A URL is
tokenised once; its tokens fetch the rules indexed under them by a join, and only those rules run their expressions on it. Rules
without a sure token are indexed under the empty token, which every URL has.

Of fitting host rules the longest wins, whatever patterns say. Where none fits, an allowing pattern wins over a blocking one, the longest of
a kind is named, and a URL that nothing fits is allowed.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.batches import long_ids

ALLOW, BLOCK = "allow", "block"
#: Characters of all rules up to which their index is broadcast; beyond, tokens meet it by a shuffle.
BROADCAST_CHARS = 4_000_000
#: URLs that one shuffled key may bring to a task: keys with more are dealt over salts.
HOT_ROWS = 100_000
#: Shares of a table's rows beyond which a URL counts as frequent; there are at most so many of them, whatever the table's size.
FREQUENT = 1_000
RULES = "kind string, rule string, verdict string, regex string, tokens array<string>, size int"
#: Host rules of the registered query (fixed values): verdict, host, path.
HOST_RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]
#: Patterns of the registered query, by what they keep out; allowing ones are exceptions.
BLOCKED_PATTERNS = {
    "gambling": ["||casino-", "||casino.", "||*-casino.", "||*-bets.", "||bet-", "||bets.", "||poker-", "/casino/", "/betting/"],
    "adult": ["||adult-", "||adult.", "||xxx.", "||*-xxx.", "||porn*", "/xxx/"],
    "pharmacy": ["||*-pills.", "||pills-", "||cheap-meds", "/viagra^"],
    "advertising": ["||ads.", "||ads-", "||ad.", "||adserver.", "||doubleclick.", "/ads/", "/banners/", "/popunder^", "^ad_id="],
    "tracking": ["||track.", "||tracker.", "||*-track.", "||pixel.", "^clickid="],
    "spam": ["||spam-", "||*-spam.", "||free-*", "||link-farm", "/spam/"],
    "files": [".exe|", ".apk|", ".zip|"],
}
ALLOWED_PATTERNS = ["||archive.*/web/", "/robots.txt|", "||free-software-foundation."]
_TOKEN = "[a-z0-9]+"
_ANY_CASE = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def pattern_regex(pattern: str) -> str:
    """The expression of a pattern, for the lower-cased part of a URL behind its first ``://``: ``*`` stands for any run, ``^``
    for a character other than letters, digits and ``_ . % -`` or for the end, ``||`` at the front for the beginning of the host or of any of its labels,
    ``|`` at the front or end for that edge; all else for itself."""
    body = pattern.translate(_ANY_CASE)
    core = body.lstrip("|")
    end = r"\z" if core.endswith("|") else ""
    literal = lambda part: "".join(r"(?:[^a-z0-9_.%-]|\z)" if c == "^" else re.escape(c) for c in part)
    first, *later = map(literal, core.rstrip("|").split("*"))
    if not later:
        return (r"^(?:[^/?#]*\.)?" if body.startswith("||") else "^" if body.startswith("|") else "") + first + end
    # What stands between stars is taken where it first fits and not tried again elsewhere, so that no URL costs more than its length.
    front = r"^(?>(?:[^/?#]*?\.)??" if body.startswith("||") else "^(?>" if body.startswith("|") else r"^(?>[\s\S]*?"
    middle = "".join(rf"(?>[\s\S]*?{part})" for part in later[:-1])
    return f"{front}{first}){middle}" + (rf"[\s\S]*{later[-1]}\z" if end else rf"[\s\S]*?{later[-1]}")


def pattern_tokens(pattern: str) -> list[str]:
    """The tokens that a URL which the pattern fits holds whole: those with a sure edge on either side."""
    body = pattern.translate(_ANY_CASE)
    ends = f"{'/' if body.startswith('|') else '*'}{body.strip('|')}{'/' if body.endswith('|') and body.strip('|') else '*'}"
    return sorted({m.group() for m in re.finditer(_TOKEN, ends) if "*" not in (ends[m.start() - 1], ends[m.end()])})


def host_regex(host: str, path: str) -> str:
    """The expression of a host rule, for a URL's lower-cased host with its path as it is."""
    behind = "" if path else r"(?:/|\z)"
    return rf"^(?:[^/]*\.)?{re.escape(host.translate(_ANY_CASE) + path)}{behind}"


def host_tokens(host: str, path: str) -> list[str]:
    """As pattern_tokens: a path's last token may go on."""
    laid = f"/{host}{path}{'*' if path else '/'}".translate(_ANY_CASE)
    return sorted({m.group() for m in re.finditer(_TOKEN, laid) if laid[m.end()] != "*"})


def compiled_rules(spark: SparkSession, hosts: Iterable[tuple[str, str, str]], patterns: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules (RULES) from (verdict, host, path) and (verdict, pattern). A path must be empty or start with ``/``."""
    rows = []
    for verdict, host, path in hosts:
        if path and not path.startswith("/"):
            raise ValueError(f"a path starts with /: {path}")
        rows.append(("host", host.translate(_ANY_CASE) + path, verdict, host_regex(host, path), host_tokens(host, path), len(host + path)))
    rows += [("pattern", p, verdict, pattern_regex(p), pattern_tokens(p), len(p)) for verdict, p in patterns]
    if bad := {r[2] for r in rows} - {ALLOW, BLOCK}:
        raise ValueError(f"a verdict is allow or block: {sorted(bad)}")
    return spark.createDataFrame(rows, RULES).coalesce(1)


def standard_rules(spark: SparkSession) -> DataFrame:
    """The rules of the registered query."""
    return compiled_rules(spark, HOST_RULES, [*((BLOCK, p) for kind in BLOCKED_PATTERNS.values() for p in kind), *((ALLOW, p) for p in ALLOWED_PATTERNS)])


def url_filter_sql() -> str:
    """DuckDB SQL for filter_urls over pages with the standard rules: every rule is held against every URL."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    hosts = ", ".join(f"({quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in HOST_RULES)
    patterns = ", ".join(f"({quoted(v)}, {quoted(p)})" for v, p in [*((BLOCK, p) for kind in BLOCKED_PATTERNS.values() for p in kind), *((ALLOW, p) for p in ALLOWED_PATTERNS)])
    return rf"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT rest, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM split),
hosts AS (SELECT * FROM (VALUES {hosts}) x (v, h, p)),
patterns AS (SELECT v, p, CASE WHEN starts_with(p, '||') THEN '^(?:[^/?#]*\.)?' WHEN starts_with(p, '|') THEN '^' ELSE '' END
  || replace(replace(regexp_escape(trim(p, '|')), '\*', '[\s\S]*'), '\^', '(?:[^a-z0-9_.%-]|\z)') || CASE WHEN length(p) > 1 AND p[-1] = '|' THEN '\z' ELSE '' END AS r FROM (VALUES {patterns}) x (v, p)),
a AS (SELECT rest, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM d JOIN hosts ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
b AS (SELECT rest, max({{'n': length(p), 'p': p}}) FILTER (v = 'allow') AS a, max({{'n': length(p), 'p': p}}) FILTER (v = 'block') AS b FROM d JOIN patterns ON regexp_matches(low, r) GROUP BY 1)
SELECT s.page_id, d.host, d.path, a.rule, coalesce(a.v, CASE WHEN b.a IS NULL AND b.b IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN a.rule IS NULL THEN coalesce(b.a.p, b.b.p) END AS pattern
FROM (SELECT page_id, coalesce(rest, '') AS rest FROM split) s JOIN d ON s.rest = d.rest LEFT JOIN a ON a.rest = d.rest LEFT JOIN b ON b.rest = d.rest"""


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and all behind the first ``://``; all empty without one."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return _lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), rest


def _tokens(rest: Column) -> Column:
    """Distinct tokens of a URL, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(_lower(rest), F.lit(f"({_TOKEN})"), 1)))


def _indexed(rules: DataFrame, tokens: DataFrame, small: bool) -> DataFrame:
    """Rules with their rarest token, and the number n of rows of ``tokens`` that have it."""
    own = rules.withColumn("token", F.explode_outer("tokens")).withColumn("token", F.coalesce("token", F.lit("")))
    wanted = own.select("token").distinct()
    seen = tokens.join(F.broadcast(wanted) if small else wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = own.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy("kind", "rule", "verdict", "regex", "size").agg(F.min(F.struct("n", "token")).alias("t"))
    return best.select("kind", "rule", "verdict", "regex", "size", "t.token", "t.n")


def _met(tokens: DataFrame, index: DataFrame, small: bool) -> DataFrame:
    """Each URL's token with the rules indexed under it, or with none."""
    if small:
        return tokens.join(F.broadcast(index.drop("n")), "token", "left")
    salted = index.withColumn("salts", F.ceil(F.col("n") / HOT_ROWS).cast("int"))
    hot = salted.where("salts > 1").select("token", "salts").distinct().orderBy(F.desc("salts")).limit(100 * FREQUENT)
    dealt = tokens.join(F.broadcast(hot), "token", "left").withColumn("salt", F.pmod(F.xxhash64("url"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")).drop("salts")
    # The salts of tokens beyond hot's limit stay unused: both sides take them from the same rows.
    spread = index.join(F.broadcast(hot), "token", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", "n")
    return dealt.join(spread, ["token", "salt"], "left").drop("salt")


def judged_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, host, path, rule, pattern and verdict of each distinct URL of urls (url, none null)."""
    size = rules.agg(F.coalesce(F.sum(F.length("regex") + F.length("rule")), F.lit(0)).alias("chars")).first()["chars"]
    small = size <= BROADCAST_CHARS
    host, path, rest = url_parts(F.col("url"))
    laid = urls.select("url", host.alias("host"), path.alias("path"), rest.alias("rest"))
    tokens = laid.withColumn("token", F.explode(_tokens(F.col("rest"))))
    met = _met(tokens, _indexed(rules, tokens.select("token"), small), small)
    fits = F.rlike(F.when(F.col("kind") == "host", F.concat("host", "path")).otherwise(_lower(F.col("rest"))), F.col("regex"))
    hit = F.when(fits, F.struct("size", (F.col("verdict") == BLOCK).alias("blocks"), "rule"))
    # Blocks win between host rules of one length; of patterns allowing ones come first.
    kinds = {"by_host": F.when(F.col("kind") == "host", hit), **{v: F.when((F.col("kind") == "pattern") & (F.col("verdict") == v), hit) for v in (ALLOW, BLOCK)}}
    best = met.groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), *[F.max(c).alias(name) for name, c in kinds.items()])
    pattern = F.coalesce(F.col("allow.rule"), F.col("block.rule"))
    verdict = F.when(F.col("by_host").isNotNull(), F.when(F.col("by_host.blocks"), BLOCK).otherwise(ALLOW)).when(F.col("allow").isNull() & F.col("block").isNotNull(), BLOCK).otherwise(ALLOW)
    return best.select("url", "host", "path", F.col("by_host.rule").alias("rule"), F.when(F.col("by_host").isNull(), pattern).alias("pattern"), verdict.alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and pattern of every row. ``rule`` is the host rule that decides, ``pattern`` the pattern
    that does where no host rule fits; both are null where nothing fits.

    Defined cases: a null URL, and one without ``://``, has an empty host and path, and only patterns that fit the empty string fit
    it; URLs of any length are taken whole; a null id comes back as null; repeated rows are judged each; an empty table gives no rows;
    without rules all is allowed. Of host rules of one length a blocking one wins. Other columns are ignored. Each distinct URL is judged once; rows
    of URLs that a thousandth of the table has meet their verdict by broadcast (a thousand URLs at most), the others by their shuffle.
    """
    rows = pages.select(long_ids(pages, id_col).alias(id_col), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"))
    counted = rows.groupBy("url").agg(F.count("*").alias("copies"))
    least = max(HOT_ROWS, pages.count() // FREQUENT)
    hot = counted.where(F.col("copies") > least).select("url")
    out = [id_col, "host", "path", "rule", "verdict", "pattern"]
    rest = rows.join(F.broadcast(hot), "url", "left_anti").join(judged_urls(counted.where(F.col("copies") <= least).select("url"), rules), "url")
    return rest.select(out).unionAll(rows.join(F.broadcast(judged_urls(hot, rules)), "url").select(out))
