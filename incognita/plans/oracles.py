"""DuckDB SQL that computes the queries' results on its own."""

from __future__ import annotations

import re

from incognita.functions import surrogates as sg
from incognita.functions.rules import ALLOWED_WORDS, CARD, CARD_SQL_BEFORE, RULES, SAFE_WORDS, STRUCTURED_TYPES, Rule
from incognita.sources.corpus import LINES_SQL

MARK = "chr(57344)"
TOOL = LINES_SQL.format(customer="customer")
TEXTS = f"""texts AS (
  SELECT 'documents' AS source, doc_id AS row_id, text FROM documents
  UNION ALL SELECT 'pages', page_id, html FROM pages
  UNION ALL SELECT * FROM ({TOOL})
)"""


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return ", ".join(map(lit, values))


def pattern(rule: Rule) -> str:
    flags = f"(?{rule.flags})" if rule.flags else ""
    before = CARD_SQL_BEFORE if rule is CARD else rule.before
    return lit(f"{flags}({before})({rule.value})({rule.behind})")


LUHN = """(length(regexp_replace(v, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(regexp_replace(v, '[ -]', '', 'g'))), lambda i:
  CASE WHEN (length(regexp_replace(v, '[ -]', '', 'g')) - i) % 2 = 0
       THEN (2 * CAST(substr(regexp_replace(v, '[ -]', '', 'g'), i + 1, 1) AS INT)) // 10 + (2 * CAST(substr(regexp_replace(v, '[ -]', '', 'g'), i + 1, 1) AS INT)) % 10
       ELSE CAST(substr(regexp_replace(v, '[ -]', '', 'g'), i + 1, 1) AS INT) END)) % 10 = 0)"""


def rule_matches(rule: Rule) -> str:
    test = LUHN if rule is CARD else f"v <> '' AND lower(v) NOT IN ({words(SAFE_WORDS)})"
    return f"""WITH {TEXTS}, m AS (SELECT source, row_id, unnest(regexp_extract_all(text, {pattern(rule)}, 2)) AS v FROM texts)
SELECT source, row_id, v AS value, count(*) AS n FROM m WHERE {test} GROUP BY ALL"""


def _spans(texts: str = "texts") -> str:
    """CTEs up to ``claims`` (source, row_id, list of claimed spans)."""
    parts = []
    for i, rule in enumerate([CARD, *RULES]):
        test = LUHN if rule is CARD else f"v <> '' AND lower(v) NOT IN ({words(SAFE_WORDS)})"
        parts.append(f"""SELECT source, row_id, {i} AS r, s, s + length(v) AS e, v, '{rule.entity_type}' AS t FROM (
    SELECT source, row_id, list_sum(list_transform(p[1:k - 1], lambda x: length(x))) AS s, p[k] AS v FROM (
      SELECT source, row_id, p, unnest(range(2, len(p) + 1, 2)) AS k FROM (
        SELECT source, row_id, string_split(regexp_replace(text, {pattern(rule)}, '\\1' || {MARK} || '\\2' || {MARK} || '\\3', 'g'), {MARK}) AS p
        FROM {texts} WHERE regexp_matches(text, {pattern(rule)})))) WHERE {test}""")
    union = "\n  UNION ALL ".join(parts)
    return f"""spans AS ({union}),
listed AS (SELECT source, row_id, list([{{'s': s, 'e': e, 'v': v, 't': t}}] ORDER BY r, s) AS l FROM spans GROUP BY ALL),
claims AS (SELECT source, row_id, list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda y: y.s < b[1].e AND b[1].s < y.e)) > 0 THEN a ELSE list_concat(a, b) END) AS c FROM listed)"""


CLAIMED = f"WITH {TEXTS}, {_spans()}, u AS (SELECT source, row_id, unnest(c) AS x FROM claims) SELECT source, row_id, x.s::INT AS start, x.e::INT AS \"end\", x.v AS value, x.t AS entity_type FROM u"
_CODES = "'(?:%[0-9a-fA-F]{2})+'"


def _decoded(text: str) -> str:
    """Lenient percent decoding. In a run of codes that is no UTF-8 as a whole, bytes beyond ASCII count as unknown characters."""
    run = f"replace(regexp_extract_all({text}, {_CODES})[i + 1], '%', '')"
    bytes_ = f"list_transform(range(length({run}) // 2), lambda j: CAST('0x' || substr({run}, 2 * j + 1, 2) AS INT))"
    one = f"coalesce(try(decode(from_hex({run}))), array_to_string(list_transform({bytes_}, lambda b: CASE WHEN b < 128 THEN chr(b) ELSE chr(65533) END), ''), '')"
    gaps = f"string_split_regex({text}, {_CODES})"
    return f"array_to_string(list_transform(range(len({gaps})), lambda i: {gaps}[i + 1] || {one}), '')"


def found(texts: str = "texts") -> str:
    """CTEs up to ``found``: distinct (source, row_id, value, entity_type) by claims on raw texts, and on the decoded copies of those with percent signs, of which
    counts what stands verbatim in the text, and whose first claim of a value decides its type."""
    return f"""copies AS (SELECT source || '%' AS source, row_id, {_decoded('text')} AS text FROM {texts} WHERE regexp_matches(text, {_CODES})),
forms AS (SELECT source, row_id, text FROM {texts} UNION ALL SELECT c.source, c.row_id, c.text FROM copies c JOIN {texts} t ON c.source = t.source || '%' AND c.row_id = t.row_id WHERE c.text <> t.text), {_spans('forms')},
claimed AS (SELECT rtrim(source, '%') AS source, row_id, suffix(source, '%') AS is_copy, unnest(c) AS x, unnest(range(len(c))) AS k FROM claims),
ranked AS (SELECT c.source, c.row_id, x.v AS value, x.t AS entity_type, row_number() OVER (PARTITION BY c.source, c.row_id, x.v ORDER BY is_copy DESC, k) AS n
  FROM claimed c JOIN {texts} t ON t.source = c.source AND t.row_id = c.row_id WHERE NOT is_copy OR contains(t.text, x.v)),
found AS (SELECT source, row_id, value, entity_type FROM ranked WHERE n = 1)"""


FOUND = f"{TEXTS}, {found()}"

# --- surrogates ----------------------------------------------------------------------------------------------------------

def stream_cte(source: str, kind: str, engagement: str, salt: str = "''", size: int = 128, name: str = "k") -> str:
    """A CTE ``name``: the rows of ``source`` (with a column original) and ks, their keystream in hex."""
    inner, outer = sg.pads(engagement)
    seed = f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({kind}) || from_hex('00') || encode(original) || from_hex('00') || encode({salt}))))"
    blocks = " || ".join(f"sha256(from_hex(seed) || from_hex('{i:08x}'))" for i in range(1, -(-size // 32)))
    return f"{name} AS (SELECT *, seed || {blocks} AS ks FROM (SELECT *, {seed} AS seed FROM {source}))"


def _pick(alphabet: str, count: str | int, at: str | int = 0, ks: str = "ks") -> str:
    return f"array_to_string(list_transform(range(CAST({count} AS BIGINT)), lambda i: substr('{alphabet}', 1 + CAST('0x' || substr({ks}, CAST(2 * (i + {at}) + 1 AS BIGINT), 2) AS INT) % {len(alphabet)}, 1)), '')"


def _int(at: int) -> str:
    return f"CAST('0x' || substr(ks, {2 * at + 1}, 8) AS BIGINT)"


def _choice(values: list[str], number: str) -> str:
    return f"([{words(values)}])[1 + {number} % {len(values)}]"


def _upper(value: str) -> str:
    return f"(upper({value}) = {value} AND lower({value}) <> {value})"


def _domain(value: str) -> str:
    labels = f"string_split({value}, '.')"
    one = _pick(sg.LOWER, 6, "3 * j").replace("lambda i", "lambda i")
    subs = f"array_to_string(list_transform(range(len({labels}) - 1), lambda j: {one}), '.')"
    return f"CASE WHEN len({labels}) < 2 THEN {_pick(sg.LOWER, 8)} || '.example' ELSE {subs} || CASE WHEN lower({labels}[-1]) IN ({words(sg.INTERNAL_SUFFIXES)}) THEN '.pentest.local' ELSE '.example' END END"


def _byte(at: int) -> str:
    return f"CAST('0x' || substr(ks, {2 * at + 1}, 2) AS INT)"


#: Addresses of the wider spaces.
WIDER = {
    1: f"{_choice(['198.18.', '198.19.'], _int(0))} || CAST(CAST('0x' || substr(ks, 9, 4) AS INT) % 256 AS VARCHAR) || '.' || CAST(CAST('0x' || substr(ks, 13, 4) AS INT) % 256 AS VARCHAR)",
    2: f"CAST({_byte(0)} % 15 + 240 AS VARCHAR) || '.' || CAST({_byte(1)} AS VARCHAR) || '.' || CAST({_byte(2)} AS VARCHAR) || '.' || CAST({_byte(3)} AS VARCHAR)",
}


def surrogate_expression(kind: str, wide: int = 0) -> str:
    """The surrogate in terms of ``original`` and ``ks``."""
    n = "length(original)"
    v6 = "'2001:db8:' || " + " || ':' || ".join(_pick(sg.HEX, 4, at) for at in (0, 4, 8, 12))
    if kind == "IP_ADDRESS":
        group = "[0-9a-fA-F]{1,4}"
        v4 = WIDER[wide] if wide else f"{_choice(sg.TEST_NETS, _int(0))} || CAST({_int(4)} % 253 + 1 AS VARCHAR)"
        return f"CASE WHEN regexp_full_match(original, '({group}:){{7}}{group}') THEN {v6} ELSE {v4} END"
    if kind == "IPV6":
        return v6
    if kind == "CIDR":
        prefix = "CASE WHEN contains(original, '/') THEN string_split(original, '/')[-1] ELSE '24' END"
        if not wide:
            return f"{_choice(sg.TEST_NETS, _int(0))} || '0/' || {prefix}"
        address = f"string_split(CASE WHEN regexp_full_match({prefix}, '[0-9]|1[0-4]') THEN {WIDER[2]} ELSE {WIDER[wide]} END, '.')"
        number = f"list_reduce(list_transform({address}, lambda x: x::BIGINT), lambda a, b: a * 256 + b)"
        base = f"(({number}) >> (32 - ({prefix})::INT)) << (32 - ({prefix})::INT)"
        return f"array_to_string(list_transform([24, 16, 8, 0], lambda k: ((({base}) >> k) & 255)::VARCHAR), '.') || '/' || {prefix}"
    if kind == "HASH":
        def one(value: str, ks: str) -> str:
            out = _pick(sg.HEX, f"length({value})", 0, ks)
            return f"CASE WHEN {_upper(value)} THEN upper({out}) ELSE {out} END"

        inner, outer = sg.pads("x")
        seed = f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode(p))))"
        joined = f"array_to_string(list_transform(string_split(original, ':'), lambda p: {one('p', seed)}), ':')"
        return f"CASE WHEN contains(original, ':') AND regexp_full_match(original, '[0-9a-fA-F:]+') THEN {joined} ELSE {one('original', 'ks')} END"
    if kind == "MAC_ADDRESS":
        first = "lower(lpad(to_hex((CAST('0x' || substr(ks, 1, 2) AS INT) & 252) | 2), 2, '0'))"
        return first + "".join(f" || ':' || substr(ks, {2 * i + 1}, 2)" for i in range(1, 6))
    if kind == "TOKEN":
        cases = "".join(f" WHEN starts_with(original, '{p}') THEN '{p}' || {_pick(sg.ALNUM, f'greatest(8, {n} - {len(p)})')}" for p in sg.TOKEN_PREFIXES)
        return f"CASE WHEN length(original) - length(replace(original, '.', '')) = 2 AND starts_with(original, 'eyJ') THEN 'eyJ' || {_pick(sg.ALNUM, 16)} || '.' || {_pick(sg.ALNUM, 20, 16)} || '.' || {_pick(sg.ALNUM, 20, 36)}{cases} ELSE {_pick(sg.ALNUM, f'greatest(12, {n})')} END"
    if kind == "EMAIL_ADDRESS":
        return f"{_pick(sg.LOWER, 6)} || '@' || {_pick(sg.LOWER, 7, 6)} || '.example'"
    if kind == "DOMAIN":
        return _domain("original")
    if kind == "URL":
        shape = "'^([a-zA-Z][a-zA-Z0-9+.-]*://)([^/?#]+)(.*)$'"
        part = lambda k: f"regexp_extract(original, {shape}, {k})"
        host = f"regexp_replace({part(2)}, '^[^@]*@', '')"
        port = f"(contains({host}, ':') AND NOT starts_with({host}, '['))"
        user = f"CASE WHEN contains({part(2)}, '@') THEN 'u' || {_pick(sg.LOWER, 4)} || '@' ELSE '' END"
        name = f"CASE WHEN {port} THEN string_split({host}, ':')[1] ELSE {host} END"
        tail = f"CASE WHEN {port} THEN regexp_replace({host}, '^[^:]*', '') ELSE '' END"
        return f"CASE WHEN regexp_matches(original, {shape}) THEN {part(1)} || {user} || {_domain('(' + name + ')')} || {tail} || regexp_replace({part(3)}, '[?#].*$', '') ELSE {_domain('original')} END"
    if kind == "HOSTNAME":
        out = f"'host-' || {_pick(sg.LOWER + sg.DIGITS, 7)}"
        return f"CASE WHEN {_upper('original')} THEN upper({out}) ELSE {out} END"
    if kind == "USERNAME":
        return f"'u' || {_pick(sg.LOWER + sg.DIGITS, 6)}"
    if kind == "PERSON":
        return f"{_choice(sg.FIRST_NAMES, _int(0))} || ' ' || {_choice(sg.LAST_NAMES, _int(4))}"
    if kind == "ORGANIZATION":
        return f"{_choice(sg.COMPANY_NAMES, _int(0))} || ' ' || {_choice(sg.COMPANY_KINDS, _int(4))}"
    if kind == "PAYMENT_CARD":
        size = "length(regexp_replace(original, '[^0-9]', '', 'g'))"
        digit = "CAST('0x' || substr(ks, CAST(2 * i + 1 AS BIGINT), 2) AS INT) % 10"
        total = f"coalesce(list_sum(list_transform(range(CAST({size} - 1 AS BIGINT)), lambda i: CASE WHEN i % 2 = {size} % 2 THEN (2 * ({digit})) // 10 + (2 * ({digit})) % 10 ELSE {digit} END)), 0)"
        digits = f"({_pick(sg.DIGITS, size + ' - 1')} || CAST((10 - {total} % 10) % 10 AS VARCHAR))"
        before = "length(regexp_replace(substr(original, 1, i + 1), '[^0-9]', '', 'g'))"
        return f"array_to_string(list_transform(range(length(original)), lambda i: CASE WHEN regexp_full_match(substr(original, i + 1, 1), '[0-9]') THEN substr(d, {before}, 1) ELSE substr(original, i + 1, 1) END), '')", digits
    if kind == "CREDENTIAL":
        return f"'Pw' || {_pick(sg.ALNUM, 10)} || '!7'"
    if kind == "PATH":
        def one(p: str) -> str:
            picked = _pick(sg.LOWER, f"least(greatest(length({p}), 4), 10)", "j")
            return f"CASE WHEN {p} IN ('', '.', '..', '~') OR (length({p}) = 2 AND suffix({p}, ':')) THEN {p} ELSE {picked} END"

        def joined(sep: str) -> str:
            return f"array_to_string(list_transform(range(len(string_split(original, '{sep}'))), lambda j: {one(f'(string_split(original, {lit(sep)}))[j + 1]')}), '{sep}')"

        return f"CASE WHEN contains(original, '\\') THEN {joined(chr(92))} ELSE {joined('/')} END"
    if kind == "IDENTIFIER":
        return _pick(sg.ALNUM, f"greatest(8, least({n}, 24))")
    return _pick(sg.ALNUM, f"greatest(6, least({n}, 16))")


def surrogate_cte(source: str, kind: str, engagement: str, salt: str = "''", name: str = "minted", wide: int = 0) -> str:
    """CTEs that give ``name``: the rows of ``source`` with their surrogate."""
    ks = stream_cte(source, lit(kind), engagement, salt, name=f"{name}_k")
    expression = surrogate_expression(kind, wide)
    if isinstance(expression, tuple):
        laid, digits = expression
        return f"{ks}, {name}_d AS (SELECT *, {digits} AS d FROM {name}_k), {name} AS (SELECT * EXCLUDE (d), {laid} AS surrogate FROM {name}_d)"
    return f"{ks}, {name} AS (SELECT *, {expression} AS surrogate FROM {name}_k)"


#: Originals of each type, from the customer table: SQL that Spark and DuckDB share.
ORIGINALS = {
    "IP_ADDRESS": "CASE WHEN c_custkey % 5 = 0 THEN 'fe80:0:0:1:2:3:4:' || substr(md5(c_name), 1, 3) ELSE '10.' || CAST(c_custkey % 250 AS STRING) || '.1.' || CAST(c_nationkey AS STRING) END",
    "CIDR": "'10.' || CAST(c_custkey % 250 AS STRING) || '.0.0/' || CAST(8 + c_custkey % 20 AS STRING)",
    "IPV6": "'fe80::' || substr(md5(c_name), 1, 4)",
    "HASH": "CASE c_custkey % 3 WHEN 0 THEN md5(c_name) || ':' || upper(md5(upper(c_name))) WHEN 1 THEN upper(md5(c_name)) ELSE md5(c_name) || substr(md5(c_name), 1, 8) END",
    "MAC_ADDRESS": "'0a:1b:2c:' || substr(md5(c_name), 1, 2) || ':00:' || substr(md5(c_name), 3, 2)",
    "TOKEN": "CASE c_custkey % 4 WHEN 0 THEN 'eyJ' || md5(c_name) || '.abcdefghijk.' || md5(c_name) WHEN 1 THEN 'ghp_' || md5(c_name) WHEN 2 THEN 'AKIA' || substr(md5(c_name), 1, 3) ELSE substr(md5(c_name), 1, 6) END",
    "EMAIL_ADDRESS": "'u' || CAST(c_custkey AS STRING) || '@corp.com'",
    "DOMAIN": "CASE c_custkey % 3 WHEN 0 THEN 'host' || CAST(c_custkey AS STRING) WHEN 1 THEN 'a.b' || CAST(c_custkey AS STRING) || '.corp.local' ELSE 'www.shop' || CAST(c_custkey AS STRING) || '.com' END",
    "URL": "CASE c_custkey % 4 WHEN 0 THEN 'http://user:pw@www.shop' || CAST(c_custkey AS STRING) || '.com:81/a/b?c=1#d' WHEN 1 THEN 'https://10.0.0.' || CAST(c_custkey % 250 AS STRING) || '/x' WHEN 2 THEN 'ftp://[::1]:21/y' || CAST(c_custkey AS STRING) ELSE 'http://h' || CAST(c_custkey AS STRING) || '.lan#z' END",
    "HOSTNAME": "CASE c_custkey % 2 WHEN 0 THEN 'SRV-' || CAST(c_custkey AS STRING) ELSE 'srv-' || CAST(c_custkey AS STRING) END",
    "USERNAME": r"'CORP\user' || CAST(c_custkey AS STRING)",
    "PERSON": "'Person ' || CAST(c_custkey AS STRING)",
    "ORGANIZATION": "'Company ' || CAST(c_custkey AS STRING)",
    "PAYMENT_CARD": "CASE c_custkey % 3 WHEN 0 THEN '4111 1111 1111 ' || lpad(CAST(c_custkey % 9999 AS STRING), 4, '0') WHEN 1 THEN '3782-822463-1' || lpad(CAST(c_custkey % 9999 AS STRING), 4, '0') ELSE '4' || lpad(CAST(c_custkey AS STRING), 12, '0') END",
    "CREDENTIAL": "'pw' || md5(c_name)",
    "PATH": r"CASE c_custkey % 3 WHEN 0 THEN 'C:\Users\u' || CAST(c_custkey AS STRING) || '\loot.txt' WHEN 1 THEN '/home/u' || CAST(c_custkey AS STRING) || '/../x' ELSE '~/a/verylongfilename' || CAST(c_custkey AS STRING) END",
    "IDENTIFIER": "lpad(CAST(c_custkey AS STRING), 11 + c_nationkey, '0')",
    "OTHER": "'thing ' || CAST(c_custkey AS STRING)",
}


def surrogate_query(kind: str, engagement: str) -> str:
    return f"WITH o AS (SELECT DISTINCT {ORIGINALS[kind]} AS original FROM customer), {surrogate_cte('o', kind, engagement)} SELECT original, surrogate FROM minted"


# --- vaults --------------------------------------------------------------------------------------------------------------

def vault_ctes(wanted: str, engagement: str, rounds: int, kinds: list[str], late_rounds: int = 0, late: tuple[str, ...] = ("IP_ADDRESS", "CIDR")) -> str:
    """CTEs up to ``vault`` (original, entity_type, surrogate) from ``wanted`` (original, entity_type): so many rounds of
    offers, and ``late_rounds`` more for the types ``late``; an original still open after them is missing."""
    out = [f"open0 AS MATERIALIZED (SELECT original, min(entity_type) AS entity_type FROM {wanted} GROUP BY original)"]
    won = []
    for k in range(rounds + late_rounds):
        salt = "''" if k == 0 else f"'#{k - 1}'"
        wide = 2 if k >= 8 else 1 if k >= 3 else 0
        offers = []
        for i, kind in enumerate(kinds):
            if k >= rounds and kind not in late:
                continue
            source = f"open{k}_{i}"
            out.append(f"{source} AS (SELECT * FROM open{k} WHERE entity_type = '{kind}')")
            out.append(surrogate_cte(source, kind, engagement, salt, name=f"mint{k}_{i}", wide=wide))
            offers.append(f"SELECT original, entity_type, surrogate FROM mint{k}_{i}")
        taken = " UNION ALL ".join(f"SELECT surrogate FROM won{j}" for j in range(k)) or "SELECT NULL AS surrogate WHERE false"
        out.append(f"offer{k} AS MATERIALIZED ({' UNION ALL '.join(offers)})")
        out.append(f"won{k} AS MATERIALIZED (SELECT original, entity_type, surrogate FROM (SELECT *, row_number() OVER (PARTITION BY surrogate ORDER BY original) AS n FROM offer{k} WHERE surrogate NOT IN ({taken}) AND surrogate NOT IN (SELECT original FROM open0)) WHERE n = 1)")
        out.append(f"open{k + 1} AS MATERIALIZED (SELECT * FROM open{k} WHERE original NOT IN (SELECT original FROM won{k}))")
        won.append(f"SELECT * FROM won{k}")
    out.append(f"vault AS MATERIALIZED ({' UNION ALL '.join(won)})")
    return ", ".join(out)


_WORD = r"'^[\p{L}\p{N}_]$'"


def anonymised(texts: str = "texts") -> str:
    """CTEs from ``found`` and ``vault`` up to ``anonymised`` (source, row_id, before, text): of the places where a text's values stand as whole tokens (a percent
    code before them counts as an edge) the leftmost count first, of those that start together the longest; each takes its surrogate."""
    word = lambda place: f"regexp_matches(substr(t, {place}, 1), {_WORD})"
    return f"""sought AS (SELECT f.source, f.row_id, f.value AS v, surrogate, t.text AS t,
  CASE WHEN len(list_filter(range(1, length(f.value)), lambda k: f.value[1:k] = f.value[length(f.value) - k + 1:])) > 0 THEN f.value[1:1] ELSE f.value END AS sep
  FROM found f JOIN vault ON vault.original = f.value JOIN {texts} t ON t.source = f.source AND t.row_id = f.row_id),
cuts AS (SELECT source, row_id, v, surrogate, length(sep) AS w, string_split(t, sep) AS ps FROM sought),
ends AS (SELECT * EXCLUDE (ps), unnest(list_transform(ps, lambda p: length(p))) AS p, unnest(range(1, len(ps) + 1)) AS k, len(ps) AS n FROM cuts),
starts AS (SELECT *, (sum(p) OVER (PARTITION BY source, row_id, v ORDER BY k) + (k - 1) * w)::BIGINT AS s FROM ends),
places AS (SELECT p.source, p.row_id, v, surrogate, s, t.text AS t FROM starts p JOIN {texts} t ON t.source = p.source AND t.row_id = p.row_id WHERE k < n),
stands AS (SELECT source, row_id, surrogate, s, s + length(v) AS e FROM places WHERE substr(t, s + 1, length(v)) = v
  AND (s = 0 OR NOT {word('s + 1')} OR NOT {word('s')} OR (s >= 3 AND regexp_full_match(substr(t, s - 2, 3), '%[0-9a-fA-F]{{2}}')))
  AND (s + length(v) = length(t) OR NOT {word('s + length(v)')} OR NOT {word('s + length(v) + 1')})),
ordered AS (SELECT source, row_id, list([{{'s': s, 'e': e, 'new': surrogate}}] ORDER BY s, e DESC) AS l FROM stands GROUP BY ALL),
taken AS (SELECT source, row_id, list_reduce(l, lambda a, b: CASE WHEN b[1].s < a[-1].e THEN a ELSE list_concat(a, b) END) AS c FROM ordered),
anonymised AS (SELECT t.source, t.row_id, t.text AS before, CASE WHEN c IS NULL THEN t.text ELSE
    array_to_string(list_transform(range(1, len(c) + 1), lambda i: t.text[CASE WHEN i = 1 THEN 1 ELSE c[i - 1].e + 1 END:c[i].s] || c[i].new), '') || t.text[c[-1].e + 1:] END AS text
  FROM {texts} t LEFT JOIN taken k ON t.source = k.source AND t.row_id = k.row_id)"""


def plain(sql: str) -> str:
    return re.sub(r"\n\s*", "\n", sql)


MERGE_STRUCTURED = words(STRUCTURED_TYPES)
ALLOWED = words(ALLOWED_WORDS)
