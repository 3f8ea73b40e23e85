"""Queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.functions import surrogates as sg
from incognita.functions.rules import CARD, RULES, Rule
from incognita.functions.spans import rule_values
from incognita.functions.text import HYPHENS, NOISE, ZERO_WIDTH, chunks, model_type, scope_type
from incognita.operators import audit, detectors, payload, vault as vaults
from incognita.operators.entities import claimed_spans, entity_counts, floor_entities, keep_entity, known_entities, merged_types, scope_entities, without_wrappers
from incognita.operators.replace import anonymized
from incognita.operators.restore import MANGLERS, mangled, restored, restored_exactly
from incognita.plans import oracles as sql
from incognita.sources.corpus import append_vault, parse_scope, read_vault, save_look_up_tables, texts, tool_lines, write_export_csv
from incognita.sources.shared import cut, new_path
from incognita.streaming.byte_lines import byte_lines
from incognita.streaming.mint import mint_batch, minting, read_minted
from incognita.streaming.restore import restored_events, restored_stream
from incognita.streaming.slots import slots_for

Query = Callable[[SparkSession, str], DataFrame]
ENGAGEMENT = "acme-2024"
KEYS = ("source", "row_id")
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Types that the rules give to the tables' texts and tool lines.
KINDS = sorted({r.entity_type for r in [CARD, *RULES]})


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- detection -----------------------------------------------------------------------------------------------------------

def _detect(rule: Rule) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = texts(spark, sf_dir).select(*KEYS, F.explode(rule_values(F.col("text"), rule)).alias("value"))
        return found.groupBy(*KEYS, "value").agg(F.count("*").alias("n"))

    return query


for _rule in [CARD, *RULES]:
    _add(f"detect_{_rule.name}", _detect(_rule), sql.rule_matches(_rule))

_add("claimed_entities", lambda spark, d: claimed_spans(texts(spark, d), *KEYS), sql.CLAIMED)
_add("distinct_entities", lambda spark, d: floor_entities(texts(spark, d), *KEYS), f"WITH {sql.FOUND} SELECT * FROM found")
_add(
    "entity_counts_by_type",
    lambda spark, d: entity_counts(claimed_spans(texts(spark, d), *KEYS)),
    f"SELECT entity_type, count(*) AS n, count(DISTINCT value) AS n_distinct FROM ({sql.CLAIMED}) GROUP BY 1",
)

#: Scope entries from the tables: market segments and regions as organisations, each customer's host, some networks.
SCOPE_SQL = r"""SELECT c_mktsegment || '=organization' AS value FROM {customer} GROUP BY c_mktsegment
UNION ALL SELECT ' ' || r_name || ' = Organization ' FROM {region}
UNION ALL SELECT 'srv' || CAST(c_custkey AS STRING) || '.corp.local' FROM {customer}
UNION ALL SELECT '# ' || n_name FROM {nation} WHERE n_nationkey < 5
UNION ALL SELECT '10.' || CAST(n_nationkey AS STRING) || '.0.0/16' FROM {nation} WHERE n_nationkey < 3
UNION ALL SELECT n_name FROM {nation} WHERE n_nationkey >= 5"""


def _scope(spark: SparkSession, d: str) -> DataFrame:
    return parse_scope(spark.sql(SCOPE_SQL, **{t: _table(spark, d, t) for t in ("customer", "region", "nation")}))


SCOPE_TYPES = rf"""SELECT value, CASE WHEN named <> '' THEN named
  WHEN regexp_matches(value, '^(?:\d{{1,3}}\.){{3}}\d{{1,3}}/\d{{1,2}}$') THEN 'CIDR' WHEN regexp_matches(value, '^(?:\d{{1,3}}\.){{3}}\d{{1,3}}$') THEN 'IP_ADDRESS'
  WHEN contains(value, '@') THEN 'EMAIL_ADDRESS' WHEN regexp_matches(value, '\.[a-zA-Z]{{2,}}$') THEN 'DOMAIN' WHEN contains(value, ' ') THEN 'ORGANIZATION' ELSE 'HOSTNAME' END AS entity_type
FROM (SELECT CASE WHEN contains(v, '=') THEN trim(split_part(v, '=', 1)) ELSE v END AS value, CASE WHEN contains(v, '=') THEN upper(trim(split_part(v, '=', 2))) ELSE '' END AS named
  FROM (SELECT trim(value) AS v FROM ({SCOPE_SQL.format(customer="customer", region="region", nation="nation")})) WHERE v <> '' AND NOT starts_with(v, '#'))"""
_add("scope_types", _scope, SCOPE_TYPES)
_add(
    "scope_matches",
    lambda spark, d: scope_entities(tool_lines(spark, d), _scope(spark, d), *KEYS),
    rf"""WITH scope AS ({SCOPE_TYPES}), t AS (SELECT * FROM ({sql.TOOL})),
hits AS (SELECT source, row_id, scope.value AS term, entity_type, unnest(regexp_extract_all(text, '(?i)(?:^|[^\w@-])(' || regexp_escape(scope.value) || ')(?:$|\.$|\.[^\w-]|[^\w.-])', 1)) AS value
  FROM t JOIN scope ON contains(lower(text), lower(scope.value)))
SELECT source, row_id, value, min_by(entity_type, (length(term), term)) AS entity_type FROM hits GROUP BY ALL""",
)
_add(
    "text_chunks",
    lambda spark, d: _table(spark, d, "documents").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("k", "chunk")).select("doc_id", F.col("k").cast("long").alias("k"), F.md5("chunk").alias("chunk_md5")),
    """SELECT doc_id, k, md5(CASE WHEN length(text) <= 1500 THEN text ELSE substr(text, k * 1300 + 1, 1500) END) AS chunk_md5
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 1500 THEN 1 ELSE (length(text) - 1) // 1300 + 1 END)) AS k FROM documents)""",
)


# --- merging and filtering: a contextual finder that takes whole tokens with a mark in them --------------------------------


def _context(spark: SparkSession, d: str) -> DataFrame:
    found = tool_lines(spark, d).select(*KEYS, F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"([^ \t\n\r\f]*[=@:.][^ \t\n\r\f]*|[A-Z][a-z]+|ok|up|nmap)"), 1)).alias("value"))
    return found.distinct().select(*KEYS, "value", model_type(F.col("value")).alias("entity_type"))


CONTEXT = rf"""context AS (SELECT DISTINCT source, row_id, value,
  CASE WHEN contains(value, '@') AND contains(value, '.') THEN 'EMAIL_ADDRESS' WHEN regexp_matches(value, '^(?:\d{{1,3}}\.){{3}}\d{{1,3}}$') THEN 'IP_ADDRESS'
    WHEN contains(value, '\') OR regexp_matches(lower(value), '^[a-z]+\.[a-z]+$') THEN 'USERNAME'
    WHEN regexp_matches(lower(value), '[.](?:local|corp|com|net|org|lan)$') THEN 'DOMAIN' WHEN contains(value, ' ') THEN 'PERSON' ELSE 'OTHER' END AS entity_type
  FROM (SELECT source, row_id, unnest(regexp_extract_all(text, '([^ \t\n\r\f]*[=@:.][^ \t\n\r\f]*|[A-Z][a-z]+|ok|up|nmap)', 1)) AS value FROM texts WHERE source = 'tool'))"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    floor = floor_entities(tool_lines(spark, d), *KEYS).withColumns({"chain": F.lit(0), "is_floor": F.lit(True)})
    context = _context(spark, d).withColumns({"chain": F.lit(1), "is_floor": F.lit(False)})
    return merged_types(floor.unionByName(context), *KEYS)


MERGED = f"""{sql.FOUND}, {CONTEXT}, merged AS (SELECT coalesce(f.source, c.source) AS source, coalesce(f.row_id, c.row_id) AS row_id, coalesce(f.value, c.value) AS value,
  CASE WHEN f.entity_type IS NULL OR (c.entity_type IS NOT NULL AND f.entity_type NOT IN ({sql.MERGE_STRUCTURED})) THEN c.entity_type ELSE f.entity_type END AS entity_type, f.value IS NOT NULL AS is_floor
  FROM (SELECT * FROM found WHERE source = 'tool') f FULL JOIN context c ON f.source = c.source AND f.row_id = c.row_id AND f.value = c.value)"""
_add("type_precedence", _merged, f"WITH {MERGED} SELECT * FROM merged")
_add(
    "wrapper_dedup",
    lambda spark, d: without_wrappers(_merged(spark, d), *KEYS),
    rf"""WITH {MERGED} SELECT * FROM merged m WHERE is_floor OR NOT EXISTS (SELECT 1 FROM merged i WHERE i.is_floor AND length(i.value) >= 6 AND i.source = m.source AND i.row_id = m.row_id
  AND i.value <> m.value AND contains(m.value, i.value) AND regexp_full_match(substr(m.value, 1, strpos(m.value, i.value) - 1) || substr(m.value, strpos(m.value, i.value) + length(i.value)), '[\w.\-]{{0,24}}\s*["'']?\s*[:=]?\s*["'']?'))""",
)
_add(
    "entity_filter",
    lambda spark, d: _merged(spark, d).where(keep_entity(F.col("value"), F.col("is_floor"))),
    f"""WITH {MERGED} SELECT * FROM merged WHERE is_floor OR NOT (length(value) < 4 OR lower(value) IN ({sql.ALLOWED}))""",
)


def _whole_tokens(text: str) -> list[tuple[str, str]]:
    """A contextual detector: tokens between blanks that hold a mark. It breaks at lines without secrets."""
    if text.startswith("nothing"):
        raise ValueError("a detector's own fault")
    return [(t, "USERNAME" if "\\" in t else "OTHER") for t in text.split(" ") if any(c in t for c in "=@\\")]


def _chain(spark: SparkSession, d: str) -> DataFrame:
    detectors.register("tokens", detectors.from_function(_whole_tokens))
    return detectors.detected(tool_lines(spark, d), ["tokens", "no such", "REGEX", "tokens"], *KEYS, scope=_scope(spark, d))


_add(
    "detector_chain",
    _chain,
    rf"""WITH {sql.FOUND}, scope AS ({SCOPE_TYPES}), tool AS (SELECT * FROM texts WHERE source = 'tool'),
seen AS (SELECT source, row_id, scope.value AS term, entity_type, unnest(regexp_extract_all(text, '(?i)(?:^|[^\w@-])(' || regexp_escape(scope.value) || ')(?:$|\.$|\.[^\w-]|[^\w.-])', 1)) AS value FROM tool JOIN scope ON contains(lower(text), lower(scope.value))),
s AS (SELECT source, row_id, value, min_by(entity_type, (length(term), term)) AS t FROM seen GROUP BY ALL),
f AS (SELECT source, row_id, value, entity_type AS t FROM found WHERE source = 'tool'),
c AS (SELECT DISTINCT source, row_id, value, CASE WHEN contains(value, '\') THEN 'USERNAME' ELSE 'OTHER' END AS t FROM (SELECT source, row_id, unnest(string_split(text, ' ')) AS value FROM tool WHERE NOT starts_with(text, 'nothing')) WHERE contains(value, '=') OR contains(value, '@') OR contains(value, '\')),
k AS (SELECT source, row_id, value FROM f UNION SELECT source, row_id, value FROM s UNION SELECT source, row_id, value FROM c),
m AS (SELECT k.*, CASE WHEN c.t IS NOT NULL AND coalesce(s.t, f.t, '') NOT IN ({sql.MERGE_STRUCTURED}) THEN c.t ELSE coalesce(s.t, f.t) END AS entity_type, f.value IS NOT NULL OR s.value IS NOT NULL AS is_floor
  FROM k LEFT JOIN f ON f.source = k.source AND f.row_id = k.row_id AND f.value = k.value LEFT JOIN s ON s.source = k.source AND s.row_id = k.row_id AND s.value = k.value LEFT JOIN c ON c.source = k.source AND c.row_id = k.row_id AND c.value = k.value)
SELECT source, row_id, value, entity_type, is_floor FROM m WHERE (is_floor OR NOT EXISTS (SELECT 1 FROM m i WHERE i.is_floor AND length(i.value) >= 6 AND i.source = m.source AND i.row_id = m.row_id AND i.value <> m.value AND contains(m.value, i.value)
  AND regexp_full_match(substr(m.value, 1, strpos(m.value, i.value) - 1) || substr(m.value, strpos(m.value, i.value) + length(i.value)), '[\w.\-]{{0,24}}\s*["'']?\s*[:=]?\s*["'']?')))
  AND (is_floor OR NOT (length(value) < 4 OR lower(value) IN ({sql.ALLOWED})))""",
)


def _lateral(spark: SparkSession, d: str) -> DataFrame:
    """The contextual detector as a table function, joined laterally in SQL."""
    detectors.register_udtf(spark, "whole_tokens", _whole_tokens)
    return spark.sql("SELECT t.source, t.row_id, f.value, f.entity_type, count(*) AS n FROM {t} t, LATERAL whole_tokens(t.text) f GROUP BY ALL", t=texts(spark, d))


_add(
    "lateral_detector",
    _lateral,
    rf"""WITH {sql.TEXTS} SELECT source, row_id, value, CASE WHEN contains(value, '\') THEN 'USERNAME' ELSE 'OTHER' END AS entity_type, count(*) AS n
FROM (SELECT source, row_id, unnest(string_split(text, ' ')) AS value FROM texts WHERE NOT starts_with(text, 'nothing')) WHERE contains(value, '=') OR contains(value, '@') OR contains(value, '\') GROUP BY ALL""",
)


def _model_output(spark: SparkSession, d: str) -> DataFrame:
    """What a model may answer about a customer, in each of the shapes that are understood."""
    item = F.to_json(F.struct(F.col("c_name").alias("text"), F.lit("PERSON").alias("type")))
    other = F.to_json(F.struct(F.col("c_mktsegment").alias("value"), F.lit("ORGANIZATION").alias("entity_type")))
    both = F.concat(F.lit("["), item, F.lit(", "), other, F.lit("]"))
    shape = F.col("c_custkey") % 5
    raw = F.when(shape == 0, both).when(shape == 1, F.concat(F.lit('{"entities": '), both, F.lit("}"))).when(shape == 2, item).when(shape == 3, F.concat(F.lit("Here they are:\n"), both, F.lit(" as asked"))).otherwise("I found none.")
    return payload.parse_model_output(_table(spark, d, "customer").select("c_custkey", raw.alias("raw")), "c_custkey")


_add(
    "model_output",
    _model_output,
    "SELECT c_custkey, c_name AS value, 'PERSON' AS entity_type FROM customer WHERE c_custkey % 5 <> 4 UNION ALL SELECT c_custkey, c_mktsegment, 'ORGANIZATION' FROM customer WHERE c_custkey % 5 IN (0, 1, 3)",
)


# --- surrogates ----------------------------------------------------------------------------------------------------------

def _surrogates(kind: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        originals = spark.sql(f"SELECT DISTINCT {_spark(sql.ORIGINALS[kind])} AS original FROM {{customer}}", customer=_table(spark, d, "customer"))
        return originals.select("original", sg.surrogate(F.lit(kind), F.col("original"), ENGAGEMENT).alias("surrogate"))

    return query


def _spark(text: str) -> str:
    """SQL for Spark: a backslash in a literal is doubled."""
    return text.replace("\\", "\\\\")


for _kind in sg.TYPES:
    _add(f"surrogate_{_kind.lower()}", _surrogates(_kind), sql.surrogate_query(_kind, ENGAGEMENT))


# --- vault ---------------------------------------------------------------------------------------------------------------

def _found(spark: SparkSession, d: str) -> DataFrame:
    """Entities of all the tables' texts."""
    return floor_entities(texts(spark, d), *KEYS)


def _vault(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = cut(_found(spark, d), "found")
    return found, cut(vaults.mint(found.select("value", "entity_type").distinct(), None, ENGAGEMENT), "vault")


VAULT = f"""{sql.FOUND}, wanted AS (SELECT DISTINCT value AS original, entity_type FROM found), {sql.vault_ctes("wanted", ENGAGEMENT, 4, KINDS, vaults.ATTEMPTS - 4)}"""
_add("vault_build", lambda spark, d: _vault(spark, d)[1], f"WITH {VAULT} SELECT * FROM vault")
_add("vault_export", lambda spark, d: vaults.export(_vault(spark, d)[1]), f"WITH {VAULT} SELECT original, entity_type, surrogate FROM vault")
_add("vault_stats", lambda spark, d: vaults.stats(_vault(spark, d)[1]), f"WITH {VAULT} SELECT entity_type, count(*) AS n FROM vault GROUP BY ROLLUP (entity_type)")


#: A network for each customer: three compatible surrogates for all of them, so that most meet in the wider spaces.
NETWORKS_SQL = "SELECT '10.' || CAST(c_custkey % 250 AS STRING) || '.' || CAST(CAST(floor(c_custkey / 250) AS BIGINT) % 250 AS STRING) || '.' || CAST(CAST(floor(c_custkey / 62500) AS BIGINT) AS STRING) || '/24' AS value, 'CIDR' AS entity_type FROM {customer}"
_add(
    "vault_collisions",
    lambda spark, d: vaults.mint(spark.sql(NETWORKS_SQL, customer=_table(spark, d, "customer")), None, ENGAGEMENT),
    f"WITH networks AS (SELECT value AS original, entity_type FROM ({NETWORKS_SQL.format(customer='customer')})), {sql.vault_ctes('networks', ENGAGEMENT, vaults.ATTEMPTS, ['CIDR'])} SELECT * FROM vault",
)


def _looked_up(spark: SparkSession, d: str) -> DataFrame:
    """Each text's values with their surrogates, looked up and back in tables bucketed for either way."""
    found, vault = _vault(spark, d)
    folder = new_path(spark, "look-up")
    by_original, by_surrogate = save_look_up_tables(vault, f"vault_{folder.rsplit('-', 1)[-1]}", folder)
    there = vaults.look_up(found.select(*KEYS, "value"), spark.table(by_original))
    return vaults.look_up(there.withColumnRenamed("surrogate", "s"), spark.table(by_surrogate), "s", "surrogate").select(*KEYS, "value", F.col("s").alias("surrogate"), F.col("original").alias("back"))


_add("vault_look_up", _looked_up, f"WITH {VAULT} SELECT source, row_id, value, surrogate, original AS back FROM found LEFT JOIN vault ON original = value")
_add("vault_mappings", lambda spark, d: vaults.mappings(_vault(spark, d)[1]), f"WITH {VAULT} SELECT surrogate, original FROM vault")
_add("vault_originals", lambda spark, d: vaults.known_originals(_vault(spark, d)[1]), f"WITH {VAULT} SELECT original, entity_type FROM vault")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The vault of two engagements written as a table, and one of them read back."""
    path, vault = new_path(spark, "vault-table"), _vault(spark, d)[1]
    append_vault(vaults.as_rows(vault, ENGAGEMENT), path)
    append_vault(vaults.as_rows(vault.where("entity_type = 'HASH'"), "other"), path)
    return read_vault(spark, path, ENGAGEMENT).select("engagement", "original", "norm", "entity_type", "surrogate", F.col("created_at").isNotNull().alias("is_dated"))


def _exported(spark: SparkSession, d: str) -> DataFrame:
    """The vault's export written as CSV and read back."""
    path = new_path(spark, "export-csv")
    write_export_csv(vaults.export(_vault(spark, d)[1]), path)
    return spark.read.schema("original string, entity_type string, surrogate string").csv(path, header=True, escape='"', multiLine=True)


_add("vault_round_trip", _stored, f"WITH {VAULT} SELECT '{ENGAGEMENT}' AS engagement, original, lower(original) AS norm, entity_type, surrogate, true AS is_dated FROM vault")
_add("vault_export_csv", _exported, f"WITH {VAULT} SELECT original, entity_type, surrogate FROM vault")
_add(
    "rescan_known",
    lambda spark, d: known_entities(texts(spark, d), _vault(spark, d)[1], *KEYS),
    f"WITH {VAULT} SELECT source, row_id, original AS value, entity_type FROM texts JOIN vault ON contains(text, original)",
)


# --- replacement and restoration -----------------------------------------------------------------------------------------

def _anonymised(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    found, vault = _vault(spark, d)
    before = texts(spark, d)
    return before, found, vault, cut(anonymized(before, found, vault, *KEYS), "anonymised")


# A value that only stands inside a longer word is detected, but not replaced.
BOUNDED = r"""regexp_matches({text}, CASE WHEN regexp_matches({value}, '^\w') THEN '(?:^|[^\w]|%[0-9a-fA-F]{{2}})' ELSE '' END || regexp_escape({value}) || CASE WHEN regexp_matches({value}, '\w$') THEN '(?:$|[^\w])' ELSE '' END)"""
ANONYMISED = f"{VAULT}, {sql.anonymised()}"
_add(
    "anonymize_texts",
    lambda spark, d: _anonymised(spark, d)[3].select(*KEYS, F.md5("text").alias("text_md5")),
    f"WITH {ANONYMISED} SELECT source, row_id, md5(text) AS text_md5 FROM anonymised",
)


def _restore_texts(spark: SparkSession, d: str) -> DataFrame:
    _, _, vault, after = _anonymised(spark, d)
    return restored(after, vault, *KEYS).select(*KEYS, F.md5("text").alias("text_md5"))


_add("restore_texts", _restore_texts, f"WITH {sql.TEXTS} SELECT source, row_id, md5(text) AS text_md5 FROM texts")


def _checks(spark: SparkSession, d: str) -> DataFrame:
    before, found, vault, after = _anonymised(spark, d)
    bad = audit.leaks(after, found, *KEYS).groupBy(*KEYS).agg(F.count("*").alias("n_leaks"))
    secrets = found.groupBy(*KEYS).agg(F.count("*").alias("n_secrets"))
    whole = audit.roundtrip(before, restored(after, vault, *KEYS), *KEYS)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.join(secrets, list(KEYS), "left").join(bad, list(KEYS), "left").select(*KEYS, zero("n_secrets"), zero("n_leaks"), "roundtrip_ok")


CHECKS = f"WITH {sql.FOUND} SELECT t.source, t.row_id, count(f.value) AS n_secrets, coalesce(sum((NOT {BOUNDED.format(text='t.text', value='f.value')})::INT), 0)::BIGINT AS n_leaks, true AS roundtrip_ok FROM texts t LEFT JOIN found f ON t.source = f.source AND t.row_id = f.row_id GROUP BY ALL"
_add("roundtrip_check", _checks, CHECKS)
_add(
    "leak_check",
    lambda spark, d: (lambda s: audit.leaks(s[3], s[1], *KEYS))(_anonymised(spark, d)),
    f"WITH {ANONYMISED} SELECT f.source, f.row_id, f.value FROM found f JOIN anonymised a ON a.source = f.source AND a.row_id = f.row_id WHERE contains(a.text, f.value)",
)
_add("verify_report", lambda spark, d: audit.report(_checks(spark, d)), f"SELECT count(*) AS n_texts, sum(n_secrets)::BIGINT AS n_secrets, sum(n_leaks)::BIGINT AS n_leaks, 0::BIGINT AS n_broken, sum(n_leaks) = 0 AS passed FROM ({CHECKS})")
_add(
    "echo_probe",
    lambda spark, d: (lambda s: audit.echo_leaks(s[3], s[1], *KEYS))(_anonymised(spark, d)),
    f"WITH {ANONYMISED} SELECT DISTINCT value FROM found WHERE EXISTS (SELECT 1 FROM anonymised WHERE contains(text, value))",
)


def _mangled(spark: SparkSession, d: str) -> DataFrame:
    """Rates at which rewritten surrogates of the texts' vault come back, naive and tolerant."""
    vault = _vault(spark, d)[1]
    echoes = None
    for name in MANGLERS:
        one = vault.select(F.lit(name).alias("mangler"), F.col("original").alias("wanted"), "surrogate", mangled(F.col("surrogate"), name).alias("text"))
        echoes = one if echoes is None else echoes.unionAll(one)
    echoes = cut(echoes, "echoes")
    pair = F.array(F.struct("surrogate", F.col("wanted").alias("original")))
    after = restored(echoes.select("mangler", "wanted", "text"), vault, "mangler", "wanted").withColumnRenamed("text", "back")
    both = echoes.withColumn("naive", restored_exactly(F.col("text"), pair)).join(after, ["mangler", "wanted"])
    rate = lambda c: F.sum(F.contains(F.col(c), F.col("wanted")).cast("long"))
    return both.groupBy("mangler").agg(F.count("*").alias("n"), rate("naive").alias("naive_ok"), rate("back").alias("tolerant_ok"))


_MANGLED_SQL = {
    "verbatim": "s", "bold": "'**' || s || '**'", "inline_code": "'`' || s || '`'", "italic": "'*' || s || '*'", "uppercase": "upper(s)", "lowercase": "lower(s)",
    "underscored": "'_' || s || '_'", "in_sentence": "'the value ' || s || ' here'", "intra_code": "CASE WHEN length(s) > 4 THEN '`' || s[1:4] || '`' || s[5:] ELSE '`' || s || '`' END",
    "nbsp_hyphen": "replace(s, '-', chr(8209))", "bold_segment": "CASE WHEN contains(s, '.') THEN s[1:strpos(s, '.') - 1] || '**.**' || s[strpos(s, '.') + 1:] ELSE '**' || s || '**' END",
}
#: The tolerant form (functions/text.py, projected). An echo comes back if its form holds its surrogate's; letters beyond ASCII keep their case.
_FORM_SQL = f"""translate(regexp_replace(regexp_replace({{}}, '[{NOISE}{ZERO_WIDTH}]', '', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{{{{85}}}}\\pZ]+', ' ', 'g'), '{HYPHENS}ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{"-" * len(HYPHENS)}abcdefghijklmnopqrstuvwxyz')"""
_add(
    "mangled_restore_rate",
    _mangled,
    f"WITH {VAULT}, v AS (SELECT original, surrogate AS s FROM vault) "
    + " UNION ALL ".join(f"SELECT '{m}' AS mangler, count(*) AS n, sum(contains(replace({e}, s, original), original)::INT)::BIGINT AS naive_ok, sum((contains({_FORM_SQL.format(e)}, {_FORM_SQL.format('s')}) OR contains({e}, original))::INT)::BIGINT AS tolerant_ok FROM v" for m, e in _MANGLED_SQL.items()),
)


# --- payloads ------------------------------------------------------------------------------------------------------------

def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Chat requests whose turns quote tool lines: turn t of conversation c quotes the line of customer (8 c + t)."""
    lines = tool_lines(spark, d).select("row_id", F.col("text").alias("line"))
    turns = _table(spark, d, "conversations").withColumn("row_id", F.col("conv_id") * 8 + F.col("turn"))
    # Lines are far larger than the table that they are made from, by whose size Spark would send them whole to every task.
    quoted = turns.join(lines.hint("merge"), "row_id", "left").withColumn("text", F.concat_ws("\n", "text", "line"))
    return payload.requests(quoted.select("conv_id", "turn", "role", "text"))


def _payloads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    asked = cut(_requests(spark, d), "requests")
    leaves = cut(payload.leaves(asked, "conv_id"), "leaves")
    found = cut(floor_entities(leaves, "conv_id", "path"), "found")
    vault = cut(vaults.mint(found.select("value", "entity_type").distinct(), None, ENGAGEMENT), "vault")
    changed = cut(anonymized(leaves, found, vault, "conv_id", "path"), "changed")
    return asked, found, vault, cut(payload.with_leaves(asked, changed, "conv_id"), "sent")


TURNS = f"""turns AS (SELECT conv_id, turn, role, concat_ws(chr(10), c.text, l.text) AS text FROM conversations c LEFT JOIN ({sql.TOOL}) l ON l.row_id = c.conv_id * 8 + c.turn)"""


def _payload_leaks(spark: SparkSession, d: str) -> DataFrame:
    asked, found, vault, sent = _payloads(spark, d)
    outside = payload.leaves(sent, "conv_id")
    known = found.groupBy("conv_id").agg(F.countDistinct("value").alias("n_secrets"))
    bad = audit.leaks(outside, found, "conv_id", "path").groupBy("conv_id").agg(F.count("*").alias("n_leaks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return asked.join(known, "conv_id", "left").join(bad, "conv_id", "left").select("conv_id", zero("n_secrets"), zero("n_leaks"))


_add(
    "payload_anonymize",
    _payload_leaks,
    f"""WITH {TURNS}, texts AS (SELECT 'conv' AS source, conv_id * 100 + turn AS row_id, text FROM turns), {sql.found()},
wanted AS (SELECT DISTINCT value AS original, entity_type FROM found), {sql.vault_ctes("wanted", ENGAGEMENT, 4, KINDS, vaults.ATTEMPTS - 4)}, {sql.anonymised()},
f AS (SELECT k.row_id // 100 AS conv_id, value, contains(a.text, value) AS leaks FROM found k JOIN anonymised a ON a.row_id = k.row_id)
SELECT c.conv_id, count(DISTINCT value) AS n_secrets, coalesce(sum(leaks::INT), 0)::BIGINT AS n_leaks FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id = c.conv_id GROUP BY ALL""",
)


def _payload_restore(spark: SparkSession, d: str) -> DataFrame:
    asked, _, vault, sent = _payloads(spark, d)
    back = restored(payload.leaves(sent, "conv_id", whole=True), vault, "conv_id", "path")
    after = payload.leaves(payload.with_leaves(sent, back, "conv_id", whole=True), "conv_id")
    return after.groupBy("conv_id").agg(F.count("*").alias("n_leaves"), F.sum(F.length("text")).alias("n_chars"), F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("text"))), "")).alias("texts_md5"))


_add(
    "payload_restore",
    _payload_restore,
    f"WITH {TURNS} SELECT conv_id, count(*) AS n_leaves, sum(length(text))::BIGINT AS n_chars, md5(string_agg(md5(text), '' ORDER BY md5(text))) AS texts_md5 FROM turns GROUP BY 1",
)

# --- audit ---------------------------------------------------------------------------------------------------------------

_add("audit_search", lambda spark, d: audit.search(_vault(spark, d)[1], "CORP", "DOMAIN"), f"WITH {VAULT} SELECT original, entity_type, surrogate FROM vault WHERE entity_type = 'DOMAIN' AND contains(lower(original || surrogate || entity_type), 'corp')")
_add("audit_types", lambda spark, d: audit.types(_vault(spark, d)[1]), f"WITH {VAULT} SELECT DISTINCT entity_type FROM vault")
_add("audit_sorted", lambda spark, d: audit.sorted_by(_vault(spark, d)[1], "surrogate", True), f"WITH {VAULT} SELECT original, entity_type, surrogate FROM vault")


# --- streaming -----------------------------------------------------------------------------------------------------------

#: Characters in one delta of the streamed texts; files in which each part of a stream comes at least, and rows of one beyond.
DELTA, STREAM_FILES, FILE_ROWS = 7, 4, 250_000


def _source(rows: DataFrame, folder: str, parts: tuple[int, ...]) -> tuple[int, int]:
    """Writes rows (of columns stream and seq) as the files of a stream, part after part in this order. Files a part, and slots for the streams."""
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col("seq") == 0).alias("streams")).first()
    files = max(STREAM_FILES, size["n"] // len(parts) // FILE_ROWS)
    for part in parts:
        rows.where(F.pmod(F.col("seq"), F.lit(len(parts))) == part).repartition(files, "stream").write.mode("append").parquet(folder)
    return files, slots_for(size["streams"], size["n"])


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Tool lines, anonymised and cut into deltas that reach the query in several micro-batches out of order."""
    lines = tool_lines(spark, d)
    found = cut(floor_entities(lines, *KEYS), "found")
    vault = cut(vaults.mint(found.select("value", "entity_type").distinct(), None, ENGAGEMENT), "vault")
    # Each stream's own mappings: those of the values found in its line.
    own = cut(found.join(vault.withColumnRenamed("original", "value"), "value").select(F.col("row_id").cast("string").alias("stream"), "surrogate", F.col("value").alias("original")), "own")
    sent = anonymized(lines, found, vault, *KEYS)
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(DELTA))
    deltas = sent.select(F.col("row_id").cast("string").alias("stream"), F.lit(0).alias("block"), "text", F.posexplode(starts).alias("k", "at"))
    deltas = deltas.select("stream", "block", F.col("k").cast("long").alias("seq"), F.substring("text", F.col("at") + 1, F.lit(DELTA)).alias("delta"), (F.col("at") + DELTA >= F.length("text")).alias("is_end"))
    deltas = cut(deltas, "all-deltas")
    source, sink, marks = (new_path(spark, name) for name in ("deltas", "restored", "marks"))
    files, slots = _source(deltas, source, (2, 0, 3, 1))  # later parts first
    stream = spark.readStream.schema(deltas.schema).option("maxFilesPerTrigger", 2 * files).parquet(source)
    query = restored_stream(stream, own, linger_ms=0, slots=slots).writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    pieces = spark.read.schema("stream string, block int, seq long, text string").parquet(sink)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "")
    return pieces.groupBy("stream").agg(F.md5(whole).alias("text_md5"))


_add("stream_restore", _stream, f"SELECT CAST(row_id AS VARCHAR) AS stream, md5(text) AS text_md5 FROM ({sql.TOOL})")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Tool lines, anonymised, as the answers of a chat server: event lines of two formats (by row), with comments and events that
    hold no text between them, restored in one streaming query; what each line's text came out as, and its other lines."""
    lines = tool_lines(spark, d)
    found = cut(floor_entities(lines, *KEYS), "found")
    vault = cut(vaults.mint(found.select("value", "entity_type").distinct(), None, ENGAGEMENT), "vault")
    own = cut(found.join(vault.withColumnRenamed("original", "value"), "value").select(F.col("row_id").cast("string").alias("stream"), "surrogate", F.col("value").alias("original")), "own")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(DELTA)), lambda i: F.substring(F.col("text"), i + 1, F.lit(DELTA)))
    event = lambda body: F.concat(F.lit("data: "), F.to_json(body))
    first = lambda piece: event(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), piece.alias("text")).alias("delta")))
    second = lambda piece: event(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(piece.alias("content")).alias("delta"))).alias("choices")))
    stop = event(F.struct(F.lit("content_block_stop").alias("type"), F.lit(0).alias("index")))
    is_first = F.col("row_id") % 2 == 0
    whole = F.concat(F.array(F.lit(": ping"), F.lit("event: start")), F.transform(cuts, lambda p: F.when(is_first, first(p)).otherwise(second(p))), F.when(is_first, F.array(stop, F.lit("data: no json"))).otherwise(F.array(F.lit(""), F.lit("data: [DONE]"))))
    sent = anonymized(lines, found, vault, *KEYS).select(F.col("row_id").cast("string").alias("stream"), F.posexplode(whole).alias("seq", "line")).withColumn("seq", F.col("seq").cast("long"))
    sent = cut(sent, "all-events")
    source, sink, marks = (new_path(spark, name) for name in ("events", "restored-events", "marks"))
    files, slots = _source(sent, source, (2, 0, 1))
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", files).parquet(source)
    query = restored_events(stream, own, slots=slots).writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema("stream string, seq long, part int, line string").parquet(sink)
    data = F.expr("substr(line, 7)")
    text = F.coalesce(F.get_json_object(data, "$.delta.text"), F.get_json_object(data, "$.choices[0].delta.content"))
    placed = out.select("stream", F.struct("seq", "part", text.alias("text"), "line").alias("p")).groupBy("stream").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    joined = lambda keep, field: F.array_join(F.transform(F.filter("ps", keep), lambda p: p[field]), "" if field == "text" else "\n")
    return placed.select("stream", F.md5(joined(lambda p: p["text"].isNotNull(), "text")).alias("text_md5"), joined(lambda p: p["text"].isNull(), "line").alias("other_lines"))


_add(
    "stream_events",
    _events,
    f"""SELECT CAST(row_id AS VARCHAR) AS stream, md5(text) AS text_md5, ': ping' || chr(10) || 'event: start' || chr(10) ||
  CASE WHEN row_id % 2 = 0 THEN 'data: {{"type":"content_block_stop","index":0}}' || chr(10) || 'data: no json' ELSE chr(10) || 'data: [DONE]' END AS other_lines FROM ({sql.TOOL})""",
)


#: Bytes in one chunk of the streamed documents: a number that cuts characters, too.
CHUNK = 997


def _byte_lines(spark: SparkSession, d: str) -> DataFrame:
    """All documents as streams of bytes that are cut anywhere and come out of order, read back as lines."""
    source = _table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("stream"), F.encode("text", "UTF-8").alias("raw"))
    starts = F.sequence(F.lit(0), F.length("raw") - 1, F.lit(CHUNK))
    chunks_ = source.select("stream", "raw", F.posexplode(starts).alias("k", "at"))
    chunks_ = cut(chunks_.select("stream", F.col("k").cast("long").alias("seq"), F.substring("raw", F.col("at") + 1, F.lit(CHUNK)).alias("chunk"), (F.col("at") + CHUNK >= F.length("raw")).alias("is_end")), "all-chunks")
    folder, sink, marks = (new_path(spark, name) for name in ("chunks", "lines", "marks"))
    files, slots = _source(chunks_, folder, (1, 2, 0))
    stream = spark.readStream.schema(chunks_.schema).option("maxFilesPerTrigger", files).parquet(folder)
    byte_lines(stream, slots).writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    lines = spark.read.schema("stream string, seq long, line string").parquet(sink)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda p: p["line"]), "\n")
    return lines.groupBy("stream").agg(F.count("*").alias("n_lines"), F.md5(whole).alias("lines_md5"))


_add(
    "stream_byte_lines",
    _byte_lines,
    """SELECT CAST(doc_id AS VARCHAR) AS stream, len(string_split(t, chr(10))) AS n_lines, md5(t) AS lines_md5
FROM (SELECT doc_id, CASE WHEN suffix(text, chr(10)) THEN text[:-2] ELSE text END AS t FROM documents WHERE text <> '')""",
)


def _minted_in_a_stream(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all texts minted micro-batch by micro-batch, where the first try of a batch breaks off after its write and is replayed. Types of small spaces
    are left out: which original gets a surrogate that two want depends on the order of batches there."""
    found = cut(_found(spark, d).where("entity_type NOT IN ('IP_ADDRESS', 'CIDR')").select("value", "entity_type"), "findings")
    source, table, marks = (new_path(spark, name) for name in ("findings", "minted", "marks"))
    for part in range(2):
        found.where(F.pmod(F.xxhash64("value"), F.lit(2)) == part).coalesce(STREAM_FILES).write.mode("append").parquet(source)
    write, broken = mint_batch(table, ENGAGEMENT), []

    def once_broken(batch: DataFrame, number: int) -> None:
        write(batch, number)
        if number == 1 and not broken:
            broken.append(number)
            raise RuntimeError("broken off")

    for _ in range(2):
        query = minting(spark.readStream.schema(found.schema).option("maxFilesPerTrigger", STREAM_FILES).parquet(source), table, marks, ENGAGEMENT, once_broken)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not broken:
                raise
    return read_minted(spark, table).select("original", "entity_type", "surrogate")


_add(
    "vault_streamed",
    _minted_in_a_stream,
    f"WITH {sql.FOUND}, wanted AS (SELECT DISTINCT value AS original, entity_type FROM found WHERE entity_type NOT IN ('IP_ADDRESS', 'CIDR')), {sql.vault_ctes('wanted', ENGAGEMENT, 3, [k for k in KINDS if k not in ('IP_ADDRESS', 'CIDR')])} SELECT * FROM vault",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect, map, replace and restore all texts: per row its secrets, leaks and whether it came back whole."""
    return _checks(spark, sf_dir)
