"""Queries and their SQL on small tables of awkward rows."""

import duckdb
import pytest

from incognita.operators import vault as vaults
from incognita.plans.queries import ORACLES, QUERIES

#: Customers whose hash holds digits that are a card's, and others.
CUSTOMERS = [56861, 54653, 53917, 84413, 87869, 32221, *range(64)]
DOCUMENTS = [
    "to a%40b.corp.com or user%7C0123456789abcdef0123456789abcdef%7Cend", "100% of %zz and mail%2Fx@y.org%", "bad %ff%2egw7.corp.lan%e2%82 here", None, "",
    "key=10.0.0.1 10.0.0.10 x10.0.0.1y 10.0.0.1", "password: tiger%21cat tiger!cat",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    made = duckdb.connect()
    made.execute("CREATE TABLE customer AS SELECT unnest($1::BIGINT[]) AS c_custkey", [CUSTOMERS])
    made.execute("CREATE TABLE documents AS SELECT unnest(range(len($1::VARCHAR[])))::BIGINT AS doc_id, unnest($1::VARCHAR[]) AS text", [DOCUMENTS])
    made.execute(f"COPY (SELECT c_custkey, 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') AS c_name, (c_custkey % 25)::INT AS c_nationkey, 'AUTOMOBILE' AS c_mktsegment FROM customer) TO '{folder}/customer.parquet'")
    made.execute(f"COPY documents TO '{folder}/documents.parquet'")
    made.execute(f"COPY (SELECT doc_id AS page_id, text AS html FROM documents WHERE doc_id < 3) TO '{folder}/pages.parquet'")
    made.execute(f"COPY (SELECT c_custkey // 8 AS conv_id, (c_custkey % 8)::INT AS turn, CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, 'hello' AS text FROM customer) TO '{folder}/conversations.parquet'")
    return folder


def differences(spark, folder, name):
    read = duckdb.connect()
    for table in ("customer", "documents", "pages", "conversations"):
        read.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    want = read.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, folder).select(*names).collect()]
    return sorted(map(str, set(map(tuple, want.fetchall())) ^ set(got)))


@pytest.mark.parametrize("name", ["distinct_entities", "entity_filter", "anonymize_texts", "leak_check", "payload_anonymize"])
def test_query_and_sql_agree(spark, tables, name):
    assert differences(spark, tables, name) == []


@pytest.mark.parametrize("name", ["vault_build", "vault_collisions"])
def test_sql_has_all_rounds(name):
    assert f"won{vaults.ATTEMPTS - 1} AS" in ORACLES[name]


def test_rates_where_case_is_lost_for_good(spark, tmp_path):
    """A letter that has no upper case of its own in a URL's path, which surrogates keep, doesn't come back."""
    made = duckdb.connect()
    made.execute(f"COPY (SELECT 1::BIGINT AS doc_id, 'see https://shop.de/straße/a~b now and http://ex.com/x–y' AS text) TO '{tmp_path}/documents.parquet'")
    made.execute(f"COPY (SELECT 1::BIGINT AS page_id, NULL::VARCHAR AS html) TO '{tmp_path}/pages.parquet'")
    made.execute(f"COPY (SELECT 31::BIGINT AS c_custkey, 'Customer#31' AS c_name, 1 AS c_nationkey, 'AUTOMOBILE' AS c_mktsegment) TO '{tmp_path}/customer.parquet'")
    made.execute(f"COPY (SELECT 1::BIGINT AS conv_id, 1 AS turn, 'user' AS role, 'hello' AS text) TO '{tmp_path}/conversations.parquet'")
    assert differences(spark, str(tmp_path), "mangled_restore_rate") == []
    rates = {r.mangler: (r.n, r.tolerant_ok) for r in QUERIES["mangled_restore_rate"](spark, str(tmp_path)).collect()}
    assert rates["uppercase"][1] < rates["uppercase"][0] == rates["bold"][1]
