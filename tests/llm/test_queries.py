"""Contract of the queries, and their SQL where there is some."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from figmill.llm import queries

DATA = os.environ.get("FIGMILL_ORACLE_DATA", "/root/testdata/sf0.001")
COLUMNS = {
    "op2_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_simhash": "doc_id fingerprint component_id",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op7_quality": "doc_id held_out score predicted",
    "op8_extraction": "page_id url text n_chars",
    "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_language": "doc_id held_out lang_pred score",
}
TABLES = ("documents", "conversations", "embeddings")


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_row_count(spark, name):
    found = contract.queries()[name](spark, DATA)
    assert found.columns == COLUMNS[name].split()
    table = "pages" if name == "op8_extraction" else "documents"
    assert found.count() == queries.read(spark, DATA, table).count()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    found = queries.QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, found.select(columns).collect()))) == sorted(map(repr, result.fetchall()))


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*queries.QUERIES, "pipeline"} <= set(contract.queries())
