"""Queries against their SQL oracles on the smallest tables.

``FIGMILL_ORACLES=all`` compares every query; the default is one per area.
"""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as contract
from figmill.plans.catalog import QUERIES
from figmill.plans.oracles import ORACLES

DATA = os.environ.get("FIGMILL_ORACLE_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAMPLE = (
    "a5_split_positions", "a7_shard_manifest", "a8_shard_lookup", "a9_dataset_manifest",
    "b4_candidate_funnel", "c11_cleaned", "c17_primitives", "d6_encoded", "d9_predicted_markup",
    "d16_grammar_audit", "e2_deduplicated_by_block", "e8_banded_split", "e11_curriculum_draws",
    "g9_procedural_corpus", "g10_grammar_scopes", "m1_corpus_bleu", "m2_letter_edit_distance",
    "m7_graph_edit_distance", "m14_ssim", "h2_diagnostics_report", "h8_best_epochs",
    "i3_resized", "i8_augmented", "s1_incremental_curation",
)
NAMES = sorted(ORACLES) if os.environ.get("FIGMILL_ORACLES") == "all" else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    return 0.0 if value == 0 and isinstance(value, float) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(row[i]) for i in order]) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    frame = contract.queries()[name](spark, DATA)
    result = duck.execute(contract.oracle_sql()[name])
    expected = table([d[0] for d in result.description], result.fetchall())
    assert table(frame.columns, frame.collect()) == expected


def test_contract(spark):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(QUERIES) == set(ORACLES)
    assert contract.entry(spark).count() > 0
