import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from figmill.llm.filters import hash_sample
from figmill.llm.batches import SPACES, flat, gather, row_sums, run_hashes, runs, shingles, slices

TEXTS = st.lists(st.one_of(st.none(), st.text("ab é\n\t", max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_runs_are_the_words_of_each_row(texts):
    data, offsets = flat(pa.array(texts, pa.string()))
    starts, ends, rows = runs(~SPACES[data], offsets)
    found = [
        [bytes(data[starts[k] : ends[k]]).decode() for k in range(rows[n], rows[n + 1])]
        for n in range(len(texts))
    ]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_hashes_depend_on_the_word_alone():
    long = "x" * 200
    data, offsets = flat(pa.array(["one two " + long, None, "", "two " + long + " one"]))
    starts, ends, rows = runs(~SPACES[data], offsets)
    h = run_hashes(data, starts, ends)
    assert rows.tolist() == [0, 3, 3, 3, 6]
    assert len(set(h.tolist())) == 3
    assert (h[0], h[1], h[2]) == (h[5], h[3], h[4])


def test_shingles_of_short_rows():
    hashes = np.arange(1, 8, dtype=np.uint64)
    found, places = shingles(hashes, np.array([0, 0, 2, 7]), 3)
    assert places.tolist() == [0, 0, 1, 4]
    assert len(set(found.tolist())) == 4


def test_slices_keep_all_rows_and_bound_their_bytes():
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["a" * n for n in (5, 50, 0, 7, 100, 1)])], names=["text"]
    )
    parts = list(slices([batch, batch.slice(0, 0)], "text", 60))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert [p.num_rows for p in parts] == [3, 1, 1, 1]


def test_gather_and_row_sums():
    assert gather(np.arange(10), np.array([7, 0, 3]), np.array([2, 0, 3])).tolist() == [7, 8, 3, 4, 5]
    assert row_sums(np.array([1, 2, 3]), np.array([0, 0, 2, 3])).tolist() == [0, 3, 3]


def test_hash_sample_is_bounded_and_fixed(spark):
    """The same rows for any number of partitions; repeated rows count once."""
    rows = spark.range(3000).selectExpr("id % 1000 AS id", "id % 7 AS v", "array(id % 5) AS a")
    distinct = rows.distinct().count()
    few = [hash_sample(rows.repartition(n), 200) for n in (1, 9)]
    assert [len(f) for f in few] == [200, 200]
    assert few[0]["id"].tolist() == few[1]["id"].tolist() and len(set(few[0]["id"])) > 100
    assert len(hash_sample(rows, 10**6)) == distinct and len(hash_sample(rows.limit(0), 5)) == 0
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")  # arrays come as lists then
    try:
        plain = hash_sample(rows, 200)
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert plain["id"].tolist() == few[0]["id"].tolist() and [*map(list, plain["a"])] == [*map(list, few[0]["a"])]
