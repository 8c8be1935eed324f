import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from figmill.llm import queries, topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, divisor, k=5):
    """Contract rows by Python integers."""
    kept = [
        (n, i, [math.floor(256 * x) for x in v])
        for n, (i, v, *_) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, q in kept:
        if i is None or i % divisor:
            continue
        scored = [(-sum(a * b for a, b in zip(q, w)), j is None, j) for m, j, w in kept if m != n]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(spark, rows, divisor=3, k=5):
    vectors = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    got = topk.top_k(vectors, F.col("id") % divisor == 0, k)
    return sorted(map(tuple, got.collect()), key=repr)


def table(seed, count, width, zeros=0.0, spread=1.0):
    rng = random.Random(seed)
    return [
        (n, [0.0 if rng.random() < zeros else rng.gauss(0, spread) for _ in range(width)], 0)
        for n in range(count)
    ]


@pytest.mark.parametrize("zeros", [0.0, 0.5, 0.95])
def test_against_brute_force(spark, zeros):
    rows = table(1, 300, 20, zeros)
    assert found(spark, rows) == brute(rows, 3)


def test_several_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_WEIGHTS", 600)
    monkeypatch.setattr(topk, "ROW_CHUNK", 7)
    monkeypatch.setattr(topk, "QUERY_CHUNK", 3)
    rows = table(2, 260, 12, 0.3)
    assert found(spark, rows) == brute(rows, 3)


def test_ties_go_to_the_smaller_id_and_copies_count(spark):
    rows = [(n, [1.0, float(n % 2)], 0) for n in range(12)] + [(3, [1.0, 1.0], 0)] * 3
    rows += [(None, [1.0, 1.0], 0), (None, [4.0, 4.0], 0)]
    assert found(spark, rows) == brute(rows, 3)


def test_rows_that_take_no_part(spark):
    rows = table(3, 20, 4)
    rows += [(30, None, 0), (33, [None, 1.0], 0), (36, [math.nan], 0), (39, [math.inf, 1.0], 0)]
    rows += [(42, [], 0), (45, [1.0], 0), (48, [1.0, -2.0, 3.0, 4.0, 5.0, 6.0], 0)]
    assert found(spark, rows) == brute(rows, 3)


def test_sums_beyond_32_bits_are_exact(spark):
    rows = table(4, 60, 8, spread=1e6)
    assert max(abs(r[3]) for r in brute(rows, 3)) > 1 << 40
    assert found(spark, rows) == brute(rows, 3)


def test_fewer_rows_than_asked_for_and_none(spark):
    assert found(spark, table(5, 3, 4)) == brute(table(5, 3, 4), 3)
    assert found(spark, [(0, [1.0], 0)]) == []
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == []
    assert found(spark, []) == []


def test_one_id_holds_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_WEIGHTS", 400)
    rows = table(6, 200, 6) + [(9, v, 0) for _, v, _ in table(7, 100, 6)]
    assert found(spark, rows) == brute(rows, 3)


def test_scatter_of_sparse_lists():
    rng = np.random.default_rng(1)
    q = rng.integers(-5, 5, (30, 9)) * (rng.random((30, 9)) < 0.2)
    r = rng.integers(-5, 5, (50, 9)) * (rng.random((50, 9)) < 0.2)
    listed = [{t: (np.flatnonzero(m[:, t]), m[np.flatnonzero(m[:, t]), t]) for t in range(9)} for m in (q, r)]
    assert (topk.accumulated(*listed, (30, 50), np.int64) == q @ r.T).all()


def test_clashing_columns(spark, tmp_path):
    rows = table(8, 120, 5)
    extra = ["id", "weights", "row", "asks", "score", "q", "r", "line"]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in extra])
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_topk(spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 50)
