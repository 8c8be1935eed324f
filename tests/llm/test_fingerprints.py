import hashlib

import numpy as np
import pyarrow as pa
import pytest

from figmill.llm import fingerprints, queries
from helpers import DOCS, documents, prose, shingles


def jaccard(a, b):
    a, b = set(shingles(a, 5)), set(shingles(b, 5))
    return len(a & b) / len(a | b) if a | b else 1.0


def estimated(texts):
    values, there = fingerprints.codes(pa.array(texts, pa.string()))
    return fingerprints.likeness(values[:-1], values[1:], there[:-1], there[1:])


def test_likeness_follows_jaccard_without_bias():
    texts = []
    for seed in range(60):
        own = prose(seed, 300).split()
        texts += [" ".join(own), " ".join(own[: 5 * seed]) + " " + prose(seed + 1000, 100)]
    errors = [
        e - jaccard(a, b) for e, a, b in zip(estimated(texts), texts, texts[1:], strict=False)
    ]
    assert abs(np.mean(errors)) < 0.006
    assert np.std(errors) < 0.04


def test_few_and_no_shingles():
    same = estimated(["one two", "ONE  two\n", "one three", "", None, " \t", "x"])
    assert same.tolist() == [1.0, pytest.approx(0.0, abs=0.1), 0.0, 1.0, 1.0, 0.0]


def test_fingerprint_is_packed_and_equal_for_equal_texts(spark):
    texts = [prose(1, 50), prose(1, 50), None, "a", prose(2, 5000)]
    docs = documents(spark, texts).selectExpr("*", "5 AS fingerprint")
    found = fingerprints.fingerprints(docs)
    rows = {r["doc_id"]: r["fingerprint"] for r in found.collect()}
    size = fingerprints.BINS * fingerprints.BITS // 4
    assert rows[0] == rows[1] and rows[2] == ""
    assert [len(rows[n]) for n in (0, 3, 4)] == [size] * 3
    assert fingerprints.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def brute(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    texts = [t for _, t in rows]
    out = []
    for n, (key, text) in enumerate(rows):
        after = texts[(n + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    jaccard(text, edited), jaccard(text, after)))
    return out


@pytest.mark.parametrize("count", [0, 1, 2, 90])
def test_query_against_brute_force(spark, tmp_path, count):
    rows = [(n * n * 7919 % 100003, prose(n // 2, 20 + 9 * (n % 13))) for n in range(count)]
    if count > 2:
        rows += [(None, "no id"), (None, None), (5, ""), (5, "é" * 9), (5, "é" * 9), (10**15, prose(3, 3000))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op2_fingerprints(spark, str(tmp_path)).collect()]
    want = brute(rows)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted((r[:3] for r in found), key=key) == sorted((w[:3] for w in want), key=key)
    for got, true in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        if got[1] > 400:
            assert got[5] == pytest.approx(true[3], abs=0.15)
            assert got[6] == pytest.approx(true[4], abs=0.15)
