import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from figmill.llm import quality, queries
from helpers import DOCS, documents, prose


def corpus(spark, count=500):
    rng = random.Random(4)
    texts, good = [], []
    for n in range(count):
        own = prose(n, rng.randint(20, 200)).split()
        good.append(int(n % 4 != 0))
        if not good[-1]:
            kind = n // 4 % 3
            own = (
                [w.upper() + "!!" for w in own] if kind == 0
                else [w + " |" for w in own] if kind == 1
                else [w for w in own[:5] for _ in range(12)]
            )
        texts.append(" ".join(own))
    labels = [(n, x, 0) for n, x in enumerate(good)]
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    fold = queries.fold(5)
    found = quality.score(docs, labels, fold != 0).filter(fold == 0).join(labels, "doc_id").collect()
    right = [(r["score"] >= 0.3) == bool(r["quality"]) for r in found]
    assert len(found) > 60 and np.mean(right) > 0.97


def test_word_vectors_against_a_loop(spark):
    texts = ["a b c! a", None, "", "c c b", "b"]
    index = quality.index_vectors()
    want = np.zeros((quality.ROWS, quality.SIZE))
    for text in texts:
        words, _ = quality.word_rows(pa.array([text], pa.string()))
        for n, word in enumerate(words):
            for m in range(max(0, n - quality.REACH), min(len(words), n + quality.REACH + 1)):
                if m != n:
                    want[word] += index[words[m]]
    want -= want.sum(0) / np.abs(want).sum() * np.abs(want).sum(1, keepdims=True)
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    found = quality.word_vectors(documents(spark, texts))
    assert np.allclose(found, want / np.maximum(norm, 1e-9), atol=1e-5)


def test_pool_of_each_text():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(quality.ROWS, quality.SIZE)).astype(np.float32)
    texts = ["one two, three", "", None, "same same same", "x"]
    found = quality.pool(pa.array(texts), table)
    for n, text in enumerate(texts):
        words, _ = quality.word_rows(pa.array([text], pa.string()))
        v = table[words].astype(float)
        if not len(v):
            assert not found[n].any()
            continue
        steps = np.abs(np.diff(v, axis=0))
        change = steps.mean(0) if len(steps) else np.zeros(quality.SIZE)
        assert np.allclose(found[n], np.concatenate((v.mean(0), v.std(0), change)), atol=1e-4)
    # Rounding apart, repeated words have neither spread nor change.
    assert np.abs(found[3, quality.SIZE :]).max() < 1e-3


def test_network_is_calibrated_and_survives_one_class():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 4))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    network = quality.Network(x, y)
    found = network.predict(x)
    for low in (0.0, 0.25, 0.5, 0.75):
        some = (found >= low) & (found < low + 0.25)
        assert abs(found[some].mean() - y[some].mean()) < 0.08
    assert quality.Network(x[:50], np.ones(50)).predict(x[:3]).tolist() == [1, 1, 1]
    assert quality.Network(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]


def test_odd_rows_and_empty_tables(spark):
    docs, labels = corpus(spark, 60)
    odd = documents(spark, [None, "", (None, "no id"), (1, "twice"), (1, "twice"), "w " * 5000])
    found = quality.score(docs.unionByName(odd).selectExpr("*", "1 AS score", "2 AS pooled"), labels, F.lit(True))
    rows = found.collect()
    assert len(rows) == 66 and all(0 <= r["score"] <= 1 for r in rows)
    blank = spark.createDataFrame([], DOCS)
    assert quality.score(blank, labels, F.lit(True)).count() == 0
    assert quality.score(docs, labels.filter("false"), F.lit(True)).first()["score"] == 0.5
