import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from figmill.llm import phrases, queries
from helpers import documents, lower, prose

COLUMNS = "lang rank phrase a l r n score".split()


def brute(rows, least, top=2000, longest=5):
    """Contract rows of ``(text, lang)`` by counting every phrase with Python integers."""
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {
            p[i:j]
            for p, a in candidates.items()
            for i in range(len(p))
            for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and f[p[i:j]] <= a
        }
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, _, l, r = min(
                    (1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))
                )
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def found(spark, rows, least, **kept):
    docs = documents(spark, []).unionByName(
        spark.createDataFrame(
            [(n, t, l, "src", 0) for n, (t, l) in enumerate(rows)], documents(spark, []).schema
        )
    )
    got = phrases.collocations(docs, least, **kept)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


def texts(seed, count, langs=("en", "de"), vocabulary=25):
    rng = random.Random(seed)
    marks = [" ", " ", " ", ", ", ". ", "\n", "\t", "  ", "; ", "!", " é "]
    out = []
    for n in range(count):
        words = prose(seed * 1000 + n, rng.randint(0, 60), vocabulary).split()
        out.append(("".join(w + rng.choice(marks) for w in words), rng.choice(langs)))
    return out


def test_against_brute_force(spark):
    rows = texts(1, 60) + [("Rare find today, rare find today", "en")] * 5
    assert found(spark, rows, 5) == brute(rows, 5)


def test_odd_rows(spark):
    rows = [(None, "en"), ("", "en"), (" .\t,", None), ("One two three", None), ("ONE two three", "und")]
    rows += [("a b a b a b a b", "en")] * 3 + [("a\tb. a b\x0ba b", "en")] + [("é b c é b c", "fr")] * 2
    assert found(spark, rows, 2) == brute(rows, 2)
    assert found(spark, [], 1) == [] == found(spark, [(None, None)], 1)


def test_small_budget_extends_hot_prefixes(spark, monkeypatch):
    """Prefixes over budget are extended down to whole suffixes, many groups are built."""
    monkeypatch.setattr(phrases, "BUDGET", 40)
    monkeypatch.setattr(phrases, "HELD", 200)
    monkeypatch.setattr(phrases, "SLICE", 2000)
    rows = texts(2, 80, ("en",), 8) + [("the same old story again and again, " * 20, "en")] * 4
    docs = documents(spark, [t for t, _ in rows])
    want = Counter()
    for text, _ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            for m in range(2, 6):
                want.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    words, counts = phrases.mined(docs, 10)
    names = {r["key"]: r["word"] for r in words.collect()}
    got = {tuple(names[k] for k in r["words"]): r["f"] for r in counts.collect()}
    assert got == {p: c for p, c in want.items() if c >= 10}
    assert found(spark, rows, 10) == brute(rows, 10)


def test_one_long_text_and_copies(spark):
    text = prose(5, 60000, 12)
    rows = [(text, "en")] + [("hot line of copies", "en")] * 300
    assert found(spark, rows, 100, top=50) == brute(rows, 100, top=50)


def test_limit_and_ties_by_bytes(spark):
    rows = [(f"{a} {b}", "en") for a, b in ("zz yy", "é à", "e a", "Z z", "aa bb")[0:0]]
    for pair in ("zz yy", "é à", "e a", "q z", "aa bb"):
        rows += [(pair, "en")] * 3
    assert found(spark, rows, 3, top=3) == brute(rows, 3, top=3)
    assert [r[2] for r in found(spark, rows, 3)] == ["aa bb", "e a", "q z", "zz yy", "é à"]


def test_products_beyond_64_bits(spark):
    """The score of made-up counts, through the same expression."""
    a, n = 10**12 + 7, 10**13 + 9
    exact = 1000 * a * n // (a * (a + 1))
    got = spark.range(1).select(
        F.expr(
            f"cast(1000 as decimal(4,0)) * (cast({a}L as decimal(17,0)) * cast({n}L as decimal(17,0)))"
            f" div (cast({a}L as decimal(19,0)) * cast({a + 1}L as decimal(19,0)))"
        )
    ).first()[0]
    assert got == exact


def test_subtrees_read_totals_from_leaves():
    words = np.array([[1, 2, 3], [1, 2, 0], [1, 2, 3], [4, 2, 0]], np.uint64)
    nodes = list(phrases.subtrees(words, np.array([2, 3, 4, 1]), 2))
    assert [(w.tolist(), t.tolist()) for w, t in nodes] == [([[1, 2]], [9]), ([[1, 2, 3]], [6])]


def test_groups_fill_up_to_the_budget(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUDGET", 100)
    keys = [k << 44 for k in range(50)]
    table = spark.createDataFrame([(k, 30) for k in keys], "key long, f long")
    groups = phrases._groups([table])
    own = groups[np.array(keys, np.uint64) >> np.uint64(64 - phrases.CELL_BITS)]
    assert (np.diff(own) >= 0).all() and np.bincount(own).max() * 30 <= 100 and own.max() == 16


@pytest.mark.parametrize("where", ["same", "other"])
def test_clashing_columns(spark, tmp_path, where, monkeypatch):
    rows = texts(3, 30)
    docs = spark.createDataFrame([(n, t, l) for n, (t, l) in enumerate(rows)], "doc_id long, text string, lang string")
    extra = ["key", "word", "f", "words", "part", "n"] if where == "same" else ["phrase", "a", "score", "rank"]
    docs = docs.select("*", *[F.lit("x").alias(c) for c in extra])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = phrases.collocations(queries.read(spark, str(tmp_path), "documents"), 4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4)
