import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from figmill.llm import queries, toxicity as t
from helpers import DOCS, documents, prose

RUDE = ["grumbok", "vexlout", "snarfle"]


def corpus(spark, count=400):
    rng = random.Random(6)
    texts, toxic = [], []
    for n in range(count):
        own = prose(n, rng.randint(20, 120)).split()
        toxic.append(int(n % 5 == 0))
        if toxic[-1]:
            for _ in range(max(1, len(own) // 40)):
                own.insert(rng.randrange(len(own)), rng.choice(RUDE) + rng.choice(["", "er", "ing"]))
        texts.append(" ".join(own))
    labels = [(n, 1, x) for n, x in enumerate(toxic)]
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


class Brute:
    """The same model on plain dictionaries, without slots."""

    def __init__(self, labelled, everything):
        self.top = [Counter(), Counter()]
        for text, label in labelled:
            self.top[label].update(g for w in text.split() for g in self.grams(w))
        pool = Counter(g for text in everything for w in text.split() for g in self.grams(w))
        self.levels = {t.ORDER: self.top}
        shared = set(pool)
        for order in range(t.ORDER - 1, t.SHARED, -1):
            self.levels[order] = [
                Counter(g[1:] for g in self.levels[order + 1][c]) for c in (0, 1)
            ]
            shared = {g[1:] for g in shared}
        self.pairs = Counter(g[1:] for g in shared)
        self.single = Counter(g[1:] for g in self.pairs)

    @staticmethod
    def grams(word):
        line = (None,) * (t.ORDER - 2) + ("_", *word, "_")
        return [line[k : k + t.ORDER] for k in range(len(word) + 1)]

    def chance(self, gram, label):
        total = sum(self.single.values())
        one = max(self.single[gram[-1:]] - t.DISCOUNT, 0) / total
        one += t.DISCOUNT * len(self.single) / total / (1 << t.SYMBOL_BITS)
        p = self.mixed(self.pairs, gram[-2:], one)
        for order in range(t.SHARED + 1, t.ORDER + 1):
            p = self.mixed(self.levels[order][label], gram[-order:], p)
        return p

    @staticmethod
    def mixed(counts, gram, lower):
        after = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not after:
            return lower
        total = sum(after)
        return max(counts[gram] - t.DISCOUNT, 0) / total + t.DISCOUNT * len(after) / total * lower


def test_evidence_of_every_word_equals_plain_kneser_ney(spark):
    texts = [("abba cab", 0), ("cab bad abba", 1), ("dab", 1), ("bad bad cad", 0), ("abba", 0)]
    docs = documents(spark, [x for x, _ in texts] + ["ace fade"])
    labels = spark.createDataFrame([(n, x) for n, (_, x) in enumerate(texts)], "doc_id long, toxic int")
    model = t.fit(docs, docs.join(labels, "doc_id"))
    brute = Brute(texts, [x for x, _ in texts] + ["ace fade"])
    for word in ("abba", "cab", "fade", "zzz", "ba", "dabbad"):
        _, _, grams, _ = t.word_grams([word])
        want = [math.log(brute.chance(g, 1)) - math.log(brute.chance(g, 0)) for g in Brute.grams(word)]
        assert model.evidence(grams) == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    part = queries.fold(4)
    classifier = t.train(docs, labels, counted=part.isin(0, 1), curve=part == 3)
    found = t.score(docs, classifier).filter(part == 2).join(labels, "doc_id").collect()
    right = [(r["score"] >= 0.3) == bool(r["toxic"]) for r in found]
    assert len(found) > 60 and np.mean(right) > 0.97


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = corpus(spark, 120)
    part = queries.fold(4)
    turned = labels.withColumn("toxic", F.when(part == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (queries.toxicity_classifier(docs, x) for x in (labels, turned))
    assert (a.slope, a.start) == (b.slope, b.start)


def test_odd_rows_and_missing_classes(spark):
    docs = documents(spark, [None, "", "12 !!", "plain words", (None, "no id"), (3, "plain words")])
    docs = docs.selectExpr("*", "1 AS score", "2 AS evidence", "3 AS toxic", "4 AS kind")
    for rows in ([], [(3, 0)], [(3, None), (99, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        found = t.score(docs, t.train(docs, labels, F.lit(True), F.lit(True)))
        values = [r["score"] for r in found.collect()]
        assert len(values) == 6 and all(0 <= v < 0.3 for v in values)
    blank = spark.createDataFrame([], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.score(blank, t.train(blank, none, F.lit(True), F.lit(True))).count() == 0


def test_word_grams_pack_each_letter_with_its_past():
    number, rows, grams, places = t.word_grams(["ab, ab", "", "b"])
    assert number.tolist() == [0, 0, 1] and rows.tolist() == [0, 2, 2, 3] and places.tolist() == [0, 3, 5]
    a, b, edge = ord("a"), ord("b"), t.GAP
    pack = lambda *s: sum(x << t.SYMBOL_BITS * k for k, x in enumerate(s[::-1]))
    assert grams.tolist() == [
        pack(edge, a), pack(edge, a, b), pack(edge, a, b, edge), pack(edge, b), pack(edge, b, edge),
    ]
