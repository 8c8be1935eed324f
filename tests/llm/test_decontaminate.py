import random
import re

import numpy as np

from figmill.llm import decontaminate, queries
from helpers import documents, lower, prose


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(text))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def nearest(item, text):
    """Smallest distance of the item to any window, by one alignment with free ends."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return min(row)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(999)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"new{rng.randrange(999)}")
    return words


def planted():
    rng = random.Random(11)
    items = [prose(1000 + n, rng.randint(14, 60), 3000) for n in range(12)]
    items += ["", None, "just four words here", items[0]]
    texts = []
    for n in range(160):
        own = prose(n, 150, 3000).split()
        if n % 2:
            item = tokens(items[n % 12])
            at = rng.randrange(len(own))
            own[at:at] = edited(rng, item, rng.randint(0, int(0.2 * len(item))))
        texts.append(" ".join(own).title() + ".")
    texts += ["", None, items[3], items[4] * 3, "x " * 3000 + items[5] + " y" * 3000]
    return items, texts


def test_query_against_brute_force(spark, tmp_path):
    items, texts = planted()
    documents(spark, texts).selectExpr("*", "1 AS id", "2 AS item_id", "3 AS words").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    found = {(r["doc_id"], r["item_id"]): r for r in queries.op1_decontamination(spark, str(tmp_path)).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            own = tokens(item)
            if len(own) >= decontaminate.SHORTEST:
                cost = nearest(own, tokens(text))
                if cost <= decontaminate.allowed(len(own)):
                    want[d, i] = cost
    assert set(found) <= set(want)
    assert len(found) >= 0.99 * len(want)
    for key, row in found.items():
        assert row["distance"] == want[key]
        window = tokens(texts[key[0]])[row["first_word"] : row["first_word"] + row["n_words"]]
        assert distance(tokens(items[key[1]]), window) == row["distance"]
    assert {key for key, cost in want.items() if cost == 0} <= set(found)


def test_best_window_is_the_free_end_alignment():
    rng = random.Random(2)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randint(1, 9))]
        text = [rng.randrange(6) for _ in range(rng.randint(1, 20))]
        cost, begin, size = decontaminate.best_window(np.array(item), np.array(text))
        assert cost == nearest(item, text) == distance(item, text[begin : begin + size])


def test_clean_keeps_columns_and_rows_without_a_leak(spark):
    items, texts = planted()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, [(n, t) for n, t in enumerate(texts) if n % 2 == 0] + [(None, "a b")])
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(0, 160, 2)) <= set(ids) and None in ids
    assert not {162, 164} & set(ids)


def test_empty_tables(spark):
    docs = documents(spark, ["some text of five words"])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0
    one = spark.createDataFrame([(1, "some text of five words")], none.schema)
    assert decontaminate.leaks(docs.filter("false"), one).count() == 0
    assert decontaminate.leaks(docs, one).first()["distance"] == 0


def test_every_length_keeps_its_pair_bound():
    for number in {decontaminate.length_class(n) for n in range(5, 400)}:
        low, high = decontaminate.class_range(number, 400)
        for n in range(low, high + 1):
            assert decontaminate.needed_pairs(low, high) <= decontaminate.shared_pairs(n)


def test_spaced_replacements_at_the_threshold(spark):
    """Lengths at which one more edit is allowed, edits that break two pairs each."""
    rng = random.Random(5)
    items = [prose(600 + n, n, 3000) for n in (20, 30, 45)]
    texts = []
    for n in range(240):
        own = tokens(items[n % 3])
        for k in range(decontaminate.allowed(len(own))):
            own[5 * k + 1 + rng.randrange(3)] = f"new{rng.randrange(999)}"
        texts.append(f"{prose(n, 40, 3000)} {' '.join(own)} {prose(n + 999, 40, 3000)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, texts), bench).collect()}
    held = [sum((n, k) in found for n in range(k, 240, 3)) / 80 for k in range(3)]
    assert min(held) >= 0.96, held


def test_items_under_five_words_are_found_exactly(spark):
    items = ["Qxa", "qxb qxc", "qxd qxe qxf", "qxg qxh qxi qxj", "..."]
    texts = ["a QXA b qxa", "qxb z qxc qxb", "qxb, qxc! qxb qxc", "z qxd qxe qxf", "qxd qxe", "qxf z",
             "qxg qxh qxi qxj", "qxg qxh qxi", "qxa", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.leaks(documents(spark, texts).coalesce(1), bench).collect()
    found = {(r["id"], r["item_id"]): (r["first_word"], r["n_words"], r["distance"]) for r in rows}
    assert found == {(0, 0): (1, 1, 0), (2, 1): (0, 2, 0), (3, 2): (1, 3, 0), (6, 3): (0, 4, 0), (8, 0): (0, 1, 0)}


def test_clean_judges_rows_without_id(spark):
    item = prose(31, 30, 3000)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    docs = documents(spark, [(None, f"a b {item}"), (None, "other words"), (None, None), (7, "c d"), (8, item)])
    kept = decontaminate.clean(docs, bench).collect()
    assert sorted(str(r["text"]) for r in kept) == ["None", "c d", "other words"]
