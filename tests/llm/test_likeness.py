import random

import numpy as np
from pyspark.sql import functions as F

from figmill.llm import likeness, simhash
from helpers import documents, prose, shingles


def alike(x, y):
    a, b = set(shingles(x, 5)), set(shingles(y, 5))
    return a == b or bool(a and b) and len(a & b) / len(a | b) >= likeness.LIKE


def brute_first(rows):
    """Ids that stay: the least of each group linked by likeness."""
    least = [i for i, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if alike(rows[a][1], rows[b][1])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return {i for (i, _), low in zip(rows, least) if i == low}


def copies(seed):
    """Texts, chains of copies of copies and stars of copies with a few replaced words each."""
    rng = random.Random(seed)
    rows = [(1000 + n, prose(seed * 999 + n, rng.randint(3, 150), 3000)) for n in range(40)]
    for n in range(120):
        chain = n % 2
        own = (rows[-1][1] if chain else rows[n % 6][1]).split()
        for _ in range(rng.randint(0, max(1, len(own) // 40))):
            own[rng.randrange(len(own))] = f"new{rng.randrange(9999)}"
        rows.append((500 + n if n % 3 else 3000 + n, " ".join(own)))
    return rows + [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two")]


def test_first_of_groups_against_brute_force(spark):
    for seed in (1, 2):
        rows = copies(seed)
        kept = simhash.first_of_groups(documents(spark, rows).repartition(3))
        assert {r["doc_id"] for r in kept.collect()} == brute_first(rows)


def test_near_copies_beyond_two_bits_go(spark):
    """A 300-word text and copies with five replaced words: likeness 0.85, many bits apart."""
    own, rows = prose(77, 300, 3000).split(), []
    rows.append((0, " ".join(own)))
    for n in range(1, 12):
        other = list(own)
        for k in range(5):
            other[20 + 50 * k + n] = f"new{n}{k}"
        rows.append((n, " ".join(other)))
    prints = {r["id"]: r["fingerprint"] for r in simhash.fingerprints(documents(spark, rows)).collect()}
    mask = (1 << 64) - 1
    assert max(((prints[0] ^ prints[n]) & mask).bit_count() for n in range(1, 12)) > 2
    kept = simhash.first_of_groups(documents(spark, rows + [(None, rows[0][1])])).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["0", "None"]


def test_rows_of_one_id(spark):
    """Other texts of one id are other documents; the same text again is not."""
    one, two, three = (prose(n, 60, 3000) for n in (1, 2, 3))
    rows = [(1, one), (1, two), (1, one), (2, three), (5, two), (0, one + " end"), (None, one), (None, one)]
    kept = simhash.first_of_groups(documents(spark, rows))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(
        map(str, [(0, one + " end"), (1, two), (2, three), (None, one), (None, one)])
    )


def test_form_letters_are_not_compared_in_pairs(spark):
    """Letters that share most words but are not alike: none goes, and few pairs are verified."""
    base, rows = prose(5, 200, 3000).split(), []
    for n in range(150):
        own = list(base)
        for k in range(7):
            own[14 + 28 * k] = f"own{n}x{k}"
        rows.append((n, " ".join(own)))
    docs = documents(spark, rows)
    assert simhash.first_of_groups(docs).count() == 150
    classes = likeness.marked(docs).select("*", F.col("id").alias("node"), F.col("id").alias("name")).cache()
    buckets = classes.select(F.explode("keys").alias("key"), "node", F.col("node").alias("root"))
    assert buckets.groupBy("key").count().filter("count > 50").count() > 0
    assert likeness._stray_pairs(buckets, classes, docs, "doc_id", "text").count() < 150


def test_stray_pairs_lose_no_alike_pair(spark):
    rows = [(n, t) for n, (_, t) in enumerate(copies(3)) if t]
    docs = documents(spark, rows)
    classes = likeness.marked(docs).select("*", F.col("id").alias("node"), F.col("id").alias("name")).cache()
    buckets = classes.select(F.lit(1).alias("key"), "node", F.col("node").alias("root"))
    found = {tuple(r) for r in likeness._stray_pairs(buckets, classes, docs, "doc_id", "text").collect()}
    want = {(i, j) for a, (i, x) in enumerate(rows) for j, y in rows[:a] if alike(x, y)}
    assert want and want <= found


def test_recall_at_the_threshold(spark):
    """Pairs of likeness 0.8 to 0.83 beside a group of hundreds of copies of one text."""
    rng, rows, pairs = random.Random(12), [], 0
    base = prose(1, 120, 5000).split()
    rows += [(n, " ".join(base[:-1] + [f"tail{n}"])) for n in range(300)]
    at = 1000
    while pairs < 60:
        own = prose(at, 200, 5000).split()
        other = list(own)
        for k in range(4):
            other[20 + 50 * k + rng.randrange(20)] = f"x{at}{k}"
        a, b = set(shingles(" ".join(own), 5)), set(shingles(" ".join(other), 5))
        if 0.8 <= len(a & b) / len(a | b) <= 0.83:
            rows += [(at, " ".join(own)), (at + 1, " ".join(other))]
            pairs += 1
        at += 2
    kept = {r["doc_id"] for r in simhash.first_of_groups(documents(spark, rows).repartition(5)).collect()}
    assert {n for n in kept if n < 1000} == {0}
    assert sum(n % 2 for n in kept if n >= 1000) <= 0.1 * pairs


def test_candidates_come_from_simhash(spark):
    """Near copies are linked through fingerprints within the radius, and not beside them."""
    own = prose(77, 300, 3000).split()
    rows = [(0, " ".join(own))]
    for n in range(1, 6):
        rows.append((n, " ".join(own[: 50 * n] + [f"new{n}"] + own[50 * n :])))
    docs = documents(spark, rows)
    roots = {
        radius: likeness.groups(docs, simhash.components, radius=radius).select("root").distinct().count()
        for radius in (0, likeness.RADIUS)
    }
    assert roots == {0: 6, likeness.RADIUS: 1}


def test_tables_find_the_pairs_at_the_threshold():
    """Fingerprints of 2J / (1 + J) common direction, in tables for many classes."""
    rng = np.random.default_rng(5)
    drawn = likeness.tables(100_000)
    found = 0
    for n in range(300):
        values = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        sets = [values[:180], values[20:]]  # 160 of 200 are common
        bits = simhash.set_fingerprints(sets)
        apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        meet = ((bits[0] ^ bits[1]) & drawn == 0).all(1).any()
        found += meet and apart <= likeness.RADIUS
    assert found >= 290


def test_group_of_unlike_copies_gives_few_rows(spark, monkeypatch):
    """Copies of one text of which few pairs are alike, their sets in many blocks: groups as by
    brute force, and rows in proportion to the copies."""
    rng, base = random.Random(9), prose(4, 150, 3000).split()
    rows = []
    for n in range(260):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"new{n}x{rng.randrange(9999)}"
        rows.append((n, " ".join(own)))
    docs = documents(spark, rows).repartition(3)
    monkeypatch.setattr(likeness, "ROOM", 4000)
    kept = simhash.first_of_groups(docs)
    assert {r["doc_id"] for r in kept.collect()} == brute_first(rows)
    marked = likeness.marked(docs).select("*", F.col("id").alias("node"))
    trees = likeness._tree_pairs(marked.select("node", "n", "high", "low", F.explode("keys").alias("key")))
    assert 200 < trees.count() < 260


def test_large_bucket_stays_one_tree(spark):
    size = likeness.BLOCK + 100
    rows = spark.range(size).selectExpr(
        "id AS node", "1L AS key", "9L AS n", "xxhash64(id) AS high", "xxhash64(id, 1) AS low"
    )
    trees = likeness._tree_pairs(rows).collect()
    assert len({r["key"] for r in trees}) == 1
    assert {r["a"] for r in trees} | {r["b"] for r in trees} == set(range(size))
