import random

import numpy as np
import pytest
import xxhash

from figmill.llm import queries, simhash
from helpers import DOCS, documents, prose, shingles


def brute_fingerprint(text):
    own = shingles(text, 3)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(own))


def brute_components(rows):
    """Smallest reachable id of each ``(id, fingerprint)`` row."""
    least = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(rows):
            for b, (_, y) in enumerate(rows):
                if (x ^ y).bit_count() <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_fingerprint_of_texts(spark):
    texts = ["", None, "One", "one TWO", "a b c", "É b\tc  d\n", prose(3, 200), "x " * 50]
    found = {r["id"]: r["fingerprint"] for r in simhash.fingerprints(documents(spark, texts)).collect()}
    for n, text in enumerate(texts):
        assert found[n] & (1 << 64) - 1 == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(3))
def test_close_pairs_by_planes(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 16, 300).astype(np.uint16) & np.uint16(0x0F3F)
    bucket = np.sort(rng.integers(0, 9, 300))
    found = set()
    for left, right in simhash.close_pairs(values, bucket):
        found |= set(zip(left.tolist(), right.tolist()))
    assert found == {
        (i, j)
        for i in range(300)
        for j in range(i + 1, 300)
        if bucket[i] == bucket[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 2
    }


@pytest.mark.parametrize(("size", "radius"), [(700, 34), (300, 50), (64, 2), (300, 0), (2, 5)])
def test_wide_pairs_by_planes(size, radius):
    rng = np.random.default_rng(size)
    bits = rng.integers(0, 1 << 63, (8, 2), dtype=np.uint64)[rng.integers(0, 8, size)]
    bits ^= np.packbits(rng.random((size, 128)) < 0.12, axis=1).view(np.uint64)
    found = [p for left, right in simhash.wide_pairs(bits, radius) for p in zip(left.tolist(), right.tolist())]
    apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2)
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, j in zip(*np.nonzero(apart <= radius)) if i < j}


def test_links_reach_every_pair_within_two_bits(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            prints.add(at)
            for _ in range(rng.randint(0, 3)):
                at ^= 1 << rng.randrange(64)
    rows = list(enumerate(sorted(prints, key=lambda p: p * 7919 % 104729)))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    classes = spark.createDataFrame(signed, "name long, fingerprint long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes)).collect()}
    assert [roots.get(i, i) for i, _ in rows] == brute_components(rows)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(n + 1, n) for n in range(1, 40)] + [(100 + n, 99) for n in range(1, 20)]
    found = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    roots = {r["node"]: r["root"] for r in found.collect()}
    assert all(roots.get(n, n) == 1 for n in range(1, 41))
    assert all(roots.get(100 + n, 0) == 99 for n in range(1, 20))


def test_near_duplicates_of_odd_rows(spark):
    text = prose(9, 120)
    rows = [(7, text), (3, text), (3, text), (None, text), (8, ""), (5, None), (9, prose(8, 90))]
    found = [(r["id"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(
        [(7, 3), (3, 3), (3, 3), (None, 3), (8, 5), (5, 5), (9, 9)], key=str
    )


def test_one_document_of_each_group_stays(spark):
    text = prose(9, 120)
    docs = documents(spark, [(7, text), (3, text), (3, text), (None, text), (9, prose(8, 90))])
    docs = docs.selectExpr("*", "'x' AS id", "1 AS fingerprint", "2 AS component_id")
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [
        (False, 3), (False, 9), (True, None),
    ]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    texts = [prose(n % 12, 30 + n % 7) for n in range(40)] + ["", None, "a b"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(n, brute_fingerprint(t)) for n, t in enumerate(texts)]
    least = brute_components(rows)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, str(tmp_path)).collect()}
    assert found == {n: (f"{p:016x}", least[n]) for n, p in rows}
