import hashlib
import random
from collections import defaultdict
from zlib import crc32

from pyspark.sql import functions as F

from figmill.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    """Contract rows by a trie in memory."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    members, ends, kids = defaultdict(set), defaultdict(list), defaultdict(set)
    for c in own:
        h = crc32(str(c).encode()) % 6
        base = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        seq = tuple(base[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
        ends[seq].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        size = len(node[-1][1]) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[k] for k in kids[node])
    return sorted(
        (
            (
                min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n],
                saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest(),
            )
            for n, m in members.items()
        ),
        key=repr,
    )


def found(spark, rows, tmp_path, *extra):
    df = spark.createDataFrame(rows, SCHEMA).select("*", *extra)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


def table(seed, ids, longest=9, words=3):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, "user" if t % 2 else "bot", "é" * rng.randrange(words) + rng.choice("ab")))
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = table(1, range(0, 420, 2), words=2)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = table(2, [*range(-130, -90, 3), 7, 100, 101, 203], longest=4)
    rows += [(None, 0, "user", "lost"), (301, None, "user", "first"), (301, -5, "bot", "second")]
    rows += [(301, 2, None, None), (302, 0, None, None), (302, 1, "", ""), (303, 0, "", None)]
    rows += [(400, 0, "user", "same"), (400, 0, "user", "same"), (400, 1, "user", "x" * 70000)]
    rows += [(c, 0, "a", "only") for c in range(500, 530)]  # mostly turnless when rebuilt
    assert found(spark, rows, tmp_path) == brute(rows)


def test_order_of_tied_turns_does_not_depend_on_the_input(spark, tmp_path):
    rows = [(5, 0, "user", t) for t in "abcdefgh"] + table(3, [1, 2])
    one = found(spark, rows, tmp_path / "one")
    assert one == found(spark, rows[::-1], tmp_path / "two")


def test_no_conversations(spark, tmp_path):
    assert found(spark, [], tmp_path / "none") == []
    assert found(spark, [(None, 0, "user", "x")], tmp_path / "null") == []


def test_long_and_equal_conversations(spark, tmp_path, monkeypatch):
    """Chains over several blocks of places, and parents that are joined apart."""
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    monkeypatch.setattr(trie, "HOT", 3)
    long = [(c, t, "user", "same" if t < 60 + c else f"{c}-{t}") for c in (0, 1, 2) for t in range(90)]
    equal = [(c, t, "user", str(t)) for c in range(1000, 1300) for t in range(7)]
    rows = long + equal + table(4, range(3, 60))
    assert found(spark, rows, tmp_path) == brute(rows)


def test_clashing_columns(spark, tmp_path):
    rows = table(5, range(40))
    names = ["depth", "high", "low", "position", "one", "own", "kept", "base", "n_chars", "block"]
    extra = [F.lit("x").alias(n) for n in names]
    assert found(spark, rows, tmp_path, *extra) == brute(rows)


def test_contraction_of_trees(spark):
    """A chain, a star, a random tree and a comb side by side."""
    rng, size = random.Random(6), 200
    shapes = [lambda n: n - 1, lambda n: 0, lambda n: rng.randrange(n), lambda n: n - 1 if n % 2 else max(0, n - 2)]
    rows, want = [], {}
    for shape, up in enumerate(shapes):
        first = 1000 * shape
        parent = [None, *[up(n) for n in range(1, size)]]
        depth = [0]
        for n in range(1, size):
            depth.append(depth[parent[n]] + 1)
        weight = [rng.randrange(100) for _ in range(size)]
        total = weight[:]
        for n in range(size - 1, 0, -1):
            total[parent[n]] += total[n]
        rows += [
            (first + n, depth[n], None if n == 0 else first + parent[n], parent.count(n), weight[n])
            for n in range(size)
        ]
        want |= {first + n: t for n, t in enumerate(total)}
    tree = spark.createDataFrame(rows, "conv_id long, depth long, parent_conv_id long, n_children long, w long")
    assert {r["conv_id"]: r["w"] for r in trie.contracted(tree, ["w"]).collect()} == want


def test_general_interface_without_regrafting(spark):
    rows = [(1, 0, "u", "hello"), (1, 1, "b", "hi"), (2, 0, "u", "hello"), (2, 1, "b", "no")]
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    got = trie.prefix_trie(turns, turns.select("conv_id").distinct()).drop("ends_sha256")
    assert sorted(map(tuple, got.collect())) == [
        (1, 0, None, 2, 1, 2, 5), (1, 1, 1, 2, 2, 2, 5), (1, 2, 1, 1, 0, 1, 0), (2, 2, 1, 1, 0, 1, 0),
    ]
