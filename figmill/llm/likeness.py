"""Near copies by the likeness of their five-word shingles, found by SimHash.

Two texts are linked when the Jaccard likeness of their shingle sets is at least ``LIKE``. Equal
sets are one class. Every class has a fingerprint of ``simhash.WIDE`` bits; at the threshold two of
them differ in 15 % of their bits on average, so pairs within ``RADIUS`` bits are candidates (0.9998
of the pairs at the threshold, more of the more alike). They meet in tables of sampled bits: a key
has as many bits as leave about ``CELL`` classes to a bucket, and there are as many tables as find
``RECALL`` of the pairs at the threshold. All fingerprints of a bucket are compared by bit planes.

No group's pairs are listed. A bucket gives a spanning forest of its close pairs, nearest first, and
whole sets decide about each. What is left are trees whose members lie in several components. Their
sets meet in blocks of bounded size, where those outside of the tree's main component are compared
with all others; only the links found leave the task.

Words are runs between white space with A-Z lower-cased. A text of fewer words has one shingle, an
empty one none; empty texts are one class.
"""

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.llm import simhash
from figmill.llm.batches import (
    LOWER,
    SPACES,
    flat,
    gather,
    lean_slices,
    mixed,
    run_hashes,
    runs,
    shingles,
)
from figmill.llm.filters import joined
from figmill.sources.staging import stage

WIDTH = 5
LIKE = 0.8
_PER_CENT = round(LIKE * 100)
#: Smaller sets are like none but their equals.
SMALLEST = -(-_PER_CENT // (100 - _PER_CENT))
RADIUS = 34
RECALL = 0.99
#: Classes to a bucket, members of a bucket that are compared at once.
CELL, BLOCK = 1024, 4096
#: Shingles on either side of a block of sets.
ROOM = 1 << 20
SLICE = 1 << 20


def tables(classes: int) -> np.ndarray:
    """The bits that make up the key of each table, as masks in rows of 64-bit words."""
    bits = max(0, math.ceil(math.log2(max(classes, 1) / CELL)))
    differ = math.acos(2 * LIKE / (1 + LIKE)) / math.pi  # of sets of one size, the least alike
    apart = [
        (
            math.comb(simhash.WIDE, n) * differ**n * (1 - differ) ** (simhash.WIDE - n),
            math.comb(simhash.WIDE - n, bits) / math.comb(simhash.WIDE, bits),
        )
        for n in range(RADIUS + 1)
    ]
    number = 1
    while sum(share * (1 - (1 - agree) ** number) for share, agree in apart) < RECALL:
        number += 1
    rng = np.random.default_rng(83)
    chosen = np.zeros((number, simhash.WIDE), bool)
    for table in chosen:
        table[rng.choice(simhash.WIDE, bits, replace=False)] = True
    return np.packbits(chosen, axis=1, bitorder="little").view(np.uint64)


def table_keys(drawn: np.ndarray) -> Column:
    """One key per table from the fingerprint in ``high, low``."""
    return F.array(
        *[
            F.xxhash64(
                F.lit(table),
                *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(("high", "low"), masks, strict=True)],
            )
            for table, masks in enumerate(drawn.view(np.int64).tolist())
        ]
    )


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, rows = runs(~SPACES[data], offsets)
    marks, places = shingles(run_hashes(data, starts, ends), rows, WIDTH)
    return [np.unique(marks[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]


def digest(own: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(own.tobytes())


def _picked(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id, print, text`` of the rows that have an id; an id and a text's hash name a document."""
    return docs.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(text).alias("print"),
        F.col(text).alias("text"),
    )


def marked(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", classes: int = 1
) -> DataFrame:
    """``id, print, digest, n, high, low, keys`` of every document: its set's digest, size and
    fingerprint, and the keys of the tables for so many classes."""

    def work(batches):
        for part in lean_slices(batches, limit=SLICE):
            sets = shingle_sets(part.column("text"))
            bits = simhash.set_fingerprints(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("print"),
                    pa.array([digest(s) for s in sets], pa.string()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(bits[:, 0]),
                    pa.array(bits[:, 1]),
                ],
                names=["id", "print", "digest", "n", "high", "low"],
            )

    schema = "id long, print long, digest string, n long, high long, low long"
    found = _picked(docs, id_column, text).mapInArrow(work, schema)
    return found.withColumn("keys", table_keys(tables(classes)))


def _sets(docs: DataFrame, nodes: DataFrame, id_column: str, text: str) -> DataFrame:
    """``node, marks`` of ``node, name, print`` rows: the ascending shingle hashes of their texts."""

    def work(batches):
        for part in lean_slices(batches, limit=SLICE):
            sets = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("node"),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["node", "marks"],
            )

    found = joined(_picked(docs, id_column, text), nodes, "print").filter("id = name")
    return (
        found.select("node", "text").mapInArrow(work, "node long, marks array<long>")
        .dropDuplicates(["node"])
    )


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_column: str, text: str):
    """The pairs ``a > b`` of nodes whose sets are alike."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stage(wanted.join(classes.select("node", "name", "print"), "node"), "likeness-names")
    sets = stage(_sets(docs, wanted, id_column, text), "likeness-sets")
    left = sets.select(F.col("node").alias("a"), F.col("marks").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("marks").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    both = F.size("left") + F.size("right") - F.col("shared")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "left", "right", shared.alias("shared"))
        .filter(F.col("shared") * 100 >= both * _PER_CENT)
        .select("a", "b")
        .distinct()
    )


def _pair(left: str, right: str):
    return F.struct(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))


def _forest(bits: np.ndarray, sizes: np.ndarray, radius: int):
    """The links of a spanning forest of the close pairs whose sizes allow them, nearest first."""
    forest = simhash.Forest(len(bits))
    if len(bits) < 2:
        return forest
    found = []
    for left, right in simhash.wide_pairs(bits, radius):
        m, n = sizes[left], sizes[right]
        fit = np.minimum(m, n) * 100 >= np.maximum(m, n) * _PER_CENT
        left, right = left[fit], right[fit]
        apart = np.bitwise_count(bits[left] ^ bits[right]).sum(1, dtype=np.int64)
        found.append((apart, left, right))
    if found:
        apart, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        for distance in np.unique(apart):
            here = apart == distance
            forest.add(left[here], right[here])
    return forest


def _tree_pairs(buckets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``key, a, b``: links of the forest of each bucket's close pairs, with a key for each tree.

    A bucket of more than ``BLOCK`` members is one tree, whose members of the nearest fingerprints
    are compared; a member with itself stands for those that nothing is near to.
    """

    def work(bucket: pa.Table) -> pa.Table:
        node, sizes, key = (bucket.column(c).to_numpy() for c in ("node", "n", "key"))
        bits = np.stack([bucket.column(c).to_numpy() for c in ("high", "low")], 1).view(np.uint64)
        order = np.lexsort(bits.T) if len(node) > BLOCK else np.arange(len(node))
        tree, ends = [], []
        for first in range(0, len(node), BLOCK):
            own = order[first : first + BLOCK]
            forest = _forest(bits[own], sizes[own], radius)
            pairs = own[np.array(forest.links, np.int64).reshape(-1, 2)]
            ends.append(pairs)
            tree.append(own[forest.root[np.array([i for i, _ in forest.links], np.int64)]])
        if len(node) > BLOCK:
            ends.append(np.stack((order, order), 1))
            tree = [np.full(sum(map(len, ends)), order[0])]
        ends, tree = np.concatenate(ends), np.concatenate(tree)
        pairs = node[ends]
        with np.errstate(over="ignore"):
            keys = mixed(key[:1].view(np.uint64) ^ mixed(node[tree].view(np.uint64)))
        return pa.table({"key": keys.view(np.int64), "a": pairs.max(1), "b": pairs.min(1)})

    rows = buckets.select("key", "node", "n", "high", "low")
    return rows.groupBy("key").applyInArrow(work, "key long, a long, b long")


def _alike_in_block(block: pa.Table) -> pa.Table:
    """Pairs of a row of ``side`` 1 with one of side 0 that are alike and of different roots, one
    for each such row and root."""
    node, root, side = (block.column(c).to_numpy() for c in ("node", "root", "side"))
    marks = block.column("marks").combine_chunks()
    sizes = marks.value_lengths().to_numpy().astype(np.int64)
    values, codes = np.unique(marks.flatten().to_numpy(), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    others = np.flatnonzero((side == 0) & (sizes > 0))
    others = others[np.argsort(sizes[others], kind="stable")]
    ordered = sizes[others]
    pool = gather(codes, first[others], ordered)
    begins = np.concatenate(([0], np.cumsum(ordered)))
    held = np.zeros(len(values), bool)
    a, b = [], []
    for x in np.flatnonzero((side == 1) & (sizes > 0)).tolist():
        m, own = sizes[x], codes[first[x] : first[x] + sizes[x]]
        low = np.searchsorted(ordered * 100, m * _PER_CENT)
        high = np.searchsorted(ordered * _PER_CENT, m * 100, "right")
        if low == high or (root[others[low:high]] == root[x]).all():
            continue
        held[own] = True
        there = held[pool[begins[low] : begins[high]]]
        held[own] = False
        shared = np.add.reduceat(there, begins[low:high] - begins[low], dtype=np.int64)
        alike = shared * 100 >= (m + ordered[low:high] - shared) * _PER_CENT
        found = others[low:high][alike]
        found = found[root[found] != root[x]]
        _, one = np.unique(root[found], return_index=True)
        a.append(np.full(len(one), node[x]))
        b.append(node[found[one]])
    empty = [np.zeros(0, np.int64)]
    return pa.table({"a": np.concatenate(a + empty), "b": np.concatenate(b + empty)})


def _stray_pairs(
    buckets: DataFrame, classes: DataFrame, docs: DataFrame, id_column: str, text: str
) -> DataFrame:
    """Alike pairs of members of one key and different components: for each member outside of its
    key's main component one with every other component. ``buckets`` has ``key, node, root``."""
    held = buckets.distinct().join(classes.select("node", "name", "print", "n"), "node")
    held = stage(held, "likeness-strays")
    roots = held.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"),
    )
    units = roots.groupBy("key").agg(
        F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"),
        F.sum("members").alias("members"), F.sum("sign").alias("sign"),
        F.count(F.lit(1)).alias("roots"),
    ).filter("roots > 1")
    # The same members under several keys need one look.
    once = units.groupBy("members", "sign").agg(F.min(F.struct("key", "main", "n")).alias("u"))
    parts = lambda n: F.ceil(n / ROOM).cast("int")
    units = once.select(
        "u.key", F.col("u.main.root").alias("main"), parts(F.col("u.n")).alias("across"),
        parts(F.col("u.n") - F.col("u.main.n")).alias("down"),
    )
    met = stage(held.join(units, "key"), "likeness-stray-names")
    sets = stage(
        _sets(docs, met.select("node", "name", "print").distinct(), id_column, text),
        "likeness-stray-sets",
    )
    part = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.greatest(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    rows = met.filter("root <> main").select(
        "key", "node", "root", F.lit(1).alias("side"),
        part(1, F.col("down")).cast("int").alias("i"), every(F.col("across")).alias("j"),
    )
    columns = met.select(
        "key", "node", "root", F.lit(0).alias("side"),
        every(F.col("down")).alias("i"), part(0, F.col("across")).cast("int").alias("j"),
    )
    blocks = rows.unionByName(columns.select(rows.columns)).join(sets, "node")
    found = blocks.groupBy("key", "i", "j").applyInArrow(_alike_in_block, "a long, b long")
    return found.select(_pair("a", "b").alias("p")).select("p.*").distinct()


def groups(
    docs: DataFrame,
    components: Callable[[DataFrame, str], DataFrame],
    id_column: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
) -> DataFrame:
    """``node, name, print, root``: the classes of equal sets and the component each belongs to. A
    class is named by its document of the smallest id."""
    classes = stage(
        marked(docs, id_column, text)
        .groupBy("digest", "n", "high", "low")
        .agg(F.min(F.struct("id", "print")).alias("first"))
        .select(
            F.col("first.id").alias("name"), F.col("first.print").alias("print"), "n", "high", "low",
            F.monotonically_increasing_id().alias("node"),
        ),
        "likeness-classes",
    )
    large = classes.filter(F.col("n") >= SMALLEST)
    keys = table_keys(tables(large.count()))
    buckets = large.select("node", "n", "high", "low", F.explode(keys).alias("key"))
    trees = stage(_tree_pairs(buckets, radius), "likeness-trees")
    pairs = stage(trees.filter("a <> b").select("a", "b").distinct(), "likeness-pairs")
    edges = stage(_checked(pairs, classes, docs, id_column, text), "likeness-edges")
    near = components(edges, "likeness-rounds")
    near = stage(near.withColumnRenamed("root", "own"), "likeness-roots")

    def rooted(rows: DataFrame) -> DataFrame:
        found = rows.join(near, "node", "left")
        return found.withColumn("root", F.coalesce("own", "node")).drop("own")

    # The one pair of a tree of two has been looked at.
    more = trees.groupBy("key").agg(F.count(F.lit(1)).alias("links")).filter("links > 1")
    members = trees.join(more.select("key"), "key").select(
        "key", F.explode(F.array("a", "b")).alias("node")
    )
    links = stage(_stray_pairs(rooted(members), classes, docs, id_column, text), "likeness-far")
    # Few links are left: they join components, not documents.
    ends = [
        near.select(F.col("node").alias(side), F.col("own").alias(f"{side}_root")) for side in "ab"
    ]
    raised = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
        F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y")
    )
    raised = raised.select(_pair("x", "y").alias("p")).select("p.*")
    far = components(raised, "likeness-links").select(
        F.col("node").alias("root"), F.col("root").alias("last")
    )
    return rooted(classes.select("node", "name", "print")).join(far, "root", "left").select(
        "node", "name", "print", F.coalesce("last", "root").alias("root")
    )
