"""Near-duplicate documents by SimHash with bit-sliced comparison.

A text's fingerprint has bit b set when more than half of its three-word shingles have it set in
their XXH64. Fingerprints that differ in at most two bits are linked, and linked documents form
one component.

Two differing bits touch at most two of a fingerprint's eight bytes, so linked fingerprints agree
in some choice of six bytes: 28 keys per fingerprint, and no pair is missed. What shares a key
differs in two bytes only, so a bucket never holds more than 65,536 distinct fingerprints,
whatever the number of documents. Inside a bucket the free bits are stored as planes, 64
fingerprints to a word; one shift of the planes compares 64 pairs at once, carry-save counters add
up their differences, and words in which every pair is beyond the radius are abandoned. A bucket
gives the edges of a spanning forest, never all its pairs. Components come from large-star and
small-star rounds over tables in the shared folder.

``wide_pairs`` is the same comparison for wider fingerprints and radii: a whole table of pairs at a
time, with counters of as many planes as the radius has bits. ``likeness`` proposes its pairs by it.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a null
id keeps its row but never names a component (null when no other id is reachable); repeated rows
each give a row; an empty table gives an empty result.
"""

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm import likeness
from figmill.llm.batches import LOWER, SPACES, flat, mixed, row_sums, runs, slices
from figmill.sources.staging import stage

SEED = 42
WIDTH = 3
RADIUS = 2
#: Pairs of bytes that may differ; the other six are the key.
FREE = list(combinations(range(8), RADIUS))
#: Bits of the fingerprints of sets; each word of them hashes with another salt.
WIDE = 128
_SALTS = np.random.default_rng(29).integers(0, 1 << 63, WIDE // 64, dtype=np.uint64)
#: Rows of the table of pairs that is compared at a time, and planes between two looks at it.
_TILE, _LOOK = 256, 16


def joined_words(data, starts, ends) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each word begins."""
    lengths = ends - starts
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    out = np.full(begin[-1], 0x20, np.uint8)
    inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(begin[:-1], lengths) + inner] = data[np.repeat(starts, lengths) + inner]
    return out.tobytes(), begin


def text_fingerprints(column: pa.Array) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, rows = runs(~SPACES[data], offsets)
    joined, begin = joined_words(data, starts, ends)
    counts = np.diff(rows)
    sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(counts.dtype))
    places = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(counts)), sizes)
    first = rows[owner] + np.arange(places[-1]) - places[owner]
    last = first + np.minimum(counts, WIDTH)[owner]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(joined[a:b], SEED)
            for a, b in zip(begin[first].tolist(), (begin[last] - 1).tolist(), strict=True)
        ),
        np.uint64,
        len(first),
    )
    return majorities(hashes, places)


def majorities(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each row of hashes the bits that more than half of them have."""
    sizes = np.diff(places)
    out = np.zeros(len(sizes), np.uint64)
    for byte in range(8):
        part = (hashes >> np.uint64(8 * byte)).astype(np.uint8)
        bits = np.unpackbits(part[:, None], axis=1, bitorder="little")
        over = 2 * row_sums(bits.astype(np.int32), places) > sizes[:, None]
        packed = np.packbits(over, axis=1, bitorder="little")[:, 0].astype(np.uint64)
        out |= packed << np.uint64(8 * byte)
    return out


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """``WIDE`` bits of each set of hashes, as rows of 64-bit words."""
    places = np.concatenate(([0], np.cumsum([len(own) for own in sets], dtype=np.int64)))
    values = np.concatenate([np.zeros(0, np.uint64), *sets])
    parts = [majorities(mixed(values ^ salt), places) for salt in _SALTS]
    return np.stack(parts, axis=1)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fingerprint`` (the 64 bits as a long), one row per document."""

    def work(batches):
        for part in slices(batches):
            bits = text_fingerprints(part.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(bits)], names=["id", "fingerprint"]
            )

    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return picked.mapInArrow(work, "id long, fingerprint long")


class Forest:
    """Union-find over the fingerprints of one batch; keeps the links that join two trees."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self.links: list[tuple[int, int]] = []

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        fresh = np.flatnonzero(self.root[left] != self.root[right])
        for i, j in zip(left[fresh].tolist(), right[fresh].tolist(), strict=True):
            a, b = self._find(i), self._find(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((i, j))
        while (flatter := self.root[self.root]).tobytes() != self.root.tobytes():
            self.root = flatter


def _words(bits: np.ndarray) -> np.ndarray:
    """Pack booleans, 64 to a word, the first in the lowest bit."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate((packed, np.zeros(-len(packed) % 8, np.uint8))).view(np.uint64)


def close_pairs(values: np.ndarray, bucket: np.ndarray, radius: int = RADIUS):
    """Yield ``(i, j)`` index arrays of the pairs within ``radius`` bits and in one bucket.

    ``values`` holds the 16 free bits of fingerprints, ``bucket`` ascending bucket numbers.
    One round per distance in the list; a round touches the words that still hold a pair.
    """
    planes = [_words((values >> np.uint16(b)) & np.uint16(1)) for b in range(16)]
    planes = [np.concatenate((p, np.zeros(2, np.uint64))) for p in planes]
    largest = int(np.bincount(bucket).max()) if len(bucket) else 0
    for distance in range(1, largest):
        valid = _words(bucket[:-distance] == bucket[distance:])
        live = np.flatnonzero(valid)
        if not len(live):
            return
        skip, turn = distance // 64, np.uint64(distance % 64)
        left = np.minimum(live + skip, len(planes[0]) - 2)
        ones = np.zeros(len(live), np.uint64)
        twos, beyond = ones.copy(), ones.copy()
        for n, plane in enumerate(planes):
            moved = plane[left] >> turn
            if turn:
                moved |= plane[left + 1] << (np.uint64(64) - turn)
            differ = plane[live] ^ moved
            carry = ones & differ
            ones ^= differ
            beyond |= twos & carry
            twos ^= carry
            if n % 4 == 3:
                over = beyond | (twos & ones) if radius == 2 else beyond | twos
                kept = np.flatnonzero(valid[live] & ~over)
                live, left, ones, twos, beyond = (
                    x[kept] for x in (live, left, ones, twos, beyond)
                )
                if not len(live):
                    break
        if len(live):
            over = beyond | (twos & ones) if radius == 2 else beyond | twos
            hits = (valid[live] & ~over).view(np.uint8).reshape(-1, 8)
            word, bit = np.nonzero(np.unpackbits(hits, axis=1, bitorder="little"))
            first = live[word] * 64 + bit
            yield first, first + distance


def _added(a, b, c):
    """Carry-save sum of three planes: its ones and its twos."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def wide_pairs(bits: np.ndarray, radius: int):
    """Yield ``(i, j)`` index arrays, i below j, of the rows of ``bits`` within ``radius``.

    Each word holds a plane of 64 rows, which are compared with one row at a time. The counters
    begin so high that they run over where a pair is beyond the radius; words in which all are
    beyond are abandoned.
    """
    size, width = len(bits), 64 * bits.shape[1]
    single = np.unpackbits(bits.view(np.uint8).reshape(size, -1), axis=1, bitorder="little").T
    planes = np.stack([_words(plane) for plane in single])
    masks = np.uint64(0) - single.astype(np.uint64)
    levels = max(1, radius.bit_length())
    begin = (1 << levels) - 1 - radius
    for first in range(0, size, _TILE):
        own, rest = masks[:, first : first + _TILE, None], planes[:, None, first // 64 :]
        shape = (own.shape[1], rest.shape[2])
        row, word = None, None
        counters = [
            np.full(shape, -(begin >> n & 1) & (1 << 64) - 1, np.uint64)
            for n in range(levels)
        ]
        beyond = np.zeros(shape, np.uint64)
        for at in range(0, width, 2):
            if row is None:
                x, y = (own[n] ^ rest[n] for n in (at, at + 1))
            else:
                x, y = (own[n, row, 0] ^ rest[n, 0, word] for n in (at, at + 1))
            counters[0], carry = _added(counters[0], x, y)
            for n in range(1, len(counters)):
                counters[n], carry = counters[n] ^ carry, counters[n] & carry
            beyond |= carry
            if at + 2 > 2 * radius and (at + 2) % _LOOK == 0:
                kept = ~beyond != 0
                if 2 * np.count_nonzero(kept) < kept.size:
                    there = np.nonzero(kept)
                    row, word = there if row is None else (row[there], word[there])
                    counters, beyond = [c[kept] for c in counters], beyond[kept]
        if row is None:
            row, word = (x.ravel() for x in np.indices(shape))
        hits = np.unpackbits((~beyond).reshape(-1, 1).view(np.uint8), axis=1, bitorder="little")
        found, bit = np.nonzero(hits)
        left = first + row[found]
        right = 64 * (first // 64 + word[found]) + bit
        some = (right > left) & (right < size)
        if some.any():
            yield left[some], right[some]


def _bucket_links(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column("members")
        sizes = np.diff(members.offsets.to_numpy())
        inner = members.flatten()
        names = inner.field("name").to_numpy(zero_copy_only=False)
        bits = inner.field("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
        free = np.repeat(batch.column("free").to_numpy(zero_copy_only=False), sizes)
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        for choice in np.unique(free):
            mine = np.flatnonzero(free == choice)
            low, high = (np.uint64(8 * b) for b in FREE[choice])
            values = ((bits[mine] >> low) & np.uint64(255)) | (
                ((bits[mine] >> high) & np.uint64(255)) << np.uint64(8)
            )
            forest = Forest(len(mine))
            for left, right in close_pairs(values.astype(np.uint16), bucket[mine]):
                forest.add(left, right)
            if forest.links:
                ends = names[mine][np.array(forest.links)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ends.max(1)), pa.array(ends.min(1))], names=["a", "b"]
                )


def links(classes: DataFrame) -> DataFrame:
    """Edges ``a > b`` that connect all ``name, fingerprint`` rows within the radius.

    Fingerprints must be distinct.
    """
    keys = F.array(
        *[
            F.struct(
                F.lit(n).alias("free"),
                F.col("fingerprint")
                .bitwiseAND(F.lit(_signed(~((255 << 8 * i) | (255 << 8 * j)))))
                .alias("key"),
            )
            for n, (i, j) in enumerate(FREE)
        ]
    )
    buckets = (
        classes.select("name", "fingerprint", F.inline(keys))
        .groupBy("free", "key")
        .agg(F.collect_list(F.struct("name", "fingerprint")).alias("members"))
        .filter(F.size("members") > 1)
    )
    found = buckets.select("free", "members").mapInArrow(_bucket_links, "a long, b long")
    return found.distinct()


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """``node, root`` for every node of an edge; the root is the smallest node reachable.

    Rounds of large-star and small-star; each round is a table in the shared folder.
    """
    edges = stage(edges.filter("a <> b").distinct(), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = (
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).filter("a <> b").distinct()
        large = stage(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").filter("a <> b").distinct()
        edges = stage(small, label)
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fingerprint, component_id``; the component is the smallest id reachable."""
    prints = stage(fingerprints(docs, id_column, text), "simhash")
    classes = stage(
        prints.groupBy("fingerprint").agg(F.min("id").alias("name")).filter("name IS NOT NULL"),
        "simhash-classes",
    )
    roots = components(links(classes), "simhash-edges")
    named = classes.join(roots, F.col("name") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("root", "name").alias("component_id")
    )
    return prints.join(named, "fingerprint", "left").select("id", "fingerprint", "component_id")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies (``likeness``), that of the smallest id.

    Rows of one id and one text are one document, of one id and other texts others; rows without
    id all stay.
    """
    grouped = likeness.groups(docs, components)
    stays = grouped.groupBy("root").agg(F.min(F.struct("name", "print")).alias("first"))
    mark = next(n for n in (f"_print{k}" for k in count()) if n not in docs.columns)
    keep = stays.select(F.col("first.name").alias("doc_id"), F.col("first.print").alias(mark))
    named = docs.filter("doc_id IS NOT NULL").withColumn(mark, F.xxhash64("text"))
    named = named.join(keep.distinct(), ["doc_id", mark], "left_semi")
    return (
        named.dropDuplicates(["doc_id", mark])
        .select(docs.columns)
        .unionByName(docs.filter("doc_id IS NULL"))
    )
