"""Benchmark passages in documents, whole or with a fifth of their words edited.

A document holds an item when some window of its words is within ``EDITED`` of the item's length in
word edits (insert, delete, replace). A fifth of fewer than ``SHORTEST`` words is no edit: such items
are found by the hash of all their words, and the first place in a text is enough.

1. Windows. A window within the threshold keeps ``n - 1 - 2 d`` of the item's word pairs, so only
   places with that many pairs of any item are embedded; nothing within the threshold is lost.
2. Embedding. A walk over the window's words records the word at each step and moves on or stays
   by a random bit of step and word. Windows a few edits apart soon walk in step again, so edit
   distance becomes Hamming distance.
3. Bit-sampling LSH. Each of ``REPEATS`` walks samples ``SAMPLED`` of its steps as a key. Items and
   item-sized windows (items of about one length share a walk length) that share a key are
   candidates. ``REPEATS`` is chosen for the target recall at the threshold itself.
4. Verification. The exact edit distance of the item to the best window of the region decides.

Only two filters of fixed size travel to the executors, the items' word pairs and their keys; a
false positive costs a candidate and nothing else. Items, regions and candidates meet in joins.

Words are runs of ASCII letters, digits and other than ASCII characters, with A-Z lower-cased.
Null or empty texts and items hold nothing; repeated rows count once for each id; a null id is kept
as null; ties between windows go to the smaller distance, then the smaller start.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.batches import LOWER, flat, lean_slices, mixed, run_hashes, runs, ship
from figmill.llm.filters import FILTER_BITS, bit_filter, bits_of, within
from figmill.sources.staging import stage

EDITED = 0.2
SHORTEST = 5
SAMPLED = 2
RECALL = 0.995
#: Share of steps at which two walks agree that are the threshold apart, from simulation.
AGREEMENT = 0.4
REPEATS = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREEMENT**SAMPLED))
#: Lengths of one class differ by at most this factor.
CLASS_STEP = 1.15
#: Words of a region; longer stretches are cut into overlapping regions.
REGION = 1024

KEEP = np.zeros(256, bool)
KEEP[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the row offsets."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, rows = runs(KEEP[data], offsets)
    return run_hashes(data, starts, ends), rows


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Hash of every word with the next; the last one pairs with nothing."""
    with np.errstate(over="ignore"):
        return mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:])


def length_class(n: int) -> int:
    return int(math.log(n) / math.log(CLASS_STEP))


def class_range(number: int, longest: int) -> tuple[int, int]:
    """Smallest and largest number of words in a class."""
    sizes = [n for n in range(SHORTEST, longest + 1) if length_class(n) == number]
    return sizes[0], sizes[-1]


def allowed(n: int) -> int:
    return int(EDITED * n)


def shared_pairs(n: int) -> int:
    """Word pairs that a window within the threshold keeps at least."""
    return max(1, n - 1 - 2 * allowed(n))


def needed_pairs(low: int, high: int) -> int:
    """Word pairs that a window keeps at least of any item in a length class.

    The bound of one length falls where one more edit is allowed, so the shortest does not decide.
    """
    return min(shared_pairs(n) for n in range(low, high + 1))


def run_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """Key of every ``n`` words in a row."""
    keys = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for k in range(n):
        with np.errstate(over="ignore"):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) ^ hashes[k : k + len(keys)])
    return keys


def walk_keys(hashes: np.ndarray, starts: np.ndarray, number: int, low: int) -> np.ndarray:
    """Keys of the windows at ``starts`` in a length class: starts x ``REPEATS``."""
    steps = 2 * low
    rng = np.random.default_rng([number, 20])
    odd = rng.integers(0, 1 << 63, (REPEATS, steps), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    sampled = np.array([rng.choice(steps, SAMPLED, replace=False) for _ in range(REPEATS)])
    padded = np.concatenate((hashes, np.zeros(steps + 1, np.uint64)))
    place = np.repeat(starts[:, None], REPEATS, 1)
    keys = np.full(place.shape, number, np.uint64)
    with np.errstate(over="ignore"):
        for step in range(steps):
            symbol = padded[place]
            for k in range(SAMPLED):
                here = sampled[:, k] == step
                if here.any():
                    keys[:, here] += mixed(symbol[:, here] + np.uint64(k * 977 + 1))
            place += ((symbol * odd[:, step]) >> np.uint64(63)).astype(np.int64)
        repeat = np.arange(REPEATS, dtype=np.uint64) << np.uint64(32)
        return mixed(keys + repeat)


def items_of(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, words, keys, pair_bits`` of the items that have words."""

    def work(batches):
        for part in lean_slices(batches):
            hashes, rows = words(part.column("text"))
            out = []
            for n, name in enumerate(part.column("item").to_pylist()):
                own = hashes[rows[n] : rows[n + 1]]
                if not len(own):
                    continue
                if len(own) < SHORTEST:
                    keys = run_keys(own, len(own))
                    out.append((name, own.view(np.int64), keys.view(np.int64), []))
                    continue
                number = length_class(len(own))
                low = next(s for s in range(SHORTEST, len(own) + 1) if length_class(s) == number)
                keys = walk_keys(own, np.zeros(1, np.int64), number, low)[0]
                out.append((name, own.view(np.int64), keys.view(np.int64), bits_of(pairs(own))))
            columns = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["item_id", "words", "keys", "pair_bits"],
            )

    picked = benchmark.select(
        F.col(item).cast("long").alias("item"), F.col(text).alias("text")
    )
    return picked.mapInArrow(
        work, "item_id long, words array<long>, keys array<long>, pair_bits array<long>"
    )


def _windows(hashes, rows, pair_table, classes):
    """Yield ``number, low, high, starts`` of the windows worth embedding."""
    if len(hashes) < 2:
        return
    marked = within(pair_table, pairs(hashes))
    ends = rows[1:-1]
    marked[ends[(ends > 0) & (ends < len(hashes))] - 1] = False  # no pair across two rows
    upto = np.concatenate(([0], np.cumsum(marked, dtype=np.int32)))
    for number, low, high in classes:
        # A window of ``high`` words has ``high - 1`` pairs; fewer stand before the end.
        size = min(high + allowed(high) - 1, len(marked))
        need = needed_pairs(low, high)
        dense = np.flatnonzero(upto[size:] - upto[:-size] >= need)
        tail = np.arange(max(0, len(marked) - size + 1), len(marked))
        tail = tail[upto[-1] - upto[tail] >= need]
        starts = np.concatenate((dense, tail))
        # The window of a match may begin at any pair, but not without one near its start.
        reach = np.minimum(starts + 2 * allowed(high) + 1, len(marked))
        starts = starts[upto[reach] - upto[starts] > 0]
        if len(starts):
            yield number, low, high, starts


def _short(hashes, rows, key_table, short):
    """Yield ``size, starts, keys`` of the short items' first places in each row."""
    end = np.repeat(rows[1:], np.diff(rows))
    for n in short:
        keys = run_keys(hashes, n)
        at = np.flatnonzero(within(key_table, keys))
        at = at[at + n <= end[at]]  # none across two rows
        if len(at):
            both = np.stack((end[at].astype(np.uint64), keys[at]), 1)
            at = at[np.unique(both, axis=0, return_index=True)[1]]
            yield n, at, keys[at]


def _regions(starts, ends, rows):
    """Merge windows to regions inside a row, at most ``REGION`` words apart from overlaps."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    row = np.searchsorted(rows, starts, "right") - 1
    ends = np.minimum(ends, rows[row + 1])
    out = []
    for a, b, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True):
        if out and out[-1][2] == r and a <= out[-1][1] and b - out[-1][0] <= REGION:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, r])
    return out


def _region_batches(batches, pair_table, key_table, classes, short, kind):
    for part in lean_slices(batches):
        hashes, rows = words(part.column("text"))
        hits, left, right = [], [], []
        for number, low, high, starts in _windows(hashes, rows, pair_table, classes):
            for first in range(0, len(starts), 1 << 14):
                some = starts[first : first + (1 << 14)]
                keys = walk_keys(hashes, some, number, low)
                window, repeat = np.nonzero(within(key_table, keys))
                if len(window):
                    hits.append((some[window], keys[window, repeat].view(np.int64)))
                    left.append(some[window])
                    right.append(some[window] + high + allowed(high))
        for n, starts, keys in _short(hashes, rows, key_table, short):
            hits.append((starts, keys.view(np.int64)))
            left.append(starts)
            right.append(starts + n)
        if not hits:
            continue
        at = np.concatenate([h[0] for h in hits])
        keys = np.concatenate([h[1] for h in hits])
        names = part.column("id").to_pylist()
        out = [[], [], [], []]
        found = _regions(np.concatenate(left), np.concatenate(right), rows)
        # Each key goes to the first region that holds its window's start.
        starts = np.array([a for a, _, _ in found])
        region = np.searchsorted(starts, at, "right") - 1
        order = np.argsort(region, kind="stable")
        cut = np.searchsorted(region[order], np.arange(len(found) + 1))
        for n, (a, b, row) in enumerate(found):
            mine = np.unique(keys[order[cut[n] : cut[n + 1]]])
            for value, column in zip(
                (names[row], int(a - rows[row]), hashes[a:b].view(np.int64), mine), out
            ):
                column.append(value)
        kinds = (kind, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
            names=["id", "at", "words", "keys"],
        )


def best_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Distance, start and size of the window of ``text`` nearest to ``item``."""
    places = np.arange(len(text) + 1)
    cost, begin = np.zeros(len(text) + 1, np.int64), places.copy()
    big = len(text) + 1
    for word in item:
        # Cost first, then the later begin: among equal costs the shorter window.
        keep = (cost[:-1] + (text != word)) * big - begin[:-1]
        drop = (cost + 1) * big - begin
        both = drop.copy()
        both[1:] = np.minimum(keep, drop[1:])
        both = np.minimum.accumulate(both - places * big) + places * big
        cost = -(-both // big)
        begin = cost * big - both
    end = int(np.argmin(cost * big + places))
    return int(cost[end]), int(begin[end]), end - int(begin[end])


def _verify(batches):
    for batch in batches:
        text, item = batch.column("words"), batch.column("item_words")
        rows = []
        for n in range(batch.num_rows):
            own, region = np.asarray(item[n].values), np.asarray(text[n].values)
            there = set(region.tolist())
            # Every item word that the region lacks costs an edit.
            if sum(word not in there for word in own.tolist()) > allowed(len(own)):
                continue
            cost, begin, size = best_window(own, region)
            if cost <= allowed(len(own)):
                rows.append((n, begin, size, cost, 1 - cost / len(own)))
        at = [r[0] for r in rows]
        begin = pa.array([r[1] for r in rows], pa.int64())
        first = pa.compute.add(batch.column("at").take(pa.array(at, pa.int64())), begin)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(pa.array(at, pa.int64())),
                batch.column("item_id").take(pa.array(at, pa.int64())),
                first,
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.float64()),
            ],
            names=["id", "item_id", "first_word", "n_words", "distance", "similarity"],
        )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    kind: str = "long",
) -> DataFrame:
    """``id, item_id, first_word, n_words, distance, similarity``: the best window of each item
    in each document that holds it; ids are ``kind``, long or string."""
    spark = docs.sparkSession
    items = stage(items_of(benchmark), "items")
    lengths = [r[0] for r in items.select(F.size("words").alias("n")).distinct().collect()]
    schema = f"id {kind}, item_id long, first_word long, n_words long, distance long, similarity double"
    if not lengths:
        return spark.createDataFrame([], schema)
    short = sorted(n for n in lengths if n < SHORTEST)
    numbers = sorted({length_class(n) for n in lengths if n >= SHORTEST})
    classes = [(n, *class_range(n, max(lengths))) for n in numbers]
    pair_table = bit_filter(items.select(F.explode("pair_bits").alias("bit")))
    mask = F.lit(FILTER_BITS - 1).cast("long")
    item_keys = items.select("item_id", F.explode("keys").alias("key"))
    key_table = bit_filter(item_keys.select(F.col("key").bitwiseAND(mask).alias("bit")))
    id_kind = pa.string() if kind == "string" else pa.int64()
    shipped = ship(spark, (pair_table, key_table, classes, short, id_kind))
    picked = docs.select(F.col(id_column).cast(kind).alias("id"), F.col(text).alias("text"))
    regions = stage(
        picked.mapInArrow(
            lambda batches: _region_batches(batches, *shipped.value),
            f"id {kind}, at long, words array<long>, keys array<long>",
        ),
        "regions",
    ).withColumn("region", F.xxhash64("id", "at", "words"))
    candidates = (
        regions.select("region", F.explode("keys").alias("key"))
        .join(item_keys, "key")
        .select("region", "item_id")
        .distinct()
    )
    checked = (
        candidates.join(items.select("item_id", F.col("words").alias("item_words")), "item_id")
        .join(regions.select("region", "id", "at", "words"), "region")
        .select("id", "at", "words", "item_id", "item_words")
        .mapInArrow(_verify, schema)
    )
    rank = F.struct("distance", "first_word", "n_words", "similarity")
    return (
        checked.groupBy("id", "item_id")
        .agg(F.min(rank).alias("best"))
        .select("id", "item_id", "best.first_word", "best.n_words", "best.distance", "best.similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows without id are judged by their texts."""
    name, own = "_clean_name", F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256))
    named = docs.withColumn(name, F.coalesce(F.col("doc_id").cast("string"), own))
    found = leaks(named, benchmark, name, kind="string").select(F.col("id").alias(name)).distinct()
    return named.join(found, name, "left_anti").select(docs.columns)
