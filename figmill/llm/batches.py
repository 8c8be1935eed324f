"""Text columns of Arrow batches as flat numpy arrays.

The operators hand Spark's partitions to numpy in slices of a bounded number of bytes, so a
worker's memory does not depend on the partition, only on the longest single text.
"""

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
#: Longer words are hashed one by one; they are too rare to be worth a vector step per byte.
LONG_WORD = 48

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


_SHIPPED: list = []


def ship(spark, value):
    """Broadcast ``value`` until the next ``release``."""
    _SHIPPED.append(spark.sparkContext.broadcast(value))
    return _SHIPPED[-1]


def release() -> None:
    """Take back from the executors what finished jobs shipped; it travels again if it is needed."""
    while _SHIPPED:
        _SHIPPED.pop().unpersist()


#: What an operator keeps in a worker from task to task, one operator's at a time.
_KEPT: dict[str, object] = {}


def kept(name: str, build: Callable[[], object]):
    """The value of ``name``, built once per worker."""
    if name not in _KEPT:
        _KEPT[name] = build()
    return _KEPT[name]


def _trim() -> None:
    """Give memory that is free again back to the system, so that a reused worker stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def lean_slices(
    batches, column: str = "text", limit: int = SLICE_BYTES, keep: str | None = None
) -> Iterator[pa.RecordBatch]:
    """``slices`` for operators that take turns in the same workers: of the values that a worker
    keeps only ``keep`` survives, and what a task frees goes back to the system."""
    for name in [n for n in _KEPT if n != keep]:
        del _KEPT[name]
    yield from slices(batches, column, limit)
    _trim()


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose texts hold about ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in a row and the offsets of each; null counts as empty."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true places, none across two rows, and for each row the
    number of the first run at or after its start (with one more entry at the end)."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64) + _STEP
        v = (v ^ (v >> np.uint64(30))) * _M1
        v = (v ^ (v >> np.uint64(27))) * _M2
        return v ^ (v >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes, equal for equal runs in any batch."""
    lengths = ends - starts
    hashes = lengths.astype(np.uint64)
    live = np.flatnonzero(lengths <= LONG_WORD)
    at = 0
    with np.errstate(over="ignore"):
        while len(live):
            hashes[live] = hashes[live] * _M2 + data[starts[live] + at]
            at += 1
            live = live[lengths[live] > at]
    for i in np.flatnonzero(lengths > LONG_WORD):
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return mixed(hashes)


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` consecutive words of a row and the row offsets of the result.

    A row of fewer words gives one shingle of all of them, a row without words none.
    """
    counts = np.diff(rows)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    places = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(counts)), sizes)
    first = rows[owner] + np.arange(places[-1]) - places[owner]
    lengths = np.minimum(counts, width)[owner]
    out = lengths.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            there = lengths > k
            here = out * _M1 + hashes[np.where(there, first + k, 0)] if len(hashes) else out
            out = np.where(there, here ^ (here >> np.uint64(29)), out)
    return mixed(out), places


def row_sums(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sum of each row's values, zero for rows without any."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), values)).cumsum(0)
    return total[places[1:]] - total[places[:-1]]


def gather(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``pool[first[i] : first[i] + sizes[i]]`` for all i, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(first - (ends - sizes), sizes)]
