"""Seeded draws and fingerprints.

Every random decision is a function of ``(seed, key, slot)``, so it does not
depend on partitioning, on retries or on the order in which rows arrive. Single draws
are native; the many draws of a row are hashed together, an Arrow batch at a time.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
# MD5 (RFC 1321) of messages that fit one block: constants and rotations of its 64 steps.
_BLOCK, _ROOM = 64, 55
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = np.floor(np.abs(np.sin(np.arange(1.0, 65.0))) * TWO_32).astype(np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
# Messages hashed at a time, so that a step's operands stay in the cache.
_MESSAGES = 1 << 13


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def hash32(seed, key, slot) -> Column:
    """Uniform integer in ``[0, 2**32)``."""
    parts = [as_column(part).cast("string") for part in (seed, key, slot)]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(seed, key, slot) -> Column:
    """Uniform double in ``[0, 1)``."""
    return hash32(seed, key, slot) / F.lit(TWO_32)


def fingerprint(column) -> Column:
    """SHA-256 of a text or binary column."""
    return F.sha2(column, 256)


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _md5_heads(words: np.ndarray) -> np.ndarray:
    """First 32 bits of the MD5 of one-block messages; ``words`` is ``(16, messages)``."""
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in _START)
    mixed, high = np.empty_like(a), np.empty_like(a)
    for step in range(_BLOCK):
        kind = step // 16
        if kind == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
            place = step
        elif kind == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
            place = (5 * step + 1) % 16
        elif kind == 2:
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
            place = (3 * step + 5) % 16
        else:  # c ^ (b | ~d)
            np.invert(d, out=mixed)
            mixed |= b
            mixed ^= c
            place = 7 * step % 16
        a += mixed
        a += words[place]
        a += _SINES[step]
        turn = _TURNS[kind][step % 4]
        np.left_shift(a, np.uint32(turn), out=high)
        a >>= np.uint32(32 - turn)
        a |= high
        a += b
        a, b, c, d = d, a, b, c
    return (a + np.uint32(_START[0])).byteswap()


def hash_heads(stems: pa.Array, owners: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """:func:`hash32` of ``stem + slot`` for many slots; ``owners`` names the stem of each."""
    stems = stems.cast(pa.large_binary())
    ends = np.frombuffer(stems.buffers()[1], np.int64)[stems.offset : stems.offset + len(stems) + 1]
    data = np.frombuffer(stems.buffers()[2] or b"", np.uint8)
    lengths = np.diff(ends)
    places = len(str(int(slots.max()))) if len(slots) else 1
    digits = np.ones(len(slots), np.int64) + sum((slots >= 10**n).astype(np.int64) for n in range(1, places))
    sizes = lengths[owners] + digits
    kept = np.minimum(lengths, _ROOM)
    rows = np.repeat(np.arange(len(kept)), kept)
    column = np.arange(len(rows)) - np.repeat(np.cumsum(kept) - kept, kept)
    blocks = np.zeros((len(kept), _BLOCK), np.uint8)
    blocks[rows, column] = data[ends[:-1][rows] + column]
    out = np.empty(len(slots), np.uint32)
    short = np.flatnonzero(sizes <= _ROOM)
    for at in range(0, len(short), _MESSAGES):
        own = short[at : at + _MESSAGES]
        number, count, size = slots[own], digits[own], sizes[own]
        message = blocks[owners[own]]
        every = np.arange(len(own))
        for n in range(int(count.max())):  # digits from the last one on
            some = every if n == 0 else np.flatnonzero(count > n)
            message[some, size[some] - 1 - n] = 48 + number[some] // 10**n % 10
        message[every, size] = 128
        words = np.ascontiguousarray(message.view("<u4").T)
        words[14] = size * 8
        out[own] = _md5_heads(words)
    for n in np.flatnonzero(sizes > _ROOM).tolist():
        stem = stems[int(owners[n])].as_py()
        out[n] = int.from_bytes(hashlib.md5(stem + b"%d" % slots[n]).digest()[:4], "big")
    return out


def entries(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All values of a batch of lists and the offsets of its rows; null rows are empty."""
    lists = pc.fill_null(column, pa.scalar([], column.type))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def stem(seed, key) -> Column:
    """What the slot number is appended to before hashing."""
    return F.concat_ws(":", *[as_column(part).cast("string") for part in (seed, key)], F.lit(""))


def _uniforms_of(stems: pa.Array, slots: np.ndarray, offsets: np.ndarray, missing: pa.Array) -> pa.Array:
    """Uniforms of the slots of all rows; ``offsets`` says where a row's slots begin."""
    heads = hash_heads(stems, np.repeat(np.arange(len(stems)), np.diff(offsets)), slots)
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), pa.array(heads / TWO_32), mask=missing
    )


def uniform_batch(stems: pa.Array, slots: pa.Array) -> pa.Array:
    """Uniforms of a list of slots per row; null for null lists."""
    values, offsets = entries(slots)
    numbers = values.to_numpy(zero_copy_only=False).astype(np.int64)
    return _uniforms_of(stems, numbers, offsets, pc.is_null(slots))


def draw_batch(stems: pa.Array, counts: pa.Array) -> pa.Array:
    """Uniforms of the slots under a count per row; null for null counts."""
    sizes = pc.fill_null(counts, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    slots = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    return _uniforms_of(stems, slots, offsets, pc.is_null(counts))


def uniforms(seed, key, slots: Column) -> Column:
    """:func:`uniform` of every slot of an array."""

    @F.arrow_udf("array<double>")
    def drawn(stems: pa.Array, wanted: pa.Array) -> pa.Array:
        return uniform_batch(stems, wanted)

    return drawn(stem(seed, key), slots)


def draws(seed, key, count) -> Column:
    """Array of uniforms for the slots under ``count``."""

    @F.arrow_udf("array<double>")
    def drawn(stems: pa.Array, counts: pa.Array) -> pa.Array:
        return draw_batch(stems, counts)

    return drawn(stem(seed, key), as_column(count).cast("int"))


class Draws:
    """Readers of a draw array. ``base`` shifts the slots, so templates can nest."""

    def __init__(self, values: Column, base=0):
        self.values, self.base = values, base

    def shifted(self, base) -> "Draws":
        return Draws(self.values, base)

    def u(self, slot) -> Column:
        at = self.base + slot
        return F.get(self.values, at if isinstance(at, Column) else F.lit(at))

    def integer(self, slot, low: int, high: int) -> Column:
        """Uniform integer, both ends included."""
        return F.floor(self.u(slot) * (high - low + 1)) + low

    def choice(self, slot, options) -> Column:
        index = F.floor(self.u(slot) * len(options)).cast("int")
        return F.get(F.split(F.lit("|".join(options)), "[|]"), index)

    def weighted(self, slot, options) -> Column:
        """One of ``(value, weight)`` pairs by cumulative threshold."""
        return pick_weighted(self.u(slot), options)


def pick_weighted(u: Column, options) -> Column:
    total = sum(weight for _, weight in options)
    reached, branches = 0.0, None
    for value, weight in options[:-1]:
        reached += weight
        test = u < F.lit(round(reached / total, 12))
        branches = F.when(test, F.lit(value)) if branches is None else branches.when(
            test, F.lit(value)
        )
    last = F.lit(options[-1][0])
    return last if branches is None else branches.otherwise(last)
