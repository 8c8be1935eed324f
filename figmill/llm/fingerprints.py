"""Document fingerprints by one-permutation MinHash.

All five-word shingles of a text are hashed once; the high bits of a hash choose one of ``BINS``
bins and each bin keeps its smallest hash. An empty bin takes the value of a filled one that its own
sequence of random bins meets first (optimal densification), the same sequence for every text. Of
each bin the low ``BITS`` bits are stored, two bins to a byte. Two unrelated bins agree by chance
once in ``2 ** BITS`` times, so the share of agreeing bins is corrected for it.

Words are runs of other bytes than ASCII white space, with A-Z lower-cased. A text of fewer than
five words is one shingle; a text without words (null, empty, blank) has the empty fingerprint,
which is like another empty one (1) and unlike any other (0). Repeated rows give equal
fingerprints, whole texts are read whatever their length.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.batches import LOWER, SPACES, flat, mixed, run_hashes, runs, shingles, slices

WIDTH = 5
BIN_BITS = 9
BINS = 1 << BIN_BITS
BITS = 4
CHANCE = 1 / (1 << BITS)
#: Ranges of keys for each shuffle partition; more of them even out the partitions.
CELLS_EACH = 4


def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The stored bits of every bin (rows x ``BINS``) and whether the text has words."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, rows = runs(~SPACES[data], offsets)
    hashes, places = shingles(run_hashes(data, starts, ends), rows, WIDTH)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(places))
    least = np.full((len(rows) - 1) * BINS, np.iinfo(np.uint64).max, np.uint64)
    cells = owner * BINS + (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    np.minimum.at(least, cells, hashes & np.uint64((1 << (64 - BIN_BITS)) - 1))
    least = least.reshape(-1, BINS)
    filled = least != np.iinfo(np.uint64).max
    count = filled.sum(1)
    alone = np.flatnonzero(count == 1)
    least[alone] = least[alone].min(1)[:, None]
    row, column_ = np.nonzero(~filled & (count > 1)[:, None])
    turn = 0
    while len(row):
        donors = mixed(np.arange(BINS, dtype=np.uint64) + np.uint64(turn * BINS)) >> np.uint64(
            64 - BIN_BITS
        )
        donor = donors[column_].astype(np.int64)
        found = filled[row, donor]
        least[row[found], column_[found]] = least[row[found], donor[found]]
        row, column_ = row[~found], column_[~found]
        turn += 1
    return (least & np.uint64((1 << BITS) - 1)).astype(np.uint8), count > 0


def packed(values: np.ndarray, present: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text."""
    bytes_ = values[:, ::2] << 4 | values[:, 1::2]
    return [row.tobytes().hex() if there else "" for row, there in zip(bytes_, present)]


def likeness(a, b, has_a, has_b) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, row by row."""
    agree = (a == b).mean(1)
    corrected = np.clip((agree - CHANCE) / (1 - CHANCE), 0.0, 1.0)
    return np.where(has_a & has_b, corrected, (has_a == has_b).astype(float))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text``."""
    kept = docs.drop(name)
    schema = kept.withColumn(name, F.lit(None).cast("string")).schema

    def work(batches):
        for part in slices(batches, text):
            found = pa.array(packed(*codes(part.column(text))), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, found], names=[*part.schema.names, name]
            )

    return kept.mapInArrow(work, schema)


def in_order(
    docs: DataFrame,
    key: str,
    text: str,
    work: Callable[[list, list[str]], list[pa.Array]],
    schema: str,
) -> DataFrame:
    """Call ``work(keys, texts)`` on runs of rows in ascending order of ``key``.

    ``texts`` has one entry more than ``keys``: the text of the row after the last (after the very
    last row: the first). Rows of one key are ordered by text, null keys come first, null texts
    count as empty. The texts are shuffled once: keys are cut into ranges at sampled quantiles, and
    the first row of a range also travels to the range before it.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _celled(rows, parts * CELLS_EACH)
    heads = rows.groupBy("cell").agg(F.min("key").alias("key")).orderBy("cell").collect()
    if not heads:
        return spark.createDataFrame([], schema)
    # One row for each range: the range before the one that this key opens.
    before = spark.createDataFrame(
        [(h["key"], heads[n - 1]["cell"]) for n, h in enumerate(heads)], "key long, before int"
    )
    opens = rows.join(
        F.broadcast(before.withColumnRenamed("key", "opening")),
        F.col("key").eqNullSafe(F.col("opening")),
        "left",
    )
    travels = F.array(
        F.struct(F.col("cell").alias("to"), F.lit(False).alias("extra")),
        F.struct(F.col("before").alias("to"), F.lit(True).alias("extra")),
    )
    sent = (
        opens.select("key", "text", F.inline(travels))
        .filter("to IS NOT NULL")
        .repartition(parts, "to")
        .sortWithinPartitions("to", "extra", F.asc_nulls_first("key"), "text")
    )

    def walk(batches):
        now, keys, texts, size, closed = None, [], [], 0, False
        names = [field.split()[0] for field in schema.split(", ")]

        def flush(following: str):
            return pa.RecordBatch.from_arrays(work(keys, [*texts, following]), names=names)

        for part in slices(batches, "text"):
            for at, extra, k, t in zip(
                part.column("to").to_pylist(),
                part.column("extra").to_pylist(),
                part.column("key").to_pylist(),
                part.column("text").to_pylist(),
            ):
                if at != now:
                    now, closed = at, False
                if closed:
                    continue
                if keys and (extra or size > 1 << 21):
                    yield flush(t)
                    keys, texts, size = [], [], 0
                if extra:
                    closed = True
                else:
                    keys.append(k)
                    texts.append(t)
                    size += len(t)

    return sent.mapInArrow(walk, schema)


def _celled(rows: DataFrame, cells: int) -> DataFrame:
    """``rows`` with ``cell``, the number of its range of keys; null keys are in a range of their
    own before all others."""
    marks = [n / cells for n in range(1, cells)]
    cuts = rows.agg(F.percentile_approx("key", marks, max(10_000, 10 * cells))).first()[0] or [0]
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_key", outputCol="_cell", handleInvalid="keep")
    return (
        placed.transform(rows.withColumn("_key", F.col("key").cast("double")))
        .withColumn("cell", F.when(F.col("key").isNull(), -1).otherwise(F.col("_cell")).cast("int"))
        .drop("_key", "_cell")
    )
