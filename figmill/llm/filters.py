"""Filters of a fixed number of bits, to drop most rows before a shuffle.

A filter is as large for a thousand keys as for a billion; with more keys it lets more rows pass
and is never wrong about a key it holds. What passes meets the keys in a join.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.batches import mixed, ship
from figmill.sources.staging import stage

FILTER_BITS = 1 << 24
_ONE = np.uint64(1)
#: Hashes of a sample and hashes of one of its cells.
_SPAN, _CELL = 1 << 32, 1 << 16


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """Bit of each hash."""
    return (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def bit_filter(values: DataFrame) -> np.ndarray:
    """Filter with the bits of the ``bit`` column; a row per 64 bits at most reaches the driver."""
    cells = values.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    found = cells.toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def within(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """May each hash be in the filter?"""
    bit = bits_of(hashes)
    return (table[bit >> 6] >> (bit & 63).astype(np.uint64) & _ONE).astype(bool)


def joined(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` joined with ``keys`` on an integer column.

    Rows are wide and few have a key: those without one mostly stay where they are, the others are
    shuffled. The way is the same at every size of ``keys``.
    """

    def hashes(values: pd.Series) -> np.ndarray:
        return mixed(values.to_numpy(np.int64).view(np.uint64))

    @F.pandas_udf("long")
    def bit(values: pd.Series) -> pd.Series:
        return pd.Series(bits_of(hashes(values)))

    some = keys.filter(F.col(column).isNotNull())
    table = bit_filter(some.select(bit(F.col(column).cast("long")).alias("bit")))
    shipped = ship(rows.sparkSession, table)

    @F.pandas_udf("boolean")
    def there(values: pd.Series) -> pd.Series:
        return pd.Series(within(shipped.value, hashes(values)))

    near = rows.filter(F.col(column).isNotNull()).filter(there(F.col(column).cast("long")))
    return near.join(some.hint("merge"), column)


def hash_sample(rows: DataFrame, limit: int) -> pd.DataFrame:
    """At most ``limit`` distinct rows, those of the smallest hashes, on the driver.

    The rows are counted by cells of hashes first, and only those below a cut that leaves little
    more than ``limit`` are fetched, however many partitions there are.
    """
    place, span, tie = F.pmod(F.xxhash64(*rows.columns), F.lit(_SPAN)), "_place", "_tie"
    placed = rows.distinct().withColumns({span: place, tie: F.xxhash64(F.lit(span), *rows.columns)})
    distinct = stage(placed, "sample")
    cells = distinct.groupBy(F.floor(F.col(span) / _CELL).alias("cell")).count().orderBy("cell")
    upto, cut = 0, 0
    for row in cells.collect():  # at most _SPAN / _CELL cells
        if upto >= limit:
            break
        upto, cut = upto + row["count"], (row["cell"] + 1) * _CELL
    found = distinct.filter(F.col(span) < cut).toPandas()
    return found.sort_values([span, tie]).head(limit).drop(columns=[span, tie])
