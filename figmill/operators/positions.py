"""Dense positions, heads and cut points without a global sort.

A 64-bit order key is cut into cells. Rows are ranked inside their cell, and cell
counts are summed level by level, so no task ever sees more than one cell of rows
or one parent of cells. With a unique key a cell holds at most ``2**CELL_BITS`` rows
whatever the distribution; with a hashed key the rows spread evenly over the cells.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.sources.staging import stage

CELL_BITS = 16
#: Levels of parents above the cells of a 64-bit key; no level has more than ``2**16`` siblings.
PARENT_BITS = (16, 16)
# A 32-bit hash has 65,536 cells, few enough to be summed without parents.
HASHED = ()


def counts_before(counts: DataFrame, groups: list[str], parents=PARENT_BITS) -> DataFrame:
    """Add ``_before``: rows of the same group in lower cells. ``counts`` has ``_cell, _n``."""
    if not parents:
        window = W.partitionBy(*groups or [F.lit(0)]).orderBy("_cell")
        upto = F.sum("_n").over(window.rowsBetween(W.unboundedPreceding, W.currentRow))
        return counts.withColumn("_before", upto - F.col("_n"))
    nested = counts.withColumn("_parent", F.shiftright("_cell", parents[0]))
    window = W.partitionBy(*groups, "_parent").orderBy("_cell")
    upto = F.sum("_n").over(window.rowsBetween(W.unboundedPreceding, W.currentRow))
    local = nested.withColumn("_local", upto - F.col("_n"))
    above = counts_before(
        nested.groupBy(*groups, "_parent")
        .agg(F.sum("_n").alias("_n"))
        .withColumnRenamed("_parent", "_cell"),
        groups,
        parents[1:],
    ).select(*groups, F.col("_cell").alias("_parent"), F.col("_before").alias("_above"))
    return (
        local.join(above, [*groups, "_parent"])
        .withColumn("_before", F.col("_local") + F.col("_above"))
        .drop("_parent", "_local", "_above")
    )


def _offsets(cells: DataFrame, groups: list[str], parents) -> DataFrame:
    """``groups, _cell, _n, _before``. Counts that several levels read are staged, so the
    rows are scanned for them once."""
    counts = cells.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    return counts_before(stage(counts, "cells") if parents else counts, groups, parents)


def dense_position(
    df: DataFrame, key: Column, ties=(), groups=(), name: str = "position", parents=PARENT_BITS
) -> DataFrame:
    """Zero-based position of every row by ``(key, *ties)`` within its group.

    One shuffle of the rows; the offsets join on the same keys, so they follow it.
    """
    groups = list(groups)
    cells = df.withColumn("_key", key.cast("long")).withColumn(
        "_cell", F.shiftright("_key", CELL_BITS)
    )
    window = W.partitionBy(*groups, "_cell").orderBy("_key", *ties)
    offsets = _offsets(cells, groups, parents).drop("_n")
    return (
        cells.withColumn("_rank", F.row_number().over(window) - 1)
        .join(offsets, [*groups, "_cell"])
        .withColumn(name, (F.col("_rank") + F.col("_before")).cast("long"))
        .drop("_key", "_cell", "_rank", "_before")
    )


def cut_points(
    df: DataFrame, quotas: dict, key: Column, tie: Column, groups=(), parents=PARENT_BITS
) -> DataFrame:
    """One row per group and quota name: ``_name`` and the ``(key, tie)`` of the row that
    fills the quota.

    A quota maps the group-size column to a count. Rows are counted per cell; only the cell
    in which a quota falls is sorted. Quotas of zero have no row.
    """
    named = list(groups)
    whole = [] if named else [F.lit(0).alias("_all")]
    groups = named or ["_all"]
    cells = df.select(
        *named, *whole, key.cast("long").alias("_key"), tie.alias("_tie")
    ).withColumn("_cell", F.shiftright("_key", CELL_BITS))
    located = _offsets(cells, groups, parents)
    sizes = located.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    wanted = F.array(
        *[
            F.struct(F.lit(n).alias("_name"), quota(F.col("_size")).cast("long").alias("_quota"))
            for n, quota in quotas.items()
        ]
    )
    edges = (
        located.join(sizes, groups)
        .select(*groups, "_cell", "_before", "_n", F.inline(wanted))
        .filter("_before < _quota and _before + _n >= _quota")
        .select(*groups, "_cell", "_name", (F.col("_quota") - F.col("_before")).alias("_left"))
    )
    window = W.partitionBy(*groups, "_cell", "_name").orderBy("_key", "_tie")
    return (
        cells.join(edges, [*groups, "_cell"])
        .withColumn("_rank", F.row_number().over(window))
        .filter("_rank = _left")
        .select(*named, "_name", F.struct("_key", "_tie").alias("_cut"))
    )


def within_cuts(
    df: DataFrame, quotas: dict, key: Column, tie: Column, groups=(), parents=PARENT_BITS
) -> DataFrame:
    """Add one boolean column per quota: is the row among the first ones of its group?

    The cut table is staged, so the rows themselves meet it in one narrow pass.
    """
    groups = list(groups)
    points = cut_points(df, quotas, key, tie, groups, parents)
    here = F.struct(key.cast("long").alias("_key"), tie.alias("_tie"))
    if groups:
        wide = points.groupBy(*groups).agg(
            *[F.max(F.when(F.col("_name") == n, F.col("_cut"))).alias(f"_cut_{n}") for n in quotas]
        )
        joined = df.join(stage(wide, "cuts"), groups, "left")
        inside = {n: F.coalesce(here <= F.col(f"_cut_{n}"), F.lit(False)) for n in quotas}
        return joined.withColumns(inside).drop(*[f"_cut_{n}" for n in quotas])
    # One row per quota: as literals they can reach the scan as a pushed filter.
    cuts = {row["_name"]: row["_cut"] for row in points.collect()}
    inside = {}
    for n in quotas:
        cut, at = cuts.get(n), key.cast("long")
        inside[n] = (
            F.lit(False)
            if cut is None
            else (at < cut["_key"]) | ((at == cut["_key"]) & (tie <= F.lit(cut["_tie"])))
        )
    return df.withColumns(inside)


def within_cut(df: DataFrame, quota, key: Column, tie: Column, groups=(), parents=PARENT_BITS):
    """Add ``_inside`` for a single quota."""
    return within_cuts(df, {"_inside": quota}, key, tie, groups, parents)


def ordered_head(df: DataFrame, count: int, order: str) -> DataFrame:
    """First ``count`` rows by a unique integer column, kept distributed."""
    if count <= 0:
        raise ValueError(f"A head of {count} rows is empty.")
    marked = within_cut(
        df, lambda size: F.least(size, F.lit(count)), F.col(order), F.col(order)
    )
    return marked.filter("_inside").drop("_inside")


def text_position(df: DataFrame, column: str, name: str = "position") -> DataFrame:
    """Zero-based position by code-point order of a unique text column.

    Cells are the ranges of one range partitioning, which is staged, so they hold about the
    same number of texts whatever the texts have in common.
    """
    ranged = df.repartitionByRange(column).withColumn("_cell", F.spark_partition_id())
    ranged = stage(ranged, "ranged")
    order = W.partitionBy(F.lit(0)).orderBy("_cell")  # one row per range
    offsets = ranged.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).select(
        "_cell",
        F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(
            "_before"
        ),
    )
    rank = F.row_number().over(W.partitionBy("_cell").orderBy(column)) - 1
    return (
        ranged.withColumn("_rank", rank)
        .join(offsets, "_cell")
        .withColumn(name, (F.col("_rank") + F.col("_before")).cast("long"))
        .drop("_cell", "_rank", "_before")
    )
