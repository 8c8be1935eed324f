"""Deduplication, heads, splits and sampling."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions.hashing import as_column, fingerprint, hash32, pick_weighted, uniform
from figmill.operators.positions import (
    HASHED,
    dense_position,
    ordered_head,
    within_cut,
    within_cuts,
)
from figmill.operators.quality import successful_renders, valid_candidates
from figmill.sources.staging import stage


# --- Deduplication ---------------------------------------------------------------------------


def first_occurrences(
    df: DataFrame, content: str, order: str, keep: list[str] | None = None
) -> DataFrame:
    """Keep the earliest row of every distinct content, or only its ``keep`` columns.

    Copies collapse before the shuffle, so a text that makes up a third of the table
    costs one row per task. With ``keep`` the contents themselves are never shuffled.
    """
    rows = df.groupBy(fingerprint(F.col(content)).alias("_print")).agg(
        F.min_by(F.struct(*(keep or df.columns)), F.col(order)).alias("_row")
    )
    return rows.select("_row.*")


# --- Splits ----------------------------------------------------------------------------------


def check_ratio(ratio: float) -> None:
    if not 0.0 < ratio < 1.0:
        raise ValueError(f"A split at {ratio} leaves one side without rows.")


def _split(df, quota, key: str, seed, groups=(), labels=("val", "train")) -> DataFrame:
    order = hash32(seed, F.col(key), "split")
    marked = within_cut(df, quota, order, F.col(key), groups, HASHED)
    return marked.withColumn(
        "split", F.when(F.col("_inside"), labels[0]).otherwise(labels[1])
    ).drop("_inside")


def random_split(df: DataFrame, ratio: float, seed: int, key: str) -> DataFrame:
    """Exact random split: round-half-even share, at least one row on each side."""
    check_ratio(ratio)
    return _split(
        df, lambda n: F.greatest(F.lit(1.0), F.least(F.rint(n * F.lit(ratio)), n - 1.0)), key, seed
    )


def stratified_split(df: DataFrame, ratio: float, seed: int, key: str, stratum: str) -> DataFrame:
    """Exact share of every stratum, rounded down."""
    check_ratio(ratio)
    return _split(df, lambda n: F.floor(n * F.lit(ratio)), key, seed, [stratum])


def tenth_split(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Nine tenths train, rounded down; the rest val."""
    return _split(df, lambda n: F.floor(n * F.lit(0.9)), key, seed, labels=("train", "val"))


def stage_split(df: DataFrame, seed: int, key: str) -> DataFrame:
    """A fifth for small tables, else a tenth but at least 100 rows."""

    def quota(n: Column) -> Column:
        small = F.greatest(F.lit(1), F.floor(n * F.lit(0.2)))
        large = F.least(F.greatest(F.lit(100), F.floor(n * F.lit(0.1))), n - 1)
        return F.when(n <= 100, small).otherwise(large)

    return _split(df, quota, key, seed)


def banded_split(df: DataFrame, per_group: int, seed: int, key: str, group: str) -> DataFrame:
    """Quotas of 90/5/5 percent of ``per_group`` rows in every group; the rest is unused."""
    train, rest = int(per_group * 0.90), int(per_group * 0.05)
    bounds = {"train": train, "val": train + rest, "test": train + 2 * rest}
    quotas = {f"_{n}": (lambda size, b=b: F.least(size, F.lit(b))) for n, b in bounds.items()}
    order = hash32(seed, F.col(key), "split")
    marked = within_cuts(df, quotas, order, F.col(key), [group], HASHED)
    split = F.when(F.col("_train"), "train").when(F.col("_val"), "val").when(F.col("_test"), "test")
    return marked.withColumn("split", split).drop(*quotas)


# --- Quotas and retries ----------------------------------------------------------------------


def quota_fill(attempts: DataFrame, quota: int, group: str, order: str) -> DataFrame:
    """First ``quota`` valid rows of every group among at most ``3 * quota`` attempts."""
    tried = within_cut(
        attempts, lambda n: F.least(n, F.lit(3 * quota)), F.col(order), F.col(order), [group]
    ).filter("_inside").drop("_inside")
    valid = tried.filter("is_valid")
    return within_cut(
        valid, lambda n: F.least(n, F.lit(quota)), F.col(order), F.col(order), [group]
    ).filter("_inside").drop("_inside")


def quota_shortfall(filled: DataFrame, quota: int, group: str, names) -> DataFrame:
    """What every group of ``names`` lacks; a group without a single row lacks the whole quota."""
    wanted = filled.sparkSession.createDataFrame([(name,) for name in names], f"{group} string")
    counts = filled.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return wanted.join(counts, group, "left").select(
        group, F.coalesce("_n", F.lit(0)).alias("collected"),
        (F.lit(quota) - F.coalesce("_n", F.lit(0))).alias("shortfall"),
    )


def retry_seeds(samples: DataFrame, retries: int = C.MAX_RETRIES) -> DataFrame:
    """One row per sample and attempt; attempt ``k`` uses ``seed + k * 1000003``."""
    return samples.withColumn(
        "attempt", F.explode(F.sequence(F.lit(0), F.lit(retries - 1)))
    ).withColumn("attempt_seed", F.col("seed") + F.col("attempt") * F.lit(C.RETRY_STRIDE))


def first_valid_attempt(attempts: DataFrame) -> DataFrame:
    """Earliest valid attempt of every sample; null when all attempts failed."""
    valid = F.when(F.col("is_valid"), F.struct("attempt", "attempt_seed"))
    best = attempts.groupBy("sample_id").agg(F.min(valid).alias("_best"))
    return best.select(
        "sample_id",
        F.col("_best.attempt").cast("long").alias("attempt"),
        F.col("_best.attempt_seed").alias("final_seed"),
        F.col("_best").isNull().alias("failed"),
    )


# --- Candidate scan --------------------------------------------------------------------------


def curated_candidates(
    rows: DataFrame, code: str, order: str, max_rows: int, cap: int
) -> DataFrame:
    """Scan cap, gates, first occurrence of every block, candidate cap."""
    scanned = ordered_head(rows, max_rows, order)
    unique = first_occurrences(valid_candidates(scanned, code), "markup", order)
    return ordered_head(stage(unique, "candidates"), cap, order)


def successful_head(
    candidates: DataFrame, outcomes: DataFrame, target: int, order: str
) -> DataFrame:
    """First ``target`` candidates that rendered."""
    return ordered_head(successful_renders(candidates, outcomes), target, order)


# --- Sampling --------------------------------------------------------------------------------


#: Swaps a permuted place goes through; after the first one that happens it may be anywhere.
SWAPS = 24


def swap_keys(seed, key: Column, size: Column) -> Column:
    """Keys of one permutation of ``size`` places."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(SWAPS - 1)),
        lambda i: hash32(seed, key, F.concat(F.lit("swap"), i.cast("string"))) % size,
    )


def permuted_place(place: Column, size: Column, keys: Column, seed, key: Column) -> Column:
    """Where a seeded permutation of ``[0, size)`` takes a place.

    Every swap pairs each place with its mirror about a key, and a hash of the pair says whether
    they change sides: a bijection for any size, and no place needs to know another one.
    """

    def swapped(at: Column, i: Column) -> Column:
        mirror = F.pmod(F.get(keys, i) - at, size)
        pair = F.greatest(at, mirror)
        coin = F.md5(F.concat_ws(":", F.lit(str(seed)), key, i.cast("string"), pair.cast("string")))
        return F.when(F.substring(coin, 1, 1) < "8", mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(SWAPS - 1)), place, swapped)


def curriculum_draws(pool: DataFrame, draws: DataFrame, weights, seed: int) -> DataFrame:
    """Weighted family draws with replacement; rows of a family without replacement, with a
    fresh permutation whenever its pool is used up.

    ``pool(sample_id, family)``, ``draws(draw_id)``; gives ``draw_id, family, pass, sample_id,
    reason``. A draw of a family without pool keeps its row, with ``empty_pool`` as the reason.
    The pool is numbered once; a draw computes its place from its pass and number.
    """
    options = list(zip(C.FAMILIES, weights))
    chosen = draws.select(
        "draw_id", pick_weighted(uniform(seed, F.col("draw_id"), "family"), options).alias("family")
    )
    sizes = stage(
        pool.groupBy("family").agg(F.count(F.lit(1)).alias("pool_size")), "pool-sizes"
    )
    numbered = (
        dense_position(chosen, F.col("draw_id"), groups=["family"], name="_number")
        .join(sizes, "family", "left")
        .withColumn("pass", F.floor(F.col("_number") / F.col("pool_size")).cast("long"))
    )
    passes = chosen.groupBy("family").agg(F.count(F.lit(1)).alias("_draws")).join(sizes, "family")
    own = F.concat_ws("/", "family", F.col("pass").cast("string"))
    last = F.floor((F.col("_draws") - 1) / F.col("pool_size")).cast("long")
    keys = stage(
        passes.select(
            "family", "pool_size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pass")
        ).select("family", "pass", swap_keys(seed, own, F.col("pool_size")).alias("_keys")),
        "pass-keys",
    )
    place = permuted_place(
        F.col("_number") % F.col("pool_size"), F.col("pool_size"), F.col("_keys"), seed, own
    )
    placed = numbered.join(keys, ["family", "pass"], "left").withColumn(
        "place", F.when(F.col("pool_size") > 0, place)
    )
    listed = dense_position(
        pool.select("sample_id", "family"), F.col("sample_id"), groups=["family"], name="place"
    )
    empty = F.when(F.col("pool_size").isNull(), F.lit("empty_pool"))
    return placed.join(listed, ["family", "place"], "left").select(
        "draw_id", "family", "pass", "sample_id", empty.alias("reason")
    )


def round_robin_families(df: DataFrame, position: str, families, base_seed: int) -> DataFrame:
    """Families in turn, with a seed per row."""
    names = F.array(*[F.lit(name) for name in families])
    return df.withColumn(
        "family", F.element_at(names, (F.col(position) % len(families) + 1).cast("int"))
    ).withColumn("seed", hash32(base_seed, F.col(position), "seed") % F.lit(2_000_000_000))


def mixed_tiers(tiers: dict[str, DataFrame]) -> DataFrame:
    """Concatenate tiers under a ``tier`` column."""
    mixed = None
    for name, df in tiers.items():
        tagged = df.withColumn("tier", F.lit(name))
        mixed = tagged if mixed is None else mixed.unionByName(tagged)
    return mixed


def leaked_rows(test: DataFrame, train: DataFrame, content: str) -> DataFrame:
    """Test rows whose content also occurs in train."""
    seen = train.select(fingerprint(F.col(content)).alias("_print")).distinct()
    return test.withColumn("_print", fingerprint(F.col(content))).join(
        seen, "_print", "left_semi"
    ).drop("_print")


def independent_rows(test: DataFrame, train: DataFrame, content: str) -> DataFrame:
    """Test rows whose content never occurs in train."""
    seen = train.select(fingerprint(F.col(content)).alias("_print")).distinct()
    return test.withColumn("_print", fingerprint(F.col(content))).join(
        seen, "_print", "left_anti"
    ).drop("_print")


def replicated(df: DataFrame, repeats: int) -> DataFrame:
    """Every row ``repeats`` times, numbered by ``copy``."""
    if repeats <= 0:
        raise ValueError(f"Rows cannot be repeated {repeats} times.")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), as_column(repeats) - 1)))


def batch_bounds(df: DataFrame, position: str, size: int) -> DataFrame:
    """Half-open ``[start, end)`` bounds of consecutive batches."""
    if size <= 0:
        raise ValueError(f"Batches of {size} rows never end.")
    return df.groupBy(F.floor(F.col(position) / size).cast("long").alias("batch")).agg(
        F.min(position).alias("start"), (F.max(position) + 1).alias("end")
    )
