"""Quality gates and audits over tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions import text as X


def candidate_gates(code: Column, max_chars: int = C.MAX_MARKUP_CHARS) -> list[tuple[str, Column]]:
    """The gates a scanned document passes, in order."""
    block = X.first_picture(code)
    return [
        ("has_code", F.coalesce(code, F.lit("")) != ""),
        ("has_begin_tag", X.contains_text(code, C.BEGIN_PICTURE)),
        ("code_in_budget", X.within_budget(code, max_chars)),
        ("has_block", block.isNotNull()),
        ("block_in_budget", X.within_budget(block, max_chars)),
    ]


def valid_candidates(df: DataFrame, code: str, max_chars: int = C.MAX_MARKUP_CHARS) -> DataFrame:
    """Rows that pass every gate, with their first block as ``markup``."""
    for _, gate in candidate_gates(F.col(code), max_chars):
        df = df.filter(gate)
    return df.withColumn("markup", X.first_picture(F.col(code)))


def candidate_funnel(df: DataFrame, code: str, max_chars: int = C.MAX_MARKUP_CHARS) -> DataFrame:
    """How many rows are left after each gate; one pass, one row."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("scanned")]
    for name, gate in candidate_gates(F.col(code), max_chars):
        passed = passed & F.coalesce(gate, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return df.agg(*counts)


def successful_renders(samples: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Samples whose render succeeded; every other column stays aligned by key."""
    kept = outcomes.filter("is_successful").select("sample_id")
    return samples.join(kept, "sample_id", "left_semi")


def usable_images(lines: DataFrame, height: int, width: int, channels: int = 1) -> DataFrame:
    """Per image: pixel count, sample deviation, and whether it is complete and not blank."""
    square_sum = F.aggregate("pixels", F.lit(0.0), lambda a, p: a + p * p)
    total = F.aggregate("pixels", F.lit(0.0), lambda a, p: a + p)
    stats = lines.groupBy("image_id").agg(
        F.sum(F.size("pixels")).alias("pixel_count"),
        F.sum(total).alias("_s"),
        F.sum(square_sum).alias("_q"),
        F.min(F.size("pixels")).alias("_narrow"),
        F.max(F.size("pixels")).alias("_wide"),
    )
    n = F.col("pixel_count")
    deviation = F.sqrt(
        F.greatest(F.lit(0.0), (F.col("_q") - F.col("_s") * F.col("_s") / n) / (n - 1))
    )
    shaped = (n == height * width * channels) & (F.col("_narrow") == width) & (
        F.col("_wide") == width
    )
    return stats.withColumn("pixel_std", deviation).select(
        "image_id",
        "pixel_count",
        "pixel_std",
        (shaped & (F.col("pixel_std") >= C.BLANK_STD)).alias("usable"),
    )


def shard_alignment(samples: DataFrame) -> DataFrame:
    """Per shard: do images, ids and labels all have one row and one shape per sample?"""
    return samples.groupBy("split", "shard_id").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.count("pixels").alias("num_images"),
        F.count("ids").alias("num_ids"),
        F.count("family_idx").alias("num_labels"),
        F.min(F.size("pixels")).cast("long").alias("min_pixels"),
        F.max(F.size("pixels")).cast("long").alias("max_pixels"),
        F.min(F.size("ids")).cast("long").alias("min_length"),
        F.max(F.size("ids")).cast("long").alias("max_length"),
    ).withColumn(
        "aligned",
        (F.col("num_images") == F.col("num_samples"))
        & (F.col("num_ids") == F.col("num_samples"))
        & (F.col("num_labels") == F.col("num_samples"))
        & (F.col("min_pixels") == F.col("max_pixels"))
        & (F.col("min_length") == F.col("max_length")),
    )


def vocabulary_invariants(vocabulary: DataFrame) -> DataFrame:
    """One row of facts about a vocabulary and whether it is a valid bijection."""
    reserved = F.lit(0)
    for idx, token in enumerate(C.RESERVED_TOKENS):
        reserved = reserved + ((F.col("token") == token) & (F.col("idx") == idx)).cast("int")
    facts = vocabulary.agg(
        F.count(F.lit(1)).alias("entries"),
        F.countDistinct("token").alias("distinct_tokens"),
        F.countDistinct("idx").alias("distinct_ids"),
        F.sum(reserved).alias("reserved_in_place"),
        F.count_if(F.coalesce(F.col("token"), F.lit("")) == "").alias("empty_tokens"),
    )
    return facts.withColumn(
        "valid",
        (F.col("entries") == F.col("distinct_tokens"))
        & (F.col("entries") == F.col("distinct_ids"))
        & (F.col("reserved_in_place") == len(C.RESERVED_TOKENS))
        & (F.col("empty_tokens") == 0),
    )


def unknown_families(stage_families: DataFrame) -> DataFrame:
    """Stage rows that name a family nobody can generate."""
    return stage_families.filter(~F.col("family").isin(*C.FAMILIES))


def planned_total(stages: DataFrame, planned: int = C.PLANNED_SAMPLES) -> DataFrame:
    """Total of the stage plan against the planned corpus size."""
    return stages.agg(F.sum("samples").alias("total_samples")).withColumn(
        "matches_plan", F.col("total_samples") == planned
    )


def run_audit(evidence: DataFrame) -> DataFrame:
    """Status and blocking reasons per run, from an evidence table
    ``run_id, log_bytes, checkpoint_exists, checkpoint_restorable, test_rows``."""
    rules = [
        (F.col("log_bytes") == 0, "empty_log"),
        (~F.col("checkpoint_exists"), "missing_checkpoint"),
        (F.col("checkpoint_exists") & ~F.col("checkpoint_restorable"), "corrupt_checkpoint"),
        (F.col("test_rows") == 0, "missing_test_split"),
    ]
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))
    return evidence.select(
        "run_id",
        F.when(F.size(reasons) == 0, "ready").otherwise("blocked").alias("status"),
        F.array_join(reasons, ",").alias("blocking_reasons"),
    )
