"""Corpus scores over pair tables ``sample_id, family, policy, reference, candidate``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions import scores as S
from figmill.functions import text as X
from figmill.functions import tokens as K
from figmill.operators.matching import (
    cost_blocks,
    is_small_block,
    large_block_gains,
    ngram_matches,
    small_block_gain,
    token_edit_distance,
    unordered_coordinate_error,  # noqa: F401
    unordered_markup_error,
)


def tokenized_pairs(pairs: DataFrame, step: float = C.COORDINATE_STEP) -> DataFrame:
    """Replace both markups by their tokens."""
    return pairs.withColumns(
        {
            "reference_tokens": K.tokens("reference", step=step),
            "candidate_tokens": K.tokens("candidate", step=step),
        }
    )


def corpus_bleu(
    pairs: DataFrame,
    groups=(),
    max_order: int = 4,
    reference: str = "reference_tokens",
    candidate: str = "candidate_tokens",
) -> DataFrame:
    """One row per group with ``pairs`` and ``corpus_bleu``.

    Clipping happens within a pair, so a pair is reduced to a handful of counts where it
    lies; only sums per group are shuffled, and a group may hold any share of the pairs.
    """
    groups = list(groups)
    counts = pairs.select(
        *groups, ngram_matches(F.col(reference), F.col(candidate), max_order).alias("_n")
    )
    totals = counts.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("pairs"), *_bleu_sums("_n", max_order)
    )
    return totals.select(*groups, "pairs", _bleu_of_sums(max_order).alias("corpus_bleu"))


def _bleu_sums(counts: str, max_order: int) -> list[Column]:
    """Sums of the n-gram counts of pairs."""
    names = ["_rl", "_cl"] + [f"_{k}{o}" for o in range(1, max_order + 1) for k in "mt"]
    return [F.sum(F.get(counts, F.lit(i))).alias(name) for i, name in enumerate(names)]


def _bleu_of_sums(max_order: int) -> Column:
    return S.bleu(
        [F.col(f"_m{o}") for o in range(1, max_order + 1)],
        [F.col(f"_t{o}") for o in range(1, max_order + 1)],
        F.col("_rl"),
        F.col("_cl"),
    )


def edit_distances(
    pairs: DataFrame, reference: str = "reference_tokens", candidate: str = "candidate_tokens"
) -> DataFrame:
    """Per-sample coordinate-aware edit distance as ``token_distance``."""
    return pairs.withColumn(
        "token_distance", token_edit_distance(F.col(reference), F.col(candidate))
    )


def batch_evaluation(pairs: DataFrame, groups=(), max_order: int = 4) -> DataFrame:
    """BLEU and mean edit distance per group, with the range of the distances.

    Every pair is tokenized and scored once; one shuffle of sums.
    """
    groups = list(groups)
    r, c = F.col("reference_tokens"), F.col("candidate_tokens")
    scored = tokenized_pairs(pairs).select(
        *groups,
        ngram_matches(r, c, max_order).alias("_n"),
        token_edit_distance(r, c).alias("token_distance"),
    )
    totals = scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("pairs"),
        *_bleu_sums("_n", max_order),
        F.avg("token_distance").alias("mean_token_distance"),
        F.count_if(~F.col("token_distance").between(0.0, 1.0)).alias("out_of_range"),
    )
    return totals.select(
        *groups, "pairs", _bleu_of_sums(max_order).alias("corpus_bleu"),
        "mean_token_distance", "out_of_range",
    )


def coordinate_errors(pairs: DataFrame, families=C.UNORDERED_FAMILIES) -> DataFrame:
    """Coordinate error per sample: zipped points, or matched ones for the ``families`` whose
    points carry no order; rows without a family are left out where some are named. The pairs are
    read once, and either kind of row does only its own work."""
    unordered = F.col("family").isin(*families) if families else F.lit(False)
    kept = pairs.filter(F.col("family").isNotNull()) if families else pairs
    r, c = F.col("_r"), F.col("_c")
    sides = {"reference": r, "candidate": c}
    measured = kept.withColumns(
        {name: F.when(~unordered, X.points(side)) for name, side in (("_r", "reference"), ("_c", "candidate"))}
    )
    sizes = {side: F.size(found).cast("long") for side, found in sides.items()}
    matching, error = F.lit("ordered"), S.ordered_coordinate_error(r, c)
    if families:
        texts = [F.when(unordered, F.col(side)) for side in sides]
        measured = measured.withColumn("_m", unordered_markup_error(*texts))
        matched = F.col("_m")
        sizes = {side: F.when(unordered, matched[side]).otherwise(n) for side, n in sizes.items()}
        matching = F.when(unordered, F.lit("assigned")).otherwise(matching)
        error = F.when(unordered, matched["error"]).otherwise(error)
    return measured.select(
        *pairs.columns,
        F.least(*sizes.values()).alias("compared_points"),
        *[n.alias(f"{side}_points") for side, n in sizes.items()],
        matching.alias("matching"),
        error.alias("coordinate_error"),
    )


def graph_distances(
    pairs: DataFrame,
    reference: str = "reference",
    candidate: str = "candidate",
    name: str = "graph_distance",
    scale: float = C.CANVAS_DIAGONAL,
) -> DataFrame:
    """``pairs`` with the graph distance of two markup columns: the share of primitives that the
    best permutation does not explain.

    Costs are laid out natively, and matrices that a minimum decides are decided there; only
    larger ones reach the assignment.
    """
    primitives = {"_left": X.primitives(reference), "_right": X.primitives(candidate)}
    return primitive_distances(
        pairs.withColumns(primitives), "_left", "_right", name, scale
    ).drop(*primitives)


def primitive_distances(
    pairs: DataFrame, reference: str, candidate: str, name: str, scale: float = C.CANVAS_DIAGONAL
) -> DataFrame:
    """``pairs`` with the permutation-invariant distance of two primitive arrays."""
    if scale <= 0:
        raise ValueError(f"Distances are measured in units of scale, which cannot be {scale}.")
    none = F.array().cast("array<struct<kind: string, coords: array<struct<x: double, y: double>>>>")
    left, right = (F.coalesce(F.col(c), none) for c in (reference, candidate))
    longer = F.greatest(F.size(left), F.size(right))
    large = F.filter("_blocks", lambda b: ~is_small_block(b))
    small = F.aggregate(
        F.filter("_blocks", is_small_block), F.lit(0.0), lambda acc, b: acc + small_block_gain(b)
    )
    saved = F.col("_small") + F.coalesce("_large", F.lit(0.0))
    return (
        pairs.withColumns({"_blocks": cost_blocks(left, right, scale), "_longer": longer})
        .withColumns({"_small": small, "_rest": large})
        .withColumn("_large", large_block_gains(F.when(F.size("_rest") > 0, F.col("_rest"))))
        .withColumn(
            name, F.when(F.col("_longer") == 0, 0.0).otherwise((F.col("_longer") - saved) / F.col("_longer"))
        )
        .drop("_blocks", "_longer", "_small", "_rest", "_large")
    )


def structure_scores(pairs: DataFrame) -> DataFrame:
    """Keyword accuracy, family hit, collapse flag and mean point distance per sample."""
    sides = ("reference", "candidate")
    # Columns of their own: what is used several times is found once.
    measured = pairs.withColumns(
        {
            "predicted_family": X.structural_family(F.col("candidate")),
            **{f"_{side}_points": X.points(side) for side in sides},
            **{
                f"_{side}_keywords": X.keywords_present(F.col(side), C.EVALUATION_KEYWORDS)
                for side in sides
            },
        }
    )
    points, keywords = ([F.col(f"_{side}_{part}") for side in sides] for part in ("points", "keywords"))
    return measured.withColumns(
        {
            "primitive_accuracy": S.keyword_accuracy(*keywords),
            "family_accuracy": S.family_hit(F.col("family"), F.col("predicted_family")),
            "collapsed": S.collapsed_to_segment(F.col("family"), F.col("predicted_family")),
            "coord_mean_error": S.mean_point_distance(*points),
        }
    ).drop(*[f"_{side}_{part}" for side in sides for part in ("points", "keywords")])


def compilation_rates(outcomes: DataFrame, groups=()) -> DataFrame:
    return outcomes.groupBy(*groups).agg(
        F.count_if("is_successful").alias("successes"),
        F.count(F.lit(1)).alias("total"),
        F.avg(F.col("is_successful").cast("double")).alias("compilation_rate"),
    )


def mean_ssim(outcomes: DataFrame, groups=()) -> DataFrame:
    """Both conventions: over compiled samples, and with failures as zero."""
    compiled = F.when(F.col("is_successful"), F.col("ssim"))
    return outcomes.groupBy(*groups).agg(
        F.count(compiled).alias("ssim_samples"),
        F.coalesce(F.avg(compiled), F.lit(0.0)).alias("mean_ssim_compiled"),
        F.avg(F.coalesce(compiled, F.lit(0.0))).alias("mean_ssim_all"),
    )


def ssim_proxy(mean_graph_distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - mean_graph_distance))


def best_candidates(candidates: DataFrame, group: str = "image_id") -> DataFrame:
    """Best of N per image: highest positive score among compiled candidates, earliest on a
    tie; candidate 0 with score 0 when there is none. A partial aggregate, not a window."""
    good = F.col("is_successful") & (F.col("ssim") > 0)
    ranked = F.when(good, F.struct(F.col("ssim"), (-F.col("candidate_no")).alias("_no")))
    best = candidates.groupBy(group).agg(F.max(ranked).alias("_best"))
    return best.select(
        group,
        F.coalesce(-F.col("_best._no"), F.lit(0)).cast("long").alias("candidate_no"),
        F.coalesce(F.col("_best.ssim"), F.lit(0.0)).alias("best_ssim"),
    )


def policy_comparison(results: DataFrame, baseline: str = "greedy") -> DataFrame:
    """Mean SSIM and compile percentage per policy, with the gain over the baseline."""
    per_policy = results.groupBy("policy").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("ssim").alias("mean_ssim"),
        (F.avg(F.col("is_successful").cast("double")) * 100.0).alias("compile_percent"),
    )
    base = F.max(F.when(F.col("policy") == baseline, F.col("mean_ssim"))).over(
        W.partitionBy(F.lit(0))
    )
    return per_policy.withColumn("delta_ssim", F.col("mean_ssim") - base)


def tier_summary(pairs: DataFrame, outcomes: DataFrame, tier: str = "tier") -> DataFrame:
    """The metrics of every tier that has data, one row per tier.

    One scan scores the pairs, one join brings their outcomes (at most one each), one shuffle
    sums up the tiers. A pair without an outcome counts for the texts alone.
    """
    max_order = 4
    r, c = F.col("reference_tokens"), F.col("candidate_tokens")
    scored = graph_distances(tokenized_pairs(pairs)).select(
        tier, "sample_id", "graph_distance",
        ngram_matches(r, c, max_order).alias("_n"),
        token_edit_distance(r, c).alias("token_distance"),
    )
    known = outcomes.select("sample_id", "is_successful", "ssim", F.lit(1).alias("_known"))
    built = F.when(F.col("_known") == 1, F.coalesce("is_successful", F.lit(False)))
    totals = scored.join(known, "sample_id", "left").groupBy(tier).agg(
        F.count(F.lit(1)).alias("samples"),
        *_bleu_sums("_n", max_order),
        F.avg("token_distance").alias("mean_geometric_edit_distance"),
        F.avg("graph_distance").alias("mean_graph_edit_distance"),
        F.count_if(built).alias("successes"),
        F.count("_known").alias("total"),
        F.avg(built.cast("double")).alias("compilation_rate"),
        F.count_if(built).alias("ssim_samples"),
        F.coalesce(F.avg(F.when(built, F.col("ssim"))), F.lit(0.0)).alias("mean_ssim"),
    )
    return totals.select(
        tier, "samples", _bleu_of_sums(max_order).alias("corpus_bleu"),
        "mean_geometric_edit_distance", "mean_graph_edit_distance", "successes", "total",
        "compilation_rate", "ssim_samples", "mean_ssim",
    )
