"""Per-pair scores that need no other row, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from figmill import constants as C


def _distance(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _zipped_distances(reference: Column, candidate: Column) -> Column:
    """Distances of points at the same position; surplus points give no entry."""
    return F.filter(
        F.zip_with(reference, candidate, _distance), lambda d: d.isNotNull()
    )


def compared_points(reference: Column, candidate: Column) -> Column:
    return F.least(F.size(reference), F.size(candidate))


def ordered_coordinate_error(
    reference: Column, candidate: Column, scale: float = C.CANVAS_DIAGONAL
) -> Column:
    """Points paired by position: clamped distance, one per surplus point, over the longer."""
    if scale <= 0:
        raise ValueError(f"Distances are measured in units of scale, which cannot be {scale}.")
    matched = F.transform(
        _zipped_distances(reference, candidate), lambda d: F.least(d / F.lit(scale), F.lit(1.0))
    )
    longer = F.greatest(F.size(reference), F.size(candidate))
    surplus = longer - compared_points(reference, candidate)
    return F.when(longer == 0, F.lit(0.0)).otherwise((_total(matched) + surplus) / longer)


def mean_point_distance(reference: Column, candidate: Column) -> Column:
    """Mean distance of zipped points plus the count difference; the diagonal when a side
    has no point. (Reported elsewhere as an RMSE, which it is not.)"""
    compared = compared_points(reference, candidate)
    mean = _total(_zipped_distances(reference, candidate)) / compared
    return F.when(compared == 0, F.lit(C.CANVAS_DIAGONAL)).otherwise(
        mean + F.abs(F.size(reference) - F.size(candidate))
    )


def token_overlap(reference: Column, candidate: Column) -> Column:
    """Jaccard index of the token sets; two empty sides give 1."""
    union = F.size(F.array_union(reference, candidate))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(reference, candidate)) / union
    )


def keyword_accuracy(reference: Column, candidate: Column) -> Column:
    """Jaccard index of the keyword sets; two empty sides give 0."""
    shared = F.size(F.array_intersect(reference, candidate))
    return shared / F.greatest(F.lit(1), F.size(F.array_union(reference, candidate)))


def family_hit(family: Column, predicted: Column) -> Column:
    hit = (predicted == family) | ((family == C.OOD_FAMILY) & (predicted != "unknown"))
    return hit.cast("double")


def collapsed_to_segment(family: Column, predicted: Column) -> Column:
    return (predicted == "line_segment") & (family != "line_segment")


def bleu(clipped: list[Column], totals: list[Column], reference_length, candidate_length) -> Column:
    """BLEU of corpus-wide counts; zero when any order has no match."""
    order = len(clipped)
    logs = None
    zero = candidate_length == 0
    for hit, total in zip(clipped, totals):
        zero = zero | (hit == 0)
        # nullif keeps the logarithm defined where `zero` already decides.
        term = F.log(F.nullif(hit, F.lit(0).cast("long")) / total)
        logs = term if logs is None else logs + term
    penalty = F.when(candidate_length > reference_length, F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - reference_length / F.nullif(candidate_length, F.lit(0).cast("long")))
    )
    return F.when(zero, F.lit(0.0)).otherwise(penalty * F.exp(logs / order))
