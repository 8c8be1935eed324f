"""End-to-end plans: building, ingesting, assembling and evaluating a corpus."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions import scores as S
from figmill.functions import templates as G
from figmill.functions import text as X
from figmill.functions import tokens as K
from figmill.operators import curate as E
from figmill.operators import encoding as N
from figmill.operators import metrics as M
from figmill.operators.quality import successful_renders
from figmill.sources.scan import numbered_samples
from figmill.sources.staging import stage


def curated_split_counts(
    documents: DataFrame, text: str, order: str, stratum: str, ratio: float, seed: int
) -> DataFrame:
    """Budget, first occurrence, stratified split, counts per stratum."""
    short = documents.filter(X.within_budget(F.col(text)))
    kept = stage(E.first_occurrences(short, text, order, [order, stratum]), "kept")
    split = E.stratified_split(kept, ratio, seed, order, stratum)
    return split.groupBy(stratum).agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "val").alias("val"),
    )


def built_corpus(
    figures: DataFrame, external: DataFrame, outcomes: DataFrame, ratio: float, seed: int
) -> DataFrame:
    """Procedural and external samples, successful renders only, split per stratum."""
    columns = ["sample_id", "stratum", "markup"]
    everything = figures.select(*columns).unionByName(external.select(*columns))
    return E.stratified_split(
        successful_renders(everything, outcomes), ratio, seed, "sample_id", "stratum"
    )


def ingestion_funnel(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents, valid root environments and successful builds, counted in one pass."""
    checked = documents.withColumn("_valid", X.markup_violation(F.col("code")).isNull())
    joined = checked.join(outcomes.select("sample_id", "is_successful"), "sample_id", "left")
    built = F.col("_valid") & F.coalesce("is_successful", F.lit(False))
    return joined.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("_valid").alias("valid"),
        F.count_if(built).alias("built"),
    )


def ingested_pairs(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents that survive the funnel, densely numbered."""
    valid = documents.filter(X.markup_violation(F.col("code")).isNull())
    built = successful_renders(valid, outcomes).withColumn("split", F.lit("all"))
    return numbered_samples(built, "sample_id")


def independent_test_split(
    keys: DataFrame, seed: int, ood_copies: int, train: DataFrame
) -> DataFrame:
    """Eight families and ``ood_copies`` out-of-distribution figures for every key. The seeds are
    salted per part, and what ``train`` holds is left out."""
    slots = [(name, 0) for name in C.FAMILIES] + [(C.OOD_FAMILY, n) for n in range(ood_copies)]
    parts = keys.select(
        "sample_id",
        F.inline(
            F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("copy")) for f, n in slots])
        ),
    )
    salted = F.concat_ws(
        "/", F.lit("test"), "family", F.col("copy").cast("string"), F.col("sample_id").cast("string")
    )
    grammar = F.col("family").isin("composed", C.OOD_FAMILY)
    markup = F.when(grammar, G.compositional_markup(seed, salted)).otherwise(
        G.procedural_markup(F.col("family"), seed, salted)
    )
    drawn = parts.withColumns({"copy": F.col("copy").cast("long"), "markup": markup})
    return E.independent_rows(stage(drawn, "test-split"), train, "markup")


def seed_vocabulary(keys: DataFrame, seed: int) -> DataFrame:
    """Vocabulary of a tagged procedural corpus on the fine grid: every family per key."""
    families = F.array(*[F.lit(name) for name in C.FAMILIES])
    parts = keys.select("sample_id", F.explode(families).alias("family"))
    tagged = K.family_tagged(
        F.col("family"), G.procedural_markup(F.col("family"), seed, F.col("sample_id"))
    )
    # Exploded, so that the pictures are there when their tokens are asked for: Spark does not find a
    # Python function whose argument has a lambda read the variable of one around it, as templates do.
    figures = parts.select(F.explode(F.array(tagged)).alias("markup"))
    return N.build_vocabulary(
        figures.select(K.tokens("markup", step=C.FINE_COORDINATE_STEP).alias("tokens")),
        step=C.FINE_COORDINATE_STEP,
    )


def assembled_tiers(
    tier1: DataFrame, tier2: DataFrame, tier3: DataFrame, ratio: float, seed: int,
    max_length: int = C.MAX_SEQUENCE,
) -> DataFrame:
    """Procedural, compositional and external tiers as one encoded dataset. Tiers 1 and 2 are
    split, tier 3 is all test; the vocabulary comes from the train rows of tiers 1 and 2."""
    split1 = E.stratified_split(tier1, ratio, seed, "sample_id", "stratum")
    split2 = E.stratified_split(tier2, ratio, seed, "sample_id", "stratum")
    columns = ["sample_id", "split", "markup"]
    mixed = E.mixed_tiers(
        {
            "tier1": split1.select(*columns),
            "tier2": split2.select(*columns),
            "tier3": tier3.select("sample_id", F.lit("test").alias("split"), "markup"),
        }
    )
    tokenized = mixed.withColumn("tokens", K.tokens("markup")).drop("markup")
    return N.encode_splits(tokenized, ["tier", "split", "sample_id"], max_length)


def emitted_ids(pairs: DataFrame, vocabulary: DataFrame, max_length: int = C.MAX_SEQUENCE) -> DataFrame:
    """``sample_id, ids`` of the candidates as a decoder emits them: no padding, and no EOS where
    the end tag is missing."""
    tokenized = pairs.select(
        "sample_id", X.contains_text(F.col("candidate"), C.END_PICTURE).alias("ended"),
        K.tokens("candidate").alias("tokens"),
    )
    framed = N.encode(tokenized, vocabulary, ["sample_id", "ended"], max_length=max_length)
    kept = K.without(F.col("ids"), (C.PAD,))
    cut = F.when(F.col("ended"), kept).otherwise(K.without(kept, (C.EOS,)))
    return framed.select("sample_id", cut.alias("ids"))


def diagnostic_records(
    pairs: DataFrame, ids: DataFrame, unordered=C.UNORDERED_FAMILIES
) -> DataFrame:
    """Every per-sample column of the diagnostics run, from predictions, their ids and outcomes.

    Points of the ``unordered`` families are matched, those of others compared in order.
    """
    sane = pairs.join(ids, "sample_id").withColumns(
        {"sanitized": X.sanitized("candidate"), "raw": F.col("candidate")}
    )
    scored = M.coordinate_errors(sane.withColumn("candidate", F.col("sanitized")), unordered)
    scored = M.graph_distances(scored, "reference", "sanitized", "graph_ged")
    predicted = X.structural_family(F.col("sanitized"))
    audit = K.sequence_audit(F.col("ids"))
    return scored.select(
        "family",
        F.col("sample_id").alias("sample_index"),
        "seed",
        "policy",
        F.col("is_successful").alias("compilation_successful"),
        F.when(F.col("is_successful"), F.col("ssim")).otherwise(0.0).alias("ssim"),
        "coordinate_error",
        F.col("compared_points").alias("coordinate_points_compared"),
        X.emitted_commands("sanitized").alias("emitted_primitives"),
        M.token_edit_distance(K.words("reference"), K.words("sanitized")).alias("token_ged"),
        "graph_ged",
        S.token_overlap(K.words("reference"), K.words("sanitized")).alias("token_overlap"),
        predicted.alias("predicted_family"),
        S.collapsed_to_segment(F.col("family"), predicted).alias("is_line_segment_collapsed"),
        audit["total_length"].alias("total_length"),
        audit["length_to_eos"].cast("long").alias("length_to_eos"),
        audit["has_eos"].alias("has_eos"),
        audit["unk_count"].alias("unk_count"),
        X.unbalanced_delimiters(F.col("raw")).alias("unbalanced_delimiters_raw"),
        X.unbalanced_delimiters(F.col("sanitized")).alias("unbalanced_delimiters_sanitized"),
        F.nullif(F.col("log"), F.lit("")).alias("tex_error"),
    )


def diagnostics_input(records: DataFrame) -> DataFrame:
    """Rename detailed records to the columns the diagnostics report aggregates."""
    return records.select(
        "policy", "family", F.col("compilation_successful").alias("is_successful"), "ssim",
        "coordinate_error", F.col("token_ged").alias("token_distance"),
        F.col("graph_ged").alias("graph_distance"), "token_overlap",
        S.family_hit(F.col("family"), F.col("predicted_family")).alias("family_accuracy"),
        F.col("is_line_segment_collapsed").alias("collapsed"), "has_eos", "unk_count",
        "total_length", "length_to_eos",
        F.col("coordinate_points_compared").alias("compared_points"),
    )


def evaluation_scores(pairs: DataFrame) -> DataFrame:
    """The six per-sample metrics the family report averages."""
    scored = M.edit_distances(M.tokenized_pairs(M.structure_scores(pairs)))
    return scored.select(
        "sample_id", "family", "policy",
        F.col("is_successful").cast("double").alias("compilation_rate"),
        F.when(F.col("is_successful"), F.col("ssim")).otherwise(0.0).alias("ssim"),
        "primitive_accuracy", "family_accuracy", "coord_mean_error", "token_distance",
    )
