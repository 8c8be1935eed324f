"""One runnable query per operator, over the whole given tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions import scores as S
from figmill.functions import templates as G
from figmill.functions import text as X
from figmill.functions import tokens as K
from figmill.functions.hashing import fingerprint, hash32
from figmill.operators import curate as E
from figmill.operators import encoding as N
from figmill.operators import grammar, images as I
from figmill.operators import metrics as M
from figmill.operators import quality as Q
from figmill.operators import report as H
from figmill.operators.positions import dense_position, ordered_head
from figmill.plans import corpus as P
from figmill.plans import views as V
from figmill.sources import scan, sink
from figmill.sources.staging import scratch, stage
from figmill.streaming import curation as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = V.SEED


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(column, decimals: int) -> Column:
    """Round for comparison. The nudge moves exact halves off the boundary, where the last
    bit of a sum would decide."""
    column = column if isinstance(column, Column) else F.col(column)
    return F.round(column + 1e-9, decimals)


def r6(column) -> Column:
    return rounded(column, 6)


def joined(column, glue: str = "|") -> Column:
    return F.array_join(column, glue)


def vocabulary_split() -> Column:
    """Train and val of the encoding queries: val holds a family train never sees."""
    held_out = (F.col("family") == "node_arrow") | (F.col("custkey") % 10 == 0)
    return F.when(held_out, "val").otherwise("train")


def tagged_samples(spark, sf) -> DataFrame:
    """``sample_id, split, family, markup`` with the family tag in front."""
    return V.figures(spark, sf).select(
        "sample_id", vocabulary_split().alias("split"), "family",
        K.family_tagged(F.col("family"), F.col("markup")).alias("markup"),
    )


def tokenized_samples(spark, sf) -> DataFrame:
    return tagged_samples(spark, sf).select(
        "sample_id", "split", "family", K.tokens("markup").alias("tokens")
    )


def train_vocabulary(spark, sf) -> DataFrame:
    return N.build_vocabulary(tokenized_samples(spark, sf).filter("split = 'train'"))


def encoded_samples(spark, sf, max_length=C.MAX_SEQUENCE) -> tuple[DataFrame, DataFrame]:
    """Encoded samples with their vocabulary."""
    vocabulary = train_vocabulary(spark, sf)
    samples = tokenized_samples(spark, sf)
    return N.encode(samples, vocabulary, ["sample_id", "split"], max_length=max_length), vocabulary


def split_figures(spark, sf) -> DataFrame:
    return V.figures(spark, sf).withColumn("split", vocabulary_split())


# === Sources and sinks =======================================================================


@query
def a1_shard_scan(spark, sf):
    schema = V.table(spark, sf, "documents").schema
    rows = scan.read_shards(spark, f"{sf}/documents.parquet", 0, 1, schema, max_rows=700)
    return rows.select("doc_id", "scan_pos")


@query
def a2_markup_file_scan(spark, sf):
    folder = scratch(spark, "tex")
    V.tex_docs(spark, sf).select("code").write.option("maxRecordsPerFile", 64).text(folder)
    blocks = scan.document_blocks(scan.read_documents(spark, [folder], "*.txt"))
    return blocks.groupBy("markup").agg(F.count(F.lit(1)).alias("n"))


@query
def a3_pair_reconciliation(spark, sf):
    left = split_figures(spark, sf).filter("cents % 9 <> 0").select("split", "sample_id")
    right = split_figures(spark, sf).filter("cents % 4 <> 0").select("split", "sample_id")
    return scan.pair_report(left, right)


@query
def a4_evaluation_record_scan(spark, sf):
    folder = scratch(spark, "records")
    pairs = V.pairs(spark, sf)
    pairs.select(
        "policy", F.col("family").alias("f"), F.col("policy").alias("p"),
        F.col("candidate").alias("decoded_markup"), "ssim",
        F.col("is_successful").alias("compilation_successful"),
        F.when(F.length("candidate") % 2 == 0, F.size(X.points("candidate"))).alias(
            "coordinate_points_compared"
        ),
        X.emitted_commands("candidate").alias("emitted_primitives"),
        X.unbalanced_delimiters(F.col("candidate")).alias("unbalanced_delimiters_raw"),
    ).write.partitionBy("f", "p").json(folder)
    back = scan.read_evaluations(
        spark, folder, "*.json", r"f=([^/]+)/()p=([^/]+)/", multi_line=False
    )
    return back.groupBy("family", "path_policy", "record_version").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("compilation_successful").alias("compiled"),
        F.sum(F.col("unbalanced_delimiters_raw")["{}"]).alias("unbalanced_braces"),
        F.sum(F.size("emitted_primitives")).alias("commands"),
        F.count_if(F.col("policy") != F.col("path_policy")).alias("policy_conflicts"),
        r6(F.sum("ssim")).alias("ssim_total"),
    ).withColumn("record_version", F.col("record_version").cast("long"))


@query
def a5_split_positions(spark, sf):
    return scan.numbered_samples(split_figures(spark, sf), "sample_id").select(
        "split", "sample_id", "position", "sample_name"
    )


SHARD_SIZE = 500


def total(column):
    return F.aggregate(column, F.lit(0).cast("long"), lambda acc, value: acc + value)


def packed_samples(spark, sf) -> DataFrame:
    """What a shard holds: markup, image bytes, token ids and label of every sample."""
    encoded, _ = encoded_samples(spark, sf)
    pixels = F.array(*[((F.col("cents") + x * 37) % 256).cast("int") for x in range(64)])
    figures = split_figures(spark, sf).select(
        "sample_id", "family", "family_idx", "markup", pixels.alias("pixels")
    )
    return figures.join(encoded, "sample_id")


@query
def a6_shard_packing(spark, sf):
    path = scratch(spark, "shards")
    sink.write_shards(packed_samples(spark, sf), path, SHARD_SIZE)
    return sink.read_written_shards(spark, path).groupBy("split", "shard_id").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.min("sample_id").alias("first_sample"),
        F.max("sample_id").alias("last_sample"),
        F.sum(F.length("markup")).alias("chars"),
        F.sum(total(K.without(F.col("ids"), (C.PAD,)))).alias("id_sum"),  # padding is zero
        F.sum(total("pixels")).alias("pixel_sum"),
        F.sum("family_idx").alias("label_sum"),
    )


def _manifest(spark, sf):
    samples = split_figures(spark, sf).select("sample_id", "split", "family")
    return sink.shard_manifest(sink.sharded(samples, SHARD_SIZE))


@query
def a7_shard_manifest(spark, sf):
    documents = sink.manifest_json(_manifest(spark, sf), 256, C.MAX_SEQUENCE)
    shards = sink.manifest_shards(documents).filter(F.col("split") != sink.MASTER)
    return shards.select(
        "split", "shard_id", "file_name", "num_samples",
        *[F.col("family_counts")[f].alias(f) for f in C.FAMILIES],
    )


@query
def a7_master_manifest(spark, sf):
    documents = sink.manifest_json(_manifest(spark, sf), 256, C.MAX_SEQUENCE)
    heads = sink.manifest_heads(documents)
    master = sink.manifest_shards(documents).filter(F.col("split") == sink.MASTER)
    listed = master.agg(
        F.count(F.lit(1)).alias("listed_shards"), F.sum("num_samples").alias("listed_samples")
    ).withColumn("split", F.lit(sink.MASTER))
    return heads.join(listed, "split", "left").withColumns(
        {n: F.col(n).cast("long") for n in ("image_size", "max_length")}
    )


@query
def a7_manifest_files(spark, sf):
    """Manifests written as one JSON document each, and read again."""
    path = scratch(spark, "manifests")
    sink.write_manifests(_manifest(spark, sf), path, 256, C.MAX_SEQUENCE)
    files = sink.read_manifests(spark, path)
    return files.select(
        "file", "version", "total_samples", F.posexplode("shards").alias("at", "shard")
    ).select(
        "file", "version", "total_samples", F.col("at").cast("long").alias("at"),
        "shard.file_name", "shard.num_samples",
        F.aggregate(F.map_values("shard.family_counts"), F.lit(0).cast("long"), lambda a, n: a + n).alias("family_total"),
    )


@query
def a8_fetched_samples(spark, sf):
    """The samples behind global indices, from the shards on disk."""
    path = scratch(spark, "shards")
    samples = split_figures(spark, sf).select("sample_id", "split", "family", "markup")
    sink.write_shards(samples, path, SHARD_SIZE)
    shards = sink.read_written_shards(spark, path)
    requests = V.orders(spark, sf).select((F.col("sample_id") * 2 - 100).alias("index"))
    located = sink.shard_lookup(sink.shard_manifest(shards), requests)
    return sink.fetched_samples(shards, located, SHARD_SIZE).select(
        "index", "split", "shard_id", "offset", "out_of_range", "sample_id", "family",
        fingerprint(F.col("markup")).alias("fingerprint"),
    )


@query
def a8_shard_lookup(spark, sf):
    # Every third index is asked for twice, by different clients.
    clients = F.explode(F.sequence(F.lit(0), (F.col("sample_id") % 3 == 0).cast("int")))
    requests = V.orders(spark, sf).select(
        (F.col("sample_id") * 2 - 100).alias("index"), clients.alias("client")
    )
    return sink.shard_lookup(_manifest(spark, sf), requests.withColumn("client", F.col("client").cast("long")))


@query
def a9_dataset_manifest(spark, sf):
    return P.curated_split_counts(V.documents(spark, sf), "text", "doc_id", "lang", 0.1, SEED)


@query
def a9_manifest_document(spark, sf):
    """The whole manifest of a build as one JSON document, written and read again."""
    path = scratch(spark, "manifest")
    built = split_figures(spark, sf).filter("cents % 4 <> 0").withColumn(
        "stratum", F.when(F.col("cents") % 10 == 0, "external").otherwise(F.col("family"))
    )
    asked = {"procedural": 20000, "external": 2500}
    sink.write_documents(sink.dataset_manifest(built, asked, SEED, 0.1, True), path)
    found = sink.read_dataset_manifest(spark, path)
    return found.select(
        "seed", "val_ratio", "requested.procedural", "requested.external", "rendered.total",
        "showcase_rendered", F.array_join("fingerprints_sample", ",").alias("fingerprints"),
        F.explode("strata").alias("stratum", "counts"),
    ).select("*", "counts.train", "counts.val").drop("counts")


@query
def a9_manifest_totals(spark, sf):
    attempts = split_figures(spark, sf).withColumn("kept", F.col("cents") % 4 != 0)
    totals = sink.manifest_totals(attempts)
    return totals.withColumn("compile_rate", r6("compile_rate"))


@query
def a9_fingerprint_sample(spark, sf):
    return sink.fingerprint_sample(split_figures(spark, sf), "sample_id", "markup")


@query
def a10_sample_manifest(spark, sf):
    path = scratch(spark, "manifest")
    samples = V.figures(spark, sf).select(
        F.format_string("stage1_sample_%06d", "sample_id").alias("sample_id"),
        F.lit(1).alias("stage"), "family", F.col("cents").alias("seed"), "markup",
        F.array(F.lit(3), F.lit(128), F.lit(128)).alias("tensor_shape"),
        (F.col("cents") / 1000.0).alias("tensor_std"),
        fingerprint(F.col("markup")).alias("image_sha256"),
        (F.col("cents") % 4 != 0).alias("is_successful"),
    )
    sink.write_sample_manifest(samples, path)
    return sink.read_sample_manifest(spark, path).select(
        "sample_id", "family", "seed", "markup", r6("tensor_std").alias("tensor_std"),
        "image_sha256", "compilation_status",
    )


@query
def a11_vocabulary_object(spark, sf):
    """The vocabulary as one JSON object, written and read again."""
    path = scratch(spark, "vocabulary")
    sink.write_vocabulary_object(train_vocabulary(spark, sf), path)
    found = sink.read_vocabulary_object(spark, f"{path}/vocabulary.json")
    return found.select("token", F.col("idx").cast("long").alias("idx"))


@query
def a11_vocabulary_round_trip(spark, sf):
    path = scratch(spark, "vocabulary")
    documents = sink.vocabulary_documents(train_vocabulary(spark, sf))
    sink.write_vocabulary(sink.vocabulary_entries(documents), path)
    return sink.read_vocabulary(spark, path).select("token", F.col("idx").cast("long").alias("idx"))


def _records(spark, sf) -> DataFrame:
    """Records with all points compared in order, which SQL can follow for every row."""
    pairs = V.pairs(spark, sf)
    ids = P.emitted_ids(pairs, train_vocabulary(spark, sf))
    return P.diagnostic_records(pairs, ids, unordered=())


@query
def a12_detailed_csv(spark, sf):
    path = scratch(spark, "csv")
    rows = sink.detailed_rows(_records(spark, sf))
    sink.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query
def a13_family_summary(spark, sf):
    return sink.family_summary_rows(_diagnostics(spark, sf))


@query
def a13_summary_json(spark, sf):
    documents = sink.summary_documents(_diagnostics(spark, sf))
    moments = "struct<mean: double, std: double>"
    schema = (
        f"sample_count bigint, compilation_rate double, ssim {moments}, token_ged {moments}, "
        f"graph_ged {moments}, eos_rate double, unk_rate double, mean_length_to_eos double"
    )
    parsed = documents.select("policy", "family", F.from_json("document", schema).alias("d"))
    return parsed.select(
        "policy", "family", F.col("d.sample_count").alias("sample_count"),
        *[
            r6(f"d.{m}.{part}").alias(f"{m}_{part}")
            for m in ("ssim", "token_ged", "graph_ged")
            for part in ("mean", "std")
        ],
        *[r6(f"d.{c}").alias(c) for c in ("compilation_rate", "eos_rate", "unk_rate", "mean_length_to_eos")],
    )


@query
def a14_multitier_table(spark, sf):
    return H.whole_table(H.multitier_lines(H.seed_statistics(V.runs(spark, sf))), "multitier")


@query
def a14_ablation_table(spark, sf):
    return H.whole_table(H.ablation_body(H.ablation_deltas(_variants(spark, sf))), "ablation")


@query
def a14_markdown_table(spark, sf):
    return H.markdown_lines(H.family_report(_family_metrics(spark, sf)))


def _doc_outcomes(spark, sf) -> DataFrame:
    """A render outcome per document, from the labels: unlabeled documents never built."""
    return V.table(spark, sf, "labels").select(
        F.col("doc_id").alias("sample_id"), (F.col("quality") == 1).alias("is_successful")
    )


def _keyed_docs(spark, sf) -> DataFrame:
    return V.tex_docs(spark, sf).withColumnRenamed("doc_id", "sample_id")


@query
def a15_ingestion_funnel(spark, sf):
    return P.ingestion_funnel(_keyed_docs(spark, sf), _doc_outcomes(spark, sf))


@query
def a15_ingested_pairs(spark, sf):
    return P.ingested_pairs(_keyed_docs(spark, sf), _doc_outcomes(spark, sf)).select(
        "sample_id", "position", "sample_name", fingerprint(F.col("code")).alias("fingerprint")
    )


# === Predicates and gates ====================================================================


@query
def b1_length_budget(spark, sf):
    kept = V.documents(spark, sf).filter(X.within_budget(F.col("text")))
    return kept.select("doc_id", F.length("text").cast("long").alias("chars"))


@query
def b2_root_environment(spark, sf):
    # Some documents have no text.
    docs = V.tex_docs(spark, sf).withColumn("code", F.when(F.col("doc_id") % 11 != 0, F.col("code")))
    return docs.select("doc_id", F.coalesce(X.markup_violation(F.col("code")), F.lit("valid")).alias("violation"))


@query
def b3_package_whitelist(spark, sf):
    names = X.declared_names("code", C.USEPACKAGE_PATTERN)
    docs = V.tex_docs(spark, sf).withColumn("unknown", X.unknown_packages(names))
    return docs.filter(F.size("unknown") > 0).select("doc_id", joined("unknown").alias("unknown"))


@query
def b4_candidate_gates(spark, sf):
    return Q.valid_candidates(V.tex_docs(spark, sf), "code").select("doc_id", "markup")


@query
def b4_candidate_funnel(spark, sf):
    return Q.candidate_funnel(V.tex_docs(spark, sf), "code")


@query
def b5_successful_renders(spark, sf):
    samples = V.figures(spark, sf).select("sample_id", "family", "family_idx")
    return Q.successful_renders(samples, V.outcomes(spark, sf))


@query
def b6_degenerate_images(spark, sf):
    checked = Q.usable_images(V.rasters(spark, sf), V.RASTER_HEIGHT, V.RASTER_WIDTH)
    return checked.withColumn("pixel_std", r6("pixel_std"))


@query
def b7_shard_alignment(spark, sf):
    return Q.shard_alignment(sink.sharded(packed_samples(spark, sf), SHARD_SIZE))


@query
def b8_vocabulary_invariants(spark, sf):
    return Q.vocabulary_invariants(train_vocabulary(spark, sf))


def _stage_plan(spark, sf) -> DataFrame:
    """Families per stage as they occur in the orders, some under a name nobody knows."""
    name = F.when(F.col("custkey") % 97 == 0, "freeform").otherwise(F.col("family"))
    rows = V.figures(spark, sf).select(F.col("priority").alias("stage"), name.alias("family"))
    return rows.groupBy("stage", "family").agg(F.count(F.lit(1)).alias("samples"))


@query
def b9_unknown_stage_families(spark, sf):
    return Q.unknown_families(_stage_plan(spark, sf))


@query
def b9_planned_total(spark, sf):
    return Q.planned_total(_stage_plan(spark, sf))


@query
def b10_run_audit(spark, sf):
    outcomes = V.outcomes(spark, sf)
    evidence = outcomes.groupBy(F.col("image_id").alias("run_id")).agg(
        F.sum(F.length("log")).alias("log_bytes"),
        (F.count_if("is_successful") > 5).alias("checkpoint_exists"),
        (F.max("ssim") > 0.9).alias("checkpoint_restorable"),
        F.count_if(F.col("tier") == "tier3").alias("test_rows"),
    )
    return Q.run_audit(evidence)


@query
def b11_tags_present(spark, sf):
    return V.pairs(spark, sf).groupBy("policy").agg(
        F.count_if(X.tags_present(F.col("candidate"))).alias("complete"),
        r6(F.avg(X.tags_present(F.col("candidate")).cast("int"))).alias("rate"),
    )


# === Extraction and text =====================================================================


@query
def c1_picture_blocks(spark, sf):
    docs = V.tex_docs(spark, sf)
    return docs.select("doc_id", F.posexplode(X.picture_blocks("code")).alias("p", "markup")).select(
        "doc_id", F.col("p").cast("long").alias("block_no"), "markup"
    )


@query
def c2_first_picture(spark, sf):
    return V.tex_docs(spark, sf).select("doc_id", X.first_picture("code").alias("markup"))


@query
def c3_self_contained_figure(spark, sf):
    return V.tex_docs(spark, sf).select("doc_id", X.self_contained_figure("code").alias("figure"))


@query
def c4_declared_packages(spark, sf):
    return V.tex_docs(spark, sf).select("doc_id", joined(X.declared_packages("code")).alias("packages"))


@query
def c5_required_packages(spark, sf):
    return V.tex_docs(spark, sf).select(
        "doc_id", joined(X.required_packages(F.col("code"))).alias("packages")
    )


def _libraries() -> Column:
    """None, or the rich bundle, by document."""
    bundle = F.array(*[F.lit(x) for x in C.TIKZ_LIBRARIES])
    return F.when(F.col("doc_id") % 2 == 0, bundle).otherwise(F.array().cast("array<string>"))


@query
def c6_preamble(spark, sf):
    text = X.preamble(X.declared_packages("code"), _libraries())
    return V.tex_docs(spark, sf).select("doc_id", text.alias("preamble"))


@query
def c7_standalone_document(spark, sf):
    text = X.standalone_document(F.col("code"), X.required_packages(F.col("code")), _libraries())
    return V.tex_docs(spark, sf).select(
        "doc_id", F.length(text).cast("long").alias("chars"), fingerprint(text).alias("fingerprint")
    )


@query
def c8_build_log_triage(spark, sf):
    failed = V.outcomes(spark, sf).filter(~F.col("is_successful"))
    return failed.groupBy(
        X.failure_kind("log").alias("failure_kind"),
        F.coalesce(X.missing_package("log"), F.lit("-")).alias("package"),
    ).agg(F.count(F.lit(1)).alias("failures"))


@query
def c9_fingerprints(spark, sf):
    return V.documents(spark, sf).select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


@query
def c10_sanitized(spark, sf):
    return V.pairs(spark, sf).select("sample_id", X.sanitized("candidate").alias("markup"))


@query
def c11_cleaned(spark, sf):
    # Predicted markup is spaced token by token, which is what the rewrites undo.
    spaced = joined(K.tokens("candidate"), "  ")
    return V.pairs(spark, sf).select("sample_id", X.cleaned(spaced).alias("markup"))


@query
def c12_unbalanced_delimiters(spark, sf):
    gaps = X.unbalanced_delimiters(F.col("candidate"))
    return V.pairs(spark, sf).select(
        "sample_id",
        *[gaps[k].cast("long").alias(n) for k, n in (("()", "parens"), ("[]", "brackets"), ("{}", "braces"))],
    )


@query
def c13_keywords(spark, sf):
    return V.pairs(spark, sf).select(
        "sample_id",
        joined(X.keywords_present(F.col("candidate"), C.EVALUATION_KEYWORDS), " ").alias("evaluation"),
        joined(X.keywords_present(F.col("candidate"), C.DIAGNOSTIC_KEYWORDS), " ").alias("diagnostic"),
    )


@query
def c14_emitted_commands(spark, sf):
    return V.pairs(spark, sf).select("sample_id", joined(X.emitted_commands("candidate")).alias("commands"))


@query
def c15_structural_family(spark, sf):
    predicted = X.structural_family(F.col("candidate"))
    return V.pairs(spark, sf).groupBy("family", predicted.alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def c16_points(spark, sf):
    figures = V.figures(spark, sf).select("sample_id", F.posexplode(X.points("markup")).alias("p", "at"))
    return figures.select("sample_id", F.col("p").cast("long").alias("pos"), "at.x", "at.y")


@query
def c17_primitives(spark, sf):
    parsed = V.pairs(spark, sf).select("sample_id", F.posexplode(X.primitives("candidate")).alias("p", "s"))
    points = parsed.select(
        "sample_id", F.col("p").cast("long").alias("pos"), F.col("s.kind").alias("kind"),
        F.posexplode_outer("s.coords").alias("point", "c"),
    )
    return points.select(
        "sample_id", "pos", "kind", F.col("point").cast("long").alias("point"), "c.x", "c.y"
    )


@query
def c18_picture_wrap_and_body(spark, sf):
    body = G.picture_body(F.col("markup"))
    return V.figures(spark, sf).select(
        "sample_id", body.alias("body"), (G.wrap_picture(body) == F.col("markup")).alias("round_trip")
    )


# === Tokens and encoding =====================================================================


def _measures(spark, sf) -> DataFrame:
    """Signed measures of every line item, some outside the canvas."""
    items = V.table(spark, sf, "lineitem")
    return items.select(
        (F.col("l_quantity") / 4.0 - 6.0 - F.col("l_discount")).alias("x"),
        (F.col("l_tax") * 100.0 - F.col("l_quantity") / 5.0).alias("y"),
    )


@query
def d1_quantized_scalars(spark, sf):
    coarse = K.number_text(K.quantized(F.col("x")))
    fine = K.number_text(K.quantized(F.col("x"), step=C.FINE_COORDINATE_STEP))
    return _measures(spark, sf).groupBy(coarse.alias("coarse"), fine.alias("fine")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def d2_quantized_points(spark, sf):
    point = K.quantized_point(F.struct("x", "y"))
    return _measures(spark, sf).select(point.alias("p")).groupBy(
        F.col("p.x").alias("qx"), F.col("p.y").alias("qy")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def d3_grid_coverage(spark, sf):
    counts = N.token_counts(tokenized_samples(spark, sf))
    bins = N.coordinate_bins(counts)
    return bins.join(counts, "token", "left").select(
        "bin", "token", F.coalesce("occurrences", F.lit(0).cast("long")).alias("occurrences")
    )


@query
def d3_fine_grid_coverage(spark, sf):
    step = C.FINE_COORDINATE_STEP
    counts = N.token_counts(V.pairs(spark, sf).select(K.tokens("candidate", step=step).alias("tokens")))
    return N.coordinate_bins(counts, step).join(counts, "token", "left").select(
        "bin", "token", F.coalesce("occurrences", F.lit(0).cast("long")).alias("occurrences")
    )


@query
def d4_tokens(spark, sf):
    return V.pairs(spark, sf).select(
        "sample_id", joined(K.tokens("candidate"), " ").alias("quantized"),
        F.size(K.tokens("candidate", quantize=False)).cast("long").alias("raw_tokens"),
    )


@query
def d5_vocabulary(spark, sf):
    return train_vocabulary(spark, sf).select("token", F.col("idx").cast("long").alias("idx"))


@query
def d6_encoded(spark, sf):
    encoded, _ = encoded_samples(spark, sf)
    return encoded.select("sample_id", joined("ids", " ").alias("ids"))


@query
def d6_truncated(spark, sf):
    encoded, _ = encoded_samples(spark, sf, max_length=48)
    return encoded.select(
        "sample_id", joined("ids", " ").alias("ids"),
        (~F.array_contains("ids", C.EOS)).alias("truncated"),
    )


@query
def d7_split_encoding(spark, sf):
    encoded = N.encode_splits(tokenized_samples(spark, sf), ["sample_id", "split"])
    unknown = F.size(F.filter("ids", lambda t: t == C.UNK))
    return encoded.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(unknown).alias("unknown_ids"),
        F.max(F.size("ids")).cast("long").alias("length"),
    )


@query
def d8_decoded(spark, sf):
    encoded, vocabulary = encoded_samples(spark, sf)
    return N.decode(encoded, vocabulary, ["sample_id"])


@query
def d9_predicted_markup(spark, sf):
    encoded, vocabulary = encoded_samples(spark, sf)
    return N.predicted_markup(encoded, vocabulary, ["sample_id"]).select(
        "sample_id", "markup", joined("packages").alias("packages")
    )


@query
def d10_family_tagged(spark, sf):
    return tagged_samples(spark, sf).select("sample_id", "markup")


@query
def d11_teacher_forcing(spark, sf):
    encoded, _ = encoded_samples(spark, sf)
    return encoded.select(
        "sample_id", joined(K.decoder_input(F.col("ids")), " ").alias("inputs"),
        joined(K.decoder_target(F.col("ids")), " ").alias("targets"),
    )


@query
def d12_word_dropout(spark, sf):
    encoded, _ = encoded_samples(spark, sf)
    kept = K.word_dropout(K.decoder_input(F.col("ids")), SEED, F.col("sample_id"))
    return encoded.select("sample_id", joined(kept, " ").alias("inputs"))


@query
def d13_token_class_mass(spark, sf):
    return N.class_mass(tokenized_samples(spark, sf)).withColumn("weight_mass", r6("weight_mass"))


@query
def d14_ordinal_targets(spark, sf):
    # Weights under 1e-9 round to zero on either side, so the full band is compared.
    targets = N.ordinal_targets(train_vocabulary(spark, sf))
    return targets.groupBy("target").agg(
        F.count_if(F.col("weight") > 1e-12).alias("support"),
        r6(F.max("weight")).alias("peak"),
        r6(F.sum(F.col("weight") * F.col("token").cast("double"))).alias("mean_value"),
    )


@query
def d15_sequence_audit(spark, sf):
    encoded, _ = encoded_samples(spark, sf)
    return encoded.select(
        "sample_id", *[c.cast("long" if "_" in n and not n.startswith("has") else "boolean").alias(n)
                       for n, c in K.sequence_audit(F.col("ids")).items()]
    )


def _emitted(spark, sf) -> DataFrame:
    """Predicted tokens with their end, as a decoder would emit them."""
    sequence = F.concat(
        K.tokens(K.family_tagged(F.col("family"), F.col("candidate"))), F.array(F.lit("<EOS>"))
    )
    return V.pairs(spark, sf).select("sample_id", sequence.alias("tokens"))


@query
def d16_grammar_audit(spark, sf):
    broken = grammar.admissibility(_emitted(spark, sf), ["sample_id"])
    return broken.withColumn("pos", F.col("pos").cast("long"))


@query
def d16_grammar_violations(spark, sf):
    return grammar.violations_by_rule(_emitted(spark, sf))


@query
def d17_batch_bounds(spark, sf):
    numbered = dense_position(V.documents(spark, sf).select("doc_id"), F.col("doc_id"))
    return E.batch_bounds(numbered, "position", 64)


@query
def d18_reference_round_trip(spark, sf):
    encoded, vocabulary = encoded_samples(spark, sf)
    return N.reference_tokens(encoded, vocabulary, ["sample_id"]).select(
        "sample_id", joined("tokens", " ").alias("tokens")
    )


# === Dedup, splits, sampling =================================================================


@query
def e1_deduplicated(spark, sf):
    return E.first_occurrences(V.documents(spark, sf), "text", "doc_id", ["doc_id", "lang"])


@query
def e2_deduplicated_by_block(spark, sf):
    blocks = V.tex_docs(spark, sf).withColumn("markup", X.first_picture("code"))
    unique = E.first_occurrences(blocks.filter("markup is not null"), "markup", "doc_id")
    return unique.select("doc_id", fingerprint(F.col("code")).alias("fingerprint"))


MAX_ROWS, CANDIDATE_CAP, TARGET = 5000, 300, 100


def _candidates(spark, sf) -> DataFrame:
    return E.curated_candidates(V.tex_docs(spark, sf), "code", "doc_id", MAX_ROWS, CANDIDATE_CAP)


@query
def e3_candidate_scan(spark, sf):
    return _candidates(spark, sf).select("doc_id", "markup")


@query
def e4_successful_head(spark, sf):
    candidates = _candidates(spark, sf).withColumn("sample_id", F.col("doc_id"))
    kept = E.successful_head(candidates, _doc_outcomes(spark, sf), TARGET, "doc_id")
    return kept.select("doc_id", "markup")


@query
def e5_random_split(spark, sf):
    return E.random_split(V.documents(spark, sf).select("doc_id"), 0.1, SEED, "doc_id")


@query
def e6_stratified_split(spark, sf):
    rows = V.documents(spark, sf).select("doc_id", "lang")
    return E.stratified_split(rows, 0.1, SEED, "doc_id", "lang")


@query
def e7_tenth_split(spark, sf):
    return E.tenth_split(V.documents(spark, sf).select("doc_id"), SEED, "doc_id")


@query
def e7_stage_split(spark, sf):
    return E.stage_split(V.documents(spark, sf).select("doc_id"), SEED, "doc_id")


@query
def e8_banded_split(spark, sf):
    rows = V.figures(spark, sf).select("sample_id", "family")
    return E.banded_split(rows, 1000, SEED, "sample_id", "family").filter("split is not null")


def _quota_rows(spark, sf) -> DataFrame:
    # One family has no valid row.
    valid = (F.col("cents") % 4 == 0) & (F.col("family") != C.FAMILIES[2])
    rows = V.figures(spark, sf).select("sample_id", "family", valid.alias("is_valid"))
    return E.quota_fill(rows, 500, "family", "sample_id")


@query
def e9_quota_fill(spark, sf):
    return _quota_rows(spark, sf).select("sample_id", "family")


@query
def e9_quota_shortfall(spark, sf):
    return E.quota_shortfall(_quota_rows(spark, sf), 500, "family", C.FAMILIES)


@query
def e10_first_valid_attempt(spark, sf):
    seeds = V.orders(spark, sf).select("sample_id", F.col("cents").alias("seed"))
    attempts = E.retry_seeds(seeds)
    valid = V.attempt_is_valid(F.col("sample_id"), F.col("attempt"))
    return E.first_valid_attempt(attempts.withColumn("is_valid", valid))


@query
def e11_curriculum_draws(spark, sf):
    # Three draws per figure, so that passes repeat; one family has no figures.
    pool = V.figures(spark, sf).filter(F.col("family") != C.FAMILIES[1]).select("sample_id", "family")
    times = F.explode(F.sequence(F.lit(0), F.lit(2)))
    draws = V.orders(spark, sf).select("sample_id", times.alias("k")).select(
        (F.col("sample_id") * 3 + F.col("k")).alias("draw_id")
    )
    return E.curriculum_draws(pool, draws, C.STAGES[0][3], SEED)


@query
def e12_round_robin(spark, sf):
    numbered = dense_position(V.documents(spark, sf).select("doc_id"), F.col("doc_id"))
    return E.round_robin_families(numbered, "position", C.FAMILIES[:5], SEED).select(
        "doc_id", "family", "seed"
    )


@query
def e13_mixed_tiers(spark, sf):
    tiers = {
        "tier1": V.figures(spark, sf).select("sample_id", "markup"),
        "tier2": V.compositional(spark, sf),
    }
    return E.mixed_tiers(tiers).groupBy("tier").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.length("markup")).alias("chars")
    )


def _split_texts(spark, sf):
    rows = V.documents(spark, sf)
    split = E.stratified_split(rows, 0.1, SEED, "doc_id", "lang")
    return split.filter("split = 'val'"), split.filter("split = 'train'")


@query
def e14_leaked_rows(spark, sf):
    test, train = _split_texts(spark, sf)
    return E.leaked_rows(test, train, "text").select("doc_id")


@query
def e14_independent_rows(spark, sf):
    test, train = _split_texts(spark, sf)
    return E.independent_rows(test, train, "text").select("doc_id")


@query
def e15_replicated(spark, sf):
    return E.replicated(V.documents(spark, sf).select("doc_id"), 3).groupBy("copy").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("doc_sum")
    ).withColumn("copy", F.col("copy").cast("long"))


@query
def e16_evaluation_head(spark, sf):
    return ordered_head(V.figures(spark, sf), 200, "sample_id").select("sample_id", "family")


# === Generation ==============================================================================


def _family_query(name: str) -> Query:
    def build(spark, sf):
        return V.spread(V.orders(spark, sf), "sample_id").select(
            "sample_id", G.family_markup(name, SEED, F.col("sample_id")).alias("markup")
        )

    return build


for _number, _name in enumerate(C.FAMILIES, start=1):
    QUERIES[f"g{_number}_{_name}"] = _family_query(_name)


@query
def g9_procedural_corpus(spark, sf):
    return V.procedural_figures(spark, sf).select("sample_id", "family_idx", "family", "markup")


@query
def g10_grammar_scopes(spark, sf):
    body = G.picture_body(F.col("markup"))
    return V.compositional_figures(spark, sf).select(
        "sample_id", F.posexplode(F.split(body, "\n")).alias("p", "scope")
    ).select("sample_id", F.col("p").cast("long").alias("scope_no"), "scope")


@query
def g11_compositional_figures(spark, sf):
    return V.compositional_figures(spark, sf).select(
        "sample_id", "markup", X.within_budget(F.col("markup")).alias("in_budget")
    )


@query
def g12_independent_test_split(spark, sf):
    keys = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    train = V.figures(spark, sf).select("markup")
    return P.independent_test_split(V.spread(keys, "sample_id"), SEED, ood_copies=3, train=train)


@query
def g13_seed_vocabulary(spark, sf):
    keys = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"))
    return P.seed_vocabulary(V.spread(keys, "sample_id"), SEED).select("token", F.col("idx").cast("long").alias("idx"))


@query
def g14_tier_assembly(spark, sf):
    tier1 = V.figures(spark, sf).select("sample_id", F.col("family_idx").alias("stratum"), "markup")
    tier2 = V.compositional(spark, sf).withColumn("stratum", F.lit(C.COMPOSITIONAL_STRATUM))
    tier3 = Q.valid_candidates(_keyed_docs(spark, sf), "code").select("sample_id", "markup")
    encoded = P.assembled_tiers(tier1, tier2, tier3, 0.1, SEED)
    return encoded.groupBy("tier", "split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(total(K.without(F.col("ids"), (C.PAD,)))).alias("id_sum"),  # padding is zero
        F.sum(F.size("ids") - F.size(K.without(F.col("ids"), (C.UNK,)))).alias("unknown_ids"),
    )


@query
def g14_corpus_build(spark, sf):
    figures = V.figures(spark, sf).select("sample_id", F.col("family_idx").alias("stratum"), "markup")
    offset = F.lit(1_000_000_000_000)
    external = Q.valid_candidates(V.tex_docs(spark, sf), "code").select(
        (F.col("doc_id") + offset).alias("sample_id"),
        F.lit(C.EXTERNAL_STRATUM).cast("long").alias("stratum"), "markup",
    )
    docs = _doc_outcomes(spark, sf).withColumn("sample_id", F.col("sample_id") + offset)
    outcomes = V.outcomes(spark, sf).select("sample_id", "is_successful").unionByName(docs)
    built = P.built_corpus(figures, external, outcomes, 0.1, SEED)
    return sink.split_manifest(built, "stratum")


# === Metrics =================================================================================


@query
def m1_corpus_bleu(spark, sf):
    scores = M.corpus_bleu(M.tokenized_pairs(V.pairs(spark, sf)), ["policy"])
    return scores.withColumn("corpus_bleu", r6("corpus_bleu"))


@query
def m1_corpus_bleu_text(spark, sf):
    chats = V.chats(spark, sf).withColumns(
        {"r": K.words("reference"), "c": K.words("candidate"), "long_turn": F.col("turn") > 1}
    )
    scores = M.corpus_bleu(chats, ["long_turn"], 2, "r", "c")
    return scores.withColumn("corpus_bleu", r6("corpus_bleu"))


@query
def m2_token_edit_distance(spark, sf):
    scored = M.edit_distances(M.tokenized_pairs(V.pairs(spark, sf)))
    return scored.select("sample_id", r6("token_distance").alias("token_distance"))


@query
def m2_letter_edit_distance(spark, sf):
    parts = V.table(spark, sf, "part")
    letters = parts.select(
        "p_partkey", F.split("p_name", "").alias("r"),
        F.split(F.concat_ws(" ", F.lower("p_type"), "p_name"), "").alias("c"),
    )
    return M.edit_distances(letters, "r", "c").select(
        "p_partkey", r6("token_distance").alias("token_distance")
    )


@query
def m3_batch_evaluation(spark, sf):
    scores = M.batch_evaluation(V.pairs(spark, sf), ["policy"])
    return scores.withColumns(
        {"corpus_bleu": r6("corpus_bleu"), "mean_token_distance": r6("mean_token_distance")}
    )


@query
def m4_ordered_coordinate_error(spark, sf):
    r, c = X.points("reference"), X.points("candidate")
    return V.pairs(spark, sf).select(
        "sample_id", S.compared_points(r, c).cast("long").alias("compared"),
        r6(S.ordered_coordinate_error(r, c)).alias("coordinate_error"),
    )


@query
def m5_unordered_coordinate_error(spark, sf):
    """Both families without an order: nodes against other nodes, compositions rearranged."""
    scored = M.coordinate_errors(V.unordered_pairs(spark, sf))
    return scored.select(
        "sample_id", "family", "matching", "compared_points",
        r6("coordinate_error").alias("coordinate_error"),
    )


@query
def m6_mean_point_distance(spark, sf):
    error = S.mean_point_distance(X.points("reference"), X.points("candidate"))
    return V.pairs(spark, sf).select("sample_id", r6(error).alias("coord_mean_error"))


@query
def m7_graph_edit_distance(spark, sf):
    return M.graph_distances(V.pairs(spark, sf)).select(
        "sample_id", r6("graph_distance").alias("graph_distance")
    )


@query
def m8_mean_graph_distance(spark, sf):
    return M.graph_distances(V.pairs(spark, sf)).groupBy("family").agg(
        F.count(F.lit(1)).alias("samples"), r6(F.avg("graph_distance")).alias("mean_graph_distance")
    )


@query
def m9_token_overlap(spark, sf):
    return V.chats(spark, sf).select(
        "conv_id", "turn",
        r6(S.token_overlap(K.words("reference"), K.words("candidate"))).alias("token_overlap"),
    )


@query
def m10_primitive_accuracy(spark, sf):
    return M.structure_scores(V.pairs(spark, sf)).select(
        "sample_id", r6("primitive_accuracy").alias("primitive_accuracy")
    )


@query
def m11_family_accuracy(spark, sf):
    ood = F.when(F.col("sample_id") % 5 == 0, C.OOD_FAMILY).otherwise(F.col("family"))
    scored = M.structure_scores(V.pairs(spark, sf).withColumn("family", ood))
    return scored.groupBy("family").agg(r6(F.avg("family_accuracy")).alias("family_accuracy"))


@query
def m12_collapse_rate(spark, sf):
    scored = M.structure_scores(V.pairs(spark, sf))
    others = F.count_if(F.col("family") != "line_segment")
    return scored.groupBy("policy").agg(
        F.count_if("collapsed").alias("collapsed"),
        r6(F.count_if("collapsed") / F.greatest(F.lit(1), others)).alias("collapse_rate"),
    )


@query
def m13_compilation_rate(spark, sf):
    rates = M.compilation_rates(V.outcomes(spark, sf), ["policy"])
    return rates.withColumn("compilation_rate", r6("compilation_rate"))


def _raster_pairs(spark, sf) -> DataFrame:
    """Every raster against a dimmed copy whose lines shift by the label."""
    # Images of three widths, one of them under the window.
    width = F.when(F.col("image_id") % 7 == 3, 8).when(F.col("image_id") % 2 == 1, 40).otherwise(
        V.RASTER_WIDTH
    )
    unit = I.normalized(V.rasters(spark, sf)).withColumn("pixels", F.slice("pixels", F.lit(1), width))
    other = F.transform("pixels", lambda p: p * 0.9 + F.col("label") / 100.0)
    return unit.select("image_id", "channel", "y", F.col("pixels").alias("a"), other.alias("b"))


@query
def m14_ssim(spark, sf):
    scores = I.ssim(_raster_pairs(spark, sf))
    return scores.withColumn("ssim", r6("ssim"))


@query
def m15_mean_ssim(spark, sf):
    scores = M.mean_ssim(V.outcomes(spark, sf), ["policy"])
    return scores.withColumns(
        {n: r6(n) for n in ("mean_ssim_compiled", "mean_ssim_all")}
    )


@query
def m16_ssim_proxy(spark, sf):
    means = M.graph_distances(V.pairs(spark, sf)).groupBy("policy").agg(
        F.avg("graph_distance").alias("d")
    )
    return means.select("policy", r6(M.ssim_proxy(F.col("d"))).alias("mean_ssim"))


@query
def m17_best_of_n(spark, sf):
    candidates = V.outcomes(spark, sf).withColumnRenamed("sample_id", "candidate_no")
    return M.best_candidates(candidates).withColumn("best_ssim", r6("best_ssim"))


@query
def m18_policy_comparison(spark, sf):
    table = M.policy_comparison(V.outcomes(spark, sf))
    return table.withColumns({n: r6(n) for n in ("mean_ssim", "compile_percent", "delta_ssim")})


@query
def m19_tier_summary(spark, sf):
    pairs = V.pairs(spark, sf)
    rows = M.tier_summary(
        pairs.select("sample_id", "tier", "family", "reference", "candidate"),
        V.outcomes(spark, sf).select("sample_id", "is_successful", "ssim"),
    )
    return rows.withColumns({n: r6(n) for n in C.TIER_METRICS})


# === Reports =================================================================================


def _family_metrics(spark, sf) -> DataFrame:
    return P.evaluation_scores(V.pairs(spark, sf))


@query
def h1_family_report(spark, sf):
    report = H.family_report(_family_metrics(spark, sf))
    return report.select(
        "family", "samples", *[r6(c).alias(c) for c in report.columns if c.startswith("mean_")]
    )


@query
def h1_evaluation_report(spark, sf):
    report = H.family_report(P.evaluation_scores(V.pairs(spark, sf)))
    return report.select(
        "family", "samples", *[r6(c).alias(c) for c in report.columns if c.startswith("mean_")]
    )


def _diagnostics(spark, sf) -> DataFrame:
    return H.diagnostics_report(P.diagnostics_input(_records(spark, sf)))


@query
def h2_diagnostics_report(spark, sf):
    report = _diagnostics(spark, sf)
    exact = ("policy", "family", "samples", "points_compared")
    return report.select(*[c if c in exact else r6(c).alias(c) for c in report.columns])


@query
def h3_seed_statistics(spark, sf):
    stats = H.seed_statistics(V.runs(spark, sf))
    return stats.withColumns({"mean": r6("mean"), "std": r6("std")})


@query
def h4_mean_std_text(spark, sf):
    stats = H.seed_statistics(V.runs(spark, sf))
    return stats.select("model", "tier", "metric", H.mean_std_text(F.col("mean"), F.col("std")).alias("text"))


def _tier_metrics(spark, sf) -> DataFrame:
    runs = V.runs(spark, sf).unpivot(["model", "tier", "seed"], list(C.TIER_METRICS), "metric", "value")
    return runs.groupBy("tier", "metric").agg(F.avg("value").alias("value"))


@query
def h5_generalization_gap(spark, sf):
    # One metric is missing in one tier.
    metrics = _tier_metrics(spark, sf).filter("not (tier = 'tier2' and metric = 'mean_ssim')")
    return H.generalization_gap(metrics, C.TIER_METRICS).withColumn("gap", r6("gap"))


@query
def h6_baseline_deltas(spark, sf):
    runs = V.runs(spark, sf).unpivot(["model", "tier", "seed"], list(C.TIER_METRICS), "metric", "value")
    baseline = runs.filter("tier = 'tier1' and model = 'greedy'").groupBy("metric").agg(
        F.avg("value").alias("value")
    )
    model = runs.filter("model = 'beam'").groupBy("tier", "metric").agg(F.avg("value").alias("value"))
    return H.baseline_deltas(model, baseline).withColumn("delta", r6("delta"))


def _variants(spark, sf) -> DataFrame:
    name = F.when(F.col("model") == "greedy", "Full").otherwise(F.concat(F.lit("No "), F.col("model")))
    metrics = ("corpus_bleu", "mean_graph_edit_distance", "compilation_rate", "mean_ssim")
    return V.runs(spark, sf).filter("tier = 'tier3'").groupBy(name.alias("variant")).agg(
        *[F.avg(m).alias(m) for m in metrics]
    )


@query
def h7_ablation_deltas(spark, sf):
    deltas = H.ablation_deltas(_variants(spark, sf))
    return deltas.select("variant", *[r6(c).alias(c) for c in deltas.columns if c != "variant"])


@query
def h8_best_epochs(spark, sf):
    epochs = V.telemetry(spark, sf)
    per_stage = H.best_so_far(epochs, "stage", "epoch", "val_loss")
    return per_stage.select("stage", "epoch", r6("val_loss").alias("val_loss"), "is_best")


@query
def h9_stage_summary(spark, sf):
    summary = H.stage_summary(V.telemetry(spark, sf), "stage", "epoch", "val_loss")
    return summary.withColumn("best_val_loss", r6("best_val_loss"))


def _collected(spark, sf) -> DataFrame:
    events = V.table(spark, sf, "events")
    return events.select(
        F.col("event_type").alias("family"), V.epoch_hours(F.col("ts")).alias("hour"),
        V.epoch_seconds(F.col("ts")).alias("at_seconds"),
    )


@query
def h10_progress(spark, sf):
    return H.progress(_collected(spark, sf), "family", "hour")


@query
def h10_throughput(spark, sf):
    rates = H.throughput(_collected(spark, sf), "family", 2000)
    return rates.withColumn("samples_per_sec", r6("samples_per_sec"))


@query
def h11_telemetry_changes(spark, sf):
    changes = H.telemetry_changes(V.telemetry(spark, sf), "stage", "epoch", ["val_loss", "samples"])
    return changes.select(
        "stage", "epoch", "samples_change", r6("val_loss_change").alias("val_loss_change")
    )


@query
def h12_contingency(spark, sf):
    return H.contingency(split_figures(spark, sf), "family", "split", ("train", "val", "test"))


@query
def h13_epoch_losses(spark, sf):
    steps = V.table(spark, sf, "events").select(
        V.epoch_hours(F.col("ts")).alias("epoch"), F.col("value").alias("loss")
    )
    return H.epoch_losses(steps).withColumn("mean_loss", r6("mean_loss"))


# === Images ==================================================================================


def _flat(lines: DataFrame, decimals: int = 6) -> DataFrame:
    """One row per line with a readable digest of its pixels."""
    total = F.aggregate("pixels", F.lit(0.0), lambda a, p: a + p)
    weighted = F.aggregate(
        F.transform("pixels", lambda p, x: p * (x + 1)), F.lit(0.0), lambda a, p: a + p
    )
    return lines.select(
        "image_id", F.col("channel").cast("long").alias("channel"), F.col("y").cast("long").alias("y"),
        F.size("pixels").cast("long").alias("width"), rounded(total, decimals).alias("total"),
        rounded(weighted, decimals).alias("weighted"),
    )


@query
def i1_normalized(spark, sf):
    return _flat(I.normalized(V.rasters(spark, sf)))


@query
def i2_three_channels(spark, sf):
    return _flat(I.three_channels(V.rasters(spark, sf)))


@query
def i3_resized(spark, sf):
    return _flat(I.resized(V.rasters(spark, sf), 24, 48))


@query
def i3_resized_bytes(spark, sf):
    return _flat(I.resized(V.rasters(spark, sf), 8, 100, to_bytes=True))


@query
def i4_encoder_input(spark, sf):
    return _flat(I.encoder_input(V.rasters(spark, sf), 8, 32))


@query
def i5_noisy(spark, sf):
    return _flat(I.noisy(I.normalized(V.rasters(spark, sf)), 0.03, SEED), 5)


def _batched(spark, sf) -> DataFrame:
    lines = I.normalized(V.rasters(spark, sf))
    return lines.withColumn("batch_id", F.floor(F.col("image_id") / 4).cast("long"))


@query
def i6_contrasted(spark, sf):
    return _flat(I.contrasted(_batched(spark, sf), 1.3, "batch_id"))


@query
def i7_blurred(spark, sf):
    return _flat(I.blurred(I.normalized(V.rasters(spark, sf))))


@query
def i8_augmented(spark, sf):
    return _flat(I.maybe_augmented(_batched(spark, sf), SEED, "batch_id", 0.5, alpha=0.8), 5)


# === Streams =================================================================================


@query
def s1_incremental_curation(spark, sf):
    folder = scratch(spark, "stream-in")
    V.tex_docs(spark, sf).repartition(4).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = ST.curated_stream(ST.shard_stream(spark, folder, schema), "code")
    path, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    ST.append_stream(stream.select("fingerprint"), path, state, available_now=True).awaitTermination()
    return spark.read.schema("fingerprint string").parquet(path)


@query
def s1_watermarked_curation(spark, sf):
    folder = scratch(spark, "timed-in")
    timed = V.tex_docs(spark, sf).withColumn("arrived", F.timestamp_seconds("doc_id"))
    timed.repartition(4).write.parquet(folder)
    rows = ST.shard_stream(spark, folder, spark.read.parquet(folder).schema)
    stream = ST.curated_stream(rows, "code", "arrived", "1 day")
    path, state = scratch(spark, "timed-out"), scratch(spark, "timed-state")
    ST.append_stream(stream.select("fingerprint"), path, state, available_now=True).awaitTermination()
    return spark.read.schema("fingerprint string").parquet(path)


@query
def s2_live_progress(spark, sf):
    folder = scratch(spark, "progress-in")
    V.figures(spark, sf).select("sample_id", "family").write.parquet(folder)
    stream = ST.shard_stream(spark, folder, spark.read.parquet(folder).schema)
    path, state = scratch(spark, "progress-out"), scratch(spark, "progress-state")
    ST.family_progress_stream(stream, 1500, path, state, available_now=True).awaitTermination()
    return ST.latest_progress(spark, path)
