"""Sinks: splits, shards, manifests, vocabularies, records and report tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions.hashing import fingerprint
from figmill.operators.positions import counts_before, ordered_head
from figmill.operators.quality import vocabulary_invariants
from figmill.operators.report import (
    ablation_body,
    fixed_text,
    multitier_lines,
    whole_table,
)
from figmill.sources.scan import numbered_samples, unescaped
from figmill.sources.staging import moved, removed, stage

MANIFEST_VERSION = "v4"
#: Shards are summed in blocks of a thousand, these in blocks of a thousand again.
SHARD_PARENTS = (10, 10)


def write_splits(samples: DataFrame, path: str, key: str = "sample_id") -> None:
    """Densely numbered samples, one folder per split."""
    numbered_samples(samples, key).write.partitionBy("split").mode("overwrite").parquet(path)


def sharded(samples: DataFrame, shard_size: int, key: str = "sample_id") -> DataFrame:
    """Number the samples of every split and cut them into shards of ``shard_size``."""
    if shard_size <= 0:
        raise ValueError(f"Shards of {shard_size} samples hold nothing.")
    numbered = numbered_samples(samples, key)
    return numbered.withColumn("shard_id", F.floor(F.col("position") / shard_size).cast("long"))


def write_shards(samples: DataFrame, path: str, shard_size: int, key: str = "sample_id") -> None:
    """One file per shard, named as the manifest says: ``<split>/<split>_shard_0000.parquet``.

    Shards, not splits, spread the rows, and a task writes all its shards of a split one after
    another: each is full but the last of the split, so a file ends where a shard does. Then the
    files get their names.
    """
    spark = samples.sparkSession
    removed(spark, path)
    parts = f"{path}/parts"
    (
        sharded(samples, shard_size, key)
        .withColumn("folder", F.col("split"))
        .repartition("split", "shard_id")
        .sortWithinPartitions("folder", "shard_id", "position")
        .write.partitionBy("folder")
        .option("maxRecordsPerFile", shard_size)
        .parquet(parts)
    )
    written = spark.read.schema("split string, shard_id bigint").option(
        "recursiveFileLookup", True
    ).parquet(parts)
    files = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("split").alias("split"), F.min("shard_id").alias("shard_id")
    )
    names = files.select("file", _shard_file_name().alias("name")).toLocalIterator()
    moved(spark, [(r["file"], f"{path}/{r['name']}.parquet") for r in names])
    removed(spark, parts)


def read_written_shards(spark: SparkSession, path: str) -> DataFrame:
    """All samples of ``write_shards``."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def _shard_file_name() -> Column:
    return F.format_string("%1$s/%1$s_shard_%2$04d", "split", "shard_id")


def shard_manifest(shards: DataFrame) -> DataFrame:
    """Per shard: file name, samples and a count per family, absent families as zero."""
    counts = shards.groupBy("split", "shard_id").agg(
        F.count(F.lit(1)).alias("num_samples"),
        *[F.count_if(F.col("family") == f).alias(f"_{f}") for f in C.FAMILIES],
    )
    families = F.create_map(*[p for f in C.FAMILIES for p in (F.lit(f), F.col(f"_{f}"))])
    return counts.select(
        "split", "shard_id", _shard_file_name().alias("file_name"), "num_samples", families.alias("family_counts")
    )


MASTER = "all"


def manifest_json(manifest: DataFrame, image_size: int, max_length: int) -> DataFrame:
    """Manifests of all splits and the master manifest ``all``, as JSON lines ``split, manifest``.

    A manifest is a head with the totals and one line per shard, so no cell grows with the
    number of shards. The shards of a split belong to its own manifest and to the master.
    """
    scopes = F.explode(F.array(F.col("split"), F.lit(MASTER)))
    head = F.struct(
        F.lit(MANIFEST_VERSION).alias("version"),
        F.lit(image_size).alias("image_size"),
        F.lit(max_length).alias("max_length"),
        "total_samples",
        "total_shards",
    )
    heads = (
        manifest.select(scopes.alias("split"), "num_samples")
        .groupBy("split")
        .agg(
            F.sum("num_samples").alias("total_samples"),
            F.count(F.lit(1)).alias("total_shards"),
        )
        .select("split", F.to_json(head).alias("manifest"))
    )
    shard = F.struct("shard_id", "file_name", "num_samples", "family_counts")
    lines = manifest.select(F.to_json(shard).alias("manifest"), scopes.alias("split"))
    return heads.unionByName(lines)


def write_documents(fragments: DataFrame, path: str) -> None:
    """Text files ``path/<name>`` from fragments ``name, part, text``, joined in order of ``part``.

    A document is written by one task that passes its fragments on one by one, so it may be long,
    but neither a cell nor a task holds it.
    """
    spark = fragments.sparkSession
    parts = f"{path}/parts"
    (
        fragments.select("name", "part", "text", F.col("name").alias("folder"))
        .repartition("name")
        .sortWithinPartitions("folder", "part")
        .select("text", "folder")
        .write.partitionBy("folder")
        .option("lineSep", "\n")
        .mode("overwrite")
        .text(parts)
    )
    listed = spark.read.option("recursiveFileLookup", True).text(parts)
    folder = F.regexp_extract("file", "/folder=([^/]*)/[^/]*$", 1)
    files = listed.select(F.col("_metadata.file_path").alias("file")).distinct()
    names = files.select("file", unescaped(unescaped(folder)).alias("name")).collect()
    for row in names:
        removed(spark, f"{path}/{row['name']}")
    moved(spark, [(r["file"], f"{path}/{r['name']}") for r in names])
    removed(spark, parts)


def _joined_items(items: DataFrame, openings: DataFrame, closing: str) -> DataFrame:
    """Fragments of JSON documents from ``name, part, text`` items, the first without a comma, and
    the ``name, opening`` of each document."""
    firsts = items.groupBy("name").agg(F.min("part").alias("_first"))
    comma = F.when(F.col("part") == F.col("_first"), "").otherwise(",")
    body = items.join(firsts, "name").select("name", "part", F.concat(comma, "text").alias("text"))
    ends = openings.select(
        "name",
        F.inline(
            F.array(
                F.struct(F.lit(-1).cast("long").alias("part"), F.col("opening").alias("text")),
                F.struct(F.lit((1 << 63) - 1).alias("part"), F.lit(closing).alias("text")),
            )
        ),
    )
    return body.unionByName(ends)


def write_manifests(manifest: DataFrame, path: str, image_size: int, max_length: int) -> None:
    """``manifest_<split>.json`` of every split and the master ``manifest_v4.json``, each one JSON
    document with its totals and the list of its shards in order."""
    scopes = manifest.withColumn("scope", F.explode(F.array(F.col("split"), F.lit(MANIFEST_VERSION))))
    named = scopes.withColumn("name", F.format_string("manifest_%s.json", "scope"))
    order = W.partitionBy(F.lit(0)).orderBy("split")  # a row per split
    splits = manifest.select("split").distinct().withColumn("at", F.row_number().over(order))
    shard = F.to_json(F.struct("shard_id", "file_name", "num_samples", "family_counts"))
    items = named.join(splits, "split").select(
        "name", (F.col("at") * F.lit(1 << 40) + F.col("shard_id")).alias("part"), shard.alias("text")
    )
    head = F.struct(
        F.lit(MANIFEST_VERSION).alias("version"), F.lit(image_size).alias("image_size"),
        F.lit(max_length).alias("max_length"), "total_samples",
    )
    openings = named.groupBy("name").agg(F.sum("num_samples").alias("total_samples")).select(
        "name", F.concat(F.rtrim(F.to_json(head), F.lit("}")), F.lit(',"shards":[')).alias("opening")
    )
    write_documents(_joined_items(items, openings, "]}"), path)


MANIFEST_DOCUMENT = (
    "version string, image_size int, max_length int, total_samples bigint, shards array<struct<"
    "shard_id: bigint, file_name: string, num_samples: bigint, family_counts: map<string, bigint>>>"
)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and the content of the manifests of ``write_manifests``."""
    files = spark.read.schema(MANIFEST_DOCUMENT).option("multiLine", True).option(
        "pathGlobFilter", "manifest_*.json"
    ).json(path)
    return files.select(F.regexp_extract("_metadata.file_path", "([^/]*)$", 1).alias("file"), "*")


# Fields of a manifest's head and of its shard lines.
MANIFEST_SCHEMA = (
    "version string, image_size int, max_length int, total_samples bigint, total_shards bigint, "
    "shard_id bigint, file_name string, num_samples bigint, family_counts map<string, bigint>"
)


def _manifest_lines(documents: DataFrame) -> DataFrame:
    parsed = documents.select("split", F.from_json("manifest", MANIFEST_SCHEMA).alias("m"))
    return parsed.select("split", "m.*")


def manifest_shards(documents: DataFrame) -> DataFrame:
    """Read manifests back: one row per manifest and shard."""
    return _manifest_lines(documents).filter("version IS NULL").select(
        "split", "shard_id", "file_name", "num_samples", "family_counts"
    )


def manifest_heads(documents: DataFrame) -> DataFrame:
    """Read manifests back: one row of totals per manifest."""
    return _manifest_lines(documents).filter("version IS NOT NULL").select(
        "split", "version", "image_size", "max_length", "total_samples", "total_shards"
    )


def shard_lookup(manifest: DataFrame, requests: DataFrame, index: str = "index") -> DataFrame:
    """``requests`` with the shard and offset of their global sample index; ``out_of_range``
    instead of an error. Every request keeps its row and its other columns.

    Sample counts are summed in levels, split by split. Requests meet the shard they fall in by
    an equi-join on the size of a full shard, so there is no product of requests and shards.
    """
    manifest = stage(manifest.select("split", "shard_id", "num_samples"), "manifest")
    counts = manifest.select(
        "split", F.col("shard_id").alias("_cell"), F.col("num_samples").alias("_n")
    )
    within = counts_before(counts, ["split"], SHARD_PARENTS)
    totals = manifest.groupBy("split").agg(F.sum("num_samples").alias("_n"))
    order = W.partitionBy(F.lit(0)).orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("split", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    bounds = within.join(starts, "split").select(
        "split", F.col("_cell").alias("shard_id"), "_n",
        (F.col("_start") + F.col("_before")).alias("_from"),
    )
    width = manifest.agg(F.max("num_samples")).first()[0] or 1
    cells = bounds.filter("_n > 0").select(
        "split", "shard_id", "_from", (F.col("_from") + F.col("_n")).alias("_to"),
        F.explode(
            F.sequence(F.floor(F.col("_from") / F.lit(width)),
                       F.floor((F.col("_from") + F.col("_n") - 1) / F.lit(width)))
        ).alias("_cell"),
    )
    at = F.col(index)
    asked = requests.withColumn("_asked", F.floor(at / F.lit(width)))
    inside = (F.col("_asked") == F.col("_cell")) & (at >= F.col("_from")) & (at < F.col("_to"))
    return asked.join(cells, inside, "left").select(
        *requests.columns, "split", "shard_id", (at - F.col("_from")).alias("offset"),
        F.col("_from").isNull().alias("out_of_range"),
    )


def fetched_samples(shards: DataFrame, located: DataFrame, shard_size: int) -> DataFrame:
    """The samples that the rows of ``shard_lookup`` point at; requests out of range stay, empty.

    ``shards`` are written samples with ``split, shard_id, position``.
    """
    placed = shards.withColumn("offset", F.col("position") % F.lit(shard_size)).drop("position")
    return located.join(placed, ["split", "shard_id", "offset"], "left")


def dataset_manifest(
    samples: DataFrame, requested: dict[str, int], seed: int, ratio: float, showcase_ok: bool,
    stratum: str = "stratum", order: str = "sample_id", content: str = "markup",
) -> DataFrame:
    """The manifest of a built corpus as one JSON document ``name, part, text``.

    ``samples`` are the kept samples with their ``split``. Only counts per stratum and the
    fingerprints of the first samples get in, so the document has a fixed size.
    """
    strata = split_manifest(samples, stratum).select(
        F.col(stratum).alias("name"), "train", "val"
    )
    listed = strata.agg(
        F.sum(F.col("train") + F.col("val")).alias("total"),
        F.sum("train").alias("train"),
        F.sum("val").alias("val"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("name", F.struct("train", "val"))))
        ).alias("strata"),
    )
    prints = fingerprint_sample(samples, order, content).agg(
        F.array_sort(F.collect_list(F.struct(order, "fingerprint"))).alias("first")
    )
    document = F.struct(
        F.lit(seed).alias("seed"),
        F.lit(ratio).alias("val_ratio"),
        F.struct(*[F.lit(n).cast("long").alias(k) for k, n in requested.items()]).alias("requested"),
        F.struct("total", "train", "val").alias("rendered"),
        "strata",
        F.lit(showcase_ok).alias("showcase_rendered"),
        F.transform("first", lambda p: p["fingerprint"]).alias("fingerprints_sample"),
    )
    return listed.join(prints).select(  # one row each
        F.lit("manifest.json").alias("name"), F.lit(0).cast("long").alias("part"),
        F.to_json(document).alias("text"),
    )


DATASET_DOCUMENT = (
    "seed bigint, val_ratio double, requested struct<procedural: bigint, external: bigint>, "
    "rendered struct<total: bigint, train: bigint, val: bigint>, "
    "strata map<string, struct<train: bigint, val: bigint>>, showcase_rendered boolean, "
    "fingerprints_sample array<string>"
)


def read_dataset_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET_DOCUMENT).option("multiLine", True).json(f"{path}/manifest.json")


def split_manifest(samples: DataFrame, stratum: str, splits=("train", "val")) -> DataFrame:
    """Rows per stratum and split."""
    return samples.groupBy(stratum).agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in splits]
    )


def manifest_totals(attempts: DataFrame, kept: str = "kept") -> DataFrame:
    """Requested and kept totals and the success rate of a build; one row per requested sample."""
    return attempts.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(kept).alias("kept"),
        F.count_if(F.col(kept) & (F.col("split") == "train")).alias("train"),
        F.count_if(F.col(kept) & (F.col("split") == "val")).alias("val"),
    ).withColumn("compile_rate", F.col("kept") / F.greatest(F.lit(1), F.col("requested")))


def fingerprint_sample(samples: DataFrame, order: str, content: str, count: int = 8) -> DataFrame:
    """Fingerprints of the first rows, as a build keeps them in its manifest."""
    return ordered_head(samples, count, order).select(
        order, fingerprint(F.col(content)).alias("fingerprint")
    )


def write_sample_manifest(samples: DataFrame, path: str) -> None:
    """One JSON line per sample with its real outcome."""
    samples.select(
        "sample_id", "stage", "family", "seed", "markup", "tensor_shape", "tensor_std",
        "image_sha256",
        F.when(F.col("is_successful"), "SUCCESS").otherwise("FAILED").alias("compilation_status"),
    ).write.mode("overwrite").json(path)


SAMPLE_MANIFEST_SCHEMA = (
    "sample_id string, stage int, family string, seed bigint, markup string, "
    "tensor_shape array<int>, tensor_std double, image_sha256 string, compilation_status string"
)


def read_sample_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_MANIFEST_SCHEMA).json(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """One JSON line per token, so a large vocabulary is neither one cell nor one task."""
    vocabulary.select("token", "idx").write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Read a vocabulary and check its invariants."""
    return checked_vocabulary(spark.read.schema("token string, idx int").json(path))


def checked_vocabulary(vocabulary: DataFrame) -> DataFrame:
    facts = vocabulary_invariants(vocabulary).first()
    if not facts["valid"]:
        raise ValueError(f"Not a valid vocabulary: {facts.asDict()}.")
    return vocabulary


def vocabulary_documents(vocabulary: DataFrame, block: int = 4096) -> DataFrame:
    """The vocabulary as JSON objects of at most ``block`` entries each."""
    return vocabulary.groupBy(F.floor(F.col("idx") / block).alias("block")).agg(
        F.to_json(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "idx"))))
        ).alias("document")
    )


def write_vocabulary_object(vocabulary: DataFrame, path: str, name: str = "vocabulary.json") -> None:
    """The vocabulary as one JSON object ``{token: id}`` in order of the ids."""
    quoted = F.to_json(F.array("token"))
    entry = F.concat(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(":"), F.col("idx").cast("string"))
    items = vocabulary.select(
        F.lit(name).alias("name"), F.col("idx").cast("long").alias("part"), entry.alias("text")
    )
    openings = items.select("name", F.lit("{").alias("opening")).distinct()
    write_documents(_joined_items(items, openings, "}"), path)


def read_vocabulary_object(spark: SparkSession, path: str) -> DataFrame:
    """Read a vocabulary that is stored as one JSON object ``{token: id}``."""
    whole = spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")
    return checked_vocabulary(vocabulary_entries(whole))


def vocabulary_entries(documents: DataFrame) -> DataFrame:
    parsed = documents.select(F.explode(F.from_json("document", "map<string,int>")))
    return parsed.select(F.col("key").alias("token"), F.col("value").alias("idx"))


def detailed_rows(records: DataFrame) -> DataFrame:
    """The 21 columns of the detailed result file."""

    def four(name: str):
        return fixed_text(F.col(name), 4).alias(name)

    def parens(name: str):
        return F.coalesce(F.try_element_at(F.col(name), F.lit("()")), F.lit(0))

    error = F.coalesce("tex_error", F.lit(""))
    return records.select(
        "family", "sample_index", "seed", "policy", "compilation_successful", four("ssim"),
        four("coordinate_error"), "coordinate_points_compared",
        F.array_join("emitted_primitives", "|").alias("emitted_primitives"),
        four("token_ged"), four("graph_ged"), four("token_overlap"), "predicted_family",
        "is_line_segment_collapsed", "total_length", "length_to_eos", "has_eos", "unk_count",
        parens("unbalanced_delimiters_raw").alias("raw_unbalanced_parens"),
        parens("unbalanced_delimiters_sanitized").alias("san_unbalanced_parens"),
        F.substring(F.replace(error, F.lit("\n"), F.lit(" ")), 1, 100).alias("tex_error"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


# Columns of the family summary file with their decimals.
SUMMARY_COLUMNS = (
    ("compilation_rate", "compilation_rate_mean", 4), ("ssim_mean", "ssim_mean", 4),
    ("ssim_std", "ssim_std", 4), ("coordinate_error_mean", "coord_error_mean", 4),
    ("coordinate_error_std", "coord_error_std", 4), ("token_distance_mean", "token_ged_mean", 4),
    ("token_distance_std", "token_ged_std", 4), ("graph_distance_mean", "graph_ged_mean", 4),
    ("graph_distance_std", "graph_ged_std", 4), ("token_overlap_mean", "token_overlap_mean", 4),
    ("family_accuracy", "family_accuracy", 4), ("collapse_rate", "collapse_rate", 4),
    ("eos_rate", "eos_rate", 4), ("unk_rate", "unk_rate", 4), ("mean_length", "mean_length", 2),
)


def family_summary_rows(report: DataFrame) -> DataFrame:
    """The 18 columns of the family summary file, from the diagnostics report."""
    return report.filter(F.col("family") != "overall").select(
        "family", "policy", "samples",
        *[fixed_text(F.col(c), d).alias(name) for c, name, d in SUMMARY_COLUMNS],
    )


def summary_documents(report: DataFrame) -> DataFrame:
    """Nested summary: one JSON object per policy and scope."""

    def spread(name: str, *extra):
        return F.struct(
            F.col(f"{name}_mean").alias("mean"), F.col(f"{name}_std").alias("std"), *extra
        )

    body = F.struct(
        F.col("samples").alias("sample_count"),
        "compilation_rate",
        spread("ssim").alias("ssim"),
        spread("coordinate_error", F.col("points_compared")).alias("coordinate_error"),
        spread("token_distance").alias("token_ged"),
        spread("graph_distance").alias("graph_ged"),
        "family_accuracy",
        F.col("collapse_rate").alias("collapse_to_segment_rate"),
        "eos_rate",
        "unk_rate",
        F.col("mean_length").alias("mean_length_to_eos"),
    )
    return report.select("policy", "family", F.to_json(body).alias("document"))


def _write_lines(body: DataFrame, kind: str, path: str) -> None:
    """The whole table as one small text file."""
    lines = whole_table(body, kind).coalesce(1).sortWithinPartitions("line_no")
    lines.select("line").write.mode("overwrite").text(path)


def write_multitier_table(stats: DataFrame, path: str) -> None:
    _write_lines(multitier_lines(stats), "multitier", path)


def write_ablation_table(deltas: DataFrame, path: str) -> None:
    _write_lines(ablation_body(deltas), "ablation", path)
