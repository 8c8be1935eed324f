"""Sources: parquet shards, markup files, image tables and stored evaluation records."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figmill.functions.text import picture_blocks, within_budget
from figmill.operators.curate import first_occurrences
from figmill.operators.positions import dense_position
from figmill.sources.staging import stage


def read_shards(
    spark: SparkSession, template: str, start: int, count: int, schema: T.StructType,
    max_rows: int | None = None,
) -> DataFrame:
    """Shards ``start <= i < count`` of a path template such as ``.../part-{index:05d}.parquet``.

    Missing and unreadable shards are skipped. ``scan_pos`` numbers rows in the order of the shard
    index, padded or not. With ``max_rows`` only the first ones are kept: row counts come from the
    files' footers, and only files that hold a wanted row are opened again.
    """
    if not 0 <= start < count:
        raise ValueError(f"No shard lies from {start} to before {count}.")
    if max_rows is not None and max_rows < 0:
        raise ValueError(f"max_rows must not be negative. Got {max_rows}.")
    reader = (
        spark.read.schema(schema)
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True)
    )
    paths = [template.format(index=i) for i in range(start, count)]
    rows = reader.parquet(*_existing(spark, paths))
    starts = _file_starts(rows, _shard_index(template))
    if max_rows is None:
        return _numbered(rows, starts)
    wanted = starts.filter(F.col("_start") < max_rows).select("_path").collect()
    if not wanted:
        return _numbered(rows.limit(0), starts)
    first = reader.parquet(*_plain_paths(spark, [r["_path"] for r in wanted]))
    return _numbered(first, starts).filter(F.col("scan_pos") < max_rows)


def _plain_paths(spark: SparkSession, locations: list[str]) -> list[str]:
    """File locations, which are escaped like addresses, as paths to read."""
    jvm = spark.sparkContext._jvm
    return [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(x)).toString() for x in locations]


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that exist; a missing root path is an error in Spark even with ignoreMissingFiles."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        if path.getFileSystem(conf).exists(path):
            found.append(text)
    if not found:
        raise ValueError("None of the shards exists.")
    return found


def _shard_index(template: str) -> Column:
    """Shard index of a file path by the template; 0 without a placeholder."""
    before, placeholder, after = re.match(r"([^{]*)(\{[^}]*\})?(.*)", template).groups()
    if placeholder is None:
        return F.lit(0)
    name = re.escape("/" + before.rpartition("/")[2]) + r"(\d+)" + re.escape(after.split("/")[0])
    return F.regexp_extract(unescaped(F.col("_path")), name, 1).cast("long")


def unescaped(location: Column) -> Column:
    """A file location without its escapes; a plus sign is itself."""
    return F.url_decode(F.replace(location, F.lit("+"), F.lit("%2B")))


def _file_starts(rows: DataFrame, shard: Column) -> DataFrame:
    """``_path, _start``: rows before each file by shard and file path. No column is read, so the
    counts come from footers; files without readable rows do not occur."""
    sizes = rows.select(F.col("_metadata.file_path").alias("_path"))
    sizes = sizes.groupBy("_path").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shard", shard)
    window = W.partitionBy(F.lit(0)).orderBy("_shard", "_path")  # one row per file
    starts = sizes.withColumn(
        "_start",
        F.sum("_n").over(window.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n"),
    )
    return stage(starts.select("_path", "_start"), "shard-starts")


def _numbered(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Add ``scan_pos``, the order in which shards are scanned."""
    located = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.row_index").alias("_index"),
    )
    return (
        located.join(starts, "_path")
        .withColumn("scan_pos", F.col("_start") + F.col("_index"))
        .drop("_path", "_index", "_start")
    )


def read_documents(spark: SparkSession, folders: list[str], glob: str = "*.tex") -> DataFrame:
    """Markup files below the folders as ``path, raw_text``; bad bytes become U+FFFD."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .load(folders)
    )
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("raw_text"))


def document_blocks(documents: DataFrame) -> DataFrame:
    """One row per picture: ``path, block_no, markup``. Files without pictures give none."""
    return documents.select(
        "path", F.posexplode(picture_blocks("raw_text")).alias("block_no", "markup")
    )


def external_candidates(spark: SparkSession, folders: list[str], cap: int) -> DataFrame:
    """Distinct pictures within budget, in path order, at most ``cap``."""
    if cap <= 0:
        raise ValueError(f"A cap of {cap} keeps no picture.")
    blocks = document_blocks(read_documents(spark, folders)).filter(within_budget("markup"))
    placed = blocks.withColumn("_at", F.struct("path", "block_no"))
    unique = first_occurrences(placed, "markup", "_at", ["path", "block_no", "markup"])
    # A top-k: every task keeps at most ``cap`` rows.
    return unique.orderBy("path", "block_no").limit(cap)


def read_split_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Markup files of one split in stable order as ``sample_id, markup``; none is an error."""
    documents = read_documents(spark, [folder])
    corpus = documents.select(
        F.regexp_extract("path", r"([^/]+)\.tex$", 1).alias("sample_id"),
        F.col("raw_text").alias("markup"),
    )
    if corpus.isEmpty():
        raise ValueError(f"No markup files in '{folder}'.")
    return corpus


def pair_report(markups: DataFrame, images: DataFrame, keys=("split", "sample_id")) -> DataFrame:
    """Full outer match of markups and images per split: matched and one-sided counts."""
    keys = list(keys)
    left = markups.select(*keys, F.lit(True).alias("_m"))
    right = images.select(*keys, F.lit(True).alias("_i"))
    joined = left.join(right, keys, "full_outer")
    has_markup, has_image = F.col("_m").isNotNull(), F.col("_i").isNotNull()
    return joined.groupBy("split").agg(
        F.count_if(has_markup & has_image).alias("matched"),
        F.count_if(has_markup & ~has_image).alias("markup_only"),
        F.count_if(~has_markup & has_image).alias("image_only"),
    )


def paired_samples(markups: DataFrame, images: DataFrame, keys=("split", "sample_id")) -> DataFrame:
    """Markups with their images by key; fails when either side has rows of its own."""
    unmatched = pair_report(markups, images, keys).filter("markup_only > 0 or image_only > 0")
    first = unmatched.first()
    if first is not None:
        raise ValueError(f"Image and markup samples do not match: {first.asDict()}.")
    return markups.join(images, list(keys))


POINTS = T.ArrayType(T.ArrayType(T.DoubleType()))
COUNTS = T.MapType(T.StringType(), T.IntegerType())
# Fields of a stored evaluation record.
EVALUATION_RECORD = T.StructType(
    [
        T.StructField("policy", T.StringType()),
        T.StructField("raw_indices", T.ArrayType(T.IntegerType())),
        T.StructField("raw_emitted_tokens", T.ArrayType(T.StringType())),
        T.StructField("decoded_markup", T.StringType()),
        T.StructField("sanitized_markup", T.StringType()),
        T.StructField("total_length", T.IntegerType()),
        T.StructField("length_to_eos", T.IntegerType()),
        T.StructField("has_bos", T.BooleanType()),
        T.StructField("has_eos", T.BooleanType()),
        T.StructField("eos_position", T.IntegerType()),
        T.StructField("unk_count", T.IntegerType()),
        T.StructField("pad_count", T.IntegerType()),
        T.StructField("unbalanced_delimiters_raw", COUNTS),
        T.StructField("unbalanced_delimiters_sanitized", COUNTS),
        T.StructField("detected_primitives", T.ArrayType(T.StringType())),
        T.StructField("predicted_coordinates", POINTS),
        T.StructField("predicted_family", T.StringType()),
        T.StructField("compilation_successful", T.BooleanType()),
        T.StructField("tex_error", T.StringType()),
        T.StructField("ssim", T.DoubleType()),
        T.StructField("coordinate_error", T.DoubleType()),
        T.StructField("coordinate_points_compared", T.IntegerType()),
        T.StructField("reference_coordinate_count", T.IntegerType()),
        T.StructField("candidate_coordinate_count", T.IntegerType()),
        T.StructField("coordinate_matching", T.StringType()),
        T.StructField("emitted_primitives", T.ArrayType(T.StringType())),
        T.StructField("token_ged", T.DoubleType()),
        T.StructField("graph_ged", T.DoubleType()),
        T.StructField("token_overlap", T.DoubleType()),
        T.StructField("is_line_segment_collapsed", T.BooleanType()),
    ]
)


# Fixed value: where a stored record carries its family, sample and policy.
EVALUATION_PATH = r"/([^/]+)/sample_(\d+)/([^/]+)_meta\.json$"


def read_evaluations(
    spark: SparkSession, folder: str, glob: str = "*_meta.json", where: str = EVALUATION_PATH,
    multi_line: bool = True,
) -> DataFrame:
    """Stored records; family, sample and policy also come from the path by the three
    groups of ``where``. Records written before points were counted have null there and hold
    the coordinate error in canvas units, which ``record_version`` tells apart."""
    records = (
        spark.read.schema(EVALUATION_RECORD)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .json(folder)
    )
    path = F.col("_metadata.file_path")
    version = F.when(F.col("coordinate_points_compared").isNull(), 1).otherwise(2)
    return records.select(
        F.regexp_extract(path, where, 1).alias("family"),
        F.nullif(F.regexp_extract(path, where, 2), F.lit("")).cast("int").alias("sample_index"),
        F.regexp_extract(path, where, 3).alias("path_policy"),
        version.alias("record_version"),
        "*",
    )


def numbered_samples(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Dense ``position`` per split and its file stem ``sample_00000``."""
    numbered = dense_position(df, F.col(key), groups=[split])
    return numbered.withColumn(
        "sample_name", F.format_string("sample_%05d", "position")
    )
