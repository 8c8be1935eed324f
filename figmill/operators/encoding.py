"""Vocabularies and id sequences over tables.

A sequence is encoded or decoded in one of two ways, by the true size of the staged vocabulary.
Up to Spark's own broadcast threshold it travels to the tasks and Arrow batches are looked up where
they are: no row per position, no shuffle. Beyond it positions become rows that meet the vocabulary
in a join, hot tokens salted, and are put together again by key.
"""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions import tokens as K
from figmill.functions.text import required_packages
from figmill.operators.positions import text_position
from figmill.sources.staging import stage


def coordinate_bins(anchor: DataFrame, step: float = C.COORDINATE_STEP) -> DataFrame:
    """Texts of every grid bin between the canvas borders, as ``bin, token``."""
    count = round((C.CANVAS_MAX - C.CANVAS_MIN) / step)
    bins = anchor.sparkSession.range(count + 1).withColumnRenamed("id", "bin")
    value = F.lit(C.CANVAS_MIN) + F.col("bin") * F.lit(step)
    return bins.withColumn("token", K.number_text(value))


def token_counts(sequences: DataFrame, column: str = "tokens") -> DataFrame:
    """Occurrences of every token; hot tokens collapse before the shuffle."""
    return (
        sequences.select(F.explode(column).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def build_vocabulary(
    sequences: DataFrame,
    column: str = "tokens",
    include_grid: bool = True,
    step: float = C.COORDINATE_STEP,
) -> DataFrame:
    """``token, idx``: reserved ids 0-3, then every token by code point from 4.

    The result is staged: every later lookup reads the small table, and Spark decides
    from its true size whether to broadcast it.
    """
    # Repeats inside a sequence go before it is exploded.
    found = sequences.select(F.explode(F.array_distinct(column)).alias("token")).distinct()
    spark = sequences.sparkSession
    if include_grid:
        found = found.union(coordinate_bins(sequences, step).select("token"))
    fixed = spark.createDataFrame([(t,) for t in C.FAMILY_TOKENS], "token string")
    known = (
        found.union(fixed).distinct().filter(~F.col("token").isin(*C.RESERVED_TOKENS))
    )
    # Staged, so that ranks and offsets do not tokenize the corpus again.
    numbered = text_position(stage(known, "tokens"), "token", "idx").select(
        "token", (F.col("idx") + len(C.RESERVED_TOKENS)).cast("int").alias("idx")
    )
    reserved = spark.createDataFrame(
        [(t, i) for i, t in enumerate(C.RESERVED_TOKENS)], "token string, idx int"
    )
    return stage(reserved.union(numbered), "vocabulary")


#: Keys a hot token's positions are spread over in a join.
SALTS = 16


def travelling(vocabulary: DataFrame) -> pa.Table | None:
    """The vocabulary by id, if Spark would broadcast it."""
    limit = vocabulary.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = vocabulary.agg(F.sum(F.octet_length("token") + F.lit(8))).first()[0] or 0
    if size > limit:
        return None
    return vocabulary.select("token", "idx").toArrow().sort_by("idx").combine_chunks()


def _values(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """All entries of a batch of arrays, and the offsets of its rows; null rows are empty."""
    lists = pc.fill_null(column, pa.scalar([], column.type))
    first = lists.offsets[0].as_py()
    values = lists.values.slice(first, lists.offsets[-1].as_py() - first)
    return values, pc.subtract(lists.offsets, pa.scalar(first, lists.offsets.type))


def _ids_of(column: Column, table: pa.Table) -> Column:
    """Ids of a token array; unknown tokens are UNK."""
    tokens = table.column("token").combine_chunks().cast(pa.string())
    idx = table.column("idx").combine_chunks().cast(pa.int32())

    @F.arrow_udf("array<int>")
    def ids(batch: pa.Array) -> pa.Array:
        values, offsets = _values(batch)
        found = idx.take(pc.index_in(values.cast(pa.string()), value_set=tokens))
        return pa.ListArray.from_arrays(offsets, pc.fill_null(found, C.UNK))

    return ids(column)


def _tokens_of(column: Column, table: pa.Table) -> Column:
    """Tokens of an id array; null for ids outside the vocabulary."""
    tokens = table.column("token").combine_chunks().cast(pa.string())
    idx = table.column("idx").combine_chunks().cast(pa.int64())

    @F.arrow_udf("array<string>")
    def texts(batch: pa.Array) -> pa.Array:
        values, offsets = _values(batch)
        found = tokens.take(pc.index_in(values.cast(pa.int64()), value_set=idx))
        return pa.ListArray.from_arrays(offsets, found)

    return texts(column)


def _exploded(sequences: DataFrame, keep: list[str], values: Column, name: str) -> DataFrame:
    """One row per position, every sample in one task.

    Samples are dealt out by key before they grow to rows.
    """
    dealt = sequences.select(*keep, values.alias("_values")).repartition(*keep)
    return dealt.select(*keep, F.posexplode_outer("_values").alias("pos", name))


def _joined(exploded: DataFrame, vocabulary: DataFrame, name: str) -> DataFrame:
    """Positions with their vocabulary entry; a hot token's are spread over ``SALTS`` keys."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = exploded.withColumn("_salt", F.pmod(F.col("pos"), F.lit(SALTS)))
    return spread.join(vocabulary.withColumn("_salt", salts), [name, "_salt"], "left").drop("_salt")


def _regrouped(exploded: DataFrame, keep: list[str], value: Column, name: str) -> DataFrame:
    """Put exploded positions back into one array per sample, in order."""
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", value.alias("value")))
    arrays = exploded.groupBy(*keep).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    return arrays.select(*keep, F.transform("_entries", lambda e: e["value"]).alias(name))


def encode(
    sequences: DataFrame,
    vocabulary: DataFrame,
    keep: list[str],
    column: str = "tokens",
    max_length: int = C.MAX_SEQUENCE,
) -> DataFrame:
    """Framed id sequence per sample, which ``keep`` names; unknown tokens become UNK."""
    table = travelling(vocabulary)
    if table is not None:
        ids = sequences.select(*keep, _ids_of(F.col(column), table).alias("_ids"))
    else:
        positions = _exploded(sequences, keep, F.col(column), "token")
        ids = _regrouped(
            _joined(positions, vocabulary, "token"), keep, F.coalesce("idx", F.lit(C.UNK)), "_ids"
        )
    return ids.select(*keep, K.framed(F.col("_ids"), max_length).alias("ids"))


def encode_splits(
    samples: DataFrame, keep: list[str], max_length: int = C.MAX_SEQUENCE, column: str = "tokens"
) -> DataFrame:
    """Encode every split with the vocabulary of the train split alone."""
    vocabulary = build_vocabulary(samples.filter(F.col("split") == "train"), column)
    return encode(samples, vocabulary, keep, column, max_length)


def _looked_up(sequences: DataFrame, vocabulary: DataFrame, keep, dropped, column) -> DataFrame:
    """``_tokens`` of every sample, null for ids outside the vocabulary, without ``dropped`` ids."""
    wanted = F.array_compact(K.without(F.col(column), dropped))
    table = travelling(vocabulary)
    if table is not None:
        return sequences.select(*keep, _tokens_of(wanted, table).alias("_tokens"))
    # An all-padding sample still comes out, without positions.
    positions = _exploded(sequences, keep, wanted, "idx")
    return _regrouped(_joined(positions, vocabulary, "idx"), keep, F.col("token"), "_tokens")


def decode(
    sequences: DataFrame, vocabulary: DataFrame, keep: list[str], column: str = "ids"
) -> DataFrame:
    """Space-joined text without PAD, BOS and EOS; UNK stays."""
    found = _looked_up(sequences, vocabulary, keep, (C.PAD, C.BOS, C.EOS), column)
    return found.select(*keep, F.array_join("_tokens", " ", "<UNK>").alias("markup"))


def decoded_tokens(
    sequences: DataFrame, vocabulary: DataFrame, keep: list[str], column: str = "ids"
) -> DataFrame:
    """Token array without any sentinel; ids outside the vocabulary are left out."""
    found = _looked_up(sequences, vocabulary, keep, (C.PAD, C.BOS, C.EOS, C.UNK), column)
    return found.select(*keep, F.array_compact("_tokens").alias("tokens"))


def predicted_markup(
    sequences: DataFrame, vocabulary: DataFrame, keep: list[str], column: str = "ids"
) -> DataFrame:
    """Markup and implied packages of generated ids."""
    rebuilt = decoded_tokens(sequences, vocabulary, keep, column).select(
        *keep, K.reconstructed(F.col("tokens")).alias("markup")
    )
    return rebuilt.withColumn("packages", required_packages(F.col("markup")))


def reference_tokens(
    sequences: DataFrame, vocabulary: DataFrame, keep: list[str], column: str = "ids"
) -> DataFrame:
    """Round trip of reference ids: text, then tokens again."""
    texts = decode(sequences, vocabulary, keep, column)
    return texts.select(*keep, K.tokens("markup").alias("tokens"))


def class_mass(sequences: DataFrame, column: str = "tokens") -> DataFrame:
    """Tokens and loss weight mass per token class."""
    classed = token_counts(sequences, column).withColumn("class", K.token_class(F.col("token")))
    return classed.groupBy("class").agg(
        F.count(F.lit(1)).alias("distinct_tokens"),
        F.sum("occurrences").alias("occurrences"),
        F.sum(F.col("occurrences") * K.class_weight(F.col("class"))).alias("weight_mass"),
    )


def ordinal_targets(vocabulary: DataFrame, sigma: float = C.ORDINAL_SIGMA) -> DataFrame:
    """Row-normalised Gaussian over numeric tokens: ``target, token, weight``.

    A Gaussian is exactly zero in doubles beyond 40 sigma, so this is a band join on
    buckets of that width rather than a product of the vocabulary with itself.
    """
    if sigma <= 0:
        raise ValueError(f"A Gaussian of width {sigma} has no weights.")
    reach = 40.0 * sigma
    numeric = vocabulary.filter(F.col("token").rlike(C.NUMBER_PATTERN)).select(
        "token", F.col("token").cast("double").alias("value")
    )
    numeric = numeric.withColumn("_bucket", F.floor(F.col("value") / reach))
    targets = numeric.select(
        F.col("token").alias("target"),
        F.col("value").alias("center"),
        F.explode(
            F.array(F.col("_bucket") - 1, F.col("_bucket"), F.col("_bucket") + 1)
        ).alias("_bucket"),
    )
    gap = (F.col("center") - F.col("value")) / F.lit(sigma)
    edges = targets.join(numeric, "_bucket").withColumn("_mass", F.exp(-0.5 * gap * gap))
    edges = edges.filter(F.col("_mass") > 0)
    total = F.sum("_mass").over(W.partitionBy("target"))
    return edges.select("target", "token", (F.col("_mass") / total).alias("weight"))
