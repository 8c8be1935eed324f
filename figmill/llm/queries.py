"""One query per operator over its whole table, and the SQL that says the same."""

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.llm import (
    bpe,
    decontaminate,
    extraction,
    fingerprints,
    language,
    licenses,
    perspectives,
    phrases,
    quality,
    simhash,
    topk,
    toxicity,
    trie,
)

TOKENIZERS = "/opt/tokenizers"
TOXIC = 0.3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo; null ids fall in no fold."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )
    return found.withColumnRenamed("id", "doc_id")


def _edited(keys: list, texts: list[str]) -> list[pa.Array]:
    """Contract columns of ``texts[:-1]``, each followed by its next text."""
    edited = [
        a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)
    ]
    own, there = fingerprints.codes(pa.array(texts, pa.string()))
    new, changed = fingerprints.codes(pa.array(edited, pa.string()))
    return [
        pa.array(keys, pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(fingerprints.packed(own[:-1], there[:-1]), pa.string()),
        pa.array(fingerprints.packed(new, changed), pa.string()),
        pa.array(fingerprints.likeness(own[:-1], new, there[:-1], changed)),
        pa.array(fingerprints.likeness(own[:-1], own[1:], there[:-1], there[1:])),
    ]


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.in_order(
        read(spark, sf_dir, "documents"),
        "doc_id",
        "text",
        _edited,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perspectives.rotations(read(spark, sf_dir, "conversations"))
    return found.withColumn("mask", perspectives.mask_text("mask"))


def toxicity_classifier(docs: DataFrame, labels: DataFrame) -> toxicity.Classifier:
    """Two folds of labels are counted, one fits the curve, one is held out."""
    part = F.coalesce(fold(4), F.lit(2))
    return toxicity.train(docs, labels, counted=part.isin(0, 1), curve=part == 3)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = toxicity_classifier(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, classifier).select(
        "doc_id",
        F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(read(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    taught = F.coalesce(fold(5) != 0, F.lit(False))
    found = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), taught)
    return found.select(
        "doc_id",
        F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extraction.extract(pages).drop("html")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    path = os.path.join(tokenizers, "word_bpe_49k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    found = language.identify(docs.drop("lang"), docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read(spark, sf_dir, "embeddings"))
    found = topk.top_k(vectors, F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = trie.regrafted(
        trie.ordered_turns(read(spark, sf_dir, "conversations")),
        base=F.col("conv_id") - F.col("conv_id") % 100,
        kept=fold(6, "conv_id"),
        most=6,
    )
    return trie.prefix_trie(turns, conversations)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_fingerprints": op2_fingerprints,
    "op3_simhash": op3_simhash,
    "op4_perspectives": op4_perspectives,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_extraction": op8_extraction,
    "op9_bpe": op9_bpe,
    "op10_language": op10_language,
    "op11_phrases": op11_phrases,
    "op12_topk": op12_topk,
    "op13_trie": op13_trie,
}

ORACLES: dict[str, str] = {
    "op4_perspectives": perspectives.rotations_sql(),
    "op6_licenses": licenses.summary_sql(),
    "op11_phrases": phrases.collocations_sql(),
    "op12_topk": topk.divisible_sql(),
    "op13_trie": trie.rebuilt_sql(),
}
