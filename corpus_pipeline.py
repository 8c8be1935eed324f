"""Training corpus from raw documents: five filters and encoders, one after another.

Each stage takes what its predecessor kept and learns from that alone (and from ``labels`` or
``benchmark`` of the same folder). A toxicity score of 0.3 or more rejects a document, so does text
in no language (``und``) or a language score under ``SURE``; of each group linked by five-word
shingle likeness of 0.8 or more the document of the smallest id stays; documents that hold a benchmark item go; the rest is encoded,
and decoded again to prove the ids. Every stage begins by taking back from the executors what the
one before it shipped. Rows of null id are judged on their texts like any other, only
near-duplicate grouping lets them pass.
"""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.llm import bpe, decontaminate, language, queries, simhash, toxicity
from figmill.llm.batches import release
from figmill.sources.staging import stage

SURE = 0.4
#: Several stages learn a model, which SQL cannot express.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    classifier = queries.toxicity_classifier(docs, queries.read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, classifier, name="_toxic", evidence_name="_evidence")
    return scored.filter(F.col("_toxic") < queries.TOXIC).select(docs.columns)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    held_out = F.coalesce(queries.fold(4) == 2, F.lit(False))
    scored = language.identify(docs, docs.filter(~held_out), name="_lang", score="_sure")
    sure = (F.col("_lang") != language.UNKNOWN) & (F.col("_sure") >= SURE)
    return scored.filter(sure).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return simhash.first_of_groups(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return decontaminate.clean(docs, queries.read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``ids`` of every document, their number and the digest of their decoding."""
    release()
    path = os.path.join(queries.TOKENIZERS, "word_bpe_49k.json")
    kept = docs.select("doc_id", "lang", "source", "text")
    decoded = bpe.decode(bpe.encode(kept, path).drop("text"), path)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("language", in_a_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = queries.read(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
