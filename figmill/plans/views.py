"""Derived input tables.

The given tables hold no figure markup, so the corpus comes from them row by row: every
order seeds one figure, one prediction and one render outcome; every document becomes a
document with figures spliced in; every 16 embeddings become one raster. All of it is
narrow work after hashing the key once, and it grows with the tables. As in a real corpus
the markup is generated once and written; the queries read the written tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions import templates as G
from figmill.functions.hashing import uniform
from figmill.sources.staging import stage_once

SEED = 42
RASTER_HEIGHT, RASTER_WIDTH = 16, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BUILT: dict[tuple, Column] = {}


def built_once(spark: SparkSession, key: tuple, build) -> Column:
    """Reuse a large column expression within one application. Columns are unresolved
    recipes, so only the time to put them together is saved."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _BUILT:
        _BUILT[full] = build()
    return _BUILT[full]


def procedural(spark: SparkSession, family: str, seed: int) -> Column:
    """Picture of the family named by a column, keyed by ``sample_id``."""
    return built_once(
        spark, ("procedural", family, seed),
        lambda: G.procedural_markup(F.col(family), seed, F.col("sample_id")),
    )


def _family_of(index: Column) -> Column:
    names = F.array(*[F.lit(name) for name in C.FAMILIES])
    return F.element_at(names, (index + 1).cast("int"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash narrow rows by key before markup is generated from them.

    The rows are tiny and the work per row is not, so the partition count is the session's
    and not left to a rule that merges partitions by their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their price in cents."""
    source = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents"),
    )
    return source


def procedural_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, family_idx, family, markup`` and the order columns; families in turn."""
    indexed = spread(orders(spark, sf_dir), "sample_id").withColumn(
        "family_idx", F.col("sample_id") % len(C.FAMILIES)
    )
    named = indexed.withColumn("family", _family_of(F.col("family_idx")))
    return named.withColumn("markup", procedural(spark, "family", SEED))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, "figures", sf_dir, lambda: procedural_figures(spark, sf_dir))


POLICIES = {
    "1-URGENT": "greedy",
    "2-HIGH": "grammar_greedy",
    "3-MEDIUM": "beam",
    "4-NOT SPECIFIED": "nucleus",
    "5-LOW": "best_of_4",
}
TIERS = {"O": "tier1", "F": "tier2", "P": "tier3"}


def _mapped(column: Column, mapping: dict[str, str]) -> Column:
    branches = None
    for key, value in mapping.items():
        branches = (
            F.when(column == key, value) if branches is None else branches.when(column == key, value)
        )
    return branches


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, "pairs", sf_dir, lambda: predicted_pairs(spark, sf_dir))


def predicted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with predictions. Open orders: the last digit of every decimal moves.
    Filled orders: also the end tag is lost. The rest: a figure of the next family."""
    base = figures(spark, sf_dir).withColumn(
        "next_family", _family_of((F.col("family_idx") + 1) % len(C.FAMILIES))
    )
    moved = F.regexp_replace(
        F.col("markup"),
        F.lit(r"(\.\d)\d"),
        F.concat(F.lit("$1"), (F.col("custkey") % 10).cast("string")),
    )
    other = procedural(spark, "next_family", SEED + 1)
    candidate = (
        F.when(F.col("status") == "P", other)
        .when(F.col("status") == "F", F.replace(moved, F.lit("\n" + C.END_PICTURE), F.lit("")))
        .otherwise(moved)
    )
    return base.select(
        "sample_id",
        "family",
        _mapped(F.col("priority"), POLICIES).alias("policy"),
        _mapped(F.col("status"), TIERS).alias("tier"),
        F.col("cents").alias("seed"),
        F.col("markup").alias("reference"),
        candidate.alias("candidate"),
        *_outcome_columns(),
    )


def _outcome_columns() -> list[Column]:
    cents = F.col("cents")
    log = F.when(
        cents % 8 == 0,
        F.concat(
            F.lit("! LaTeX Error: File `"), F.lit("pkg"), (cents % 13).cast("string"),
            F.when(cents % 3 == 0, ".cls").otherwise(".sty"), F.lit("' not found."),
        ),
    ).otherwise(F.concat(F.lit("! Undefined control sequence.\nl."), (cents % 17).cast("string")))
    return [
        (cents % 4 != 0).alias("is_successful"),
        F.when(cents % 4 == 0, log).otherwise("").alias("log"),
        ((cents % 10007) / F.lit(10006.0)).alias("ssim"),
    ]


def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, "unordered_pairs", sf_dir, lambda: rearranged_pairs(spark, sf_dir))


def rearranged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order a node figure with another one, and a composed figure with itself: its
    statements reversed and without the first."""
    key = F.col("sample_id")

    def drawn(family: str, drawn_key: Column) -> Column:
        return G.procedural_markup(F.lit(family), SEED, drawn_key)

    keys = spread(orders(spark, sf_dir).select("sample_id"), "sample_id")
    nodes = keys.select(
        "sample_id", F.lit("node_arrow").alias("family"),
        drawn("node_arrow", key).alias("reference"),
        drawn("node_arrow", F.concat(F.lit("m5/"), key.cast("string"))).alias("candidate"),
    )
    lines = F.split("reference", "\n")
    statements = F.reverse(F.slice(lines, F.lit(3), F.size(lines) - 3))
    composed = keys.select(
        "sample_id", F.lit("composed").alias("family"), drawn("composed", key).alias("reference")
    ).withColumn(
        "candidate",
        F.array_join(
            F.concat(F.slice(lines, 1, 1), statements, F.slice(lines, -1, 1)), "\n"
        ),
    )
    return nodes.unionByName(composed)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render outcomes: a quarter fail, half of those for a missing file."""
    return orders(spark, sf_dir).select(
        "sample_id", F.col("custkey").alias("image_id"),
        _mapped(F.col("priority"), POLICIES).alias("policy"),
        _mapped(F.col("status"), TIERS).alias("tier"),
        *_outcome_columns(),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


PREAMBLES = (
    "\\usepackage{pgfplots, amsmath}\n\\usepackage{foo}\n",
    "\\usepackage[x11names]{xcolor}\n\\usetikzlibrary{arrows.meta,calc}\n",
    "\\definecolor{ink}{rgb}{0,0,0.5}\n\\def\\globalscale {1.0}\n\\usepackage {siunitx}\n",
    "\\begin{axis}\\addplot {x};\\end{axis} \\draw (0,0) to[R, l=1] (2,0);\n",
    "",
)


def tex_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, "tex_docs", sf_dir, lambda: spliced_documents(spark, sf_dir))


def spliced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, code``: whole document text after a preamble, with none, one or two figures."""
    heads = F.array(*[F.lit(p) for p in PREAMBLES])
    doc = F.col("doc_id")
    first = G.family_markup("line_segment", SEED, doc % 50)
    second = G.family_markup("node_arrow", SEED, doc)
    code = F.concat(
        F.element_at(heads, (doc % len(PREAMBLES) + 1).cast("int")),
        F.col("text"),
        F.when(doc % 4 > 0, F.concat(F.lit("\n"), first)).otherwise(""),
        F.when(doc % 4 > 1, F.concat(F.lit("\nmore\n"), second)).otherwise(""),
    )
    rows = spread(documents(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "lang", "source", code.alias("code"))


def compositional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(
        spark, "compositional", sf_dir, lambda: compositional_figures(spark, sf_dir)
    )


def compositional_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grammar figure per customer."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    return spread(keys, "sample_id").withColumn(
        "markup",
        built_once(
            spark, ("compositional", SEED),
            lambda: G.compositional_markup(SEED, F.col("sample_id")),
        ),
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte intensities: 16 consecutive vectors of 64 values are one gray image."""
    level = lambda v: F.greatest(
        F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1.0) * 127.5))
    ).cast("double")
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.floor(F.col("vec_id") / RASTER_HEIGHT).cast("long").alias("image_id"),
        F.lit(0).alias("channel"),
        (F.col("vec_id") % RASTER_HEIGHT).cast("int").alias("y"),
        F.transform("embedding", level).alias("pixels"),
        F.col("label"),
    )


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a wall-clock timestamp."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def epoch_hours(ts: Column) -> Column:
    return F.floor(epoch_seconds(ts) / 3600).cast("long")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training telemetry: the type is the stage, the hour its epoch. Steps are
    averaged before anything is ordered, so windows run over epochs."""
    events = table(spark, sf_dir, "events")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    seconds = epoch_seconds(F.col("ts"))
    return events.groupBy(
        F.col("event_type").alias("stage"), epoch_hours(F.col("ts")).alias("epoch")
    ).agg(
        F.count(F.lit(1)).alias("samples"),
        (F.sum(cents) / F.lit(100.0) / F.count(F.lit(1))).alias("val_loss"),
        (F.max(seconds) - F.min(seconds)).alias("elapsed_seconds"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows per model, tier and seed, averaged from the orders."""
    cents = F.col("cents")
    rows = orders(spark, sf_dir).select(
        _mapped(F.col("priority"), POLICIES).alias("model"),
        _mapped(F.col("status"), TIERS).alias("tier"),
        (F.col("custkey") % 3).alias("seed"),
        (cents % 1009 / F.lit(1008.0)).alias("corpus_bleu"),
        (cents % 2003 / F.lit(2002.0)).alias("mean_geometric_edit_distance"),
        (cents % 3001 / F.lit(3000.0)).alias("mean_graph_edit_distance"),
        (cents % 4 != 0).cast("double").alias("compilation_rate"),
        (cents % 10007 / F.lit(10006.0)).alias("mean_ssim"),
    )
    return rows.groupBy("model", "tier", "seed").agg(
        *[F.avg(m).alias(m) for m in C.TIER_METRICS]
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the answer that follows: plain-text reference and candidate."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("reference")
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate")
    )
    return asked.join(answered, ["conv_id", "turn"])


def attempt_is_valid(key: Column, attempt: Column) -> Column:
    """Stand-in for a render that fails now and then."""
    return uniform(SEED, key, F.concat(F.lit("try"), attempt.cast("string"))) >= 0.4
