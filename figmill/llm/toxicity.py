"""Toxicity by class-conditional Kneser-Ney models.

Two character models, of toxic and of ordinary text, score every word with its two edges. Orders
5 to 3 are counted for each class, so that a class that never saw a word says so; below them both
back off to the same counts of orders 2 and 1, which come from all documents, labelled or not. So
rare expressions are smoothed by what the whole corpus knows and cancel out where neither class
knows better. Highest orders count occurrences, lower ones distinct left neighbours, all with one
absolute discount.

Each word's log-likelihoods are compared; by how much the toxic one exceeds the other by more than
``MARGIN`` is the word's evidence, so the classes' mixture of languages and topics, which moves
every word a little, says nothing. A document's evidence is the mean over its words. A logistic
curve over its logarithm, fitted on labelled rows outside the counts, turns it into a score from
0 to 1.

All labelled rows are counted and all rows count for the shared orders. Counts are kept in tables
with a fixed number of slots (``SLOTS``), which bounds what travels to the executors; n-grams that
meet in a slot share their counts. ``CURVE_ROWS`` bounds the rows that fit the curve.

Words are runs of letters, lower-cased. Texts without words (null, empty) have evidence 0. Without
labels of both classes the curve is the evidence itself. Repeated rows count again, on the curve
once; a null id joins no label.
"""

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.batches import gather, lean_slices, mixed, row_sums, run_hashes, runs, ship
from figmill.llm.filters import hash_sample, joined
from figmill.llm.language import GAP, code_points
from figmill.sources.staging import stage

ORDER = 5
SHARED = 2
SYMBOL_BITS = 12
DISCOUNT = 0.75
#: Bits of the slot numbers: of n-grams and of their contexts, by order.
SLOTS = {5: (21, 19), 4: (19, 17), 3: (17, 15)}
CURVE_ROWS = 50_000
MARGIN = 5.0
#: Evidence that counts as none on the curve.
LEAST = 1e-3
#: Bytes of text that a worker holds as arrays at a time.
SLICE = 2 << 20
POOL = 2  # the class of the counts over all documents


def word_grams(texts: list[str]):
    """Distinct words of a slice: the word number of each word, row offsets of the words, packed
    n-grams of the distinct words and the offsets of each one's n-grams.

    An n-gram holds the symbol and the four before it, zero before the word's left edge.
    """
    points, ends = code_points(texts)
    starts, stops, rows = runs(points != GAP, ends)
    number, _ = pd.factorize(run_hashes(points.astype(np.uint64), starts, stops))
    first = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    begin, size = starts[first], (stops - starts)[first]
    letters = gather(points, begin, size).astype(np.int64)
    letters = np.where(letters < 1 << SYMBOL_BITS, letters, 2048 + letters % 2048)
    places = np.concatenate(([0], np.cumsum(size + 1)))
    symbols = np.full(places[-1], GAP, np.int64)
    within = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    symbols[np.repeat(places[:-1], size) + within] = letters
    at = np.arange(len(symbols)) - np.repeat(places[:-1], size + 1)
    grams = symbols.copy()
    for back in range(1, ORDER):
        before = np.zeros(len(symbols), np.int64)
        before[back:] = symbols[:-back]
        before = np.where(at >= back, before, np.where(at == back - 1, GAP, 0))
        grams |= before << (SYMBOL_BITS * back)
    return number, rows, grams, places


def gram_counts(docs: DataFrame, text: str = "text", kind: str = "kind") -> DataFrame:
    """``gram, kind, n``: occurrences of the packed n-grams by the class column ``kind``."""

    def work(batches):
        for part in lean_slices(batches, "text", SLICE):
            number, rows, grams, places = word_grams(
                pc.fill_null(part.column("text"), "").to_pylist()
            )
            owner = np.repeat(part.column("kind").to_numpy(zero_copy_only=False), np.diff(rows))
            for class_ in np.unique(owner):
                words = np.bincount(number[owner == class_], minlength=len(places) - 1)
                weights = np.repeat(words, np.diff(places))
                slot, names = pd.factorize(grams)
                n = np.bincount(slot, weights, len(names)).astype(np.int64)
                names, n = names[n > 0], n[n > 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(np.full(len(n), class_, np.int32)), pa.array(n)],
                    names=["gram", "kind", "n"],
                )

    picked = docs.select(F.col(text).alias("text"), F.col(kind).cast("int").alias("kind"))
    return picked.mapInArrow(work, "gram long, kind int, n long")


def slots(grams: np.ndarray, order: int, which: int) -> np.ndarray:
    """Slot of each n-gram (0) or context (1) of an order."""
    bits = SLOTS[order][which]
    return (mixed(grams.astype(np.uint64) + np.uint64(order)) >> np.uint64(64 - bits)).astype(
        np.int64
    )


class Model:
    """Count tables of both classes (order, slot, class) and the shared distribution."""

    def __init__(self, grams, contexts, shared):
        self.grams, self.contexts, self.shared = grams, contexts, shared

    def evidence(self, grams: np.ndarray) -> np.ndarray:
        """log P(symbol | before, toxic) - log P(symbol | before, ordinary) of packed n-grams."""
        low = grams & ((1 << SYMBOL_BITS * SHARED) - 1)
        base = self.shared_probability(low)
        chance = [base, base]
        for order in range(SHARED + 1, ORDER + 1):
            own = grams & ((1 << SYMBOL_BITS * order) - 1)
            slot, context = slots(own, order, 0), slots(own >> SYMBOL_BITS, order, 1)
            for class_ in (0, 1):
                total, types = self.contexts[order][:, class_][context].T
                n = self.grams[order][slot, class_]
                seen = np.maximum(n - DISCOUNT, 0.0) / np.maximum(total, 1)
                spare = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
                chance[class_] = seen + np.minimum(spare, 1.0) * chance[class_]
        return np.log(chance[1]) - np.log(chance[0])

    def shared_probability(self, pairs: np.ndarray) -> np.ndarray:
        keys, values, rest_of, single, floor = self.shared
        symbol, before = pairs & ((1 << SYMBOL_BITS) - 1), pairs >> SYMBOL_BITS
        one = single[symbol] + floor
        if not len(keys):
            return one
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        return np.where(keys[at] == pairs, values[at], 0.0) + rest_of[before] * one


def _hashed(table: DataFrame, column: str, order: int, which: int, **sums) -> np.ndarray:
    """Sums by slot as a dense array; a row for each slot at most reaches the driver."""
    bits = SLOTS[order][which]

    @F.pandas_udf("int")
    def slot(values: pd.Series) -> pd.Series:
        return pd.Series(slots(values.to_numpy(np.int64), order, which))

    found = (
        table.withColumn("slot", slot(column))
        .groupBy("slot")
        .agg(*[F.sum(expression).cast("float").alias(n) for n, expression in sums.items()])
        .toPandas()
    )
    out = np.zeros((1 << bits, len(sums)), np.float32)
    out[found["slot"].to_numpy(np.int64)] = found[list(sums)].to_numpy(np.float32)
    return out


def fit(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """Count ``labelled`` rows by class and all ``docs`` for the shared orders."""
    counted = gram_counts(labelled, text, label).unionByName(
        gram_counts(docs.withColumn("_pool", F.lit(POOL)), text, "_pool")
    )
    table = counted.groupBy("gram").agg(
        *[
            F.sum(F.when(F.col("kind") == class_, F.col("n")).otherwise(0)).alias(name)
            for class_, name in ((0, "ordinary"), (1, "toxic"), (POOL, "pool"))
        ]
    )
    table = stage(table, "grams5")
    grams, contexts = {}, {}
    classes = ("ordinary", "toxic")
    for order in range(ORDER, SHARED, -1):
        grams[order] = _hashed(table, "gram", order, 0, **{c: F.col(c) for c in classes})
        context = table.withColumn("context", F.shiftright("gram", SYMBOL_BITS))
        sums = {c: F.col(c) for c in classes} | {
            f"{c}_types": (F.col(c) > 0).cast("long") for c in classes
        }
        flat = _hashed(context, "context", order, 1, **sums)
        contexts[order] = np.stack((flat[:, [0, 1]], flat[:, [2, 3]]), axis=2)
        mask = F.lit((1 << SYMBOL_BITS * (order - 1)) - 1).cast("long")
        table = table.groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(
            *[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in (*classes, "pool")]
        )
        table = stage(table, f"grams{order - 1}")
    return Model(grams, contexts, _shared(table))


def _shared(table: DataFrame):
    """Distribution of the symbol after one symbol: discounted pairs and what is left for single
    symbols. At most ``2 ** 24`` pairs of symbols exist."""
    pairs = table.filter("pool > 0").select("gram", "pool").toPandas()
    keys = pairs["gram"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], pairs["pool"].to_numpy(np.float64)[order]
    width = 1 << SYMBOL_BITS
    before, symbol = keys >> SYMBOL_BITS, keys & (width - 1)
    total = np.bincount(before, n, width)
    types = np.bincount(before, minlength=width)
    rest = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
    values = np.maximum(n - DISCOUNT, 0) / total[before] if len(keys) else n
    single = np.bincount(symbol, minlength=width).astype(float)
    everything = max(single.sum(), 1.0)
    floor = DISCOUNT * max((single > 0).sum(), 1) / everything / width
    return keys, values, rest, np.maximum(single - DISCOUNT, 0) / everything, floor


def evidence(docs: DataFrame, model: Model, text: str = "text", name: str = "evidence"):
    """``docs`` with the mean evidence of its words."""
    shipped = ship(docs.sparkSession, model)
    kept = docs.drop(name)
    schema = kept.withColumn(name, F.lit(None).cast("double")).schema

    def work(batches):
        for part in lean_slices(batches, text, SLICE):
            number, rows, grams, places = word_grams(pc.fill_null(part.column(text), "").to_pylist())
            word = row_sums(shipped.value.evidence(grams), places)
            total = row_sums(np.maximum(word - MARGIN, 0.0)[number], rows)
            value = total / np.maximum(np.diff(rows), 1)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(value)], names=[*part.schema.names, name]
            )

    return kept.mapInArrow(work, schema)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and start of the logistic curve by Newton's method, with a small ridge."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, 0.0
    design = np.stack((x, np.ones(len(x))), 1)
    weights = np.zeros(2)
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (y - chance) - 1e-3 * weights
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0]), float(weights[1])


class Classifier(NamedTuple):
    """Count model and the logistic curve over the logarithm of the evidence."""

    model: Model
    slope: float
    start: float


def train(
    docs: DataFrame,
    labels: DataFrame,
    counted,
    curve,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Classifier:
    """Learn from all ``docs`` and from the labelled ones.

    ``counted`` and ``curve`` are conditions on the id: labelled rows for the counts and for the
    logistic curve. Labels of other rows teach nothing.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(id_column, label)
    own = docs.select(id_column, text)
    taught = joined(own.filter(counted), known.filter(counted), id_column)
    model = fit(own, taught, text, label)
    rest = joined(own.filter(curve), known.filter(curve), id_column)
    measured = evidence(rest, model, text).select(id_column, "evidence", label)
    fitted = hash_sample(measured, CURVE_ROWS)
    slope, start = logistic(
        np.log(fitted["evidence"].to_numpy(float) + LEAST), fitted[label].to_numpy(float)
    )
    return Classifier(model, slope, start)


def score(
    docs: DataFrame,
    classifier: Classifier,
    text: str = "text",
    name: str = "score",
    evidence_name: str = "evidence",
) -> DataFrame:
    """``docs`` with the columns ``evidence_name`` and ``name``."""
    logit = F.lit(classifier.slope) * F.log(F.col(evidence_name) + LEAST) + classifier.start
    found = evidence(docs, classifier.model, text, evidence_name)
    return found.withColumn(name, 1 / (1 + F.exp(-logit)))
