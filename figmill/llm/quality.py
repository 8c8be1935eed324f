"""Quality classifier on random-indexing word vectors.

Words share ``ROWS`` hashed rows. Each word has a fixed random index vector of a few +1 and -1;
a row's context vector sums the index vectors of the words beside its occurrences in the whole
corpus, so words used alike get like vectors. Rows are scaled to unit length. A document pools the
vectors of its words: their mean, their spread and the mean difference of neighbours, the last two
small where words repeat. A two-layer network of numpy reads the pooled vector; a temperature,
fitted on labelled rows outside the training, calibrates its probability.

Words are runs of letters and digits, or of other characters than white space, case kept. The
vectors read all documents; the table of rows bounds what is shipped. At most ``TRAIN_ROWS`` labelled
rows, picked by a hash of the row, train and calibrate the network. Texts without words (null,
empty) pool to zero. Without labels of both classes every score is the share of label 1 (0.5
without any). Repeated rows count again in the vectors and teach once; a null id joins no label.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.batches import SPACES, flat, mixed, run_hashes, runs, ship, slices
from figmill.llm.filters import hash_sample, joined
from figmill.sources.staging import stage

ROW_BITS = 13
ROWS = 1 << ROW_BITS
SIZE = 24
#: Entries of an index vector that are not zero.
ENTRIES = 4
#: Words to either side that count as beside.
REACH = 2
TRAIN_ROWS = 20_000
HIDDEN = 32
ROUNDS = 60
SLICE = 2 << 20

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table row of every word and the offsets of the texts."""
    data, offsets = flat(column)
    letters, other = _ALNUM[data], ~_ALNUM[data] & ~SPACES[data]
    a, b, _ = runs(letters, offsets)
    c, d, _ = runs(other, offsets)
    starts, ends = np.concatenate((a, c)), np.concatenate((b, d))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    table_rows = run_hashes(data, starts, ends) >> np.uint64(64 - ROW_BITS)
    return table_rows.astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors() -> np.ndarray:
    """The fixed index vector of each row."""
    out = np.zeros((ROWS, SIZE), np.float32)
    rows = np.arange(ROWS, dtype=np.uint64)
    for entry in range(ENTRIES):
        draw = mixed(rows * np.uint64(ENTRIES) + np.uint64(entry))
        place = (draw % np.uint64(SIZE)).astype(np.int64)
        out[np.arange(ROWS), place] += np.where(draw >> np.uint64(63), 1.0, -1.0)
    return out


def _context_sums(batches):
    index = index_vectors()
    sums = np.zeros((ROWS, SIZE), np.float64)
    for part in slices(batches, "text", SLICE):
        words, ends = word_rows(part.column("text"))
        if not len(words):
            continue
        vectors = index[words]
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        beside = np.zeros_like(vectors)
        for step in range(1, REACH + 1):
            same = (text[step:] == text[:-step])[:, None]
            beside[step:] += vectors[:-step] * same
            beside[:-step] += vectors[step:] * same
        for place in range(SIZE):
            sums[:, place] += np.bincount(words, beside[:, place], ROWS)
    used = np.flatnonzero(np.abs(sums).sum(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), *[pa.array(sums[used, p]) for p in range(SIZE)]],
        names=["row", *[f"v{p}" for p in range(SIZE)]],
    )


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vector of every row, summed over all documents."""
    names = [f"v{p}" for p in range(SIZE)]
    schema = "row long, " + ", ".join(f"{n} double" for n in names)
    found = (
        docs.select(F.col(text).alias("text"))
        .mapInArrow(_context_sums, schema)
        .groupBy("row")
        .agg(*[F.sum(n).alias(n) for n in names])
        .toPandas()
    )
    out = np.zeros((ROWS, SIZE))
    out[found["row"].to_numpy(np.int64)] = found[names].to_numpy(float)
    # The mean vector says only how frequent words are; what is left says how they are used.
    out -= out.sum(0) / max(np.abs(out).sum(), 1e-9) * np.abs(out).sum(1, keepdims=True)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each text's rows, zero for texts without any."""
    filled = np.diff(ends) > 0
    out = np.zeros((len(filled), values.shape[1]))
    if filled.any():
        out[filled] = np.add.reduceat(values, ends[:-1][filled], axis=0, dtype=np.float64)
    return out


def pool(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean, spread and mean difference of neighbours of each text's word vectors."""
    words, ends = word_rows(column)
    count = np.maximum(np.diff(ends), 1)[:, None]
    vectors = table[words]
    mean = _sums(vectors, ends) / count
    spread = np.sqrt(np.maximum(_sums(np.square(vectors, dtype=np.float64), ends) / count - mean**2, 0))
    steps = np.zeros_like(vectors)
    np.subtract(vectors[1:], vectors[:-1], out=steps[:-1])
    np.abs(steps, out=steps)
    inner = ends[1:][np.diff(ends) > 0] - 1
    steps[inner] = 0  # the next word is another text's
    change = _sums(steps, ends) / np.maximum(count - 1, 1)
    return np.concatenate((mean, spread, change), 1)


def pooled(docs: DataFrame, table: np.ndarray, text: str = "text", name: str = "pooled"):
    """``docs`` with the pooled vector of ``text``."""
    shipped = ship(docs.sparkSession, table)
    kept = docs.drop(name)
    schema = kept.withColumn(name, F.lit(None).cast("array<float>")).schema

    def work(batches):
        for part in slices(batches, text, SLICE):
            values = pool(part.column(text), shipped.value).astype(np.float32)
            places = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            column = pa.ListArray.from_arrays(pa.array(places), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, column], names=[*part.schema.names, name]
            )

    return kept.mapInArrow(work, schema)


class Network:
    """One hidden layer of rectified units and a calibrated logistic output."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """Train on three quarters of the rows, calibrate on the rest."""
        self.share = float(y.mean()) if len(y) else 0.5
        self.constant = len(y) < 8 or y.min() == y.max()
        if self.constant:
            return
        rng = np.random.default_rng(7)
        self.middle, self.scale = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(x))
        held, own = order[: len(x) // 4], order[len(x) // 4 :]
        z = self._scaled(x)
        self.weights = [
            rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
            np.zeros(1),
        ]
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(ROUNDS):
            rng.shuffle(own)
            for at in range(0, len(own), 128):
                step += 1
                for w, g, m, v in zip(
                    self.weights, self._slopes(z[own[at : at + 128]], y[own[at : at + 128]]),
                    first, second, strict=True,
                ):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    fair = np.sqrt(v / (1 - 0.999**step)) + 1e-8
                    w -= 3e-3 * (m / (1 - 0.9**step)) / fair
        self.temperature = self._fitted(self._logits(z[held]), y[held])

    def _scaled(self, x):
        return np.clip((x - self.middle) / self.scale, -8, 8)

    def _logits(self, z):
        w, b, u, c = self.weights
        return np.maximum(z @ w + b, 0) @ u + c

    def _slopes(self, z, y):
        w, b, u, c = self.weights
        hidden = np.maximum(z @ w + b, 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ u + c, -30, 30))) - y) / len(y)
        inner = np.outer(error, u) * (hidden > 0)
        decay = 1e-4
        return z.T @ inner + decay * w, inner.sum(0), hidden.T @ error + decay * u, error.sum()

    @staticmethod
    def _fitted(logits, y) -> float:
        """Temperature of the smallest log loss, from a fine grid."""
        grid = np.geomspace(0.25, 8, 61)
        losses = [
            np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)) for t in grid
        ]
        return float(grid[int(np.argmin(losses))])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.share)
        logits = self._logits(self._scaled(x)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def score(
    docs: DataFrame,
    labels: DataFrame,
    taught,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """``id, score`` of every document; ``taught`` is a condition on the id of rows to learn from."""
    own = docs.select(id_column, text)
    table = word_vectors(own, text)
    vectors = stage(pooled(own, table, text).select(id_column, "pooled"), "pooled")
    known = labels.filter(F.col(label).isin(0, 1)).filter(taught).select(id_column, label)
    rows = hash_sample(joined(vectors, known, id_column), TRAIN_ROWS)
    x = np.stack(rows["pooled"].to_numpy()).astype(float) if len(rows) else np.zeros((0, 3 * SIZE))
    network = ship(docs.sparkSession, Network(x, rows[label].to_numpy(float)))

    def work(batches):
        for batch in batches:
            values = batch.column("pooled").flatten().to_numpy(zero_copy_only=False)
            found = network.value.predict(values.reshape(batch.num_rows, -1).astype(float))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), pa.array(found)], names=[id_column, "score"]
            )

    schema = vectors.select(id_column).withColumn("score", F.lit(None).cast("double")).schema
    return vectors.mapInArrow(work, schema)
