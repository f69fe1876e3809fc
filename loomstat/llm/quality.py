"""Quality scores from random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.text import row_id, sample_below, texts
from loomstat.llm.words import frequent
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze

# units (frequent words and shapes of all others) with a vector of their own, at most
UNITS = 2048
SIZE = 64
ONES = 6  # non-zero entries of an index vector
REACH = 2  # neighbours to each side
HIDDEN = 32
EPOCHS = 60
# expected number of labelled rows that the network is fitted on
SAMPLE_ROWS = 12_000
# shape of a byte: capital, small letter, digit, beyond ASCII, or itself
_SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else 126 if b >= 128 else b for b in range(256)
)


def shape(word: bytes) -> bytes:
    """Class of a word that is not frequent: shapes of its first and last bytes, and its length up to 8."""
    s = word.translate(_SHAPE)
    return b"\n" + s[:1] + s[-3:] + str(min(len(s), 8)).encode()


@dataclass
class Units:
    """Numbers of frequent words and of shapes; 0 stands for what was not seen."""

    number: dict[bytes, int]

    def of(self, text: bytes) -> np.ndarray:
        number = self.number
        get = number.get
        words = text.split()
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for k in np.flatnonzero(ids < 0).tolist():
            ids[k] = get(shape(words[k]), 0)
        return ids


def _unit_counts(frames):
    """(unit, n) per task: words and shapes, counted together."""
    from collections import Counter

    def out(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["unit", "n"]
        )

    counts: Counter[bytes] = Counter()
    for batch in frames:
        for text in texts(batch.column(0)):
            counts.update(text.split())
            if len(counts) > 300_000:
                yield out(_with_shapes(counts))
                counts.clear()
    yield out(_with_shapes(counts))


def _with_shapes(counts):
    shapes: dict[bytes, int] = {}
    for word, n in counts.items():
        s = shape(word)
        shapes[s] = shapes.get(s, 0) + n
    return {**counts, **shapes}


def index_vectors(units: list[bytes]) -> np.ndarray:
    """A sparse vector of +1 and -1 per unit, drawn from the hash of the unit."""
    out = np.zeros((len(units), SIZE), np.float32)
    for k, unit in enumerate(units):
        rng = np.random.default_rng(xxhash.xxh64_intdigest(unit, 1))
        places = rng.choice(SIZE, ONES, replace=False)
        out[k, places] = rng.choice([-1.0, 1.0], ONES)
    return out


def _contexts(shared):
    """(unit, vector) per task: sums of the index vectors of a unit's neighbours."""

    def run(frames):
        units, index = shared.value
        n = len(index)
        cells = np.zeros(n * n, np.int64)
        held, size = [], 0

        def add():
            nonlocal held, size, cells
            if held:
                cells += np.bincount(np.concatenate(held), minlength=n * n)
            held, size = [], 0

        for batch in frames:
            for text in texts(batch.column(0)):
                ids = units.of(text)
                for reach in range(1, REACH + 1):
                    held.append(ids[:-reach] * n + ids[reach:])
                    size += len(held[-1])
                if size > 2_000_000:
                    add()
        add()
        grid = cells.reshape(n, n).astype(np.float32)
        vectors = grid @ index + grid.T @ index
        for begin in range(0, n, 256):
            part = vectors[begin : begin + 256].astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(begin, begin + len(part)), SIZE) * SIZE + np.tile(np.arange(SIZE), len(part))), pa.array(part.ravel())],
                names=["cell", "x"],
            )

    return run


@dataclass
class Model:
    """Unit vectors and the network on pooled vectors; the scale holds the calibrated temperature."""

    units: Units
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: tuple[np.ndarray, ...]
    temperature: float

    def pool(self, text: bytes) -> np.ndarray:
        """Mean vector of the units of a text, and the logarithm of their number."""
        ids = self.units.of(text)
        out = np.zeros(SIZE + 1)
        if len(ids):
            counts = np.bincount(ids, minlength=len(self.vectors))
            out[:SIZE] = counts @ self.vectors / len(ids)
            out[SIZE] = np.log1p(len(ids))
        return out

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = _forward((pooled - self.mean) / self.spread, self.weights)[1] / self.temperature
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _forward(x: np.ndarray, weights) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = weights
    hidden = np.tanh(x @ a + b)
    return hidden, hidden @ c + d


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 3) -> tuple[tuple[np.ndarray, ...], float]:
    """Weights by Adam on four fifths of the rows, temperature by least log loss on the rest."""
    rng = np.random.default_rng(seed)
    n, size = x.shape
    weights = [rng.normal(0, 1 / np.sqrt(size), (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    order = rng.permutation(n)
    held, used = order[: n // 5], order[n // 5 :]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for begin in range(0, len(used), 128):
            rows = used[begin : begin + 128]
            hidden, z = _forward(x[rows], weights)
            slope = (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y[rows]) / len(rows)
            inner = np.outer(slope, weights[2]) * (1 - hidden**2)
            grads = [x[rows].T @ inner + 1e-4 * weights[0], inner.sum(axis=0), hidden.T @ slope + 1e-4 * weights[2], slope.sum()]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if not len(held):
        return tuple(weights), 1.0
    z = _forward(x[held], weights)[1]
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 41))
    losses = [np.mean(np.logaddexp(0, -(2 * y[held] - 1) * z / t)) for t in choices]
    return tuple(weights), float(choices[int(np.argmin(losses))])


def learn(
    docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
    label_key: str = "doc_id", sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Word vectors from all ``training`` texts; the network from about ``sample_rows`` labelled rows.

    Labels are read of training rows alone and rows without one are left out; labels of one key that contradict each
    other count as 1. Rows that agree in key and text count once, others of a key each. The sample is drawn from the rows by
    their digests. Without any labelled row, or with one class only, every score is the share of that class (0.5 without rows).
    """
    spark = docs.sparkSession
    trained = docs.filter(training).select(F.col(text).alias("text"))
    counts = trained.mapInArrow(_unit_counts, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    names = [b""] + [bytes(unit) for unit, _ in frequent(freeze(counts), UNITS - 1, "unit")]
    units = Units({u: k for k, u in enumerate(names) if k})
    index = index_vectors(names)
    shared = spark.sparkContext.broadcast((units, index))
    sums = trained.mapInArrow(_contexts(shared), "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    vectors = np.zeros(len(names) * SIZE)
    vectors[sums["cell"].to_numpy(np.int64)] = sums["x"].to_numpy()
    # whole numbers, so that the order of summing does not matter
    vectors = np.round(vectors).reshape(len(names), SIZE)
    # the own index vector keeps units apart that have like neighbours
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.maximum(norm, 1e-9) + index / np.sqrt(ONES)
    model = Model(units, vectors, np.zeros(SIZE + 1), np.ones(SIZE + 1), (), 1.0)

    marked = labels.select(F.col(label_key).alias("of"), F.col(label).cast("int").alias("y")).filter("of IS NOT NULL AND y IN (0, 1)")
    marked = marked.groupBy("of").agg(F.max("y").alias("y"))
    source = docs.filter(training).select(F.col(key).alias("key"), row_id(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    labelled = source.select("key", "row").join(broadcast_if_small(freeze(marked)), F.col("key") == F.col("of"))
    labelled = freeze(labelled.groupBy("row").agg(F.max("y").alias("y")))
    share = sample_rows / max(labelled.count(), 1)
    sample = freeze(labelled.filter(sample_below(F.hex("row"), share)).withColumnRenamed("row", "of"))
    chosen = source.join(broadcast_if_small(sample), F.col("row") == F.col("of")).dropDuplicates(["row"]).select("row", "y", "text")
    holder = spark.sparkContext.broadcast(model)

    def pooled(frames):
        for batch in frames:
            rows = [holder.value.pool(t).tolist() for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["row", "y", "x"]
            )

    rows = chosen.mapInArrow(pooled, "row binary, y int, x array<double>").collect()
    rows.sort(key=lambda r: bytes(r["row"]))
    y = np.array([r["y"] for r in rows], np.float64)
    if len(rows) < 10 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(rows) else 0.5, 0.01, 0.99))
        model.weights = (np.zeros((SIZE + 1, 1)), np.zeros(1), np.zeros(1), np.array(np.log(share / (1 - share))))
        return model
    x = np.array([r["x"] for r in rows])
    model.mean, model.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weights, model.temperature = fit_network((x - model.mean) / model.spread, y)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row of ``docs``, from the whole text alone.

    NULL and empty texts have a zero vector and its score. Repeated keys give a row each, an empty table
    none; other columns are neither read nor returned.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for batch in frames:
            found = shared.value
            pooled = np.array([found.pool(t) for t in texts(batch.column(1))]).reshape(-1, SIZE + 1)
            p = found.probability(pooled)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["key", "score", "predicted"]
            )

    return source.mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
