"""Log-bilinear language model, trained by noise-contrastive estimation on the counts of the corpus.

The score of word w after word h is ``r_h . C . q_w + b_w``. The model needs the corpus only through
the counts of neighbouring words, which Spark gathers over all training texts; NCE then uses the exact
expectation over data and noise instead of drawn examples. Words beyond the ``VOCABULARY`` most
frequent ones are one class, inside which a word's share is its smoothed count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.text import row_id, texts
from loomstat.llm.words import frequent, pair_counts, tokens, word_counts
from loomstat.plans.positions import expand
from loomstat.plans.scratch import freeze

# words with a vector of their own; 0 is the class of all others, 1 the end (and start) of a text
VOCABULARY = 1022
SIZE = 32
NOISE = 16
STEPS = 120
RATE = 0.02
# share of the words' own distribution in every prediction
BACKOFF = 0.1
# most words whose counts are broadcast; a fixed number, the counts of all others are joined
FREQUENT = 131_072


def train(pairs: np.ndarray, seed: int = 7) -> np.ndarray:
    """log10 probabilities [before, word] from counts of neighbours, normalised for each word before.

    NCE against ``NOISE`` noise words from the words' own distribution, all counts at once, by Adam.
    """
    rng = np.random.default_rng(seed)
    n = len(pairs)
    counts = pairs.astype(np.float64)
    total = counts.sum()
    unigram = (counts.sum(axis=0) + 1.0) / (total + n)
    rows = counts.sum(axis=1, keepdims=True)
    log_noise = np.log(NOISE * unigram)
    weight = max(total, 1.0)
    params = [rng.normal(0, 0.1, (n, SIZE)), np.eye(SIZE), rng.normal(0, 0.1, (n, SIZE)), np.log(unigram)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        r, c, q, b = params
        predicted = r @ c
        score = predicted @ q.T + b
        real = 1.0 / (1.0 + np.exp(np.clip(log_noise - score, -60, 60)))
        slope = (counts * (1.0 - real) - NOISE * rows * unigram * real) / weight
        back = slope @ q
        grads = [back @ c.T - 1e-4 * r / n, r.T @ back, slope.T @ predicted - 1e-4 * q / n, slope.sum(axis=0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            ahead = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-10)
            params[k] = params[k] + RATE * (1 - step / (STEPS + 1)) * ahead
    r, c, q, b = params
    score = (r @ c) @ q.T + b
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p = (1 - BACKOFF) * p / p.sum(axis=1, keepdims=True) + BACKOFF * unigram / unigram.sum()
    return np.log10(p).astype(np.float32)


def _neighbours(n: int):
    def pairs(ids: np.ndarray) -> np.ndarray:
        return np.concatenate(([1], ids)) * n + np.concatenate((ids, [1]))

    return pairs


def _score(shared):
    """Rows per text: a head with the sums over frequent words, and one per other word with its number."""

    def run(frames):
        numbers, known, table, total, words = shared.value
        number, count = numbers.get, known.get
        bottom = np.log10(total + words + 1)
        schema = pa.schema(
            [("id", pa.binary()), ("key", pa.int64()), ("word", pa.string()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())]
        )
        for batch in frames:
            out = [[] for _ in schema]

            def add(*row):
                for column, x in zip(out, row, strict=True):
                    column.append(x)

            for place, text in enumerate(texts(batch.column(2))):
                found = tokens(text)
                ids = np.fromiter((number(w, 0) for w in found), np.int64, len(found))
                counts = np.fromiter((count(w, 0) for w in found), np.float64, len(found))
                near = table[np.concatenate(([1], ids)), np.concatenate((ids, [1]))]
                others: dict[bytes, int] = {}
                for k in np.flatnonzero(counts == 0).tolist():
                    others[found[k]] = others.get(found[k], 0) + 1
                ended = known[b"\n"]
                base = float((np.log10(counts[counts > 0] + 1) - bottom).sum() + np.log10(ended + 1) - bottom)
                inside = counts[(counts > 0) & (ids == 0)]
                model = float(near.sum(dtype=np.float64) + np.log10(inside + 1).sum())
                name, key = (batch.column(k)[place].as_py() for k in (0, 1))
                add(name, key, None, 0, len(found) + 1, int((counts > 0).sum()) + (ended > 0), base, model)
                for word, times in others.items():
                    add(name, None, word.decode("utf-8", "replace"), times, None, None, None, None)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out[:] = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def score_texts(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score), all sums of log10, for every row.

    Tokens are the words between ASCII blanks with A-Z in lower case, and one end. ``base_score`` is
    add-one smoothing over the counts of the ``training`` rows; ``score`` is the model's log10
    probability of the text. NULL and empty texts hold the end alone. Without training rows the base
    scores are 0. ``key`` is a whole number; rows of one key (NULL is one) are told apart by their texts, and
    rows that agree in both are scored together and come back as often as they are there. An empty table gives no rows; other
    columns are neither read nor returned.
    """
    spark = docs.sparkSession
    trained = docs.filter(training).select(F.col(text).alias("text"))
    counted = freeze(word_counts(trained))
    sizes = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = trained.count()
    total, distinct = sizes["n"] + ends, sizes["v"] + (ends > 0)
    top = frequent(counted, FREQUENT)
    counts = {word.encode(): n for word, n in top} | {b"\n": ends}
    numbers = {word.encode(): k + 2 for k, (word, _) in enumerate(top[:VOCABULARY])}
    n = VOCABULARY + 2
    rows = pair_counts(trained, spark.sparkContext.broadcast(numbers), _neighbours(n), n * n).toPandas()
    pairs = np.zeros(n * n, np.int64)
    pairs[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    table = train(pairs.reshape(n, n))
    # the share of a word inside the class of all others is its count plus one over the class's
    known = sum(n for _, n in top[:VOCABULARY])
    class_total = np.log10(sizes["n"] - known + sizes["v"] - len(numbers) + 1)
    table[:, 0] -= class_total
    shared = spark.sparkContext.broadcast((numbers, counts, table, total, distinct))
    source = docs.select(row_id(F.col(key), F.col(text)).alias("id"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    scored = source.mapInArrow(
        _score(shared), "id binary, key long, word string, times long, n_tokens long, n_known long, base double, model double"
    )
    rare = counted.select(F.col("word").alias("rare"), "n")
    # heads meet no rare word; their join key is unlike any word and differs by text
    joined = scored.withColumn("join_key", F.coalesce("word", F.concat(F.lit(" "), F.xxhash64("id").cast("string"))))
    joined = joined.join(rare, F.col("join_key") == F.col("rare"), "left")
    c = F.coalesce("n", F.lit(0))
    times = F.col("times")
    gain = times * F.log10(c + 1)
    lost = times * F.lit(float(np.log10(total + distinct + 1)))
    # equal rows have equal heads, and as many rows of each other word as heads
    copies = F.count("n_tokens")
    rare_known = F.sum(F.when(F.col("n").isNotNull(), times).otherwise(0))
    out = joined.groupBy("id").agg(
        F.max("key").alias("key"),
        copies.alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.call_function("div", rare_known, copies)).alias("n_known"),
        (F.max("base") + F.sum(F.when(F.col("word").isNotNull(), gain - lost).otherwise(0.0)) / copies).alias("base_score"),
        (F.max("model") + F.sum(F.when(F.col("word").isNotNull(), gain).otherwise(0.0)) / copies).alias("score"),
    )
    out = expand(out.drop("id"), "copies")
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
