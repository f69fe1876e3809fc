"""Counts of words and of neighbouring words over a whole corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.text import LOWER, texts

# distinct words that a task holds before it passes its counts on
HELD_WORDS = 300_000
END = "\n"  # no word holds a line feed


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case."""
    return text.translate(LOWER).split()


def word_counts(source: DataFrame) -> DataFrame:
    """(word, n) over the texts of a one-column frame; counted per task before the shuffle."""

    def run(frames):
        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "n"],
            )

        counts: Counter[bytes] = Counter()
        for batch in frames:
            for text in texts(batch.column(0)):
                counts.update(tokens(text))
                if len(counts) > HELD_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int, word: str = "word") -> list[tuple]:
    """(word, n) of the ``most`` words with the highest n, ties to the smaller word, in falling order of n.

    Whole eighths of a power of two of the counts are taken while they fit, then the rest from the next one by an
    ordered limit, so only a few hundred sums and the words taken reach the driver.
    """
    eighth = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(eighth.alias("e")).agg(F.count(F.lit(1)).alias("words")).collect()
    cut, crossing, taken = None, None, 0
    for r in sorted(sizes, key=lambda r: -r["e"]):
        if taken + r["words"] > most:
            crossing = r["e"]
            break
        taken += r["words"]
        cut = r["e"]
    chosen = counts.select(word, "n")
    rows = chosen.filter(eighth >= cut).collect() if cut is not None else []
    if crossing is not None and taken < most:
        rows += chosen.filter(eighth == crossing).orderBy(F.desc("n"), word).limit(most - taken).collect()
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (-r[1], r[0]))


def pair_counts(source: DataFrame, shared, pairs: Callable[[np.ndarray], np.ndarray], size: int) -> DataFrame:
    """(cell, n): how often each cell number below ``size`` is given by ``pairs`` of a text's word numbers.

    ``shared`` broadcasts word to number; words without one are 0. A task sums its cells first, so at
    most ``size`` rows leave it.
    """

    def run(frames):
        number = shared.value.get
        total = np.zeros(size, np.int64)
        for batch in frames:
            held, size_held = [], 0
            for text in texts(batch.column(0)):
                words = tokens(text)
                held.append(pairs(np.fromiter((number(w, 0) for w in words), np.int64, len(words))))
                size_held += len(held[-1])
                if size_held > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, size_held = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    return source.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
