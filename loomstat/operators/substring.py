"""Longest substring shared by all strings of a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.suffixes import longest_matches
from loomstat.plans.keys import as_list, attach, cols, q
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze

# symbols whose suffixes are sorted at once; one longer pair of strings is sorted alone
SORTED_SYMBOLS = 1_000_000
# lengths that a task holds before it passes them on
HELD_LENGTHS = 4_000_000


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, lengths): per start in the key's first string, the least of a task's longest matches."""
    held: dict[int, np.ndarray] = {}
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int32()))],
            names=["__id", "__lengths"],
        )

    for batch in batches:
        ids, firsts, texts = (batch.column(k) for k in range(3))
        begin, symbols = 0, 0
        pairs: list[tuple[str, str]] = []
        for row in range(batch.num_rows):
            pair = firsts[row].as_py(), texts[row].as_py()
            pairs.append(pair)
            symbols += len(pair[0]) + len(pair[1])
            if symbols < SORTED_SYMBOLS and row < batch.num_rows - 1:
                continue
            for place, found in enumerate(longest_matches(pairs), begin):
                name = ids[place].as_py()
                if name in held:
                    np.minimum(held[name], found, out=held[name])
                else:
                    held[name] = found.astype(np.int32)
                    size += len(found)
            begin, symbols, pairs = row + 1, 0, []
            if size > HELD_LENGTHS:
                yield out()
                held.clear()
                size = 0
    if held:
        yield out()


def common_substring(
    df: DataFrame,
    by: str | Sequence[str] | None,
    column: str,
    order: str | Sequence[str],
) -> DataFrame:
    """Longest substring found in every string of a key, as ``common``.

    Ties go to the leftmost one in the first string by ``order``. A key with fewer than two
    strings gives ''. Each string is compared with the first one only: the suffixes of both are sorted together,
    which costs L log² L for L characters, many short pairs at once. The lengths found are reduced by a minimum per
    start, in the task and before the shuffle, so no task ever holds a key's strings.
    """
    by = as_list(by)
    rows = df.filter(q(column).isNotNull())
    key = F.struct(*cols(as_list(order)))
    heads = rows.groupBy(*cols(by)).agg(
        F.min_by(q(column), key).alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    # numbered in the frozen copy, so that a number names a key from here on
    heads = broadcast_if_small(freeze(heads.withColumn("__id", F.monotonically_increasing_id())))
    texts = rows.select(*cols(by), q(column).alias("__text")).distinct()
    usable = attach(texts, heads, by).filter((F.col("__n") > 1) & (F.length("__first") > 0))
    # the first string stays out of the grouping keys: it would travel once per start
    found = usable.select("__id", "__first", "__text").mapInArrow(_lengths, "__id long, __lengths array<int>")
    starts = found.select("__id", F.posexplode("__lengths").alias("__at", "__len"))
    shared = starts.groupBy("__id", "__at").agg(F.min("__len").alias("__len"))
    best = shared.groupBy("__id").agg(
        F.max_by(F.struct("__at", "__len"), F.struct("__len", -F.col("__at"))).alias("__b")
    )
    out = attach(heads, best, ["__id"], "left")
    text = F.substr(F.col("__first"), F.col("__b.__at") + 1, F.col("__b.__len"))
    return out.select(*cols(by), F.coalesce(text, F.lit("")).alias("common"))
