"""Bootstrap intervals and permutation p-values for samples of any size.

The data is collapsed to (value, count) per key, which is exact and often tiny. The
distinct values are hashed into chunks of a few thousand, and each (chunk, slices of
replicates) is one unit of work, so that neither a key nor a replicate is tied to one
task. A slice has its own seed, so results do not depend on how many slices a unit takes. See ``loomstat.functions.draws`` for why the chunks add up to one exact draw. Only
sums per replicate are shuffled afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.draws import draws_of_chunk, generator, sums_of_chunk
from loomstat.functions.student_t import t_quantile, t_sf
from loomstat.functions.text import nan_to_null
from loomstat.operators.inference import t_statistic, two_sample_moments
from loomstat.plans.keys import as_list, attach, cols, q
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze

CHUNK_VALUES = 4096
SLICE = 250
# units of work planned per core; a unit takes several slices when there are more
UNITS_PER_CORE = 16
WITH_REPLACEMENT, WITHOUT = "bootstrap", "permutation"


def _sketch(df, by, column, group=None, a=None, b=None) -> DataFrame:
    """Columns ``by``, value ``v`` and its counts ``ca``, ``cb`` in the two samples.

    Written once: every later step reads this much smaller table.
    """
    v = nan_to_null(q(column).cast("double"))
    if group is None:
        rows = df.select(*cols(by), v.alias("v"), F.lit(True).alias("in_a"), F.lit(False).alias("in_b"))
    else:
        named = df.filter(q(group).isin(a, b))
        rows = named.select(
            *cols(by), v.alias("v"), (q(group) == F.lit(a)).alias("in_a"), (q(group) == F.lit(b)).alias("in_b")
        )
    counted = rows.filter("v is not null").groupBy(*cols(by), "v")
    return freeze(counted.agg(F.count_if("in_a").alias("ca"), F.count_if("in_b").alias("cb")))


def _sizes(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per key: group sizes and sums, summed over values."""
    return sketch.groupBy(*cols(by)).agg(
        F.sum("ca").alias("n_a"),
        F.sum("cb").alias("n_b"),
        F.sum(F.col("v") * F.col("ca")).alias("sum_a"),
        F.sum(F.col("v") * F.col("cb")).alias("sum_b"),
    )


def _problems(sketch: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    """Items to draw from: ``by``, ``side``, ``v``, count ``c`` and share of it in a ``ca``."""
    if kind == WITHOUT:
        return sketch.select(*cols(by), F.lit("a").alias("side"), "v", (F.col("ca") + F.col("cb")).alias("c"), "ca")
    sides = [F.struct(F.lit(s).alias("side"), F.col(f"c{s}").alias("c"), F.col(f"c{s}").alias("ca")) for s in "ab"]
    return sketch.select(*cols(by), "v", F.inline(F.array(*sides))).filter("c > 0")


def _problem_sizes(items: DataFrame, keys: Sequence[str], chunk_values: int) -> DataFrame:
    """Per draw problem: number of chunks, number of draws, its name and the seed of its draws."""
    sizes = freeze(
        items.groupBy(*cols(keys)).agg(
            F.ceil(F.count(F.lit(1)) / chunk_values).alias("chunks"), F.sum("ca").alias("total")
        )
    )
    # keys of any type travel through Python as one text, long enough that no two share it
    name = F.sha2(F.to_json(F.struct(*[q(k).alias(f"k{i}") for i, k in enumerate(keys)])), 256)
    return broadcast_if_small(sizes.withColumn("problem", name).withColumn("seed", F.xxhash64(*cols(keys))))


def _chunks(items: DataFrame, keys: Sequence[str], sizes: DataFrame) -> tuple[DataFrame, int]:
    """One row per chunk: sorted ``values``, ``counts``, ancestor weights, draws ``total``;
    and the number of chunks."""
    placed = attach(items, sizes, keys)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")))
    at = [*keys, "chunk"]
    pairs = F.array_sort(F.collect_list(F.struct("v", "c")))
    rows = placed.groupBy(*cols(at)).agg(
        pairs.alias("__pairs"), F.sum("c").alias("w"), F.max("chunks").alias("chunks"), F.max("total").alias("total"),
        F.max("problem").alias("problem"), F.max("seed").alias("seed"),
    )
    rows = rows.withColumn("values", F.col("__pairs.v")).withColumn("counts", F.col("__pairs.c")).drop("__pairs")
    largest, number = (x or 0 for x in sizes.agg(F.max("chunks"), F.sum("chunks")).first())
    if largest <= 1:
        empty = F.array().cast("array<long>")
        return rows.withColumn("left", empty).withColumn("right", empty).drop("w"), number
    rows = freeze(rows)
    height = F.ceil(F.log2(F.col("chunks"))).cast("int")
    levels = rows.filter("chunks > 1").select(
        *cols(at), "w", F.explode(F.sequence(F.lit(0), height - 1)).alias("level")
    )
    node = F.expr("shiftright(chunk, level)")
    levels = levels.withColumn("node", node).withColumn("parent", F.expr("shiftright(node, 1)"))
    even = F.col("node") % 2 == 0
    weights = levels.groupBy(*cols(keys), "level", "parent").agg(
        F.sum(F.when(even, F.col("w")).otherwise(0)).alias("l"), F.sum(F.when(even, 0).otherwise(F.col("w"))).alias("r")
    )
    # at most log2(chunks) entries per chunk
    paths = attach(levels, weights, [*keys, "level", "parent"]).groupBy(*cols(at)).agg(
        F.array_sort(F.collect_list(F.struct("level", "l", "r"))).alias("__path")
    )
    out = attach(rows, paths, at, "left")
    none = F.array().cast("array<long>")
    sides = {name: F.coalesce(F.col("__path").getField(name[0]), none) for name in ("left", "right")}
    return out.withColumns(sides).drop("__path", "w"), number


def _draw(kind: str, seed: int):
    replace = kind == WITH_REPLACEMENT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done: dict[tuple[str, int], np.ndarray] = {}
            for row in batch.itertuples(index=False):
                identity = (seed, int(replace), row.seed)
                values, counts = np.asarray(row.values), np.asarray(row.counts)
                for first in range(row.first, row.first + row.size, SLICE):
                    size = min(SLICE, row.first + row.size - first)
                    k = draws_of_chunk(
                        identity, row.chunk, first, row.left, row.right, row.total, size, replace
                    )
                    rng = generator(*identity, 2, row.chunk, first)
                    sums = sums_of_chunk(rng, values, counts, k, replace)
                    # chunks of one problem in one batch are added up before the shuffle
                    at = (row.problem, first)
                    done[at] = done[at] + sums if at in done else np.asarray(sums, dtype=float)
            yield pd.DataFrame(
                {"problem": [p for p, _ in done], "first": [f for _, f in done], "sums": list(done.values())}
            )

    return run


def _width(df: DataFrame, units: int) -> int:
    """Tasks for work that is long although its input is short: some per core, and never
    more than a few dozen units in one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(units, max(2 * cores, units // 64)))


def _replicates(
    sketch: DataFrame, by: Sequence[str], kind: str, n: int, seed: int, chunk_values: int
) -> DataFrame:
    """Columns ``by``, ``replicate``, and the drawn sums ``draw_a`` and ``draw_b``."""
    keys = [*by, "side"]
    items = _problems(sketch, by, kind)
    sizes = _problem_sizes(items, keys, chunk_values)
    chunks, number = _chunks(items, keys, sizes)
    cores = sketch.sparkSession.sparkContext.defaultParallelism
    slices = -(-n // SLICE)
    # values are copied once per unit
    together = max(1, min(slices, number * slices // (UNITS_PER_CORE * cores)))
    step = SLICE * together
    units = chunks.select(
        "problem", "seed", "chunk", "total", "values", "counts", "left", "right",
        F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(step))).alias("first"),
    )
    units = units.withColumn("size", F.least(F.lit(step), n - F.col("first")))
    units = units.repartition(_width(sketch, number * -(-slices // together)), "problem", "chunk", "first")
    drawn = units.mapInPandas(_draw(kind, seed), "problem string, first int, sums array<double>")
    sums = (
        drawn.select("problem", "first", F.posexplode("sums").alias("at", "x"))
        .groupBy("problem", (F.col("first") + F.col("at")).alias("replicate"))
        .agg(F.sum("x").alias("x"))
    )
    labelled = sums.join(sizes.select(*cols(keys), "problem"), "problem")
    return labelled.groupBy(*cols(by), "replicate").agg(
        F.max(F.when(F.col("side") == "a", F.col("x"))).alias("draw_a"),
        F.max(F.when(F.col("side") == "b", F.col("x"))).alias("draw_b"),
    )


def _with_sizes(reps: DataFrame, sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    return attach(reps, broadcast_if_small(_sizes(sketch, by)), by)


def _interval(value: Column, confidence: float) -> Column:
    alpha = (1 - confidence) / 2
    # a key has one row per replicate, so the exact percentile stays small
    return F.percentile(value, F.array(F.lit(alpha), F.lit(1 - alpha)))


def _bootstrap_means(sketch, by, n, seed, chunk_values) -> DataFrame:
    reps = _with_sizes(_replicates(sketch, by, WITH_REPLACEMENT, n, seed, chunk_values), sketch, by)
    return reps.withColumn("mean_a", F.col("draw_a") / F.col("n_a")).withColumn(
        "mean_b", F.col("draw_b") / F.col("n_b")
    )


def _exceeding(sketch, by, n, seed, chunk_values) -> DataFrame:
    """Per key: shares of permuted differences strictly above the observed one."""
    reps = _with_sizes(_replicates(sketch, by, WITHOUT, n, seed, chunk_values), sketch, by)
    both = F.col("sum_a") + F.col("sum_b")
    observed = F.col("sum_a") / F.col("n_a") - F.col("sum_b") / F.col("n_b")
    permuted = F.col("draw_a") / F.col("n_a") - (both - F.col("draw_a")) / F.col("n_b")
    # equal differences must not count as larger because sums were added in another order
    slack = 1e-12 * (F.abs(F.col("sum_a") / F.col("n_a")) + F.abs(F.col("sum_b") / F.col("n_b")))
    usable = reps.filter("n_a > 0 and n_b > 0")
    return usable.groupBy(*cols(by)).agg(
        F.avg((permuted > observed + slack).cast("double")).alias("p_greater"),
        F.avg((F.abs(permuted) > F.abs(observed) + slack).cast("double")).alias("p_two_sided"),
        F.max("n_a").alias("n_a"),
        F.max("n_b").alias("n_b"),
    ).filter("n_a > 0")


def mean_ci_bootstrap(
    df: DataFrame,
    by: str | Sequence[str] | None,
    column: str,
    confidence: float = 0.95,
    n: int = 10_000,
    seed: int = 0,
    chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """Percentile interval ``lower, upper`` of the means of n resamples per key."""
    by = as_list(by)
    means = _bootstrap_means(_sketch(df, by, column), by, n, seed, chunk_values)
    out = means.groupBy(*cols(by)).agg(_interval(F.col("mean_a"), confidence).alias("ci"), F.max("n_a").alias("n"))
    return out.filter("n > 0").select(*cols(by), "n", F.col("ci")[0].alias("lower"), F.col("ci")[1].alias("upper"))


def diff_ci_bootstrap(
    df: DataFrame,
    by: str | Sequence[str] | None,
    group: str,
    column: str,
    a: object,
    b: object,
    confidence: float = 0.95,
    n: int = 10_000,
    seed: int = 0,
    chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """Percentile interval of mean(a) - mean(b) with both samples resampled per key."""
    by = as_list(by)
    means = _bootstrap_means(_sketch(df, by, column, group, a, b), by, n, seed, chunk_values)
    out = means.groupBy(*cols(by)).agg(
        _interval(F.col("mean_a") - F.col("mean_b"), confidence).alias("ci"),
        F.max("n_a").alias("n_a"),
        F.max("n_b").alias("n_b"),
    )
    return out.filter("n_a > 0 and n_b > 0").select(
        *cols(by), "n_a", "n_b", F.col("ci")[0].alias("lower"), F.col("ci")[1].alias("upper")
    )


def permutation_test(
    df: DataFrame,
    by: str | Sequence[str] | None,
    group: str,
    column: str,
    a: object,
    b: object,
    n: int = 10_000,
    seed: int = 0,
    two_sided: bool = False,
    chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """Share of label shuffles whose difference of means is strictly above the observed one."""
    by = as_list(by)
    out = _exceeding(_sketch(df, by, column, group, a, b), by, n, seed, chunk_values)
    p = F.col("p_two_sided") if two_sided else F.col("p_greater")
    return out.select(*cols(by), "n_a", "n_b", p.alias("p_value"))


def ab_report(
    df: DataFrame,
    by: str | Sequence[str] | None,
    group: str,
    column: str,
    a: object,
    b: object,
    confidence: float = 0.95,
    n: int = 10_000,
    seed: int = 0,
    chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """Intervals and p-values of two groups by both methods, one row per key and metric.

    Columns: ``metric``, ``method``, ``estimate``, ``lower``, ``upper``, ``p_value``.
    """
    by = as_list(by)
    alpha = (1 - confidence) / 2
    m = t_statistic(two_sample_moments(df, by, group, column, a, b))
    na, nb = F.col("n_a"), F.col("n_b")
    m = m.withColumns(
        {
            "ta": t_quantile(1 - alpha, na - 1),
            "tb": t_quantile(1 - alpha, nb - 1),
            "td": t_quantile(1 - alpha, na + nb - 2),
            "p": t_sf("t", "dof"),
            "diff": F.col("mean_a") - F.col("mean_b"),
        }
    )
    none = F.lit(None).cast("double")

    def row(metric, method, estimate, lower=none, upper=none, p=none):
        return F.struct(
            F.lit(metric).alias("metric"), F.lit(method).alias("method"), estimate.alias("estimate"),
            lower.alias("lower"), upper.alias("upper"), p.alias("p_value"),
        )

    def around(metric, estimate, half):
        return row(metric, "t", estimate, estimate - half, estimate + half)

    error = F.sqrt(F.pow("std_a", F.lit(2)) / na + F.pow("std_b", F.lit(2)) / nb)
    by_t = m.select(
        *cols(by),
        F.inline(
            F.array(
                around("mean_a", F.col("mean_a"), F.col("ta") * F.col("std_a") / F.sqrt(na)),
                around("mean_b", F.col("mean_b"), F.col("tb") * F.col("std_b") / F.sqrt(nb)),
                around("difference", F.col("diff"), F.col("td") * error),
                row("a_greater_b", "t", F.col("t"), p=F.col("p")),
            )
        ),
    )
    sketch = _sketch(df, by, column, group, a, b)
    boot = _bootstrap_means(sketch, by, n, seed, chunk_values).withColumn("d", F.col("mean_a") - F.col("mean_b"))
    cis = boot.groupBy(*cols(by)).agg(
        _interval(F.col("mean_a"), confidence).alias("ca"),
        _interval(F.col("mean_b"), confidence).alias("cb"),
        _interval(F.col("d"), confidence).alias("cd"),
        (F.max("sum_a") / F.max("n_a")).alias("ma"),
        (F.max("sum_b") / F.max("n_b")).alias("mb"),
    )
    by_bootstrap = cis.select(
        *cols(by),
        F.inline(
            F.array(
                row("mean_a", "bootstrap", F.col("ma"), F.col("ca")[0], F.col("ca")[1]),
                row("mean_b", "bootstrap", F.col("mb"), F.col("cb")[0], F.col("cb")[1]),
                row("difference", "bootstrap", F.col("ma") - F.col("mb"), F.col("cd")[0], F.col("cd")[1]),
            )
        ),
    )
    tested = _exceeding(sketch, by, n, seed, chunk_values)
    by_shuffle = tested.select(
        *cols(by),
        F.inline(
            F.array(
                row("a_greater_b", "permutation", none, p=F.col("p_greater")),
                row("a_differs_b", "permutation", none, p=F.col("p_two_sided")),
            )
        ),
    )
    return by_t.unionByName(by_bootstrap).unionByName(by_shuffle)
