"""Spectra and filters of sampled series; the samples of a series lie in its order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.blockfilter import SHORT, BlockFilter, block_filter
from loomstat.plans.keys import as_list, attach, cols, q
from loomstat.plans.positions import POS, positions
from loomstat.plans.scratch import freeze


def _schema(df: DataFrame, names: Sequence[str], extra: str) -> T.StructType:
    fields = [df.schema[n] for n in names]
    return T.StructType(fields + T.StructType.fromDDL(extra).fields)


# samples that are packed into one value, from which a task cuts its segments
_PACKED = 16_384


def _segments(x: np.ndarray, nperseg: int, step: int) -> np.ndarray:
    """The whole segments of a packed stretch, one per ``step`` samples, as a view."""
    if len(x) < nperseg:
        return np.empty((0, nperseg))
    return np.lib.stride_tricks.sliding_window_view(x, nperseg)[::step]


def _power_sums(by: list[str], nperseg: int, step: int, fs: float):
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    scale = np.full(nperseg // 2 + 1, 2.0 / (fs * (window**2).sum()))
    scale[0] /= 2
    if nperseg % 2 == 0:
        scale[-1] /= 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = [_segments(np.asarray(xs, dtype=float), nperseg, step) for xs in batch["xs"]]
            held = np.array([len(c) for c in cut], dtype=int)
            if not held.sum():
                continue
            batch, held, cut = batch[held > 0], held[held > 0], [c for c in cut if len(c)]
            x = np.concatenate(cut)
            x = (x - x.mean(axis=1, keepdims=True)) * window
            power = np.abs(np.fft.rfft(x, axis=1)) ** 2 * scale
            # segments of one key in one batch are added up before the shuffle
            if by:
                which = batch.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            else:
                which = np.zeros(len(batch), dtype=int)
            sums = np.zeros((which.max() + 1, power.shape[1]))
            np.add.at(sums, which, np.add.reduceat(power, np.cumsum(held) - held, axis=0))
            first = np.unique(which, return_index=True)[1]
            out = batch[by].iloc[first].reset_index(drop=True)
            out["segments"] = np.bincount(which, held).astype(int)
            out["power"] = list(sums)
            yield out

    return run


def welch_psd(
    df: DataFrame,
    by: str | Sequence[str] | None,
    order: str | Sequence[str],
    column: str,
    fs: float = 1.0,
    nperseg: int = 256,
    max_rows: int | None = None,
) -> DataFrame:
    """One-sided power density ``(freq, psd)`` averaged over half-overlapping segments.

    Periodic Hann window, segment mean removed, trailing partial segment dropped. A series
    shorter than one segment gives no rows, and one with a missing sample in a segment has NULL for ``psd``.
    A series is packed into aligned stretches of whole steps, some
    16,000 samples each, and a stretch also gets the half segment behind its end; no other sample is sent
    twice. Segments are cut and transformed in Arrow batches over many stretches and keys.
    """
    by, behind = as_list(by), nperseg // 2
    step = nperseg - behind
    size = step * max(1, _PACKED // step)
    x = q(column).cast("double").alias("__x")
    rows = positions(df.select(*cols(by), *cols(as_list(order)), x), by, as_list(order), max_rows)
    stretch = F.floor(F.col(POS) / size).cast("long")
    before = F.when((F.col(POS) % size < behind) & (stretch > 0), stretch - 1)
    cut = rows.select(*cols(by), POS, "__x", F.explode(F.array_compact(F.array(stretch, before))).alias("__stretch"))
    segments = (
        cut.groupBy(*cols(by), "__stretch")
        .agg(F.array_sort(F.collect_list(F.struct(POS, "__x"))).getField("__x").alias("xs"))
        .select(*cols(by), "xs")
    )
    schema = _schema(segments, by, "segments long, power array<double>")
    sums = segments.mapInPandas(_power_sums(by, nperseg, step, float(fs)), schema)
    return (
        sums.select(*cols(by), "segments", F.posexplode("power").alias("__i", "__p"))
        .groupBy(*cols(by), "__i")
        # the power of a stretch with a missing sample comes back as NULL, which a sum would pass over
        .agg(F.when(F.count("__p") == F.count(F.lit(1)), F.sum("__p") / F.sum("segments")).alias("psd"))
        .select(*cols(by), (F.col("__i") * (float(fs) / nperseg)).alias("freq"), "psd")
    )


def _end_states(keys: list[str], filt: BlockFilter):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            out["state"] = [filt.run(np.asarray(x, dtype=float))[1] for x in batch["xs"]]
            yield out

    return run


def _prefix_states(keys: list[str], step: np.ndarray):
    """Starting state of every entry of a chain that itself starts at rest, and its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            starts, ends = [], []
            for states in batch["states"]:
                z, chain = np.zeros(step.shape[0]), []
                for state in states:
                    chain.append(z)
                    z = step @ z + np.asarray(state)
                starts.append(chain)
                ends.append(z)
            out["starts"], out["end"] = starts, ends
            yield out

    return run


def _filtered(filt: BlockFilter, step: np.ndarray):
    """Column function: a block's output from its input and its starting state."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(xs: pd.Series, near: pd.Series, far: pd.Series, at: pd.Series) -> pd.Series:
        ys = []
        for x, z, top, i in zip(xs, near, far, at):
            start = None
            if z is not None:
                start = np.asarray(z) + np.linalg.matrix_power(step, int(i)) @ np.asarray(top)
            ys.append(filt.run(np.asarray(x, dtype=float), start)[0])
        return pd.Series(ys)

    return run


def iir_filter(
    df: DataFrame,
    by: str | Sequence[str] | None,
    order: str | Sequence[str],
    column: str,
    b: Sequence[float],
    a: Sequence[float],
    block: int = 16_384,
    chain: int = 1024,
    max_rows: int | None = None,
) -> DataFrame:
    """Direct-form filter from rest; gives ``by``, ``order``, the column and ``filtered``.

    A series is cut into blocks. Every block is filtered from rest on its own; block end
    states are chained in groups of ``chain`` blocks, the group ends once more per key, and
    each block is then filtered from its true starting state. No task ever holds a series.
    """
    by, order = as_list(by), as_list(order)
    if block % SHORT:
        raise ValueError(f"block must be a multiple of {SHORT}")
    filt = block_filter([float(v) for v in b], [float(v) for v in a])
    slim = df.select(*cols(by), *cols(order), q(column).cast("double").alias("__x"))
    rows = positions(slim, by, order, max_rows)
    packed = rows.groupBy(*cols(by), F.floor(F.col(POS) / block).cast("long").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct(POS, "__x", *cols(order)))).alias("rows")
    )
    # written once: read for the end states and again for the output
    packed = freeze(packed)
    xs = F.col("rows").getField("__x").alias("xs")
    top = packed.agg(F.max("blk")).first()[0]
    nothing = F.lit(None).cast("array<double>")
    if not top or not filt.order:
        started = packed.withColumns({"near": nothing, "far": nothing, "at": F.lit(0).cast("long")})
        step = np.eye(max(filt.order, 1))
    else:
        step = filt.power(block)
        keys = [*by, "blk"]
        ends = packed.select(*cols(keys), xs).mapInPandas(
            _end_states(keys, filt), _schema(packed, keys, "state array<double>")
        )
        grouped = ends.withColumn("grp", F.floor(F.col("blk") / chain).cast("long"))
        groups = grouped.groupBy(*cols(by), "grp").agg(
            F.array_sort(F.collect_list(F.struct("blk", "state"))).alias("__s")
        )
        groups = groups.select(*cols(by), "grp", F.col("__s.blk").alias("blks"), F.col("__s.state").alias("states"))
        names = [*by, "grp", "blks"]
        kind = "starts array<array<double>>, end array<double>"
        inner = freeze(groups.mapInPandas(_prefix_states(names, step), _schema(groups, names, kind)))
        tops = inner.groupBy(*cols(by)).agg(F.array_sort(F.collect_list(F.struct("grp", "end"))).alias("__s"))
        tops = tops.select(*cols(by), F.col("__s.grp").alias("grps"), F.col("__s.end").alias("states"))
        far_step = np.linalg.matrix_power(step, chain)
        outer = tops.mapInPandas(_prefix_states([*by, "grps"], far_step), _schema(tops, [*by, "grps"], kind))
        far = outer.select(*cols(by), F.explode(F.arrays_zip("grps", "starts")).alias("z")).select(
            *cols(by), F.col("z.grps").alias("grp"), F.col("z.starts").alias("far")
        )
        near = inner.select(*cols(by), "grp", F.explode(F.arrays_zip("blks", "starts")).alias("z")).select(
            *cols(by), "grp", F.col("z.blks").alias("blk"), F.col("z.starts").alias("near")
        )
        starts = attach(near, far, [*by, "grp"]).withColumn("at", F.col("blk") - F.col("grp") * chain)
        started = attach(packed, starts.drop("grp"), keys, "left")
    ys = _filtered(filt, step)(xs, "near", "far", "at")
    out = started.select(*cols(by), "rows", ys.alias("ys"))
    flat = out.select(*cols(by), F.explode(F.arrays_zip("rows", "ys")).alias("z"))
    return flat.select(
        *cols(by),
        *[F.col("z.rows").getField(o).alias(o) for o in order],
        F.col("z.rows").getField("__x").alias(column),
        F.col("z.ys").alias("filtered"),
    )
