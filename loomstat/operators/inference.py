"""Confidence intervals and p-values by the t-distribution.

Deviations are population deviations (divisor n). Moments come from one aggregate, and
the distribution is evaluated on the grouped rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.student_t import t_quantile, t_sf
from loomstat.functions.text import nan_to_null
from loomstat.plans.keys import as_list, cols, q


def _value(column: str) -> Column:
    return nan_to_null(q(column).cast("double"))


def mean_ci_t(
    df: DataFrame, by: str | Sequence[str] | None, column: str, confidence: float = 0.95
) -> DataFrame:
    """Mean and its interval ``lower, upper`` per key; NULL bounds below two values."""
    v, by = _value(column), as_list(by)
    moments = df.groupBy(*cols(by)).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )
    t = t_quantile(1 - (1 - confidence) / 2, F.col("n") - 1)
    half = F.col("__t") * F.col("std") / F.sqrt(F.col("n"))
    return moments.withColumn("__t", t).select(
        *cols(by), "n", "mean", "std", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper")
    )


def two_sample_moments(
    df: DataFrame, by: str | Sequence[str] | None, group: str, column: str, a: object, b: object
) -> DataFrame:
    """Count, mean and population deviation of both groups per key, in one pass."""
    v = _value(column)
    parts = []
    for tag, name in (("a", a), ("b", b)):
        x = F.when(q(group) == F.lit(name), v)
        parts += [
            F.count(x).alias(f"n_{tag}"),
            F.avg(x).alias(f"mean_{tag}"),
            F.stddev_pop(x).alias(f"std_{tag}"),
        ]
    return df.filter(q(group).isin(a, b)).groupBy(*cols(as_list(by))).agg(*parts)


def diff_ci_t(
    df: DataFrame,
    by: str | Sequence[str] | None,
    group: str,
    column: str,
    a: object,
    b: object,
    confidence: float = 0.95,
) -> DataFrame:
    """Difference of means a - b and its interval ``lower, upper`` per key."""
    m = two_sample_moments(df, by, group, column, a, b)
    na, nb = F.col("n_a"), F.col("n_b")
    diff = F.col("mean_a") - F.col("mean_b")
    error = F.sqrt(F.pow("std_a", F.lit(2)) / na + F.pow("std_b", F.lit(2)) / nb)
    out = m.withColumn("__t", t_quantile(1 - (1 - confidence) / 2, na + nb - 2)).withColumn("diff", diff)
    half = F.col("__t") * error
    return out.select(
        *cols(as_list(by)),
        "n_a",
        "n_b",
        "diff",
        (F.col("diff") - half).alias("lower"),
        (F.col("diff") + half).alias("upper"),
    )


def t_statistic(m: DataFrame) -> DataFrame:
    """Pooled statistic of :func:`two_sample_moments`: divisor-n variances weighted by n - 1."""
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(
        ((na - 1) * F.pow("std_a", F.lit(2)) + (nb - 1) * F.pow("std_b", F.lit(2))) / (na + nb - 2)
    )
    scale = pooled * F.sqrt(1 / na + 1 / nb)
    usable = (na + nb > 2) & (na > 0) & (nb > 0) & (scale > 0)
    return m.withColumn("t", F.when(usable, (F.col("mean_a") - F.col("mean_b")) / scale)).withColumn(
        "dof", na + nb - 2
    )


def ttest_greater(
    df: DataFrame, by: str | Sequence[str] | None, group: str, column: str, a: object, b: object
) -> DataFrame:
    """Statistic and upper-tail p-value of the hypothesis mean(a) > mean(b) per key."""
    out = t_statistic(two_sample_moments(df, by, group, column, a, b))
    return out.withColumn("p_value", t_sf("t", "dof")).select(
        *cols(as_list(by)), "n_a", "n_b", "t", "dof", "p_value"
    )
