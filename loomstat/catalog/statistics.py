"""Intervals, tests, spectra, filters and partitions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.catalog.registry import Tables, query, r
from loomstat.functions.student_t import t_sf
from loomstat.operators import inference, resampling
from loomstat.operators.combinatorics import best_partitions, partitions_of, score_partitions
from loomstat.operators.signals import iir_filter, welch_psd
from loomstat.plans.limits import broadcast_if_small

# the 97.5 % point by the published expansion of t around the normal quantile
Z = 1.959963984540054


def t_point(dof: str) -> str:
    z = Z
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    return f"({z} + " + " + ".join(f"{c} / pow({dof}, {i + 1})" for i, c in enumerate(terms)) + ")"


@query(
    "t1_mean_ci",
    f"""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
               round(avg(value) - {t_point('(count(*) - 1)')} * stddev_pop(value) / sqrt(count(*)), 6) AS lower,
               round(avg(value) + {t_point('(count(*) - 1)')} * stddev_pop(value) / sqrt(count(*)), 6) AS upper
        FROM events GROUP BY 1""",
)
def t1(t: Tables):
    out = inference.mean_ci_t(t.events, "event_type", "value")
    return out.select("event_type", "n", *[r(c).alias(c) for c in ("mean", "std", "lower", "upper")])


GROUPS = """g AS (SELECT year(o_orderdate)::INT AS y, count(*) FILTER (o_orderstatus = 'F') AS na, count(*) FILTER (o_orderstatus = 'O') AS nb,
     avg(o_totalprice) FILTER (o_orderstatus = 'F') AS ma, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mb,
     stddev_pop(o_totalprice) FILTER (o_orderstatus = 'F') AS sa, stddev_pop(o_totalprice) FILTER (o_orderstatus = 'O') AS sb
     FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)"""


def _by_year(t: Tables):
    return t.orders.select(F.year("o_orderdate").alias("y"), "o_orderstatus", "o_totalprice")


@query(
    "t2_diff_ci",
    f"""WITH {GROUPS} SELECT y, na AS n_a, nb AS n_b, round(ma - mb, 3) AS diff,
          round(ma - mb - {t_point('(na + nb - 2)')} * sqrt(sa * sa / na + sb * sb / nb), 3) AS lower,
          round(ma - mb + {t_point('(na + nb - 2)')} * sqrt(sa * sa / na + sb * sb / nb), 3) AS upper FROM g""",
)
def t2(t: Tables):
    out = inference.diff_ci_t(_by_year(t), "y", "o_orderstatus", "o_totalprice", "F", "O")
    return out.select("y", "n_a", "n_b", *[r(c, 3).alias(c) for c in ("diff", "lower", "upper")])


@query(
    "t3_ttest",
    f"""WITH {GROUPS},
        s AS (SELECT *, na + nb - 2 AS dof, (ma - mb) / (sqrt(((na - 1) * sa * sa + (nb - 1) * sb * sb) / (na + nb - 2)) * sqrt(1.0 / na + 1.0 / nb)) AS t FROM g),
        -- upper tail by Simpson's rule on [t, t + 60]
        x AS (SELECT y, t + i * 0.005 AS u, CASE WHEN i IN (0, 12000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w,
                     dof, lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0) - 0.5 * ln(pi() * dof) AS c
              FROM s, range(0, 12001) AS q(i)),
        p AS (SELECT y, sum(w * exp(c - (dof + 1) / 2.0 * ln(1 + u * u / dof))) * 0.005 / 3 AS p FROM x GROUP BY y)
        SELECT y, na AS n_a, nb AS n_b, round(t, 6) AS t, dof, round(p, 6) AS p_value FROM s JOIN p USING (y)""",
)
def t3(t: Tables):
    out = inference.ttest_greater(_by_year(t), "y", "o_orderstatus", "o_totalprice", "F", "O")
    return out.select("y", "n_a", "n_b", r("t").alias("t"), "dof", r("p_value").alias("p_value"))


def _near(a, b, width):
    return (F.abs(a - b) < width).cast("int")


@query(
    "t4_mean_ci_bootstrap",
    "SELECT event_type, count(*) AS n, 1 AS lower_agrees, 1 AS upper_agrees FROM events GROUP BY 1",
)
def t4(t: Tables):
    """Both methods agree up to resampling noise and the skewness of the values."""
    boot = resampling.mean_ci_bootstrap(t.events, "event_type", "value", n=2000, seed=4)
    exact = inference.mean_ci_t(t.events, "event_type", "value").select(
        "event_type", F.col("lower").alias("low"), F.col("upper").alias("high")
    )
    slack = 0.15 * (F.col("high") - F.col("low"))
    return boot.join(exact, "event_type").select(
        "event_type", "n", _near(F.col("lower"), F.col("low"), slack).alias("lower_agrees"),
        _near(F.col("upper"), F.col("high"), slack).alias("upper_agrees"),
    )


@query(
    "t5_diff_ci_bootstrap",
    f"WITH {GROUPS} SELECT y, na AS n_a, nb AS n_b, 1 AS lower_agrees, 1 AS upper_agrees FROM g",
)
def t5(t: Tables):
    args = ("y", "o_orderstatus", "o_totalprice", "F", "O")
    boot = resampling.diff_ci_bootstrap(_by_year(t), *args, n=2000, seed=5)
    exact = inference.diff_ci_t(_by_year(t), *args).select("y", F.col("lower").alias("low"), F.col("upper").alias("high"))
    slack = 0.15 * (F.col("high") - F.col("low"))
    return boot.join(exact, "y").select(
        "y", "n_a", "n_b", _near(F.col("lower"), F.col("low"), slack).alias("lower_agrees"),
        _near(F.col("upper"), F.col("high"), slack).alias("upper_agrees"),
    )


@query(
    "t6_permutation_test",
    f"WITH {GROUPS} SELECT y, na AS n_a, nb AS n_b, 1 AS p_agrees FROM g",
)
def t6(t: Tables):
    args = ("y", "o_orderstatus", "o_totalprice", "F", "O")
    shuffled = resampling.permutation_test(_by_year(t), *args, n=4000, seed=6)
    exact = inference.ttest_greater(_by_year(t), *args).select("y", F.col("p_value").alias("p"))
    return shuffled.join(exact, "y").select("y", "n_a", "n_b", _near(F.col("p_value"), F.col("p"), 0.05).alias("p_agrees"))


@query(
    "t6_permutation_two_sided",
    f"WITH {GROUPS} SELECT y, na AS n_a, nb AS n_b, 1 AS p_agrees FROM g",
)
def t6b(t: Tables):
    """Within four standard errors of 10,000 shuffles of the p-value by the permuted difference's own variance."""
    args = ("y", "o_orderstatus", "o_totalprice", "F", "O")
    shuffled = resampling.permutation_test(_by_year(t), *args, n=10_000, seed=6, two_sided=True)
    v, in_a, in_b = F.col("o_totalprice"), F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    moments = _by_year(t).filter(in_a | in_b).groupBy("y").agg(
        F.var_pop(v).alias("var"), F.avg(F.when(in_a, v)).alias("ma"), F.avg(F.when(in_b, v)).alias("mb")
    )
    n = F.col("n_a") + F.col("n_b")
    sd = F.sqrt(F.col("var") * n * n / (F.col("n_a") * F.col("n_b") * (n - 1)))
    p = 2 * t_sf(F.abs(F.col("ma") - F.col("mb")) / sd, F.lit(1e9))
    slack = 4 * F.sqrt(p * (1 - p) / 10_000) + 0.01
    return shuffled.join(moments, "y").select("y", "n_a", "n_b", _near(F.col("p_value"), p, slack).alias("p_agrees"))


@query(
    "t8_ab_report_agrees",
    """SELECT metric, method, 1 AS agrees FROM (VALUES ('mean_a', 'bootstrap'), ('mean_b', 'bootstrap'), ('difference', 'bootstrap'),
         ('mean_a', 't'), ('mean_b', 't'), ('difference', 't'), ('a_greater_b', 't'), ('a_greater_b', 'permutation'), ('a_differs_b', 'permutation'))
         AS rows(metric, method)""",
)
def t8_agrees(t: Tables):
    """Every row of the report against closed forms: means, their variances and normal tails."""
    n = 10_000
    report = resampling.ab_report(t.events, None, "event_type", "value", "view", "click", n=n, seed=8)
    v, in_a, in_b = F.col("value"), F.col("event_type") == "view", F.col("event_type") == "click"
    m = t.events.filter(in_a | in_b).agg(
        F.count_if(in_a).alias("na"), F.count_if(in_b).alias("nb"), F.var_pop(v).alias("var"),
        F.avg(F.when(in_a, v)).alias("ma"), F.avg(F.when(in_b, v)).alias("mb"),
        F.var_pop(F.when(in_a, v)).alias("va"), F.var_pop(F.when(in_b, v)).alias("vb"),
    )
    rows = report.join(F.broadcast(m))
    metric, all_n, diff = F.col("metric"), F.col("na") + F.col("nb"), F.col("ma") - F.col("mb")
    value = F.when(metric == "mean_a", F.col("ma")).when(metric == "mean_b", F.col("mb")).otherwise(diff)
    a, b = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    sd = F.sqrt(F.when(metric == "mean_a", a).when(metric == "mean_b", b).otherwise(a + b))
    # four standard errors of a 2.5 % point of n draws are 0.11 deviations, and some for skewness
    interval = F.greatest(F.abs(F.col("lower") - (value - 1.96 * sd)), F.abs(F.col("upper") - (value + 1.96 * sd))) < 0.15 * sd
    z = diff / F.sqrt(F.col("var") * all_n * all_n / (F.col("na") * F.col("nb") * (all_n - 1)))
    p = F.when(metric == "a_differs_b", 2 * t_sf(F.abs(z), F.lit(1e9))).otherwise(t_sf(z, F.lit(1e9)))
    tested = F.abs(F.col("p_value") - p) < 4 * F.sqrt(p * (1 - p) / n) + 0.01
    return rows.select("metric", "method", F.coalesce(interval, tested).cast("int").alias("agrees"))


@query("t8_ab_report")
def t8(t: Tables):
    """All intervals and p-values of view against click events, 10,000 replicates each."""
    return resampling.ab_report(t.events, None, "event_type", "value", "view", "click", n=10_000, seed=8)


@query(
    "t8_ab_report_t_rows",
    f"""WITH g AS (SELECT count(*) FILTER (event_type = 'view') AS na, count(*) FILTER (event_type = 'click') AS nb,
               avg(value) FILTER (event_type = 'view') AS ma, avg(value) FILTER (event_type = 'click') AS mb,
               stddev_pop(value) FILTER (event_type = 'view') AS sa, stddev_pop(value) FILTER (event_type = 'click') AS sb FROM events),
        s AS (SELECT 'mean_a' AS metric, ma AS e, {t_point('(na - 1)')} * sa / sqrt(na) AS h FROM g
              UNION ALL SELECT 'mean_b', mb, {t_point('(nb - 1)')} * sb / sqrt(nb) FROM g
              UNION ALL SELECT 'difference', ma - mb, {t_point('(na + nb - 2)')} * sqrt(sa * sa / na + sb * sb / nb) FROM g)
        SELECT metric, round(e, 6) AS estimate, round(e - h, 6) AS lower, round(e + h, 6) AS upper FROM s""",
)
def t8t(t: Tables):
    report = resampling.ab_report(t.events, None, "event_type", "value", "view", "click", n=500, seed=8)
    rows = report.filter("method = 't' and metric <> 'a_greater_b'")
    return rows.select("metric", *[r(c).alias(c) for c in ("estimate", "lower", "upper")])


@query(
    "g1_welch_psd",
    """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
       s AS (SELECT user_id, seg, pos - 8 * seg AS i, value FROM (SELECT *, unnest([pos // 8, pos // 8 - 1]) AS seg FROM p) WHERE seg >= 0),
       f AS (SELECT *, count(*) OVER w AS n, value - avg(value) OVER w AS x FROM s WINDOW w AS (PARTITION BY user_id, seg)),
       d AS (SELECT user_id, seg, k, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 16)) * cos(2 * pi() * k * i / 16)) AS re,
                    sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 16)) * sin(2 * pi() * k * i / 16)) AS im
             FROM f, range(0, 9) AS q(k) WHERE n = 16 GROUP BY ALL)
       -- the squared window sums to 6
       SELECT user_id, k * 2.0 / 16 AS freq, round(avg(re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / (2.0 * 6), 4) + 0.0 AS psd
       FROM d GROUP BY user_id, k""",
)
def g1(t: Tables):
    psd = welch_psd(t.events, "user_id", ["ts", "event_id"], "value", fs=2.0, nperseg=16)
    return psd.withColumn("psd", r("psd", 4))


# long coefficients, so that no output lies on a rounding border
B = [0.2071067811865, 0.3141592653590, 0.1123456789012]
A = [1.0, -0.9016994374947, 0.4013579246801]


@query(
    "g2_iir_filter",
    f"""WITH RECURSIVE p AS (SELECT user_id, event_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
        y AS (SELECT user_id, event_id, pos, x, 0.0::DOUBLE AS x1, {B[0]} * x AS y, 0.0::DOUBLE AS y1 FROM p WHERE pos = 1
              UNION ALL
              SELECT p.user_id, p.event_id, p.pos, p.x, y.x,
                     {B[0]} * p.x + {B[1]} * y.x + {B[2]} * y.x1 - ({A[1]}) * y.y - ({A[2]}) * y.y1, y.y
              FROM y JOIN p ON p.user_id = y.user_id AND p.pos = y.pos + 1)
        SELECT event_id, round(y, 5) + 0.0 AS filtered FROM y""",
)
def g2(t: Tables):
    out = iir_filter(t.events, "user_id", ["ts", "event_id"], "value", B, A)
    return out.select("event_id", r("filtered", 5).alias("filtered"))


def _lines(t: Tables):
    """Distinct line numbers of every order; at most seven."""
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("items"))


def _shown(column: str):
    return F.array_join(F.transform(column, lambda b: F.array_join(b.cast("array<string>"), ",")), "|")


@query(
    "c1_set_partitions",
    """WITH RECURSIVE i AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS items FROM lineitem GROUP BY 1),
       s AS (SELECT l_orderkey, items, 1 AS k, 1 AS used, [items[1]::VARCHAR, '', ''] AS b FROM i
             UNION ALL
             SELECT l_orderkey, items, k + 1, greatest(used, c), [CASE WHEN c = j THEN CASE WHEN b[j] = '' THEN '' ELSE b[j] || ',' END || items[k + 1] ELSE b[j] END FOR j IN [1, 2, 3]]
             FROM (SELECT *, unnest(range(1, least(used + 1, 3) + 1)) AS c FROM s WHERE k < len(items)))
       SELECT l_orderkey, array_to_string(b, '|') AS blocks FROM s WHERE k = len(items) AND used = 3""",
)
def c1(t: Tables):
    return partitions_of(_lines(t), "items", 3, 7).select("l_orderkey", _shown("blocks").alias("blocks"))


@query(
    "c3_score_partitions",
    """WITH p AS (SELECT l_suppkey, l_linenumber AS c, count(l_quantity) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY ALL),
       -- every proper subset is a block of exactly one split in two
       i AS (SELECT l_suppkey, list_sort(list(c)) AS items FROM p GROUP BY 1),
       m AS (SELECT *, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM i),
       b AS (SELECT l_suppkey, [items[j] FOR j IN range(1, len(items) + 1) IF (mask >> (j - 1)) & 1 = 1] AS block FROM m)
       SELECT l_suppkey, array_to_string(block, ',') AS categories, sum(n)::BIGINT AS n, round(sum(s), 2) AS total
       FROM b JOIN p USING (l_suppkey) WHERE list_contains(block, c) GROUP BY 1, 2""",
)
def c3(t: Tables):
    scored = score_partitions(t.lineitem, "l_suppkey", "l_linenumber", "l_quantity", 2, 7)
    return scored.select(
        "l_suppkey", F.array_join(F.col("categories").cast("array<string>"), ",").alias("categories"), "n", F.round("total", 2).alias("total")
    )


@query(
    "c3_score_partitions_mean",
    """WITH p AS (SELECT l_suppkey, l_linenumber AS c, count(l_quantity) AS n, sum(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL),
       i AS (SELECT l_suppkey, list_sort(list(c)) AS items FROM p GROUP BY 1),
       m AS (SELECT *, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM i),
       b AS (SELECT l_suppkey, [items[j] FOR j IN range(1, len(items) + 1) IF (mask >> (j - 1)) & 1 = 1] AS block FROM m)
       SELECT l_suppkey, array_to_string(block, ',') AS categories, round(sum(s) / sum(n), 9) AS mean, min(lo) AS least, max(hi) AS most
       FROM b JOIN p USING (l_suppkey) WHERE list_contains(block, c) GROUP BY 1, 2""",
)
def c3_mean(t: Tables):
    def scored(agg: str, name: str):
        rows = score_partitions(t.lineitem, "l_suppkey", "l_linenumber", "l_quantity", 2, 7, agg)
        return rows.select("l_suppkey", F.array_join(F.col("categories").cast("array<string>"), ",").alias("categories"), F.col("total").alias(name))

    every = scored("mean", "mean").withColumn("mean", F.round("mean", 9))
    for agg, name in (("min", "least"), ("max", "most")):
        every = every.join(scored(agg, name), ["l_suppkey", "categories"])
    return every


# the 12 months of a nation's suppliers in two halves whose quantities differ least
@query(
    "c3_best_partitions",
    """WITH p AS (SELECT s_nationkey AS k, month(l_shipdate) AS c, sum(l_quantity) AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
       i AS (SELECT k, list(s ORDER BY c) AS t, list(c ORDER BY c) AS items, count(*) AS n FROM p GROUP BY k),
       -- the first category is always in the first half
       m AS (SELECT *, unnest(range(0, (1 << (n - 1)::INT) - 1)) * 2 + 1 AS mask FROM i),
       d AS (SELECT *, abs(list_sum([CASE WHEN (mask >> (j - 1)) & 1 = 1 THEN t[j] ELSE -t[j] END FOR j IN range(1, n + 1)])) AS cost FROM m),
       b AS (SELECT k, min(cost) AS cost, count(*) AS groupings FROM d GROUP BY k)
     SELECT k AS s_nationkey, round(cost, 6) AS cost, groupings, round((SELECT sum(s) FROM p WHERE p.k = b.k), 2) AS quantity,
       round(cost, 6) AS cost_of_blocks FROM b""",
)
def c3_best(t: Tables):
    nations = t.supplier.select("s_suppkey", "s_nationkey")
    lines = t.lineitem.join(broadcast_if_small(nations), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("month", F.month("l_shipdate"))
    best = best_partitions(lines, "s_nationkey", "month", "l_quantity", 2, 12).drop("place", "rank")
    per = lines.groupBy("s_nationkey", "month").agg(F.sum("l_quantity").alias("s"))
    joined = best.join(per, "s_nationkey")
    first = F.array_contains(F.col("blocks")[0], F.col("month"))
    sums = joined.groupBy("s_nationkey", "cost").agg(
        F.sum("s").alias("quantity"), F.abs(F.sum(F.when(first, F.col("s")).otherwise(-F.col("s")))).alias("cost_of_blocks"),
        (F.pow(F.lit(2.0), F.count(F.lit(1)) - 1) - 1).cast("long").alias("groupings"),
    )
    return sums.select(
        "s_nationkey", F.round("cost", 6).alias("cost"), "groupings", F.round("quantity", 2).alias("quantity"),
        F.round("cost_of_blocks", 6).alias("cost_of_blocks"),
    )


@query(
    "c2_ordered_partitions",
    """WITH i AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS items FROM lineitem GROUP BY 1),
       m AS (SELECT *, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM i)
       SELECT l_orderkey, array_to_string([items[j] FOR j IN range(1, len(items) + 1) IF (mask >> (j - 1)) & 1 = 1], ',') || '|' ||
              array_to_string([items[j] FOR j IN range(1, len(items) + 1) IF (mask >> (j - 1)) & 1 = 0], ',') AS blocks FROM m""",
)
def c2(t: Tables):
    return partitions_of(_lines(t), "items", 2, 7, ordered=True).select("l_orderkey", _shown("blocks").alias("blocks"))
