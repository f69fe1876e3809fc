"""Windows, aggregates and order statistics over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.catalog.registry import Tables, query, r
from loomstat.catalog.tables import POINT
from loomstat.operators import aggregates as agg
from loomstat.operators import windows
from loomstat.operators.encode import decode_labels, encode_labels, fit_labels, impute_mean
from loomstat.operators.ranks import central_interval, percentiles
from loomstat.operators.substring import common_substring

ORDER = ["ts", "event_id"]


@query(
    "w1_moving_avg",
    """SELECT event_id, user_id, CASE WHEN count(value) OVER w >= 7 THEN round(avg(value) OVER w, 6) END AS value_avg
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def w1(t: Tables):
    out = windows.moving_avg(t.events.select("user_id", *ORDER, "value"), "user_id", ORDER, "value", 7)
    return out.select("event_id", "user_id", r("value_avg").alias("value_avg"))


@query(
    "w2_moving_sum",
    """SELECT event_id, CASE WHEN count(v) OVER w >= 3 THEN round(sum(v) OVER w, 4) END AS v_sum
       FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def w2(t: Tables):
    holes = t.events.select("user_id", *ORDER, F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return windows.moving_sum(holes, "user_id", ORDER, "v", 3).select("event_id", r("v_sum", 4).alias("v_sum"))


@query(
    "w3_moving_std",
    """SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(stddev_samp(value) OVER w, 5) END AS value_std
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def w3(t: Tables):
    out = windows.moving_std(t.events.select("user_id", *ORDER, "value"), "user_id", ORDER, "value", 5)
    return out.select("event_id", r("value_std", 5).alias("value_std"))


RUNS_SQL = """WITH p AS (
       SELECT user_id, value > 40 AS flag, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM p WHERE flag),
     s AS (SELECT user_id, n, min(pos) AS "start", max(pos) AS "end" FROM g GROUP BY user_id, n, island)
     SELECT user_id, "start", "end" FROM s"""


@query("w4_true_runs", RUNS_SQL + ' WHERE "start" > 0 AND "end" < n - 1')
def w4(t: Tables):
    flags = t.events.select("user_id", *ORDER, (F.col("value") > 40).alias("flag"))
    return windows.true_runs(flags, "user_id", ORDER, "flag")


@query("w4_true_runs_partial", RUNS_SQL)
def w4p(t: Tables):
    flags = t.events.select("user_id", *ORDER, (F.col("value") > 40).alias("flag"))
    return windows.true_runs(flags, "user_id", ORDER, "flag", partial=True)


@query(
    "w5_waterfall",
    """WITH d AS (SELECT event_id, value - 50 AS delta, sum(value - 50) OVER (PARTITION BY user_id ORDER BY ts, event_id
                  ROWS UNBOUNDED PRECEDING) AS run FROM events)
       SELECT event_id, round(100 + run - delta, 2) + 0.0 AS x0, round(100 + run, 2) + 0.0 AS x1,
              CASE WHEN delta >= 0 THEN 'positive' ELSE 'negative' END AS sign, format('{:,.2f}', delta) AS label
       FROM d""",
)
def w5(t: Tables):
    steps = t.events.select("user_id", *ORDER, (F.col("value") - 50).alias("delta"))
    out = windows.waterfall(steps, "user_id", ORDER, "delta", 100.0)
    return out.select("event_id", r("x0", 2).alias("x0"), r("x1", 2).alias("x1"), "sign", "label")


@query(
    "w5_waterfall_holes",
    """WITH d AS (SELECT event_id, user_id, ts, CASE WHEN event_type NOT IN ('error', 'signup') THEN value - 50 END AS delta FROM events),
          t AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM d)
       SELECT event_id, round(100 + run - delta, 2) + 0.0 AS x0, round(100 + run, 2) + 0.0 AS x1,
              CASE WHEN delta >= 0 THEN 'positive' WHEN delta < 0 THEN 'negative' END AS sign,
              CASE WHEN delta IS NOT NULL THEN format('{:,.2f}', delta) END AS label
       FROM t""",
)
def w5h(t: Tables):
    # blocks of a few rows, so that most keys are cut
    missing = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "signup", F.lit(float("nan")))
    steps = t.events.select("user_id", *ORDER, missing.otherwise(F.col("value") - 50).alias("delta"))
    out = windows.waterfall(steps, "user_id", ORDER, "delta", 100.0, max_rows=20)
    return out.select("event_id", r("x0", 2).alias("x0"), r("x1", 2).alias("x1"), "sign", "label")


@query(
    "w6_unkeyed_avg",
    """SELECT event_id, CASE WHEN count(value) OVER w >= 9 THEN round(avg(value) OVER w, 6) END AS value_avg
       FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)""",
)
def w6(t: Tables):
    # small blocks, so that the whole block path runs on the test tables too
    out = windows.moving_avg(t.events.select(*ORDER, "value"), None, ORDER, "value", 9, max_rows=2000)
    return out.select("event_id", r("value_avg").alias("value_avg"))


@query(
    "w1_moving_avg_long",
    """SELECT event_id, event_type, CASE WHEN count(value) OVER w >= 1000 THEN round(avg(value) OVER w, 6) END AS value_avg
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
)
def w1_long(t: Tables):
    out = windows.moving_avg(t.events.select("event_type", *ORDER, "value"), "event_type", ORDER, "value", 1000)
    return out.select("event_id", "event_type", r("value_avg").alias("value_avg"))


@query(
    "w3_moving_std_long",
    """SELECT event_id, CASE WHEN count(value) OVER w >= 1000 THEN round(stddev_samp(value) OVER w, 5) END AS value_std
       FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
)
def w3_long(t: Tables):
    out = windows.moving_std(t.events.select(*ORDER, "value"), None, ORDER, "value", 1000, max_rows=2000)
    return out.select("event_id", r("value_std", 5).alias("value_std"))


@query("a1_total_range", "SELECT event_type, round(max(value) - min(value), 6) AS total_range FROM events GROUP BY 1")
def a1(t: Tables):
    return agg.total_range(t.events, "event_type", "value").withColumn("total_range", r("total_range"))


def interval_sql(key: str, column: str, table: str, x: float) -> str:
    return f"""WITH v AS (SELECT {key} AS k, {column} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {column}) - 1 AS i,
                     count(*) OVER (PARTITION BY {key}) AS n FROM {table}),
       c AS (SELECT DISTINCT k, n FROM v),
       d AS (SELECT k, n, max(q) AS r FROM (SELECT k, n, unnest(range(0, n)) AS q FROM c) WHERE (n - q)::DOUBLE / n >= {x} GROUP BY k, n),
       h AS (SELECT v.k, d.n, d.r, max(v) FILTER (i = r // 2) AS a0, max(v) FILTER (i = r // 2 + 1) AS a1,
                    max(v) FILTER (i = d.n - r // 2 - 2) AS b1, max(v) FILTER (i = d.n - r // 2 - 1) AS b0
             FROM v JOIN d ON v.k = d.k GROUP BY v.k, d.n, d.r)
       SELECT k, CASE WHEN r % 2 = 1 AND a1 - a0 < b0 - b1 THEN a1 ELSE a0 END AS lower,
              CASE WHEN r % 2 = 1 AND NOT a1 - a0 < b0 - b1 THEN b1 ELSE b0 END AS upper, n, r AS dropped FROM h"""


@query("a2_central_interval", interval_sql("l_returnflag", "l_extendedprice", "lineitem", 0.95))
def a2(t: Tables):
    return central_interval(t.lineitem, "l_returnflag", "l_extendedprice", 0.95).withColumnRenamed("l_returnflag", "k")


@query(
    "a2_central_interval_unkeyed",
    f"SELECT lower, upper, n, dropped FROM ({interval_sql('1', 'value', 'events', 0.9)})",
)
def a2u(t: Tables):
    return central_interval(t.events, None, "value", 0.9, max_rows=1000)


@query(
    "a3_histogram",
    """WITH b AS (SELECT l_returnflag, floor((greatest(least(l_quantity, 45), 1) - 5) / 4)::INT AS i, count(*) AS c FROM lineitem GROUP BY ALL),
            k AS (SELECT l_returnflag, unnest(range(-1, 11)) AS i FROM (SELECT DISTINCT l_returnflag FROM lineitem))
       SELECT k.l_returnflag, 5.0 + 4 * i AS "left", 4.0 AS width, coalesce(c, 0) AS height, 7.0 + 4 * i AS center
       FROM k LEFT JOIN b USING (l_returnflag, i) WHERE i BETWEEN 0 AND 9 OR c > 0""",
)
def a3(t: Tables):
    return agg.histogram(t.lineitem, "l_returnflag", "l_quantity", list(range(5, 46, 4)))


@query(
    "a3_histogram_share",
    """WITH b AS (SELECT floor(least(value, 200) / 10)::INT AS i, count(*) AS c FROM events GROUP BY 1),
            k AS (SELECT unnest(range(0, 21)) AS i)
       SELECT 10.0 * i AS "left", 10.0 AS width, round(coalesce(c, 0) / (SELECT count(*) FROM events), 9) AS height, 5.0 + 10 * i AS center
       FROM k LEFT JOIN b USING (i) WHERE i < 20 OR c > 0""",
)
def a3p(t: Tables):
    out = agg.histogram(t.events, None, "value", list(range(0, 201, 10)), pdf=True)
    return out.withColumn("height", F.round("height", 9))


@query(
    "a5_common_substring",
    """WITH f AS (SELECT p_brand, p_size, arg_min(p_name, p_partkey) AS first, count(*) AS n FROM part GROUP BY ALL),
       s AS (SELECT p_brand, p_size, i, j, substring(first, i::INT, j::INT) AS x
             FROM (SELECT *, unnest(range(1, length(first) + 1)) AS i FROM f WHERE n > 1), range(1, 101) AS g(j)
             WHERE i + j - 1 <= length(first)),
       c AS (SELECT s.p_brand, s.p_size, i, j, x FROM s JOIN part USING (p_brand, p_size)
             GROUP BY ALL HAVING bool_and(contains(p_name, x))),
       b AS (SELECT p_brand, p_size, arg_max(x, (j, -i)) AS x FROM c GROUP BY ALL)
       SELECT f.p_brand, f.p_size, coalesce(x, '') AS common FROM f LEFT JOIN b USING (p_brand, p_size)""",
)
def a5(t: Tables):
    return common_substring(t.part, ["p_brand", "p_size"], "p_name", "p_partkey")


@query(
    "a5_common_substring_long",
    """WITH f AS (SELECT item_id % 20 AS k, arg_min(text, item_id) AS first, count(*) AS n FROM benchmark GROUP BY 1),
       s AS (SELECT k, n, i, j, substring(first, i::INT, j::INT) AS x
             FROM (SELECT *, unnest(range(1, length(first) + 1)) AS i FROM f WHERE n > 1), range(1, 31) AS g(j) WHERE i + j - 1 <= length(first)),
       c AS (SELECT s.k, i, j, x FROM s JOIN benchmark b ON s.k = b.item_id % 20 GROUP BY ALL HAVING bool_and(contains(b.text, x))),
       m AS (SELECT k, arg_max(x, (j, -i)) AS x FROM c GROUP BY 1)
       SELECT f.k, coalesce(x, '') AS common FROM f LEFT JOIN m USING (k)""",
)
def a5_long(t: Tables):
    items = t.benchmark.select("item_id", (F.col("item_id") % 20).alias("k"), "text")
    return common_substring(items, "k", "text", "item_id")


@query(
    "a6_impute_mean",
    """SELECT event_id, round(coalesce(CASE WHEN event_type <> 'error' THEN value END,
              (SELECT avg(value) FROM events WHERE event_type <> 'error')), 6) AS value FROM events""",
)
def a6(t: Tables):
    marked = F.when(F.col("event_type") == "error", "?").otherwise(F.col("value").cast("string"))
    out = impute_mean(t.events.select("event_id", marked.alias("value")), "value")
    return out.withColumn("value", r("value"))


@query(
    "a6_impute_mean_holes",
    """SELECT event_id, round(coalesce(CASE WHEN event_type NOT IN ('error', 'signup') THEN value END,
              (SELECT avg(value) FROM events WHERE event_type NOT IN ('error', 'signup'))), 6) AS value FROM events""",
)
def a6h(t: Tables):
    marked = F.when(F.col("event_type") == "error", "?").when(F.col("event_type") == "signup", "NaN")
    out = impute_mean(t.events.select("event_id", marked.otherwise(F.col("value").cast("string")).alias("value")), "value")
    return out.withColumn("value", r("value"))


LABELS = ["o_orderstatus", "o_orderpriority"]


@query(
    "a7_fit_labels",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS label, row_number() OVER (ORDER BY {c}) - 1 AS code
            FROM (SELECT DISTINCT {c} FROM orders)"""
        for c in LABELS
    ),
)
def a7(t: Tables):
    return fit_labels(t.orders, LABELS)


@query(
    "a7_encode_labels",
    """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus,
              dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders""",
)
def a7e(t: Tables):
    orders = t.orders.select("o_orderkey", *LABELS)
    return encode_labels(orders, fit_labels(orders, LABELS), LABELS)


@query("a7_decode_labels", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def a7d(t: Tables):
    orders = t.orders.select("o_orderkey", *LABELS)
    table = fit_labels(orders, LABELS)
    return decode_labels(encode_labels(orders, table, LABELS), table, LABELS)


@query(
    "a8_axis_range",
    """SELECT user_id, event_type, CASE WHEN min(value) < max(value) THEN min(value) WHEN min(value) = 0 THEN -1.0
              WHEN min(value) > 0 THEN 0.0 ELSE min(value) END AS low,
              CASE WHEN min(value) < max(value) THEN max(value) WHEN min(value) = 0 THEN 1.0
              WHEN min(value) > 0 THEN max(value) ELSE 0.0 END AS high FROM events GROUP BY ALL""",
)
def a8(t: Tables):
    return agg.axis_range(t.events, ["user_id", "event_type"], "value")


@query(
    "a9_map_viewport",
    f"""WITH b AS (SELECT c_nationkey, 6378137.0 * radians(min(lon)) AS x0, 6378137.0 * radians(max(lon)) AS x1,
                    6378137.0 * ln(tan(pi() / 4 + radians(min(lat)) / 2)) AS y0, 6378137.0 * ln(tan(pi() / 4 + radians(max(lat)) / 2)) AS y1
             FROM (SELECT c_nationkey, {POINT[0]} AS lon, {POINT[1]} AS lat FROM customer) GROUP BY 1),
        m AS (SELECT *, x1 - x0 > 1.5 * (y1 - y0) AS wide FROM b),
        e AS (SELECT *, CASE WHEN wide THEN 0.05 * (x1 - x0) ELSE (1.1 * (y1 - y0) * 1.5 - (x1 - x0)) / 2 END AS mx,
                     CASE WHEN wide THEN (1.1 * (x1 - x0) / 1.5 - (y1 - y0)) / 2 ELSE 0.05 * (y1 - y0) END AS my FROM m)
        SELECT c_nationkey, round(x0 - mx, 3) AS x0, round(x1 + mx, 3) AS x1, round(y0 - my, 3) AS y0, round(y1 + my, 3) AS y1 FROM e""",
)
def a9(t: Tables):
    spots = t.customer.select(
        "c_nationkey", F.expr(f"double({POINT[0]})").alias("lon"), F.expr(f"double({POINT[1]})").alias("lat")
    )
    view = agg.map_viewport(spots, "c_nationkey", "lon", "lat", 1.5)
    return view.select("c_nationkey", *[r(c, 3).alias(c) for c in ("x0", "x1", "y0", "y1")])


@query(
    "a10_curve_band",
    """SELECT l_returnflag, l_linenumber, round(avg(l_discount), 9) AS mean, min(l_discount) AS "min", max(l_discount) AS "max"
       FROM lineitem GROUP BY ALL""",
)
def a10(t: Tables):
    return agg.curve_band(t.lineitem, "l_returnflag", "l_linenumber", "l_discount").withColumn("mean", r("mean", 9))


@query(
    "a11_interval_extent",
    """SELECT o_orderpriority, round(min(o_totalprice) - 0.01 * (max(o_totalprice + o_custkey) - min(o_totalprice)), 4) AS low,
              round(max(o_totalprice + o_custkey) + 0.01 * (max(o_totalprice + o_custkey) - min(o_totalprice)), 4) AS high
       FROM orders GROUP BY 1""",
)
def a11(t: Tables):
    spans = t.orders.select(
        "o_orderpriority", F.col("o_totalprice").alias("start"), (F.col("o_totalprice") + F.col("o_custkey")).alias("end")
    )
    out = agg.interval_extent(spans, "o_orderpriority")
    return out.select("o_orderpriority", r("low", 4).alias("low"), r("high", 4).alias("high"))


@query(
    "a11_interval_extent_holes",
    """WITH h AS (SELECT event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 5 <> 0 THEN value + 1 END AS b FROM events)
       SELECT event_type, round(min(a) - 0.01 * (max(b) - min(a)), 4) AS low, round(max(b) + 0.01 * (max(b) - min(a)), 4) AS high
       FROM h GROUP BY 1""",
)
def a11h(t: Tables):
    # every row is there; some bounds are NULL or NaN
    spans = t.events.select(
        "event_type",
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("start"),
        F.when(F.col("event_id") % 5 != 0, F.col("value") + 1).otherwise(F.lit(float("nan"))).alias("end"),
    )
    out = agg.interval_extent(spans, "event_type")
    return out.select("event_type", r("low", 4).alias("low"), r("high", 4).alias("high"))


@query(
    "a11_interval_extent_times",
    """WITH s AS (SELECT l_linestatus, l_shipdate AS a, l_shipdate + to_days(l_linenumber) AS b FROM lineitem)
       SELECT l_linestatus, strftime(min(a) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS low,
              strftime(arg_max(b, (a, b)) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS high FROM s GROUP BY 1""",
)
def a11t(t: Tables):
    spans = t.lineitem.select(
        "l_linestatus", F.col("l_shipdate").alias("start"),
        (F.col("l_shipdate") + F.make_dt_interval("l_linenumber")).alias("end"),
    )
    out = agg.interval_extent(spans, "l_linestatus", order=["start", "end"])
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("low", "high")]
    return out.select("l_linestatus", *shown)


@query(
    "a12_percentiles",
    """SELECT event_type, p, round(v, 6) AS value FROM (
         SELECT event_type, unnest([0.025, 0.5, 0.975]::DOUBLE[]) AS p, unnest(quantile_cont(value, [0.025, 0.5, 0.975])) AS v
         FROM events GROUP BY 1)""",
)
def a12(t: Tables):
    return percentiles(t.events, "event_type", "value", [0.025, 0.5, 0.975]).withColumn("value", r("value"))


@query("a13_distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def a13(t: Tables):
    return agg.distinct_values(t.lineitem, ["l_returnflag", "l_linestatus"])
