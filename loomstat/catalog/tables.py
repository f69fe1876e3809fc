"""Validation, cleaning, sorting and joins over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.catalog.registry import Tables, query, r
from loomstat.functions import text
from loomstat.functions.zones import zone_pairs
from loomstat.operators import joins, ordering, quality
from loomstat.operators.places import nearest_place


@query("p1_split_xy", "SELECT p_size, p_retailprice FROM part")
def p1(t: Tables):
    features, _ = quality.split_xy(t.part, ["p_size", "p_retailprice"], "p_type")
    return features


@query("p2_rename", "SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def p2(t: Tables):
    return quality.rename_columns(t.nation, {"n_nationkey": "id", "n_name": "name", "absent": "x"})


@query("p3_to_numeric", "SELECT event_id, value FROM events")
def p3(t: Tables):
    texts = t.events.select("event_id", F.col("value").cast("string").alias("value"))
    return quality.to_numeric(texts, "value")


@query("p3_bad_rows", "SELECT event_id, props AS mixed FROM events WHERE event_type = 'view'")
def p3b(t: Tables):
    mixed = F.when(F.col("event_type") == "view", F.col("props")).otherwise(F.col("value").cast("string"))
    return quality.bad_rows(t.events.select("event_id", mixed.alias("mixed")), "mixed")


@query("p4_decimal_comma", "SELECT event_id, value FROM events")
def p4(t: Tables):
    comma = F.translate(F.col("value").cast("string"), ".", ",")
    return t.events.select("event_id", text.decimal_comma(comma).alias("value"))


@query("p5_drop_missing", "SELECT event_id, value FROM events WHERE event_type NOT IN ('error', 'view')")
def p5(t: Tables):
    holes = F.when(F.col("event_type") == "error", None).when(
        F.col("event_type") == "view", float("nan")
    ).otherwise(F.col("value"))
    return quality.drop_missing(t.events.select("event_id", holes.alias("value")), "value")


@query(
    "p6_check",
    """SELECT * FROM (
         SELECT 'column' AS "check", 'value' AS "column", 0::BIGINT AS failures
         UNION ALL SELECT 'column', 'absent', 1
         UNION ALL SELECT 'rows', '', abs(count(*) - 7) FROM events
         UNION ALL SELECT 'no_nulls', 'value', count(*) FILTER (event_type = 'error') FROM events
         UNION ALL SELECT 'no_nulls', 'ts', 0
         UNION ALL SELECT 'unique', 'event_id', count(event_id) - count(DISTINCT event_id) FROM events
         UNION ALL SELECT 'unique', 'user_id', count(user_id) - count(DISTINCT user_id) FROM events
         UNION ALL SELECT 'width', 'parts', count(*) FILTER (len(string_split(props, '6')) <> 1) FROM events)""",
)
def p6(t: Tables):
    events = t.events.withColumn("value", F.when(F.col("event_type") != "error", F.col("value"))).withColumn(
        "parts", F.split("props", "6")
    )
    return quality.check(
        events, rows=7, no_nulls=["value", "ts"], unique=["event_id", "user_id"],
        columns=["value", "absent"], width=("parts", 1),
    )


@query("p7_contains_ci", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'data')")
def p7(t: Tables):
    return quality.contains_ci(t.documents, "text", "DaTa").select("doc_id", "lang")


@query(
    "p8_validate_entries",
    """WITH e AS (SELECT p_partkey, upper(p_name) AS entry FROM part),
       j AS (SELECT *, CASE WHEN entry = '' THEN 'empty' WHEN entry = 'RED WIDGET' THEN 'placeholder'
                            WHEN length(entry) > 11 THEN 'too_long' END AS r0 FROM e),
       k AS (SELECT *, row_number() OVER (PARTITION BY entry, r0 ORDER BY p_partkey) AS nth FROM j)
       SELECT p_partkey, entry, CASE WHEN r0 IS NOT NULL THEN r0
              WHEN nth > 1 OR entry IN (SELECT upper(c_name) FROM customer UNION ALL SELECT upper(p_name) || ' X' FROM part UNION ALL SELECT upper(min(p_name)) FROM part) THEN 'present' END AS reason
       FROM k""",
)
def p8(t: Tables):
    entries = t.part.select("p_partkey", F.col("p_name").alias("entry"))
    known = t.customer.select(F.upper("c_name").alias("entry"))
    known = known.union(t.part.select(F.upper(F.concat("p_name", F.lit(" X"))))).union(t.part.agg(F.upper(F.min("p_name"))))
    return quality.validate_entries(
        entries, "entry", "p_partkey", upper=True, max_len=11, placeholder="RED WIDGET", existing=known
    )


@query(
    "p9_normalize_dates",
    """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%d %B %Y') END AS day FROM orders)
       SELECT o_orderkey, day, CASE WHEN day IS NULL THEN 'unparseable'
              WHEN row_number() OVER (PARTITION BY day ORDER BY o_orderkey) > 1 THEN 'present' END AS reason
       FROM d""",
)
def p9(t: Tables):
    kind = F.col("o_orderkey") % 3
    written = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(kind == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise("no date")
    )
    days = t.orders.select("o_orderkey", written.alias("day"))
    return quality.normalize_dates(days, "day", "o_orderkey", ["yyyy-MM-dd", "dd/MM/yyyy"])


@query(
    "p10_sample_exact",
    """SELECT count(*) // 3 AS n, count(*) // 3 AS n_keys, count(*) // 3 AS n_known FROM orders""",
)
def p10(t: Tables):
    orders = t.orders
    sample = quality.sample_exact(orders, orders.count() // 3, 11, "o_orderkey")
    known = orders.select("o_orderkey", F.lit(1).alias("known"))
    return sample.join(known, "o_orderkey", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"), F.count("known").alias("n_known")
    )


@query("p11_table_view", "SELECT c_name, c_acctbal FROM customer")
def p11(t: Tables):
    return quality.table_view(t.customer, ["c_name", "c_acctbal"], required=["c_name"])


@query("o1_sort", "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events")
def o1(t: Tables):
    holes = F.when(F.col("event_type") != "error", F.col("value"))
    return ordering.sort_by(t.events.select("event_id", holes.alias("value")), ["value", "event_id"])


@query(
    "o2_order_by_list",
    "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) - 1 - s_suppkey AS rank FROM supplier",
)
def o2(t: Tables):
    suppliers = t.supplier.select("s_suppkey", "s_name")
    return ordering.order_by_list(suppliers, "s_suppkey", list(range(suppliers.count()))[::-1])


@query(
    "o2_order_table",
    """SELECT c_custkey, (c_custkey - lowest) * 7919 % n AS rank
       FROM customer, (SELECT min(c_custkey) AS lowest, count(*) AS n FROM customer)""",
)
def o2t(t: Tables):
    """An order as long as the table, itself a table."""
    n, lowest = t.customer.agg(F.count(F.lit(1)), F.min("c_custkey")).first()
    customers = t.customer.select("c_custkey", (F.col("c_custkey") - lowest).alias("i"))
    order = customers.select(F.col("i").alias("position"), (F.col("i") * 7919 % n).alias("rank"))
    return ordering.order_by_list(customers, "i", order).select("c_custkey", "rank")


@query(
    "o3_first_per_group",
    """SELECT user_id, event_id, event_type FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
)
def o3(t: Tables):
    return ordering.first_per_group(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "u1_stack_samples",
    """SELECT 'customer' AS sample, c_acctbal AS balance FROM customer
       UNION ALL SELECT 'supplier', s_acctbal FROM supplier""",
)
def u1(t: Tables):
    return ordering.stack_samples(
        {
            "customer": t.customer.select(F.col("c_acctbal").alias("balance")),
            "supplier": t.supplier.select(F.col("s_acctbal").alias("balance")),
        }
    ).select("sample", "balance")


@query(
    "j1_align_series",
    """WITH a AS (SELECT c_custkey % 1000 AS label, sum(c_nationkey)::BIGINT AS v, min(c_custkey) AS o FROM customer GROUP BY 1),
            b AS (SELECT s_suppkey * 3 AS label, s_nationkey::BIGINT AS v, s_suppkey AS o FROM supplier)
       SELECT coalesce(a.label, b.label) AS label, coalesce(a.v, 0) AS value_a, coalesce(b.v, 0) AS value_b,
              (a.label IS NOT NULL)::INT AS is_existing, coalesce(a.o, b.o) AS position
       FROM a FULL JOIN b ON a.label = b.label""",
)
def j1(t: Tables):
    a = t.customer.groupBy((F.col("c_custkey") % 1000).alias("label")).agg(
        F.sum("c_nationkey").alias("v"), F.min("c_custkey").alias("o")
    )
    b = t.supplier.select(
        (F.col("s_suppkey") * 3).alias("label"), F.col("s_nationkey").cast("long").alias("v"), F.col("s_suppkey").alias("o")
    )
    return joins.align_series(a, b, "label", "v", "o").withColumn("is_existing", F.col("is_existing").cast("int"))


@query(
    "j1_align_many",
    """SELECT l_linenumber, sum(l_quantity) FILTER (l_returnflag = 'A') AS "A",
              sum(l_quantity) FILTER (l_returnflag = 'N') AS "N", sum(l_quantity) FILTER (l_returnflag = 'R') AS "R"
       FROM lineitem GROUP BY l_linenumber""",
)
def j1m(t: Tables):
    sums = t.lineitem.groupBy("l_linenumber", "l_returnflag").agg(F.sum("l_quantity").alias("quantity"))
    return joins.align_many(sums, "l_linenumber", "l_returnflag", "quantity", ["A", "N", "R"])


@query(
    "j1_align_many_ordered",
    """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS place FROM orders GROUP BY ALL)
       SELECT o_custkey, coalesce(max(n) FILTER (o_orderstatus = 'F'), 0) AS "F", coalesce(max(n) FILTER (o_orderstatus = 'O'), 0) AS "O",
              coalesce(max(n) FILTER (o_orderstatus = 'P'), 0) AS "P", count(*) FILTER (o_orderstatus = 'F') > 0 AS is_existing,
              coalesce(max(place) FILTER (o_orderstatus = 'F'), max(place) FILTER (o_orderstatus = 'O'), max(place) FILTER (o_orderstatus = 'P')) AS position
       FROM c WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1""",
)
def j1o(t: Tables):
    counts = t.orders.groupBy("o_custkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("place")
    )
    return joins.align_many(counts, "o_custkey", "o_orderstatus", "n", ["F", "O", "P"], order="place")


ZONES = {"view": "PST", "click": "JST", "purchase": "CST", "signup": "US/Pacific", "error": "EST"}
ZONE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ZONES.items()) + " END"
ZONE_VALUES = ", ".join(f"('{a}', '{z}')" for a, z in zone_pairs() if a in ZONES.values())
LOCAL = "ts + to_days((event_id % 365)::INT)"
CANDIDATES_SQL = f"""
    z(zone_text, zone) AS (VALUES {ZONE_VALUES}),
    e AS (SELECT event_id, date_trunc('second', {LOCAL}) AS ts, {ZONE_CASE} AS zone_text FROM events),
    c AS (SELECT event_id, zone, ts, timezone('UTC', timezone(zone, ts)) AS utc FROM e JOIN z USING (zone_text)),
    h AS (SELECT event_id, zone, strftime(utc, '%Y-%m-%d %H:%M:%S') AS utc,
                 trunc(date_diff('second', utc, ts) / 3600.0)::INT AS hrs FROM c)"""


def _candidates(t: Tables):
    shifted = F.expr("date_trunc('SECOND', ts + make_dt_interval(int(event_id % 365)))")
    local = t.events.select("event_id", shifted.alias("ts"), F.expr(ZONE_CASE).alias("zone_text"))
    # a wall-clock time again, whatever date_trunc returned
    local = local.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumnRenamed("zone_text", "said")
    return joins.utc_candidates(local, "ts", "said")


@query("j2_utc_candidates", f"WITH {CANDIDATES_SQL} SELECT event_id, zone, utc, hrs FROM h")
def j2(t: Tables):
    return _candidates(t).select(
        "event_id", F.col("equivalent_zone").alias("zone"),
        F.date_format("datetime_utc", "yyyy-MM-dd HH:mm:ss").alias("utc"), F.col("hrs_wrt_utc").alias("hrs"),
    )


@query(
    "j3_expected_zone",
    f"""WITH {CANDIDATES_SQL} SELECT event_id, hrs, min(zone) AS zone FROM h
        WHERE contains(lower(zone), 'america') GROUP BY event_id, hrs""",
)
def j3(t: Tables):
    return joins.filter_expected_zone(_candidates(t), "event_id", "America").select(
        "event_id", F.col("hrs_wrt_utc").alias("hrs"), F.col("equivalent_zone").alias("zone")
    )


def _spot(key: str, lon_step: int, lat_step: int) -> tuple[str, str]:
    return f"(({key} * {lon_step}) % 36000) / 100.0 - 180", f"(({key} * {lat_step}) % 17800) / 100.0 - 89"


POINT, PLACE = _spot("c_custkey", 3701, 5303), _spot("s_suppkey", 7919, 3571)


@query(
    "j4_nearest_place",
    f"""WITH p AS (SELECT c_custkey, {POINT[0]} AS lon, {POINT[1]} AS lat FROM customer),
        g AS (SELECT s_suppkey, s_name || ', S' || s_nationkey AS place, {PLACE[0]} AS glon, {PLACE[1]} AS glat FROM supplier),
        d AS (SELECT c_custkey, s_suppkey, place, 2 * 6371.0088 * asin(sqrt(least(1.0,
                     pow(sin(radians(glat - lat) / 2), 2)
                     + cos(radians(lat)) * cos(radians(glat)) * pow(sin(radians(glon - lon) / 2), 2)))) AS km
              FROM p, g),
        n AS (SELECT c_custkey, arg_min(place, (km, s_suppkey)) AS place, min(km) AS km FROM d
              WHERE km <= 1500 GROUP BY c_custkey)
        SELECT p.c_custkey, n.place, round(n.km, 4) AS km FROM p LEFT JOIN n USING (c_custkey)""",
)
def j4(t: Tables):
    points = t.customer.select("c_custkey", F.expr(f"double({POINT[0]})").alias("lon"), F.expr(f"double({POINT[1]})").alias("lat"))
    places = t.supplier.select(
        F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("city"),
        F.concat(F.lit("S"), "s_nationkey").alias("state"),
        F.expr(f"double({PLACE[0]})").alias("lon"), F.expr(f"double({PLACE[1]})").alias("lat"),
    )
    near = nearest_place(points, places, 1500)
    return near.select("c_custkey", "place", r("km", 4).alias("km"))


@query("j5_labels_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j5(t: Tables):
    return joins.labels_not_in(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("j5_labels_not_in_other", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def j5o(t: Tables):
    return joins.labels_not_in(
        t.orders.select("o_custkey", "o_orderkey"), t.supplier.select(F.col("s_suppkey").alias("o_custkey")), "o_custkey"
    )


@query("j5_labels_in", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def j5i(t: Tables):
    return joins.labels_in(
        t.orders.select("o_custkey", "o_orderkey"), t.supplier.select(F.col("s_suppkey").alias("o_custkey")), "o_custkey"
    )
