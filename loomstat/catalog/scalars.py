"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.catalog.registry import Tables, query, r
from loomstat.functions import calendar as cal
from loomstat.functions import geo, signal, text
from loomstat.functions.zones import resolve_zone
from loomstat.operators.nested import flatten_discovered
from loomstat.operators.quality import flatten_nested, series_to_rows


@query(
    "f1_ordinal",
    """SELECT o_orderkey, o_orderkey::VARCHAR || CASE
         WHEN o_orderkey % 100 BETWEEN 10 AND 19 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st'
         WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS nth
       FROM orders""",
)
def f1(t: Tables):
    return t.orders.select("o_orderkey", text.ordinal("o_orderkey").alias("nth"))


@query(
    "f2_safe_filename",
    r"""SELECT page_id, rtrim(regexp_replace(url, '[^\p{L}\p{N} ._]', '', 'g')) AS filename FROM pages""",
)
def f2(t: Tables):
    return t.pages.select("page_id", text.safe_filename("url").alias("filename"))


@query(
    "f3_webm_to_gps",
    """SELECT o_orderkey, round(degrees((o_totalprice * 60 - 15000000) / 6378137.0), 6) + 0.0 AS lon,
              round(degrees(2 * atan(exp((o_custkey * 9.0 - 60000) / 6378137.0)) - pi() / 2), 6) + 0.0 AS lat
       FROM orders""",
)
def f3(t: Tables):
    lon, lat = geo.webm_to_gps(F.col("o_totalprice") * 60 - 15000000, F.col("o_custkey") * 9.0 - 60000)
    return t.orders.select("o_orderkey", r(lon).alias("lon"), r(lat).alias("lat"))


# spots derived from a key, so that every row has its own
LON, LAT = "((c_custkey * 37) % 36000) / 100.0 - 180", "((c_custkey * 53) % 18100) / 100.0 - 90.5"


@query(
    "f4_gps_to_webm",
    f"""WITH s AS (SELECT c_custkey, {LON} AS lon, {LAT} AS lat FROM customer)
        SELECT c_custkey, CASE WHEN abs(lat) < 90 THEN round(6378137.0 * radians(lon), 3) + 0.0 END AS x,
               CASE WHEN abs(lat) < 90
                    THEN round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) + 0.0 END AS y
        FROM s""",
)
def f4(t: Tables):
    spots = t.customer.select("c_custkey", F.expr(f"double({LON})").alias("lon"), F.expr(f"double({LAT})").alias("lat"))
    x, y = geo.gps_to_webm("lon", "lat")
    return spots.select("c_custkey", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query(
    "f5_aliased_freq",
    """SELECT o_orderkey, round(CASE WHEN floor(o_totalprice / 3000) % 2 = 0 THEN o_totalprice % 3000
                                     ELSE 3000 - o_totalprice % 3000 END, 6) + 0.0 AS alias
       FROM orders""",
)
def f5(t: Tables):
    return t.orders.select("o_orderkey", r(signal.aliased_freq("o_totalprice", 6000)).alias("alias"))


@query("f6_iso_week", "SELECT o_orderkey, strftime(o_orderdate, '%G-%V') AS week FROM orders")
def f6(t: Tables):
    return t.orders.select("o_orderkey", cal.iso_week("o_orderdate").alias("week"))


@query(
    "f7_week_to_date",
    """WITH w AS (
         SELECT o_orderkey, year(o_orderdate) AS y, (o_orderkey % 54)::INT AS n, (o_custkey % 7)::INT AS dow,
                make_date(year(o_orderdate), 1, 1) AS jan1, make_date(year(o_orderdate), 1, 4) AS jan4
         FROM orders)
       SELECT o_orderkey,
              strftime(CASE WHEN n = 0 AND isodow(jan1) = 1 THEN NULL
                ELSE date_trunc('week', jan1 + INTERVAL 6 DAY) + to_days(7 * (n - 1) + (dow + 6) % 7) END, '%Y-%m-%d') AS monday_based,
              strftime(CASE WHEN n = 0 THEN NULL
                ELSE date_trunc('week', jan4) + to_days(7 * (n - 1) + (dow + 6) % 7) END, '%Y-%m-%d') AS iso_based
       FROM w""",
)
def f7(t: Tables):
    week = F.concat(F.year("o_orderdate"), F.lit("-"), F.col("o_orderkey") % 54)
    dow = (F.col("o_custkey") % 7).cast("int")
    return t.orders.select(
        "o_orderkey",
        cal.week_to_date(week, dow).cast("string").alias("monday_based"),
        cal.week_to_date(week, dow, "iso").cast("string").alias("iso_based"),
    )


@query(
    "f8_week_begin",
    """SELECT o_orderkey, (isodow(o_orderdate) = 1)::INT AS is_begin,
              strftime(date_trunc('week', o_orderdate) + INTERVAL 7 DAY, '%Y-%m-%d') AS next_begin
       FROM orders""",
)
def f8(t: Tables):
    return t.orders.select(
        "o_orderkey",
        cal.is_week_begin("o_orderdate").cast("int").alias("is_begin"),
        cal.next_week_begin("o_orderdate").cast("string").alias("next_begin"),
    )


@query(
    "f9_week_end",
    """SELECT o_orderkey, (isodow(o_orderdate) = 7)::INT AS is_end,
              strftime(o_orderdate::DATE - (isodow(o_orderdate) % 7)::INT, '%Y-%m-%d') AS previous_end
       FROM orders""",
)
def f9(t: Tables):
    return t.orders.select(
        "o_orderkey",
        cal.is_week_end("o_orderdate").cast("int").alias("is_end"),
        cal.previous_week_end("o_orderdate").cast("string").alias("previous_end"),
    )


@query(
    "f10_datenum",
    """WITH d AS (SELECT o_orderkey, 719529.0::DOUBLE + o_custkey + o_totalprice / 1000000 AS x FROM orders)
       SELECT o_orderkey, (floor(x)::BIGINT - 719529) * 86400000000
                          + round((x - floor(x)) * 86400000000)::BIGINT AS micros FROM d""",
)
def f10(t: Tables):
    x = F.lit(719529.0) + F.col("o_custkey") + F.col("o_totalprice") / 1000000
    return t.orders.select("o_orderkey", cal.ntz_to_micros(cal.datenum_to_timestamp(x)).alias("micros"))


@query(
    "f11_epoch",
    """SELECT o_orderkey, epoch_us(to_timestamp(0) + to_microseconds(round(o_totalprice * 1000 * 1000000)::BIGINT)) AS micros
       FROM orders""",
)
def f11(t: Tables):
    return t.orders.select("o_orderkey", F.unix_micros(cal.epoch_to_timestamp(F.col("o_totalprice") * 1000)).alias("micros"))


ZONE_TEXT = """CASE event_type WHEN 'view' THEN 'PST' WHEN 'click' THEN 'JST' WHEN 'purchase' THEN 'CEST'
               WHEN 'signup' THEN 'Asia/Tokyo' ELSE 'no zone' END"""


@query(
    "f12_resolve_zone",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'US/Pacific' WHEN 'click' THEN 'Asia/Hong_Kong'
              WHEN 'purchase' THEN 'Europe/Berlin' WHEN 'signup' THEN 'Asia/Tokyo' END AS zone FROM events""",
)
def f12(t: Tables):
    return t.events.select("event_id", resolve_zone(F.expr(ZONE_TEXT)).alias("zone"))


@query(
    "f13_folder_label",
    "SELECT page_id, list_extract(string_split(url, '/'), -2) AS folder FROM pages",
)
def f13(t: Tables):
    return t.pages.select("page_id", text.folder_label("url").alias("folder"))


@query("f14_block_label", "SELECT p_partkey, p_brand || ', ' || p_type AS label FROM part")
def f14(t: Tables):
    return t.part.select("p_partkey", text.block_label(["p_brand", "p_type"]).alias("label"))


@query(
    "f15_bin_arithmetic",
    """SELECT o_orderkey, round((2 * o_totalprice + o_custkey) / 2, 4) AS center,
              round(o_totalprice - 0.01 * o_custkey, 4) + 0.0 AS low, round(o_totalprice + 1.01 * o_custkey, 4) AS high
       FROM orders""",
)
def f15(t: Tables):
    end = F.col("o_totalprice") + F.col("o_custkey")
    low, high = signal.padded("o_totalprice", end)
    return t.orders.select(
        "o_orderkey", r(signal.bin_center("o_totalprice", end), 4).alias("center"),
        r(low, 4).alias("low"), r(high, 4).alias("high"),
    )


@query(
    "f16_flatten_nested",
    """SELECT event_id, json_extract(props, '$.k')::BIGINT AS "props.k", user_id AS "who.user_id",
              event_type AS "who.what.event_type" FROM events""",
)
def f16(t: Tables):
    nested = t.events.select(
        "event_id",
        F.from_json("props", "k bigint").alias("props"),
        F.struct("user_id", F.struct("event_type").alias("what")).alias("who"),
    )
    return flatten_nested(nested)


@query(
    "f16_nested_keys",
    """SELECT event_id, json_extract(props, '$.k')::BIGINT AS props_k,
       CASE WHEN event_type = 'click' THEN value END AS m_click, CASE WHEN event_type = 'error' THEN value END AS m_error,
       CASE WHEN event_type = 'purchase' THEN value END AS m_purchase, CASE WHEN event_type = 'signup' THEN value END AS m_signup,
       CASE WHEN event_type = 'view' THEN value END AS m_view,
       CASE WHEN event_id % 3 = 0 THEN event_id // 2 ELSE user_id END::DOUBLE AS j_n,
       CASE WHEN event_id % 3 = 0 THEN event_type ELSE (user_id % 4)::VARCHAR END AS j_either,
       CASE WHEN event_id % 2 = 0 THEN user_id % 7 END AS j_who_day,
       CASE WHEN event_id % 2 = 0 THEN '' || user_id % 5 || ',-' ELSE '-,-' END AS j_parts_p,
       CASE WHEN event_id % 2 = 0 THEN '-,' || event_type ELSE event_type || ',' || event_type END AS j_parts_q
       FROM events""",
)
def f16n(t: Tables):
    """JSON text, a map by event type and made JSON whose keys and kinds vary by row."""
    whole = F.expr("event_id % 2 = 0")
    number = F.when(F.expr("event_id % 3 = 0"), F.concat((F.expr("event_id div 2")).cast("string"), F.lit(".0"))).otherwise(F.col("user_id").cast("string"))
    either = F.when(F.expr("event_id % 3 = 0"), F.to_json(F.array("event_type"))).otherwise(F.format_string("[%d]", F.expr("user_id % 4")))
    parts = F.when(whole, F.format_string('[{"p":%d},{"q":"%s"}]', F.expr("user_id % 5"), "event_type")).otherwise(
        F.format_string('[{"q":"%s"},{"q":"%s"}]', "event_type", "event_type")
    )
    who = F.when(whole, F.format_string('{"day":%d}', F.expr("user_id % 7"))).otherwise(F.lit("{}"))
    text = F.concat(
        F.lit('{"n":'), number, F.lit(',"either":'), F.regexp_replace(either, r"^\[|\]$", ""), F.lit(',"parts":'), parts, F.lit(',"who":'), who, F.lit("}")
    )
    flat = flatten_discovered(
        t.events.select("event_id", "props", F.create_map("event_type", "value").alias("m"), text.alias("j")), ["props", "j"], sep="_"
    )
    joined = {c: F.array_join(F.col(c).cast("array<string>"), ",", "-") for c in ("j_parts_p", "j_parts_q")}
    return flat.withColumns(joined)


@query(
    "f17_series_to_rows",
    """SELECT c_custkey, 'c_acctbal' AS "index", c_acctbal AS "values" FROM customer
       UNION ALL SELECT c_custkey, 'nation', c_nationkey::DOUBLE FROM customer""",
)
def f17(t: Tables):
    wide = t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return series_to_rows(wide, "c_custkey", ["c_acctbal", "nation"])
