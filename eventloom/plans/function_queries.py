"""Queries that apply every row function to whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from eventloom.functions import dates as d
from eventloom.functions import scalar as s

from .register import query

MOMENT = datetime(2024, 2, 14, 15, 16, 17, 189000)


@query("""
SELECT event_id, value + user_id AS added, value - user_id AS subtracted, value * user_id AS multiplied,
  CASE WHEN user_id = 0 THEN NULL ELSE value / user_id END AS divided, CASE WHEN user_id % 7 = 0 THEN NULL ELSE (event_id::DOUBLE % (user_id % 7)::DOUBLE) END AS remainder,
  power(power((user_id % 5)::DOUBLE, 2), 3) AS powered, -value AS negated, ceil(value) AS up, floor(value) AS down, floor(value + 0.5) AS rounded,
  floor(value * 10 + 0.5) / 10.0 AS rounded1, ceil(value * 100) / 100.0 AS up2, floor(value * 100) / 100.0 AS down2 FROM events""")
def fn_mathematics(t):
    return t("events").select(
        "event_id",
        s.add("value", "user_id").alias("added"),
        s.subtract("value", "user_id").alias("subtracted"),
        s.multiply("value", "user_id").alias("multiplied"),
        s.divide("value", "user_id").alias("divided"),
        s.modulo("event_id", F.col("user_id") % 7).alias("remainder"),
        s.power(F.col("user_id") % 5, s.lit(2), s.lit(3)).alias("powered"),
        s.negate("value").alias("negated"),
        s.ceiling("value").alias("up"),
        s.floor("value").alias("down"),
        s.round_half_up("value").alias("rounded"),
        s.round_half_up("value", 1).alias("rounded1"),
        s.ceiling("value", 2).alias("up2"),
        s.floor("value", 2).alias("down2"),
    )


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (value::BIGINT) END AS b FROM events)
SELECT event_id, (a IS NOT DISTINCT FROM b) AS eq, (a IS DISTINCT FROM b) AS ne, coalesce(a > b, false) AS gt, coalesce(a < b, false) AS lt,
  coalesce(a >= b, a IS NULL AND b IS NULL) AS gte, coalesce(a <= b, a IS NULL AND b IS NULL) AS lte,
  (coalesce(a > 50, false) AND coalesce(b > 50, false)) AS both_, (coalesce(a > 50, false) OR coalesce(b > 50, false)) AS either_, NOT (a > 50) AS not_,
  CASE WHEN a > 50 THEN b WHEN NOT (a > 50) THEN a END AS if_, (a IS NULL) AS a_null, (a IS NOT NULL) AS a_value,
  coalesce(a + b, a, b)::DOUBLE AS added FROM e""")
def fn_logic(t):
    e = t("events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("a"), F.when(F.col("event_id") % 7 != 0, F.rint("value").cast("bigint")).alias("b"))
    high = F.col("a") > 50
    return e.select(
        "event_id",
        s.equals("a", "b").alias("eq"),
        s.not_equals("a", "b").alias("ne"),
        s.greater_than("a", "b").alias("gt"),
        s.less_than("a", "b").alias("lt"),
        s.greater_than_or_equal_to("a", "b").alias("gte"),
        s.less_than_or_equal_to("a", "b").alias("lte"),
        s.and_(high, F.col("b") > 50).alias("both_"),
        s.or_(high, F.col("b") > 50).alias("either_"),
        s.not_(high).alias("not_"),
        s.if_(high, "b", "a").alias("if_"),
        s.is_null("a").alias("a_null"),
        s.is_value("a").alias("a_value"),
        s.add("a", "b").alias("added"),
    )


@query("""
SELECT o_orderkey, (o_orderpriority || ':' || o_orderstatus) AS joined, contains(o_orderpriority, 'URG') AS has, lower(o_orderpriority) AS low, upper(o_orderpriority) AS up, length(o_orderpriority)::INTEGER AS len,
  (instr(o_orderpriority, '-') - 1)::INTEGER AS at, CASE WHEN instr(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, 1, instr(o_orderpriority, '-') - 1) ELSE '' END AS before,
  CASE WHEN instr(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, instr(o_orderpriority, '-') + 1) ELSE '' END AS after,
  substr(o_orderpriority, 3, 4) AS part, CASE WHEN length(o_orderpriority) <= 100 THEN '' END AS outside, regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$') AS matched,
  CASE WHEN regexp_full_match(o_orderpriority, '1-.*') OR regexp_full_match(o_orderpriority, '2-.*') THEN o_orderpriority END AS included,
  CASE WHEN NOT regexp_full_match(o_orderpriority, '1-.*') THEN o_orderpriority END AS excluded, regexp_replace(o_orderpriority, '[A-Z]', 'x', 'g') AS replaced,
  sha256(o_orderpriority) AS sha, md5('salt' || o_orderpriority) AS salted,
  CASE WHEN instr(reverse(o_orderpriority), 'E') = 0 THEN -1 ELSE length(o_orderpriority) - instr(reverse(o_orderpriority), 'E') END::INTEGER AS last_e FROM orders""")
def fn_text(t):
    p = "o_orderpriority"
    return t("orders").select(
        "o_orderkey",
        s.concat(p, s.lit(":"), "o_orderstatus").alias("joined"),
        s.contains(p, s.lit("URG")).alias("has"),
        s.lower_case(p).alias("low"),
        s.upper_case(p).alias("up"),
        s.string_length(p).alias("len"),
        s.index_of(p, s.lit("-")).alias("at"),
        s.substring_before(p, "-").alias("before"),
        s.substring_after(p, "-").alias("after"),
        s.substring(p, 2, 6).alias("part"),
        s.substring(p, 100, 110).alias("outside"),
        s.match(p, "[0-9]-[A-Z]+").alias("matched"),
        s.include(p, "1-.*", "2-.*").alias("included"),
        s.exclude(p, "1-.*").alias("excluded"),
        s.replace(p, "[A-Z]", "x").alias("replaced"),
        s.hash_text(p).alias("sha"),
        s.hash_text(p, "md5", "salt").alias("salted"),
        s.last_index_of(p, "E").alias("last_e"),
    )


_UNITS_SQL = ", ".join(
    f"epoch_ms(date_trunc('{u}', ts)) AS floor_{u}, epoch_ms(CASE WHEN ts > date_trunc('{u}', ts) THEN date_trunc('{u}', ts) + INTERVAL 1 {u} ELSE date_trunc('{u}', ts) END) AS ceiling_{u}, "
    f"epoch_ms(CASE WHEN ts > date_trunc('{u}', ts) + INTERVAL {h} THEN date_trunc('{u}', ts) + INTERVAL 1 {u} ELSE date_trunc('{u}', ts) END) AS round_{u}"
    for u, h in (("second", "500 MILLISECOND"), ("minute", "30 SECOND"), ("hour", "30 MINUTE"), ("day", "12 HOUR"), ("week", "84 HOUR"), ("month", "15 DAY"), ("year", "6 MONTH"))
)


@query(f"SELECT event_id, {_UNITS_SQL} FROM events")
def fn_date_rounding(t):
    return t("events").select("event_id", *[d.millis(f("ts", u)).alias(f"{n}_{u}") for u in d.UNITS for n, f in (("floor", d.floor_time), ("ceiling", d.ceiling_time), ("round", d.round_time))])


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS shown, strftime(ts, '%d/%m/%Y') AS day_shown, epoch_ms(date_trunc('millisecond', ts)) AS ms,
  epoch_ms(strptime(strftime(ts, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M')) AS parsed, (user_id * 60000)::BIGINT AS parsed_minutes,
  (user_id::VARCHAR || 'm') AS duration_text FROM events""")
def fn_date_formats(t):
    minutes = F.concat(F.col("user_id").cast("string"), F.lit("m"))
    return t("events").select(
        "event_id",
        d.format_date("ts").alias("shown"),
        d.format_date("ts", "dd/MM/yyyy").alias("day_shown"),
        d.millis("ts").alias("ms"),
        d.millis(d.parse_date(d.format_date("ts", "dd/MM/yyyy HH:mm"), "dd/MM/yyyy HH:mm")).alias("parsed"),
        d.parse_duration(minutes).alias("parsed_minutes"),
        minutes.alias("duration_text"),
    )


@query("""
SELECT epoch_ms(TIMESTAMP '2024-02-14 15:16:17.189') AS now_, epoch_ms(TIMESTAMP '2024-02-14 15:16:17') AS second_, epoch_ms(TIMESTAMP '2024-02-14 15:16:00') AS minute_,
  epoch_ms(TIMESTAMP '2024-02-14 15:00:00') AS hour_, epoch_ms(TIMESTAMP '2024-02-14') AS day_, epoch_ms(TIMESTAMP '2024-02-12') AS week_, epoch_ms(TIMESTAMP '2024-02-01') AS month_,
  epoch_ms(TIMESTAMP '2024-01-01') AS year_, epoch_ms(TIMESTAMP '2022-02-11 14:16:15.189') AS shifted, 5400000::BIGINT AS iso, '90m' AS spoken, 'PT1H30M' AS iso_text FROM region WHERE r_regionkey = 0""")
def fn_reference_times(t):
    moment = d.resolve_date("now()-2y3d1h2s", MOMENT)
    return t("region").where("r_regionkey = 0").select(
        d.millis(d.reference_time(None, MOMENT)).alias("now_"),
        *[d.millis(d.reference_time(u, MOMENT)).alias(f"{u}_") for u in ("second", "minute", "hour", "day", "week", "month", "year")],
        d.millis(d.reference_time(None, moment)).alias("shifted"),
        d.parse_iso_duration(F.lit("PT1H30M")).alias("iso"),
        d.format_duration(F.lit(5_400_000)).alias("spoken"),
        d.format_iso_duration(F.lit(5_400_000)).alias("iso_text"),
    )


@query("""
SELECT c_custkey, try_cast(c_mktsegment AS DOUBLE) AS d1, try_cast(c_custkey::VARCHAR AS INTEGER) AS i1, try_cast(c_custkey::VARCHAR AS BIGINT) AS l1, c_custkey::VARCHAR AS s1, (c_nationkey <> 0) AS b1,
  'long' AS t1, 'double' AS t2, 'string' AS t3, CASE WHEN c_nationkey = 3 THEN 'null' ELSE 'integer' END AS t4, true AS n1, false AS n2, true AS err FROM customer""")
def fn_casts_and_types(t):
    some = F.when(F.col("c_nationkey") != 3, F.col("c_nationkey"))
    return t("customer").select(
        "c_custkey",
        s.to_double("c_mktsegment").alias("d1"),
        s.to_integer(s.to_string("c_custkey")).alias("i1"),
        s.to_long(s.to_string("c_custkey")).alias("l1"),
        s.to_string("c_custkey").alias("s1"),
        s.to_boolean("c_nationkey").alias("b1"),
        s.type_of("c_custkey").alias("t1"),
        s.type_of("c_acctbal").alias("t2"),
        s.type_of("c_name").alias("t3"),
        s.type_of(some).alias("t4"),
        s.is_number("c_acctbal").alias("n1"),
        s.is_number("c_name").alias("n2"),
        s.is_error(s.to_double("c_mktsegment"), "c_mktsegment").alias("err"),
    )


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority, regexp_extract(url, '^[a-z]+://(?:[^@/?#]*@)?([^/:?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN instr(url, '?') > 0 THEN regexp_extract(url, '\?([^#]*)', 1) END AS query,
  CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*:[0-9]+') THEN regexp_extract(url, '^[a-z]+://[^/?#]*:([0-9]+)', 1) ELSE '-1' END AS port,
  regexp_extract(url, '^[^:]+:([^#]*)', 1) AS specific FROM pages""")
def fn_uris(t):
    return t("pages").select(
        "page_id",
        s.scheme_from_uri("url").alias("scheme"),
        s.authority_from_uri("url").alias("authority"),
        s.host_from_uri("url").alias("host"),
        s.path_from_uri("url").alias("path"),
        s.query_from_uri("url").alias("query"),
        s.port_from_uri("url").alias("port"),
        s.scheme_specific_part_from_uri("url").alias("specific"),
    )


@query("""
SELECT page_id, '[' || url_encode(url) || '](' || url_encode('?id=' || page_id) || '){stepping}' AS stepped, url_encode(url) AS encoded, url_decode(url_encode(url)) AS decoded,
  '[go](' || url_encode(url) || ')' AS linked FROM pages""")
def fn_links(t):
    return t("pages").select(
        "page_id", s.stepping_link("url", "page_id").alias("stepped"), s.encode_url("url").alias("encoded"), s.decode_url(s.encode_url("url")).alias("decoded"), s.link(s.lit("go"), "url").alias("linked")
    )


@query("""
WITH a AS (SELECT event_id, (user_id % 256) AS b, (event_id % 256) AS c FROM events)
SELECT event_id, (10 * 16777216 + b * 65536 + c * 256 + 1)::BIGINT AS n, (b < 128) AS inside, (10 * 16777216)::BIGINT AS lo, (10 * 16777216 + 8388607)::BIGINT AS hi,
  event_id::VARCHAR AS dec, upper(to_hex(event_id)) AS hexed FROM a""")
def fn_networks(t):
    a = t("events").select("event_id", F.format_string("10.%d.%d.1", F.col("user_id") % 256, F.col("event_id") % 256).alias("ip"))
    block = s.cidr_range(s.lit("10.0.0.0/9"))
    return a.select(
        "event_id", s.numeric_ip("ip").alias("n"), s.ip_in_cidr("ip", s.lit("10.0.0.0/9")).alias("inside"), block["lo"].alias("lo"), block["hi"].alias("hi"), s.hex_to_dec(F.hex("event_id")).alias("dec"), F.hex("event_id").alias("hexed")
    )
