"""Conditions, expressions with lookups, tables of the language, and row functions that need whole tables to show."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from eventloom.functions import FUNCTIONS, function
from eventloom.functions import dates as d
from eventloom.functions import scalar as s
from eventloom.functions.states import get_state
from eventloom.operators import conditions as c
from eventloom.operators import groups, lookups, state_tables, statistics, tables
from eventloom.operators.query import EventQuery

from .register import query


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 30000 AND o_totalprice >= 30000.5 AND o_totalprice < 200000 AND o_orderkey <= 5000 AND starts_with(o_orderpriority, '1') IS NOT NULL
  AND (starts_with(o_orderpriority, '1-') OR ends_with(o_orderpriority, 'LOW') OR regexp_matches(o_orderpriority, '^3.M'))""")
def q_comparisons(t):
    either = c.any_of(c.starts_with("o_orderpriority", "1-"), c.ends_with("o_orderpriority", "LOW"), c.matches("o_orderpriority", "^3.M"))
    price = c.all_of(c.greater_than("o_totalprice", 30000), c.greater_than_or_equal_to("o_totalprice", 30000.5), c.less_than("o_totalprice", 200000), c.less_than_or_equal_to("o_orderkey", 5000))
    return t("orders").where(price & either & c.not_equals("o_orderstatus", "f") & c.is_not_null("o_orderpriority") & ~c.is_null("o_orderstatus")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '(?i)^.*u.g.*$') OR regexp_matches(o_orderpriority, '(?i)^.*not .pec.*$')")
def q_contains_wildcards(t):
    return t("orders").where(c.any_of(c.contains("o_orderpriority", "u?g"), c.contains("o_orderpriority", "not ?pec"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), '-') AND contains(lower(o_orderpriority), 'e') AND NOT contains(lower(o_orderpriority), 'urgent')")
def q_quick_filter(t):
    return t("orders").where(c.quick_filter("o_orderpriority", "- E !URGENT")).select("o_orderkey")


@query("""
SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)""")
def q_in_folder(t):
    """Customers as documents below nations, nations below regions, two regions below one folder: a tree of four levels."""
    customer = t("customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("doc"), "c_nationkey")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    tree = (
        customer.select(F.col("doc").alias("node"), name("n", "c_nationkey").alias("parent"))
        .unionByName(t("nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent")))
        .unionByName(t("region").select(name("r", "r_regionkey").alias("node"), F.when(F.col("r_regionkey").isin(1, 3), "odd").otherwise("even").alias("parent")))
    )
    return c.in_folder(customer, "doc", tree, "odd").select("c_custkey")


@query("""
SELECT n_nationkey, n_regionkey = 2 AS is_that, n_nationkey % 2 = 0 AS of_type, n_nationkey % 2 = 0 AND n_regionkey = 2 AS of_that FROM nation""")
def q_doc_refs(t):
    kind = F.when(F.col("n_nationkey") % 2 == 0, "View").otherwise("Dictionary")
    ref = F.struct(kind.alias("type"), F.concat(F.lit("uuid-"), F.col("n_regionkey").cast("string")).alias("uuid"), F.col("n_name").alias("name"))
    return t("nation").select("n_nationkey", c.is_doc_ref(ref, "uuid-2").alias("is_that"), c.of_doc_ref(ref, "View").alias("of_type"), c.of_doc_ref(ref, "View", "uuid-2").alias("of_that"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <= 2")
def q_nested_dictionary(t):
    """A dictionary of nations by region; that of region 2 imports that of 1, which imports that of 0 and, again, that of 2's import."""
    words = t("nation").select(F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("name"), F.col("n_nationkey").alias("word"))
    steps = t("region").where("r_regionkey > 0").select(F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("name"), F.concat(F.lit("region "), (F.col("r_regionkey") - 1).cast("string")).alias("imported"))
    listed = c.dictionary_words(t("region"), words, steps, "region 2")
    return c.in_dictionary(t("customer"), "c_nationkey", listed).select("c_custkey")


@query("SELECT event_id, 'user=ann site=Über allés' AS given, 'ann' AS who, NULL::VARCHAR AS nothing, 'at Über allés: $' AS title FROM events WHERE event_type = 'purchase'")
def q_params(t):
    given = tables.read_params("user=ann site=\"Über allés\"")
    wanted = tables.substitute("${kind}", {"kind": "purchase"})
    rows = t("events").where(c.equals("event_type", wanted))
    return rows.select("event_id", s.params(given).alias("given"), s.param("user", given).alias("who"), s.param("absent", given).alias("nothing"), F.lit(tables.substitute("at ${site}: $$", given)).alias("title"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_show(t):
    shown = EventQuery(t("events")).group_by("event_type", n=function("count")()).visualise("Bubble", x="event_type", y="n")
    assert shown.show["name"] == "Bubble"
    return shown.frame()


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS k FROM c)
SELECT event_type, user_id, n FROM r WHERE k <= 5""")
def q_chart_rows(t):
    """The nested chart arrays, entry by entry."""
    counts = t("events").groupBy("event_type", "user_id").agg(function("count")().alias("n"))
    nested = groups.nest(counts, ["event_type", "user_id"], ["n"], [100, 5, 1])
    each = nested.select("event_type", F.explode("values").alias("v"))
    return each.select("event_type", F.col("v.key").alias("user_id"), F.explode("v.values").alias("x")).select("event_type", "user_id", "x.n")


@query("""
WITH u AS (SELECT event_type, user_id::VARCHAR AS key, max(value) AS v FROM events GROUP BY ALL),
s AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'signup' GROUP BY ALL),
e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT e.event_id, b.name AS nation, s.v AS latest, CASE WHEN s.v > 50 THEN 'high' ELSE 'low' END AS band, r.r_name AS region
FROM e LEFT JOIN (SELECT n_nationkey AS k, n_name AS name FROM nation) b ON b.k = e.user_id LEFT JOIN region r ON e.user_id BETWEEN r.r_regionkey * 10 AND r.r_regionkey * 10 + 6
ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def l_get_state(t):
    """getState() in expressions: an exact, a temporal and a ranged table, one value used by a later expression."""
    nation = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    signups = t("events").where("event_type = 'signup'").select(F.col("user_id").alias("key"), F.col("ts").alias("effective_time"), "value")
    bands = t("region").select((F.col("r_regionkey") * 10).cast("bigint").alias("key_start"), (F.col("r_regionkey") * 10 + 6).cast("bigint").alias("key_end"), F.col("r_name").alias("value"))
    return (
        EventQuery(t("events").where("event_type = 'purchase'"))
        .with_states(nations=nation, signups=signups, bands=bands)
        .eval(nation=FUNCTIONS["getstate"]("nations", "user_id"), latest=get_state("signups", "user_id", "ts"), band=s.if_(F.coalesce(F.col("latest") > 50, F.lit(False)), F.lit("high"), F.lit("low")), region=get_state("bands", "user_id"))
        .select("event_id", "nation", "latest", "band", "region")
        .frame()
    )


@query("""
WITH w AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS state FROM events GROUP BY user_id) SELECT c_custkey, w.state FROM customer LEFT JOIN w ON c_custkey = w.user_id""")
def l_state_overwritten(t):
    """Of several values of a key the one written last counts."""
    states = t("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "ts")
    return lookups.state_lookup(t("customer"), states, "c_custkey", "state", written="ts").select("c_custkey", "state")


@query("""
WITH st AS (SELECT DISTINCT date_trunc('day', ts) AS eff FROM events WHERE event_type = 'signup'),
a AS (SELECT date_trunc('day', ts) AS eff, user_id AS k, max(value::INT::VARCHAR) AS v FROM events WHERE event_type = 'signup' GROUP BY ALL),
e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT e.*, st.eff FROM e ASOF LEFT JOIN st ON e.ts >= st.eff),
h AS (SELECT p.*, a.v FROM p LEFT JOIN a ON a.eff = p.eff AND a.k = p.user_id),
r AS (SELECT n_nationkey * 4 AS lo, n_nationkey * 4 + 2 AS hi, n_name FROM nation)
SELECT h.event_id, coalesce(x.r_name, r.n_name) AS value FROM h LEFT JOIN r ON h.v::BIGINT BETWEEN r.lo AND r.hi LEFT JOIN region x ON h.v = (x.r_regionkey * 3 + 1)::VARCHAR""")
def l_mapped_reference(t):
    """lookup('sign-ups/bands', user, time): daily streams of the first map; the second one has ranges and exact keys."""
    e = t("events")
    own = e.where("event_type = 'signup'").withColumns({"day": d.floor_time("ts", "day"), "stream_id": F.dayofmonth("ts").cast("bigint")})
    daily = own.select("stream_id", F.col("day").alias("effective_time"), F.lit("sign-ups").alias("map")).distinct()
    once = t("region").where("r_regionkey = 0").select(F.lit(100).cast("bigint").alias("stream_id"), F.lit("2000-01-01").cast("timestamp_ntz").alias("effective_time"), F.lit("bands").alias("map"))
    none = F.lit(None)
    first = own.select("stream_id", F.lit("sign-ups").alias("map"), F.col("user_id").cast("string").alias("key"), none.cast("bigint").alias("key_start"), none.cast("bigint").alias("key_end"), F.rint("value").cast("int").cast("string").alias("value"))
    ranges = t("nation").select(F.lit(100).cast("bigint").alias("stream_id"), F.lit("bands").alias("map"), none.cast("string").alias("key"), (F.col("n_nationkey") * 4).cast("bigint").alias("key_start"), (F.col("n_nationkey") * 4 + 2).cast("bigint").alias("key_end"), F.col("n_name").alias("value"))
    exact = t("region").select(F.lit(100).cast("bigint").alias("stream_id"), F.lit("bands").alias("map"), (F.col("r_regionkey") * 3 + 1).cast("string").alias("key"), none.cast("bigint").alias("key_start"), none.cast("bigint").alias("key_end"), F.col("r_name").alias("value"))
    asked = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return lookups.mapped_lookup(asked, daily.unionByName(once), first.unionByName(ranges).unionByName(exact), "sign-ups/bands", "user_id", "ts").select("event_id", "value")


@query("SELECT epoch_ms(date_trunc('day', ts)) AS day_ms, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def q_merge_statistics(t):
    """Statistics of three sources, added up."""
    parts = [statistics.rollup(t("events").where(F.col("event_id") % 3 == k), "ts", ["event_type"], "day", value=F.col("value"), kind="none") for k in range(3)]
    merged = statistics.merge_statistics(*parts, keys=["time_bucket", "event_type"])
    return merged.select(d.millis("time_bucket").alias("day_ms"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def q_delete_before(t):
    return state_tables.delete_before(t("events"), "ts", F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query("""
WITH w AS (SELECT event_type, epoch_ms(ts) // 86400000 + p AS day, p, value FROM events, range(2) AS r(p))
SELECT event_type, day * 86400000 AS day_ms, round(sum(value) FILTER (p = 0), 2) AS this_day, max(value) FILTER (p = 1) AS day_before FROM w GROUP BY ALL""")
def q_period(t):
    """period(0, sum) and period(1, max) of a window of two days."""
    rows = EventQuery(t("events")).window("ts", "2d", "1d").eval(day_ms=d.millis("window_start"))
    of = FUNCTIONS["period"]
    return rows.group_by("event_type", "day_ms", this_day=F.round(function("sum")(of("period", 0, "value")), 2), day_before=function("max")(of("period", 1, "value"))).frame()


@query("""
SELECT event_id, value::FLOAT::DOUBLE AS shorter, true AS is_int, false AS is_text, true AS is_double, true AS is_text2, false AS is_bool, true AS yes, false AS no, NULL::VARCHAR AS nothing, NULL::VARCHAR AS failed FROM events""")
def fn_types_and_values(t):
    f = FUNCTIONS
    return t("events").select(
        "event_id", f["tofloat"]("value").cast("double").alias("shorter"), f["islong"]("user_id").alias("is_int"), f["isstring"]("user_id").alias("is_text"), f["isdouble"]("value").alias("is_double"),
        f["isstring"]("event_type").alias("is_text2"), f["isboolean"]("event_type").alias("is_bool"), f["true"]().alias("yes"), f["false"]().alias("no"), f["null"]().cast("string").alias("nothing"), f["err"]().cast("string").alias("failed"),
    )


@query("""
SELECT event_id, '[Board](' || replace(url_encode('?uuid=u' || user_id || '&params=user=' || user_id), '%20', '+') || '){dashboard}' AS board,
  '[Data](' || url_encode('?id=' || user_id || '&recordNo=' || event_id) || '){data}' AS data, 'ann' AS who, true AS drawn FROM events""")
def fn_board_links(t):
    user = F.col("user_id").cast("string")
    f = FUNCTIONS
    return t("events").select(
        "event_id", f["dashboard"](F.lit("Board"), F.concat(F.lit("u"), user), F.concat(F.lit("user="), user)).alias("board"), f["data"](F.lit("Data"), id="user_id", recordNo="event_id").alias("data"),
        f["currentuser"]("ann").alias("who"), f["random"]().between(0, 1).alias("drawn"),
    )


@query("SELECT event_id, 'u' || user_id || ':pw' AS user_info, 'top' || event_id AS fragment FROM events")
def fn_uri_parts(t):
    uri = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(":pw@example.org:8443/a/b?x=1#top"), F.col("event_id").cast("string"))
    return t("events").select("event_id", FUNCTIONS["extractuserinfofromuri"](uri).alias("user_info"), FUNCTIONS["extractfragmentfromuri"](uri).alias("fragment"))


@query("""
SELECT event_id, event_id::VARCHAR AS from_hex, printf('%o', event_id) AS octal, 'Zoë ' || event_type AS decoded, (10 * 16777216 + (user_id % 200) * 65536 + 768)::BIGINT AS lo, (10 * 16777216 + (user_id % 200) * 65536 + 1023)::BIGINT AS hi,
  '<ROW><a>' || user_id || '</a><b>' || event_type || '</b></ROW>' AS xml FROM events""")
def fn_hex_networks_xml(t):
    given = F.hex("event_id")
    spaced = F.regexp_replace(F.hex(F.encode(F.concat(F.lit("Zoë "), "event_type"), "UTF-8")), "(..)", "$1 ")
    block = F.concat(F.lit("10."), (F.col("user_id") % 200).cast("string"), F.lit(".3.77/24"))
    json = F.to_json(F.struct(F.col("user_id").alias("a"), F.col("event_type").alias("b")))
    ends = s.cidr_range(block)
    return t("events").select(
        "event_id", s.hex_to_dec(given).alias("from_hex"), s.hex_to_oct(given).alias("octal"), s.hex_to_string(spaced).alias("decoded"), ends["lo"].alias("lo"), ends["hi"].alias("hi"),
        F.regexp_replace(s.json_to_xml(json, "a bigint, b string"), r"\s*\n\s*", "").alias("xml"),
    )


@query("SELECT event_id, md5('now') AS m FROM events WHERE ts < TIMESTAMP '2024-01-02'")
def fn_relative_now(t):
    """now() and a reference day, with a given moment."""
    day = d.reference_time("day", datetime(2024, 1, 2, 13))
    return t("events").where(F.col("ts") < day.cast("timestamp_ntz")).select("event_id", s.hash_text(F.lit("now"), "md5").alias("m"))
