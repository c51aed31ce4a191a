"""Lookups in state tables, and detection rules run as batches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from eventloom.functions import aggregates as a
from eventloom.functions import dates as d
from eventloom.operators import lookups, state_tables
from eventloom.sources import cleaning
from eventloom.streaming import rules

from .register import query


@query("SELECT s_suppkey, n_name AS value FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def l_state(t):
    states = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return lookups.state_lookup(t("supplier"), states, "s_nationkey").select("s_suppkey", "value")


@query("SELECT s_suppkey, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def l_chained(t):
    first = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value"))
    second = t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return lookups.chained_lookup(t("supplier"), [first, second], "s_nationkey", "region").select("s_suppkey", "region")


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT p.event_id, s.value FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def l_temporal(t):
    """The latest sign-up value of each purchase's user at that time."""
    e = t("events")
    states = e.where("event_type = 'signup'").select(F.col("user_id").alias("key"), F.col("ts").alias("effective_time"), "value")
    return lookups.temporal_lookup(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), states, "user_id", "ts").select("event_id", "value")


@query("""
WITH r AS (SELECT (p_partkey * 40)::BIGINT AS a, (p_partkey * 40 + 30)::BIGINT AS b, p_brand FROM part)
SELECT l_orderkey, l_linenumber, CASE WHEN r.b >= l.k THEN r.p_brand END AS band FROM (SELECT *, floor(l_extendedprice)::BIGINT AS k FROM lineitem) l ASOF LEFT JOIN r ON l.k >= r.a""")
def l_ranged(t):
    ranges = t("part").select((F.col("p_partkey") * 40).alias("key_start"), (F.col("p_partkey") * 40 + 30).alias("key_end"), F.col("p_brand").alias("value"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").cast("bigint").alias("k"))
    return lookups.ranged_lookup(rows, ranges, "k", "band").select("l_orderkey", "l_linenumber", "band")


@query("""
WITH r AS (SELECT (user_id // 10 * 10) AS a, (user_id // 10 * 10 + 7) AS b, ts, max({'b': user_id // 10 * 10 + 7, 'v': value}) AS x FROM events WHERE event_type = 'signup' GROUP BY ALL),
s AS (SELECT DISTINCT a FROM r), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), n AS (SELECT e.*, s.a FROM e ASOF LEFT JOIN s ON e.user_id >= s.a)
SELECT n.event_id, CASE WHEN r.x.b >= n.user_id THEN r.x.v END AS value FROM n ASOF LEFT JOIN r ON n.a = r.a AND n.ts >= r.ts""")
def l_temporal_ranged(t):
    e = t("events")
    low = F.floor(F.col("user_id") / 10).cast("bigint") * 10
    ranges = e.where("event_type = 'signup'").select(low.alias("key_start"), (low + 7).alias("key_end"), F.col("ts").alias("effective_time"), "value")
    rows = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return lookups.temporal_ranged_lookup(rows, ranges, "user_id", "ts").select("event_id", "value")


@query("""
WITH s AS (SELECT user_id, ts AS a, ts + INTERVAL 2 HOUR AS b FROM events WHERE event_type = 'view')
SELECT e.event_id, EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND e.ts BETWEEN s.a AND s.b) AS in_session FROM events e WHERE event_type = 'click'""")
def l_session(t):
    e = t("events")
    views = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 2 hours")).alias("end"))
    sessions = state_tables.merge_sessions(views, ["key"])
    return lookups.session_lookup(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), sessions, "user_id", "ts").select("event_id", "in_session")


@query("""
WITH b AS (SELECT p_partkey, bit FROM part, range(6) AS r(bit) WHERE (p_size >> bit) & 1 = 1)
SELECT p.p_partkey, x.names FROM part p LEFT JOIN (SELECT p_partkey, array_to_string(list(n_name ORDER BY bit), ',') AS names FROM b JOIN nation ON n_nationkey = bit GROUP BY p_partkey) x USING (p_partkey)""")
def l_bitmap(t):
    states = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    found = lookups.bitmap_lookup(t("part").select("p_partkey", "p_size"), states, "p_size", ["p_partkey"])
    return found.select("p_partkey", F.array_join("values", ",").alias("names"))


@query("""
WITH st AS (SELECT DISTINCT date_trunc('day', ts) AS eff, date_diff('day', DATE '2024-01-01', ts) AS stream_id FROM events WHERE event_type = 'signup'),
en AS (SELECT date_diff('day', DATE '2024-01-01', ts) AS stream_id, user_id, max(value) AS value FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT c.event_id, en.value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c ASOF LEFT JOIN st ON c.ts >= st.eff LEFT JOIN en ON en.stream_id = st.stream_id AND en.user_id = c.user_id""")
def l_reference_data(t):
    """Reference streams by day: the value of a click's user in the stream that was effective then."""
    e = t("events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    own = e.where("event_type = 'signup'").withColumn("stream_id", day)
    streams = own.select("stream_id", d.floor_time("ts", "day").alias("effective_time")).distinct()
    entries = own.groupBy("stream_id", F.col("user_id").alias("key")).agg(F.max("value").alias("value"))
    return lookups.reference_lookup(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), streams, entries, "user_id", "ts").select("event_id", "value")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority AS note FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON l_orderkey = o_orderkey")
def l_annotations(t):
    notes = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("note"))
    return lookups.annotate(t("lineitem"), notes, ("l_orderkey",)).select("l_orderkey", "l_linenumber", "note")


@query("""
SELECT 'dear purchase' AS rule, epoch_us(ts) // 1000 AS time_ms, user_id::VARCHAR AS user_id FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase' AND value > 90) WHERE k = 1""")
def r_streaming_rule(t):
    rule = rules.StreamingRule("dear purchase", (F.col("event_type") == "purchase") & (F.col("value") > 90), "ts", ["user_id"], unique_by=["user_id", "ts"])
    return rule.detections(t("events")).select("rule", d.millis("time").alias("time_ms"), F.col("values")[0]["value"].alias("user_id"))


@query("""
SELECT 'many errors' AS rule, max(epoch_us(ts) // 1000) AS time_ms, user_id::VARCHAR AS user_id, count(*)::VARCHAR AS n FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 15""")
def r_table_builder_rule(t):
    rule = rules.TableBuilderRule("many errors", ["user_id"], {"n": a.count()}, F.col("n") > 15, "ts")
    found = rule.detections(t("events").where("event_type = 'error'"))
    return found.select("rule", d.millis("time").alias("time_ms"), F.col("values")[0]["value"].alias("user_id"), F.col("values")[1]["value"].alias("n"))


@query("""
SELECT 'busy user' AS rule, epoch_ms(TIMESTAMP '2024-01-08') AS time_ms, user_id::VARCHAR AS user_id FROM events WHERE ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-08' GROUP BY user_id HAVING count(*) >= 3""")
def r_scheduled_rule(t):
    rule = rules.ScheduledRule("busy user", lambda e: e.groupBy("user_id").agg(a.count().alias("n")).where("n >= 3"), "ts", ["user_id"])
    found = rule.run(t("events"), datetime(2024, 1, 7), datetime(2024, 1, 8))
    return found.select("rule", d.millis("time").alias("time_ms"), F.col("values")[0]["value"].alias("user_id"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def e_json_fields(t):
    return cleaning.json_fields(t("events").select("event_id", "props"), "props", "k bigint").select("event_id", "k")


@query("SELECT event_id, split_part(s, ',', 1) AS a, split_part(s, ',', 2) AS b FROM (SELECT event_id, event_type || ',' || user_id AS s FROM events)")
def e_split_fields(t):
    fields = cleaning.split_quoted(F.concat_ws(",", F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("user_id").cast("string")))
    return t("events").select("event_id", fields[0].alias("a"), fields[1].alias("b"))


@query("SELECT doc_id, unnest(range(1, len(ls) + 1)) AS record_no, md5(unnest(ls)) AS record FROM (SELECT doc_id, [x for x in string_split(text, chr(10)) if x <> ''] AS ls FROM documents)")
def e_split_records(t):
    found = cleaning.split_records(t("documents").select("doc_id", "text"), "text", "\n")
    return found.select("doc_id", F.col("record_no").cast("bigint").alias("record_no"), F.md5("record").alias("record"))


@query("SELECT event_id, regexp_extract(s, '([a-z]+)-([0-9]+)', 1) AS kind, regexp_extract(s, '([a-z]+)-([0-9]+)', 2) AS usr FROM (SELECT event_id, '[' || event_type || '-' || user_id || ']' AS s FROM events)")
def e_regex_fields(t):
    line = F.concat(F.lit("["), "event_type", F.lit("-"), F.col("user_id").cast("string"), F.lit("]"))
    return t("events").select("event_id", cleaning.regex_fields(line, "([a-z]+)-([0-9]+)", ["kind", "usr"]).alias("f")).select("event_id", "f.*")


@query("SELECT event_id, event_type AS kind, user_id::VARCHAR AS usr FROM events")
def e_xml_fields(t):
    doc = F.concat(F.lit("<e><t>"), "event_type", F.lit("</t><u id='"), F.col("user_id").cast("string"), F.lit("'/></e>"))
    return t("events").select("event_id", cleaning.xml_fields(doc, {"kind": "e/t", "usr": "e/u/@id"}).alias("f")).select("event_id", "f.*")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INTEGER AS event_id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def e_event_ids(t):
    return cleaning.with_event_ids(t("lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


@query("SELECT doc_id, replace(text, 'the', 'THE') AS text FROM documents")
def e_find_replace(t):
    return t("documents").select("doc_id", cleaning.find_replace("text", "the", "THE").alias("text"))


@query("SELECT event_id, event_type AS kind, user_id::VARCHAR AS usr, NULL::VARCHAR AS missing FROM events")
def e_key_values(t):
    line = F.concat(F.lit("kind="), "event_type", F.lit(" usr="), F.col("user_id").cast("string"))
    pairs = cleaning.key_values(line)
    return t("events").select("event_id", pairs["kind"].alias("kind"), pairs["usr"].alias("usr"), F.try_element_at(pairs, F.lit("none")).alias("missing"))


@query("""
SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS cleaned, md5(replace(replace(text, '&', '&amp;'), '&amp;amp;', '&amp;')) AS escaped
FROM documents WHERE NOT contains(text, '<')""")
def e_cleaning(t):
    plain = t("documents").where(~F.contains("text", F.lit("<")))
    return plain.select("doc_id", F.md5(cleaning.drop_invalid_characters("text")).alias("cleaned"), F.md5(cleaning.escape_bad_xml_text("text")).alias("escaped"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS merged FROM conversations GROUP BY conv_id")
def e_merge_records(t):
    from eventloom.sources.writers import merge_records

    return merge_records(t("conversations"), ["conv_id"], "turn", "text").select("conv_id", F.md5("merged").alias("merged"))


@query("SELECT event_id, '<record><event_type>' || event_type || '</event_type></record>' AS xml, '{\"event_type\":\"' || event_type || '\"}' AS json FROM events")
def e_written_records(t):
    from eventloom.sources import writers

    record = t("events").select("event_type")
    return t("events").select("event_id", F.regexp_replace(writers.xml_element(record), r"\s*\n\s*", "").alias("xml"), writers.json_line(record).alias("json"))


@query("SELECT event_id, user_id, 'HIGH' AS band FROM events WHERE event_type = 'error' AND value > 75")
def q_view(t):
    """A view: a table, a filter and an extracted field."""
    from eventloom.sources.readers import view

    seen = view(t("events"), "high_errors", (F.col("event_type") == "error") & (F.col("value") > 75), {"band": F.lit("HIGH")})
    return seen.select("event_id", "user_id", "band")


@query("""
SELECT epoch_ms(date_trunc('hour', ts)) AS hour_ms, event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' GROUP BY ALL""")
def q_statistics_search(t):
    """Stored hourly statistics, by tag values and time."""
    from eventloom.operators import conditions as c
    from eventloom.operators import statistics

    stored = statistics.rollup(t("events"), "ts", ["event_type"], "hour", kind="all")
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-06"))
    found = stored.where(c.is_in("event_type", ["error", "click"]) & c.time_range("time_bucket", start, end))
    return found.select(d.millis("time_bucket").alias("hour_ms"), "event_type", "n")


@query("""
WITH e AS (SELECT user_id, event_type, value::INT AS v, ts FROM events)
SELECT user_id, event_type, v FROM e WHERE ts >= TIMESTAMP '2024-01-15' EXCEPT SELECT user_id, event_type, v FROM e WHERE ts < TIMESTAMP '2024-01-15'""")
def r_duplicates_seen_before(t):
    e, split = t("events").select("user_id", "event_type", F.rint("value").cast("int").alias("v"), "ts"), F.lit("2024-01-15").cast("timestamp_ntz")
    fresh = e.where(F.col("ts") >= split).drop("ts")
    return state_tables.suppress_duplicates(fresh, ["user_id", "event_type", "v"], e.where(F.col("ts") < split))
