"""Ingestion: parsers, filters, writers, metadata tables, provenance, and rules with schedules and linked events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from eventloom.functions import aggregates as a
from eventloom.functions import dates as d
from eventloom.operators import conditions as c
from eventloom.operators import provenance
from eventloom.operators.query import EventQuery
from eventloom.sources import cleaning, metadata, readers, writers
from eventloom.streaming import rules

from .register import query

# ---------------------------------------------------------------- cleaning and parsing


@query("""
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '<e>1 &lt; 2 &amp; ' WHEN user_id % 3 = 1 THEN '<e>&amp;amp &lt;&lt; &amp; ' ELSE '<e>&#10;&x1;&lt;5&gt; ' END || event_type || '</e>' AS xml FROM events""")
def e_bad_xml_text(t):
    """Ampersands and angle brackets that are no markup."""
    bad = F.when(F.col("user_id") % 3 == 0, "<e>1 < 2 & ").when(F.col("user_id") % 3 == 1, "<e>&amp <<  &amp; ").otherwise("<e>&#10;&x1;<5&gt; ")
    bad = F.regexp_replace(bad, "  ", " ")
    return t("events").select("event_id", cleaning.escape_bad_xml_text(F.concat(bad, "event_type", F.lit("</e>"))).alias("xml"))


@query("SELECT event_id, 'a?b' || chr(9) || event_type || '?' AS shown, event_type AS bare FROM events")
def e_xml_characters(t):
    dirty = F.concat(F.lit("a\x01b\t"), "event_type", F.lit("\x0b"))
    return t("events").select("event_id", cleaning.replace_invalid_xml_characters(dirty, "?").alias("shown"), cleaning.strip_bom(F.concat(F.lit("﻿"), "event_type")).alias("bare"))


@query("""
SELECT event_id, regexp_replace(regexp_replace(event_type, '[aeiou]', '#'), '[aeiou]', '#') AS two, regexp_replace(event_type, '([a-z])([a-z])', '\\2\\1') AS swapped, 'x' || chr(1) || 'y.b.c' AS literal FROM events""".replace("\\\\", "\\"))
def e_find_replace_limited(t):
    literal = cleaning.find_replace(F.concat(F.lit("a.b.c"),), "a", "x\x01y", limit=5)
    return t("events").select(
        "event_id", cleaning.find_replace("event_type", "[aeiou]", "#", regex=True, limit=2).alias("two"), cleaning.find_replace("event_type", "([a-z])([a-z])", "$2$1", regex=True, limit=1).alias("swapped"), literal.alias("literal")
    )


@query("""
SELECT event_id, event_type AS a, 'x|' || user_id AS b, 'c\\' AS c, NULL::VARCHAR[] AS few, [event_type, 'x|' || user_id] AS two FROM events""")
def e_split_containers(t):
    """Containers and escapes, fewest and most fields."""
    line = F.concat("event_type", F.lit("|(x|"), F.col("user_id").cast("string"), F.lit(")|c\\\\"))
    fields = lambda **more: cleaning.split_fields(line, "|", "(", ")", "\\", **more)
    got = fields()
    return t("events").select("event_id", got[0].alias("a"), got[1].alias("b"), got[2].alias("c"), fields(least=4).alias("few"), fields(most=2).alias("two"))


@query("""
SELECT event_id, 2 AS n, event_type AS first_key, user_id::VARCHAR AS first_value, 'k2' AS second_key, true AS too_few FROM events""")
def e_regex_matches(t):
    line = F.concat("event_type", F.lit("="), F.col("user_id").cast("string"), F.lit("; K2=7; k3=8"))
    found = cleaning.regex_matches(line, r"(\w+)=(\d+)", ["key", "value"], most=2)
    none = cleaning.regex_matches(line, r"(\w+)=(\d+)", ["key", "value"], least=4)
    return t("events").select("event_id", F.size(found).alias("n"), found[0]["key"].alias("first_key"), found[0]["value"].alias("first_value"), F.lower(found[1]["key"]).alias("second_key"), none.isNull().alias("too_few"))


@query("SELECT event_id, [user_id::VARCHAR, event_type] AS left_parts, ['1', '2'] AS right_parts FROM events")
def e_group_fields(t):
    """A group node: an inner split within each match of a pattern."""
    line = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(":1] ["), "event_type", F.lit(":2]"))
    half = lambda i: cleaning.within(line, r"\[([^\]]*)\]", 1, lambda g: cleaning.split_fields(g, ":")[i])
    return t("events").select("event_id", half(0).alias("left_parts"), half(1).alias("right_parts"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signed FROM events""")
def e_variables(t):
    """A variable that one record stores and the next ones use."""
    e = t("events").withColumns({"at": F.struct("ts", "event_id"), "stored": F.when(F.col("event_type") == "signup", F.col("event_id"))})
    return cleaning.remembered(e, "user_id", "at", "stored", "signed").select("event_id", "signed")


@query("SELECT event_id, event_type AS kind, user_id::VARCHAR AS usr, '' AS missing FROM events")
def e_combined_parser(t):
    """JSON, XML and key=value lines through one parser."""
    user = F.col("user_id").cast("string")
    line = (
        F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("kind"), user.alias("usr"))))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("<e><kind>"), "event_type", F.lit("</kind><usr>"), user, F.lit("</usr></e>")))
        .otherwise(F.concat(F.lit("kind="), "event_type", F.lit(" usr="), user))
    )
    return t("events").select("event_id", cleaning.combined_fields(line, ["kind", "usr", "missing"]).alias("f")).select("event_id", "f.*")


@query("SELECT event_id, event_type AS first_kind, user_id::VARCHAR AS second_user FROM events")
def e_xml_fragment(t):
    """Elements without a root."""
    fragment = F.concat(F.lit("<e><k>"), "event_type", F.lit("</k></e><e><u>"), F.col("user_id").cast("string"), F.lit("</u></e>"))
    return t("events").select("event_id", cleaning.xml_fields(cleaning.xml_fragment(fragment), {"first_kind": "/root/e[1]/k", "second_user": "/root/e[2]/u"}).alias("f")).select("event_id", "f.*")


@query("SELECT 'valid' AS side, count(*) AS n FROM events WHERE value < 90 UNION ALL SELECT 'invalid', count(*) FROM events WHERE NOT value < 90")
def e_valid_records(t):
    good, bad = cleaning.valid_records(t("events"), F.col("value") < 90)
    return good.groupBy(F.lit("valid").alias("side")).agg(a.count().alias("n")).unionByName(bad.groupBy(F.lit("invalid").alias("side")).agg(a.count().alias("n")))


@query("SELECT event_id FROM events WHERE event_type = 'error' OR value > 50")
def e_record_output(t):
    """Records whose output fields are all empty go."""
    shown = t("events").withColumns({"one": F.when(F.col("event_type") == "error", "e"), "two": F.when(F.col("value") > 50, "v").otherwise("")})
    return cleaning.counted(cleaning.with_output(shown, ["one", "two"]), "records").select("event_id")


@query("SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 + 1)::INTEGER AS chunk FROM events")
def e_split_filter(t):
    return cleaning.chunked(t("events"), "user_id", "event_id", 10).select("user_id", "event_id", "chunk")


@query("""
SELECT DISTINCT event_id, f.name AS field, f.term AS term FROM events, LATERAL (SELECT unnest([{'name': 'kind', 'term': event_type}, {'name': 'note', 'term': 'user'}, {'name': 'note', 'term': user_id::VARCHAR}]) AS f)
WHERE f.name <> 'note' OR user_id % 2 = 0""")
def e_dynamic_index(t):
    """Fields without a schema, and the terms of each."""
    e = t("events").select("event_id", F.col("event_type").alias("kind"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("User "), F.col("user_id").cast("string"))).alias("note"))
    return cleaning.dynamic_terms(cleaning.dynamic_fields(e, ["kind", "note"]), "event_id")


@query("SELECT event_id, event_type AS kind, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE event_type = 'error'")
def e_dynamic_output(t):
    """Query results by fields that are only known from the data."""
    found = EventQuery(cleaning.dynamic_fields(t("events").select("event_id", F.col("event_type").alias("kind")), ["kind"])).eval(kind=F.col("fields")["kind"]).where(c.equals("kind", "error"))
    rows = found.frame().select("event_id", "kind")
    return rows.join(rows.groupBy("kind").agg(a.count().alias("n")), "kind")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed')")
def e_index_terms(t):
    """The terms that an index keeps beside a text, as index_table() writes them."""
    indexed = readers.with_terms(t("documents").select("doc_id", "text"), ["text"], "alpha")
    return indexed.where(F.exists("text_terms", lambda x: F.contains(x, F.lit("licensed")))).select("doc_id")


# ---------------------------------------------------------------- writers


@query("SELECT event_id, '<event><event_type>' || event_type || '</event_type></event>' AS xml, '{\"event_type\":\"' || event_type || '\"}' AS json FROM events")
def e_writer_records(t):
    """Records as the JSON and XML writers write them."""
    e = t("events")
    xml = F.regexp_replace(writers.xml_element(e.select("event_type"), "event"), r"\s*\n\s*", "")
    return e.select("event_id", xml.alias("xml"), writers.json_line(e.select("event_type")).alias("json"))


@query("""
SELECT 'visits' AS key, '{"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || printf('%03d', epoch_us(ts) // 1000 % 1000) || 'Z","name":"visits","tags":[{"tag":"event_type","value":"' || event_type || '"},{"tag":"user_id","value":"' || user_id || '"}],"count":1}' AS value FROM events""")
def e_statistic_messages(t):
    return metadata.statistic_messages(t("events"), "ts", "visits", ["event_type", "user_id"])


# ---------------------------------------------------------------- metadata tables

_DAY = "date_diff('day', DATE '2024-01-01', ts)::BIGINT"


def _streams(t):
    """Events as streams of a day."""
    return t("events").withColumns({"stream_id": F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint"), "feed": F.lit("WEB-EVENTS"), "type": F.lit("Events"), "severity": F.when(F.col("event_type") == "error", "Error").otherwise("Info")})


@query(f"""
SELECT {_DAY} AS "Id", 'WEB-EVENTS' AS "Feed", 'Unlocked' AS "Status", count(*) AS "ReadCount", count(*) FILTER (event_type = 'error') AS "ErrorCount", count(*) FILTER (event_type <> 'error') AS "InfoCount", sum(strlen(props))::BIGINT AS "RawSize",
  epoch_us(min(ts)) // 1000 AS created, epoch_us(max(ts)) // 1000 AS changed FROM events GROUP BY ALL HAVING count(*) FILTER (event_type = 'error') > 2""")
def m_stream_meta(t):
    """Stream metadata, searched like a table."""
    meta = metadata.stream_meta(_streams(t), "stream_id", "feed", "type", "ts", "severity", "props")
    found = EventQuery(meta).where(c.all_of(c.equals("Feed", "web-*"), c.greater_than("ErrorCount", 2))).frame()
    return found.select("Id", "Feed", "Status", "ReadCount", "ErrorCount", "InfoCount", "RawSize", d.millis("CreateTime").alias("created"), d.millis("StatusTime").alias("changed"))


@query(f"""
WITH s AS (SELECT {_DAY} AS id, bool_or(event_type = 'purchase' AND value > 95) AS done FROM events GROUP BY ALL)
SELECT "Status", count(*) AS n, min(id) AS low FROM (SELECT id, CASE WHEN done THEN 'Complete' ELSE 'Created' END AS "Status" FROM s) GROUP BY ALL""")
def m_processor_tasks(t):
    """Tasks of a pipeline: complete where a stream has output."""
    streams = metadata.stream_meta(_streams(t), "stream_id", "feed", "type", "ts")
    dear = _streams(t).where("event_type = 'purchase' and value > 95")
    outputs = metadata.stream_meta(dear, "stream_id", "feed", "type", "ts").withColumn("ParentId", F.col("Id"))
    tasks = metadata.processor_tasks(streams, outputs, "dear purchases", "node1")
    return EventQuery(tasks).group_by("Status", n=a.count(), low=F.min("MetaId")).frame()


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS "Partition", count(*) AS "DocCount", epoch_us(max(ts)) // 1000 AS last FROM events GROUP BY ALL HAVING count(*) > 10""")
def m_index_shards(t):
    """The shards of an index by week."""
    shards = metadata.index_shards(readers.with_partition(t("events"), "ts", unit="week"), "events", "ts")
    return shards.where(c.greater_than("DocCount", 10)).select("Partition", "DocCount", d.millis("LastCommit").alias("last"))


@query(f"""SELECT {_DAY} AS stream_id, event_id, 'error of ' || user_id AS "Title", 'New' AS "Status", epoch_us(ts) // 1000 AS created FROM events WHERE event_type = 'error' AND user_id < 5""")
def m_annotations(t):
    """What the annotation writer makes of errors, searched by title."""
    made = metadata.annotations(_streams(t).where("event_type = 'error'"), "stream_id", "event_id", F.concat(F.lit("error of "), F.col("user_id").cast("string")), "ts")
    found = made.where(c.matches("Title", "^error of [0-4]$"))
    return found.select("stream_id", "event_id", "Title", "Status", d.millis("CreatedOn").alias("created"))


@query(f"""
SELECT {_DAY} AS stream_id, 'kinds' AS map, event_type AS key, NULL::BIGINT AS key_start, round(value, 1)::VARCHAR AS value FROM events WHERE event_type <> 'view'
UNION ALL SELECT {_DAY}, 'users', NULL, user_id, event_type FROM events WHERE user_id % 7 <> 0""")
def m_reference_entries(t):
    """Reference data as it is loaded: a map of keys and one of ranges, of which reversed ones and empty keys are left out."""
    e = _streams(t)
    keys = metadata.reference_entries(e, "stream_id", "kinds", F.round("value", 1), "ts", key=F.when(F.col("event_type") != "view", F.col("event_type")))
    ends = F.when(F.col("user_id") % 7 == 0, F.col("user_id") - 1).otherwise(F.col("user_id") + 1)
    ranges = metadata.reference_entries(e, "stream_id", "users", F.col("event_type"), "ts", key_start=F.col("user_id"), key_end=ends)
    return keys.unionByName(ranges).select("stream_id", "map", "key", "key_start", "value")


@query("""
SELECT 'state' AS kind, user_id::VARCHAR AS key, 'Double' AS "ValueType", max(value)::VARCHAR AS value FROM events WHERE event_type = 'signup' GROUP BY user_id
UNION ALL SELECT 'ranged', user_id || '-' || (user_id + 9), 'String', event_type FROM events WHERE event_type = 'error' AND value > 90
UNION ALL SELECT 'session', user_id::VARCHAR, NULL, (epoch_us(ts) // 1000)::VARCHAR FROM events WHERE event_type = 'click' AND value > 90""")
def m_state_tables(t):
    """State tables as they are loaded, and scanned like any table."""
    e = t("events")
    top = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("value").alias("value"))
    state = metadata.state_rows(top, "state", F.col("value"), key=F.col("user_id").cast("string"))
    ranged = metadata.state_rows(e.where("event_type = 'error' and value > 90"), "ranged_state", F.col("event_type"), key_start=F.col("user_id"), key_end=F.col("user_id") + 9)
    session = metadata.state_rows(e.where("event_type = 'click' and value > 90"), "session", key=F.col("user_id").cast("string"), start=F.col("ts"), end=F.col("ts") + F.expr("interval 1 hour"))
    none = F.lit(None).cast("string")
    return (
        state.select(F.lit("state").alias("kind"), "key", "ValueType", "value")
        .unionByName(ranged.select(F.lit("ranged").alias("kind"), F.concat_ws("-", F.col("key_start").cast("string"), F.col("key_end").cast("string")).alias("key"), "ValueType", "value"))
        .unionByName(session.select(F.lit("session").alias("kind"), "key", none.alias("ValueType"), d.millis("start").cast("string").alias("value")))
    )


# ---------------------------------------------------------------- provenance


@query(f"""
SELECT event_id, 'feed ' || {_DAY} % 3 AS feed, CASE WHEN {_DAY} % 2 = 0 THEN 'node1' END AS node, CASE WHEN {_DAY} % 3 = 0 THEN 'SECRET' ELSE 'OFFICIAL' END AS classification FROM events""")
def p_stream_attributes(t):
    """meta(), feed-name() and classification() of each event's stream."""
    e = _streams(t).drop("feed")
    ids = e.select("stream_id").distinct()
    feed = F.concat(F.lit("feed "), (F.col("stream_id") % 3).cast("string"))
    attributes = ids.select("stream_id", F.lit("Feed").alias("name"), feed.alias("value")).unionByName(ids.where("stream_id % 2 = 0").select("stream_id", F.lit("Node").alias("name"), F.lit("node1").alias("value")))
    feeds = t("region").where("r_regionkey = 0").select(F.lit("feed 0").alias("feed"), F.lit("SECRET").alias("classification"))
    known = provenance.with_meta(e, attributes, "stream_id", {"feed": "Feed", "node": "Node"})
    return provenance.with_classification(known, feeds, "feed", "OFFICIAL").select("event_id", "feed", "node", "classification")


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS record, unnest(range(1, len(string_split(text, '. ')) + 1)) AS k FROM documents),
q AS (SELECT doc_id, k, record, coalesce(string_agg(record, '. ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || '. ', '') AS before FROM p)
SELECT doc_id, k, 1 + length(before) - length(replace(before, chr(10), '')) AS line_from, 1 + length(string_split(before, chr(10))[-1]) AS col_from,
  1 + length(before || record) - length(replace(before || record, chr(10), '')) AS line_to,
  CASE WHEN contains(record, chr(10)) THEN length(string_split(record, chr(10))[-1]) ELSE length(string_split(before, chr(10))[-1]) + greatest(1, length(record)) END AS col_to FROM q""")
def p_positions(t):
    """line-from(), col-from(), line-to() and col-to() of sentences that may run over lines."""
    parts = t("documents").select("doc_id", F.posexplode(F.split("text", r"\. ", -1)).alias("at", "record"))
    placed = provenance.with_positions(parts, "doc_id", "at", "record", ". ")
    return placed.select("doc_id", (F.col("at") + 1).cast("bigint").alias("k"), "line_from", "col_from", "line_to", "col_to")


# ---------------------------------------------------------------- rules


@query("""
SELECT md5('x') IS NOT NULL AS has_id, 'user_id' AS "Name", epoch_us(ts) // 1000 AS time_ms, user_id::VARCHAR AS "Value", date_diff('day', DATE '2024-01-01', ts)::BIGINT AS stream_id, event_id FROM events WHERE event_type = 'error' AND value > 95""")
def r_linked_events(t):
    """Detections with their events, as rows of the analytic store."""
    rule = rules.StreamingRule("dear error", (F.col("event_type") == "error") & (F.col("value") > 95), "ts", ["user_id"], links=["stream_id", "event_id"])
    found = rule.detections(_streams(t))
    stored = metadata.analytic_store(found)
    key = F.md5(F.to_json(F.struct("rule", "time", "values")))
    linked = found.select(key.alias("UUID"), F.explode("linked_events").alias("x")).select("UUID", "x.*")
    return stored.join(linked, "UUID").select((F.length("UUID") == 32).alias("has_id"), "Name", d.millis("Time").alias("time_ms"), "Value", "stream_id", "event_id")


@query("""
SELECT 'errors' AS rule, epoch_ms(DATE '2024-01-01' + INTERVAL (k * 2) DAY + INTERVAL 6 HOUR) AS time_ms, user_id::VARCHAR AS user_id FROM (
  SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 06:00:00')) // 172800000000 + 1 AS k FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts < TIMESTAMP '2024-01-09 06:00:00') GROUP BY user_id, k HAVING count(*) >= 2""")
def r_cron_rule(t):
    """A scheduled rule at 06:00 of odd days, over the contiguous windows between."""
    rule = rules.ScheduledRule("errors", lambda e: e.where("event_type = 'error'").groupBy("user_id").agg(a.count().alias("n")).where("n >= 2"), "ts", ["user_id"])
    runs = [rule.run(t("events"), start, end) for start, end in rules.cron_windows("0 6 1-31/2 * *", datetime(2024, 1, 1, 6), datetime(2024, 1, 10))]
    found = runs[0]
    for run in runs[1:]:
        found = found.unionByName(run)
    return found.select("rule", d.millis("time").alias("time_ms"), F.col("values")[0]["value"].alias("user_id"))


@query("""
SELECT user_id::VARCHAR AS user_id, count(*)::VARCHAR AS n FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-19 22:00:00' GROUP BY user_id HAVING count(*) > 5""")
def r_table_builder_waits(t):
    """A table-building rule that waits two hours for late data."""
    rule = rules.TableBuilderRule("many errors", ["user_id"], {"n": a.count()}, F.col("n") > 5, "ts", wait="2 hours")
    settled = rule.settled(t("events").where("event_type = 'error'"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return rule.detections(settled).select(F.col("values")[0]["value"].alias("user_id"), F.col("values")[1]["value"].alias("n"))
