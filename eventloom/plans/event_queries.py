"""Queries of the event language: clauses, groups, windows, statistics, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import aggregates as a
from eventloom.functions import function
from eventloom.functions import dates as d
from eventloom.operators import conditions as c
from eventloom.operators import groups, state_tables, statistics, tables, windows
from eventloom.operators.query import EventQuery

from .register import query


def hourly_counts(events: DataFrame, more_than: int) -> DataFrame:
    """from events where event_type = purchase eval hour, count() group by hour having count > … sort by hour limit 100"""
    return (
        EventQuery(events)
        .where(c.equals("event_type", "purchase", case_sensitive=True))
        .eval(hour=d.millis(d.floor_time("ts", "hour")))
        .group_by("hour", n=a.count())
        .having(F.col("n") > more_than)
        .sort_by("hour")
        .select("hour", "n")
        .limit(100)
        .frame()
    )


@query("""
SELECT epoch_ms(date_trunc('hour', ts)) AS hour, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 3 ORDER BY 1 LIMIT 100""")
def q_hourly_counts(t):
    return hourly_counts(t("events"), more_than=3)


@query("""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean, round(sum(value), 2) AS total, max(value) AS high, min(value) AS low,
  round(stddev_pop(value), 4) AS sd, round(var_pop(value), 2) AS var FROM events GROUP BY event_type""")
def q_type_aggregates(t):
    aggregated = EventQuery(t("events")).group_by(
        "event_type", n=a.count(), users=a.count_unique("user_id"), mean=F.round(a.average("value"), 4), total=F.round(a.total("value"), 2), high=a.highest("value"), low=a.lowest("value"),
        sd=F.round(a.st_dev("value"), 4), var=F.round(a.variance("value"), 2),
    )
    return aggregated.frame()


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(CASE WHEN l_quantity > 10 THEN l_quantity END) / count(*), 6) AS mean_with_nulls, count(*) AS n
FROM lineitem GROUP BY ALL""")
def q_lineitem_aggregates(t):
    big = F.when(F.col("l_quantity") > 10, F.col("l_quantity"))
    return EventQuery(t("lineitem")).group_by(
        "l_returnflag", "l_linestatus", qty=F.round(a.total("l_quantity"), 2), revenue=F.round(a.total(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2), mean_with_nulls=F.round(a.average(big), 6), n=a.count()
    ).frame()


@query("""
WITH g AS (SELECT 0 AS depth, event_type, NULL::BIGINT AS user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type
  UNION ALL SELECT 1, event_type, user_id, count(*), round(sum(value), 2) FROM events GROUP BY event_type, user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY depth, CASE WHEN depth = 1 THEN event_type END ORDER BY total DESC, event_type, user_id) AS k FROM g)
SELECT depth, event_type, user_id, n, total FROM r WHERE k <= CASE depth WHEN 0 THEN 3 ELSE 10 END AND (depth = 0 OR event_type IN (SELECT event_type FROM r WHERE depth = 0 AND k <= 3))""")
def q_nested_groups(t):
    """Types, then users: 3 types by total, 10 users under each."""
    levels = ["event_type", "user_id"]
    nested = groups.nested_groups(t("events"), levels, {"n": a.count(), "total": F.round(a.total("value"), 2)})
    return groups.limit_by_depth(nested, levels, ["total desc"], sizes=[3, 10])


@query("""
WITH g AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT 0 AS depth, event_type, NULL::BIGINT AS user_id, count(*) AS n FROM events GROUP BY event_type
UNION ALL SELECT 1, event_type, user_id, n FROM g WHERE event_type = 'error'""")
def q_open_groups(t):
    levels = ["event_type", "user_id"]
    return groups.open_groups(groups.nested_groups(t("events"), levels, {"n": a.count()}), levels, [("error",)])


@query("SELECT event_type, count(DISTINCT user_id) AS groups FROM events GROUP BY event_type")
def q_count_groups(t):
    return t("events").groupBy("event_type").agg(a.count_groups("user_id").alias("groups"))


@query("""
SELECT user_id, first(event_id ORDER BY ts, event_id) AS first_id, last(event_id ORDER BY ts, event_id) AS last_id, (list(event_id ORDER BY ts, event_id))[3] AS third_id,
  array_to_string((list(event_type ORDER BY ts, event_id))[1:3], ',') AS top3, array_to_string((list(event_type ORDER BY ts, event_id))[-3:], ',') AS bottom3,
  last(value ORDER BY ts, event_id) AS any_value FROM events GROUP BY user_id""")
def q_selection(t):
    """first(), last(), any(), nth(), top() and bottom() in one pass over the rows at both ends of each group."""
    order = F.struct("ts", "event_id")
    grouped = EventQuery(t("events")).order("ts", "event_id").group_by(
        "user_id", first_id=a.first("event_id", order), last_id=a.last("event_id", order), third_id=function("nth")("event_id", 3), top3=function("top")("event_type", ",", 3),
        bottom3=function("bottom")("event_type", ",", 3), any_value=a.any_value("value", order),
    )
    return grouped.frame()


@query("""
SELECT user_id, array_to_string((list(event_type ORDER BY ts, event_id))[1:4], '|') AS joined, array_to_string(list_sort(list_slice(first_seen, 1, 3)), '|') AS kinds
FROM (SELECT e.*, f.first_seen FROM events e JOIN (SELECT user_id, list(event_type ORDER BY ts0, id0) AS first_seen FROM (SELECT user_id, event_type, min(ts) AS ts0, arg_min(event_id, (ts, event_id)) AS id0 FROM events GROUP BY ALL) GROUP BY user_id) f USING (user_id))
GROUP BY user_id, first_seen""")
def q_joining_distinct(t):
    grouped = EventQuery(t("events")).order("ts", "event_id")
    return grouped.group_by("user_id", joined=function("joining")("event_type", "|", 4), kinds=function("distinct")("event_type", "|", 3)).frame()


@query("""
SELECT user_id, event_id, k::INTEGER AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 2""")
def q_edge_rows(t):
    return groups.edge_rows(t("events"), ["user_id"], ["ts", "event_id"], 2, last=True).select("user_id", "event_id", "rank")


_STEP = "(epoch_ms(ts) // 21600000 * 21600000)"


@query(f"""
WITH s AS (SELECT event_type, {_STEP} AS step, count(*) AS v FROM events GROUP BY ALL), m AS (SELECT event_type, step + p * 21600000 AS w, p, v FROM s, range(4) AS r(p))
SELECT event_type, w AS window_ms, coalesce(sum(v) FILTER (p = 0), 0)::BIGINT AS period0, coalesce(sum(v) FILTER (p = 1), 0)::BIGINT AS period1, coalesce(sum(v) FILTER (p = 2), 0)::BIGINT AS period2,
  coalesce(sum(v) FILTER (p = 3), 0)::BIGINT AS period3 FROM m GROUP BY ALL HAVING coalesce(sum(v) FILTER (p = 0), 0) > 5""")
def q_hopping_window(t):
    """window ts by 1d advance 6h: counts of four periods, having period0 > 5"""
    counted = windows.window_counts(t("events"), ["event_type"], "ts", "1d", "6h").where("period0 > 5")
    return counted.withColumn("window_ms", d.millis("window_start")).drop("window_start")


@query(f"""
SELECT event_type, {_STEP} + p * 21600000 AS window_ms, p::INTEGER AS period, round(sum(value), 2) AS total FROM events, range(2) AS r(p) GROUP BY ALL""")
def q_hopping_rows(t):
    rows = EventQuery(t("events")).window("ts", "12h", "6h").eval(window_ms=d.millis("window_start"))
    return rows.group_by("event_type", "window_ms", "period", total=F.round(a.total("value"), 2)).frame()


@query("""
WITH l AS (SELECT date_trunc('day', l_shipdate) AS d, * FROM lineitem)
SELECT epoch_ms(d) AS day_ms, coalesce(l_returnflag, '*') AS l_returnflag, coalesce(l_linestatus, '*') AS l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total
FROM l GROUP BY GROUPING SETS ((d, l_returnflag, l_linestatus), (d, l_returnflag), (d, l_linestatus), (d))""")
def q_tag_rollup(t):
    rolled = statistics.rollup(t("lineitem"), "l_shipdate", ["l_returnflag", "l_linestatus"], "day", value=F.col("l_quantity"))
    return rolled.select(d.millis("time_bucket").alias("day_ms"), "l_returnflag", "l_linestatus", "n", F.round("total", 2).alias("total"))


@query("""
SELECT epoch_ms(date_trunc('hour', ts)) AS hour_ms, '*' AS event_type, user_id::VARCHAR AS user_id, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT epoch_ms(date_trunc('hour', ts)), event_type, '*', count(*) FROM events GROUP BY ALL""")
def q_custom_rollup(t):
    rolled = statistics.rollup(t("events"), "ts", ["event_type", "user_id"], "hour", kind="custom", custom=[["event_type"], ["user_id"]])
    return rolled.withColumn("hour_ms", d.millis("time_bucket")).drop("time_bucket")


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS b, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)
SELECT epoch_ms(CASE WHEN b < TIMESTAMP '2024-01-15' THEN date_trunc('day', b) ELSE b END) AS bucket_ms, event_type, sum(n)::BIGINT AS n, floor(sum(total) / sum(n) * 1000000 + 0.25) / 1000000 AS mean FROM h GROUP BY 1, 2""")
def q_precision_rollup(t):
    hourly = statistics.rollup(t("events"), "ts", ["event_type"], "hour", value=F.col("value"), kind="none")
    merged = statistics.coarsen(hourly, ["event_type"], F.lit("2024-01-15").cast("timestamp_ntz"), "day")
    return merged.select(d.millis("time_bucket").alias("bucket_ms"), "event_type", "n", (F.floor(statistics.mean_value() * 1000000 + 0.25) / 1000000).alias("mean"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 AS end_ms, count(*) AS n FROM i GROUP BY user_id, k""")
def q_sessions(t):
    found = state_tables.sessions_of(t("events"), ["user_id"], "ts", "6 hours")
    return found.select("user_id", d.millis("start").alias("start_ms"), d.millis("end").alias("end_ms"), "n")


@query("""
WITH s AS (SELECT user_id, ts AS a, ts + INTERVAL (value::BIGINT) MINUTE AS b FROM events), q AS (SELECT user_id, a, max(b) AS b FROM s GROUP BY ALL),
o AS (SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
i AS (SELECT user_id, a, b, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, epoch_us(min(a)) // 1000 AS start_ms, epoch_us(max(b)) // 1000 AS end_ms FROM i GROUP BY user_id, k""")
def q_merge_sessions(t):
    s = t("events").select("user_id", F.col("ts").alias("start"), F.timestamp_add("MINUTE", F.rint("value").cast("int"), F.col("ts")).alias("end"))
    return state_tables.merge_sessions(s, ["user_id"]).select("user_id", d.millis("start").alias("start_ms"), d.millis("end").alias("end_ms"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""")
def q_condense(t):
    e = t("events").withColumn("at", F.struct("ts", "event_id"))
    return state_tables.condense(e, ["user_id"], "at", "event_type").select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_suppress_duplicates(t):
    return state_tables.suppress_duplicates(t("events").select("user_id", "event_type"))


@query("""
SELECT event_id FROM events WHERE CASE WHEN event_type = 'error' THEN true WHEN event_type = 'view' THEN ts >= TIMESTAMP '2024-01-25' WHEN value > 50 THEN ts >= TIMESTAMP '2024-01-20' ELSE true END""")
def q_data_retention(t):
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    rules = [(F.col("event_type") == "error", None), (F.col("event_type") == "view", "5 days"), (F.col("value") > 50, "10 days")]
    return state_tables.retain(t("events"), rules, "ts", now).select("event_id")


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def q_merge_parts(t):
    e = t("events").withColumn("at", F.struct("ts", "event_id"))
    parts = [e.where(F.col("event_id") % 3 == k) for k in range(3)]
    return state_tables.latest(parts, ["user_id"], "at").select("user_id", "event_type", "event_id")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'red' WHEN value > 90 THEN 'amber' END AS style FROM events WHERE event_type = 'error' OR event_type <> 'view'""")
def q_conditional_formatting(t):
    rules = [(F.col("event_type") == "error", "red", False), (F.col("event_type") == "view", "hidden", True), (F.col("value") > 90, "amber", False)]
    return tables.style_rows(t("events"), rules).select("event_id", "style")


@query("""SELECT event_id FROM events WHERE (regexp_matches(props, '1') OR regexp_matches(props, '"k": 2')) AND NOT regexp_matches(props, '9') AND event_type IN ('click', 'view')""")
def q_column_filters(t):
    keep = tables.include_exclude("props", '1\n"k": 2', "9") & tables.chosen_values("event_type", ["click", "view"])
    return t("events").where(keep).select("event_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50 OFFSET 100")
def q_paging(t):
    return tables.page(t("events").select("event_id", "value"), [F.col("value").desc(), F.col("event_id")], 100, 50)


@query("""
SELECT event_id, printf('%.2f', value) AS shown, strftime(ts, '%Y-%m-%d') AS day, format('{:,}', event_id * 1000) AS thousands FROM events""")
def q_formats(t):
    return t("events").select(
        "event_id", tables.format_column("value", "number", places=2).alias("shown"), tables.format_column("ts", "date_time", pattern="yyyy-MM-dd").alias("day"),
        tables.format_column(F.col("event_id") * 1000, "number", separator=True).alias("thousands"),
    )


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS k FROM c)
SELECT event_type, sum(n)::BIGINT AS n, count(*) AS entries, min(user_id) AS low FROM r WHERE k <= 5 GROUP BY event_type""")
def q_chart(t):
    """Nested chart arrays (type -> user -> counts), five users a type, folded to totals for comparison."""
    counts = t("events").groupBy("event_type", "user_id").agg(a.count().alias("n"))
    nested = groups.nest(counts, ["event_type", "user_id"], ["n"], [100, 5, 1])
    each = nested.select("event_type", F.explode("values").alias("v"))
    return each.groupBy("event_type").agg(F.sum(F.col("v.values")[0]["n"]).alias("n"), F.count("*").alias("entries"), F.min("v.key").alias("low"))


@query(r"""
SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_'']+'), 'licensed') AND lang IN ('en', 'fr')""")
def q_term_search(t):
    return t("documents").where(c.has_term("text", "Licensed") & c.is_in("lang", "en, fr")).select("doc_id")


@query("""
SELECT o_orderkey FROM orders WHERE regexp_full_match(lower(o_orderpriority), '[0-9]-.*') AND lower(o_orderpriority) LIKE '_-%' AND NOT contains(lower(o_orderpriority), 'low') AND o_totalprice BETWEEN 50000 AND 150000
  AND o_orderstatus IN ('O', 'F')""")
def q_conditions(t):
    wanted = c.all_of(c.equals("o_orderpriority", "?-*"), c.none_of(c.contains("o_orderpriority", "LOW")), c.between("o_totalprice", 50000, 150000), c.is_in("o_orderstatus", ["O", "F"]), None)
    return t("orders").where(wanted).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def q_in_dictionary(t):
    words = t("nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("word"))
    return c.in_dictionary(t("customer"), "c_nationkey", words).select("c_custkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def q_time_range(t):
    from datetime import datetime

    moment = datetime(2024, 1, 12, 9)
    start, end = (F.lit(d.resolve_date(x, moment)).cast("timestamp_ntz") for x in ("day()-2d", "day()"))
    return t("events").where(c.time_range("ts", start, end)).select("event_id")


@query("SELECT DISTINCT l_orderkey AS stream_id, l_linenumber AS event_id FROM lineitem WHERE l_quantity > 45")
def q_event_refs(t):
    from eventloom.sources.readers import event_refs

    return event_refs(t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("stream_id"), F.col("l_linenumber").alias("event_id")))


@query("SELECT 'X' AS \"Dummy\" FROM region WHERE r_regionkey = 0")
def q_dual(t):
    from eventloom.sources.readers import dual

    return dual(t("region").sparkSession)
