"""Operators on small tables: nulls, ties, empty tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.functions import aggregates as a
from eventloom.operators import conditions as c
from eventloom.operators import groups, lookups, state_tables, statistics, tables, windows
from eventloom.operators.query import EventQuery, general_sort_keys
from eventloom.sources import cleaning, readers, writers

BASE = datetime(2000, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_chain(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, None), (4, "b")], "n int, k string")
    q = EventQuery(df).where(c.equals("k", "a")).eval(m=F.col("n") * 2).eval(m=F.col("m") + 1).sort_by("m desc").select("m", kind="k").limit(1)
    assert rows(q.frame()) == [(5, "a")]
    assert EventQuery(df).visualise("Bubble", x="n").show == {"name": "Bubble", "x": "n"}
    assert rows(EventQuery(df).sort_by("k").select("k").page(0, 1).frame()) == [(None,)]


def test_conditions(spark):
    df = spark.createDataFrame([("userOne",), ("user5",), (None,), ("",)], "u string")
    pick = lambda cond: df.where(cond).count()
    assert pick(c.equals("u", "USER*")) == 2
    assert pick(c.equals("u", "user?")) == 1
    assert pick(c.equals("u", "USER5", case_sensitive=True)) == 0
    assert pick(c.not_equals("u", "user5")) == 3
    assert pick(c.contains("u", "ERO")) == 1
    assert pick(c.none_of(c.contains("u", "user"), None)) == 2
    assert pick(c.all_of()) == 4
    assert pick(c.any_of(None)) == 4
    assert pick(c.quick_filter("u", "user !5")) == 1
    assert pick(c.has_term("u", "user*")) == 2
    tree = spark.createDataFrame([("a", "root"), ("userOne", "a"), ("user5", "other")], "node string, parent string")
    assert rows(c.in_folder(df, "u", tree, "root")) == [("userOne",)]


def test_general_sort(spark):
    df = spark.createDataFrame([("foo",), ("100",), ("3",), (None,), ("20",)], "x string")
    assert [r[0] for r in df.orderBy(*general_sort_keys("x")).collect()] == [None, "3", "20", "100", "foo"]


def test_sizes_and_nested_limits(spark):
    assert [groups.size_at([100, 10, 1], d) for d in (0, 2, 3)] == [100, 1, 1]
    assert groups.size_at([], 0) is None
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), (None, 1)], "k string, v int")
    nested = groups.nested_groups(df, ["k", "v"], {"n": a.count()})
    top = groups.limit_by_depth(nested, ["k", "v"], ["n desc"], [2, 1])
    assert rows(top) == sorted([(0, "a", None, 3), (0, None, None, 1), (1, "a", 2, 2), (1, None, 1, 1)], key=repr)
    assert rows(groups.limit_by_depth(nested.where("false"), ["k", "v"], ["n"])) == []


def test_hopping_window(spark):
    df = spark.createDataFrame([(BASE,), (BASE + timedelta(hours=1),)], "ts timestamp_ntz")
    counted = windows.window_counts(df, [], "ts", "2h", "1h")
    assert [tuple(r)[1:] for r in counted.orderBy("window_start").collect()] == [(1, 0), (1, 1), (0, 1)]
    with pytest.raises(ValueError):
        windows.duration_ms("soon")


def test_temporal_lookup(spark):
    states = [("k", BASE + timedelta(seconds=10 * i), f"v{i}") for i in range(100)] + [("k", BASE - timedelta(seconds=10 * i), f"w{i}") for i in range(1, 10)] + [(None, BASE, "null")]
    s = spark.createDataFrame(states, "key string, effective_time timestamp_ntz, value string")
    asked = spark.createDataFrame([("k", BASE), ("k", BASE + timedelta(seconds=15)), ("k", BASE - timedelta(days=1)), ("x", BASE), (None, BASE), ("k", None), ("k", BASE + timedelta(days=9))], "key string, at timestamp_ntz")
    got = {(r["key"], r["at"]): r["value"] for r in lookups.temporal_lookup(asked, s, "key", "at").collect()}
    assert got[("k", BASE)] == "v0"
    assert got[("k", BASE + timedelta(seconds=15))] == "v1"
    assert got[("k", BASE + timedelta(days=9))] == "v99"
    assert [got[k] for k in (("k", BASE - timedelta(days=1)), ("x", BASE), (None, BASE), ("k", None))] == [None] * 4
    assert lookups.temporal_lookup(asked, s.where("false"), "key", "at").where("value is not null").count() == 0
    assert lookups.temporal_lookup(asked.where("false"), s, "key", "at").count() == 0


def test_ranged_lookup(spark):
    r = spark.createDataFrame([(0, 100, "wide"), (10, 12, "narrow"), (200, 300, "far")], "key_start bigint, key_end bigint, value string")
    asked = spark.createDataFrame([(5,), (11,), (13,), (150,), (300,), (-1,), (None,)], "k bigint")
    got = {x["k"]: x["value"] for x in lookups.ranged_lookup(asked, r, "k").collect()}
    assert got == {5: "wide", 11: "narrow", 13: None, 150: None, 300: "far", -1: None, None: None}


def test_sessions(spark):
    s = [("k", BASE + timedelta(seconds=10 * i), BASE + timedelta(seconds=10 * i + 10)) for i in range(-9, 100)] + [("k", None, BASE)]
    df = spark.createDataFrame(s, "key string, start timestamp_ntz, end timestamp_ntz")
    merged = state_tables.merge_sessions(df, ["key"])
    assert merged.count() == 1
    asked = spark.createDataFrame([("k", BASE), ("k", datetime(1999, 1, 1)), ("x", BASE)], "key string, at timestamp_ntz")
    assert rows(lookups.session_lookup(asked, merged, "key", "at").select("in_session")) == [(False,), (False,), (True,)]


def test_state_upkeep(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, None), ("k", 4, None), ("k", 5, "a")], "key string, t int, v string")
    assert rows(state_tables.condense(df, ["key"], "t", "v").select("t")) == [(1,), (3,), (5,)]
    assert rows(state_tables.condense(df, ["key"], "t", "v", F.lit(3)).select("t")) == [(1,), (3,), (4,), (5,)]
    parts = [df.where("t < 3"), df.where("t >= 3")]
    assert rows(state_tables.latest(parts, ["key"], "t")) == [("k", 5, "a")]
    assert rows(state_tables.latest(parts, ["key"], "t", overwrite=False)) == [("k", 1, "a")]
    seen = df.where("t = 1")
    assert rows(state_tables.suppress_duplicates(df, ["v"], seen).select("v")) == [(None,)]


def test_rollup(spark):
    df = spark.createDataFrame([(BASE, "x", None, 2.0), (BASE + timedelta(seconds=1), "x", "q", 3.0)], "ts timestamp_ntz, a string, b string, v double")
    got = statistics.rollup(df, "ts", ["a", "b"], "minute", value=F.col("v"))
    assert got.count() == 6
    assert rows(got.where("a = '*' and b = '*'").select("n", "total")) == [(2, 5.0)]
    assert statistics.masks(["a", "b"], "none") == [["a", "b"]]
    both = statistics.merge_statistics(got, got, keys=["time_bucket", "a", "b"])
    assert rows(both.where("a = '*' and b = '*'").select("n", "total")) == [(4, 10.0)]
    problems = statistics.validate(df.withColumn("c", F.lit(None).cast("int")), "ts", "a", "c", "v")
    assert problems.where("problem is not null").count() == 0


def test_tables(spark):
    assert tables.substitute("a ${x} $$ ${y}", {"x": "1"}) == "a 1 $ "
    assert tables.read_params("user=jbloggs site=\"New York\" q='it\\'s'") == {"user": "jbloggs", "site": "New York", "q": "it's"}
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert df.where(tables.chosen_values("x", [])).count() == 0
    assert df.where(tables.chosen_values("x", [], invert=True)).count() == 3
    assert df.where(tables.chosen_values("x", ["a"], invert=True)).count() == 2


def test_cleaning(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first()[0]
    assert one(cleaning.strip_bom(F.lit("﻿abc"))) == "abc"
    assert one(cleaning.drop_invalid_characters(F.lit("a\x01b\t"))) == "ab\t"
    assert one(cleaning.escape_bad_xml_text(F.lit("<a>1 < 2 & &amp;</a>"))) == "<a>1 &lt; 2 &amp; &amp;</a>"
    assert one(cleaning.find_replace(F.lit("aaa"), "a", "b", limit=2)) == "bba"
    assert one(cleaning.find_replace(F.lit("a.c abc"), "a.c", "$1")) == "$1 abc"
    assert one(cleaning.split_quoted(F.lit('x,"a ""b"", c",,y'))) == ["x", 'a "b", c', "", "y"]
    assert one(cleaning.key_values(F.lit("a=1 b=2 a=3"))) == {"a": "3", "b": "2"}
    assert one(cleaning.regex_fields(F.lit("123 [abc] text"), r"(\d+) \[(\w+)\] (.*)", ["id", "tag", "rest"])) == ("123", "abc", "text")
    assert one(cleaning.regex_fields(F.lit("none"), r"(\d+)", ["id"])) is None
    df = spark.createDataFrame([("f", "who,what\nann,login\n\nbob,logout")], "path string, value string")
    records = cleaning.split_records(df, "value").drop("value")
    named = cleaning.with_header(records, "record", "record_no", ["path"])
    assert rows(named.select(F.col("fields")["who"], F.col("fields")["what"])) == [("ann", "login"), ("bob", "logout")]


def test_sources_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,1", BASE), (2, None, BASE + timedelta(days=1))], "id int, t string, ts timestamp_ntz")
    writers.download(df.select("id", "t"), f"{tmp_path}/csv")
    assert rows(readers.csv(spark, f"{tmp_path}/csv", "id int, t string")) == rows(df.select("id", "t"))
    readers.index_table(df, f"{tmp_path}/index", "ts", ["t"])
    index = spark.read.parquet(f"{tmp_path}/index")
    assert readers.partition_filter(index, "ts", BASE, BASE + timedelta(hours=1)).count() == 1
    writers.write_text(df, f"{tmp_path}/text", F.col("id").cast("string"), header="head")
    assert ("head",) in rows(readers.lines(spark, f"{tmp_path}/text"))
    writers.append_streams(df.withColumns({"feed": F.lit("F"), "type": F.lit("Raw")}), f"{tmp_path}/streams")
    assert spark.read.parquet(f"{tmp_path}/streams").count() == 2
    assert writers.merge_records(df, [], "id", F.coalesce("t", F.lit("-"))).first()[0] == "x,1\n-"
    for name in readers.SCHEMAS:
        assert readers.empty(spark, name).count() == 0
    assert readers.view(df, "seen", F.col("id") == 1).count() == 1


def test_as_of_with_a_hot_key(spark):
    """A key with most of the rows is dealt over many tasks, and few states carry over all buckets."""
    from eventloom.operators.buckets import with_bucket

    asked = spark.range(4000).selectExpr("if(id % 10 = 0, cast(id as string), 'hot') AS key", "timestamp_ntz'2000-01-01' + make_dt_interval(0, 0, 0, pow(id, 1.5)) AS at", "id")
    states = spark.range(40).selectExpr("'hot' AS key", "timestamp_ntz'2000-01-01' + make_dt_interval(0, 0, 0, pow(id * 97, 1.5) + 0.5) AS effective_time", "id AS value")
    got = {r["id"]: (r["key"], r["value"]) for r in lookups.temporal_lookup(asked, states, "key", "at").collect()}
    assert len(got) == 4000
    for i, (key, value) in got.items():
        want = max((k for k in range(40) if (k * 97) ** 1.5 + 0.5 <= i**1.5), default=None)
        assert value == (want if key == "hot" else None), i
    parts = with_bucket(asked, "at", "b", buckets=16).where("key = 'hot'").groupBy("b").count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 2 * 3600 / 16
    shown = lookups.temporal_lookup(asked, states, "key", "at")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_as_of_equals_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows_ = [(rnd.choice("abc") if rnd.random() > 0.1 else None, rnd.randrange(60) if rnd.random() > 0.1 else None, i) for i in range(400)]
    states = [(rnd.choice("abc") if rnd.random() > 0.1 else None, rnd.randrange(60) if rnd.random() > 0.1 else None, rnd.randrange(9)) for _ in range(80)]
    left, right = spark.createDataFrame(rows_, "k string, t int, i int"), spark.createDataFrame(states, "k string, o int, v int")
    for buckets in (1, 2, 7):
        for r in lookups.as_of(left, right, ["k"], "t", "o", ["v"], buckets).collect():
            best = [(o, v) for k, o, v in states if k == r["k"] and None not in (k, o, r["t"]) and o <= r["t"]]
            assert r["v"] == (max(best)[1] if best else None)


def test_state_kinds_of_get_state(spark):
    from eventloom.functions import FUNCTIONS

    df = spark.createDataFrame([("a", 5, BASE)], "k string, n bigint, at timestamp_ntz")
    later = BASE + timedelta(days=1)
    kinds = {
        "exact": spark.createDataFrame([("a", "x")], "key string, value string"),
        "temporal": spark.createDataFrame([("a", BASE, "old"), ("a", later, "new")], "key string, effective_time timestamp_ntz, value string"),
        "session": spark.createDataFrame([("a", BASE, later)], "key string, start timestamp_ntz, end timestamp_ntz"),
        "ranged": spark.createDataFrame([(1, 9, "in")], "key_start bigint, key_end bigint, value string"),
        "both": spark.createDataFrame([(1, 9, later, "late")], "key_start bigint, key_end bigint, effective_time timestamp_ntz, value string"),
    }
    get = FUNCTIONS["getstate"]
    asked = {"exact": get("exact", "k"), "then": get("temporal", "k", "at"), "now": get("temporal", "k"), "there": get("session", "k", "at"), "band": get("ranged", "n"), "later": get("both", "n", "at"), "k": get("exact", "k")}
    want = {"exact": "x", "then": "old", "now": "new", "there": True, "band": "in", "later": None, "k": "x"}
    for name, value in asked.items():
        got = EventQuery(df).with_states(**kinds).eval(**{name: value}).frame().first().asDict()
        assert got == {"k": "a", "n": 5, "at": BASE, **{name: want[name]}}


def test_folders_and_dictionaries_of_any_depth(spark):
    deep = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(40)], "node string, parent string")
    df = spark.createDataFrame([("n40",), ("n0",), (None,)], "u string")
    assert rows(c.in_folder(df, "u", deep, "n0")) == [("n40",)]
    words = spark.createDataFrame([("a", "x"), ("b", "y"), ("z", "no")], "name string, word string")
    imports = spark.createDataFrame([("a", "b")], "name string, imported string")
    assert rows(c.dictionary_words(df, words, imports, "a")) == [("x",), ("y",)]


def test_terms_equal_split_terms(spark):
    df = spark.createDataFrame([("The cat's catalogue",), ("cat",), ("a cat, CAT_s",), ("concat",), (None,), ("",), ("naïve cat5 5",)], "u string")
    for analyser in c.ANALYSERS:
        for term in ("cat", "Cat's", "5", "the", "naïve", "a cat", ""):
            fast = [r[0] for r in df.select(c.has_term("u", term, analyser)).collect()]
            split = [r[0] for r in df.select(F.coalesce(F.array_contains(c.tokens("u", analyser), term if analyser == "keyword" else term.lower()), F.lit(False))).collect()]
            if analyser != "keyword":
                assert fast == split, (analyser, term)


def test_splitting(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first()[0]
    assert one(cleaning.split_fields(F.lit("a,'b,c',d\\,e,"), ",", "'", escape="\\")) == ["a", "b,c", "d,e", ""]
    assert one(cleaning.split_fields(F.lit("a::<b::c>"), "::", "<", ">")) == ["a", "b::c"]
    assert one(cleaning.split_fields(F.lit("a,b"), least=3)) is None and one(cleaning.split_fields(F.lit("a,b"), most=1)) == ["a"]
    assert one(cleaning.split_fields(F.lit(None).cast("string"))) is None
    assert one(cleaning.find_replace(F.lit("a\0a\0a"), "a", "b", limit=2)) == "b\0b\0a"
    assert one(cleaning.find_replace(F.lit("xx"), "y*", "b", regex=True, limit=2)) == "xx"
    assert [r["key"] for r in one(cleaning.regex_matches(F.lit("a=1 b=2"), r"(\w)=(\d)", ["key", "value"]))] == ["a", "b"]


def test_selections_of_groups(spark):
    from eventloom.functions import function

    df = spark.createDataFrame([(k, i, v) for k in ("a", None) for i, v in enumerate(["x", "y", "x", None, "z"])], "k string, i int, v string")
    got = EventQuery(df).order("i").group_by("k", n=a.count(), top=function("top")("v", ",", 2), bottom=function("bottom")("v", ",", 3), second=function("nth")("v", 2), none=function("nth")("v", 9), kinds=function("distinct")("v", "|", 2))
    assert rows(got.frame()) == sorted([("a", 5, "x,y", "x,z", "y", None, "x|y"), (None, 5, "x,y", "x,z", "y", None, "x|y")], key=repr)


def test_posting(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen, refused = [], []

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            if not refused:
                refused.append(body)
            else:
                seen.extend(body.split("\n"))
            self.send_response(200 if seen else 503)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    writers.post_rows(spark.range(0, 10, 1, 1).selectExpr("cast(id as string) as x"), f"http://127.0.0.1:{server.server_port}/in", F.col("x"), together=4)
    server.shutdown()
    assert refused == ["0\n1\n2\n3"] and seen == [str(i) for i in range(10)]


def test_rolling_by_time(spark, tmp_path):
    df = spark.createDataFrame([("F", "Raw", BASE), ("F", "Raw", BASE + timedelta(minutes=90))], "feed string, type string, ts timestamp_ntz")
    writers.append_streams(df, f"{tmp_path}/streams", time="ts")
    assert {r["rolled"] for r in spark.read.parquet(f"{tmp_path}/streams").select(F.col("rolled").cast("string")).collect()} == {"2000-01-01T000000", "2000-01-01T010000"}


def test_xml_fields_are_evaluated_at_once(spark):
    """One XPath evaluation for all fields, with the results that each path has by itself."""
    odd = ["<r><e><k>a</k></e><e><u>7</u></e></r>", "<r><e><k>x<b>y</b>z</k><k>2</k></e></r>", "<r a='1, 2'><e/><e><u><![CDATA[<&]]>&lt;<!-- c -->;</u></e></r>", "<r/>", "", None, "<r>\n <e> <k> a\tb </k></e></r>", '<?xml version="1.1"?><r><e><k>&#31;</k></e><e><u>&#xFFFD;</u></e></r>']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string")
    paths = {"k": "/r/e[1]/k", "u": "r/e[2]/u", "a": "/r/@a", "n": "count(//e)", "t": "//e[k = 'a' or u]", "yes": "boolean(//u)"}
    fields = df.select("i", cleaning.xml_fields("x", paths).alias("f")).select("i", "f.*")
    assert rows(fields) == rows(df.select("i", *[F.xpath_string("x", F.lit(p)).alias(n) for n, p in paths.items()]))
    assert rows(df.select("i", cleaning.xml_fields("x", {"k": "/r/e[1]/k"}).alias("f")).select("i", "f.*")) == rows(fields.select("i", "k"))
    both = spark.createDataFrame([("<e><k>a</k></e>",), ('{"k":"b"}',), ("k=c u=d",), (None,), ("",), ("<e><u>1</u><k>2</k></e>",)], "x string")
    combined = both.select(cleaning.combined_fields("x", ["k", "u"]).alias("f")).select("f.*")
    assert rows(combined) == sorted([("a", ""), ("b", ""), ("c", "d"), ("", ""), ("", ""), ("2", "1")], key=repr)
    for column in (cleaning.xml_fields("x", paths), cleaning.combined_fields("x", ["k", "u"])):
        assert len({call[:80] for call in str(column).split("xpath_string(")[1:]}) == 1
