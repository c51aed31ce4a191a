from __future__ import annotations

import zlib

import pytest
from conftest_llm import ODD, WORD

from eventloom.llm import mixing, ordering, queries, sharding


def targets(sizes, weights=(1, 2, 3), cap=3):
    """By hand: sizes by source; None is last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        share = {s: cap * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and share[s] > cap * sizes[s]}
        if not over:
            return share
        full |= over


def check_mix(rows, got):
    words = [(r[0], len(WORD.findall(r[1] or "")), r[3]) for r in rows]
    sizes = {}
    for _, n, s in words:
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r, s in got:
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mix_of_documents(spark, sf, documents):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect()]
    source = {r[0]: r[3] for r in rows}
    once = queries.op4_source_mix(spark, sf).collect()
    check_mix(rows, [(r, source[r["doc_id"]]) for r in once])
    assert sorted(once) == sorted(queries.op4_source_mix(spark, sf).collect())


def test_mix_with_caps_nulls_and_empty_sources(table):
    rows = [(i, "w " * (i % 9), None, ["tiny", "é", "big", "big", "big", None, "void"][i % 7]) for i in range(200)]
    rows = [(i, "" if s == "void" else "w" if s == "tiny" and i > 7 else t, g, s) for i, t, g, s in rows]
    rows += [(None, "null id here", None, "big"), (3, rows[3][1], None, rows[3][3])]
    plan = mixing.schedule(table(rows))
    from pyspark.sql import functions as F

    got = plan.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda x, d: x + d["taken_words"])).collect()
    check_mix(rows, [(r, None if r["source_key"] == "n" else r["source_key"][1:]) for r in got])
    assert mixing.schedule(table([])).count() == 0
    assert mixing.mix(table([])).count() == 0


def test_mix_is_ordered_and_whole(table):
    rows = [(i, "w " * (1 + i % 5), None, "ab"[i % 2]) for i in range(60)] + [(0, "w ", None, "a")]
    out = mixing.mix(table(rows).withColumnsRenamed({"n_chars": "draw", "lang": "row"}).selectExpr("*", "1 AS id", "2 AS hash", "3 AS _id")).collect()
    finish = [r["virtual_finish"] for r in out]
    assert finish == sorted(finish)
    drawn = [(r["doc_id"], r["draw"]) for r in out]
    assert len([d for d in drawn if d == (0, 1)]) == 2
    assert all(r["taken_words"] == len(WORD.findall(r["text"])) for r in out)


def test_the_queue_decides_the_mix(spark, table):
    """Packets are range-partitioned by finish time, and what is served is what a word-by-word queue serves."""
    import heapq

    rows = [(i, "w " * (1 + i * 37 % 400), None, "abcd"[i % 4 if i % 3 else 0]) for i in range(90)]
    packets = spark.createDataFrame([("ka", 0, 5, 9.0, 0.5)], "source_key string, start long, words long, target double, finish double")
    assert "rangepartitioning(finish" in mixing._queued(packets)._jdf.queryExecution().toString()
    plan = mixing.schedule(table(rows)).collect()
    target = {r["source_key"]: r["target"] for r in plan}
    budget = sum(int(x) for x in target.values())
    queue, served = [(1 / t, k, 1) for k, t in target.items() if t], dict.fromkeys(target, 0)
    heapq.heapify(queue)
    for _ in range(budget):
        _, k, n = heapq.heappop(queue)
        served[k] = n
        heapq.heappush(queue, ((n + 1) / target[k], k, n + 1))
    taken = dict.fromkeys(target, 0)
    for r in plan:
        taken[r["source_key"]] += sum(d["taken_words"] for d in r["draws"])
    assert taken == served


def test_running_total(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select((F.col("id") % 3).alias("g"), ordering.shuffled("id").alias("o"), F.col("id").alias("t"), (F.col("id") % 7).alias("w"))
    got = ordering.running_total(df, ["g"], "o", ["t"], "w", 3000, "before").collect()
    so_far = {}
    for r in sorted(got, key=lambda r: (r["g"], r["o"], r["t"])):
        assert r["before"] == so_far.get(r["g"], 0)
        so_far[r["g"]] = r["before"] + r["w"]


def check_shards(got, rows, shards):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert all(0 <= k < shards for k in by_shard)
    return {k: sum(r["size"] for r in own) for k, own in by_shard.items()}


def test_shards_of_documents(spark, sf, documents):
    """The registered query: 40 shards within the bound that the operator states, of real metadata dimensions."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = queries.op10_kd_shards(spark, sf).collect()
    sizes = check_shards(got, rows, 40)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    target = sum(r["size"] for r in got) / 40
    bound = 6 * max(max(r["size"] for r in got), sharding.TOLERANCE * target)
    assert all(abs(sizes.get(k, 0) - target) <= bound for k in range(40))


def plain_kd(rows, shards):
    """By hand, with the operator's keys: rows of (keys, tie, size); each node is cut by sorting."""
    spans = [max(r[0][d] >> 32 for r in rows) for d in range(len(rows[0][0]))]
    total = sum(r[2] for r in rows)

    def split(own, leaves, first):
        if leaves == 1:
            return [(first, r) for r in own]
        widths = [(max(x) - min(x)) / max(1, s) for x, s in zip(([r[0][d] >> 32 for r in own] for d in range(len(spans))), spans, strict=True)]
        dim = max(range(len(spans)), key=lambda d: (widths[d], -d))
        wanted = sum(r[2] for r in own) * (leaves // 2) / leaves
        order = sorted(own, key=lambda r: (r[0][dim], r[1]))
        before, at = 0, 0
        while at < len(order):
            end = at
            while end < len(order) and order[end][0][dim] == order[at][0][dim]:
                end += 1
            inside = sum(r[2] for r in order[at:end])
            if before + inside >= wanted or end == len(order):
                if inside > total / shards * sharding.TOLERANCE and end - at > 1:
                    while at < end and before + order[at][2] < wanted:
                        before, at = before + order[at][2], at + 1
                    inside, end = order[at][2] if at < end else 0, at + 1
                cut = end if before + inside / 2 < wanted else at
                break
            before, at = before + inside, end
        half = leaves // 2
        return split(order[:cut], half, first) + split(order[cut:], leaves - half, first + half)

    return split(rows, shards, 0)


def test_shards_equal_sorted_cuts(table):
    """Histogram cuts put the same bytes into each shard as cuts of sorted lists, but for rows at the cuts."""
    rows = [(i, f"w{i} " * (3 + i * 7 % 31), ["en", "de", None][i % 3], f"s{i % 5}") for i in range(600)]
    described = sharding.describe(table(rows), None).collect()
    plain = {}
    for k, r in plain_kd([(tuple(r["keys"]), r["tie"], r["size"]) for r in described], 8):
        plain[k] = plain.get(k, 0) + r[2]
    sizes = {}
    for r in sharding.assign(table(rows), 8).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    largest = max(r["size"] for r in described)
    assert sum(sizes.values()) == sum(plain.values()) and all(abs(sizes[k] - plain[k]) <= 3 * largest for k in range(8))


def test_shards_are_near_equal_and_keep_small_groups(table):
    rows = [(i, f"text number {i} " * (3 + i % 11), ["en", None][i % 2], f"s{i % 5}") for i in range(1500)]
    rows += [(2000 + i, "a copy of one text", "en", "s1") for i in range(700)]
    rows += [(3000 + i, f"pair {i // 2} of the same text", "de", "s2") for i in range(60)]
    got = sharding.assign(table(rows), 8).collect()
    sizes = check_shards(got, rows, 8)
    assert len(sizes) == 8 and max(sizes.values()) < 1.08 * min(sizes.values())
    pairs = {}
    for r in got:
        if r["doc_id"] >= 3000:
            pairs.setdefault((r["doc_id"] - 3000) // 2, set()).add(r["shard"])
    assert sum(len(s) == 1 for s in pairs.values()) >= 0.8 * len(pairs)


def test_shard_keeps_rows_and_columns(table):
    rows = [(r[0], r[1], None, None) for r in ODD]
    df = table(rows)
    out = sharding.shard(df.selectExpr("*", "7 AS slot", "doc_id AS size", "1 AS _key", "2 AS _n", "3 AS row"), 3)
    assert sorted(out.columns) == sorted([*df.columns, "size", "shard", "slot", "_key", "_n", "row"])
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert sharding.shard(table([]), 3).count() == 0 and sharding.assign(table([]), 3).count() == 0
    assert sharding.shards_for(table([(1, "x" * 984)]), 100) == 10


def test_plans_of_a_level_do_not_grow_with_the_tree(documents, monkeypatch):
    """Rows carry their leaf: no plan of a pass over a level nests the tree's cuts, which took the driver's memory."""
    plans = []
    narrow = sharding._narrow
    monkeypatch.setattr(sharding, "_narrow", lambda rows, *rest: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN")), narrow(rows, *rest))[1])
    got = sharding.assign(documents, 16)
    assert got.count() == documents.count() and len(plans) >= 4
    assert max(plans) == 0
