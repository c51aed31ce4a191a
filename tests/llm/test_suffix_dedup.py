from __future__ import annotations

import hashlib
import random

import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from eventloom.llm import queries, suffix_dedup


def brute(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = {}, {}
    for at, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for k in range(len(data) - 99):
            seen.setdefault(data[k : k + 100], (at, k))
    for at, (i, text) in enumerate(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if seen[data[k : k + 100]] < (at, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, text)] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(df, rows, hot):
    want = {}
    for (i, _), v in brute(rows).items():
        want.setdefault(i, []).append(v)
    got = suffix_dedup.dedup(df, hot).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) in want[r["doc_id"]], r["doc_id"]
        if r["kept"] is not None:
            assert len(r["kept"]) == r["n_bytes"] - r["n_removed"]
            assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("hot", [1, suffix_dedup.HOT])
def test_documents(documents, hot):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check(documents, rows, hot)


def test_query(spark, sf, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = {i: v for (i, _), v in brute(rows).items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op5_suffix_dedup(spark, sf).collect()} == want


@pytest.mark.parametrize(("seed", "hot"), [(1, 1), (2, suffix_dedup.HOT), (3, 2), (4, suffix_dedup.HOT)])
def test_periods_overlaps_and_borrowed_parts(table, seed, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(100):
        text = ""
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.3:
                text += rng.choice("ab") * rng.randint(1, 300)
            elif kind < 0.5:
                text += ("xyz é" * 80)[: rng.randint(1, 300)]
            elif kind < 0.8 and rows:
                other = rng.choice(rows)[1] or ""
                a = rng.randint(0, max(0, len(other) - 1))
                text += other[a : a + rng.randint(1, 400)]
            else:
                text += "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 250)))
        rows.append((i, text or None))
    check(table(rows), rows, hot)


def test_odd_rows(table):
    odd = [r for r in ODD if not (r[1] or "").startswith("word word")] + [(5, "word " * 200), (11, None), (11, "word " * 200)]
    check(table(odd), odd, suffix_dedup.HOT)
    assert suffix_dedup.dedup(table([])).count() == 0
    long = suffix_dedup.dedup(table([(5, "word " * 60_000)])).first()
    assert (long["n_bytes"], long["n_removed"], long["n_spans"]) == (300_000, 299_995, 1)


@pytest.mark.parametrize("hot", [1, 3])
def test_grams_with_more_runs_than_are_held(table, monkeypatch, hot):
    """Runs of one gram come in many batches: equal ones, ones with other contexts, rows that are one document."""
    monkeypatch.setattr(suffix_dedup, "SETTLED", 4)
    monkeypatch.setattr(suffix_dedup, "PACKED", 300)
    monkeypatch.setattr(suffix_dedup, "SMALL_BLOCK", 1 << 9)
    rng = random.Random(hot)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = word(130)
    rows = [(i, word(60) + common + word(60)) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(30)] + [rows[3], rows[3], (5, rows[3][1]), (None, rows[9][1]), (300, None), (301, "")]
    check(table(rows), rows, hot)


def test_runs_are_settled_in_one_shuffle(spark):
    """What repeats, what is open and what is alone comes of one sort by gram: no joins, no further aggregates."""
    runs = spark.createDataFrame([(1, 1, 1, 5, 2, 0, 9), (1, 1, 1, 6, 1, 3, 12), (1, 2, 2, 6, 1, 40, 49), (2, 1, 1, 5, 2, 60, 69), (3, 1, 1, 5, 2, 80, 80), (3, 1, 1, 5, 2, 80, 80)], "gram long, c1 long, c2 long, row long, doc long, s long, e long")
    settled = suffix_dedup._settled(runs.withColumn("salt", F.lit(0).cast("long")), 20)
    got = {(r["gram"], r["kind"], r["doc"], r["s"]) for r in settled.collect()}
    assert got == {(1, suffix_dedup.REPEAT, 2, 0), (1, suffix_dedup.OPEN, 1, 3), (1, suffix_dedup.OPEN, 1, 40)}
    plan = settled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_copies_of_a_batch_are_spread(table):
    """A gram that very many copies share doesn't bring them all to one task."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    keyed = suffix_dedup._keyed(table([(i, text) for i in range(400)])).coalesce(1)
    runs = suffix_dedup._run_rows(keyed, suffix_dedup.sieve.build(suffix_dedup._grams_twice(keyed), ["gram"])).collect()
    by_key = {}
    for r in runs:
        by_key[r["gram"], r["salt"]] = by_key.get((r["gram"], r["salt"]), 0) + 1
    assert len(runs) >= 400 and len(runs) % 400 == 0 and max(by_key.values()) <= 4
