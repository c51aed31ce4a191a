"""Each stage of the pipeline against a brute-force version, on its own input; and odd rows through all of them."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from conftest_llm import ODD, WORD
from test_mix_and_shards import targets
from test_near_dedup import brute
from test_text_operators import plain_items_found

import corpus_pipeline as cp

STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module")
def corpus(table):
    """Documents of two languages, with copies, near copies, benchmark items, junk and nulls."""
    rng = random.Random(7)
    stock = {"en": "the and of with this that from have been were".split(), "de": "der und mit dass nicht auch wird einen haben sind".split()}
    made = {g: w + ["".join(rng.choice(w) for _ in range(2)) for _ in range(150)] for g, w in stock.items()}
    text = lambda g, n: " ".join(rng.choice(made[g]) for _ in range(n))
    rows = [(i, text("en" if i % 3 else "de", 20 + i % 90), "en" if i % 3 else "de", f"s{i % 4}" if i % 4 else None) for i in range(120)]
    rows += [(200 + i, rows[i][1], *rows[i][2:]) for i in range(10)]
    for i in range(10, 20):
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w), *rows[i][2:]))
    return [*rows, (300, None, "en", "s1"), (301, "", None, "s2"), (302, "123 !!! 456", "en", None), (303, "qqq zzxx jjvv ppww " * 9, None, "s1"), (304, rows[50][1] + " " + rows[51][1], "en", "s3")]


def after(stage, spark, df, sf):
    out = stage(spark, df, sf)
    assert set(cp.COLUMNS) <= set(out.columns)
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in out.collect()]


def test_language_stage(spark, table, corpus, sf):
    """Kept: documents of which 0.3 of the n-grams are known to the language with the most; here by plain sets."""
    got = {r[0] for r in after(STAGES["language ID"], spark, table(corpus), sf)}
    fold = lambda t: " " + "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in t.lower()) + "  "
    grams = lambda t: [fold(t)[k : k + 4] for k in range(len(fold(t)) - 3)]
    counts = {g: Counter(x for _, t, h, _ in corpus if h == g and t for x in grams(t)) for g in ("en", "de")}
    rate = {g: {x: n / sum(c.values()) for x, n in c.items()} for g, c in counts.items()}
    known = {g: {x for x, n in c.items() if n >= 3 and rate[g][x] >= 0.2 * max(rate[h].get(x, 0) for h in rate)} for g, c in counts.items()}
    for i, t, _, _ in corpus:
        share = max(sum(x in k for x in grams(t)) / len(grams(t)) for k in known.values()) if t and any(map(str.isalpha, t)) else 0.0
        assert abs(share - 0.3) < 0.02 or (i in got) == (share >= 0.3), (i, share)
    assert not got & {300, 301, 302, 303} and len(got) > 100


def test_near_duplicate_stage(spark, table, corpus, sf):
    """Kept: the smallest doc_id of each component by five-word shingles and similarity 0.8, every pair compared."""
    got = sorted(r[0] for r in after(STAGES["near-duplicate removal"], spark, table(corpus), sf))
    assert got == sorted(i for i, (_, component) in brute([r[:2] for r in corpus], 5).items() if i == component)


def test_benchmark_stage(spark, table, corpus, sf):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = [*corpus, *[(400 + k, f"{corpus[k][1]} {items[k]} end", "en", "s1") for k in range(8)]]
    got = sorted(r[0] for r in after(STAGES["benchmark decontamination"], spark, table(rows), sf))
    assert got == sorted(i for i, t, _, _ in rows if not plain_items_found(t or "", items))
    assert not set(got) & set(range(400, 408))


def test_mixing_stage(spark, table, corpus, sf):
    """Whole documents; each source within one of its documents of its target, and the whole within half of one."""
    got = after(STAGES["source mixing"], spark, table(corpus), sf)
    size = lambda t: len(WORD.findall(t or ""))
    total, taken, longest = Counter(), Counter(), Counter()
    for _, t, _, s in corpus:
        total[s] += size(t)
        longest[s] = max(longest[s], size(t))
    drawn = Counter(got)
    assert set(drawn) <= set(corpus) and max(drawn.values()) <= 3
    for (_, t, _, s), n in drawn.items():
        taken[s] += n * size(t)
    for s, want in targets(dict(total)).items():
        assert abs(taken[s] - want) <= longest[s] + sum(longest.values()) * want / sum(total.values()), s
    assert abs(sum(taken.values()) - sum(total.values())) <= max(longest.values())


def test_sharding_stage(spark, table, corpus, sf):
    out = STAGES["sharding"](spark, table(corpus), sf).collect()
    rows = [r[:2] for r in corpus]
    size = {i: len((t or "").encode()) + 16 for i, t in rows}
    assert sorted(r["doc_id"] for r in out) == sorted(size)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by_shard.values())
    target = sum(size.values()) / cp.SHARDS
    assert all(abs(sum(size[r["doc_id"]] for r in by_shard.get(k, [])) - target) <= 6 * max(size.values()) for k in range(cp.SHARDS))


def test_stages_keep_columns_whatever_their_names(spark, table, sf):
    """Extra columns with names of the operators' own are no trouble."""
    odd = table(ODD).selectExpr("*", "1 AS row", "2 AS _found", "3 AS known", "4 AS component_id", "5 AS row_key", "6 AS draw", "7 AS slot", "8 AS _key", "9 AS size")
    for name, stage in cp.STAGES:
        assert set(cp.COLUMNS) <= set(stage(spark, odd, sf).columns), name
        assert stage(spark, odd, sf).count() >= 0
