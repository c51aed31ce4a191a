from __future__ import annotations

import random

import numpy as np
import pytest
from conftest_llm import ALIKE, LOWER, ODD, WORD

from eventloom.llm import components, near_dedup, queries, textblocks


def sets(rows, k):
    out = {}
    for i, text in rows:
        w = [x.translate(LOWER) for x in WORD.findall(text or "")]
        out.setdefault(i, set()).update({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(rows, k):
    s = sets(rows, k)
    ids = sorted(s)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def check(df, rows, k):
    want = brute(rows, k)
    got = near_dedup.near_duplicates(df, shingle=k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_documents(spark, sf, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = brute(rows, 4)
    got = queries.op2_minhash_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_edited_copies(table, seed):
    """Groups with links that no member shares with all others, passages that many share, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(40)]
    for _ in range(4):
        base = [word() for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join(passage + [word() for _ in range(rng.randint(1, 60))]) for _ in range(60)]
    rows += [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(20)] * 2
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    check(table(rows), rows, 4)


def test_odd_rows(table):
    got = {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.near_duplicates(table(ODD)).collect()}
    assert len(near_dedup.near_duplicates(table(ODD)).collect()) == len(ODD)
    assert got[(1, 0)]["kept"] and got[(2, 0)]["kept"] and got[(3, 0)]["component_id"] == 3
    assert got[(7, 8)]["component_id"] == 6 and not got[(7, 8)]["kept"]
    assert near_dedup.near_duplicates(table([])).count() == 0
    clash = table(ODD).withColumnsRenamed({"lang": "gone_id", "source": "component_id"})
    assert near_dedup.drop_near_duplicates(clash).count() == len(ODD) - 1
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(table([]), percent=70)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_rounds(spark, monkeypatch):
    """Stars are seen to be stars by the step that labels them; a chain of 40 in a few rounds of two shuffles each."""
    plans = []
    write = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    star = components.connected_components(spark.createDataFrame([(9, 4), (4, 7), (1, 2), (1, 3), (2, 1)], "a long, b long"))
    assert {(r["node"], r["component"]) for r in star.collect()} == {(4, 4), (7, 4), (9, 4), (1, 1), (2, 1), (3, 1)} and star.count() == 6
    assert len(plans) == 1
    assert components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).where("component = 0").count() == 41
    assert len(plans) <= 8 and max(x.count("Exchange") for x in plans) <= 2


def test_long_words_that_hashes_may_confuse(table, monkeypatch):
    """One word each, the same words within a longer text, a copy in capitals; one list of several salts."""
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 2)
    rows = [*ALIKE, *[f"one two three {x} four five six" for x in ALIKE], ALIKE[0].upper()]
    rows += [" ".join(f"w{i}" for i in range(40)) + f" end{k}" for k in range(7)]
    rows = list(enumerate(rows))
    check(table(rows), rows, 4)


def test_pairs_are_counted_on_the_words_themselves(table, monkeypatch):
    """Even where all words have one hash."""
    monkeypatch.setattr(textblocks, "range_hashes", lambda data, starts, ends, lower=False: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"ab Ab ab xy", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    assert textblocks.exact_ids(data, starts, ends).tolist() == [0, 1, 0, 2]
    assert textblocks.exact_ids(data, starts, ends, lower=True).tolist() == [0, 0, 0, 1]
    assert textblocks.exact_windows(np.array([4, 1, 4, 1, 2]), 2).tolist() == [2, 1, 2, 0]
