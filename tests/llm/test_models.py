"""Language ID, line labels and n-gram quality."""

from __future__ import annotations

import itertools
import re
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ALIKE, ODD

from eventloom.llm import language_id, line_crf, ngram_quality, queries


def test_language_of_held_out_documents(spark, sf, documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    got = queries.op7_language_id(spark, sf).collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and len(held) > 20
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(table):
    df = table([(r[0], r[1]) for r in ODD])
    model = language_id.fit(table([(i, t * 9, g) for i, (t, g) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de"), ("x", None)])]))
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df.withColumnRenamed("n_chars", "score"), model).collect()}
    assert got[None] == got[""] == got["!!! ??? ..."] == ("und", 0.0)
    assert got[ODD[-1][1]][0] in ("en", "de")
    none = language_id.fit(table([]))
    assert {r["lang_pred"] for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.predict(table([]), model).count() == 0


def test_more_languages_than_bits_of_a_word(table):
    """150 made-up languages, each of its own syllables: all are learned, short texts too, and known doesn't shrink."""
    rng = np.random.default_rng(4)
    syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 2)) for _ in range(1500)]
    word = lambda i: "".join(rng.choice(syllables[10 * i : 10 * i + 10], rng.integers(1, 4)))
    text = lambda i: " ".join(word(i) for _ in range(60))
    rows = [(1000 * i + k, text(i), f"language {i:03d}") for i in range(150) for k in range(4)]
    model = language_id.fit(table(rows))
    assert len(model.languages) == 150 and model.slots.shape[0] == 3
    fresh = [(i, text(i), None) for i in range(150)] + [(200, "Oui", None), (201, syllables[700], None), (202, "1234 !!", None)]
    got = {r["doc_id"]: r for r in language_id.predict(table(fresh).withColumnRenamed("n_chars", "known"), model).collect()}
    right = [got[i]["lang_pred"] == f"language {i:03d}" for i in range(150)]
    assert np.mean(right) > 0.95 and min(got[i]["known"] for i in range(150) if right[i]) > 0.3
    assert got[200]["lang_pred"] != "und" and got[201]["known"] > 0 and got[202]["lang_pred"] == "und"


def test_bloom_hits_equal_plain_sets(table):
    """Corrected hits are the hits of plain sets of n-grams, but for what the filters pass by chance."""
    from eventloom.llm.textblocks import blocks

    import pyarrow as pa

    rows = [(i, f"{w} and {w} or the {w} of {w} " * 5, g) for i, (w, g) in enumerate([("cat", "en"), ("katze", "de"), ("chatte", "fr")] * 4)]
    model = language_id.fit(table(rows), docs_per_language=100)
    fold = lambda t: " " + "".join(c if c.isalpha() or ord(c) > 127 else " " for c in t.lower()) + "  "
    grams = lambda t: [fold(t)[k : k + 4] for k in range(len(fold(t)) - 3)]
    counts = {g: Counter(x for _, t, h in rows if h == g for x in grams(t)) for g in ("de", "en", "fr")}
    rate = lambda g, x: counts[g][x] / sum(counts[g].values())
    member = lambda g, x: counts[g][x] >= 3 and rate(g, x) >= 0.2 * max(rate(h, x) for h in counts)
    asked = ["the cat of the house", "katze oder chatte", "xyz", "a"]
    (block,) = blocks(pa.array(asked))
    hits, n = model.corrected_hits(block)
    assert n.tolist() == [len(grams(t)) for t in asked]
    want = [[sum(member(g, x) for x in grams(t)) for g in ("de", "en", "fr")] for t in asked]
    assert np.abs(hits - np.array(want)).max() < 0.1


def base_counts(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_line_labels(spark, sf, documents):
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = queries.op6_line_crf(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r["kept"], quality[r["doc_id"]]) for r in got if r["doc_id"] in quality and not r["base_failed"]]
    assert np.mean([k for k, q in judged if q == 1]) > 0.95
    assert np.mean([k for k, q in judged if q == 0] or [0]) < 0.5


def test_line_labels_of_odd_rows(table, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = line_crf.fit(table(ODD), labels)
    got = line_crf.judge(table(ODD), model).collect()
    assert len(got) == len(ODD) and line_crf.judge(table([]), model).count() == 0
    for r, (_, text) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_words"])), sorted(ODD, key=lambda r: (r[0] or 0, len((r[1] or "").split()))), strict=True):
        assert r["n_words"] == len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def test_line_counts_of_long_lines_that_hashes_may_confuse(table):
    rows = [(0, "\n".join(ALIKE)), (1, "\n".join([*ALIKE, ALIKE[1]])), (2, " ".join([f"a b {x}" for x in ALIKE] * 20)), (3, "\n\na\n \na\n ")]
    model = line_crf.ChainModel(np.zeros((line_crf.N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    clash = table(rows).withColumnsRenamed({"lang": "kept", "source": "n_words"})
    for r in line_crf.judge(clash, model).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(rows[r["doc_id"]][1])


def test_lines_are_labelled_by_themselves():
    """A pattern of bad documents is boilerplate, and so is a line that stands behind several others; a line of copies isn't."""
    good, bad, part = 0b1, 0b1000000001, 0b101
    codes = [np.array([good, good, part])] * 8 + [np.array([bad, bad, good])] * 4
    keys = [np.array([1000 + i, 2000 + i, 7]) for i in range(4)] + [np.array([11, 12, 13])] * 4 + [np.array([3000 + i, 4000 + i, 5000 + i]) for i in range(4)]
    labels = line_crf.line_labels(codes, keys, [1] * 8 + [0] * 4)
    assert [x.tolist() for x in labels] == [[0, 0, 1]] * 4 + [[0, 0, 0]] * 4 + [[1, 1, 0]] * 4
    assert line_crf.line_labels([], [], []) == []


def test_viterbi_and_training():
    rng = np.random.default_rng(0)
    model = line_crf.ChainModel(np.zeros((line_crf.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in (1, 2, 6):
        scores = rng.normal(size=(n, 2))
        total = lambda p, s=scores: model.start[p[0]] + sum(s[i, x] for i, x in enumerate(p)) + sum(model.move[a, b] for a, b in itertools.pairwise(p))
        assert tuple(model.decode(scores)) == max(itertools.product((0, 1), repeat=n), key=total)
    xs = [np.eye(line_crf.N_FEATURES)[rng.integers(0, 2, 5)] for _ in range(80)]
    ys = [x[:, 1].astype(int) for x in xs]
    fitted = line_crf.train(xs, ys)
    assert np.mean([(fitted.decode(x @ fitted.emit) == y).mean() for x, y in zip(xs, ys, strict=True)]) > 0.99
    assert line_crf.train([], []).emit.sum() == 0


def test_quality(spark, sf, documents):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op9_kneser_ney_quality(spark, sf).collect()
    assert len(got) == documents.count()
    assert np.mean([r["kept"] for r in got if quality.get(r["doc_id"]) == 1]) > 0.95
    mean = lambda q: np.mean([np.log(r["perplexity"]) for r in got if quality.get(r["doc_id"]) == q])
    assert mean(0) > mean(1) + 1


def kneser_ney(texts):
    """A plain interpolated modified Kneser-Ney trigram model."""
    tri = Counter()
    for t in texts:
        w = ["<", "<", *t.split()]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)

    def discounts(counts):
        n = [sum(v == k for v in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        raw = (1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
        return [max(0.05, min(k - 0.05, x)) for k, x in zip((1, 2, 3), raw, strict=True)]

    def order(counts, context):
        d, total, held = discounts(counts), Counter(), Counter()
        for g, c in counts.items():
            total[context(g)] += c
            held[context(g)] += d[min(c, 3) - 1]
        own = {g: (c - d[min(c, 3) - 1]) / total[context(g)] for g, c in counts.items()}
        return own, {k: held[k] / total[k] for k in total}

    o3, r3 = order(tri, lambda g: g[:2])
    o2, r2 = order(bi, lambda g: g[0])
    o1, r1 = order(uni, lambda g: ())

    def log_probability(text):
        w, out = ["<", "<", *text.split()], 0.0
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            p1 = o1.get(c, 0) + r1[()] / (len(uni) + 1)
            p2 = o2.get((b, c), 0) + r2.get(b, 1) * p1
            out += np.log(o3.get((a, b, c), 0) + r3.get((a, b), 1) * p2)
        return out

    return log_probability


def test_kneser_ney_equals_the_plain_model(table):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefg"), size=rng.integers(1, 40), p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])) for _ in range(30)]
    plain = kneser_ney(texts)
    df = table([(i, t) for i, t in enumerate([*texts, "a b z a b", "z"])])
    model = ngram_quality.fit(df, df.where("doc_id < 30").select("doc_id"))
    for r in ngram_quality.scored(df, model).collect():
        text = [*texts, "a b z a b", "z"][r["doc_id"]]
        assert r["log_probability"] == pytest.approx(plain(text), rel=1e-4)


def test_quality_of_odd_rows(table, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = ngram_quality.keep(table(ODD), none).collect()
    assert len(got) == len(ODD)
    assert all(r["kept"] == (r["n_words"] > 0) and r["perplexity"] is None for r in got)
    some = spark.createDataFrame([(6, 1), (5, 1), (None, 1), (4, None), (9, 1), (7, 1)], "doc_id long, quality int")
    assert ngram_quality.keep(table(ODD), some).count() == len(ODD)
    assert ngram_quality.keep(table([]), some).count() == 0


def test_quality_learns_from_all_trusted_text(table, spark):
    # 4,000 trusted documents; a word triple that stands in one training document, past 20,000 words, is not unseen
    labels = spark.range(4000).selectExpr("id AS doc_id", "1 AS quality")
    training = ngram_quality.training_ids(labels)
    assert 2800 < training.count() < 3200
    texts = [(0, "x " * 20_001 + "rare mark here"), (1, "x x x"), (7, "rare mark here"), (8, "here mark rare")]
    docs = table(texts)
    model = ngram_quality.fit(docs, spark.createDataFrame([(0,), (1,)], "doc_id long"))
    got = {r["doc_id"]: r["log_probability"] for r in ngram_quality.scored(docs, model).collect()}
    plain = kneser_ney([t for _, t in texts[:2]])
    assert all(got[i] == pytest.approx(plain(t), rel=1e-4) for i, t in texts)
    assert got[7] > got[8]


def test_quality_threshold_is_the_quantile_alone(table, spark):
    rng = np.random.default_rng(2)
    docs = table([(i, " ".join(rng.choice(list("abcdefgh"), size=40)), "en") for i in range(60)])
    labels = spark.range(60).selectExpr("id AS doc_id", "1 AS quality")
    training = {r["doc_id"] for r in ngram_quality.training_ids(labels).collect()}
    got = ngram_quality.keep(docs, labels).collect()
    held_out = [r["perplexity"] for r in got if r["doc_id"] not in training]
    assert held_out and {r["threshold"] for r in got} == {max(held_out)}
    assert all(r["kept"] == (r["perplexity"] <= max(held_out)) for r in got)


def test_quality_leaves_no_shuffle_files(table, spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    known = lambda: set(re.findall(r"shuffle_(\d+)_", files.getAllFiles().mkString("\n")))
    docs = table([(i, f"some words of text {i}") for i in range(200)])
    model = ngram_quality.fit(docs, docs.where("doc_id < 100").select("doc_id"))
    before = known()
    scores = ngram_quality.scored(docs, model)  # writes what it looks up
    for _ in range(40):
        if not known() - before:
            break
        time.sleep(0.5)
    assert not known() - before
    assert scores.count() == 200


def test_quality_keeps_little_on_disk(table, spark, monkeypatch):
    """The model takes a few bytes for each n-gram, nothing else stays, and rounds don't change scores."""
    from pathlib import Path

    from eventloom.llm.scratch import scratch_root

    root = Path(scratch_root(spark).removeprefix("file:"))
    used = lambda: sum(x.stat().st_size for x in root.rglob("*") if x.is_file())
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, 5000) % 400) for _ in range(40)]
    docs = table([*enumerate(texts), (50, "w1 w2 unknown w1 w2"), (51, None), (52, " ")])
    monkeypatch.setattr(ngram_quality, "SLICE_WORDS", 60_000, raising=False)
    monkeypatch.setattr(ngram_quality, "GROUP_BYTES", 400_000, raising=False)
    before = used()
    model = ngram_quality.fit(docs, docs.where("doc_id < 30").select("doc_id"))
    split = [["", "", *t.split()] for t in texts[:30]]
    grams = len({g for w in split for g in zip(w, w[1:], w[2:], strict=False)} | {g for w in split for g in itertools.pairwise(w)})
    assert used() - before < 20 * grams
    after_fit = used()
    got = {r["doc_id"]: r["log_probability"] for r in ngram_quality.scored(docs, model).collect()}
    assert used() - after_fit < 100_000
    plain = kneser_ney(texts[:30])
    for i in (0, 29, 35):
        assert got[i] == pytest.approx(plain(texts[i]), rel=1e-6)
    assert got[50] == pytest.approx(plain("w1 w2 unknown w1 w2"), rel=1e-6)
    assert got[51] == got[52] == 0 and len(got) == 43


def test_distinct_ngrams_of_a_chunk_cost_little_more_than_a_sort(monkeypatch):
    """A fraction of the CPU time that hashing them takes (np.unique() without counts or places)."""
    task = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(ngram_quality, "TaskContext", task)
    asked = ngram_quality._asked(SimpleNamespace(mapInArrow=lambda f, _: f), 7)
    rng = np.random.default_rng(5)
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(map(str, rng.integers(0, 1 << 20, 5000))) for _ in range(50)]})

    def cpu(run):
        times = []
        for _ in range(3):
            began = time.thread_time()
            run()
            times.append(time.thread_time() - began)
        return min(times)

    ((_, first, hashes),) = ngram_quality._chunks(iter([batch]), [], 1 << 20)
    keys = ngram_quality._keys(hashes, first)
    sort, chunk = cpu(lambda: np.sort(keys)), cpu(lambda: list(ngram_quality._chunks(iter([batch]), [], 1 << 20)))
    assert cpu(lambda: list(asked(iter([batch])))) < 2 * chunk + 8 * sort
    rows = pa.Table.from_batches(asked(iter([batch])))
    got = np.concatenate([ngram_quality._unpacked_keys(x) for x in rows["keys"].to_pylist()])
    assert got.tolist() == sorted(set(keys.tolist()))


def test_order_of_keys_that_differ_in_low_bits_only():
    rng = np.random.default_rng(6)
    leading = rng.integers(0, 1 << 63, 3000).astype(np.uint64) & ~np.uint64((1 << 20) - 1)
    few = np.concatenate([leading, leading[:100] | np.uint64(5), leading[:100] | np.uint64(2), leading[:50]])
    many = rng.integers(0, 1 << 12, 5000).astype(np.uint64)
    for keys in (rng.permutation(few), many, many[:1], many[:0]):
        assert (keys[ngram_quality._order(keys)] == np.sort(keys)).all()
        known, number = ngram_quality._numbered(keys)
        assert known.tolist() == sorted(set(keys.tolist())) and (known[number] == keys).all()
        for packed in (keys, keys >> np.uint64(40), np.zeros(3, np.uint64)):
            assert (ngram_quality._unpacked(ngram_quality._packed(packed)) == packed).all()
        assert (ngram_quality._unpacked_keys(ngram_quality._packed_keys(known)) == known).all()
