"""Training order, decontamination, line templates, the sieve and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
import tiktoken
from conftest_llm import ODD

from eventloom.llm import decontamination, line_templates, queries, sieve, training_order


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 70_000])
def test_permutation(n):
    got = training_order.permute(np.arange(n), n, key=5)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != training_order.permute(np.arange(n), n, key=6)).mean() > 0.9


def test_shards_round_trip(spark, documents, tmp_path):
    ranks = training_order.read_vocabulary(spark, training_order.VOCABULARY)
    plan = training_order.plan(documents, ranks, key=1, length=64)
    rows = training_order.training_order(plan, records_per_shard=100).collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    assert all((r["shard"], r["record"]) == divmod(r["slot"], 100) for r in rows)
    written = training_order.write_shards(plan, f"file://{tmp_path}/shards", records_per_shard=100)
    assert sum(r["records"] for r in written.collect()) == len(rows)
    again = list(training_order.read_shards(f"file://{tmp_path}/shards", 0, length=64, records_per_shard=100))
    assert [(s, d, k, t.tobytes()) for s, d, k, t in again] == [(r["slot"], r["doc_id"], r["seq_no"], bytes(r["tokens"])) for r in rows]
    resumed = list(training_order.read_shards(f"file://{tmp_path}/shards", 137, length=64, records_per_shard=100))
    assert [r[:3] for r in resumed] == [r[:3] for r in again[137:]]
    coder = tiktoken.Encoding("t", pat_str=training_order.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    parts = {}
    for _, d, k, t in again:
        parts.setdefault(d, {})[k] = t.tolist()
    for d, own in parts.items():
        ids = [x for k in sorted(own) for x in own[k]]
        assert ids[-1] == len(ranks) and coder.decode(ids[:-1]) == text[d]
        assert ids[:-1] == coder.encode_ordinary(text[d])
    # a document's sequences have neighbouring numbers before they are permuted
    number = {int(s): i for i, s in enumerate(training_order.permute(np.arange(len(rows)), len(rows), key=1))}
    numbers = {}
    for r in rows:
        numbers.setdefault(r["doc_id"], []).append(number[r["slot"]] - r["seq_no"])
    assert all(len(set(x)) == 1 for x in numbers.values())


def test_training_order_query(spark, sf, documents):
    """The registered query, against the tokens of each document; the order doesn't depend on the files."""
    got = queries.op1_training_order(spark, sf).collect()
    ranks = training_order.read_vocabulary(spark, training_order.VOCABULARY)
    coder = tiktoken.Encoding("t", pat_str=training_order.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for r in documents.collect():
        ids = np.array([*coder.encode_ordinary(r["text"] or ""), len(ranks)], "<u2") if r["text"] else []
        want |= {(r["doc_id"], k, len(ids[512 * k :][:512]), zlib.crc32(ids[512 * k :][:512].tobytes())) for k in range(-(-len(ids) // 512))}
    assert {(r["doc_id"], r["seq_no"], r["n_tokens"], r["tokens_crc32"]) for r in got} == want and len(got) == len(want)
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert all((r["shard"], r["record"]) == divmod(r["slot"], training_order.RECORDS_PER_SHARD) for r in got)


def test_training_order_is_free_of_the_layout(spark, documents, tmp_path):
    ranks = training_order.read_vocabulary(spark, training_order.VOCABULARY)
    slots = []
    for files in (3, 6):
        documents.repartition(files, "text").write.parquet(f"{tmp_path}/{files}")
        plan = training_order.plan(spark.read.parquet(f"{tmp_path}/{files}"), ranks, key=8, length=128)
        slots.append({(r["doc_id"], r["seq_no"]): r["slot"] for r in training_order.training_order(plan).select("doc_id", "seq_no", "slot").collect()})
    assert slots[0] == slots[1]


def test_training_order_plan_ranges(spark, documents):
    """Tokens are shuffled once, by ranges of whole shards."""
    from pyspark.sql import functions as F

    plan = training_order.plan(documents, {bytes([i]): i for i in range(256)}, key=8, length=64)
    ordered = training_order.training_order(plan, records_per_shard=2000)
    text = ordered._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
    held = ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).orderBy("p").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(held, held[1:], strict=False))


def test_training_order_writes_in_rounds(spark, documents, tmp_path, monkeypatch):
    """Each round shuffles a part of the sequences, and its shuffle files go when it ends; the shards are those of one round."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: files.getAllFiles().mkString("\n").count("shuffle_")
    plan = training_order.plan(documents, {bytes([i]): i for i in range(256)}, key=8, length=64)
    before, parts, materialize = shuffled(), [], training_order.materialize

    def spied(df, name):
        table = materialize(df, name)
        parts.append(sum(r["records"] for r in table.collect()))
        return table

    monkeypatch.setattr(training_order, "materialize", spied)
    monkeypatch.setattr(training_order, "RANGE_BYTES", 1)
    got = []
    for rounds in (4, 1):
        monkeypatch.setattr(training_order, "WRITE_ROUNDS", rounds)
        uri = f"file://{tmp_path}/{rounds}"
        written = training_order.write_shards(plan, uri, records_per_shard=900).collect()
        got.append([(r["shard"], r["records"], r["bytes"], zlib.crc32((tmp_path / str(rounds) / f"{r['shard']:08d}.bin").read_bytes())) for r in sorted(written)])
    assert got[0] == got[1] and sum(r[1] for r in got[0]) == plan.n and len(got[0]) == -(-plan.n // 900) > 8
    assert sum(parts[:4]) == plan.n == parts[4] and len(parts) == 5
    assert max(parts[:4]) < 0.4 * plan.n
    for _ in range(40):
        if shuffled() <= before:
            break
        time.sleep(0.5)
    assert shuffled() <= before


def test_training_order_of_odd_rows(table, spark, tmp_path):
    ranks = {bytes([i]): i for i in range(256)}
    odd = table(ODD).withColumnsRenamed({"lang": "hash", "source": "slot", "n_chars": "part"})
    plan = training_order.plan(odd, ranks, key=3)
    got = training_order.training_order(plan).collect()
    assert {r["doc_id"] for r in got} == {None, 3, 4, 5, 6, 7, 8, 9}
    assert sum(r["n_tokens"] for r in got) == sum(len(t.encode()) + 1 for _, t in ODD if t)
    uri = f"file://{tmp_path}/odd"
    read = training_order.records_of(plan, training_order.write_shards(plan, uri), uri).collect()
    assert sorted((r["slot"], r["doc_id"] or -1, zlib.crc32(r["tokens"])) for r in got) == sorted((r["slot"], r["doc_id"] or -1, r["tokens_crc32"]) for r in read)
    empty = training_order.plan(table([]), ranks, key=3)
    assert training_order.training_order(empty).count() == 0
    uri = f"file://{tmp_path}/none"
    assert training_order.records_of(empty, training_order.write_shards(empty, uri), uri).count() == 0


def test_long_texts_are_cut_where_tokens_part(monkeypatch):
    monkeypatch.setattr(training_order, "PIECE", 50)
    text = "some words, and more: numbers 12 345 and  blanks " * 20
    pieces = list(training_order._pieces(text))
    assert "".join(pieces) == text and len(pieces) > 10
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(training_order.VOCABULARY, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=training_order.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [i for p in pieces for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text)
    assert list(training_order._pieces("x" * 200)) == ["x" * 200]


def plain_words(text):
    return re.findall(r"[^\s]+", text.lower())


def test_decontamination_of_documents(spark, sf, documents):
    """Every item that occurs as a whole is found, and nothing that shares less than half of an item's words in order."""
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r["doc_id"]: set(r["item_ids"] or []) for r in queries.op3_template_decontamination(spark, sf).collect()}
    for r in documents.collect():
        text = r["text"].lower()
        whole = {i for i, t in items.items() if t.lower() in text}
        assert whole <= got[r["doc_id"]]
        grams = {tuple(w) for w in zip(*[plain_words(text)[k:] for k in range(5)], strict=False)}
        for i in got[r["doc_id"]] - whole:
            own = [tuple(w) for w in zip(*[plain_words(items[i])[k:] for k in range(5)], strict=False)]
            assert sum(g in grams for g in own) >= 0.5 * len(own)


ITEM = "When Tom bought 5 apples and 3 pears at the market for 20 dollars in total today."


def test_slots_must_be_consistent(table, spark):
    items = spark.createDataFrame([(9, ITEM), (None, None), (8, "one two"), (None, "what is the capital")], "item_id long, text string")
    docs = [
        (1, f"Intro. {ITEM} More."),
        (2, "We saw: Ann bought 7 apples and 9 pears at the market for 11 euros in total today. ok"),
        (3, "They say Ann bought 7 apples and 7 pears at the market for 11 euros in total today."),
        (4, "Nobody bought apples or pears at any market for 11 euros today."),
        (5, "So what is the capital now?"),
    ]
    got = {r["doc_id"]: r for r in decontamination.contamination(table(docs), items).collect()}
    assert [i for i in got if got[i]["contaminated"]] == [i for i in got if i in (1, 2, 5)]
    assert not got[1]["reparameterised"] and got[2]["reparameterised"]
    clash = table(docs).withColumnsRenamed({"lang": "covered", "source": "item_key"})
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(clash, items).collect()) == [3, 4]


def test_copies_of_few_literals_are_found(table, spark):
    train = "A train travels 60 km in 2 hours, then 90 km in 3 hours. What is its average speed?"
    items = spark.createDataFrame([(1, train), (2, "What is 12 + 7 * 3?"), (3, "quokka"), (4, "blue quagga")], "item_id long, text string")
    docs = [
        (1, f"Solve this. {train} Thanks."),
        (2, "They ask: What is 12 + 7 * 3? Easy."),
        (3, "the quokka sleeps"),
        (4, "a blue quagga"),
        (5, "A train travels 50 km in 4 hours, then 80 km in 5 hours. What is its average speed?"),
        (6, "What is 12 + 8 * 3? And 7?"),
        (7, "quagga, blue"),
    ]
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.contamination(table(docs), items).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [1], 6: None, 7: None}


def plain_words_of(text):
    """(word as it is, template) of each word, by hand."""
    marks = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out, opening = [], True
    number_before = False
    for m in re.finditer("[^\x20\x09-\x0d]+", text):
        bare = m[0].strip(marks)
        if "\n" in text[: m.start()][len(text[: m.start()].rstrip("\x20\t\n\x0b\x0c\r")) :]:
            opening = True
        if bare:
            own = bare.translate(lower)
            number = bool(re.search("[0-9]", bare)) or own in decontamination.NUMBER_WORDS
            kind = "N" if number else "U" if own in decontamination.UNITS and number_before else "P" if bare[0].isupper() and ord(bare[0]) < 0x800 and not opening else None
            out.append((own, kind))
            number_before = number
        opening = m[0][-1] in ".!?:;"
    return out


def plain_items_found(text, items):
    """By hand: the items (name -> text) found in a text."""
    doc, found = plain_words_of(text), set()
    windows = {}
    for size in range(1, 6):
        for p in range(len(doc) - size + 1):
            w = doc[p : p + size]
            windows.setdefault(("own", *(x[0] for x in w)), []).append(p)
            if sum(k is None for _, k in w) >= 3:
                windows.setdefault(("template", *(k or x for x, k in w)), []).append(p)
    for name, item_text in items.items():
        item = plain_words_of(item_text)
        size = min(5, len(item))
        runs, open_ = {}, set()
        for p in range(len(item) - size + 1 if item else 0):
            w = item[p : p + size]
            template = sum(k is None for _, k in w) >= 3
            if template:
                open_ |= set(range(p, p + size))
            hits = {q: set() for q in windows.get(("own", *(x[0] for x in w)), [])}
            for q in windows.get(("template", *(k or x for x, k in w)), []) if template else []:
                hits.setdefault(q, set()).update((x[0], y[0]) for x, y in zip(w, doc[q : q + size], strict=True) if x[1])
            for q, fills in hits.items():
                at, held = runs.setdefault(q - p, (set(), set()))
                at |= set(range(p, p + size))
                held |= fills
        good = [(at, fills) for at, fills in runs.values() if len(fills) == len({x for x, _ in fills}) == len({y for _, y in fills})]
        covered = {i for at, _ in good for i in at}
        changed = any(x != y for _, fills in good for x, y in fills)
        can = max(len(open_), len(item) / 2) if changed else len(item)
        if covered and len(covered) / can >= decontamination.LEAST_COVERED:
            found.add(name)
    return found


def test_decontamination_equals_brute_force(spark, sf, documents):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r["doc_id"]: set(r["item_ids"] or []) for r in queries.op3_template_decontamination(spark, sf).collect()}
    for r in documents.collect():
        assert got[r["doc_id"]] == plain_items_found(r["text"] or "", items), r["doc_id"]


#: Questions with open numbers, names and units, in four languages.
QUESTIONS = [
    "When {0} bought {1} apples and {2} pears at the market, how many pieces of fruit did {0} carry home?",
    "A train leaves the station and travels {1} km in {2} hours without a stop. What is its average speed?",
    "On a sunny morning {0} painted {1} fences and then rested for {2} minutes. How long did the work take in total?",
    "The baker sold {1} loaves before noon and {2} loaves after lunch. How many loaves did the baker sell that day?",
    "Am Montag hat {0} auf dem Markt {1} Birnen und {2} Pflaumen gekauft. Wie viele Früchte sind das zusammen?",
    "Ein Zug fährt ohne Halt {1} Kilometer weit und braucht dafür {2} Stunden. Wie schnell ist er im Mittel?",
    "Au marché ce matin {0} a acheté {1} pommes et {2} poires. Combien de fruits cela fait au total?",
    "Un train parcourt sans arrêt {1} kilomètres et met pour cela {2} heures. Quelle est sa vitesse moyenne?",
    "En el mercado esta mañana {0} compró {1} manzanas y {2} peras. Cuántas frutas son en total?",
    "Un tren recorre sin parar {1} kilómetros y tarda para ello {2} horas. Cuál es su velocidad media?",
]


def test_recall_of_reparameterised_questions(table, spark):
    names = ["Anna", "Élodie", "Ömer", "Łukasz", "Carlos", "Zoë", "Ивана", "Tom"]
    items = spark.createDataFrame([(i, q.format("Maria", 17 + i, 40 + i)) for i, q in enumerate(QUESTIONS)], "item_id long, text string")
    rows, want = [], {}
    for i, q in enumerate(QUESTIONS):
        for k, name in enumerate(names):
            doc_id = 100 * i + k
            rows.append((doc_id, f"Some text goes before it. {q.format(name, 3 + 7 * k + i, 'neun' if k == 0 else 90 + k)} And some comes after."))
            want[doc_id] = [i]
    clean = [(5000 + i, q.format("", "", "").replace("  ", " ").replace(" and ", " or ")[: 40 + i]) for i, q in enumerate(QUESTIONS)]
    got = {r["doc_id"]: r for r in decontamination.contamination(table(rows + clean), items).collect()}
    recall = np.mean([got[d]["item_ids"] == w for d, w in want.items()])
    print("recall of re-parameterised questions", recall)
    assert recall >= 0.9
    assert not any(got[d]["contaminated"] for d, _ in clean)


def test_decontamination_keeps_clashing_columns(table, spark):
    items = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    docs = table([(1, ITEM), (2, "fine"), (None, ITEM), (None, None)]).withColumnsRenamed({"lang": "doc", "source": "row_key", "n_chars": "_found"})
    assert [(r["doc_id"], r["text"]) for r in decontamination.decontaminate(docs, items).orderBy("doc_id").collect()] == [(None, None), (2, "fine")]
    assert sum(r["contaminated"] for r in decontamination.contamination(docs.withColumnsRenamed({"doc": "id"}), items).collect()) == 2


def test_decontamination_of_odd_rows(table, spark):
    items = spark.createDataFrame([(1, ODD[7][1]), (1, ODD[7][1])], "item_id long, text string")
    got = decontamination.contamination(table(ODD), items).collect()
    assert len(got) == len(ODD) and sum(r["contaminated"] for r in got) == 3
    assert decontamination.contamination(table([]), items).count() == 0
    assert decontamination.decontaminate(table(ODD), items.where("false")).count() == len(ODD)


def test_line_templates(table):
    body = lambda i: " ".join(chr(97 + i) * n for n in range(3, 12))
    rows = [(i, f"{body(i)}\nPage {i} of 10 served by node {i * 7}\nCopyright all rights reserved\n\nend {chr(97 + i) * 3}") for i in range(6)]
    out = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(table(rows)).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["n_dropped"] == 0
    for i in range(1, 6):
        assert out[i]["text"] == f"{body(i)}\n\nend {chr(97 + i) * 3}" and (out[i]["n_dropped"], out[i]["n_lines"]) == (2, 5)
    assert {r["n_dropped"] for r in line_templates.drop_recurring_lines(table(rows), keep_first=False).collect()} == {2}
    assert {r["n_dropped"] for r in line_templates.drop_recurring_lines(table(rows), least_docs=7, least_template_docs=7).collect()} == {0}
    copies = [(i, rows[0][1]) for i in range(5)] + [(0, rows[0][1])]
    assert sorted(r["n_dropped"] for r in line_templates.drop_recurring_lines(table(copies)).collect()) == [0, 0, 4, 4, 4, 4]


def plain_recurring(rows, least_docs=2, least_template_docs=3):
    """By hand: the (document, line number) pairs to drop."""
    from eventloom.llm.textblocks import range_hashes

    code = {}

    def hashed(word):
        if word not in code:
            data = np.frombuffer(word.encode(), np.uint8)
            code[word] = int(range_hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0])
        return code[word]

    docs = {}  # masked line -> documents
    places = {}  # masked line -> [(doc, line_no)]
    for doc_id, text in set(rows):
        for k, line in enumerate((text or "").split("\n")):
            masked = tuple("#" if re.search("[0-9]", w) else w for w in re.findall("[^\x20\x09-\x0d]+", line))
            if masked:
                docs.setdefault(masked, set()).add((doc_id, text))
                places.setdefault(masked, []).append(((doc_id, text), k))
    plain = lambda m: [(i, w) for i, w in enumerate(m) if w != "#"]
    groups = {}
    for m in docs:
        if len(m) > 3 and any(i >= 3 for i, _ in plain(m)):
            groups.setdefault((len(m), m[:3]), {})[m] = {x for x in plain(m) if x[0] >= 3}
    lead = lambda m: sum(i < 3 for i, _ in plain(m))
    final = {}
    for split in range(3):
        split_up = {}
        for name, members in groups.items():
            here, lines = {}, {}
            for m, held in members.items():
                for x in held:
                    here[x] = here.get(x, 0) + len(docs[m])
                    lines[x] = lines.get(x, 0) + 1
            everything = sum(len(docs[m]) for m in members)
            for m, held in members.items():
                held = {x for x in held if here[x] >= least_template_docs}
                enough = lambda n, m=m: n and n + lead(m) >= 0.6 * len(plain(m))
                if split < 2:
                    able = [(here[x], -x[0], hashed(x[1]), x) for x in held if lines[x] < len(members)]
                    if enough(len(held)):
                        split_up.setdefault((name, max(able)[3] if able else None), {})[m] = held
                else:
                    constants = frozenset(x for x in held if here[x] >= 0.3 * everything)
                    if enough(len(constants)):
                        final[m] = (name, constants)
        groups = split_up
    of_template = {}
    for m, t in final.items():
        of_template.setdefault(t, set()).update(docs[m])
    gone = {}
    for m in docs:
        t = final.get(m)
        if t is not None and len(of_template[t]) >= least_template_docs:
            gone.setdefault(t, []).extend(places[m])
        elif len(docs[m]) >= least_docs:
            gone.setdefault(m, []).extend(places[m])
    first = [min(x, key=lambda y: (y[0][0] is not None, y[0][0] or 0, y[1])) for x in gone.values()]
    return {y for x in gone.values() for y in x} - set(first)


def check_lines(got, rows):
    want = plain_recurring(rows)
    expected = []
    for doc_id, text in rows:
        kept = [x for k, x in enumerate((text or "").split("\n")) if ((doc_id, text), k) not in want]
        expected.append((doc_id or -1, "\n".join(kept) if text is not None else ""))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted(expected)
    assert sum(r["n_dropped"] for r in got) >= len(want)


def test_line_templates_equal_brute_force(spark, sf, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check_lines(queries.op8_line_templates(spark, sf).collect(), rows)


def test_line_templates_with_variable_words(table):
    names = "ann bob cy dee eve flo gus hal ivy jo".split()
    rows = [(i, f"welcome back to our pages dear {n} please log in\nown words of {n}: {n * 2} {n * 3} {n * 4} {n * 5}\n{i}\n1 2 {i}") for i, n in enumerate(names)]
    four = [f"the same three {' '.join(f'{w}{c}' for w in 'ab cd ef gh ij kl mn'.split())}" for c in "wxyz"]
    rows += [(20 + i, f"{four[i % 4]}\n{names[i % 10]} {i % 3} alone") for i in range(12)]
    rows += [(None, "welcome back to our pages dear null please log in"), (40, "welcome back to their homes dear all please sit down")]
    got = line_templates.drop_recurring_lines(table(rows).withColumnsRenamed({"lang": "gone", "source": "row", "n_chars": "_key"})).collect()
    check_lines(got, rows)
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[3] == "own words of dee: deedee deedeedee deedeedeedee deedeedeedeedee" and text[40] == rows[-1][1]
    assert all(four[i % 4] not in text[20 + i] for i in range(4, 12))
    same = line_templates.drop_recurring_lines(table(rows).withColumnsRenamed({"lang": "_gone", "source": "group", "n_chars": "n_lines"})).collect()
    assert sorted(r["text"] for r in same) == sorted(r["text"] for r in got)


def test_line_templates_of_odd_rows(table):
    out = line_templates.drop_recurring_lines(table(ODD)).collect()
    check_lines(out, ODD)
    assert [r["text"] for r in out if r["doc_id"] == 7] == [""]  # a copy of document 6
    assert line_templates.drop_recurring_lines(table([])).count() == 0


def test_sieve_lets_all_partners_through(spark):
    keys = spark.range(0, 1000, 7)
    words = sieve.build(keys, ["id"], 16)
    got = {r["id"] for r in sieve.keep_possible(spark.range(3000), "id", words).collect()}
    assert set(range(0, 1000, 7)) <= got and len(got) < 400
    assert sieve.keep_possible(spark.range(0), "id", words).count() == 0


def test_pipeline(spark, sf, documents):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language ID", "near-duplicate removal", "benchmark decontamination", "source mixing", "sharding"]
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    out = cp.run(spark, sf).collect()
    assert out[0].asDict().keys() >= {*cp.COLUMNS, "shard", "slot"}
    assert all(rows[r["doc_id"]] == r["text"] for r in out)
    items = [r["text"].lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(t in r["text"].lower() for r in out for t in items)
    assert len({hashlib.md5(r["text"].encode()).digest() for r in out}) == len({r["doc_id"] for r in out})
    by_shard = {}
    for r in out:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_pipeline_of_odd_and_empty_tables(spark, table, sf):
    import corpus_pipeline as cp

    for rows in (ODD, []):
        docs = table(rows)
        for name, stage in cp.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
            assert set(cp.COLUMNS) <= set(docs.columns), name


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_nothing_outside_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for path in (root / "eventloom").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|\.llm\b", path.read_text()), path
