"""Removal of repeated byte strings by difference-cover suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of a smaller doc_id, or
earlier in the same one. Strings are judged on the input. Three steps, each exact:

1. Every window of LENGTH bytes is owned by the gram of GRAM bytes in it with the least hash (leftmost of equals): equal
   windows have the same owner at the same offset. The windows that one gram occurrence owns are one run. Runs whose
   owner occurs once hold no repeat. Runs equal in all their bytes (compared by 128 bits of hash) are repeats but for
   the earliest one.
2. What is left, the earliest runs of grams with several contexts, goes to a suffix sort. The runs are partitioned by
   gram, and each partition sorts its suffixes by the difference cover {0, 1, 3} modulo 7: sampled suffixes are named by
   7 bytes and then, recursing on pairs of names, by 14, 28 and 56; the names of sampled suffixes and the bytes before
   them order the remaining suffixes, and adjacent equal prefixes of LENGTH bytes are repeats. Any two suffixes have an
   offset below 7 at which both are sampled. A gram with more than HOT contexts is too much for one task: the windows
   of its runs are grouped one by one instead, by 128 bits of hash, with a minimum as the aggregate.
3. Runs of repeated windows become removed spans of each document.

Null texts count as empty. Null doc_ids come last. Rows that share doc_id and text are one document and get the same
result; other rows of one doc_id are ordered by a hash of the text. An empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sieve
from .scratch import bounded_batches, materialize
from .textblocks import BLOCK_BYTES, Block, blocks, mix64

LENGTH = 100
GRAM = 64
HOT = 20_000
SIEVE_BITS = 25
TASK_BYTES = 4 << 20
#: Blocks whose arrays stay in the processor's cache; grams packed, and runs settled, at once.
SMALL_BLOCK = 1 << 16
PACKED = 1 << 21
SETTLED = 1 << 18
_COVER, _PERIOD = (0, 1, 3), 7
_LAST = 2**63 - 1
REPEAT, OPEN, HOT_RUN = 0, 1, 2
RUN = ("gram", "c1", "c2", "doc", "row", "s", "e")

_rng = np.random.default_rng(99)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_FACTOR = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_PLACE_BITS = np.uint64(28)
_PLACE_MASK = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes (a power of two) that start at each place."""
    h, n, k = _LETTER[data], 1, 0
    while n < size:
        h = h[:-n] * _FACTOR[k] + h[n:] if len(h) > n else h[:0]
        n, k = n * 2, k + 1
    return mix64(h)


def _runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, text, first window, last window) of each run of windows with one owner, places within the block."""
    hashes = _gram_hashes(block.data, GRAM)
    span = LENGTH - GRAM + 1
    n = len(block.data) - LENGTH + 1
    if n <= 0:
        return hashes[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = (hashes & ~_PLACE_MASK) | np.arange(len(hashes), dtype=np.uint64)
    wide = 1
    while wide * 2 <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[: n], least[span - wide : span - wide + n])
    owner = (least & _PLACE_MASK).astype(np.int64)
    counts = np.maximum(np.diff(block.offsets) - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.repeat(block.offsets[:-1], counts) + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(at):
        return hashes[:0], at, at, at
    own = owner[at]
    begins = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    ends = np.append(begins[1:], len(at)) - 1
    return hashes[own[begins]], text[begins], at[begins], at[ends]


_BASES = ((_FACTOR[20], _LETTER), (_FACTOR[21], mix64(_LETTER)))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, kept by the process."""
    known = _powers.get(which)
    if known is None or len(known[0]) <= size:
        base = _BASES[which][0]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = max(size, BLOCK_BYTES) + 1
        known = _powers[which] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (base, inverse))
    return known


def _range_fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte range, by prefix sums of two polynomials."""
    out = []
    for which, (_, letters) in enumerate(_BASES):
        power, back = _powers_of(which, len(data))
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(letters[data] * power[: len(data)], out=total[1:])
        out.append(mix64((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _FACTOR[22]))
    return out[0], out[1]


def _keyed(docs: DataFrame) -> DataFrame:
    """row (of doc_id and text), doc (null last) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64("doc_id", text).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), text.alias("text"))


def _grams_twice(keyed: DataFrame) -> DataFrame:
    """(gram): owners that occur more than once. The grams of a batch go out as one packed row for each range of hashes,
    ranges as many as shuffle partitions; a gram that a batch holds several times is packed twice. Each range is sorted."""
    ranges = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.sort(np.concatenate(held))
        keep = np.ones(len(grams), bool)
        keep[2:] = grams[2:] != grams[:-2]  # twice is enough
        grams = grams[keep]
        cuts = [0, *np.searchsorted(grams, bounds).tolist(), len(grams)]
        at = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([grams[cuts[i] : cuts[i + 1]].tobytes() for i in at], pa.binary())], names=["bucket", "grams"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for block in blocks(batch.column("text"), SMALL_BLOCK):
                held.append(_runs(block)[0])
                size += len(held[-1])
                if size > PACKED:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def found() -> pa.RecordBatch:
            grams = np.sort(np.concatenate(held))
            held.clear()
            again = np.flatnonzero(grams[1:] == grams[:-1])
            again = again[np.concatenate([[True], grams[again[1:]] != grams[again[:-1]]])] if len(again) else again
            return pa.RecordBatch.from_arrays([pa.array(grams[again].view(np.int64))], names=["gram"])

        for batch in batches:
            for bucket, grams in zip(batch.column("bucket").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                if held and bucket != last:
                    yield found()
                held.append(np.frombuffer(grams, np.uint64))
                last = bucket
        if held:
            yield found()

    return keyed.select("text").mapInArrow(pack, "bucket int, grams binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(twice, "gram long")


def _run_rows(keyed: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(gram, c1, c2, doc, row, s, e, salt): runs (doc and row tell documents apart) whose gram may occur twice; s and e are
    its windows' first and last start. salt is 0, or another number for a run that repeats one of the same batch, so that
    a gram's many copies needn't come to one task."""
    shared = keyed.sparkSession.sparkContext.broadcast(wanted)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "doc"))
            parts = []
            for block in blocks(batch.column("text"), SMALL_BLOCK):
                grams, text, s, e = _runs(block)
                keep = sieve.test(shared.value, grams)
                grams, text, s, e = grams[keep], text[keep], s[keep], e[keep]
                c1, c2 = _range_fingerprints(block.data, s, e + LENGTH)
                at = block.first + text
                parts.append((grams.view(np.int64), c1.view(np.int64), c2.view(np.int64), doc[at], row[at], s - block.offsets[text], e - block.offsets[text]))
            if parts:
                firsts, others = _told_apart(np.stack([np.concatenate(x) for x in zip(*parts, strict=True)]))
                salt = np.concatenate([np.zeros(firsts.shape[1], np.int64), np.arange(1, others.shape[1] + 1)])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*np.concatenate([firsts, others], axis=1), salt)], names=[*RUN, "salt"])

    return keyed.mapInArrow(cut, ", ".join(f"{c} long" for c in (*RUN, "salt")))


def _told_apart(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs (columns gram, c1, c2, doc, row, s, e), by gram: the earliest of each kind of bytes, once, and the others."""
    gram, c1, c2, doc, row, s, _ = runs
    runs = runs[:, np.lexsort((s, row, doc, c2, c1, gram))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:3, 1:] != runs[:3, :-1]).any(axis=0)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return runs[:, new], runs[:, (runs[3:6] != runs[3:6, first]).any(axis=0)]


def _settled(runs: DataFrame, hot: int) -> DataFrame:
    """(gram, kind, row, doc, s, e) of runs: REPEAT, equal in all bytes to an earlier one; or OPEN, the earliest of its
    bytes, of a gram with several contexts; or HOT_RUN, of one with more than `hot` contexts, where copies may remain.
    What is alone is not returned. Runs are sorted by gram and settled some whole grams at a time; of a gram with more
    runs than that, only the earliest of each context are held, and none once it is hot."""
    most = max(SETTLED, 2 * hot)

    def rows(runs: np.ndarray, kind: int) -> pa.RecordBatch:
        gram, _, _, doc, row, s, e = runs
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(len(gram), kind, np.int8)), *(pa.array(x) for x in (row, doc, s, e))], names=["gram", "kind", "row", "doc", "s", "e"])

    def whole(runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Settles runs that hold all of their grams."""
        runs, others = _told_apart(runs)
        yield rows(others, REPEAT)
        begins = np.flatnonzero(np.concatenate([[True], runs[0][1:] != runs[0][:-1]]))
        n = np.diff(np.append(begins, runs.shape[1]))
        n = np.repeat(n, n)
        yield rows(runs[:, (n > 1) & (n <= hot)], OPEN)
        yield rows(runs[:, (n > 1) & (n > hot)], HOT_RUN)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, is_hot = [], 0, None, False  # is_hot: of the last gram
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in RUN])
            copies = batch.column("salt").to_numpy(zero_copy_only=False) > 0
            if copies.any():
                yield rows(new[:, copies], REPEAT)
                new = new[:, ~copies]
            if not new.shape[1]:
                continue
            if is_hot:
                go_on = int(np.searchsorted(new[0] != last, True))
                firsts, others = _told_apart(new[:, :go_on])
                yield rows(others, REPEAT)
                yield rows(firsts, HOT_RUN)
                new = new[:, go_on:]
                if not new.shape[1]:
                    continue
                is_hot = False
            last = new[0][-1]
            held.append(new)
            size += new.shape[1]
            if size <= most:
                continue
            runs = np.concatenate(held, axis=1)
            begin = int(np.searchsorted(runs[0] == last, True))  # grams come together
            if begin:
                yield from whole(runs[:, :begin])
                runs = runs[:, begin:]
            if runs.shape[1] > most // 2:
                runs, others = _told_apart(runs)
                yield rows(others, REPEAT)
                if runs.shape[1] > hot:
                    yield rows(runs, HOT_RUN)
                    runs, is_hot = runs[:, :0], True
            held, size = [runs], runs.shape[1]
        if size:
            yield from whole(np.concatenate(held, axis=1))

    return runs.repartition("gram", "salt").sortWithinPartitions("gram").mapInArrow(settle, "gram long, kind byte, row long, doc long, s long, e long")


def _segments(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted runs (gram, hot, row, doc, s, e): those columns and `bytes`."""
    by_row = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("gram", "hot", "s", "e")).alias("runs"))  # of one document
    texts = sieve.keep_possible(keyed, "row", sieve.build(by_row, ["row"])).dropDuplicates(["doc", "row"])
    cut = F.struct(
        F.col("x.gram").alias("gram"), F.col("x.hot").alias("hot"), "row", "doc", F.col("x.s").alias("s"), F.col("x.e").alias("e"),
        F.substring(F.col("text").cast("binary"), (F.col("x.s") + 1).cast("int"), (F.col("x.e") - F.col("x.s") + LENGTH).cast("int")).alias("bytes"),
    )
    return texts.join(by_row, ["doc", "row"]).select("row", "doc", "text", F.explode("runs").alias("x")).select(cut.alias("y")).select("y.*")


def _words_at(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes (8 at most) from each place as one number, big end first."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[at + k]
    return out


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal pairs of names get equal names, in sorted order."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def repeated_windows(data: np.ndarray, first: np.ndarray, last: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which windows repeat one of lower order, by a difference cover. data: the bytes of all runs, one after another;
    windows start at first[r] to last[r] of run r; order: a number for each window, in the sequence of the runs."""
    counts = last - first + 1
    windows = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    again = np.zeros(len(windows), bool)
    if not len(windows):
        return again
    padded = np.concatenate([data, np.zeros(2 * LENGTH, np.uint8)])
    sampled = np.flatnonzero(np.isin(np.arange(len(data) + LENGTH) % _PERIOD, _COVER))
    place = np.full(len(padded) + LENGTH, len(sampled) - 1, np.int64)  # past the end: the last one
    place[sampled] = np.arange(len(sampled))
    named = {7: np.unique(_words_at(padded, sampled, 7), return_inverse=True)[1]}
    for size in (7, 14, 28):  # recursing on pairs of names
        named[size * 2] = _names(named[size], named[size][place[sampled + size]])
    named = _names(named[56], named[28][place[sampled + 56]])  # of 84 bytes
    residue = windows % _PERIOD
    for shift in range(_PERIOD):
        mine = np.flatnonzero(np.isin((residue + shift) % _PERIOD, _COVER))
        name = named[place[windows[mine] + shift]]
        several = np.bincount(name)[name] > 1
        mine, name = mine[several], name[several]
        at = windows[mine]
        # with the 84 bytes, the 16 that remain: `shift` before them and 16 - shift behind
        middle = _words_at(padded, at + shift + 84, 8)
        rest = (_words_at(padded, at, shift) << np.uint64(8 * (8 - shift)) if shift else np.uint64(0)) | _words_at(padded, at + shift + 92, 8 - shift)
        rank = np.lexsort((order[mine], rest, middle, name))
        same = (name[rank][1:] == name[rank][:-1]) & (middle[rank][1:] == middle[rank][:-1]) & (rest[rank][1:] == rest[rank][:-1])
        again[mine[rank[1:][same]]] = True
    return again


def _sorted_ranges(segments: DataFrame) -> DataFrame:
    """(doc, row, s, e): repeated windows among the segments, which hold the earliest of each kind; partitioned by gram."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        doc, row, s, e = (table[c].to_numpy() for c in ("doc", "row", "s", "e"))
        lengths = e - s + LENGTH
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        n = e - s + 1
        run = np.repeat(np.arange(len(s)), n)
        start = np.repeat(s - np.cumsum(n) + n, n) + np.arange(len(run))
        order = np.empty(len(run), np.int64)
        order[np.lexsort((start, row[run], doc[run]))] = np.arange(len(run))
        hit = repeated_windows(data, ends - lengths, ends - LENGTH, order)
        return _as_ranges(doc[run][hit], row[run][hit], start[hit], run[hit])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            grams = batch.column("gram").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(grams[1:] != grams[:-1]) + 1).tolist(), len(grams)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and size > TASK_BYTES and grams[a] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += held[-1].column("bytes").nbytes
                last = grams[a]
        if held:
            yield flush(held)

    return segments.repartition("gram").sortWithinPartitions("gram").select("gram", "row", "doc", "s", "e", "bytes").mapInArrow(sort, "doc long, row long, s long, e long")


def _as_ranges(doc: np.ndarray, row: np.ndarray, start: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """Neighbouring windows of one run as one range."""
    new = np.ones(len(start), bool)
    new[1:] = (run[1:] != run[:-1]) | (start[1:] != start[:-1] + 1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(start))[: len(begins)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[begins]), pa.array(row[begins]), pa.array(start[begins]), pa.array(start[ends])], names=["doc", "row", "s", "e"])


def _hot_ranges(segments: DataFrame) -> DataFrame:
    """The same for grams with very many contexts, window by window."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["bytes"], np.uint8)
                a = np.arange(r["e"] - r["s"] + 1)
                w1, w2 = _range_fingerprints(data, a, a + LENGTH)
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(np.full(n, r["doc"])), pa.array(np.full(n, r["row"])), pa.array(r["s"] + a)], names=["w1", "w2", "doc", "row", "s"]
                )

    each = materialize(segments.mapInArrow(spread, "w1 long, w2 long, doc long, row long, s long"), "windows")
    first = each.groupBy("w1", "w2").agg(F.min(F.struct("doc", "row", "s")).alias("first"))
    other = (F.col("doc") != F.col("first.doc")) | (F.col("row") != F.col("first.row")) | (F.col("s") != F.col("first.s"))
    return each.join(first, ["w1", "w2"]).where(other).select("doc", "row", "s", F.col("s").alias("e"))


def repeated_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, row, s, e): windows that start at s to e of a document also start earlier. Documents are told apart by their
    doc_id and a hash of it and the text."""
    keyed = _keyed(docs).where(F.octet_length("text") >= LENGTH)
    runs = _run_rows(keyed, sieve.build(_grams_twice(keyed), ["gram"], SIEVE_BITS))
    settled = materialize(_settled(runs, hot), "settled")
    equal = settled.where(F.col("kind") == REPEAT).select("doc", "row", "s", "e")
    wanted = settled.where(F.col("kind") != REPEAT).select("gram", (F.col("kind") == HOT_RUN).alias("hot"), "doc", "row", "s", "e")
    segments = materialize(_segments(keyed, wanted), "segments")
    found = equal.unionByName(_sorted_ranges(segments.where("not hot")))
    return found.unionByName(_hot_ranges(segments.where("hot")))


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _spans(of: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, from, to): the maximal removed spans of each document, of its ranges of windows."""
    order = np.lexsort((s, of))
    of, s = of[order], s[order]
    shift = of << 40  # so that no document's span reaches the next one's
    reach = np.maximum.accumulate(e[order] + LENGTH + shift)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] + shift[1:] > reach[:-1]
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(s))[: len(begins)] - 1
    return of[begins], s[begins], reach[ends] - shift[ends]


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed, as (from, to)) and kept (the bytes that stay,
    null where nothing goes) for each row of docs."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ranges = repeated_ranges(docs, hot).groupBy("doc", "row").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))  # of one document
    ranges = materialize(ranges, "ranges")
    keyed = docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "row": F.xxhash64("doc_id", "text")})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            ranges = batch.column("ranges")
            each = ranges.flatten()
            s, e = (each.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            of, begin, end = _spans(np.repeat(np.arange(len(texts)), ranges.value_lengths().to_numpy(zero_copy_only=False)), s, e)
            at = np.searchsorted(of, np.arange(len(texts) + 1))
            kept = []
            begins, ends = begin.tolist(), end.tolist()
            for data, i, j in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True):
                kept.append(b"".join(data[a:b] for a, b in zip([0, *ends[i:j]], [*begins[i:j], len(data)], strict=True)))
            n = np.array([len(x) for x in texts], np.int64)
            arrays = [
                batch.column("doc_id"),
                pa.array(n),
                pa.array(n - np.array([len(x) for x in kept], np.int64)),
                pa.array(np.diff(at).astype(np.int64)),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["from", "to"])),
                pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    schema = f"doc_id long, {DIGEST}, spans array<struct<from: long, to: long>>, kept binary"
    may = sieve.build(ranges, ["row"])
    touched = sieve.keep_possible(keyed, "row", may).join(ranges, ["doc", "row"]).select(F.col("doc_id").cast("long"), "text", "ranges").mapInArrow(cut, schema)
    rest = keyed.select("doc", "row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    untouched = rest.join(ranges.select("doc", "row"), ["doc", "row"], "left_anti").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.lit(None).cast("array<struct<from: long, to: long>>").alias("spans"), F.lit(None).cast("binary").alias("kept")
    )
    return touched.unionByName(untouched)
