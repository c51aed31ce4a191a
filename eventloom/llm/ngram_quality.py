"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

fit() counts the word trigrams of all trusted documents but the held-out ones in Spark. The model is one row of packed
integers for each bucket of n-gram hashes: how often a word, pair or triple stands (lower orders: after how many words),
and what follows it as a context. A triple lies in the bucket of its context, so buckets are counted apart from each
other, a slice of them at a time, and no order is joined to another. scored() takes the documents in groups: each
partition asks for its distinct n-grams, sorted and packed by bucket, the tasks of the buckets answer with the counts, and
the partition derives the probabilities from them. So the disk holds the model, and the questions of one slice or group
at a time; their tables and shuffle files go with each. docs is read twice for each group, and once before.

A document's log probability is averaged with PSEUDO_WORDS words of its language's trusted mean, so short texts are
not judged by a few words. keep() retains documents up to the `quantile` of the perplexity of the held-out trusted
documents (HELD_OUT of them) in their language; languages without one use the quantile over all languages.

Null, empty and blank texts have no words, a null perplexity and are not kept. A null lang is a language of its own.
Null labels are not trusted. Without any trusted row perplexities are null and texts with words are kept. Repeated
rows are scored alike. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sieve
from .ordering import shuffled
from .scratch import dropped, materialize, shared_uri, shuffles_removed
from .textblocks import blocks, mix64, word_hashes, words

HELD_OUT = 0.25
PSEUDO_WORDS = 30
QUANTILE = 0.995
MOST_LOG_SLICES = 3  # the buckets are counted in at most this many rounds, as a power of two
LOG_SLICES_OF_WORDS = 2  # the words, which are few, in a round for so many of these, as a power of two
SLICE_WORDS = 1 << 19  # and each is for so many words of training text at least
MOST_GROUPS = 8  # the documents are scored in at most this many rounds
GROUP_BYTES = 1 << 23  # and each is for so many bytes of text at least
CHUNK_WORDS = 1 << 19  # words of a partition whose n-grams are made distinct together when they are counted
ASKED_WORDS = 1 << 18  # and when they are looked up, which takes more memory
BUCKET_WORDS = 1 << 20  # words of training text for a bucket
LEAST_LOG_BUCKETS, MOST_LOG_BUCKETS = 7, 12
MOST_PENDING = 1 << 21  # n-grams of a bucket that wait to be made distinct
MOST_REPAIRS = 1000  # of an order by leading bits, before all bits are sorted by
_BEGIN = np.uint64(0xB5297A4D3F84D5B5)
_TOP = np.uint64((1 << MOST_LOG_BUCKETS) - 1 << 64 - MOST_LOG_BUCKETS)
_COUNTS = 5  # of a key: its own count, and as a context all of its followers' and how many have 1, 2 and more


@dataclass
class TrigramModel:
    """slices: the folder of each slice of the buckets, with the pairs and triples; words: that of the words' buckets.
    discounts: of words, pairs and triples that count 1, 2 and more; total: the words' counts; unseen: the probability
    of an unseen word."""

    slices: list[str]
    words: str
    log_buckets: int
    log_slices: int
    discounts: list[tuple[float, float, float]]
    total: float
    unseen: float


def _before(values: np.ndarray, first: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The value before each, within its text; a mark where there is none."""
    out = np.roll(values, 1)
    out[first[:-1][np.diff(first) > 0]] = mark
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(3) + mix64(b))


_MARK = np.full(1, _BEGIN)
_MARKS = _pair(_MARK, _MARK)


def _triple(context: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of a pair and the word after it. The leading bits, and so the bucket, are those of the pair."""
    return context & _TOP | mix64(context * np.uint64(5) + c) & ~_TOP


def _packed_planes(planes: np.ndarray) -> bytes:
    """Values as rows of their bytes of equal weight, the lowest first, compressed."""
    return len(planes).to_bytes(1, "little") + planes.shape[1].to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def _unpacked_planes(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    return np.frombuffer(pa.decompress(data[9:], width * size, codec="zstd", asbytes=True), np.uint8).reshape(width, size)


def _packed(values: np.ndarray) -> bytes:
    """64-bit values, compressed byte by byte of equal weight, without the leading bytes that none needs."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return _packed_planes(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)


def _unpacked(data: bytes) -> np.ndarray:
    planes = _unpacked_planes(data)
    if len(planes) == 1:
        return planes[0].astype(np.uint64)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : len(planes)] = planes.T
    return values.view(np.uint64).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the differences."""
    return int(keys[0]).to_bytes(8, "little") + _packed(np.diff(keys)) if len(keys) else b""


def _unpacked_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), _unpacked(data[8:])]), dtype=np.uint64)


def _order(keys: np.ndarray) -> np.ndarray:
    """The places of the keys in their order: one sort of values, the leading bits of each key with its place in the
    low ones, is several times as fast as argsort(). Keys that differ in further bits only are put in order after it."""
    low = np.uint64((1 << max(1, len(keys).bit_length())) - 1)
    marked = keys & ~low | np.arange(len(keys), dtype=np.uint64)
    marked.sort()
    order = (marked & low).astype(np.int64)
    ordered = keys[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(wrong) > MOST_REPAIRS:
        return np.argsort(keys)
    marked &= ~low
    for value in set(marked[wrong].tolist()):
        i, j = np.searchsorted(marked, np.uint64(value)), np.searchsorted(marked, np.uint64(value), "right")
        order[i:j] = order[i:j][np.argsort(keys[order[i:j]])]
    return order


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def _distinct_keys(keys: np.ndarray) -> np.ndarray:
    """As np.unique(), which hashes integers and is slow at many distinct ones."""
    ordered = np.sort(keys)
    return ordered[_begins(ordered)]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the order of all and where the run of each key begins in it."""
    order = _order(keys)
    ordered = keys[order]
    begins = _begins(ordered)
    return ordered[begins], order, begins


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the number of each key among them."""
    known, order, begins = _runs(keys)
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(known)), np.diff(begins, append=len(keys)))
    return known, number


def _slice(keys: np.ndarray, log_buckets: int, log_slices: int) -> np.ndarray:
    return keys >> np.uint64(64 - log_buckets) >> np.uint64(log_buckets - log_slices)


def _bounds(keys: np.ndarray, log_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of the buckets that sorted keys fall into."""
    buckets = keys >> np.uint64(64 - log_buckets)
    edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(keys)]
    return [(int(buckets[i]), i, j) for i, j in zip(edges, edges[1:]) if i < j]


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Runs of rows with about `least` words: some of their columns, where each text's words begin, and the hashes of the
    words."""
    rows, counts, hashes, size = [], [np.zeros(1, np.int64)], [], 0
    for batch in batches:
        for block in blocks(batch.column("text")):
            w = words(block)
            rows.append(batch.select(columns).slice(block.first, block.last - block.first))
            counts.append(np.diff(w.first))
            hashes.append(word_hashes(block, w))
            size += len(hashes[-1])
            if size >= least:
                yield pa.Table.from_batches(rows), np.cumsum(np.concatenate(counts)), np.concatenate(hashes)
                rows, counts, hashes, size = [], [np.zeros(1, np.int64)], [], 0
    if rows:
        yield pa.Table.from_batches(rows), np.cumsum(np.concatenate(counts)), np.concatenate(hashes)


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Those of modified Kneser-Ney, by how many n-grams count 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(max(0.05, min(k - 0.05, x)) for k, x in zip((1, 2, 3), raw, strict=True))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids with a label and none other than 1."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def training_ids(labels: DataFrame, held_out: float = HELD_OUT) -> DataFrame:
    """The trusted doc_ids that the model learns from: all but about held_out of them."""
    return trusted_ids(labels).where(shuffled("doc_id", seed=11) >= held_out * float(2**63))


_TOKENS = "known binary, codes binary, first binary, n long"


def _tokens(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(known, codes, first, n): the words of the documents with the given ids, as places in a chunk's distinct hashes."""
    ids = sieve.build(training, ["doc_id"])
    wanted = sieve.keep_possible(docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id", ids)
    picked = wanted.join(training, "doc_id").select("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, first, hashes in _chunks(batches, [], CHUNK_WORDS):
            if len(hashes):
                known, codes = _numbered(hashes)
                yield pa.RecordBatch.from_pydict({"known": [_packed_keys(known)], "codes": [_packed(codes)], "first": [_packed(first)], "n": [len(hashes)]})

    return picked.mapInArrow(encode, _TOKENS)


def _grams(tokens: DataFrame, part: int, log_buckets: int, log_slices: int) -> DataFrame:
    """(bucket, kind, x, y, z) of the distinct triples of each chunk: kind 0 by the bucket of the context, with the triple,
    the context and the count; kind 1 by that of the last two words, with the triple and these words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _unpacked_keys(row["known"])[_unpacked(row["codes"]).astype(np.int64)]
                first = _unpacked(row["first"]).astype(np.int64)
                b = _before(c, first, _MARK)
                last = _pair(b, c)
                out: dict[str, list] = {"bucket": [], "kind": [], "x": [], "y": [], "z": []}
                context = _before(last, first, _MARKS)
                for kind, pair in enumerate((context, last)):
                    at = np.flatnonzero(_slice(pair, log_buckets, log_slices) == part)
                    triples, order, begins = _runs(_triple(context[at], c[at]))
                    n, at = np.diff(begins, append=len(at)), at[order[begins]]
                    if kind:
                        order = _order(pair[at])
                        at, triples = at[order], triples[order]
                    y, z = (b[at], c[at]) if kind else (pair[at], n)
                    for bucket, i, j in _bounds(pair[at] if kind else triples, log_buckets):
                        for name, value in zip(out, (bucket, kind, *(_packed(v[i:j]) for v in (triples, y, z))), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in "xyz")]))

    return tokens.mapInArrow(emit, "bucket int, kind int, x binary, y binary, z binary")


def _distinct(parts: list[tuple[np.ndarray, ...]], summed: bool) -> tuple[np.ndarray, ...]:
    """The distinct triples of some (triples, y, z), with the y and the sum or one of the z of each."""
    x, y, z = (np.concatenate(v) for v in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64),) * 3
    keys, order, begins = _runs(x)
    one = order[begins]
    return keys, y[one], np.add.reduceat(z[order], begins) if summed and len(keys) else z[one]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sums of each of the rows of counts."""
    known, order, begins = _runs(keys)
    return known, np.add.reduceat(counts[:, order], begins, axis=1) if len(known) else counts


def _as_context(n: np.ndarray) -> np.ndarray:
    return np.stack([np.zeros(len(n)), n, n == 1, n == 2, n > 2])


def _as_own(n: np.ndarray) -> np.ndarray:
    return np.stack([n, *[np.zeros(len(n))] * (_COUNTS - 1)])


_SEEN = [f"seen{k}" for k in range(1, 9)]  # how many triples count 1 to 4, and how many pairs
_MODEL = "bucket int, keys binary, counts binary, " + ", ".join(f"{x} long" for x in _SEEN)


def _model_row(bucket: int, keys: np.ndarray, counts: np.ndarray, seen: list[int]) -> pa.RecordBatch:
    row = [[bucket], [_packed_keys(keys)], [_packed(counts.ravel())], *([x] for x in seen)]
    types = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * len(seen)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=["bucket", "keys", "counts", *_SEEN])


def _counted(grams: DataFrame) -> DataFrame:
    """A model's row for each bucket (grams: whole buckets in a partition, sorted by them), and rows of bucket -1 with the
    counts of the words that they add to."""

    def row(bucket: int, held: list[list[tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
        triples, contexts, n = _distinct(held[0], True)
        _, b, c = _distinct(held[1], False)
        pairs, order, begins = _runs(_pair(b, c))
        at, after = order[begins], np.diff(begins, append=len(order))
        seen = [int((x == k).sum()) for x in (n, after) for k in range(1, 5)]
        yield _model_row(bucket, *_summed(np.concatenate([triples, contexts, pairs]), np.hstack([_as_own(n), _as_context(n), _as_own(after)])), seen)
        yield _model_row(-1, *_summed(np.concatenate([b[at], c[at]]), np.hstack([_as_context(after), _as_own(np.ones(len(at)))])), [0] * 8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size, most = None, [[], []], [0, 0], [MOST_PENDING] * 2
        for batch in batches:
            for bucket, kind, x, y, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last:
                    if last is not None:
                        yield from row(last, held)
                    last, held, size, most = bucket, [[], []], [0, 0], [MOST_PENDING] * 2
                held[kind].append((_unpacked(x), _unpacked(y), _unpacked(z)))
                size[kind] += len(held[kind][-1][0])
                if size[kind] > most[kind]:
                    held[kind] = [_distinct(held[kind], kind == 0)]
                    size[kind] = len(held[kind][0][0])
                    most[kind] = MOST_PENDING + 2 * size[kind]
        if last is not None:
            yield from row(last, held)

    return grams.mapInArrow(count, _MODEL)


def _words_counted(parts: DataFrame, part: int, log_buckets: int, log_slices: int) -> DataFrame:
    """A model's row for each bucket of a slice of the words, from the rows of bucket -1. seen1 to seen4: how many words
    count 1 to 4, seen5: how many count at all, seen6: all counts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, values = _unpacked_keys(packed), _unpacked(counts).reshape(_COUNTS, -1)
                mine = np.flatnonzero(_slice(keys, log_buckets, log_slices) == part)
                keys, values = keys[mine], values[:, mine]
                bounds = _bounds(keys, log_buckets)
                packed_parts = [[_packed_keys(keys[i:j]) for _, i, j in bounds], [_packed(values[:, i:j].ravel()) for _, i, j in bounds]]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in bounds], pa.int32()), *(pa.array(x, pa.binary()) for x in packed_parts)], names=["bucket", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(bucket: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([x for x, _ in held]), np.hstack([x for _, x in held]))
            own = counts[0]
            return _model_row(bucket, keys, counts, [*(int((own == k).sum()) for k in range(1, 5)), int((own > 0).sum()), int(own.sum()), 0, 0])

        last, held = None, []
        for batch in batches:
            for bucket, keys, counts in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "counts")), strict=True):
                if bucket != last and held:
                    yield row(last, held)
                    held = []
                last = bucket
                held.append((_unpacked_keys(keys), _unpacked(counts).reshape(_COUNTS, -1)))
                if len(held) > 1 and sum(len(x) for x, _ in held[1:]) > MOST_PENDING + len(held[0][0]):
                    held = [_summed(np.concatenate([x for x, _ in held]), np.hstack([x for _, x in held]))]
        if held:
            yield row(last, held)

    spread = parts.mapInArrow(split, "bucket int, keys binary, counts binary").repartition(_parts(log_buckets - log_slices), "bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(add, _MODEL)


def _parts(log_buckets: int) -> int:
    """The partitions that so many buckets are dealt to."""
    return max(8, 1 << log_buckets - 3)


def _write(df: DataFrame, uri: str, *columns: str) -> None:
    with shuffles_removed(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").partitionBy(*columns).parquet(uri)


def fit(docs: DataFrame, training: DataFrame) -> TrigramModel | None:
    """The model of all documents with the given ids (distinct)."""
    spark = docs.sparkSession
    token_rows = shared_uri(spark, "tokens")
    _write(_tokens(docs, training), token_rows)
    tokens = spark.read.schema(_TOKENS).parquet(token_rows)
    size = tokens.agg(F.sum("n")).first()[0]
    if not size:
        dropped(spark, token_rows)
        return None
    log_buckets = min(MOST_LOG_BUCKETS, max(LEAST_LOG_BUCKETS, (size // BUCKET_WORDS).bit_length()))
    log_slices = min(MOST_LOG_SLICES, (size // SLICE_WORDS).bit_length())
    slices = []
    for part in range(1 << log_slices):
        slices.append(shared_uri(spark, "model"))
        grams = _grams(tokens, part, log_buckets, log_slices).repartition(_parts(log_buckets - log_slices), "bucket").sortWithinPartitions("bucket")
        _write(_counted(grams), slices[-1], "bucket")
    dropped(spark, token_rows)
    rows = spark.read.schema(_MODEL)
    of_grams = [rows.parquet(x).agg(*(F.sum(c) for c in _SEEN)).first() for x in slices]
    seen = [float(sum(x[i] or 0 for x in of_grams)) for i in range(8)]
    parts = None
    for uri in slices:
        of_slice = rows.parquet(uri).where("bucket = -1").select("keys", "counts")
        parts = of_slice if parts is None else parts.union(of_slice)
    word_rows = shared_uri(spark, "words")
    log_rounds = max(0, log_slices - LOG_SLICES_OF_WORDS)
    for part in range(1 << log_rounds):
        _write(_words_counted(parts, part, log_buckets, log_rounds), word_rows, "bucket")
    for uri in slices:
        dropped(spark, f"{uri}/bucket=-1")
    n1, n2, n3, n4, known, total = (float(x) for x in rows.parquet(word_rows).agg(*(F.sum(c) for c in _SEEN[:6])).first())
    discounts = [_discounts(n1, n2, n3, n4), _discounts(*seen[4:]), _discounts(*seen[:4])]
    d1, d2, d3 = discounts[0]
    held = d1 * n1 + d2 * n2 + d3 * (known - n1 - n2)
    return TrigramModel(slices, word_rows, log_buckets, log_slices, discounts, total, held / total / (known + 1))


def _keys(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The words, pairs and triples of some texts, one after the other, with a last word and pair of marks alone."""
    if not len(c):
        return c
    pair = _pair(_before(c, first, _MARK), c)
    return np.concatenate([c, pair, _triple(_before(pair, first, _MARKS), c), _MARK, _MARKS])


def _places(c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct _keys(), and the places among them of each word, the one before, the pair, the context and the triple."""
    keys, at = _numbered(_keys(c, first))
    n = len(c)
    word, pair, triple = at[:n], at[n : 2 * n], at[2 * n : 3 * n]
    return keys, [word, _before(word, first, at[-2:-1]), pair, _before(pair, first, at[-1:]), triple]


def _checksum(keys: np.ndarray) -> int:
    return int(np.sum(mix64(keys), dtype=np.uint64).view(np.int64))


def _asked(source: DataFrame, log_buckets: int) -> DataFrame:
    """(bucket, part, chunk, checksum, keys) of the distinct n-grams of each chunk of a partition."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for chunk, (_, first, c) in enumerate(_chunks(batches, [], ASKED_WORDS)):
            keys = _distinct_keys(_keys(c, first))
            bounds, checksum = _bounds(keys, log_buckets), _checksum(keys)
            same = [np.full(len(bounds), x) for x in (part, chunk, checksum)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _, _ in bounds], pa.int32()), *(pa.array(x, t) for x, t in zip(same, (pa.int32(), pa.int32(), pa.int64()), strict=True)), pa.array([_packed_keys(keys[i:j]) for _, i, j in bounds], pa.binary())],
                names=["bucket", "part", "chunk", "checksum", "keys"],
            )

    return source.mapInArrow(ask, "bucket int, part int, chunk int, checksum long, keys binary")


def _read(uri: str, folder: str) -> pa.Table | None:
    """The rows in a folder of a table in the shared one, if there are any."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    files = [x.path for x in store.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True)) if x.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(store.open_input_file(x)).read() for x in files]) if files else None


def _answered(asked: DataFrame, model: TrigramModel) -> DataFrame:
    """(bucket, part, chunk, checksum, hits, counts): which of the keys asked the model has, and their counts."""

    def load(bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys in their order, their places and the bytes of the counts by these."""
        tables = [_read(uri, f"bucket={bucket}") for uri in (model.slices[bucket >> model.log_buckets - model.log_slices], model.words)]
        rows = [row for table in tables if table is not None for row in table.select(["keys", "counts"]).to_pylist()]
        keys = np.concatenate([np.zeros(0, np.uint64), *(_unpacked_keys(x["keys"]) for x in rows)])
        parts = [x.reshape(len(x), _COUNTS, -1) for x in (_unpacked_planes(x["counts"]) for x in rows)]
        planes, done = np.zeros((max([1, *map(len, parts)]), _COUNTS, len(keys)), np.uint8), 0
        for x in parts:
            planes[: len(x), :, done : done + x.shape[2]] = x
            done += x.shape[2]
        order = np.argsort(keys, kind="stable")  # merges the tables, which are sorted
        return keys[order], order, planes

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            hits, values = [], []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                if bucket != last:
                    last, (known, order, planes) = bucket, load(bucket)
                keys = _unpacked_keys(packed)
                at = np.searchsorted(known, keys)
                found = np.zeros(len(keys), bool)
                inside = at < len(known)
                found[inside] = known[at[inside]] == keys[inside]
                hits.append(np.packbits(found).tobytes())
                values.append(_packed_planes(planes[:, :, order[at[found]]].reshape(len(planes), -1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hits, pa.binary()), pa.array(values, pa.binary())], names=["bucket", "part", "chunk", "checksum", "hits", "counts"])

    return asked.mapInArrow(answer, "bucket int, part int, chunk int, checksum long, hits binary, counts binary")


def _logs(counts: np.ndarray, at: list[np.ndarray], model: TrigramModel) -> np.ndarray:
    """The logarithm of the probability of each word; counts: of the distinct n-grams, at: as of _places()."""

    times = np.minimum(counts[0], 3).astype(np.int64)
    seen = np.where(counts[1] > 0, counts[1], np.inf)

    def kept(places: np.ndarray, order: int) -> np.ndarray:
        return (counts[0] - np.array([0.0, *model.discounts[order]])[times])[places]

    def over(places: np.ndarray, context: np.ndarray, order: int, lower: np.ndarray) -> np.ndarray:
        left = np.where(counts[1] > 0, (np.array(model.discounts[order]) @ counts[2:]) / seen, 1.0)
        return kept(places, order) / seen[context] + left[context] * lower

    c, b, pair, context, triple = at
    p1 = kept(c, 0) / model.total + model.unseen
    return np.log(over(triple, context, 2, over(pair, b, 1, p1)))


_SCORES = "doc_id long, lang string, n_words long, log_probability double"


def _scores(source: DataFrame, model: TrigramModel | None, uri: str) -> DataFrame:
    """The scores of one group, by the answers in a table."""

    def logs(part: int, first: np.ndarray, c: np.ndarray, answers: list[dict]) -> np.ndarray:
        keys, at = _places(c, first)
        counts = np.zeros((_COUNTS, len(keys)))
        bounds, mine = _bounds(keys, model.log_buckets), {x["bucket"]: x for x in answers}
        if set(mine) != {x for x, _, _ in bounds} or {x["checksum"] for x in answers} != {_checksum(keys)}:
            raise RuntimeError(f"partition {part} has other rows than when its n-grams were looked up")
        for bucket, i, j in bounds:
            hits = np.unpackbits(np.frombuffer(mine[bucket]["hits"], np.uint8), count=j - i)
            counts[:, i + np.flatnonzero(hits)] = _unpacked(mine[bucket]["counts"]).reshape(_COUNTS, -1)
        return _logs(counts, at, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, answers = TaskContext.get().partitionId(), None
        for chunk, (rows, first, c) in enumerate(_chunks(batches, ["doc_id", "lang"], ASKED_WORDS)):
            sums = np.full(rows.num_rows, np.nan)
            if model is not None:
                of_words = np.zeros(0)
                if len(c):
                    answers = _read(uri, f"part={part}") if answers is None else answers
                    mine = answers.take(np.flatnonzero(answers["chunk"].to_numpy() == chunk)).to_pylist() if answers is not None else []
                    of_words = logs(part, first, c, mine)
                to_here = np.concatenate([[0.0], np.cumsum(of_words)])
                sums = to_here[first[1:]] - to_here[first[:-1]]
            yield from rows.append_column("n_words", pa.array(np.diff(first))).append_column("log_probability", pa.array(sums, from_pandas=True)).combine_chunks().to_batches()

    return source.mapInArrow(score, _SCORES)


def scored(docs: DataFrame, model: TrigramModel | None) -> DataFrame:
    """(doc_id, lang, n_words, log_probability) for each row of docs, which must have the same partitions whenever it
    is read; a task that finds other words than at the look-up fails."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    if model is None:
        return _scores(source, None, "")
    path = shared_uri(spark, "scores")
    with shuffles_removed(spark):
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = min(MOST_GROUPS, 1 + size // GROUP_BYTES)
    for group in range(groups):
        some = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(groups)) == group)
        asked = _asked(some, model.log_buckets).repartition(_parts(model.log_buckets), "bucket").sortWithinPartitions("bucket")
        uri = shared_uri(spark, "answers")
        _write(_answered(asked, model).repartition("part"), uri, "part")
        _scores(some, model, uri).write.mode("append").option("compression", "zstd").parquet(path)
        dropped(spark, uri)
    return spark.read.schema(_SCORES).parquet(path)


def keep(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, pseudo_words: int = PSEUDO_WORDS) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept) for each row of docs."""
    training = materialize(training_ids(labels), "training")
    scores = materialize(scored(docs, fit(docs, training)), "scores")
    fresh = trusted_ids(labels).join(training, "doc_id", "left_anti")
    good = scores.join(fresh, "doc_id", "left_semi").where("n_words > 0 and log_probability is not null")
    means = good.groupBy("lang").agg((F.sum("log_probability") / F.sum("n_words")).alias("mean"))
    overall = good.agg(F.sum("log_probability") / F.sum("n_words")).first()[0]
    key = F.coalesce(F.concat(F.lit("k"), "lang"), F.lit("n"))
    means = means.select(key.alias("key"), "mean")
    cost = -(F.col("log_probability") + pseudo_words * F.coalesce("mean", F.lit(overall))) / (F.col("n_words") + pseudo_words)
    shrunk = scores.withColumn("key", key).join(means, "key", "left").withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(cost)))
    shrunk = materialize(shrunk.drop("mean"), "shrunk")
    limits = shrunk.join(fresh, "doc_id", "left_semi").where("perplexity is not null")
    by_lang = limits.groupBy("key").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    fallback = limits.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    judged = shrunk.join(by_lang, "key", "left").withColumn("threshold", F.coalesce("threshold", F.lit(fallback).cast("double")))
    fine = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) & (F.col("n_words") > 0)
    return judged.select("doc_id", "lang", "n_words", "perplexity", "threshold", fine.alias("kept"))
