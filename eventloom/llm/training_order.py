"""Token shards in training order.

Documents become sequences of at most `length` token ids (the last of a document ends with an end-of-text id). They are
numbered 0..n-1 by a hash of doc_id and text and by their place in the document, however the table is split into files
and partitions. A keyed Feistel network over the next even power of two, walked along its cycle until it is below n,
gives each number a slot: a permutation that needs no shuffle and no table.

plan() tokenises into a table under the shared folder and numbers the documents, a few bytes each; the numbers are
written by partition, and tasks that read the table look them up there, so that no join shuffles the tokens.
write_shards() sends every sequence straight to the range partition of its slot: tokens are shuffled once. Ranges are
whole shards. It does so in WRITE_ROUNDS turns of neighbouring ranges, each of which reads the whole table and shuffles
its own sequences, so that the disk holds one turn's shuffle files at a time. Each task writes slots r*k..r*(k+1)-1 to file k as records of one stride, so slot s is at byte
(s mod r) * stride of file s div r, and read_shards() starts at any slot with one seek.

Null and empty texts have no sequence. Null doc_ids stay null (-1 in the files). Repeated rows are separate documents
(equal rows share out their numbers). An empty table gives no rows and no files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import running_total, shuffled
from .scratch import bounded_batches, materialize, shared_uri, shuffles_removed
from .textblocks import mix64

LENGTH = 512
ROUNDS = 6
RECORDS_PER_SHARD = 65_536
RANGE_BYTES = 128 << 20
MOST_RANGES = 50_000
WRITE_ROUNDS = 4
READ_BYTES = 8 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 20


def _pieces(text: str) -> Iterator[str]:
    """Very long texts in pieces, cut before a blank that follows a letter, where the split pattern always parts."""
    at = 0
    while len(text) - at > PIECE:
        end = text.rfind(" ", at + 1, at + PIECE)
        while end > at and not text[end - 1].isalpha():
            end = text.rfind(" ", at + 1, end)
        if end <= at:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def read_vocabulary(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file, by Spark's reader."""
    rows = spark.read.text(path if "://" in path else f"file://{path}").collect()
    return {base64.b64decode(a): int(b) for a, b in (r[0].split() for r in rows if r[0].strip())}


def _coder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(coder, text: str) -> np.ndarray:
    parts = [coder.encode_to_numpy(piece) for piece in _pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


@dataclass
class Plan:
    """n sequences in a table, and under `uri`, by partition, the number of each document's first one."""

    table: DataFrame
    n: int
    uri: str
    key: int
    length: int
    vocabulary: int

    @property
    def record(self) -> np.dtype:
        """The layout of a record: token ids are uint16 up to 65,536 ids, uint32 beyond."""
        return np.dtype([("doc_id", "<i8"), ("seq_no", "<i4"), ("n_tokens", "<i4"), ("tokens", _dtype(self.vocabulary), self.length)])


def _dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary < 65_536 else "<u4"


def tokenised(docs: DataFrame, ranks: dict[bytes, int], length: int = LENGTH) -> DataFrame:
    """(part, place, doc_id, hash, of, seq_no, n_tokens, tokens): the sequences of each document; part and place tell
    documents apart, hash tells texts apart, of is the document's number of sequences."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    end_of_text, dtype = len(ranks), np.dtype(_dtype(len(ranks)))
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ["part", "place", "doc_id", "hash", "of", "seq_no", "n_tokens", "tokens"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        part, place = TaskContext.get().partitionId(), 0
        stride = length * dtype.itemsize
        rows: list[list] = [[] for _ in names]
        size = 0
        for batch in batches:
            for doc_id, hash_, text in zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), batch.column("text"), strict=True):
                packed = np.append(_ids(coder, text.as_py()), end_of_text).astype(dtype).tobytes()
                of = -(-len(packed) // stride)
                for k in range(of):
                    chunk = packed[k * stride : (k + 1) * stride]
                    for column, value in zip(rows, (part, place, doc_id, hash_, of, k, len(chunk) // dtype.itemsize, chunk), strict=True):
                        column.append(value)
                place += 1
                size += len(packed)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)
                    rows, size = [[] for _ in names], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)

    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash")).where("text <> ''")
    return source.mapInArrow(encode, "part int, place long, doc_id long, hash long, of int, seq_no int, n_tokens int, tokens binary")


def plan(docs: DataFrame, ranks: dict[bytes, int], key: int, length: int = LENGTH) -> Plan:
    """Tokenises the documents and numbers their sequences."""
    spark = docs.sparkSession
    bounded_batches(spark)
    table = materialize(tokenised(docs, ranks, length), "sequences")
    counted = table.where("seq_no = 0").select("part", "place", "doc_id", "hash", F.col("of").cast("long").alias("n"))
    rows, n = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ordered = counted.withColumns({"order": shuffled("doc_id", "hash", seed=1), "all": F.lit(0)})
    numbered = running_total(ordered, ["all"], "order", ["doc_id", "hash", "part", "place"], "n", rows, "first")
    uri = shared_uri(spark, "numbers")
    with shuffles_removed(spark):
        numbered.select("part", "place", "first").repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(uri)
    return Plan(table, n, uri, key, length, len(ranks))


def _numbers(uri: str, part: int) -> np.ndarray:
    """The first number of each document of a partition, by place."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    files = [x.path for x in store.get_file_info(fs.FileSelector(f"{root}/part={part}")) if x.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(store.open_input_file(x)).read(["place", "first"]) for x in files]).sort_by("place")["first"].to_numpy()


def sequences(plan: Plan, slots: range | None = None) -> DataFrame:
    """(slot, doc_id, seq_no, n_tokens, tokens): tokens as little-endian bytes. Those of some slots, or all."""
    n, key, uri = plan.n, plan.key, plan.uri
    slots = range(n) if slots is None else slots

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            part, place, seq_no = (batch.column(c).to_numpy() for c in ("part", "place", "seq_no"))
            numbers = np.empty(len(part), np.int64)
            here = np.unique(part).tolist()
            known = {p: known[p] if p in known else _numbers(uri, p) for p in here}  # those of this batch alone
            for p in here:
                mine = part == p
                numbers[mine] = known[p][place[mine]] + seq_no[mine]
            slot = permute(numbers, n, key)
            rows = pa.RecordBatch.from_arrays([pa.array(slot), *[batch.column(c) for c in ("doc_id", "seq_no", "n_tokens", "tokens")]], names=["slot", "doc_id", "seq_no", "n_tokens", "tokens"])
            yield rows.filter(pa.array((slot >= slots.start) & (slot < slots.stop)))

    return plan.table.select("part", "place", "doc_id", "seq_no", "n_tokens", "tokens").mapInArrow(placed, "slot long, doc_id long, seq_no int, n_tokens int, tokens binary")


def permute(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each index below n: a Feistel permutation of 0..n-1, walked along its cycle."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def _ranges(plan: Plan, records_per_shard: int) -> tuple[int, int]:
    """How many shards a range partition has, and how many ranges there are.

    Slots are dense, so the ranges need no sample of the data: a partition has shards of RANGE_BYTES together, or more
    where there would be over MOST_RANGES partitions."""
    shards = max(1, -(-plan.n // records_per_shard))
    together = max(1, RANGE_BYTES // (records_per_shard * plan.record.itemsize), -(-shards // MOST_RANGES))
    return together, -(-shards // together)


def training_order(plan: Plan, records_per_shard: int = RECORDS_PER_SHARD, ranges: range | None = None) -> DataFrame:
    """(slot, shard, record, doc_id, seq_no, n_tokens, tokens), range-partitioned by whole shards and sorted by slot; of
    some range partitions, or all."""
    together, count = _ranges(plan, records_per_shard)
    ranges = range(count) if ranges is None else ranges
    slots = range(*(min(plan.n, x * together * records_per_shard) for x in (ranges.start, ranges.stop)))
    shard = F.expr(f"slot div {records_per_shard}")
    ordered = sequences(plan, slots).repartitionById(len(ranges), (shard / together).cast("int") - ranges.start).sortWithinPartitions("slot")
    return ordered.select("slot", shard.alias("shard"), (F.col("slot") % records_per_shard).alias("record"), "doc_id", "seq_no", "n_tokens", "tokens")


def write_shards(plan: Plan, uri: str, records_per_shard: int = RECORDS_PER_SHARD) -> DataFrame:
    """Writes the sequences as one file a shard under uri (a store that pyarrow.fs reaches from every executor), by the
    tasks of the range partitions, and returns (shard, records, bytes). A file gets its name when it is whole. Each of
    WRITE_ROUNDS turns shuffles the sequences of its own ranges."""
    from pyarrow import fs

    record = plan.record

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now, out, count, done = None, None, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{root}/.{now:08d}.{attempt}", f"{root}/{now:08d}.bin")
                done.append((now, count, count * record.itemsize))

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            records = np.zeros(batch.num_rows, record)
            records["doc_id"] = batch.column("doc_id").fill_null(-1).to_numpy()
            records["seq_no"], n = batch.column("seq_no").to_numpy(), batch.column("n_tokens").to_numpy()
            records["n_tokens"] = n
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), record["tokens"].base)
            records["tokens"][np.arange(record["tokens"].shape[0]) < n[:, None]] = tokens
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo < hi and shards[lo] != now:
                    close()
                    now, count = int(shards[lo]), 0
                    out = store.open_output_stream(f"{root}/.{now:08d}.{attempt}")
                if lo < hi:
                    out.write(records[lo:hi].tobytes())
                    count += hi - lo
        close()
        yield pa.RecordBatch.from_pylist([{"shard": s, "records": c, "bytes": b} for s, c, b in done], schema=pa.schema([("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64())]))

    def turn(ranges: range) -> DataFrame:
        rows = training_order(plan, records_per_shard, ranges).select("shard", "doc_id", "seq_no", "n_tokens", "tokens")
        return materialize(rows.mapInArrow(write, "shard long, records long, bytes long"), "written")

    count = _ranges(plan, records_per_shard)[1]
    rounds = min(count, WRITE_ROUNDS)
    return reduce(DataFrame.unionAll, [turn(range(count * k // rounds, count * (k + 1) // rounds)) for k in range(rounds)])


def records_of(plan: Plan, written: DataFrame, uri: str, records_per_shard: int = RECORDS_PER_SHARD) -> DataFrame:
    """(slot, shard, record, doc_id, seq_no, n_tokens, tokens_crc32), read from the files; the checksum is of the
    record's token ids."""
    from pyarrow import fs

    record, together = plan.record, max(1, READ_BYTES // plan.record.itemsize)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                at = 0
                with store.open_input_file(f"{root}/{shard:08d}.bin") as f:
                    while data := f.read(together * record.itemsize):
                        rows = np.frombuffer(data, record)
                        width = record["tokens"].base.itemsize
                        sums = [zlib.crc32(t[: n * width]) for t, n in zip(map(bytes, rows["tokens"]), rows["n_tokens"].tolist(), strict=True)]
                        place = np.arange(at, at + len(rows))
                        at += len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[pa.array(x) for x in (shard * records_per_shard + place, np.full(len(rows), shard), place)],
                                pa.array(rows["doc_id"], mask=rows["doc_id"] == -1),
                                *[pa.array(np.ascontiguousarray(rows[c])) for c in ("seq_no", "n_tokens")],
                                pa.array(sums, pa.int64()),
                            ],
                            names=["slot", "shard", "record", "doc_id", "seq_no", "n_tokens", "tokens_crc32"],
                        )

    return written.select("shard").mapInArrow(read, "slot long, shard long, record long, doc_id long, seq_no int, n_tokens int, tokens_crc32 long")


def read_shards(uri: str, start: int, length: int = LENGTH, itemsize: int = 2, records_per_shard: int = RECORDS_PER_SHARD) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(slot, doc_id, seq_no, token ids) from slot start on, in order."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    record = np.dtype([("doc_id", "<i8"), ("seq_no", "<i4"), ("n_tokens", "<i4"), ("tokens", f"<u{itemsize}", length)])
    slot = start
    while store.get_file_info(name := f"{root}/{slot // records_per_shard:08d}.bin").is_file:
        with store.open_input_file(name) as f:
            f.seek(slot % records_per_shard * record.itemsize)
            while data := f.read(record.itemsize):
                (row,) = np.frombuffer(data, record)
                yield slot, int(row["doc_id"]), int(row["seq_no"]), row["tokens"][: row["n_tokens"]]
                slot += 1
        if slot % records_per_shard:
            return
