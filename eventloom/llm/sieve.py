"""A Bloom filter of fixed size that spares a join most of the rows that have no partner.

The filter's size is a parameter and does not grow with the data. A full filter lets more rows through; the join
that follows decides, so results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import mix64

LOG_BITS = 24
_SALTS = (np.uint64(0), np.uint64(0x9E3779B97F4A7C15))


def places(keys: np.ndarray, log_bits: int = LOG_BITS) -> list[np.ndarray]:
    return [mix64(keys.view(np.uint64) + salt) >> np.uint64(64 - log_bits) for salt in _SALTS]


def build(keys: DataFrame, columns: list[str], log_bits: int = LOG_BITS) -> np.ndarray:
    """The filter of all values in some long columns, as 2 ** log_bits bits. Executors set bits, the driver gets the
    finished words."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (log_bits - 6), np.uint64)
        for batch in batches:
            for column in batch.columns:
                for at in places(column.drop_null().to_numpy(zero_copy_only=False), log_bits):
                    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["at", "bits"])

    rows = keys.select(*[F.col(c).cast("long") for c in columns]).mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    table = rows.toArrow()
    words = np.zeros(1 << (log_bits - 6), np.uint64)
    words[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return words


def test(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    log_bits = int(len(words)).bit_length() - 1 + 6
    passed = np.ones(len(keys), bool)
    for at in places(keys, log_bits):
        passed &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return passed


def keep_possible(df: DataFrame, column: str, words: np.ndarray) -> DataFrame:
    """The rows of df whose key may be in the filter; rows with a null key go."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(column)
            passed = np.asarray(keys.is_valid()) & test(shared.value, keys.fill_null(0).to_numpy(zero_copy_only=False))
            if passed.any():
                yield batch.filter(pa.array(passed))

    return df.mapInArrow(pick, df.schema)


