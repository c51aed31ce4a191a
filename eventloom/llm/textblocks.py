"""Vectorised work on the texts of an Arrow batch: words and their hashes, without a Python loop over words.

A block is a run of rows whose texts hold about BLOCK_BYTES; one longer text is a block by itself. Words are
maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as runs of such characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The lowest 0 to 8 bytes of a 64-bit value.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Rows first to last of a batch; text i is data[offsets[i]:offsets[i + 1]], empty for null."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(texts: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES, together: int = 1) -> Iterator[Block]:
    """The blocks of a column; runs of `together` rows stay in one block."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_valid()), lengths, 0)
    first = 0
    while first < len(lengths):
        last, size = first, 0
        while last < len(lengths) and (last == first or size + lengths[last : last + together].sum() <= block_bytes):
            size += lengths[last : last + together].sum()
            last = min(len(lengths), last + together)
        own = np.concatenate([[0], np.cumsum(lengths[first:last])])
        if own[-1] == offsets[last] - offsets[first]:
            part = data[offsets[first] : offsets[last]]
        else:
            part = np.concatenate([data[offsets[i] : offsets[i] + lengths[i]] for i in range(first, last)])
        yield Block(first, last, part, own)
        first = last


@dataclass
class Words:
    """Words of a block in order; those of text i are first[i] to first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words(block: Block) -> Words:
    data, offsets = block.data, block.offsets
    inside = ~SEPARATOR[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def _pieces(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each range as pieces of eight bytes, the last one filled with zeros: the pieces, the number of each in its range
    and where each range's begin."""
    counts = (lengths + 7) >> 3
    begins = np.cumsum(counts) - counts
    number = np.arange(int(counts.sum())) - np.repeat(begins, counts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = np.repeat(lengths, counts) - 8 * number
    return eight[np.repeat(starts, counts) + 8 * number] & _LOWEST[np.minimum(left, 8)], number, begins


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; with lower, A-Z count as a-z. Empty ranges share one hash.

    The sum, over a range's pieces of eight bytes, of a scrambling of the piece with its number: no two places weigh
    alike, however long the range, and the sum isn't linear in the bytes."""
    lengths = ends - starts
    sums = np.zeros(len(lengths), np.uint64)
    some = lengths > 0
    if some.any():
        values, number, begins = _pieces(_LOWER[data] if lower else data, starts, lengths)
        further = np.flatnonzero(number)
        values[further] ^= mix64(number[further].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums[some] = np.add.reduceat(mix64(values + np.uint64(0x632BE59BD9B4E019)), begins[some])
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, hashes: np.ndarray | None = None) -> np.ndarray:
    """A number below the number of ranges for each range; two are equal if, and only if, the bytes are."""
    if hashes is None:
        hashes = range_hashes(data, starts, ends, lower)
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, like = ends - starts, first[ids]
    folded = _LOWER[data] if lower else data
    same = lengths == lengths[like]
    checked = np.flatnonzero(same & (like != np.arange(len(like))) & (lengths > 0))
    if len(checked):
        mine, _, begins = _pieces(folded, starts[checked], lengths[checked])
        other, _, _ = _pieces(folded, starts[like[checked]], lengths[checked])
        same[checked[np.logical_or.reduceat(mine != other, begins)]] = False
    if same.all():
        return ids
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(folded[a:b].tobytes(), len(known)) for a, b in zip(starts, ends, strict=True)])


def word_hashes(block: Block, w: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z."""
    return range_hashes(block.data, w.starts, w.ends, lower)


def count_in(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each range the mask marks."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[ends] - total[starts]


def lines(block: Block) -> Words:
    """The lines of a block, parted by newlines; every text has one at least. starts, ends and first as of words."""
    breaks = np.flatnonzero(block.data == 0x0A)
    per_text = np.searchsorted(breaks, block.offsets[1:]) - np.searchsorted(breaks, block.offsets[:-1])
    first = np.concatenate([[0], np.cumsum(per_text + 1)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    opens, closes = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    opens[first[:-1]], closes[first[1:] - 1] = True, True
    starts[opens], ends[closes] = block.offsets[:-1], block.offsets[1:]
    starts[~opens], ends[~closes] = breaks + 1, breaks
    return Words(starts, ends, first)


def repeats_earlier(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Marks each key that its owner has had before, in order."""
    order = np.lexsort((keys, owner))
    same = np.zeros(len(keys), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    marked = np.zeros(len(keys), bool)
    marked[order] = same
    return marked


def exact_windows(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of `size` neighbouring exact_ids(): equal for equal runs only."""
    named = ids[: max(0, len(ids) - size + 1)]
    for k in range(1, size):
        named = np.unique(named * (int(ids.max(initial=0)) + 1) + ids[k : k + len(named)], return_inverse=True)[1]
    return named


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size neighbouring values; windows may cross texts, the caller picks those that don't."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix64(total * np.uint64(3) + hashes[k : k + n] + np.uint64(k + 1))
    return total


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes; a shorter text is one shingle, an empty one none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < size:
        return mix64(window_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(window_hashes(hashes, size))
