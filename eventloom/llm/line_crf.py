"""Document quality by line labelling: a linear-chain CRF marks each line as content or boilerplate.

The weights of a two-state chain are fitted by gradient ascent on the likelihood of a bounded sample of labelled
documents. Each of their lines is labelled by itself: as boilerplate if its pattern of features is commoner among the
lines of documents labelled 0 than among those of documents labelled 1, or if the line recurs in the sample behind
RECURS different lines, as parts of a page do and lines of copied documents don't; as content otherwise. Viterbi
decoding then labels every line of every document; a document whose content lines hold LEAST_CONTENT or more of its
word characters is retained.

Base counts (see measure) fail a document first: fewer than 50 words, or more than half of the words in repeated
three-word windows. Null and empty texts have no words and fail. Without labelled rows all lines are content. Repeated
rows are judged alike; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import shuffled
from .textblocks import SEPARATOR, Block, Words, blocks, count_in, exact_ids, exact_windows, lines, range_hashes, repeats_earlier, word_hashes, words

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
LEAST_CONTENT = 0.5
SAMPLE_DOCS = 1500
SAMPLE_LINES = 200
RECURS = 3
# fixed cue words of licence, navigation and consent lines
CUES = ("copyright", "licensed", "license", "reserved", "cookies", "cookie", "privacy", "subscribe", "login", "sitemap", "click", "terms")
_CUES = np.sort(range_hashes(np.frombuffer("".join(CUES).encode(), np.uint8), np.cumsum([0, *map(len, CUES)])[:-1], np.cumsum([0, *map(len, CUES)])[1:]))
CONTENT, BOILERPLATE = 0, 1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_CONTINUED = np.zeros(256, bool)
_CONTINUED[0x80:0xC0] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"')")] = True


def _strip(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """ends moved back over trailing bytes of a set."""
    ends = ends.copy()
    while True:
        move = (ends > starts) & marks[data[np.maximum(ends - 1, 0)]] if len(data) else np.zeros(len(ends), bool)
        if not move.any():
            return ends
        ends[move] -= 1


def _features(block: Block, w: Words, hashes: np.ndarray, ls: Words, line_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0/1 features for each line, and each line's count of word characters."""
    data = block.data
    size = np.maximum(ls.ends - ls.starts, 1)
    share = lambda mask: count_in(mask, ls.starts, ls.ends) / size
    letters, upper, marks, symbols = share(_LETTER[data]), share(_UPPER[data]), share(_MARK[data]), share(_SYMBOL[data])
    owner = np.repeat(np.arange(len(ls.first) - 1), np.diff(ls.first))
    first_word, last_word = np.searchsorted(w.starts, ls.starts), np.searchsorted(w.starts, ls.ends)
    n_words = last_word - first_word
    in_words = count_in(~SEPARATOR[data] & ~_CONTINUED[data], ls.starts, ls.ends)
    ends = _strip(data, ls.ends, ls.starts, SEPARATOR)
    stopped = (ends > ls.starts) & _STOP[data[np.maximum(ends - 1, 0)]] if len(data) else np.zeros(len(ends), bool)
    cue = np.isin(hashes, _CUES)
    cued = np.concatenate([[0], np.cumsum(cue)])
    line_of = np.repeat(np.arange(len(ls.starts)), n_words)
    again = repeats_earlier(line_of, hashes)
    repeated = np.concatenate([[0], np.cumsum(again)])
    repeat_share = (repeated[last_word] - repeated[first_word]) / np.maximum(n_words, 1)
    mean_length = in_words / np.maximum(n_words, 1)
    return np.stack(
        [
            np.ones(len(size)),
            n_words == 0,
            (n_words > 0) & (n_words < 4),
            n_words >= 12,
            stopped,
            letters < 0.6,
            letters >= 0.75,
            upper > 0.3,
            marks > 0.15,
            symbols > 0.05,
            symbols > 0.15,
            repeats_earlier(owner, line_keys) & (n_words > 0),
            cued[last_word] > cued[first_word],
            repeat_share > 0.7,
            mean_length > 12,
        ],
        axis=1,
    ).astype(np.float64), in_words


N_FEATURES = 15


@dataclass
class ChainModel:
    """Scores of a two-state chain: emit (features, states), move (from, to) and start."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi: the best state of each line, given (lines, 2) emission scores."""
        (m00, m01), (m10, m11) = self.move.tolist()
        rows = scores.tolist()
        a, b = rows[0][0] + self.start[0], rows[0][1] + self.start[1]
        back = []
        for e0, e1 in rows[1:]:
            from_0, from_1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from_0, from_1))
            a, b = (b + m10 if from_0 else a + m00) + e0, (b + m11 if from_1 else a + m01) + e1
        states, now = [0] * len(rows), int(b > a)
        for i in range(len(rows) - 1, -1, -1):
            states[i] = now
            if i:
                now = int(back[i - 1][now])
        return np.array(states)


def train(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 150, rate: float = 0.5, penalty: float = 1e-3) -> ChainModel:
    """Maximum likelihood by gradient ascent; forward and backward passes run over all sequences at once."""
    model = ChainModel(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    if not sequences:
        return model
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    seqs, tags = [sequences[i] for i in order], [labels[i] for i in order]
    longest = len(seqs[0])
    x = np.zeros((len(seqs), longest, N_FEATURES))
    y = np.zeros((len(seqs), longest), int)
    on = np.zeros((len(seqs), longest), bool)
    for i, (s, t) in enumerate(zip(seqs, tags, strict=True)):
        x[i, : len(s)], y[i, : len(s)], on[i, : len(s)] = s, t, True
    live = on.sum(0)
    one_hot = np.eye(2)[y] * on[:, :, None]
    pairs = np.einsum("nta,ntb->ab", one_hot[:, :-1] * on[:, 1:, None], one_hot[:, 1:]) if longest > 1 else np.zeros((2, 2))
    observed = np.einsum("ntf,nts->fs", x, one_hot)
    total = on.sum()
    lse = lambda v, axis: v.max(axis) + np.log(np.exp(v - v.max(axis, keepdims=True)).sum(axis))
    for _ in range(steps):
        scores = x @ model.emit
        alpha, beta = np.zeros((len(seqs), longest, 2)), np.zeros((len(seqs), longest, 2))
        alpha[:, 0] = scores[:, 0] + model.start
        for t in range(1, longest):
            n = live[t]
            alpha[:n, t] = scores[:n, t] + lse(alpha[:n, t - 1, :, None] + model.move, 1)
        for t in range(longest - 2, -1, -1):
            n = live[t + 1]
            beta[:n, t] = lse(model.move + (scores[:n, t + 1] + beta[:n, t + 1])[:, None, :], 2)
        last = on.sum(1) - 1
        z = lse(alpha[np.arange(len(seqs)), last], 1)
        post = np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
        joint = np.exp(alpha[:, :-1, :, None] + model.move + (scores + beta)[:, 1:, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        model.emit += rate * ((observed - np.einsum("ntf,nts->fs", x, post)) / total - penalty * model.emit)
        model.move += rate * ((pairs - joint.sum((0, 1))) / total - penalty * model.move)
        model.start += rate * ((one_hot[:, 0] - post[:, 0]).sum(0) / len(seqs) - penalty * model.start)
    return model


def _prepared(block: Block) -> tuple[Words, np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words and their exact ids, lines and theirs, the features of the lines and their word characters."""
    w, ls = words(block), lines(block)
    hashes = word_hashes(block, w)
    ids = exact_ids(block.data, w.starts, w.ends, hashes=hashes)
    keys = exact_ids(block.data, ls.starts, ls.ends)
    features, in_words = _features(block, w, hashes, ls, keys)
    return w, ids, ls, keys, features, in_words


def line_labels(codes: list[np.ndarray], keys: list[np.ndarray], quality: list[int], recurs: int = RECURS) -> list[np.ndarray]:
    """The label of each line of some documents, given the lines' patterns and hashes and the documents' labels."""
    if not codes:
        return []
    counts = [len(c) for c in codes]
    code, key, good = np.concatenate(codes), np.concatenate(keys), np.repeat(np.array(quality) == 1, counts)
    before = np.concatenate([np.append(np.zeros(1, key.dtype), k[:-1]) for k in keys])
    patterns, which = np.unique(code, return_inverse=True)
    in_good, in_bad = (np.bincount(which[x], minlength=len(patterns)) + 0.5 for x in (good, ~good))
    worse = in_bad / (in_bad.sum() or 1) > in_good / (in_good.sum() or 1) if (~good).any() else np.zeros(len(patterns), bool)
    follows = np.unique(np.stack([key, before]), axis=1)[0]
    line, behind = np.unique(follows, return_counts=True)
    recurring = np.isin(key, line[behind >= recurs]) & (code >> 1 & 1 == 0)  # not lines without a word
    labels = np.where(worse[which] | recurring, BOILERPLATE, CONTENT)
    return np.split(labels, np.cumsum(counts)[:-1])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> ChainModel:
    """Fits on about sample_docs documents of each label, picked by a hash of the doc_id, that have at most
    sample_lines lines. labels: (doc_id, quality)."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 1, min(1.0, sample_docs / max(1, counts.get(1, 1)))).otherwise(min(1.0, sample_docs / max(1, counts.get(0, 1))))
    picked = marked.where(shuffled("doc_id", seed=5) < share * float(2**63))
    rows = docs.select("doc_id", F.col("text").cast("string")).where("text is not null").join(F.broadcast(picked), "doc_id")  # about 2 * sample_docs ids

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                _, _, ls, _, features, _ = _prepared(block)
                codes = (features.astype(np.int64) << np.arange(N_FEATURES)).sum(1)
                keys = range_hashes(block.data, ls.starts, ls.ends).view(np.int64)
                part = lambda x, ls=ls: [x[lo:hi].tolist() for lo, hi in zip(ls.first[:-1], ls.first[1:], strict=True)]
                rows = slice(block.first, block.last)
                out = pa.table({"doc_id": batch.column("doc_id")[rows], "quality": batch.column("quality")[rows], "codes": pa.array(part(codes), pa.list_(pa.int64())), "keys": pa.array(part(keys), pa.list_(pa.int64()))})
                yield from out.filter(pa.array(np.diff(ls.first) <= sample_lines)).combine_chunks().to_batches()

    sample = rows.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(sequences, "doc_id long, quality int, codes array<long>, keys array<long>").orderBy("doc_id", "codes").toArrow()
    codes, keys = ([np.array(x) for x in sample[c].to_pylist()] for c in ("codes", "keys"))
    return train([(c[:, None] >> np.arange(N_FEATURES) & 1).astype(float) for c in codes], line_labels(codes, keys, sample["quality"].to_pylist()))


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_content_lines long, n_lines long"


def judge(docs: DataFrame, model: ChainModel) -> DataFrame:
    """The base counts, the share of word characters in content lines and the verdict, for each row of docs.

    word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_dup_lines: lines with a word that equal an
    earlier line; n_repeat_words: words in three-word windows that the text has twice or more, the first included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for block in blocks(batch.column("text")):
                w, ids, ls, keys, features, in_words = _prepared(block)
                data, texts = block.data, len(block.offsets) - 1
                n_words = np.diff(w.first)
                chars = count_in(~SEPARATOR[data] & ~_CONTINUED[data], block.offsets[:-1], block.offsets[1:])
                symbols = count_in(_SYMBOL[data], block.offsets[:-1], block.offsets[1:])
                owner = np.repeat(np.arange(texts), np.diff(ls.first))
                has_word = np.searchsorted(w.starts, ls.ends) > np.searchsorted(w.starts, ls.starts)
                dup = np.bincount(owner[repeats_earlier(owner, keys) & has_word], minlength=texts)
                repeat = _repeat_words(ids, w.first)
                scores = features @ m.emit
                content, n_content = np.zeros(texts), np.zeros(texts, np.int64)
                for i, (lo, hi) in enumerate(zip(ls.first[:-1], ls.first[1:], strict=True)):
                    is_content = m.decode(scores[lo:hi]) == CONTENT
                    n_content[i] = is_content.sum()
                    content[i] = in_words[lo:hi][is_content].sum() / max(1, chars[i])
                failed = (n_words < LEAST_WORDS) | (100 * repeat > MOST_REPEATED_PERCENT * n_words)
                columns = [n_words, chars, symbols, dup, repeat]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.last - block.first),
                        *[pa.array(c.astype(np.int64)) for c in columns],
                        pa.array(failed),
                        pa.array(~failed & (content >= LEAST_CONTENT)),
                        pa.array(content),
                        pa.array(n_content),
                        pa.array(np.diff(ls.first).astype(np.int64)),
                    ],
                    names=[x.split()[0] for x in VERDICT.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measure, VERDICT)


def _repeat_words(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, how many words lie in a three-word window that the text has twice or more."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(ids) < 3:
        return np.zeros(len(counts), np.int64)
    at = np.flatnonzero(owner[:-2] == owner[2:])
    keys = exact_windows(ids, 3)[at] * len(counts) + owner[at]
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    hit = at[times[inverse] > 1]
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[hit + k] = True
    return np.bincount(owner[covered], minlength=len(counts))
