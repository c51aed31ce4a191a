"""Language identification by bit-sliced Bloom filters over byte n-grams.

Slot i of the filter holds one bit per language, so the slots of an n-gram, joined by AND, are the mask of all
languages that contain it; masks are as many 64-bit words wide as the languages need. A text's hits per language are
counted over all its n-grams and corrected for the share of n-grams that the language's filter passes by chance; the
language with the most corrected hits wins, and the score is its share of all corrected hits. `known` is the share of
the text's n-grams that are corrected hits of the winner; it doesn't depend on the number of languages.

An n-gram belongs to a language if its rate there is at least MEMBER_RATIO of its highest rate in any language. The
model is fitted on about docs_per_language labelled texts of each language, picked by a hash of the doc_id, and keeps
grams_per_language n-grams of each: 4 MB for every 64 languages.

Texts are lower-cased (A-Z) and set between blanks, so that short ones have n-grams too; bytes of ASCII other than
letters count as blanks. Null texts and texts without a letter are `und` with score and known 0. A text with letters
but without a known n-gram gets the most frequent language with score 0. Without any labelled row all are `und`. Null
labels are not learned from. Repeated rows are scored alike; an empty table gives no rows; other columns are never
read and pass through predict(), where lang_pred, score and known are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import shuffled
from .scratch import quoted
from .textblocks import Block, blocks, mix64

GRAM = 4
DOCS_PER_LANGUAGE = 3000
GRAMS_PER_LANGUAGE = 20_000
MEMBER_RATIO = 0.2
LEAST_COUNT = 3
LOG_SLOTS = 19
HASHES = 3
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(block: Block, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The code of each byte n-gram that lies within one text and the blanks around it, and how many each text has."""
    lengths = np.diff(block.offsets)
    padding = np.where(lengths > 0, size - 1, 0)  # one blank before a text, the others behind it
    offsets = block.offsets + np.concatenate([[0], np.cumsum(padding)])
    folded = np.full(offsets[-1], 0x20, np.uint64)
    folded[np.arange(len(block.data)) + np.repeat((offsets - block.offsets)[:-1] + 1, lengths)] = _FOLD[block.data]
    n = max(0, len(folded) - size + 1)
    codes = np.zeros(n, np.uint64)
    for k in range(size):
        codes |= folded[k : k + n] << np.uint64(8 * k)
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    begins = np.repeat(offsets[:-1], counts)
    inside = begins + np.arange(len(begins)) - np.repeat(np.cumsum(counts) - counts, counts)
    return codes[inside], counts


def _slots(codes: np.ndarray, log_slots: int, hashes: int) -> Iterator[np.ndarray]:
    mixed = mix64(codes)
    step = mix64(mixed + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    for k in range(hashes):
        yield ((mixed + np.uint64(k) * step) >> np.uint64(64 - log_slots)).astype(np.int64)


@dataclass
class LanguageModel:
    """languages[i] has bit i mod 64 of the slots in slots[i div 64]."""

    languages: list[str]
    default: str
    slots: np.ndarray
    log_slots: int = LOG_SLOTS
    hashes: int = HASHES

    def _bits(self, words: list[np.ndarray], i: int) -> np.ndarray:
        return words[i // 64] >> np.uint64(i % 64) & np.uint64(1)

    def chance(self) -> np.ndarray:
        """Per language, the share of absent n-grams that its filter passes."""
        filled = [np.count_nonzero(self._bits(list(self.slots), i)) / self.slots.shape[1] for i in range(len(self.languages))]
        return np.array(filled) ** self.hashes

    def corrected_hits(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages): hits beyond those expected by chance; and each text's number of n-grams."""
        codes, counts = grams(block)
        places = list(_slots(codes, self.log_slots, self.hashes))
        masks = [reduce(np.bitwise_and, [word[at] for at in places]) for word in self.slots]
        ends = np.cumsum(counts)
        chance = self.chance()
        found = np.zeros((len(counts), len(self.languages)))
        for i in range(len(self.languages)):
            total = np.concatenate([[0], np.cumsum(self._bits(masks, i).astype(np.int64))])
            hits = total[ends] - total[ends - counts]
            found[:, i] = np.maximum(0.0, (hits - counts * chance[i]) / max(1e-9, 1 - chance[i]))
        return found, counts


def _has_letter(block: Block, i: int) -> bool:
    own = block.data[block.offsets[i] : block.offsets[i + 1]]
    folded = own | np.uint8(0x20)
    if bool(((folded >= 97) & (folded <= 122)).any()):
        return True
    return bool((own >= 128).any()) and any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace"))


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, grams_per_language: int = GRAMS_PER_LANGUAGE) -> LanguageModel:
    """Learns from the rows (doc_id, text, lang) with a lang."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row a language
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return LanguageModel([], UNDETERMINED, np.zeros((0, 1 << LOG_SLOTS), np.uint64))
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, docs_per_language / r["count"]))]), F.col("lang"))
    picked = labelled.where(shuffled("doc_id", seed=3) < share * float(2**63))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            for block in blocks(batch.column("text")):
                codes, n = grams(block)
                own = np.repeat(langs[block.first : block.last], n)
                for lang in sorted(set(langs[block.first : block.last])):
                    seen, times = np.unique(codes[own == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(times)], names=["lang", "gram", "n"])

    counted = picked.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["t"] for r in counted.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    per_gram = counted.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("found"))  # an entry a language at most
    total_of = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(totals.get(lang, 1)))])
    rated = per_gram.select("gram", F.transform("found", lambda x: F.struct(x["lang"].alias("lang"), x["n"].alias("n"), (x["n"] / F.element_at(total_of, x["lang"])).alias("rate"))).alias("found"))
    best = F.array_max(F.transform("found", lambda x: x["rate"]))
    members = rated.select("gram", best.alias("best"), F.explode("found").alias("x")).where(f"x.n >= {LEAST_COUNT} and x.rate >= best * {MEMBER_RATIO}")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    chosen = members.select("gram", "x.lang", "x.n").withColumn("rank", rank).where(F.col("rank") <= grams_per_language).select("gram", "lang").toArrow()
    slots = np.zeros((-(-len(languages) // 64), 1 << LOG_SLOTS), np.uint64)
    index = {lang: i for i, lang in enumerate(languages)}
    codes = chosen["gram"].to_numpy().view(np.uint64)
    which = np.array([index[x] for x in chosen["lang"].to_pylist()], dtype=np.int64)
    for at in _slots(codes, LOG_SLOTS, HASHES):
        np.bitwise_or.at(slots, (which // 64, at), np.uint64(1) << (which % 64).astype(np.uint64))
    return LanguageModel(languages, counts[0]["lang"], slots)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and known added (columns of these names in docs are replaced)."""
    added = ["lang_pred", "score", "known"]
    kept = [c for c in docs.columns if c.lower() not in added]
    source = docs.select(*map(quoted, kept))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in added[1:]]])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores, known = [], [], []
            for block in blocks(batch.column("text")):
                hits, n = m.corrected_hits(block) if m.languages else (np.zeros((block.last - block.first, 0)), None)
                for i, row in enumerate(hits):
                    if not m.languages or not _has_letter(block, i):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        known.append(0.0)
                        continue
                    total = float(row.sum())
                    names.append(m.languages[int(row.argmax())] if total > 0 else m.default)
                    scores.append(float(row.max()) / total if total > 0 else 0.0)
                    known.append(float(row.max()) / int(n[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())], names=[*kept, *added])

    return source.mapInArrow(label, schema)
