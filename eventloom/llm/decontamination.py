"""Benchmark decontamination by templates: re-parameterised questions are found as well as copies.

Words lose surrounding punctuation and case; numbers, names (capitalised words inside a sentence) and units become
typed placeholders, and their own words the slots. Windows of WINDOW words of documents and items are joined by hash:
every window by its words as they are, so that copies match whatever they are made of, and windows with LEAST_LITERALS
words or more that are no placeholder by their template as well. Matches of one document, item and offset must fill the
slots consistently: one item value becomes one document value and the other way round; offsets that don't are left
out. An item is found if the windows that remain cover LEAST_COVERED or more of the words that can match: all words for
a copy; for another filling those in windows of templates, but half of the item's words at least.

A fixed-size filter of the item windows spares the join the windows that no item has. Null and empty texts match
nothing. Items of fewer words than WINDOW are matched by one window of their length. Rows are told apart by doc_id and
a hash of it and the text, so repeated rows get the same result and a null doc_id is allowed. Repeated or null item_ids count by text.
Empty tables give no match. Other columns of docs pass through decontaminate(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sieve
from .scratch import materialize
from .textblocks import Block, blocks, count_in, mix64, range_hashes, window_hashes, words

WINDOW = 5
LEAST_LITERALS = 3
LEAST_COVERED = 0.8
# fixed values: unit words of English, German, French and Spanish, lower case
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds lb lbs ml l "
    "litre litres liter liters gallon gallons s sec second seconds min minute minutes hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw v volt volts amp amps j kj cal kcal pa kpa bar c f k km/h mph m/s dollar dollars euro euros cent cents usd eur percent "
    "millimeter zentimeter meter kilometer meile meilen gramm kilogramm tonne tonnen pfund sekunde sekunden minute minuten stunde stunden tag tage tagen "
    "woche wochen monat monate monaten jahr jahre jahren grad prozent "
    "millimètre millimètres centimètre centimètres mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes tonne tonnes litre litres "
    "seconde secondes minute minutes heure heures jour jours semaine semaines mois an ans année années degré degrés "
    "milímetro milímetros centímetro centímetros metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos tonelada toneladas litro litros "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados euro euros dólar dólares"
).split()
# fixed values: number words of the same languages
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante soixante cent mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones"
).split()


def _hashes_of(terms: list[str]) -> np.ndarray:
    coded = [t.encode() for t in dict.fromkeys(terms)]
    ends = np.cumsum([0, *map(len, coded)])
    return np.sort(range_hashes(np.frombuffer(b"".join(coded), np.uint8), ends[:-1], ends[1:]))


_OWN = np.uint64(0x4444444444444444)  # apart from templates
_UNITS, _NUMBERS = _hashes_of(UNITS), _hashes_of(NUMBER_WORDS)
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;")] = True
#: Which characters of one or two bytes in UTF-8, by their first two bytes, are capital letters.
_CAPITAL = np.zeros(1 << 16, bool)
for _c in filter(str.isupper, map(chr, range(0x800))):
    _b = _c.encode()
    _CAPITAL[_b[0] << 8 | _b[1] if len(_b) == 2 else slice(_b[0] << 8, (_b[0] + 1) << 8)] = True


def _templates(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hash and own hash of each word that is more than punctuation, and where each text's begin."""
    data, w = block.data, words(block)
    starts, ends = w.starts.copy(), w.ends.copy()
    ended = _END[data[w.ends - 1]] if len(data) else np.zeros(0, bool)
    while len(data) and (move := (starts < ends) & _MARK[data[np.minimum(starts, len(data) - 1)]]).any():
        starts[move] += 1
    while len(data) and (move := (starts < ends) & _MARK[data[np.maximum(ends - 1, 0)]]).any():
        ends[move] -= 1
    opening = np.zeros(len(starts), bool)
    if len(starts):
        opening[1:] = ended[:-1] | (count_in(data == 0x0A, w.ends[:-1], w.starts[1:]) > 0)
        firsts = w.first[:-1]
        opening[firsts[firsts < len(starts)]] = True
    keep = starts < ends
    own = range_hashes(data, starts[keep], ends[keep], lower=True)
    head = data[starts[keep]] if len(data) else np.zeros(0, np.uint8)
    second = data[np.minimum(starts[keep] + 1, max(0, len(data) - 1))] if len(data) else head
    capital = _CAPITAL[head.astype(np.int64) << 8 | second]
    number = (count_in(_DIGIT[data], starts[keep], ends[keep]) > 0) | np.isin(own, _NUMBERS)
    unit = np.isin(own, _UNITS) & np.concatenate([[False], number[:-1]]) if len(own) else np.zeros(0, bool)
    template = own.copy()
    template[capital & ~opening[keep]] = _NAME
    template[unit] = _UNIT
    template[number] = _NUMBER
    first = np.concatenate([[0], np.cumsum(keep)])[w.first]
    return template, own, first


def _window_rows(docs: DataFrame, key: str, sizes: list[int], filters: dict[int, np.ndarray] | None, whole_if_short: bool) -> DataFrame:
    """(doc, key, size, window, pos, n_words, n_open, slots), doc a column of docs, n_open words being in a window of its template, for the windows of each text that may be wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(filters) if filters is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared is not None else None
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            ids = batch.column("doc")
            for block in blocks(batch.column("text")):
                template, own, first = _templates(block)
                literal = ~np.isin(template, [_NUMBER, _NAME, _UNIT])
                counts = np.diff(first)
                owner = np.repeat(np.arange(len(counts)), counts)
                for size in sizes:
                    windows = window_hashes(template, size)
                    if not len(windows):
                        continue
                    starts = np.arange(len(windows))
                    whole = owner[starts] == owner[starts + size - 1]
                    if whole_if_short:
                        whole &= (size == WINDOW) | (counts[owner[starts]] == size)
                    open_ = whole & (count_in(literal, starts, starts + size) >= LEAST_LITERALS)
                    reach = np.zeros(len(template) + 1, np.int64)
                    reach[:-size] += open_
                    reach[size:] -= open_
                    n_open = count_in(np.cumsum(reach)[:-1] > 0, first[:-1], first[1:])
                    for hashes, ok, filled in ((windows, open_.copy(), True), (mix64(window_hashes(own, size) ^ _OWN), whole.copy(), False)):
                        if wanted is not None:
                            ok[ok] = sieve.test(wanted[size], hashes[ok])
                        at = np.flatnonzero(ok)
                        if not len(at):
                            continue
                        slots = [own[p : p + size][~literal[p : p + size]].view(np.int64).tolist() if filled else [] for p in at]
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(block.first + owner[at])),
                                pa.array(keys[block.first + owner[at]]),
                                pa.array(np.full(len(at), size, np.int32)),
                                pa.array(hashes[at].view(np.int64)),
                                pa.array((at - first[owner[at]]).astype(np.int32)),
                                pa.array(counts[owner[at]].astype(np.int32)),
                                pa.array(n_open[owner[at]].astype(np.int32)),
                                pa.array(slots, pa.list_(pa.int64())),
                            ],
                            names=["doc", "key", "size", "window", "pos", "n_words", "n_open", "slots"],
                        )

    schema = "doc long, key long, size int, window long, pos int, n_words int, n_open int, slots array<long>"
    return docs.select("doc", key, F.col("text").cast("string")).mapInArrow(cut, schema)


def find_items(docs: DataFrame, benchmark: DataFrame, least_covered: float = LEAST_COVERED) -> DataFrame:
    """One row a document and item found: doc (its doc_id), row_key (xxhash64 of doc_id and text), item_key (of item_id and text),
    covered (share of the item's words) and reparameterised (some slot differs)."""
    keyed_items = benchmark.where("text is not null").select(F.lit(0).cast("long").alias("doc"), F.xxhash64("item_id", "text").alias("item_key"), "text")
    sizes = list(range(1, WINDOW + 1))
    items = materialize(_window_rows(keyed_items, "item_key", sizes, None, whole_if_short=True).distinct(), "items")
    used = sorted(r["size"] for r in items.select("size").distinct().collect())
    filters = {size: sieve.build(items.where(F.col("size") == size), ["window"], 22) for size in used}
    keyed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    found = _window_rows(keyed, "row_key", used, filters, whole_if_short=False)
    right = items.select("size", "window", F.col("key").alias("item_key"), F.col("pos").alias("item_pos"), F.col("n_words").alias("item_words"), F.col("n_open").alias("item_open"), F.col("slots").alias("item_slots"))
    matched = found.join(right, ["size", "window"]).withColumn("offset", F.col("pos") - F.col("item_pos"))
    fills = F.arrays_zip("item_slots", "slots")
    runs = matched.groupBy("doc", F.col("key").alias("row_key"), "item_key", "item_words", "item_open", "offset").agg(
        F.array_distinct(F.flatten(F.collect_set(fills))).alias("fills"),
        F.collect_set(F.struct("item_pos", "size")).alias("at"),
    )
    of = lambda part: F.transform("fills", lambda x: x[part])
    one_to_one = (F.size("fills") == F.size(F.array_distinct(of("item_slots")))) & (F.size("fills") == F.size(F.array_distinct(of("slots"))))
    words_hit = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("at")), lambda x: F.sequence(x["item_pos"], x["item_pos"] + x["size"] - 1)))))
    changed = F.max(F.exists("fills", lambda x: x["item_slots"] != x["slots"]))
    can_match = F.when(changed, F.greatest("item_open", F.col("item_words") / 2)).otherwise(F.col("item_words"))
    return (
        runs.where(one_to_one)
        .groupBy("doc", "row_key", "item_key", "item_words", "item_open")
        .agg(F.least(F.lit(1.0), words_hit / can_match).alias("covered"), changed.alias("reparameterised"))
        .where(F.col("covered") >= least_covered)
        .drop("item_words", "item_open")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, least_covered: float = LEAST_COVERED) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (sorted, without nulls), covered (of the best item) and reparameterised
    for each row of docs."""
    names = benchmark.where("text is not null").select(F.xxhash64("item_id", "text").alias("item_key"), "item_id").distinct()
    hits = (
        find_items(docs, benchmark, least_covered)
        .join(names, "item_key")
        .groupBy("doc", "row_key")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count_distinct("item_key").alias("n_items"), F.max("covered").alias("covered"), F.max("reparameterised").alias("reparameterised"))
    )
    hits = hits.withColumnRenamed("row_key", "hit_key")
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("row_key"))
    return rows.join(hits, (F.col("row_key") == F.col("hit_key")) & F.col("id").eqNullSafe(F.col("doc")), "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        "item_ids",
        F.coalesce("covered", F.lit(0.0)).alias("covered"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_covered: float = LEAST_COVERED) -> DataFrame:
    """docs without the rows in which an item is found; all columns stay."""
    found = find_items(docs, benchmark, least_covered).select("doc", "row_key").distinct()
    same = (F.xxhash64(docs["doc_id"], docs["text"]) == found["row_key"]) & docs["doc_id"].cast("long").eqNullSafe(found["doc"])
    return docs.join(found, same, "left_anti")
