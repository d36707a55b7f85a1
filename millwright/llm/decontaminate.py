"""Benchmark decontamination by canonical templates.

Texts are read as tokens (runs of letters and digits; case is ignored). Numbers, units behind a number and
names (words with one capital, the first letter, that do not start a sentence) become the typed placeholders
of a template, so a question with other numbers or names has the same template. Windows of WINDOW template
tokens are hashed and joined with those of the benchmark; an item with names has a second form that keeps
them as words, for copies that are all in lower or upper case. A template counts once for each document and item,
however often it occurs. An item is `verbatim` if the document has enough of its windows with the same values;
else, if it has enough of the templates, the values in the slots are compared: it is `reparameterised` if each value of the
item has mostly one value in the document. Only templates that occur once in the item tell which value stands for
which; an item without one (a list of numbers) is found verbatim or not at all.

Document windows meet a Bloom filter of the benchmark's windows before the shuffle. The filter has a fixed
size and only spares work: what passes it is joined by the exact hash, so its false hits cost a little and
change nothing.

Cases: a null or empty text has no windows; a text of any length is read as a whole; repeated rows, and rows that
repeat an id or have none, count as one document (or item) with the windows of all of them; an item or text of fewer than WINDOW tokens has one window, all
of its tokens; an empty table gives an empty result;
other columns of the inputs are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import LOWER, blocks, bloom_filter, in_bloom, materialise, mix, prefix_hash, without

WINDOW, COVERAGE, CONSISTENCY = 5, 0.6, 0.8
SALTS = 16
#: Units that follow a number.
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg ton tons tonne tonnes lb lbs pound pounds oz ounce ounces ml l liter liters litre"
    " litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent usd eur gbp"
    " dollar dollars cent cents euro euros degree degrees mph kmh w kw kwh v hz khz mhz ghz kb mb gb tb"
).split()
_BASE = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n|"]] = True
#: Hashes that stand for the placeholders.
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x6E756D6265720001, 0x756E697400000002, 0x6E616D6500000003))


def _word_hash(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        sums, down = prefix_hash(data, _BASE)
        out.append(mix(sums[-1:] * down[:1])[0])
    return np.array(out, np.uint64)


_UNIT_HASHES = np.sort(_word_hash(UNITS))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes of texts: for each token its value's hash, its template's hash, and the first token of each text (and their number)."""
    low = LOWER[data]
    accent = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3) & (low[1:] != 0x97)  # capital letters of Latin-1
    big = _UPPER[data]
    big[:-1] |= accent
    low[1:][accent] += 0x20
    word, digit = _WORD[data], _DIGIT[data]
    n = len(data)
    if n > 2:  # a point or comma within a number belongs to it
        inner = np.flatnonzero(((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]) + 1
        word[inner] = digit[inner] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | (digit[1:] != digit[:-1])
    inside = at[(at > 0) & (at < n)]
    first[inside] = word[inside]
    start = np.flatnonzero(first)
    gap = np.flatnonzero(~word)
    end = np.append(start[1:], n)
    where = np.searchsorted(gap, start)  # the first byte that is no word after the token's start
    end = np.minimum(end, np.where(where < len(gap), gap[np.minimum(where, len(gap) - 1)], n)) if len(gap) else end
    sums, down = prefix_hash(low, _BASE)
    value = mix((sums[end] - sums[start]) * down[start])
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    owner = np.searchsorted(start, at)
    opens = np.ones(len(start), bool)  # starts a sentence: of a text, or a stop since the last token
    opens[1:] = stops[start[1:]] > stops[end[:-1]]
    opens[owner[:-1][owner[:-1] < len(start)]] = True
    number = digit[start]
    template = value.copy()
    second = np.minimum(start + 1 + (data[start] >= 0x80), n - 1) if n else start
    title = big[start] & (second < end) & ((low[second] == data[second]) & (data[second] >= 97))
    template[title & ~opens & ~number] = NAME
    template[number] = NUMBER
    after = np.setdiff1d(np.flatnonzero(number[:-1]) + 1, owner)
    at_unit = np.searchsorted(_UNIT_HASHES, value[after])
    template[after[_UNIT_HASHES[np.minimum(at_unit, len(_UNIT_HASHES) - 1)] == value[after]]] = UNIT
    return value, template, owner


def windows(template: np.ndarray, owner: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: the hash of its template, its text, and its first token. A text of fewer tokens has one window."""
    n = np.diff(owner)
    size = np.minimum(n, width)
    count = np.where(n > 0, n - size + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + owner[:-1][text]
    h = np.zeros(len(text), np.uint64)
    padded = np.append(template, np.zeros(width, np.uint64))
    for k in range(width):
        h = h * np.uint64(_BASE | 1) + np.where(k < size[text], padded[first + k], np.uint64(k))
    return mix(h), text, first


_SLOTS = "array<struct<pos:int,val:long>>"


def _slots(value: np.ndarray, template: np.ndarray, first: np.ndarray, width: int, last: np.ndarray) -> pa.Array:
    """For each window its slots: position in the window and hash of the value."""
    place = first[:, None] + np.arange(width)
    safe = np.minimum(place, len(template) - 1)
    slot = np.isin(template[safe], (NUMBER, UNIT, NAME)) & (place < last[:, None])
    offsets = np.concatenate([[0], np.cumsum(slot.sum(axis=1))])
    pairs = pa.StructArray.from_arrays(
        [pa.array(np.nonzero(slot)[1].astype(np.int32)), pa.array(value[safe][slot].view(np.int64))], ["pos", "val"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def template_windows(df: DataFrame, id_col: str, text_col: str, width: int = WINDOW, bloom=None, names: bool = True) -> DataFrame:
    """id, first (token), n (windows of the text), h, slots; only windows that may be in the broadcast filter, if there is one.

    names=False: the second form of the texts that have names.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in blocks(batches, "text", 2 << 20):
            value, template, owner = tokens(data, at)
            if not len(value):
                continue
            if not names:
                named = template == NAME
                template = np.where(named, value, template)
            h, text, first = windows(template, owner, width)
            if not names:
                has = np.diff(np.concatenate([[0], np.cumsum(named)])[owner]) > 0
                h, text, first = h[has[text]], text[has[text]], first[has[text]]
            count = np.bincount(text, minlength=len(owner) - 1)
            if bloom is not None:
                may = np.flatnonzero(in_bloom(h, bloom.value))
                h, text, first = h[may], text[may], first[may]
            ids = part.column(0).take(pa.array(text))
            slots = _slots(value, template, first, width, owner[1:][text])
            place = (first - owner[:-1][text]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(place), pa.array(count[text].astype(np.int32)), pa.array(h.view(np.int64)), slots], ["id", "first", "n", "h", "slots"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, first int, n int, h long, slots {_SLOTS}")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY,
) -> DataFrame:
    """doc_id, item_id, coverage, consistency, verdict: one row for each item found in a document.

    coverage: share of the item's different templates that the document has; consistency: share of the slots, by the
    item's value, that hold the value's most frequent counterpart in the document (1 for verbatim ones).
    """
    forms = [template_windows(benchmark, item_col, item_text_col, width, names=n).withColumn("form", F.lit(int(n))) for n in (True, False)]
    items = forms[0].union(forms[1]).select("id", "form", "h", "slots", F.xxhash64("slots").alias("own"))
    items = materialise(items.withColumnRenamed("id", "item_id").dropDuplicates(["item_id", "form", "h", "own"]), "items")
    bloom = bloom_filter(items.select("h"))
    found = template_windows(docs, id_col, text_col, width, bloom).select(F.col("id").alias("doc_id"), "h", "slots", F.xxhash64("slots").alias("own"))
    found = materialise(found.dropDuplicates(["doc_id", "h", "own"]), "windows")
    # a window of an item is told by its template, and by its template and values; either is counted once in a document
    each = items.groupBy("item_id", "form", "h").agg(F.count("*").alias("values"), F.first("slots").alias("item_slots"), F.collect_list("own").alias("owns"))
    each = materialise(each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "templates")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    owns = found.groupBy("doc_id", "h").agg(F.collect_list("own").alias("found_owns")).select("doc_id", "h", "found_owns", salt)  # bounded by the text
    met = owns.join(each.select("item_id", "form", "h", "owns", "salt"), ["h", "salt"])
    met = met.groupBy("doc_id", "item_id", "form").agg(F.count("*").alias("shared"), F.sum(F.size(F.array_intersect("owns", "found_owns"))).alias("equal"))
    sizes = items.groupBy("item_id", "form").agg(F.count_distinct("h").alias("different"), F.count("*").alias("windows")).withColumnsRenamed({"item_id": "i", "form": "f"})
    met = met.join(sizes, met["item_id"].eqNullSafe(sizes["i"]) & (F.col("form") == F.col("f"))).drop("i", "f")
    met = met.withColumn("coverage", F.col("shared") / F.col("different")).filter(F.col("coverage") >= coverage)
    met = met.withColumn("verbatim", F.col("equal") / F.col("windows") >= coverage)
    best = met.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "verbatim", "form")).alias("best"), F.max("verbatim").alias("verbatim"))
    best = materialise(best.select("doc_id", "item_id", "best.coverage", "best.form", "verbatim"), "share")
    # slots of the others: only windows whose template occurs once in the item say which value stands for which
    open_ = best.filter("not verbatim").select("doc_id", F.col("item_id").alias("i"), F.col("form").alias("f"))
    once = each.filter("values = 1 and salt = 0").select(F.col("item_id").alias("j"), F.col("form").alias("g"), "h", "item_slots")
    asked = open_.join(once, F.col("i").eqNullSafe(F.col("j")) & (F.col("f") == F.col("g"))).drop("j", "g").withColumnRenamed("doc_id", "d").withColumnRenamed("h", "k")
    pairs = asked.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("h"))).select("d", "i", F.explode(F.arrays_zip("slots", "item_slots")).alias("s"))
    pairs = pairs.groupBy("d", "i", F.col("s.item_slots.val").alias("mine"), F.col("s.slots.val").alias("other")).agg(F.count("*").alias("n"))
    slots = pairs.groupBy("d", "i", "mine").agg(F.max("n").alias("top"), F.sum("n").alias("n")).groupBy("d", "i").agg((F.sum("top") / F.sum("n")).alias("consistency"))
    out = best.join(slots, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left")
    out = out.withColumn("consistency", F.when(F.col("verbatim"), F.lit(1.0)).otherwise(F.coalesce("consistency", F.lit(0.0))))
    out = out.filter(F.col("consistency") >= consistency).withColumn("verdict", F.when(F.col("verbatim"), "verbatim").otherwise("reparameterised"))
    return out.select("doc_id", "item_id", "coverage", "consistency", "verdict")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no benchmark item was found."""
    found = contaminated(docs, benchmark, id_col, text_col, **options)
    return without(docs, id_col, found.select(F.col("doc_id").alias(id_col)))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE_SQL: dict[str, str] = {}
