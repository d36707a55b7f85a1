"""Near-duplicate paragraphs by MinHash banding, exact Jaccard verification and connected components.

Line breaks and punctuation move between copies, so a paragraph is found by its words: it starts at a word whose
shingle has the least hash among REACH words on either side (the first word of a text as well; a stretch of
over 4 * REACH words without such a place is cut evenly) and has PASSAGE words, or what is left of its text if
that is MIN_WORDS or more. Neighbours overlap, so a repeated passage of over 50 words holds a paragraph, or nearly
all of one, wherever it stands in its text. Shingles are SHINGLE successive words (runs of letters and digits,
case ignored).

Paragraphs with the same words are merged first. Each different one has BANDS bands of ROWS minima: few rows a band,
for high recall (at a similarity of 0.8 a pair meets in a band with probability 1 - (1 - 0.8**2)**4 = 0.983,
and a repeated passage mostly has several paragraphs). The members of a band's bucket are joined with
their shingle sets, and a search through the bucket links them: each member is compared with all that are not
yet reached, by an index of the bucket's shingles, so all similar pairs are respected and none is built as a row.
A bucket of over `most` members is dealt out by its members' rarest shingles, of which similar sets share one for certain. What is
still larger (many variants of one passage) is dealt to parts twice at random, which mostly connects all of it; where it
does not, each two parts are compared as a whole. So no link is lost to a bucket's size.
Similarity is the exact Jaccard index of the shingle sets. Components of the links are the groups; the first
paragraph of a group, by document and place, stays.

A group counts if it is in more than one document; what a document repeats only to itself is left to others.

Cases: a null text has no paragraphs, nor has one of fewer than MIN_WORDS words; a text of any length is read as a
whole, by one task; a null id is the smallest one; a document is a pair of id and text, so rows that repeat both are
one document, and rows that repeat an id (or have none) with other texts are several; ties do not occur, since
document and place order all paragraphs but those of repeated rows, one of which stays; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import LOWER, attach_group, blocks, bloom_filter, longs, materialise, may_be_in, mix, powers, prefix_hash, runs, text_bytes, whole_groups
from millwright.llm.components import components

SHINGLE, PASSAGE, MIN_WORDS, REACH, SIMILARITY, BANDS, ROWS = 5, 30, 26, 9, 0.8, 4, 2
SALTS = 64
_MOST = np.uint64((1 << 64) - 1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _seeds(level: int) -> np.ndarray:
    return np.random.default_rng(11 + level).integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of bytes of texts: a hash of each word, the first word of each text (and their number), and the words' starts and ends."""
    low = LOWER[data]
    accent = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3) & (low[1:] != 0x97)  # capital letters of Latin-1
    low[1:][accent] += 0x20
    word = _WORD[low]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inside = at[(at > 0) & (at < len(data))]
    first[inside], last[inside - 1] = word[inside], word[inside - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums, down = prefix_hash(low, 0x9E3779B97F4A7C15)
    return mix((sums[end] - sums[start]) * down[start]), np.searchsorted(start, at), start, end


def shingle_hashes(value: np.ndarray) -> np.ndarray:
    """The hash of the shingle that starts at each word; those that would leave the last text are missing."""
    n = max(0, len(value) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0xD1342543DE82EF95) + value[k : k + n]
    return mix(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of x[i : i + width] for each i."""
    step = 1
    while step * 2 <= width:
        x, step = np.minimum(x[:-step], x[step:]), step * 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def cut(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """First word, number of words and text of each paragraph, the shingles' hashes with a gap behind each text, and each word's place there."""
    text = np.repeat(np.arange(len(owner) - 1), np.diff(owner))
    place = np.arange(len(value)) + text * PASSAGE + PASSAGE
    laid = np.full(len(value) + len(owner) * PASSAGE, _MOST)
    left = owner[1:][text] - np.arange(len(value))  # words from here to the text's end
    h = shingle_hashes(value)
    whole = np.flatnonzero(left >= SHINGLE)
    laid[place[whole]] = h[whole]
    window = _least(laid, REACH)
    here = laid[place]
    start = (here < window[place - REACH]) & (here <= window[place + 1])
    begun = np.concatenate([[0], np.cumsum(start & (left >= MIN_WORDS))])
    opens = owner[:-1][np.diff(owner) > 0]
    opens = opens[begun[np.minimum(opens + 3, owner[1:][text[opens]])] == begun[opens]]  # unless one that is nearly the same starts there
    start[opens] = True
    first = np.flatnonzero(start)
    gap = np.minimum(np.diff(np.append(first, len(value))), left[first])
    more = np.where(gap > 4 * REACH, gap // (2 * REACH) - 1, 0)
    if more.any():
        extra = np.repeat(first, more) + (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1) * 2 * REACH
        first = np.sort(np.concatenate([first, extra]))
    first = first[left[first] >= MIN_WORDS]
    return first, np.minimum(left[first], PASSAGE), text[first], laid, place


def _digests(value: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words of each paragraph."""
    out = []
    for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        up, down = powers(base, len(value))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(base)) * up[: len(value)])])
        out.append(mix((sums[first + size] - sums[first]) * down[first] + size.astype(np.uint64)))
    return out[0], out[1]


def paragraphs(docs: DataFrame) -> DataFrame:
    """id, mark (hash of id and text), start, end (bytes of the text), n_words, hi and lo (128-bit hash of the words), b0 to b3 (bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(0)
        for rows, data, at in blocks(batches, "text", 2 << 20):
            value, owner, starts, ends = words(data, at)
            first, size, text, laid, place = cut(value, owner)
            hi, lo = _digests(value, first, size)
            bands, none = np.zeros((len(first), BANDS), np.uint64), laid == _MOST
            for k, seed in enumerate(seeds):
                mixed = (laid ^ seed) * (seed | np.uint64(1))
                mixed[none] = _MOST
                least = _least(mixed, PASSAGE - SHINGLE + 1)[place[first]] if len(first) else np.zeros(0, np.uint64)
                bands[:, k // ROWS] = mix(bands[:, k // ROWS] + least + np.uint64(k + 1))
            base = at[text]
            columns = [starts[first] - base, ends[first + size - 1] - base, size, hi.view(np.int64), lo.view(np.int64), *bands.view(np.int64).T]
            named = [rows.column(k).take(pa.array(text)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*named, *map(pa.array, columns)], ["id", "mark", "start", "end", "n_words", "hi", "lo", *names])

    names, kind = [f"b{k}" for k in range(BANDS)], docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, mark long, start long, end long, n_words long, hi long, lo long, " + ", ".join(f"{n} long" for n in names))


def _packed(h: np.ndarray) -> bytes:
    """The high 40 bits of the different hashes: two different shingles of a pair of paragraphs agree with probability 1e-9."""
    return np.unique(h >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of all sets, one after the other, and where each set's begin (and the end of the last)."""
    data, at = text_bytes(column)
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, 3:] = data.reshape(-1, 5)
    return out.view("<u8")[:, 0], at // 5


def _with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, p, set (of shingles) for each key of the paragraphs p that wanted (mark, start, hi, p, keys) names; repeated rows repeat them."""
    lists = wanted.groupBy("mark").agg(F.collect_list(F.struct("start", "hi", "p", "keys")).alias("parts"))  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text", 2 << 20):
            value, owner, starts, _ = words(data, at)
            first, size, _, laid, place = cut(value, owner)
            hi, _ = _digests(value, first, size)
            column = rows.column("parts")
            parts, number = column.flatten(), np.diff(column.offsets.to_numpy())
            if not len(first):
                continue
            k = np.searchsorted(starts[first], np.repeat(at[:-1], number) + longs(parts.field("start")))
            k = np.minimum(k, len(first) - 1)
            good = np.flatnonzero(hi.view(np.int64)[k] == longs(parts.field("hi")))
            parts, k = parts.take(pa.array(good)), k[good]
            sets = [_packed(laid[a : a + n]) for a, n in zip(place[first[k]].tolist(), (size[k] - SHINGLE + 1).tolist(), strict=True)]
            keys = parts.field("keys")
            each = np.repeat(np.arange(len(k)), np.diff(keys.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([keys.flatten(), parts.field("p").take(pa.array(each)), pa.array(sets, pa.binary()).take(pa.array(each))], ["key", "p", "set"])

    texts = may_be_in(docs, "mark", bloom_filter(wanted.select(F.col("mark").alias("h"))))
    return texts.join(lists, "mark").select("text", "parts").mapInArrow(run, "key long, p long, set binary")


def connect_sets(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Links that connect whatever pairs of a Jaccard index of at least `least` connect, by breadth-first search.

    An index of the sets' items counts what a set shares with all others at once, so no pair of sets is built.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    if n == 2:
        both = np.intersect1d(*sets, assume_unique=True).size
        if both >= least * (size.sum() - both):
            yield 0, 1
        return
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    holder = np.repeat(np.arange(n), size)[np.argsort(item, kind="stable")]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(item))])
    left = np.ones(n, bool)
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        open_ = [seed]
        while open_ and left.any():
            x = open_.pop()
            own = item[starts[x] : starts[x + 1]]
            shared = np.bincount(np.concatenate([holder[bounds[i] : bounds[i + 1]] for i in own.tolist()]), minlength=n)
            found = np.flatnonzero(left & (shared >= least * (size + size[x] - shared)))
            left[found] = False
            open_ += found.tolist()
            for y in found.tolist():
                yield x, y


def _shared_keys(banded: DataFrame, most: int) -> DataFrame:
    """The rows of banded (key, p) whose key another paragraph has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, large in whole_groups(batches, ["key"], most):
            if not large:
                starts = runs(longs(part.column("key")))
                part = part.filter(pa.array(np.repeat(np.diff(starts) > 1, np.diff(starts))))
            yield part

    return banded.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, p long")


def _firsts(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """The rows of large groups (keys, p, set), once for each of the set's rarest shingles in its group: a column first is added.

    Two sets of a Jaccard index of at least `similarity` share at least that part of either one's shingles. So they share one of the
    first size - ceil(similarity * size) + 1 shingles of both in any common order, and no link is lost. Shingles are ordered by how
    many sets of the group have them; those of one set only link nothing.
    """
    names = [*keys, "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, at = _unpacked(b.column("set"))
            row = pa.array(np.repeat(np.arange(b.num_rows), np.diff(at)))
            yield pa.RecordBatch.from_arrays([*[b.column(n).take(row) for n in names], pa.array(items.view(np.int64))], [*names, "first"])

    items = rows.select(*names, "set").mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", first long")
    counted = attach_group(items, [*keys, "first"], {"n": (F.count("*"), F.sum)}, spread_by=["p"])
    ranked = counted.groupBy(*names).agg(F.sort_array(F.collect_set(F.struct("n", "first"))).alias("all"))  # bounded by PASSAGE
    least = F.ceil(F.size("all") * similarity - 1e-9).cast("int")
    chosen = ranked.select(*names, F.explode(F.slice("all", F.lit(1), F.size("all") - least + 1)).alias("at")).filter("at.n > 1")
    return rows.dropDuplicates(names).join(chosen.select(*names, "at.first"), names)


def _compare(rows: DataFrame, keys: list[str], similarity: float, most: int | None) -> DataFrame:
    """a, b: links within the groups of rows (keys, p, set); the rows of a group of over most rows come back as they are, a and b null."""
    names = ["a", "b", *keys, "p", "set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, large in whole_groups(batches, keys, most):
            if large:
                empty = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([empty, empty, *[part.column(n) for n in names[2:]]], names)
                continue
            p = longs(part.column("p"))
            again = np.append(False, np.all([np.diff(longs(part.column(k))) == 0 for k in (*keys, "p")], axis=0))
            part, p = part.filter(pa.array(~again)), p[~again]  # a repeated row
            items, at = _unpacked(part.column("set"))
            starts, out = runs(*[longs(part.column(k)) for k in keys]), []
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if j - i > 1:
                    out += [(p[i + x], p[i + y]) for x, y in connect_sets([items[at[k] : at[k + 1]] for k in range(i, j)], similarity)]
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            fill = [pa.nulls(len(a), pa.int64())] * (len(keys) + 1) + [pa.nulls(len(a), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *fill], names)

    ordered = rows.select(*keys, "p", "set").repartition(*keys).sortWithinPartitions(*keys, "p")
    return ordered.mapInArrow(run, "a long, b long, " + ", ".join(f"{k} long" for k in keys) + ", p long, set binary")


def _dealt(rows: DataFrame, keys: list[str], most: int, turn: int) -> DataFrame:
    """The rows of large groups with a part of about most rows of their group, another one in each turn."""
    sized = attach_group(rows, keys, {"n": (F.count("*"), F.sum)}, spread_by=["p"])
    return sized.withColumn("part", F.pmod(F.xxhash64("p", F.lit(turn)), F.ceil(F.col("n") / most)))


def _in_parts(rows: DataFrame, keys: list[str], links: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """The rows of large groups once for each two parts of their group that hold them, and the keys of such a pair of parts.

    A group whose rows are all connected by links already has nothing to add and is left out.
    """
    roots = components(links).withColumnRenamed("node", "p")
    rows = rows.join(roots, "p", "left").withColumn("root", F.coalesce("root", "p"))
    aggs = {"n": (F.count("*"), F.sum), "low": (F.min("root"), F.min), "high": (F.max("root"), F.max)}
    rows = attach_group(rows, keys, aggs, spread_by=["p"], extend=lambda groups: groups.filter("low <> high"))
    rows = rows.withColumn("parts", F.ceil(F.col("n") / most)).withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other")), [*keys, "x", "y"]


def _links(members: DataFrame, similarity: float, most: int) -> DataFrame:
    """a, b: links that connect what pairs of at least `similarity` connect within the buckets of members (key, p, set)."""

    def compared(rows: DataFrame, keys: list[str], most: int | None) -> tuple[DataFrame, DataFrame]:
        out = materialise(_compare(rows, keys, similarity, most), "links")
        return out.filter("a is not null").select("a", "b"), out.filter("a is null").select(*keys, "p", "set")

    found, rest = compared(members, ["key"], most)
    if rest.isEmpty():
        return found.distinct()
    keys = ["key", "first"]
    links, rest = compared(_firsts(rest, ["key"], similarity), keys, most)
    found = found.union(links)
    if rest.isEmpty():
        return found.distinct()
    for turn in (1, 2):  # parts that each hold near copies of one passage are connected by the second dealing
        found = found.union(compared(_dealt(rest, keys, most, turn), [*keys, "part"], None)[0])
    return found.union(compared(*_in_parts(rest, keys, found, most), None)[0]).distinct()


def paragraph_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, most: int = 2048) -> DataFrame:
    """doc_id, start, end, n_words, class_doc, class_start, removed: one row for each paragraph with near copies in another document, itself included.

    class_doc and class_start name the group's first paragraph, which stays; removed is true for all others.
    Paragraphs of a text overlap; what goes is the union of the removed ones.
    """
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("mark"), text.alias("text"))
    rows = materialise(paragraphs(docs).withColumn("row", F.monotonically_increasing_id()), "paragraphs")
    # p, the least row of a paragraph's copies, is its number; paragraphs with the same words have the same bands
    bands = [f"b{k}" for k in range(BANDS)]
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    salts = F.expr("bit_or(shiftleft(1L, salt))").alias("salts")  # over which a group's rows are spread
    groups = rows.withColumn("salt", salt).groupBy("hi", "lo").agg(F.min("row").alias("p"), F.count("*").alias("n"), salts, *[F.first(b).alias(b) for b in bands])
    groups = materialise(groups, "different")
    shared = _shared_keys(groups.select(F.explode(F.array(*bands)).alias("key"), "p"), most)
    wanted = shared.groupBy("p").agg(F.collect_list("key").alias("keys"))
    wanted = materialise(wanted.join(rows.select(F.col("row").alias("p"), "mark", "start", "hi"), "p"), "wanted")
    roots = components(_links(_with_sets(docs, wanted), similarity, most))
    chosen = groups.select("hi", "lo", F.col("p").alias("node"), "n", "salts").join(roots, "node", "left").filter("n > 1 or root is not null")
    spread = F.expr(f"explode(filter(sequence(0, {SALTS - 1}), i -> (shiftright(salts, i) & 1) = 1))")
    chosen = chosen.select("hi", "lo", F.coalesce("root", "node").alias("root"), spread.alias("salt"))
    found = rows.drop(*bands).withColumn("salt", salt).join(chosen, ["hi", "lo", "salt"]).drop("hi", "lo", "salt")
    aggs = {"class": (F.min(F.struct("id", "start", "row")), F.min), "low": (F.min("mark"), F.min), "high": (F.max("mark"), F.max)}
    found = attach_group(materialise(found, "found"), ["root"], aggs, spread_by=["row"], extend=lambda classes: classes.filter("low <> high"))
    return found.select(
        F.col("id").alias("doc_id"), "start", "end", "n_words", F.col("class.id").alias("class_doc"), F.col("class.start").alias("class_start"),
        (F.col("row") != F.col("class.row")).alias("removed"),
    )


def op8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_paragraphs": op8_paragraphs}
ORACLE_SQL: dict[str, str] = {}
