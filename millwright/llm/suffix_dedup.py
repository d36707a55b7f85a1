"""Exact substring deduplication: bytes covered by a long string that also starts earlier are removed.

Every window of LENGTH bytes has an anchor, the window's GRAM-byte string with the least hash, so equal
windows have equal anchors at equal places. A document's windows with the same anchor form a segment; there
is one for about 40 bytes of text. Of each segment only numbers are dealt out at first: those whose anchor, with the
bytes of half a window before it or behind it, occurs once have no window that occurs elsewhere, and are dropped.

All others are fetched and dealt to shards by anchor. Segments with the same bytes are one string of a shard: its copies
behind the first one are removed whole. Different segments of a group can have a window in common only if they agree in the bytes of half a
window on one side of the anchor; those that agree with no other one are left out. A shard lays the others out with a separator of its own
behind each, sorts their suffixes by Larsson-Sadakane refinement and gets common prefixes by Kasai's scan (all
segments of the shard in step). Windows are equal if their suffixes agree in LENGTH bytes; of equal ones the first
stays, and the others are removed. A group of too many different segments for one shard is cut into several, and one of very many segments
is dealt to several tasks before (those of frequent anchors, which some documents tell, already as numbers); each shard
gives its sorted table of different windows, and the tables are merged by binary search, on the windows' bytes.

Order: smaller id first, then the earlier start. Cases: a null text is empty; a null id is the smallest one; ids of
other types than integers are numbered in their order; rows that repeat both id and text are one document, and what is
removed of one is removed of all; rows that repeat an id, or have none, with other texts are ordered by a hash of
the text; texts shorter than LENGTH are kept; a text over BLOCK bytes is read in overlapping parts; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.prefix import global_order
from millwright.llm.common import blocks, bloom_filter, in_bloom, longs, materialise, may_be_in, mix, powers, runs, text_bytes, whole_groups

LENGTH, GRAM, BLOCK = 100, 16, 1 << 18
#: One document of so many tells which anchors are frequent; that decides only how their segments are dealt to tasks.
SHARE = 64
_ONE = 0xD6E8FEB86659FD93
_LOW = np.uint64((1 << 24) - 1)
_BYTES = np.array([1 << (8 * k) for k in range(8)], np.uint64)


def segments(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of bytes of texts (up to 2**24): first window and number of windows of each segment, its anchor's place, and hashes
    of the anchor and of the bytes that make up half a window on either side of the anchor."""
    n, width = len(data), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    up, down = powers(_ONE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(data, up[:n], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    grams = sums[gram:] - sums[:-gram]
    grams *= down[: n - gram + 1]
    least = grams & ~_LOW  # the high bits of the hash, then the place: of equal hashes the first one is the least
    least |= np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    least &= _LOW
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    for begin, end in zip(at[1:-1].tolist(), at[1:-1].tolist(), strict=True):  # no window crosses into another text
        new[max(0, end - length + 1) : begin] = False
        if begin < len(new):
            new[begin] = True
    if len(least) > at[-2] and at[-1] - at[-2] < length:
        new[at[-2] :] = False
    first = np.flatnonzero(new)
    owner = np.searchsorted(at, first, side="right") - 1
    fits = first + length <= at[owner + 1]
    first, owner = first[fits], owner[fits]
    count = np.minimum(np.append(first[1:], n), at[owner + 1] - length + 1) - first
    anchor = least[first].astype(np.int64)

    def hashed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (sums[j] - sums[i]) * down[i]

    half = (length - gram + 1) // 2
    before = mix(hashed(np.maximum(anchor - half, 0), anchor))
    after = mix(hashed(anchor + gram, np.minimum(anchor + gram + half, n)))
    return first, count, anchor, mix(grams[anchor]), before, after


class Dealt:
    """Frequent anchors and the codes under which their segments are dealt: about `size` segments each, for an estimated number of them."""

    def __init__(self, keys: np.ndarray, number: np.ndarray, size: int):
        order = np.argsort(keys)
        self.keys, self.codes_of = keys[order], -(-number[order] // size)
        salt = np.concatenate([np.zeros(0, np.int64), *[np.arange(1, n + 1) for n in self.codes_of.tolist()]])
        own = np.repeat(self.keys, self.codes_of)
        code = self.code(own, salt)
        order = np.argsort(code)
        self.codes, self.own, self.salt = code[order], own[order], salt[order]

    @staticmethod
    def code(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix(key.view(np.uint64) + salt.astype(np.uint64)).view(np.int64)

    @staticmethod
    def find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in `what` of values that are in the sorted array `where`, and their places there."""
        if not len(where):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(where, what), len(where) - 1)
        hit = np.flatnonzero(where[at] == what)
        return hit, at[hit]

    def deal(self, key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """key, with a code in place of each frequent one."""
        hit, at = self.find(self.keys, key)
        spread = mix(mix(doc[hit].view(np.uint64)) + place[hit].astype(np.uint64)) % self.codes_of[at].astype(np.uint64)
        key = key.copy()
        key[hit] = self.code(key[hit], spread.astype(np.int64) + 1)
        return key

    def undo(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys, and the salt of each (0: not frequent). Another key that equals a code is dealt with it as a whole, which does no harm."""
        hit, at = self.find(self.codes, code)
        key, salt = code.copy(), np.zeros(len(code), np.int64)
        key[hit], salt[hit] = self.own[at], self.salt[at]
        return key, salt


def _dealt(docs: DataFrame, length: int, gram: int, most: int) -> Dealt:
    """The anchors that are estimated, by some documents, to occur over 4 * most times. Others that do are only slower; no segment is left out."""
    some = _occurrences(docs.filter(F.pmod(F.xxhash64("doc"), F.lit(SHARE)) == 0), length, gram)
    found = some.groupBy("key").count().filter(F.col("count") * SHARE > 4 * most).collect()  # at most one for 4 * most segments
    key, number = (np.array([r[k] for r in found], np.int64) for k in (0, 1))
    return Dealt(key, number * SHARE, 4 * most)


def _occurrences(docs: DataFrame, length: int, gram: int, dealt: Dealt | None = None) -> DataFrame:
    """key, doc, place: one row for each segment; key is the anchor's hash, or a code of it if it is frequent.

    place packs the start (31 bits), the anchor's offset and the number of windows (7 bits each) and 9 bits of each neighbour's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text", BLOCK):
            ids = longs(rows.column(0))
            for base in range(0, max(1, len(data) - length + 1), 2 * BLOCK):  # more than one part only of a single long text
                part = data[base : base + 2 * BLOCK + length - 1] if len(data) > 2 * BLOCK + length else data
                inner = at if part is data else np.array([0, len(part)])
                first, count, anchor, key, before, after = segments(part, inner, length, gram)
                owner = np.searchsorted(inner, first, side="right") - 1
                start = first - inner[owner] + (base if part is not data else 0)
                place = (start.astype(np.int64) << 32) | ((anchor - first) << 25) | (count << 18)
                place |= ((before & np.uint64(511)).astype(np.int64) << 9) | (after & np.uint64(511)).astype(np.int64)
                key = key.view(np.int64) if dealt is None else dealt.deal(key.view(np.int64), ids[owner], place)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[owner]), pa.array(place)], ["key", "doc", "place"])
                if part is data:
                    break

    return docs.mapInArrow(run, "key long, doc long, place long")


def repeated(code: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    order, out = np.argsort(code), np.zeros(len(code), bool)
    same = code[order[1:]] == code[order[:-1]]
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _repeatable(occurrences: DataFrame, length: int, gram: int, most: int, dealt: Dealt | None = None) -> DataFrame:
    """doc, place, key, part: the segments of which a window may occur elsewhere.

    place packs the start, the anchor's offset and the number of windows (7 bits each). A group of over most rows is dealt out in parts of
    about most rows, from 1 on; others are part 0. The segments of a frequent anchor come by code, and so in parts from the first.
    """
    half, dealt = (length - gram + 1) // 2, dealt or Dealt(np.zeros(0, np.int64), np.zeros(0, np.int64), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, seen = None, 0  # the large group that is read, and its rows so far
        for rows, large in whole_groups(batches, ["key"], most):
            if not large:
                code = longs(rows.column("key"))
                starts = runs(code)
                rows = rows.filter(pa.array(np.repeat(np.diff(starts) > 1, np.diff(starts)) | (dealt.undo(code)[1] > 0)))
            code, doc, place = (longs(rows.column(c)) for c in ("key", "doc", "place"))
            key, salt = dealt.undo(code)
            offset, count = (place >> 25) & 127, (place >> 18) & 127
            pair, part = large | (salt > 0), (salt > 0).astype(np.int64)
            if large:  # pieces of one group, or whole large groups of a batch
                starts = runs(code)
                part = np.arange(len(code)) - np.repeat(starts[:-1], np.diff(starts))
                part[: starts[1]] += seen if code[0] == name else 0
                name, seen = code[-1], int(part[-1]) + 1
                part = part // most + 1
            else:
                # half a window or more is before the anchor in the last windows, or behind it in the first ones
                for side, has in ((9, offset >= half), (0, offset - count + 1 <= half)):
                    own = np.flatnonzero(has)
                    pair[own] |= repeated(mix(mix(code[own].view(np.uint64)) + ((place[own] >> side) & 511).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(x[pair]) for x in (doc, place >> 18, key, (salt << 32) | part)], ["doc", "place", "key", "part"])

    return occurrences.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc long, place long, key long, part long")


def paired(key: np.ndarray, offset: np.ndarray, data: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Of different segments: whether half a window's bytes before the anchor, or behind it, also occur in another segment of the group.

    Equal windows have half a window's bytes on one side of the anchor in common, so no others can have a window in common.
    """
    half = (length - gram + 1) // 2
    up, down = powers(_ONE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
    anchor, least = at[:-1] + offset, offset - (np.diff(at) - length)  # least: bytes before the anchor in the last window
    out = np.zeros(len(key), bool)
    for has, first in ((offset >= half, anchor - half), (least <= length - gram - half, anchor + gram)):
        own = np.flatnonzero(has)
        i = first[own]
        out[own] |= repeated(mix(mix(key[own].view(np.uint64)) + (sums[i + half] - sums[i]) * down[i]))
    return out


def laid_out(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings with a separator behind each: symbols (a byte + 1; a separator is 0) and the starts of the strings (and the end)."""
    n = len(at) - 1
    out = np.zeros(len(data) + n, np.uint16)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data.astype(np.uint16) + 1
    return out, at + np.arange(n + 1)


def _ordered(key: np.ndarray, key_bits: int, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """value (of up to `bits` bits), ordered by key and value, and where the key changes. If both fit they are packed, since a plain sort is fastest."""
    new = np.ones(len(value), bool)
    if key_bits + bits <= 64:
        code = (key << np.uint64(bits)) | value.astype(np.uint64)
        code.sort()
        value, key = (code & np.uint64((1 << bits) - 1)).astype(np.int64), code >> np.uint64(bits)
    else:
        by = np.lexsort((value, key))
        value, key = value[by], key[by]
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return value, new


def suffix_array(symbols: np.ndarray, lanes: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """The sorted suffixes of strings that are laid out with separators (lanes: their starts, and the end), by Larsson-Sadakane refinement.

    A separator is less than any byte and than all separators behind it, so no comparison goes on into the next
    string. Suffixes are sorted by 4 symbols first; each round sorts the groups that are still unsorted by
    the ranks of the suffixes that start as many symbols later as the groups agree in.

    With count, only the first `count` suffixes of each string come in order; of the others those are refined whose ranks they need.
    """
    n = len(symbols)
    if count is not None:
        offset = (np.arange(n) - np.repeat(lanes[:-1], np.diff(lanes))).astype(np.int32)
        wanted = np.repeat(count.astype(np.int32), np.diff(lanes))
    bits = max(1, int(n).bit_length())
    word = np.append(symbols, np.zeros(4, np.uint16)).astype(np.int64)
    for k in (1, 2):
        word = (word[:-k] << (9 * k)) | word[k:]
    word = word[:n]
    short = np.zeros(n, bool)  # what is behind the separator does not count; the place tells such suffixes apart
    for left in range(4):
        at = lanes[1:] - 1 - left
        at = at[at >= lanes[:-1]]
        short[at] = True
        word[at] = word[at] >> (9 * (4 - left)) << (9 * (4 - left))
    rank = np.empty(n, np.int64)

    def name(places: np.ndarray, new: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        """Give the suffixes at places the place of their group's head as rank; which of them are in groups of more than one."""
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(new)))
        rank[suffixes] = np.repeat(places[heads], size)
        return np.repeat(size > 1, size)

    order, new = _ordered(word.astype(np.uint64), 36, np.arange(n), bits)
    new |= short[order]
    places = np.flatnonzero(name(np.arange(n), new, order))
    h = 4
    while len(places):
        suffixes = order[places]
        if count is not None and h >= 32:  # to agree in 2 h symbols is asked of the first ones, and of those multiples of 2 h behind them
            needed = (offset[suffixes] & (2 * h - 1)) < wanted[suffixes]
            places, suffixes = places[needed], suffixes[needed]
        both = (rank[suffixes] << bits) | rank[suffixes + h]
        suffixes, new = _ordered(both.astype(np.uint64), 2 * bits, suffixes, bits)
        order[places] = suffixes
        places = places[name(places, new, suffixes)]
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, lanes: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """For each place in order the common prefix with the place before, up to depth bytes, by Kasai's scan.

    lanes: the starts of the strings, and the end; order has the first `count` suffixes of each string. The scan goes through
    all strings in step: from one suffix to the next the prefix loses one byte at most, if the other string goes on as well.
    """
    n = len(symbols)
    place = np.full(n + 1, -1, np.int32)
    place[order] = np.arange(len(order))
    before = np.append(order[-1:], order[:-1])  # the suffix that is sorted just before each one
    left = np.repeat(lanes[1:] - 1, np.diff(lanes)) - np.arange(n)  # bytes up to the separator
    np.minimum(left, depth, out=left)
    word = np.append(np.maximum(symbols, 1).astype(np.uint64) - np.uint64(1), np.zeros(8, np.uint64))
    for k in (1, 2, 4):
        word = (word[:-k] << np.uint64(8 * k)) | word[k:]
    out, by_size = np.zeros(len(order), np.int64), np.argsort(-count, kind="stable")
    lane, have, sizes = lanes[:-1][by_size], np.zeros(len(count), np.int64), -count[by_size]
    last = np.full(len(count), -1, np.int64)  # the suffix with which each string was compared
    for t in range(int(count.max(initial=0))):
        alive = int(np.searchsorted(sizes, -t, side="left"))  # strings of more than t suffixes
        i, h, goes_on = lane[:alive] + t, have[:alive], place[last[:alive] + 1] >= 0
        own = place[i]
        j = before[own]
        most = np.minimum(left[i], left[j])
        most[own == 0] = 0
        h = np.minimum(np.maximum(h - 1, 0) * goes_on, most)
        going = np.flatnonzero(h < most)
        while len(going):
            done = h[going]
            differ = word[i[going] + done] ^ word[j[going] + done]
            same = 8 - np.searchsorted(_BYTES, differ, side="right")  # leading bytes that agree
            h[going] = np.minimum(done + same, most[going])
            going = going[(same == 8) & (h[going] < most[going])]
        out[own], have, last = h, h, j
    return out


def first_copies(strings: pa.Array) -> np.ndarray:
    """Whether each string is the first one with its bytes."""
    coded = strings.dictionary_encode()
    code, first = coded.indices.to_numpy(), np.empty(len(coded.dictionary), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]  # what is assigned last stays
    return first[code] == np.arange(len(code))


def _slices(key: np.ndarray, at: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of whole groups of rows, of about limit bytes each, or of one group."""
    starts, first = runs(key), 0
    while first < len(starts) - 1:
        last = int(np.searchsorted(at[starts], at[starts[first]] + limit, side="right")) - 1
        last = min(max(first + 1, last), len(starts) - 1)
        yield slice(int(starts[first]), int(starts[last]))
        first = last


def _shards(found: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """doc, start, end: spans to remove; with shard and window: the table of different windows of a shard that holds a part of a group.

    found has place, the start and the anchor's offset (7 bits). Groups of over most different segments are cut, and so are those that come in parts.
    """
    names = ["doc", "start", "end", "shard", "code", "window"]

    def spans(*columns: np.ndarray) -> pa.RecordBatch:
        fill = [pa.nulls(len(columns[0]), t) for t in (pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), *fill], names)

    def apart(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """The different segments, and the spans of their copies; a copy is behind the first one, as rows are sorted by document and start."""
        first = first_copies(rows.column("bytes"))
        copies = rows.filter(pa.array(~first))
        start = longs(copies.column("place")) >> 7
        return rows.filter(pa.array(first)), spans(longs(copies.column("doc")), start, start + np.diff(text_bytes(copies.column("bytes"))[1]))

    def sorted_shard(rows: pa.RecordBatch, shard: int | None) -> pa.RecordBatch:
        # of equal windows the first one is in the first row, as rows are sorted by document and start
        doc, start = longs(rows.column("doc")), longs(rows.column("place")) >> 7
        data, at = text_bytes(rows.column("bytes"))
        symbols, lanes = laid_out(data, at)
        count, rows_of = np.maximum(np.diff(lanes) - length, 0), np.repeat(np.arange(len(doc)), np.diff(lanes))
        order = suffix_array(symbols, lanes, count)
        place = order[order + length < lanes[rows_of[order] + 1]]  # the windows
        group = np.cumsum(common_prefixes(symbols, place, lanes, count, length) < length)
        heads = runs(group)
        first = np.minimum.reduceat(place, heads[:-1]) if len(place) else place
        head = np.repeat(first, np.diff(heads))
        gone = np.sort(place[place != head])
        part = rows_of[gone]
        cut = runs(gone - np.arange(len(gone)), part)
        one, last = gone[cut[:-1]], gone[cut[1:] - 1]
        part = part[cut[:-1]]
        columns = [doc[part], start[part] + one - lanes[part], start[part] + last - lanes[part] + length]
        if shard is None:
            return spans(*columns)
        part = rows_of[first]
        base, raw = first - part, data.tobytes()  # without the separators
        more = doc[part], start[part] + first - lanes[part], start[part] + first - lanes[part] + length
        columns = [np.concatenate(x) for x in zip(columns, more, strict=True)]
        mask = np.arange(len(columns[0])) < len(columns[0]) - len(first)
        table = [None] * int(mask.sum()) + [raw[p : p + length] for p in base.tolist()]
        up, down = powers(_ONE, len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up[: len(data)])])
        code = np.zeros(len(mask), np.uint64)
        code[~mask] = mix((sums[base + length] - sums[base]) * down[base])
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(np.full(len(mask), shard), mask=mask), pa.array(code.view(np.int64), mask=mask), pa.array(table, pa.binary())], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = 0
        for rows, _ in whole_groups(batches, ["key"], 8 * most):
            rows, copies = apart(rows)
            yield copies
            key, part = longs(rows.column("key")), longs(rows.column("part"))
            offset, (data, at), stays = longs(rows.column("place")) & 127, text_bytes(rows.column("bytes")), part > 0
            for own in _slices(key, at, 1 << 18):
                stays[own] |= paired(key[own], offset[own], data[at[own.start] : at[own.stop]], at[own.start : own.stop + 1] - at[own.start], length, gram)
            rows, key, part = rows.filter(pa.array(stays)), key[stays], part[stays]
            starts = runs(key)
            size = np.diff(starts)
            cut = (size > most) | (part[starts[:-1]] > 0)
            for group in np.flatnonzero(cut).tolist():
                for at in range(int(starts[group]), int(starts[group + 1]), most):
                    yield sorted_shard(rows.slice(at, min(most, int(starts[group + 1]) - at)), shard)
                    shard += 1
            rows = rows.filter(pa.array(np.repeat(~cut, size)))
            for own in _slices(longs(rows.column("key")), text_bytes(rows.column("bytes"))[1], 1 << 17):
                yield sorted_shard(rows.slice(own.start, own.stop - own.start), None)

    sorted_rows = found.repartition("key", "part").sortWithinPartitions("key", "doc", "place")
    return sorted_rows.mapInArrow(run, "doc long, start long, end long, shard long, code long, window binary")


def merge_tables(a: tuple, b: tuple) -> tuple[tuple, tuple]:
    """Two sorted tables (window, doc, start) as one, by binary search, and (doc, start) of the windows of which the other table has an earlier one."""
    at = np.searchsorted(a[0], b[0])
    safe = np.minimum(at, max(0, len(a[0]) - 1))
    both = a[0][safe] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    mine, other = safe[both], np.flatnonzero(both)
    later = (a[1][mine] > b[1][other]) | ((a[1][mine] == b[1][other]) & (a[2][mine] > b[2][other]))
    lost = tuple(np.where(later, a[k][mine], b[k][other]) for k in (1, 2))
    kept = [a[k].copy() for k in (1, 2)]
    for k in (1, 2):
        kept[k - 1][mine] = np.where(later, b[k][other], a[k][mine])
    rest = np.flatnonzero(~both)
    merged = tuple(np.insert(x, at[rest], y[rest]) for x, y in zip((a[0], *kept), b, strict=True))
    return merged, lost


def _merged(windows: DataFrame, length: int, bucket: int = 1 << 15) -> DataFrame:
    """doc, start, end of the windows (of the tables of shards) that an earlier one equals. Windows meet in buckets of their hash, of about `bucket` each."""
    buckets = -(-windows.count() // bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in whole_groups(batches, ["bucket"]):
            window = np.array(rows.column("window").to_pylist(), f"S{length}")  # bytes of one length: zeros at the end do not matter
            doc, start = longs(rows.column("doc")), longs(rows.column("start"))
            cut, ends = runs(longs(rows.column("bucket")), longs(rows.column("task")), longs(rows.column("shard"))), runs(longs(rows.column("bucket")))
            lost = [(doc[:0], start[:0])]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = cut[(cut >= a) & (cut <= b)].tolist()
                tables = [(window[i:j], doc[i:j], start[i:j]) for i, j in zip(own[:-1], own[1:], strict=True)]
                while len(tables) > 1:
                    pairs = [merge_tables(*tables[k : k + 2]) for k in range(0, len(tables) - 1, 2)]
                    lost += [x[1] for x in pairs]
                    tables = [x[0] for x in pairs] + tables[len(pairs) * 2 :]
            doc, start = (np.concatenate(x) for x in zip(*lost, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, start, start + length)], ["doc", "start", "end"])

    dealt = windows.withColumn("bucket", F.pmod("code", F.lit(max(1, buckets)))).select("bucket", "task", "shard", "window", "doc", "start")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "task", "shard", "window").mapInArrow(run, "doc long, start long, end long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = 1024) -> DataFrame:
    """doc, start, end (of tables that are written): byte spans, which may overlap, whose windows of length bytes all start earlier elsewhere.

    docs has the columns doc (long, not null; different) and text. most: rows of a shard.
    """
    dealt = _dealt(docs, length, gram, 8 * most)
    repeatable = materialise(_repeatable(_occurrences(docs, length, gram, dealt), length, gram, 8 * most, dealt), "segments")
    lists = repeatable.groupBy("doc").agg(F.collect_list(F.struct("place", "key", "part")).alias("parts"))  # bounded by the text

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text"):
            column = rows.column("parts")
            parts, number = column.flatten(), np.diff(column.offsets.to_numpy())
            doc, place = np.repeat(longs(rows.column("doc")), number), longs(parts.field("place"))
            base, size, place = (place >> 14) + np.repeat(at[:-1], number), (place & 127) + length - 1, place >> 7
            for a in range(0, len(doc), 1 << 12):  # bounded batches of a long text
                own = slice(a, a + (1 << 12))
                offsets = np.concatenate([[0], np.cumsum(size[own])])
                taken = data[np.arange(offsets[-1]) + np.repeat(base[own] - offsets[:-1], size[own])]
                column = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken)])
                key, part = (parts.field(c).slice(a, len(offsets) - 1) for c in ("key", "part"))
                yield pa.RecordBatch.from_arrays([key, part, pa.array(doc[own]), pa.array(place[own]), column], ["key", "part", "doc", "place", "bytes"])

    bloom = bloom_filter(lists.select(F.xxhash64("doc").alias("h")))
    texts = may_be_in(docs.withColumn("h", F.xxhash64("doc")), "h", bloom).drop("h")
    found = texts.join(lists, "doc").select("doc", "text", "parts").mapInArrow(fetch, "key long, part long, doc long, place long, bytes binary")
    compared = _shards(found, length, gram, most).withColumn("task", F.spark_partition_id().cast("long"))
    compared = materialise(compared, "compared")
    spans = compared.filter("shard is null").select("doc", "start", "end")
    tables = compared.filter("shard is not null")
    return spans if tables.isEmpty() else spans.union(materialise(_merged(tables, length), "merged"))


def removed(spans: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end (in the bytes of all rows) of the maximal runs that each row's spans cover, in order."""
    owner = np.repeat(np.arange(len(spans)), pc.fill_null(spans.value_lengths(), 0).to_numpy())
    parts = spans.flatten()
    first, last = at[owner] + longs(parts.field("start")), np.minimum(at[owner] + longs(parts.field("end")), at[owner + 1])
    inside = first < at[owner + 1]
    owner, first, last = owner[inside], first[inside], last[inside]
    order = np.argsort(first, kind="stable")  # rows are behind one another, so this is their order too
    owner, first, last = owner[order], first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(owner), bool)
    new[1:] = (first[1:] > last[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    return owner[heads], first[heads], last[np.append(heads[1:], len(owner)) - 1] if len(heads) else first[:0]


def _numbered(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """id, doc, text: doc is the id, if ids are different integers; else the place of (id, hash of the text) in their order, which rows may repeat."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"))
    plain = isinstance(rows.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if plain and rows.groupBy("id").count().filter("count > 1 or id is null").isEmpty():
        return rows.select("id", F.col("id").cast("long").alias("doc"), "text"), False
    rows = rows.withColumn("mark", F.xxhash64("text"))
    ranks = global_order(rows.select(F.col("id").alias("own"), F.col("mark").alias("same")).distinct(), ["own", "same"])
    joined = rows.join(ranks, F.col("id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("same")))
    return materialise(joined.select("id", F.col("rank").cast("long").alias("doc"), "text"), "numbered"), True


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = 1024, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with with_text the kept bytes: one row for each row of df."""
    docs, repeats = _numbered(df, id_col, text_col)
    different = docs.select("doc", "text")
    spans = repeated_spans(different.dropDuplicates(["doc"]) if repeats else different, length, gram, most)
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text"):
            n = rows.num_rows
            owner, first, last = removed(rows.column("spans"), at) if "spans" in rows.schema.names else [np.zeros(0, np.int64)] * 3
            view, edges, kept = memoryview(data), np.searchsorted(owner, np.arange(n + 1)).tolist(), []
            base, first, last = at.tolist(), first.tolist(), last.tolist()
            for k in range(n):
                cut = slice(edges[k], edges[k + 1])
                pieces = zip([base[k], *last[cut]], [*first[cut], base[k + 1]], strict=True)
                kept.append(b"".join([view[a:b] for a, b in pieces]))
            gone = np.diff(at) - np.array([len(x) for x in kept], np.int64)
            columns = [np.diff(at), gone, np.diff(edges).astype(np.int64), [sha256(x).hexdigest() for x in kept], kept]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([rows.column("id"), *[pa.array(x, t) for x, t in zip(columns, kinds, strict=False)]], names[: 5 + with_text])

    bloom = bloom_filter(lists.select(F.xxhash64("doc").alias("h")))
    marked = docs.withColumn("h", F.xxhash64("doc"))
    cut = may_be_in(marked, "h", bloom).join(lists, "doc", "left")

    def finish_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the documents that have no spans for certain; in the same step, so that a task needs one Python worker only."""
        yield from finish(b.filter(pa.array(~in_bloom(longs(b.column("h")).view(np.uint64), bloom.value))) for b in batches)

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return marked.select("id", "text", "h").mapInArrow(finish_others, schema).union(cut.select("id", "text", "spans").mapInArrow(finish, schema))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
