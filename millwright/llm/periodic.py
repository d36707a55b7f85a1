"""Periodic runs: stretches of words that repeat with a short period, such as looped generations.

A run is a stretch with smallest period q (words q apart are identical) of at least max(min_length, min_exponent * q)
words that neither neighbour extends. Runs are found by the runs theorem: every run holds a Lyndon word of its period's
length that is the longest one at its start, under one of the two orders of the words. So each position gives two candidates, and
each is extended to both sides by longest-common-extension queries: the string depth of a lowest common ancestor, in the
suffix tree of the words to the right and in that of their reversal to the left. Trees are built by Ukkonen's algorithm;
an Euler tour with range minima over it answers a query in constant time, all of a text's queries at once.

A run's trigrams of words recur, so words whose trigram occurs too seldom in its document are in no run. They cut a document
into stretches, and only stretches that could hold a run get trees. This leaves nothing out: a run lies in
one stretch, and a neighbour beyond the stretch cannot extend it.

Cases: a null text is empty and has no words, no runs and an empty collapsed text; rows are judged one by one, so repeated rows,
null ids and ties change nothing; an empty table gives an empty one; columns of the input that clash with the added ones are replaced.
A text is held as a whole by one task; trees take about 1 kB for each word of a stretch, which is only
much where a document is periodic nearly throughout (a looped text of a million words takes about 1 GB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import blocks, mix, prefix_hash, runs

MIN_LENGTH, MIN_EXPONENT = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_BASE = 0x9E3779B97F4A7C15


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the words `[^\\x20\\x09-\\x0D]+`; none crosses texts."""
    ink = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    starts, ends = np.flatnonzero(ink & (~before | edge[:-1])), np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Ranges of words that could hold a run: successive trigrams of words that each occur often enough in their text."""
    often, n = min(min_exponent - 1, max(min_length, min_exponent) - 2), len(starts)
    if often < 2:  # nothing is known of such short runs
        cut = runs(text)
        return [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b - a >= min_length]
    if n < 3:
        return []
    sums, down = prefix_hash(data, _BASE)
    word = mix((sums[ends] - sums[starts]) * down[starts])
    key = mix(mix(word[:-2] + np.uint64(1)) ^ (word[1:-1] * np.uint64(3))) ^ (word[2:] * np.uint64(5))
    key = mix(key ^ (text[:-2].astype(np.uint64) * np.uint64(_BASE)))
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    good = (count[which] >= often) & (text[:-2] == text[2:])
    cut = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
    first, last = cut[::2], cut[1::2] + 2
    long = last - first >= max(min_length, min_exponent)
    return list(zip(first[long].tolist(), last[long].tolist(), strict=True))


def ukkonen(s: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """The suffix tree of s, whose last letter is unique: (parent * width + first letter -> node), start and end of each node's edge."""
    n, start, end, link, child = len(s), [0], [0], [0], {}
    active = edge = length = rest = 0
    for i, c in enumerate(s):
        rest += 1
        made = 0
        while rest:
            if not length:
                edge = i
            key = active * width + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if made:
                    link[made] = active
                    made = 0
            else:
                top = start[below]
                span = end[below] - top
                if length >= span:  # a leaf's edge is longer than length
                    active, edge, length = below, edge + span, length - span
                    continue
                if s[top + length] == c:
                    if made:
                        link[made] = active
                    length += 1
                    break
                middle = len(start)
                start += [top, i]
                end += [top + length, n]
                link += [0, 0]
                child[key], start[below] = middle, top + length
                child[middle * width + c] = middle + 1
                child[middle * width + s[top + length]] = below
                if made:
                    link[made] = middle
                made = middle
            rest -= 1
            if active:
                active = link[active]
            elif length:
                length -= 1
                edge = i - rest + 1
    return child, start, end


class RangeMin:
    """Minima of ranges of x, in constant time each, in memory proportional to x: blocks of 16 and a sparse table over them."""

    SIZE = 16

    def __init__(self, x: np.ndarray):
        n = -(-len(x) // self.SIZE)
        self.rows = np.full((n, self.SIZE), np.iinfo(np.int32).max, np.int32)
        self.rows.reshape(-1)[: len(x)] = x
        self.to = np.minimum.accumulate(self.rows, axis=1).reshape(-1)
        self.since = np.minimum.accumulate(self.rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [self.rows.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= n:
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(a, b), np.maximum(a, b)
        first, last = low // self.SIZE, high // self.SIZE
        out = np.minimum(self.since[low], self.to[high])
        one = np.flatnonzero(first == last)
        column = np.arange(self.SIZE)
        inside = (column >= (low[one] % self.SIZE)[:, None]) & (column <= (high[one] % self.SIZE)[:, None])
        out[one] = np.where(inside, self.rows[first[one]], np.iinfo(np.int32).max).min(axis=1)
        between = last - first - 1
        for k, level in enumerate(self.levels):
            own = np.flatnonzero((between >= 1 << k) & (between < 2 << k))
            out[own] = np.minimum(out[own], np.minimum(level[first[own] + 1], level[last[own] - (1 << k)]))
        return out


class SuffixTree:
    """Suffixes of letters from 1 to width - 1: their order, and the length of what two of them share, all by one tree."""

    def __init__(self, letters: np.ndarray, width: int):
        s = [*letters.tolist(), 0]
        child, start, end = ukkonen(s, width)
        n, nodes = len(s), len(start)
        key, node = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        del child
        order = np.argsort(key)
        parent, self._letter, self._child = key[order] // width, key[order] % width, node[order]
        self._from = np.searchsorted(parent, np.arange(nodes + 1))
        edge = (np.array(end) - np.array(start)).tolist()
        children, at, stop = self._child.tolist(), self._from[:-1].tolist(), self._from[1:].tolist()
        depth, tour, path = [0] * nodes, [], [0]
        while path:  # an Euler tour: a node at its entry and after each of its children
            v = path[-1]
            tour.append(v)
            k = at[v]
            if k < stop[v]:
                c = children[k]
                at[v] = k + 1
                depth[c] = depth[v] + edge[c]
                path.append(c)
            else:
                path.pop()
        walk, self._depth = np.array(tour, np.int64), np.array(depth, np.int64)
        leaf = (np.diff(self._from) == 0)[walk]
        self._n, self._place = n, np.empty(n, np.int64)
        self._place[n - self._depth[walk[leaf]]] = np.flatnonzero(leaf)
        self._least = RangeMin(self._depth[walk].astype(np.int32))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters the suffixes that start at a and b share; a is never b."""
        return self._least(self._place[a], self._place[b]).astype(np.int64)

    def rank(self, backwards: bool = False) -> np.ndarray:
        """The place of each suffix in their order; a suffix's beginning comes before it, and backwards reverses the order of letters."""
        if not backwards:
            order = np.argsort(self._place)
        else:
            last = self._letter == 0
            children = self._child[np.lexsort((np.where(last, 1 << 62, self._letter), np.repeat(np.arange(len(self._from) - 1), np.diff(self._from))))].tolist()
            low, high, path, found = self._from[:-1].tolist(), self._from[1:].tolist(), [0], []
            while path:  # the last child is visited first: the end of the text, then letters from the highest on
                v = path.pop()
                if low[v] == high[v]:
                    found.append(v)
                else:
                    path += children[low[v] : high[v]]
            order = self._n - self._depth[np.array(found, np.int64)]
        out = np.empty(self._n, np.int64)
        out[order] = np.arange(self._n)
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word at each position ends: the next position of a smaller suffix."""
    n, order = len(rank) - 1, rank.tolist()
    out = [n] * n
    for i in range(n - 1, -1, -1):
        j, own = i + 1, order[i]
        while j < n and order[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_of(letters: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """start, length, period of the runs of a sequence of integers from 1 on, by start and then period."""
    n = len(letters)
    if n < max(min_length, min_exponent):
        return np.empty((0, 3), np.int64)
    width = int(letters.max()) + 1
    right, left = SuffixTree(letters, width), SuffixTree(letters[::-1], width)
    found = []
    for backwards in (False, True):
        end = lyndon_ends(right.rank(backwards))
        i = np.flatnonzero(end - np.arange(n) <= n // min_exponent)
        j = end[i]
        before, after = left.common(n - i, n - j), right.common(i, j)
        period, length = j - i, j - i + before + after
        own = length >= np.maximum(min_length, min_exponent * period)
        found.append(np.stack([i[own] - before[own], length[own], period[own]], axis=1))
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _block(data: np.ndarray, at: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """For each text: its number of words; all runs with their text's number; the collapsed texts."""
    raw = data.tobytes()
    starts, ends, text = words_of(data, at)
    n_words = np.bincount(text, minlength=len(at) - 1)
    first = np.cumsum(n_words) - n_words
    found = [np.empty((0, 3), np.int64)]
    for a, b in stretches(data, starts, ends, text, min_length, min_exponent):
        numbers: dict[bytes, int] = {}
        letters = [numbers.setdefault(raw[x:y], len(numbers) + 1) for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
        own = runs_of(np.array(letters, np.int64), min_length, min_exponent)
        own[:, 0] += a
        found.append(own)
    found = np.concatenate(found)
    owner = text[found[:, 0]]
    gone = np.zeros(len(starts) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(gone)[:-1] == 0
    ends_at, looped = at.tolist(), set(owner.tolist())
    collapsed = []
    for k in range(len(at) - 1):
        if k in looped:
            own = np.flatnonzero(keep[first[k] : first[k] + n_words[k]]) + first[k]
            collapsed.append(b" ".join([raw[x:y] for x, y in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]))
        else:
            collapsed.append(b" ".join(raw[ends_at[k] : ends_at[k + 1]].split()))
    found[:, 0] -= first[owner]
    return n_words, owner, found, collapsed


def find_runs(df: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """df with n_words, runs (array of start, length, period, by start and then period; words count from 0) and collapsed.

    collapsed is the text without the words that stand in a run after its first period, joined by single spaces. min_exponent is at least 2.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run has at least two periods and one word")
    df = df.drop("n_words", "runs", "collapsed")
    kept = df.columns
    kinds = df.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:long,length:long,period:long>>").alias("runs"), F.lit(None).cast("string").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, text_col):
            n_words, owner, found, collapsed = _block(data, at, min_length, min_exponent)
            offsets = np.searchsorted(owner, np.arange(len(at)))
            each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)
            new = [pa.array(n_words.astype(np.int64)), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*kept, "n_words", "runs", "collapsed"])

    return df.mapInArrow(run, kinds)


def strongest(found: Column) -> Column:
    """Of an array of runs the one with the greatest length / period, compared exactly; the first of equal ones, null without any."""
    stronger = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(found, nothing, lambda best, x: F.when(stronger(best, x), x).otherwise(best))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document, by crc32 of its id, goes on from some word with a stretch that it repeats."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    rows = rows.withColumn("a", a).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    words = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", at(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(looped(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = lambda c: F.col(f"best.{c}")
    return out.select("doc_id", "n_runs", best("start").alias("start"), best("length").alias("length"), best("period").alias("period"), F.floor(1000 * best("length") / best("period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op11_runs": op11_runs}
ORACLE_SQL: dict[str, str] = {}
