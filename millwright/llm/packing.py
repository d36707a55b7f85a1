"""Lexical retrieval packing: documents that share rare terms go into the same training sequence.

Texts become token ids once; the ids are written to a table. Document frequencies of the ids over all
documents (a vector of the vocabulary's size) weigh the terms. Documents are dealt to shards by hash; a
shard has an inverted index of its documents with BM25 weights for all their terms. Each document in
turn, if it is unused, seeds a sequence, and the index returns its unused neighbours, best first, which
fill the window; the last one is cut to fit and its rest goes on as the next seed. Documents of over a
window are cut into full windows first. What is left at the end of a shard goes into sequences whose
lengths are powers of two, so there is no padding at all.

Cases: a null or empty text has the end token only; ties between neighbours go to the one that comes
first by id; repeated rows are packed as often as they occur; an empty table gives an empty result; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import _POWERS, LOWER, blocks, longs, materialise, mix, prefix_hash, runs, text_bytes, whole_groups

WINDOW, END, SHARD_TOKENS, CACHE = 4096, 2, 4_000_000, 1_500_000
K1, B = 1.2, 0.75
#: What the tokenizer splits a word of plain characters into: letters, single digits, other characters.
_PARTS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-`{-~]+")
_PLAIN = re.compile(rb"(?:[!-&(-~]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Neighbours that are sorted before the others are.
FIRST = 64
#: Bytes of text in a block, and parts of words that are kept.
BLOCK, PARTS = 2 << 20, 1 << 16


def _byte_letters() -> dict[int, int]:
    """The characters that byte-level vocabularies use for bytes: printable ones stand for themselves, the others follow 255 in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class WordTokenizer:
    """Token ids of texts, word by word: the tokenizer drops white space and never joins words, so each word is encoded once.

    The words of a block of texts are found and told apart by array operations; a word's key is a 64-bit hash,
    its length and its first and last eight bytes. Words that are new are encoded and kept, up to CACHE of them: in the order of
    their hashes, the latest ones in a table of their own, so that the large one is seldom written again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("token ids of over two bytes")
        self.letters = _byte_letters()
        self.parts: dict[bytes, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        self.known, self.recent = _no_words(), _no_words()
        self.flat, self.start, self.size = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64)

    def _lists(self, spelt: list[bytes]) -> list[list[int]]:
        """Ids of each word. A word of letters is one part for the tokenizer's model, other words of plain characters are several."""
        tokenize, out = self.whole.model.tokenize, []
        letters = b" ".join(spelt).decode("latin-1").translate(self.letters).split(chr(self.letters[32]))  # no word has a space
        for word, seen in zip(spelt, letters, strict=True):
            if word.isalpha():
                out.append([t.id for t in tokenize(seen)])
            elif not _PLAIN.fullmatch(word):
                out.append(self.whole.encode(word.decode(), add_special_tokens=False).ids)
            elif len(parts := _PARTS.findall(word)) == 1:
                out.append([t.id for t in tokenize(seen)])
            else:
                ids: list[int] = []
                for part in parts:
                    if part not in self.parts:
                        if len(self.parts) >= PARTS:
                            self.parts.clear()
                        self.parts[part] = [t.id for t in tokenize(part.decode("latin-1").translate(self.letters))]
                    ids += self.parts[part]
                out.append(ids)
        return out

    def encode_block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the place where each text's begin (and the end of the last)."""
        raw = data.tobytes()
        if b"<|" in raw:  # special tokens may be in a text, and case counts for them
            odd = [i for i in range(len(at) - 1) if b"<|" in raw[at[i] : at[i + 1]]]
        else:
            odd = []
        low = LOWER[data]
        begin, end = words(low, at)
        keys = word_keys(low, begin, end)
        first, inverse = distinct(keys[0])
        if not all((k == k[first][inverse]).all() for k in keys):  # two words with one hash
            _, first, inverse = np.unique(np.rec.fromarrays(keys), return_index=True, return_inverse=True)
        wanted, small = [k[first] for k in keys], low.tobytes()
        if len(self.known[0]) + len(self.recent[0]) > CACHE:
            self.reset()
        row, taken = np.full(len(first), -1), np.zeros(len(first), bool)
        for table in (self.known, self.recent):
            if len(table[0]):
                place = np.minimum(np.searchsorted(table[0], wanted[0]), len(table[0]) - 1)
                same = [t[place] == w for t, w in zip(table, wanted, strict=False)]
                taken |= same[0]
                same = np.logical_and.reduce(same)
                row[same] = table[4][place[same]]
        new = np.flatnonzero(row < 0)
        if len(new):
            at_new = first[new]
            lists = self._lists([small[i:j] for i, j in zip(begin[at_new].tolist(), end[at_new].tolist(), strict=True)])
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            row[new] = np.arange(len(self.start), len(self.start) + len(new))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(lists), np.uint16, int(size.sum())))
            fresh = ~taken[new]  # of several words with one hash the first is kept
            fresh[1:] &= wanted[0][new][1:] != wanted[0][new][:-1]
            kept = new[fresh]
            self.recent = _merged(self.recent, [*[w[kept] for w in wanted], row[kept]])
            if 8 * len(self.recent[0]) > len(self.known[0]):
                self.known, self.recent = _merged(self.known, self.recent), _no_words()
        row = row[inverse]
        size = self.size[row]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[row] - ends + size, size)] if total else np.empty(0, np.uint16)
        bounds = np.concatenate([[0], ends])[np.searchsorted(begin, at)]
        if odd:
            parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            for i in odd:
                parts[i] = np.array(self.whole.encode(raw[at[i] : at[i + 1]].decode(), add_special_tokens=False).ids, np.uint16)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_block(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the different hashes, in the order of the hashes, and which of them each place has.

    Hashes are told apart by their high 44 bits, so that one fast sort of numbers does; who needs more compares more.
    """
    if len(h) >= 1 << 20:
        return np.unique(h, return_index=True, return_inverse=True)[1:]
    low = np.uint64((1 << 20) - 1)
    code = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    order, starts = (code & low).astype(np.int64), runs(code >> np.uint64(20))
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return order[starts[:-1]], inverse


#: Masks of the first bytes of eight, by their number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Marks that end a word: all of ASCII but the apostrophe, which may be part of what follows or goes before.
_STOPS = np.zeros(256, bool)
_STOPS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_ACCENTED = np.zeros(256, bool)
_ACCENTED[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True


def words(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased texts; marks behind a letter at a word's end are a word of their own."""
    n = len(low)
    black = ~_SPACE[low]
    start = black.copy()
    start[1:] &= ~black[:-1]
    inside = at[(at > 0) & (at < n)]
    start[inside] = black[inside]
    stop = np.flatnonzero(_STOPS[low])
    if len(stop):
        letter = np.zeros(len(stop), bool)
        has = stop > 0
        before = low[stop[has] - 1]
        letter[has] = _LOWER[before] | (_ACCENTED[before] & (stop[has] > 1) & (low[stop[has] - 2] == 0xC3))
        letter &= ~start[stop]
        last = np.append(np.diff(stop) != 1, True)  # the last one of a run of stops
        close = stop[last] + 1
        ends = close == n
        ends[~ends] = ~black[close[~ends]] | start[close[~ends]]
        run = np.cumsum(last) - last
        start[stop[letter & ends[run]]] = True
    begin = np.flatnonzero(start)
    white = np.flatnonzero(~black)
    end = np.append(begin[1:], n)[: len(begin)]
    if len(white):
        where = np.searchsorted(white, begin)
        end = np.minimum(end, np.where(where < len(white), white[np.minimum(where, len(white) - 1)], n))
    return begin, end


def _no_words() -> list[np.ndarray]:
    return [*[np.empty(0, np.uint64) for _ in range(3)], np.empty(0, np.int64), np.empty(0, np.int64)]


def _merged(one: list[np.ndarray], other: list[np.ndarray]) -> list[np.ndarray]:
    """Two tables of words in the order of hashes as one; sorting joins two sorted runs."""
    order = np.argsort(np.concatenate([one[0], other[0]]), kind="stable")
    return [np.concatenate([a, b])[order] for a, b in zip(one, other, strict=True)]


def word_keys(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hash, first and last eight bytes and length of each word."""
    sums, down = prefix_hash(low, 0x9E3779B97F4A7C15)
    size = end - begin
    h = mix((sums[end] - sums[begin]) * down[begin] + size.astype(np.uint64))
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(low) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    own = _FIRST[np.minimum(size, 8)]
    return [h, eight[begin] & own, eight[np.maximum(end - 8, begin)] & own, size]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenise(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (little-endian, two bytes each), n: the text's token ids and the end token."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:  # kept by the worker for its next task
            _TOKENIZERS[tokenizer] = WordTokenizer(tokenizer)
        own = _TOKENIZERS[tokenizer]
        for part, data, at in blocks(batches, "text", BLOCK):
            ids, bounds = own.encode_block(data, at)
            n = np.diff(bounds) + 1
            out = np.insert(ids, bounds[1:], END).astype("<u2")
            offsets = pa.py_buffer((2 * np.concatenate([[0], np.cumsum(n)])).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array(n)], ["id", "ids", "n"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, n long")


def document_frequencies(tokens: DataFrame, vocabulary: int = 1 << 16) -> np.ndarray:
    """For each token id the number of documents that have it; the driver reads at most `vocabulary` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(vocabulary, np.int64)
        for _, data, at in blocks(batches, "ids", 8 << 20):
            term, _, _ = term_counts(np.frombuffer(data.tobytes(), "<u2"), at // 2)
            found += np.bincount(term, minlength=vocabulary)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], ["term", "df"])

    table = tokens.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[table.column("term").to_numpy()] = table.column("df").to_numpy()
    return out


def term_counts(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and number of occurrences, in the order of terms and then of documents."""
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    code = np.sort((ids.astype(np.uint64) << np.uint64(32)) | doc)
    starts = runs(code)
    code = code[starts[:-1]]
    return (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64), np.diff(starts)


class _Index:
    """Inverted index of a shard: for each term the items that have it, with BM25 weights.

    Items that are used up are dropped from it whenever a quarter of them are, so that most of what a seed looks at can still be packed.
    """

    def __init__(self, ids: np.ndarray, at: np.ndarray, idf: np.ndarray, average: float, terms: int | None):
        term, item, tf = term_counts(ids, at)
        w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.diff(at)[item] / average))
        self.n = len(at) - 1
        order = np.argsort(item.astype(np.uint16) if self.n <= 1 << 16 else item, kind="stable")
        best = np.ones(len(item), bool)
        if terms is not None:
            best[:] = False
            bounds = np.searchsorted(item[order], np.arange(self.n + 1))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = order[a:b]
                best[own[np.argpartition(-w[own], terms)[:terms]] if b - a > terms else own] = True
        term, self.item, self.weight = term[best], item[best], w[best].astype(np.float32).astype(float)
        self.bounds = np.searchsorted(term, np.arange(len(idf) + 1))
        self.held = self.n
        order = np.argsort(self.item, kind="stable")
        self.queries = np.split(term[order].astype(np.int64), np.searchsorted(self.item[order], np.arange(1, self.n)))

    def _drop(self, unused: np.ndarray) -> None:
        left = int(np.count_nonzero(unused))
        if 4 * left < 3 * self.held:
            keep = unused[self.item]
            self.bounds = np.concatenate([[0], np.cumsum(keep)])[self.bounds]
            self.item, self.weight, self.held = self.item[keep], self.weight[keep], left

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused items that share terms with the seed, best first."""
        return np.fromiter(self.nearest(seed, unused), np.int64)

    def nearest(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """As neighbours, one by one; few of many are asked for, so the best FIRST are sorted before the others."""
        self._drop(unused)
        terms = self.queries[seed]
        spans = [slice(a, b) for a, b in zip(self.bounds[terms].tolist(), self.bounds[terms + 1].tolist(), strict=True)]
        items = np.concatenate([self.item[s] for s in spans])
        score = np.bincount(items, np.concatenate([self.weight[s] for s in spans]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        best = np.ones(len(found), bool)
        if len(found) > FIRST:
            own = score[found]
            best = own >= np.partition(own, -FIRST)[-FIRST]
        for some in (best, ~best):
            part = found[some]
            yield from part[np.argsort(-score[part], kind="stable")].tolist()


def pack_shard(sizes: np.ndarray, index_of: Callable, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given sizes; index_of(starts) indexes their tails."""
    sequence = 0
    starts = sizes // window * window
    for doc in np.flatnonzero(starts).tolist():
        for at in range(0, int(starts[doc]), window):
            yield doc, at, window, sequence, 0
            sequence += 1
    unused = sizes > starts
    if not unused.any():
        return
    starts, sizes = starts.tolist(), sizes.tolist()
    index = index_of(starts)
    pieces: list[tuple[int, int, int]] = []  # of the open sequence
    room = window
    upcoming, k = np.flatnonzero(unused).tolist(), 0

    def add(doc: int) -> bool:
        """Put the document's rest, or as much as fits, into the open sequence; true if all of it fitted."""
        nonlocal room
        n = min(room, sizes[doc] - starts[doc])
        pieces.append((doc, starts[doc], n))
        starts[doc] += n
        room -= n
        if starts[doc] == sizes[doc]:
            unused[doc] = False
            return True
        return False

    seed = None
    while True:
        while k < len(upcoming) and not unused[upcoming[k]]:
            k += 1
        if seed is None or not unused[seed]:
            if k == len(upcoming):
                break
            seed = upcoming[k]
        first, seed = seed, None
        cut = None if add(first) else first
        if room:
            for doc in index.nearest(first, unused):
                if not add(doc):
                    cut = doc
                if not room:
                    break
        if not room:
            offset = 0
            for doc, start, n in pieces:
                yield doc, start, n, sequence, offset
                offset += n
            sequence, room, pieces, seed = sequence + 1, window, [], cut
    left, bit = window - room, window
    while left:  # the last sequences have lengths that are powers of two
        while bit > left:
            bit //= 2
        offset = 0
        while offset < bit:
            doc, start, n = pieces.pop(0)
            take = min(n, bit - offset)
            yield doc, start, take, sequence, offset
            offset += take
            if take < n:
                pieces.insert(0, (doc, start + take, n - take))
        sequence, left = sequence + 1, left - bit


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, terms: int | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_tokens (of the sequence): one row for each piece.

    terms: how many of a document's best terms are posted and asked for; by default all are.
    """
    tokens = materialise(tokenise(df, tokenizer, id_col, text_col), "tokens")
    count, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df_counts = document_frequencies(tokens)
    idf = np.log1p((count - df_counts + 0.5) / (df_counts + 0.5))
    shared = df.sparkSession.sparkContext.broadcast((idf, max(1.0, total / max(1, count))))  # of the vocabulary's size
    shards = max(1, -(-total // shard_tokens))
    dealt = tokens.withColumn("shard", F.pmod(F.xxhash64("id", "n"), F.lit(shards)))
    # by range, so that each partition has as many shards as any other
    dealt = dealt.repartitionByRange(min(shards, 1 << 15), "shard").sortWithinPartitions("shard", "id")
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, average = shared.value
        _TOKENIZERS.clear()  # the worker's words are not needed any more
        _POWERS.clear()
        for rows, _ in whole_groups(batches, ["shard"]):
            shard = longs(rows.column("shard"))
            for number in np.unique(shard).tolist():
                part = rows.filter(pa.array(shard == number))
                data, at = text_bytes(part.column("ids"))
                ids, at = np.frombuffer(data.tobytes(), "<u2"), at // 2

                def index_of(starts: list[int], ids=ids, at=at) -> _Index:
                    size = np.diff(at) - starts
                    tails = np.repeat(at[1:] - np.cumsum(size), size) + np.arange(size.sum())
                    return _Index(ids[tails], np.concatenate([[0], np.cumsum(size)]), idf, average, terms)

                found = np.array(list(pack_shard(np.diff(at), index_of, window)), np.int64).reshape(-1, 5)
                doc, start, length, sequence, offset = found.T
                begin = at[doc] + start
                sums = [crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                total = np.bincount(sequence, length)[sequence].astype(np.int64)
                columns = [part.column("id").take(pa.array(doc)), start, length, np.array(sums, np.int64), np.diff(at)[doc], sequence + (number << 32), offset, total]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_tokens"]
    return dealt.mapInArrow(run, ", ".join(f"{n} {kind if n == 'doc_id' else 'long'}" for n in names))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL: dict[str, str] = {}
