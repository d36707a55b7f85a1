"""Toxicity: a learnt lexicon, misspelled terms by Levenshtein automata, and windows of context that tell quotation from abuse.

The lexicon is learnt from labelled documents: words, and stems (beginnings of words), that occur in more toxic documents than chance
explains; a term's weight is the log ratio of its rates per word. The terms form a trie. A Levenshtein automaton for each term
accepts what is a few edits away from it; all of them, intersected with the trie, run as one automaton, whose
states (sets of trie nodes with the edits spent) are made when a text first leads to them. Tokens of a block of texts walk it together.
Stems are matched without edits, and a word that clean documents use is no misspelling.

Each hit gets a window of words around it. Hits that stand within quotation marks or quoted lines count apart from those that do
not, unless their window has others that do not. A document's score is a logistic function of what its worst window, all its
hits and their density weigh, unquoted and quoted. The lexicon is learnt from at most LABELS documents of each kind, that function's weights
from at most SAMPLE of them, those with the least hash of the id; every text is scored whole.

Cases: a null text is empty; an empty text, and one without a hit, gets the score of no hits; without labelled
documents of both kinds every score is 0; rows that share an id share its label, an id or text labelled both ways is toxic;
labels without a document and null labels are not learnt from; a null id is scored but not learnt from; repeated rows are scored alike; terms of equal strength sort by text; an empty table
gives an empty one; columns that clash with the added ones are replaced. Tokens of over LONGEST letters are no terms; texts of any length are held one by one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import longs, materialise, prefix_hash, text_bytes

#: Bounds of the lexicon, by strength; of the labelled documents of each kind that it is learnt from; of those that the score's weights are fitted on.
TERMS, LABELS, SAMPLE = 5000, 100000, 20000
LONGEST, STEMS, LEAST_Z, LEAST_WEIGHT, WINDOW, BLOCK = 40, (4, 5, 6, 7), 5.0, 1.5, 25, 1 << 20
_BASE = 0x9E3779B97F4A7C15
FEATURES = ("worst", "all", "density", "quoted_worst", "quoted_density")
OPENS, CLOSES = "“„«‹「", "”»›」"


def allowed_edits(term: str) -> int:
    """Edits that a misspelling of a term may have: none below five letters, one below nine, two beyond."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Codes:
    """Lower-cased letters and digits by code point, found when they first occur."""

    def __init__(self) -> None:
        self.seen, self.word, self.lower = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code is of a word, and the codes in lower case."""
        new = np.flatnonzero(np.bincount(codes, minlength=1) > 0) if len(codes) else np.empty(0, int)
        for c in new[~self.seen[new]].tolist():
            x = chr(c)
            self.seen[c], self.word[c], low = True, x.isalnum(), x.lower()
            self.lower[c] = ord(low) if len(low) == 1 else c
        return self.word[codes], self.lower[codes]


_CODES: list[Codes] = []
#: The automaton of a worker's last model, with the states that its texts have led to.
_KEPT: dict[str, object] = {}


@dataclass(frozen=True)
class Tokens:
    """The words of several texts: lower-cased code points, start and end of each word, its text, and where each text starts."""

    codes: np.ndarray
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    at: np.ndarray


def tokens(texts: Sequence[str]) -> Tokens:
    if not _CODES:
        _CODES.append(Codes())
    at = np.cumsum([0, *map(len, texts)])
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    word, codes = _CODES[0](raw)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts, ends = np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1
    return Tokens(codes, raw, starts, ends, np.searchsorted(at, starts, side="right") - 1, at)


def quoted(t: Tokens) -> np.ndarray:
    """Whether each word stands in a quotation that ends in its line, or in a line that begins with >."""
    n = len(t.raw)
    line = np.zeros(n + 1, bool)
    line[t.at] = True
    line[1:] |= t.raw == 10
    begin = np.maximum.accumulate(np.where(line[:-1], np.arange(n), 0)) if n else np.empty(0, np.int64)
    stops = np.append(np.flatnonzero(line[1:]) + 1, n)
    end = stops[np.searchsorted(stops, t.starts, side="right")] if n else np.empty(0, np.int64)
    start = begin[t.starts]

    def upto(marks: str) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.isin(t.raw, [ord(m) for m in marks]))])

    straight, opens, closes = upto('"'), upto(OPENS), upto(CLOSES)
    inside = ((straight[t.starts] - straight[start]) % 2 == 1) & (straight[end] > straight[t.starts])
    open_ = (opens[t.starts] - opens[start] > closes[t.starts] - closes[start]) & (closes[end] > closes[t.starts])
    return inside | open_ | (t.raw[start] == ord(">")) if n else np.zeros(0, bool)


class Automaton:
    """Levenshtein automata of all terms of a lexicon, intersected with its trie and made deterministic as far as texts lead.

    terms are words, or stems if they end with *. step gives the next states; of a state, `word` has the number of the
    closest term that ends there (-1: none) and `edits` its edits, `stem` the longest stem that a token's beginning has spelled.
    """

    DEAD = 0

    def __init__(self, terms: Sequence[str], known: Sequence[str] = ()):
        self.terms, self.known = list(terms), set(known)
        letters = sorted({c for t in terms for c in t.rstrip("*")})
        self.classes = np.zeros(0x110000, np.int32)  # 0: a letter of no term
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.below: list[dict[int, int]] = [{}]
        self.ends, self.stems, self.most = [-1], [-1], [0]
        for k, term in enumerate(terms):
            stem, node = term.endswith("*"), 0
            budget = 0 if stem else allowed_edits(term)
            self.most[0] = max(self.most[0], budget)
            for c in term.rstrip("*"):
                x = int(self.classes[ord(c)])
                if x not in self.below[node]:
                    self.below[node][x] = len(self.below)
                    self.below.append({})
                    self.ends.append(-1)
                    self.stems.append(-1)
                    self.most.append(0)
                node = self.below[node][x]
                self.most[node] = max(self.most[node], budget)  # the most edits that a term below the node allows
            (self.stems if stem else self.ends)[node] = k
        self.budget = [0 if t.endswith("*") else allowed_edits(t) for t in terms]
        self.number: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.table = np.full((64, self.width), -1, np.int32)
        self.word, self.edits, self.stem = np.full(64, -1, np.int32), np.zeros(64, np.int32), np.full(64, -1, np.int32)
        self._state({})
        self.start = self._state({0: 0})

    def _state(self, spent: dict[int, int]) -> int:
        """The number of a state, with the nodes that letters of terms alone lead to (a letter left out is an edit)."""
        work = list(spent.items())
        while work:
            node, e = work.pop()
            if e == spent.get(node):
                for child in self.below[node].values():
                    if e + 1 <= self.most[child] and e + 1 < spent.get(child, 9):
                        spent[child] = e + 1
                        work.append((child, e + 1))
        key = tuple(sorted(spent.items()))
        if key in self.number:
            return self.number[key]
        n = self.number[key] = len(self.sets)
        self.sets.append(key)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.word, self.edits, self.stem = (np.concatenate([x, np.full_like(x, -1)]) for x in (self.word, self.edits, self.stem))
        ended = [(e, self.ends[v]) for v, e in key if self.ends[v] >= 0 and e <= self.budget[self.ends[v]]]
        self.edits[n], self.word[n] = min(ended, default=(0, -1))
        self.stem[n] = next((self.stems[v] for v, e in key if not e and self.stems[v] >= 0), -1)
        return n

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        out = self.table[states, letters]
        new = np.flatnonzero(out < 0)
        if len(new):
            for code in np.unique(states[new].astype(np.int64) * self.width + letters[new]).tolist():
                state, x = divmod(code, self.width)
                after: dict[int, int] = {}
                for node, e in self.sets[state]:
                    if e < self.most[node] or (not node and e < self.most[0]):
                        after[node] = min(after.get(node, 9), e + 1)  # a letter too many
                    for y, child in self.below[node].items():
                        cost = e + (x != y)  # the letter, or another one in its place
                        if cost <= self.most[child] or not cost:
                            after[child] = min(after.get(child, 9), cost)
                self.table[state, x] = self._state(after)
            out = self.table[states, letters]
        return out

    def match(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that are hits, the number of the term of each, and its edits. A word's own term goes before a stem, and a stem before a misspelling."""
        state = np.full(len(t.starts), self.start, np.int32)
        stem = np.full(len(t.starts), -1, np.int32)
        word, edits = stem.copy(), np.zeros(len(t.starts), np.int32)
        alive, at, length = np.flatnonzero(t.ends - t.starts <= LONGEST), 0, t.ends - t.starts
        classes = self.classes[t.codes]
        while len(alive):
            state[alive] = self.step(state[alive], classes[t.starts[alive] + at])
            found = self.stem[state[alive]]
            stem[alive] = np.where(found >= 0, found, stem[alive])
            at += 1
            done = alive[length[alive] == at]
            word[done], edits[done] = self.word[state[done]], self.edits[state[done]]
            alive = alive[(length[alive] > at) & (state[alive] != self.DEAD)]
        near = (word >= 0) & (edits > 0) & (stem < 0)
        if self.known:
            own = np.flatnonzero(near)
            text = t.codes.tobytes()
            near[own] = [text[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") not in self.known for a, b in zip(t.starts[own].tolist(), t.ends[own].tolist(), strict=True)]
        exact = (word >= 0) & (edits == 0)
        term = np.where(exact | near, word, stem)
        hits = np.flatnonzero(term >= 0)
        return hits, term[hits], np.where(near[hits], edits[hits], 0)


@dataclass(frozen=True)
class Model:
    terms: list[str]
    weights: np.ndarray
    known: list[str]  # words near a term that are words of their own
    coefficients: np.ndarray | None  # of 1 and FEATURES; None: nothing could be learnt

    def automaton(self) -> Automaton:
        return Automaton(self.terms, self.known)


@dataclass(frozen=True)
class Hits:
    """What was found in several texts: for each hit its word, term, edits, weight, whether it counts as quoted, and its window's weight."""

    word: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    quoted: np.ndarray
    window: np.ndarray
    features: np.ndarray  # texts x FEATURES


def found_in(t: Tokens, automaton: Automaton, weights: np.ndarray) -> Hits:
    n = len(t.at) - 1
    word, term, edits = automaton.match(t)
    weight = weights[term] * 0.7**edits if len(term) else np.empty(0)
    own, text = quoted(t)[word], t.text[word]
    words = np.bincount(t.text, minlength=n)
    first = np.cumsum(words) - words
    low, high = np.maximum(word - WINDOW, first[text]), np.minimum(word + WINDOW + 1, first[text] + words[text])
    a, b = np.searchsorted(word, low), np.searchsorted(word, high)

    def around(w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(w)])
        return sums[b] - sums[a]

    own = own & (around(weight * ~own) == 0)  # abuse that also quotes is abuse
    direct, cited = weight * ~own, weight * own
    window = around(direct)

    def worst(w: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, text, np.where(of, w, 0))
        return out

    total, cited_total = np.bincount(text, direct, n), np.bincount(text, cited, n)
    features = [np.log1p(worst(window, ~own)), np.log1p(total), np.log1p(100 * total / (words + 50)), np.log1p(worst(around(cited), own)), np.log1p(100 * cited_total / (words + 50))]
    return Hits(word, term, edits, own, np.where(own, around(cited), window), np.stack(features, axis=1))


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about BLOCK bytes of text, or one row, and their texts; null is empty."""
    for batch in batches:
        data, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        raw, first = data.tobytes(), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, side="right")) - 1)
            ends = at[first : last + 1].tolist()
            yield batch.slice(first, last - first), [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            first = last


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELS) -> DataFrame:
    """id, toxic, text of documents with a label, equal texts once (toxic if one of them is), so that copies don't make a term strong.

    At most `most` documents of each kind, those with the least hash of the id: that bounds the broadcast of their ids, and no text is shuffled.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null").withColumn("mark", F.xxhash64("text"))
    marks = rows.select("id", "mark").join(known, "id")
    marks = materialise(marks.groupBy("mark").agg(F.min("id").alias("id"), (F.max("toxic") > 0).alias("toxic")), "marks")
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = marks.limit(0)
    for kind, n in sizes.items():
        place = F.xxhash64("id", F.lit(1))
        own = marks.filter(F.col("toxic") == kind).filter(F.shiftrightunsigned(place, 11) / 2.0**53 <= 1.2 * most / n)  # spares the order most rows
        chosen = chosen.unionByName(own.orderBy(place, "id").limit(most))
    return rows.join(F.broadcast(chosen), ["id", "mark"]).select("id", F.col("toxic").cast("int").alias("toxic"), "text")


def _counts(train: DataFrame) -> DataFrame:
    """term, bad, good (documents with it), bad_n, good_n (occurrences), over words and stems (ending with *) of train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _texts(batches, "text"):
            t = tokens(texts)
            toxic = longs(rows.column("toxic"))[t.text] > 0 if len(t.text) else np.empty(0, bool)
            sums, down = prefix_hash(t.codes, _BASE)
            length, text = t.ends - t.starts, t.codes.tobytes()
            for size in (0, *STEMS):
                own = np.flatnonzero((length <= LONGEST) & (length >= 3) if not size else length > size)
                ends = t.ends[own] if not size else t.starts[own] + size
                key = (sums[ends] - sums[t.starts[own]]) * down[t.starts[own]]
                _, first, which = np.unique(key, return_index=True, return_inverse=True)
                pair = np.unique(np.stack([which, t.text[own]]), axis=1) if len(own) else np.empty((2, 0), np.int64)
                bad = longs(rows.column("toxic"))[pair[1]] > 0
                names = [text[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") + ("*" if size else "") for a, b in zip(t.starts[own][first].tolist(), ends[first].tolist(), strict=True)]
                many = [np.bincount(pair[0][bad], minlength=len(first)), np.bincount(pair[0][~bad], minlength=len(first)), np.bincount(which[toxic[own]], minlength=len(first)), np.bincount(which[~toxic[own]], minlength=len(first))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(x.astype(np.int64)) for x in many]], ["term", "bad", "good", "bad_n", "good_n"])

    out = train.select("text", "toxic").mapInArrow(run, "term string, bad long, good long, bad_n long, good_n long")
    return out.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("bad", "good", "bad_n", "good_n")])


def _strength(n_bad: int, n_good: int) -> Column:
    """The root of the likelihood ratio statistic of a term's documents against equal shares of both kinds; 0 if clean documents have the larger share."""
    n, share = F.col("bad") + F.col("good"), n_bad / (n_bad + n_good)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(0.0)
    g = part("bad", share) + part("good", 1 - share)
    return F.when(F.col("bad") > n * share, F.sqrt(2 * F.greatest(g, F.lit(0.0)))).otherwise(0.0)


def _telling(strength: dict[str, float]) -> set[str]:
    """All terms but the stems that are no stronger than a longer term that begins with them: those tell nothing more."""
    order = sorted(strength)
    kept = set()
    for term in order:
        stem, k = term.rstrip("*"), bisect_left(order, term.rstrip("*"))
        longer = takewhile(lambda t: t.startswith(stem), islice(order, k, None))
        if not term.endswith("*") or all(strength[t] < strength[term] for t in longer if t != term):
            kept.add(term)
    return kept


def _near(counts: DataFrame, automaton: Automaton) -> DataFrame:
    """Words of counts that are misspellings of a term."""
    shared = counts.sparkSession.sparkContext.broadcast((automaton.terms,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(*shared.value)
        for b in batches:
            hits, _, edits = auto.match(tokens(b.column(0).to_pylist()))  # a word is one token
            yield b.take(pa.array(hits[edits > 0]))

    return counts.filter(~F.col("term").endswith("*")).select("term").mapInArrow(run, "term string")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of 1 and the columns of x by Newton's method, with a penalty on all but the first."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(train: DataFrame) -> Model:
    """The model of documents id, toxic, text: the strongest TERMS words and stems, and the score's coefficients."""
    train = materialise(train, "labelled")
    sizes = {bool(r["toxic"]): r["n"] for r in train.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}  # two rows
    n_bad, n_good = sizes.get(True, 0), sizes.get(False, 0)
    if not n_bad or not n_good:
        return Model([], np.empty(0), [], None)
    counts = materialise(_counts(train), "terms")
    total = counts.filter(~F.col("term").endswith("*")).agg(F.sum("bad_n"), F.sum("good_n")).first()
    weight = F.log((F.col("bad_n") + 0.5) / (float(total[0] or 0) + 1)) - F.log((F.col("good_n") + 0.5) / (float(total[1] or 0) + 1))
    strong = counts.select("term", weight.alias("weight"), _strength(n_bad, n_good).alias("z")).filter((F.col("z") >= LEAST_Z) & (F.col("weight") >= LEAST_WEIGHT))
    rows = strong.orderBy(F.desc("z"), "term").limit(TERMS).collect()  # the lexicon's bound
    kept = _telling({r["term"]: r["z"] for r in rows})
    terms, weights = [r["term"] for r in rows if r["term"] in kept], np.array([r["weight"] for r in rows if r["term"] in kept], float)
    bare = Model(terms, weights, [], None)
    known = [r["term"] for r in _near(counts.filter("good > 0"), bare.automaton()).limit(20 * TERMS).collect()] if terms else []
    bare = Model(terms, weights, known, None)
    sample = _mapped(train, bare, text_col="text").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("toxic", "__features").toPandas()
    x = np.array(sample["__features"].tolist(), float).reshape(len(sample), len(FEATURES))
    return Model(terms, weights, known, logistic(x, (sample["toxic"].to_numpy() > 0).astype(float)))


def _mapped(df: DataFrame, model: Model, text_col: str, score: str = "", spans: str = "") -> DataFrame:
    """df with __features (score empty), or with the score and (where named) the hits' spans."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by TERMS and what is near them
    added = {score: "double"} if score else {"__features": "array<double>"}
    if spans:
        added[spans] = "array<struct<start:int,length:int,term:string,edits:int,quoted:boolean,window:double>>"
    df = df.drop(*added)
    kept = df.columns
    schema = df.select("*", *[F.lit(None).cast(kind).alias(n) for n, kind in added.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if _KEPT.get("terms") != (m.terms, m.known):
            _KEPT.update(terms=(m.terms, m.known), automaton=m.automaton())
        automaton, names = _KEPT["automaton"], np.array([*m.terms, ""], object)
        for rows, texts in _texts(batches, text_col):
            t = tokens(texts)
            hits = found_in(t, automaton, m.weights)
            if not score:
                new = [pa.array(hits.features.tolist(), pa.list_(pa.float64()))]
            elif m.coefficients is None:
                new = [pa.array(np.zeros(len(texts)))]
            else:
                new = [pa.array(1 / (1 + np.exp(-np.clip(m.coefficients[0] + hits.features @ m.coefficients[1:], -30, 30))))]
            if spans:
                w, text = hits.word, t.text[hits.word]
                fields = {"start": pa.array((t.starts[w] - t.at[text]).astype(np.int32)), "length": pa.array((t.ends[w] - t.starts[w]).astype(np.int32)), "term": pa.array(names[hits.term].tolist(), pa.string()), "edits": pa.array(hits.edits.astype(np.int32)), "quoted": pa.array(hits.quoted), "window": pa.array(hits.window)}
                new.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields))))
            yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*kept, *added])

    return df.mapInArrow(run, schema)


def score(df: DataFrame, model: Model, text_col: str = "text", prefix: str = "toxic_") -> DataFrame:
    """df with toxic_score (0 to 1) and toxic_hits: of each hit its start and length in characters, term, edits, whether it is a quotation, and its window's weight."""
    return _mapped(df, model, text_col, f"{prefix}score", f"{prefix}hits")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose label is never learnt from: crc32 of the id's text leaves 0 when divided by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(labelled(docs.filter(~held_out()), labels.filter(~held_out())))
    out = score(docs.select("doc_id", "text"), model)
    found = F.col("toxic_hits")
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.size(found).alias("n_hits"), F.size(F.filter(found, lambda h: h["quoted"])).alias("n_quoted"))


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLE_SQL: dict[str, str] = {}
