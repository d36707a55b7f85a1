"""Shards get only segments that may share a window, very large groups are dealt out in parts, and results are those of a plain version."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from millwright.llm import suffix_dedup


def plain(rows, length):
    """id -> number of bytes, of removed bytes and of removed runs, and the hash of what is left."""
    seen, want = set(), {}
    for i, text in sorted(rows):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(b[k : k + length])
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        want[i] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return want


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def test_copies_alone_are_not_sorted(spark, monkeypatch):
    """A group's only different segment has no window in common with another one, so no suffix array is made for it."""

    def none(data, at):
        raise AssertionError(f"{len(at) - 1} segments were laid out")

    monkeypatch.setattr(suffix_dedup, "laid_out", none)
    text = words(random.Random(5), 150)
    docs = spark.createDataFrame([(k, text) for k in (2, 3, 1)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {1: (0, 0), 2: (len(text), 1), 3: (len(text), 1)}


def test_a_large_group_is_dealt_out_in_parts(spark):
    rng = random.Random(6)
    passage = words(rng, 40)
    rows = [(k, words(rng, rng.randint(0, 30)) + passage[rng.randint(0, 30) : rng.randint(150, 200)] + words(rng, 5)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    numbered, _ = suffix_dedup._numbered(docs, "doc_id", "text")
    found = suffix_dedup._repeatable(suffix_dedup._occurrences(numbered.select("doc", "text"), 100, 16), 100, 16, 16)
    sizes = {(r["key"], r["part"]): r["count"] for r in found.groupBy("key", "part").count().collect()}
    assert max(part for _, part in sizes) >= 3 and max(sizes.values()) <= 16
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(docs, most=2).collect()}  # parts of 16 segments
    assert got == plain(rows, 100) and sum(x[1] for x in got.values()) > 3000


def test_segments_of_a_frequent_anchor_are_dealt_out_as_numbers(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARE", 1)
    rng = random.Random(7)
    passage = words(rng, 40)
    rows = [(k, words(rng, rng.randint(0, 4)) + passage[rng.randint(0, 30) : rng.randint(150, 200)] + words(rng, 2)) for k in range(-100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    numbered = suffix_dedup._numbered(docs, "doc_id", "text")[0].select("doc", "text")
    dealt = suffix_dedup._dealt(numbered, 100, 16, 16)
    plainly, spread = (suffix_dedup._occurrences(numbered, 100, 16, x).groupBy("key").count().agg({"count": "max"}).first()[0] for x in (None, dealt))
    assert plainly > 200 and spread < 120  # codes of about 64 segments each
    key, salt = dealt.undo(dealt.codes)
    assert set(key) == set(dealt.keys) and salt.min() == 1 and dealt.undo(dealt.keys)[1].max() == 0
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(docs, most=2).collect()}
    assert got == plain(rows, 100)


@pytest.mark.parametrize(("length", "gram"), [(20, 5), (21, 5), (30, 8)])
@pytest.mark.parametrize("most", [1024, 1])
def test_other_lengths(spark, length, gram, most):
    """Passages in which single letters differ, so that windows agree on one side of an anchor only."""
    rng = random.Random(length)
    passages, rows = [words(rng, 12) for _ in range(4)], []
    for k in range(80):
        text = list(rng.choice(passages) + words(rng, 3) + rng.choice(passages))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((k, "".join(text)[rng.randint(0, 9) :]))
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, gram=gram, most=most).collect()}
    assert got == plain(rows, length)


def test_runs_of_spans():
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rows = [[{"start": 9, "end": 9}], None, [{"start": 5, "end": 8}, {"start": 0, "end": 3}, {"start": 2, "end": 5}], [], [{"start": 0, "end": 4}], [{"start": 0, "end": 2}, {"start": 3, "end": 9}]]
    spans = pa.array(rows, kind)[1:]  # a slice, as blocks give
    at = np.array([0, 4, 14, 14, 18, 23])
    owner, first, last = suffix_dedup.removed(spans, at)
    assert (owner.tolist(), first.tolist(), last.tolist()) == ([1, 3, 4, 4], [4, 14, 18, 21], [12, 18, 20, 23])
    assert [len(x) for x in suffix_dedup.removed(spans[:1], at[:2])] == [0, 0, 0]


def test_what_occurs_more_than_once():
    assert suffix_dedup.repeated(np.array([5, 1, 5, 2, 1, 9, 5])).tolist() == [True, True, True, False, True, False, True]
    assert suffix_dedup.repeated(np.zeros(0, np.uint64)).tolist() == []
