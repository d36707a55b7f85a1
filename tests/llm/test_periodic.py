"""Periodic runs against a plain search for every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, shortest=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            own = w[start : start + length]
            if i > start and length >= max(shortest, exponent * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sequences():
    rng = random.Random(5)
    for _ in range(400):
        n, k = rng.randint(0, 70), rng.randint(1, 4)
        w = [rng.randint(1, k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randint(0, n - 1)
            p = 1 + (n - a) // rng.randint(3, 9)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        yield w


def test_runs_are_those_of_a_plain_search():
    for w in sequences():
        for shortest, exponent in ((6, 4), (1, 2), (4, 3)):
            found = [tuple(r) for r in periodic.runs_of(np.array(w, np.int64), shortest, exponent).tolist()]
            assert found == plain_runs(w, shortest, exponent), w


def test_blocks_of_several_texts_and_nested_runs(spark):
    texts = [" ".join(f"w{x}" for x in w) for w in sequences()] + [None, "", " \t\n", "a b " * 40 + "a b c " * 30, ("x " * 8 + "y ") * 9, "é é " * 12]
    rows = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "id long, text string, runs string").repartition(3)
    for exponent in (4, 2):
        got = {r["id"]: r for r in periodic.find_runs(rows, min_exponent=exponent).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w = WORD.findall(t or "")
            expected = plain_runs(w, 6, exponent)
            assert got[i]["n_words"] == len(w)
            assert [tuple(r) for r in got[i]["runs"]] == expected
            assert got[i]["collapsed"] == collapsed(w, expected)


def test_no_rows_and_bad_limits(spark):
    assert periodic.find_runs(spark.createDataFrame([], "text string")).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic.find_runs(spark.createDataFrame([], "text string"), min_exponent=1)


def test_a_long_looped_text(spark):
    text = " ".join(f"w{i % 700}" for i in range(30000))
    row = periodic.find_runs(spark.createDataFrame([(text,)], "text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 30000, 700)]
    assert row["collapsed"] == " ".join(f"w{i}" for i in range(700))


def test_op11_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, "q " * 50), (10**6, None), (10**6 + 1, "x"), (10**6 + 2, "")], "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(odd).withColumn("start", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in periodic.op11_runs(spark, str(tmp_path)).collect()}
    source = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    assert len(rows) == len(source)
    looped = 0
    for r in source:
        w = WORD.findall(r["text"] or "")
        n, h = len(w), 1 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        found, got = plain_runs(w), rows[r["doc_id"]]
        looped += len(found)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (got["n_runs"], got["start"], got["length"], got["period"]) == (len(found), *best)
        assert got["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
    assert looped > 3
