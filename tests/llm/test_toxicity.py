"""Toxicity: the automaton against plain edit distances, quotations, and learning on planted and given documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_what_edit_distances_find():
    rng = random.Random(1)
    for r in range(25):
        terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(12)} | ({"abca*", "bb*"} if r % 2 else set()))
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(150)]
        for t in terms:
            w = list(t.rstrip("*"))
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randint(0, 1)] = rng.choice(["", "d", "a"])
            words.append("".join(w) or "x")
        hits, term, edits = toxicity.Automaton(terms, known=words[:10]).match(toxicity.tokens(words))
        got = {int(i): (terms[t], int(e)) for i, t, e in zip(hits, term, edits, strict=True)}
        for i, w in enumerate(words):
            near = min(((distance(w, t), t) for t in terms if not t.endswith("*") and distance(w, t) <= toxicity.allowed_edits(t)), default=None)
            stem = max((t for t in terms if t.endswith("*") and w.startswith(t[:-1])), key=len, default=None)
            if near and near[0] == 0:
                assert got[i] == (near[1], 0)
            elif stem:
                assert got[i] == (stem, 0)
            elif near and w not in words[:10]:
                assert got[i][1] == near[0] == distance(w, got[i][0])
            else:
                assert i not in got


def test_quotations():
    texts = ['he said "you fool" and left', '"fool', "fool\n> fool\nfool", "« fool » fool „fool“", "fool”", "", '"a"fool"b"']
    t = toxicity.tokens(texts)
    words = ["".join(map(chr, t.codes[a:b])) for a, b in zip(t.starts, t.ends, strict=True)]
    found = [(int(k), bool(q)) for k, w, q in zip(t.text, words, toxicity.quoted(t), strict=True) if w == "fool"]
    assert found == [(0, True), (1, False), (2, False), (2, True), (2, False), (3, True), (3, False), (3, False), (4, False), (6, False)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "lu", "me", "no"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["scoundrel", "Numbskull", "dimwit"])
        rows.append((i, " ".join(w), int(toxic)))
    rows += [(1000 + i, rows[1][1], 0) for i in range(3)] + [(None, "scoundrel", 0), (2000, None, 0), (2001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(toxicity.labelled(docs.drop("toxic"), docs.select("doc_id", "toxic")))


def scored(spark, model, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, body string, toxic_score string")
    return {r["i"]: r for r in toxicity.score(df, model, "body").collect()}


def test_learns_terms_and_catches_misspellings(spark, planted):
    assert {"scoundrel", "numbskull", "dimwit"} <= set(planted.terms)
    plain = "ba do kiki lu me nono " * 8
    got = scored(spark, planted, [plain, plain + "SCOUNDREL you dimwit", plain + "scoumdrell you dimwitt nunbskull", "", None, "scoundrel"])
    assert got[0]["toxic_score"] < 0.5 < got[1]["toxic_score"]
    assert got[2]["toxic_score"] > 0.5 and [(h["term"], h["edits"]) for h in got[2]["toxic_hits"]] == [("scoundrel", 2), ("dimwit", 1), ("numbskull", 1)]
    assert got[3]["toxic_score"] == got[4]["toxic_score"] < 0.5
    hit = got[1]["toxic_hits"][0]
    assert (plain + "SCOUNDREL you dimwit")[hit["start"] : hit["start"] + hit["length"]] == "SCOUNDREL" and not hit["quoted"]


def test_quotation_scores_lower_than_abuse(spark, planted):
    plain = "ba do kiki lu me nono " * 8
    got = scored(spark, planted, [plain + "scoundrel dimwit " + plain, plain + '"scoundrel dimwit" ' + plain, plain + '"scoundrel" dimwit ' + plain, plain])
    assert got[1]["toxic_score"] < got[0]["toxic_score"] and all(h["quoted"] for h in got[1]["toxic_hits"])
    assert not any(h["quoted"] for h in got[2]["toxic_hits"])  # abuse that also quotes is abuse


def test_the_sample_is_bounded_and_copies_count_once(spark):
    docs = spark.createDataFrame([(i, f"t{i // 2}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    for most, expected in ((30, {0: 30, 1: 30}), (1000, {0: 100, 1: 100})):
        rows = toxicity.labelled(docs, labels, most=most).collect()
        assert {k: sum(r["toxic"] == k for r in rows) for k in (0, 1)} == expected
        assert len({r["text"] for r in rows}) == len(rows)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(2, 1)]):
        model = toxicity.fit(toxicity.labelled(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
        assert [r["toxic_score"] for r in toxicity.score(docs, model).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_op12_on_documents_it_has_not_learnt_from(spark):
    folder = "/root/testdata/sf0.1"
    rows = toxicity.op12_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    bad, good = (np.array([r["score"] for r in rows if r["held_out"] and r["toxic"] == k]) for k in (1, 0))
    assert len(bad) > 50 and (bad >= 0.5).mean() > 0.9 and (good >= 0.5).mean() < 0.01
    assert (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean() > 0.95
