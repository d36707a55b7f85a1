"""Repair of conversations against a plain search for the cheapest edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from millwright.llm import turns

FOLLOWS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def cheapest(rows):
    """Cost and audit by Dijkstra's algorithm over (last initial, rows read)."""
    heap, seen = [(0, "", "", 0)], set()
    while True:
        cost, audit, last, i = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        if (last, i) in seen:
            continue
        seen.add((last, i))
        for x in "ua":
            if (last, x) in FOLLOWS:
                heapq.heappush(heap, (cost + 2, audit + "I", x, i))
        if i == len(rows):
            continue
        initial, gone, truncated = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", last, i + 1))
        if not gone:
            if (last, initial) in FOLLOWS:
                heapq.heappush(heap, (cost + truncated, audit + "K", initial, i + 1))
            for x in "ua":
                if (last, x) in FOLLOWS:
                    heapq.heappush(heap, (cost + 2 + truncated, audit + "R", x, i + 1))


def plain(rows):
    """The report and the text of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, facts = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        blank, duplicate = bare == "", bare != "" and (role, text) in seen
        seen.add((role, text))
        facts.append((blank, duplicate, bool(bare) and not duplicate and bare[-1] not in ".!?"))
    initials = [r[1][:1] for r in rows]
    cost, audit = cheapest([(i, f[0] or f[1], f[2]) for i, f in zip(initials, facts, strict=True)])
    lines, at, last = [], 0, ""
    for edit in audit:
        if edit != "D":
            x = initials[at] if edit == "K" else next(x for x in "ua" if (last, x) in FOLLOWS)
            role = rows[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[x]
            lines.append(role + ":" + ("" if edit == "I" else rows[at][2]))
            last = x
        at += edit != "I"
    known = {r[0] for r in rows} - {None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    counts = [sum(f[k] for f in facts) for k in range(3)]
    return (gaps, *counts, illegal, cost, audit), "\n".join(lines)


def made(n, seed):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["One.", "Two", "Three! \n", " ", "", None, "four?", "Zwei", "É…"]
    return [(rng.choice([None, 0, 1, 2, 3]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def check(report, told, rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    got, texts = {r["conv"]: r for r in report.collect()}, {r["conv"]: r["sha256"] for r in told.collect()}
    assert set(got) == set(groups)
    for conv, own in groups.items():
        expected, text = plain(own)
        assert tuple(got[conv][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == expected
        assert got[conv]["n_rows"] == len(own)
        assert texts.get(conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()


def test_tables_accept_the_grammar_only():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("sua") for _ in range(rng.randint(0, 7)))
        stack = turns.entries()[""]
        for x in text:
            stack = stack and turns._advance(stack, x)
        assert bool(stack and turns.accepts(stack)) == bool(re.fullmatch("(s?(ua)+)?", text)), text


def test_parts_compose_to_the_cheapest_edits():
    rng = random.Random(2)
    for _ in range(3000):
        rows = [(rng.choice("suauaua? "), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 10))]
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(2))
        parts = [{(a, b): x for a in turns.entries() for b, x in turns.parse(rows[i:j], a).items()} for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        whole = turns.compose(turns.compose(parts[0], parts[1]), parts[2])
        assert turns.finish(whole) == cheapest(rows)


@pytest.mark.parametrize("block", [3, 256])
def test_repair_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    monkeypatch.setattr(turns, "FAN", 2 if block == 3 else 64)
    monkeypatch.setattr(turns, "PIECE", 5)
    rows = made(60, block)
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, rank long, conv string").repartition(3)
    report, repaired = turns.repair(df)
    check(report, turns.digests(repaired), rows)


def test_one_long_conversation_is_cut_into_blocks(spark):
    rng = random.Random(4)
    rows = [("c", i // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "", f"{i}.", f"{i}!", f"{i}?"])) for i in range(2500)]
    report, repaired = turns.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(4))
    check(report, turns.digests(repaired), rows)


def test_no_rows(spark):
    report, repaired = turns.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.count() == 0 and repaired.count() == 0 and turns.digests(repaired).count() == 0


def test_op13_against_plain_python(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    odd = spark.createDataFrame([(c if c is None else c + 10**6, *r) for c, *r in made(80, 9)], source.select("conv_id", "turn", "role", "text").schema)
    source.select("conv_id", "turn", "role", "text").unionByName(odd).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = spark.read.parquet(str(tmp_path / "conversations.parquet")).collect()
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        groups[conv] += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    got = {r["conv_id"]: r for r in turns.op13_turns(spark, str(tmp_path)).collect()}
    assert set(got) == set(groups)
    for conv, own in groups.items():
        expected, text = plain(own) if own else ((0, 0, 0, 0, 0, 0, ""), "")
        assert tuple(got[conv][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == expected
        assert got[conv]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
