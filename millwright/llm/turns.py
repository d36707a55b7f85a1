"""Repair of conversations: the cheapest edits that make their roles follow `(s?(ua)+)?`, by generalised LR parsing.

The roles' initials are parsed by the LR tables of a small grammar. Where the next row does not fit, the parser forks: it
deletes the row, gives it another role or inserts an empty row. Stacks share their lower parts, and stacks with
equal tops merge: the one with the least cost stays, of equal costs the one whose audit (edits' initials in order) sorts first. That loses nothing:
equal tops accept the same continuations, and no audit is the beginning of another one of the same top and cost.

A conversation may be of any length: rows get one global order, blocks of it are parsed by themselves from each top that may
stand before them, and the blocks' results (least cost and audit from top to top) are composed, a bounded number at a time. What
leaves a conversation in one piece is its audit, which is one value of the result, a byte for each row.

Cases: a null role or text is one space; null conversations are one conversation, null turns come first; rows with one turn are taken
by role and text; a role that begins with none of s, u and a (or is empty) is never kept; repeated rows are duplicates; an empty table
gives empty results; texts of any length are only compared and looked at from their ends, not changed; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import groupby, islice, pairwise
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millwright.functions.prefix import global_order
from millwright.llm.common import materialise

#: The grammar of a conversation's initials, and the edits' costs.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "SP"), ("S", "s"), ("P", "ua"), ("P", "Pua"))
INSERT, DELETE, REROLE, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
BLOCK, FAN, PIECE = 256, 64, 4096

Stack = tuple[int, ...]
Path = tuple[int, str, Stack]  # cost, audit and stack


class Tables:
    """SLR tables of a grammar whose non-terminals are capital letters: states, transitions and the reductions of each state by what follows."""

    def __init__(self, grammar: Sequence[tuple[str, str]]):
        rules = [("", grammar[0][0]), *grammar]
        firsts: dict[str, set[str]] = {n: set() for n, _ in rules}
        follow: dict[str, set[str]] = {n: set() for n, _ in rules}
        follow[""].add("$")
        empty = {n for n, r in rules if not r}
        first = lambda x: firsts.get(x, {x})
        for _ in range(len(rules) ** 2):  # each pass adds something or all are complete
            for n, r in rules:
                for i, x in enumerate(r):
                    firsts[n] |= first(x) if all(y in empty for y in r[:i]) else set()
                    if x in follow:
                        rest = r[i + 1 :]
                        follow[x] |= set().union(*[first(y) for k, y in enumerate(rest) if all(z in empty for z in rest[:k])])
                        follow[x] |= follow[n] if all(y in empty for y in rest) else set()
                if all(y in empty for y in r):
                    empty.add(n)

        def closed(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            work = list(items)
            while work:
                k, dot = work.pop()
                below = rules[k][1][dot : dot + 1]
                new = {(j, 0) for j, (n, _) in enumerate(rules) if n and n == below} - items
                items |= new
                work += new
            return frozenset(items)

        states, self.move = [closed({(0, 0)})], {}
        for number, items in enumerate(states):  # grows while it is read
            for x in sorted({rules[k][1][dot] for k, dot in items if dot < len(rules[k][1])}):
                to = closed({(k, dot + 1) for k, dot in items if rules[k][1][dot : dot + 1] == x})
                if to not in states:
                    states.append(to)
                self.move[number, x] = states.index(to)
        self.reduce = {(number, x): rules[k] for number, items in enumerate(states) for k, dot in items if k and dot == len(rules[k][1]) for x in follow[rules[k][0]]}

    def advance(self, stack: Stack, terminal: str) -> Stack | None:
        """The stack after a terminal was shifted, or None where it does not fit; $ accepts."""
        while rule := self.reduce.get((stack[-1], terminal)):
            stack = stack[: len(stack) - len(rule[1])]
            stack = (*stack, self.move[stack[-1], rule[0]])
        if terminal == "$":
            return stack
        to = self.move.get((stack[-1], terminal))
        return None if to is None else (*stack, to)


@cache
def _tables() -> Tables:
    return Tables(GRAMMAR)


@cache
def _advance(stack: Stack, terminal: str) -> Stack | None:
    return _tables().advance(stack, terminal)


@cache
def entries() -> dict[str, Stack]:
    """Stacks that stand for all that may be on top between two rows: nothing yet, and the last initial."""
    out = {"": (0,)}
    for text in ("s", "u", "ua"):
        stack: Stack = (0,)
        for x in text:
            stack = _advance(stack, x)
        out[text[-1]] = stack
    return out


@cache
def kind_of(top: int) -> str:
    """The entry that accepts what this top accepts: the terminal that leads to it."""
    return next((x for (_, x), to in _tables().move.items() if to == top and x.islower()), "")


@cache
def accepts(stack: Stack) -> bool:
    end = _advance(stack, "$")
    return len(end) == 2 and (end[0], GRAMMAR[0][0]) in _tables().move and _tables().move[end[0], GRAMMAR[0][0]] == end[1]


def _merge(tops: dict[int, Path], cost: int, audit: str, stack: Stack | None) -> bool:
    """Keep the path if it is the first one of its top or better than the one that is there."""
    if stack is None:
        return False
    there = tops.get(stack[-1])
    if there is not None and there[:2] <= (cost, audit):
        return False
    tops[stack[-1]] = (cost, audit, stack)
    return True


def insertions(tops: dict[int, Path]) -> dict[int, Path]:
    """tops with all that inserted rows lead to."""
    work = sorted(tops.values())
    while work:
        cost, audit, stack = work.pop(0)
        for x in ROLES:
            to = _advance(stack, x)
            if _merge(tops, cost + INSERT, audit + "I", to):
                work.append((cost + INSERT, audit + "I", to))
    return tops


def parse(rows: Sequence[tuple[str, bool, bool]], entry: str) -> dict[str, tuple[int, str]]:
    """exit -> least cost and its audit, from an entry over rows (initial, to be deleted, truncated)."""
    tops = {entries()[entry][-1]: (0, "", entries()[entry])}
    for initial, gone, truncated in rows:
        after: dict[int, Path] = {}
        for cost, audit, stack in insertions(tops).values():
            _merge(after, cost + DELETE, audit + "D", stack)
            if gone:
                continue
            cost += TRUNCATED * truncated
            if initial in entries() and initial:
                _merge(after, cost, audit + "K", _advance(stack, initial))
            for x in ROLES:
                _merge(after, cost + REROLE, audit + "R", _advance(stack, x))
        tops = after
    out: dict[str, tuple[int, str]] = {}
    for top, (cost, audit, _) in tops.items():
        kind = kind_of(top)
        out[kind] = min(out.get(kind, (cost, audit)), (cost, audit))
    return out


Steps = dict[tuple[str, str], tuple[int, str]]  # (entry, exit) -> cost, audit


def compose(left: Steps, right: Steps) -> Steps:
    out: Steps = {}
    for (a, b), (c1, a1) in left.items():
        for (b2, c), (c2, a2) in right.items():
            if b == b2:
                new = (c1 + c2, a1 + a2)
                out[a, c] = min(out.get((a, c), new), new)
    return out


def finish(steps: Steps) -> tuple[int, str]:
    """Cost and audit of the whole conversation: from its beginning to an end that the grammar accepts."""
    best = []
    for (a, b), (cost, audit) in steps.items():
        if a == "":
            tops = insertions({entries()[b][-1]: (cost, audit, entries()[b])})
            best += [p[:2] for p in tops.values() if accepts(p[2])]
    return min(best)


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def replay(audit: str, initials: str) -> list[str]:
    """What comes of each row: pairs of an edit's initial and its role's, those of inserted rows before; insertions at the end go to the last row."""
    stack, at, own, out = entries()[""], 0, "", []
    for edit in audit:
        if edit == "D":
            own += "D-"
        else:
            x = initials[at] if edit == "K" else next(x for x in ROLES if _advance(stack, x) is not None)
            own += edit + x
            stack = _advance(stack, x)
        if edit != "I":
            at += 1
            out.append(own)
            own = ""
    if own:
        out[-1] += own
    return out


_STEPS = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
#: What is known of successive rows of a conversation: block, rank of the first row, initials, adjacent pairs that do not fit, and the paths through them.
_FRAGMENT = {"block": ("long", pa.int64()), "first": ("long", pa.int64()), "initials": ("string", pa.string()), "illegal": ("long", pa.int64()), "steps": ("array<struct<entry:string,exit:string,cost:long,audit:string>>", _STEPS)}
_REPAIR = {"piece": ("long", pa.int64()), "first": ("long", pa.int64()), "illegal": ("long", pa.int64()), "cost": ("long", pa.int64()), "audit": ("string", pa.string()), "tokens": ("array<string>", pa.list_(pa.string()))}


def _mapped(df: DataFrame, each: Callable[[Iterator[tuple]], Iterator[tuple]], fields: dict[str, tuple[str, pa.DataType]], size: int = 1000) -> DataFrame:
    """Rows (conv, *fields) that each makes of df's rows, partition by partition, in their order; df has a column conv."""
    kind = df.schema["conv"].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), *[(n, a) for n, (_, a) in fields.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = each(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        while held := list(islice(out, size)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ", ".join([f"conv {kind.simpleString()}", *[f"{n} {s}" for n, (s, _) in fields.items()]]))


def _fragments(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of rows (conv, block, rank, initial, to be deleted, truncated): the part of each conversation in each block."""
    last = None
    for (name, block), own in groupby(rows, itemgetter(0, 1)):
        own = list(own)  # of one block
        begins = entries() if last != block else ("",)  # only a block's first conversation may have begun before it
        last = block
        initials = "".join(r[3] for r in own)
        illegal = sum(not legal(a, b) for a, b in pairwise(initials))
        paths = [(a, b, *x) for a in begins for b, x in parse([r[3:] for r in own], a).items()]
        yield name, block, own[0][2], initials, illegal, _packed(paths)


def _packed(paths: Sequence[tuple[str, str, int, str]]) -> list[dict]:
    return [dict(zip(("entry", "exit", "cost", "audit"), p, strict=True)) for p in paths]


def _unpacked(row: tuple) -> tuple[int, int, str, int, Steps]:
    return *row[1:5], {(s["entry"], s["exit"]): (s["cost"], s["audit"]) for s in row[5]}


def _joined(own: list[tuple]) -> tuple:
    """One fragment of successive ones; composed by halves, so that audits are copied a few times only."""
    if len(own) == 1:
        return own[0]
    left, right = _joined(own[: len(own) // 2]), _joined(own[len(own) // 2 :])
    border = not legal(left[2][-1], right[2][0])
    return left[0], left[1], left[2] + right[2], left[3] + right[3] + border, compose(left[4], right[4])


def _composed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of fragments sorted by conv and block: one for each FAN blocks of a conversation."""
    for (name, block), own in groupby(rows, lambda r: (r[0], r[1] // FAN)):
        _, first, initials, illegal, steps = _joined([_unpacked(r) for r in own])
        yield name, block, first, initials, illegal, _packed([(*k, *x) for k, x in steps.items()])


def _finished(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of fragments sorted by conv and block: each conversation's repair; piece 0 has its cost and audit, every piece what comes of PIECE rows."""
    for name, own in groupby(rows, itemgetter(0)):
        _, first, initials, illegal, steps = _joined([_unpacked(r) for r in own])
        cost, audit = finish(steps)
        tokens = replay(audit, initials)
        for k in range(0, len(tokens), PIECE):
            head = (illegal, cost, audit) if not k else (None, None, None)
            yield name, k // PIECE, first + k, *head, tokens[k : k + PIECE]


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: a report with a row for each conversation of df (conv, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit),
    and the repaired turns (conv, rank and place, which order a conversation, edit, role, text).

    gaps are turns that are missing between the least and the greatest one; a row's first fault counts; illegal counts adjacent rows
    whose initials do not follow the grammar.
    """
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    rows = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))  # equal rows may be many; their order does not matter
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("spread")]
    ordered = global_order(rows, order).drop("total", "spread")

    bare = F.rtrim("text", F.lit(SPACE))
    new = ordered.filter(bare != "").groupBy("conv", "role", "text").agg(F.min("rank").alias("rank")).select("rank", F.lit(True).alias("new"))
    initial = F.when(F.col("role") == "", "?").otherwise(F.substring("role", 1, 1))
    facts = ordered.select("rank", "conv", "turn", initial.alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    facts = facts.join(new, "rank", "left").withColumn("duplicate", ~F.col("blank") & F.col("new").isNull())
    truncated = F.col("cut") & ~F.col("blank") & ~F.col("duplicate")
    facts = facts.select("conv", F.floor(F.col("rank") / BLOCK).alias("block"), "rank", "turn", "initial", "blank", "duplicate", truncated.alias("truncated"))
    facts = materialise(facts, "facts")

    dealt = facts.select("conv", "block", "rank", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
    fragments = materialise(_mapped(dealt.repartition("block").sortWithinPartitions("rank"), _fragments, _FRAGMENT), "fragments")
    together = lambda f: f.repartition("conv").sortWithinPartitions("conv", "block")
    while (fragments.groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > FAN:
        spread = fragments.repartition("conv", F.floor(F.col("block") / FAN)).sortWithinPartitions("conv", "block")
        fragments = materialise(_mapped(spread, _composed, _FRAGMENT), "fragments")
    repaired = materialise(_mapped(together(fragments), _finished, _REPAIR), "repaired")

    counts = facts.groupBy("conv").agg(
        F.count("*").alias("n_rows"), *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    heads = repaired.filter("piece = 0").select(F.col("conv").alias("__conv"), "illegal", "cost", "audit")
    report = counts.join(heads, F.col("conv").eqNullSafe(F.col("__conv"))).select("conv", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = repaired.select("first", F.posexplode("tokens").alias("i", "token")).select((F.col("first") + F.col("i")).alias("rank"), "token")
    edits = edits.select("rank", F.posexplode(F.regexp_extract_all("token", F.lit(".."), F.lit(0))).alias("place", "step"))
    edits = edits.select("rank", "place", F.substring("step", 1, 1).alias("edit"), F.substring("step", 2, 1).alias("x")).filter("edit != 'D'")
    name = F.when(F.col("edit") == "K", F.col("role")).when(F.col("x") == "u", ROLES["u"]).otherwise(ROLES["a"])
    said = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    turns = edits.join(ordered.select("rank", "conv", "role", "text"), "rank").select("conv", "rank", "place", "edit", name.alias("role"), said.alias("text"))
    return report, turns


def digests(turns: DataFrame) -> DataFrame:
    """conv, sha256: hash of a conversation's lines `role:text`, joined by newlines. Lines are read in order and not held."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for name, own in groupby(rows, itemgetter(0)):
            found = hashlib.sha256()
            for k, row in enumerate(own):
                found.update((b"\n" if k else b"") + row[1].encode("utf-8", "surrogatepass"))
            yield name, found.hexdigest()

    lines = turns.repartition("conv").sortWithinPartitions("conv", "rank", "place").select("conv", F.concat("role", F.lit(":"), "text").alias("line"))
    return _mapped(lines, each, {"sha256": ("string", pa.string())})


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults: by crc32 of `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), loses its ends of sentences (2), comes twice (3) or gets the role user (4)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(h == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    report, turns = repair(damaged(source))
    told = digests(turns).select(F.col("conv").alias("__told"), "sha256")
    ids = source.select("conv_id").distinct()
    out = ids.join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(told, F.col("conv_id").eqNullSafe(F.col("__told")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op13_turns": op13_turns}
ORACLE_SQL: dict[str, str] = {}
