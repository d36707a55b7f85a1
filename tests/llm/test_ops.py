"""The corpus operators against brute force, on small tables with hard cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millwright.llm import components, decontaminate, exact_dedup, hilbert, langid, packing, paragraphs, simhash, suffix_dedup, urlfilter
from millwright.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, id string, row long, fp long"
WORDS = [a + b for a in ("ba", "ko", "ti", "mu", "sel", "dor", "gan", "vix") for b in ("ra", "lin", "po", "th", "e", "us", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty, blank and long texts, accents, ties."""
    rng = random.Random(5)
    passage, base = prose(rng, 60), prose(rng, 120)
    out = [(prose(rng, rng.randint(1, 90)), "en") for _ in range(40)]
    out += [(base, "en")] * 3 + [(base.upper(), "fr")] + [(" ".join(w if rng.random() > 0.03 else "xyzzy" for w in base.split()), "en") for _ in range(8)]
    out += [(prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 20), "de") for _ in range(4)]
    out += [(None, None), ("", "en"), ("  \t\n ", "en"), ("1234 !!", None), ("Ünïcödé É " * 40, "fr"), ("a" * 700, "en"), (prose(rng, 6000), "en"), ("x", "en"), ("é", "fr")]
    out += [(prose(rng, 15) + " " + base[50:400] + " " + prose(rng, 15), "en") for _ in range(3)]
    return [(i, t, lang, f"s{i % 3}", "clash", 7, 1) for i, (t, lang) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(docs, rows, digest_bytes):
    """With one byte of identifier chunks clash, and verification must tell them apart."""
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r[0]: tuple(r[1:]) for r in exact_dedup.duplicate_groups(docs, digest_bytes=digest_bytes).collect()}
    assert got == want


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup_repeated_ids_with_other_texts(spark, digest_bytes):
    rng = random.Random(3)
    texts = [prose(rng, 900) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[0]), (3, texts[3]), (3, texts[3])]
    size = Counter(t for _, t in rows)
    got = exact_dedup.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), digest_bytes=digest_bytes).collect()
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    assert len(got) == len(rows) and all(r.group_size == size[digest[r.text_sha256]] for r in got)
    assert sorted((r.keep_id or 0, r.group_size) for r in got) == [(0, 1), (1, 1), (2, 2), (2, 2), (3, 3), (3, 3), (3, 3)]


def test_exact_dedup_rows_without_ids_and_twice(spark, empty):
    twice = spark.createDataFrame([(None, "a"), (None, "A"), (3, "b"), (3, "b"), (4, "b")], "doc_id long, text string")
    got = exact_dedup.duplicate_groups(twice).collect()
    assert sorted((r.keep_id or -1, r.group_size) for r in got) == [(-1, 2), (-1, 2), (4, 3), (4, 3), (4, 3)]
    assert sum(r.kept for r in got) == 2
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(twice).collect() if r.doc_id) == [4]


def test_chunks_follow_content():
    data = np.frombuffer(prose(random.Random(1), 9000).encode(), np.uint8)
    cuts = set(exact_dedup.cut_points(data, np.array([0])).tolist())
    moved = set((exact_dedup.cut_points(np.append(np.frombuffer(b"inserted ", np.uint8), data), np.array([0])) - 9).tolist())
    assert len(cuts & moved) >= len(cuts) - 3


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


@pytest.mark.parametrize("most", [4096, 1])
def test_simhash(docs, rows, most):
    """With most = 1 every bucket is dealt out again, at three levels."""
    fps = [fingerprint(r[1]) for r in rows]
    root = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(docs, most=most).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in range(len(rows))}


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("level", [0, 1, 2])
def test_masks_cover_every_pair(level):
    rng, found = np.random.default_rng(0), [m & ((1 << 64) - 1) for m in simhash.masks(4, level)]
    assert len(found) == 31
    for _ in range(3000):
        spot = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not m & spot for m in found)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(300, 300)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100} | {200 + i: 100 for i in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [8192, 3])
def test_suffix_dedup(docs, rows, most):
    """With most = 3 groups are cut into several shards whose windows are merged."""
    seen, want = set(), {}
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        want[r[0]] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(docs, most=most).collect()}
    assert got == want


def test_suffix_dedup_long_text_is_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    data = np.frombuffer(prose(random.Random(2), 900).encode(), np.uint8)
    docs = spark.createDataFrame([(1, data.tobytes().decode()), (2, data[700:3000].tobytes().decode()), (None, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {1: (len(data), 0, 0), 2: (2300, 2300, 1), None: (5, 0, 0)}


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_text_ids_repeated_and_null_ids(spark):
    """Rows that repeat id and text are one document; other texts with the same id, or none, are documents of their own."""
    rng = random.Random(12)
    one, two = prose(rng, 60), prose(rng, 60)
    rows = [("b", one), ("b", one), ("a", two), ("c", "x" + one), (None, two + "!"), (None, one[:200]), ("c", None)]
    got = sorted((r.doc_id or "", r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    n, m = len(one), len(two)
    # those without an id are the first documents
    assert got == sorted([("a", m, m), ("b", n, 200), ("b", n, 200), ("c", n + 1, n), ("", m + 1, 0), ("", 200, 0), ("c", 0, 0)])


def test_suffix_dedup_sorts_copies_once(spark, monkeypatch):
    """A shard's strings differ, and copies are removed all the same: of three documents with the same text the first one stays."""
    laid_out = suffix_dedup.laid_out

    def different(data, at):
        strings = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert len(set(strings)) == len(strings)
        return laid_out(data, at)

    monkeypatch.setattr(suffix_dedup, "laid_out", different)
    text = prose(random.Random(4), 200)
    docs = spark.createDataFrame([(k, text) for k in (3, 1, 2)] + [(4, "x" + text[7:])], "doc_id long, text string")
    n = len(text)
    for most in (1024, 2):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs, most=most).collect()}
        assert got == {1: (n, 0, 0), 2: (n, n, 1), 3: (n, n, 1), 4: (n - 6, n - 7, 1)}
    assert suffix_dedup.first_copies(pa.array([b"b", b"a", b"b", b"", b"a", b"c"], pa.binary())[1:]).tolist() == [True, True, True, False, True]


def test_suffix_dedup_needs_one_python_worker_in_a_task(docs):
    """Texts go through one Python worker between two exchanges; a second one costs as much memory again."""

    def most(plan):
        below = [plan.children().apply(k) for k in range(plan.children().size())]
        own = max((most(x) for x in below), default=0) if plan.nodeName() != "Join" else 0
        return own + (plan.nodeName() == "MapInArrow")

    assert most(suffix_dedup.remove_repeats(docs)._jdf.queryExecution().optimizedPlan()) == 1


def plain_suffixes(strings):
    """(string, place) of all suffixes in order; a string's end is less than any byte and than the ends of later strings."""
    found = [(k, i) for k, s in enumerate(strings) for i in range(len(s) + 1)]
    return sorted(found, key=lambda f: [(b + 1, 0) for b in strings[f[0]][f[1] :]] + [(0, f[0])])


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    strings = [rng.integers(0, 3, 200), rng.integers(97, 99, 150), np.full(90, 97), np.full(120, 0), np.zeros(0), np.array([255, 0]), np.full(90, 97), rng.integers(0, 256, 100)]
    strings = [x.astype(np.uint8).tobytes() for x in [*strings, strings[0]]]
    at = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
    symbols, lanes = suffix_dedup.laid_out(np.frombuffer(b"".join(strings), np.uint8), at)
    order = suffix_dedup.suffix_array(symbols, lanes)
    want = plain_suffixes(strings)
    owner = np.searchsorted(lanes, order, side="right") - 1
    assert list(zip(owner.tolist(), (order - lanes[owner]).tolist(), strict=True)) == want
    for count in (np.diff(lanes), np.maximum(np.diff(lanes) - 40, 0), np.minimum(np.diff(lanes), 20)):  # all suffixes, and the first ones of each string
        partly = suffix_dedup.suffix_array(symbols, lanes, count)
        some = partly[partly - lanes[np.searchsorted(lanes, partly, side="right") - 1] < count[np.searchsorted(lanes, partly, side="right") - 1]]
        assert some.tolist() == order[order - lanes[owner] < count[owner]].tolist()
        found = [x for x in want if x[1] < count[x[0]]]
        lcp = suffix_dedup.common_prefixes(symbols, some, lanes, count, 100)
        for k in range(1, len(some)):
            a, b = (strings[i][j:] for i, j in found[k - 1 : k + 1])
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, 100)


def test_merging_by_binary_search():
    def table(*rows):
        return np.array([r[0] for r in rows], "S3"), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)

    merged, lost = suffix_dedup.merge_tables(table((b"abc", 1, 5), (b"b\xff\x00", 4, 0)), table((b"abc", 1, 2), (b"abd", 9, 9), (b"b\xff\x00", 7, 0), (b"\xff\xff\xff", 1, 1)))
    assert list(zip(*(x.tolist() for x in merged), strict=True)) == [(b"abc", 1, 2), (b"abd", 9, 9), (b"b\xff", 4, 0), (b"\xff\xff\xff", 1, 1)]
    assert list(zip(*(x.tolist() for x in lost), strict=True)) == [(1, 5), (7, 0)]


def plain_paragraphs(rows):
    """(id, start, words) of each paragraph; the places are those of cut(), the words are found by a regular expression."""
    out = []
    for i, text in enumerate(r[1] or "" for r in rows):
        data = np.frombuffer(text.encode(), np.uint8)
        value, owner, starts, _ = paragraphs.words(data, np.array([0, len(data)]))
        first, size, *_ = paragraphs.cut(value, owner)
        found = [(len(text[: m.start()].encode()), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
        assert [f[0] for f in found] == starts.tolist()
        out += [(rows[i][0], found[a][0], [w for _, w in found[a : a + n]]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
    return out


@pytest.fixture(scope="module")
def passages():
    """Documents of one line or many that share passages of 51 to 60 words, and variants of one passage."""
    rng = random.Random(21)
    shared, base = [prose(rng, 51 + k % 10) for k in range(30)], prose(rng, 70).split()
    out = []
    for k in range(90):
        passage = shared[k % 30]
        if k % 3:
            passage = passage.replace(" ", "\n", 4).upper()
        out.append(f"{prose(rng, rng.randint(0, 60))} {passage}. {prose(rng, rng.randint(0, 60))}")
    for k in range(40):
        out.append(" ".join(["w%d" % k if j == k else w for j, w in enumerate(base)]))
    clean = [prose(rng, 150) + "\n" + " ".join(shared[0].split()[:14]) for _ in range(20)] + [" ".join([prose(rng, 60)] * 2)]
    return [(i, t) for i, t in enumerate(out + clean)], len(out)


@pytest.mark.parametrize("most", [2048, 2])
def test_paragraphs(spark, docs, rows, passages, most):
    """With most = 2 buckets are dealt out by rare shingles, then at random, and then compared part by part: no link is lost."""
    rows = rows + [(1000 + i, t) for i, t in passages[0]]
    lines = [(i, at, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, at, w in plain_paragraphs(rows)]
    root = classes(len(lines), [(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines[:i]) if len(a[2] & b[2]) >= 0.8 * len(a[2] | b[2])])
    within = defaultdict(set)
    for i, k in enumerate(root):
        within[k].add(lines[i][0])
    want = {lines[i][:2]: lines[k][:2] for i, k in enumerate(root) if len(within[k]) > 1}
    more = spark.createDataFrame([(1000 + i, t) for i, t in passages[0]], "doc_id long, text string")
    found = paragraphs.paragraph_groups(docs.select("doc_id", "text").union(more), most=most).collect()
    assert {(r.doc_id, r.start): (r.class_doc, r.class_start) for r in found} == want
    assert all(r.removed == ((r.doc_id, r.start) != (r.class_doc, r.class_start)) for r in found)


def test_large_buckets_lose_no_link(spark):
    """At the default size: a bucket of 2,000 pairs that are just similar enough, and one of 5,000 variants of a passage beside strangers."""
    rng = np.random.default_rng(4)
    fresh = lambda n: [rng.bytes(5) for _ in range(n)]
    members = []
    for k in range(2000):
        both = fresh(24)
        members += [(1, 2 * k, b"".join(both + fresh(3))), (1, 2 * k + 1, b"".join(fresh(3) + both))]
    base = fresh(24)
    members += [(2, 10_000 + k, b"".join(base + fresh(2))) for k in range(5000)]
    members += [(2, 20_000 + k, b"".join(base[:10] + fresh(16))) for k in range(50)]
    rows = spark.createDataFrame(members, "key long, p long, set binary")
    roots = {r.node: r.root for r in components.components(paragraphs._links(rows.union(rows.limit(500)), 0.8, 2048)).collect()}
    assert roots == {2 * k + i: 2 * k for k in range(2000) for i in (0, 1)} | {10_000 + k: 10_000 for k in range(5000)}


def test_passages_within_lines_are_found_and_short_ones_left_alone(spark, passages):
    rows, shared = passages
    found = {r.doc_id for r in paragraphs.paragraph_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len([i for i in range(90) if i in found]) >= 85 and not [i for i in found if i >= shared]


def test_paragraphs_empty_repeated_rows_and_null_ids(spark, empty):
    assert paragraphs.paragraph_groups(empty).count() == 0
    text, other = prose(random.Random(8), 30), prose(random.Random(9), 30)
    rows = [(1, text), (1, text), (None, text), (2, other), (2, other), (2, other + " end"), (3, None)]
    got = paragraphs.paragraph_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 2, 2] and sum(r.removed for r in got) == 4


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    want = {r[0]: np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [2], np.uint32) for r in rows}
    out = packing.pack(docs, path, shard_tokens=4000).toPandas()
    for i, g in out.sort_values("start").groupby("doc_id"):
        assert (g.doc_tokens == len(want[i])).all()
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(want[i])
        assert g.ids_crc32.tolist() == [zlib.crc32(want[i][a : a + n].astype("<u4").tobytes()) for a, n in zip(g.start, g.length, strict=True)]
    assert set(out.doc_id) == set(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        n = int(g.length.sum())
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and n <= 4096 and not n & (n - 1)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("text", ["don't stop, we'll see. OK...", "<|endoftext|> and <|ENDOFTEXT|>,", "É, é. ÀÉ… a,b. 3.14, x", "tab\tnew\nline\r\n", "ß, ñ. 日本。 e\u0301, .,", "%%%, ***.", " \u00a0\u2003x,\u3000y. "])
def test_words_are_tokenised_as_the_whole_text(text):
    own = packing.WordTokenizer(packing.default_tokenizer())
    assert own.encode(text.encode()).tolist() == own.whole.encode(text, add_special_tokens=False).ids


def test_index_ranks_as_bm25_does():
    rng = np.random.default_rng(5)
    docs = [rng.integers(3, 60, rng.integers(1, 80)) for _ in range(50)]
    at, ids = np.concatenate([[0], np.cumsum([len(d) for d in docs])]), np.concatenate(docs).astype("<u2")
    df = np.array([sum(t in d for d in docs) for t in range(100)])
    idf, average = np.log1p((50 - df + 0.5) / (df + 0.5)), at[-1] / 50
    index, unused = packing._Index(ids, at, idf, average, None), rng.random(50) < 0.7
    for seed in range(50):
        tf = np.array([[np.sum(d == t) for t in set(docs[seed].tolist())] for d in docs])
        size = np.array([[len(d)] for d in docs])
        score = (idf[list(set(docs[seed].tolist()))] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))).sum(axis=1)
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == set(np.flatnonzero(unused & (score > 0)).tolist())
        assert np.all(np.diff(score[got]) <= 1e-4)


def test_packing_brings_related_documents_together(spark):
    rng = random.Random(4)
    topics = [[f"{c}{w}" for w in WORDS] for c in "qwz"]
    rows = [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(300))) for i in range(60)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.default_tokenizer()).toPandas()
    mixed = [len({d % 3 for d in g.doc_id}) for _, g in out[out.n_tokens == 4096].groupby("sequence_id")]
    assert np.mean([m == 1 for m in mixed]) > 0.6


def test_decontaminate(spark, empty):
    item = "A train leaves Boston at 9 am and travels 120 km to Albany. How long does it take if it covers 60 km in 1 hour?"
    other = "A train leaves Denver at 7 am and travels 240 km to Dallas. How long does it take if it covers 80 km in 1 hour?"
    loose = "A train leaves Denver at 7 am and travels 240 km to Dallas. How long does it take if it covers Paris km in Rome hour?"
    rng = random.Random(6)
    texts = [f"{prose(rng, 30)}. {item} {prose(rng, 30)}", item.lower(), f"{prose(rng, 9)}. {other} {prose(rng, 9)}", prose(rng, 200), None, "", "short", loose.split("How")[1], item.upper()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "one two"), (4, prose(rng, 40))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verdict for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(0, 1): "verbatim", (1, 1): "verbatim", (2, 1): "reparameterised", (8, 1): "verbatim"}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, benchmark).collect()) == [3, 4, 5, 6, 7]
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.filter("false")).count() == 0


def plain_windows(text, names):
    """(template, values) of each window of a text; names=False: the second form, None without names."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return []
    value, template, _ = decontaminate.tokens(data, np.array([0, len(data)]))
    if not names:
        if not (template == decontaminate.NAME).any():
            return []
        template = np.where(template == decontaminate.NAME, value, template)
    kinds = {int(k) for k in (decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME)}
    value, template = value.tolist(), template.tolist()
    spans = [(k, min(k + 5, len(value))) for k in range(max(1, len(value) - 4) if value else 0)]
    return [(tuple(template[a:b]), tuple((k - a, value[k]) for k in range(a, b) if template[k] in kinds)) for a, b in spans]


def plain_contaminated(docs, items):
    out = {}
    for d, text in docs:
        have = set(plain_windows(text, True))
        by = defaultdict(set)
        for h, slots in have:
            by[h].add(slots)
        for i, question in items:
            best = []
            for form in (1, 0):
                want = set(plain_windows(question, bool(form)))
                mine = defaultdict(set)
                for h, slots in want:
                    mine[h].add(slots)
                if want:
                    covered = sum(h in by for h in mine) / len(mine)
                    best.append((covered, len(want & have) / len(want) >= 0.6, form, mine))
            best = [b for b in best if b[0] >= 0.6]
            if not best:
                continue
            covered, _, _, mine = max(best, key=lambda b: b[:3])
            if any(b[1] for b in best):
                out[d, i] = ("verbatim", covered, 1.0)
                continue
            pairs = Counter()
            for h, alternatives in mine.items():
                if len(alternatives) == 1:
                    for slots in by.get(h, ()):
                        pairs.update((own[1], other[1]) for own, other in zip(*alternatives, slots, strict=True))
            top = defaultdict(int)
            for (own, _), n in pairs.items():
                top[own] = max(top[own], n)
            share = sum(top.values()) / sum(pairs.values()) if pairs else 0.0
            if share >= 0.8:
                out[d, i] = ("reparameterised", covered, share)
    return out


def test_decontamination_against_brute_force(spark):
    """Questions with other numbers, names and units, halves of questions, repeated rows, lists of numbers, texts of many numbers."""
    rng = random.Random(31)
    people, places = ["Anna", "Boris", "Clara", "Denis"], ["Paris", "Oslo", "Rome", "Lima"]

    def question(k):
        who, where = rng.choice(people), rng.choice(places)
        return f"{prose(random.Random(k), 6)} and {who} walks {rng.randint(2, 99)} km from {where} with {rng.randint(2, 99)} kg of {prose(random.Random(k), 4)} in {rng.randint(2, 9)} hours. How fast is {who} near {where}?"

    numbers = " ".join(str(rng.randint(1, 999)) for _ in range(200))
    items = [(k, question(k)) for k in range(12)] + [(50, numbers), (51, None), (52, "one two"), (53, "")]
    docs = []
    for k in range(60):
        kind, q = k % 6, items[k % 12][1]
        q = {0: q, 1: question(k % 12), 2: q.lower(), 3: q[: len(q) // 2], 4: q.replace("km", "miles"), 5: prose(rng, 60)}[kind]
        docs.append((k, f"{prose(rng, 20)}. {q} {prose(rng, 20)}"))
    docs += [(100, " ".join(str(rng.randint(1, 999)) for _ in range(3000))), (101, "x " + numbers + " y"), (102, None), (103, "one two"), (104, "")]
    table = spark.createDataFrame(docs + docs[:3], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.verdict, round(r.coverage, 9), round(r.consistency, 9)) for r in decontaminate.contaminated(table, benchmark).collect()}
    want = {k: (v, round(c, 9), round(s, 9)) for k, (v, c, s) in plain_contaminated(docs, items).items()}
    assert got == want and {v[0] for v in want.values()} == {"verbatim", "reparameterised"} and (101, 50) in want and (100, 50) not in want


def test_language_accuracy_and_rejects(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out()))
    held = langid.predict(docs.filter(langid.held_out()), model)
    right, n, least, most = held.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.min("lang_score"), F.max("lang_score")).first()
    assert right >= 0.97 * n and 0 <= least <= most <= 1
    odd = spark.createDataFrame([(None,), ("",), ("123 !?",), ("é",), ("x" * 5000,)], "text string")
    assert [r.lang_pred == "und" for r in langid.predict(odd, model).collect()] == [True, True, True, False, False]
    assert langid.predict(empty, model).count() == 0
    untaught = langid.predict(odd, langid.fit(empty))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_packing_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x"), (None, None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.default_tokenizer()).toPandas()
    assert out.length.sum() == sum(len(packing.WordTokenizer(packing.default_tokenizer()).encode((t or "").encode())) + 1 for _, t in rows)


def test_language_sample_is_bounded_with_repeated_and_null_ids(spark):
    """Ties, repeated rows and rows without ids: the sample holds at most `sample` different rows of a language."""
    rng = random.Random(2)
    rows = [(None, prose(rng, 20), "xx") for _ in range(60)] + [(7, prose(rng, 20), "yy") for _ in range(60)] + [(8, "same words here", "yy")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, sample=10).languages == ["xx", "yy"]
    got = langid.predict(docs, langid.fit(docs)).select("text", "lang_pred", "lang_score").distinct().collect()
    assert len(got) == len({r.text for r in got})  # equal texts are judged alike


def test_pipeline_stages_and_run(spark, tmp_path):
    """Each stage against a plain version over what the one before it kept, and the run as a whole."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(77)
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).toPandas()
    rows = [(int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars)) for r in sample.itertuples()]
    item = "A train leaves Boston at 9 am and travels 120 km to Albany. How long does it take if it covers 60 km in 1 hour?"
    words = sample.text[0].split()
    more = [item, sample.text[3].upper(), None, "", "123 456", " ".join(words + ["extra"]), sample.text[1]]
    rows += [(9000 + i, t, None if i % 2 else "en", "s", 0) for i, t in enumerate(more)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame(rows, schema)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    text = {r[0]: r[1] for r in rows}
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept[list(kept)[-1]] if kept else set(text)
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == table.columns
            docs = spark.createDataFrame(out.collect(), schema)
            kept[name] = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            gone = before - kept[name]
            assert {9002, 9003, 9004} <= gone and len(gone) < 0.05 * len(text) + 3
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for i in before:
                groups[low(text[i])].append(i)
            assert kept[name] == {max(g) for g in groups.values()}
        elif name == "simhash_dedup":
            ids = sorted(before)
            prints = [fingerprint(text[i]) for i in ids]
            root = classes(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= corpus_pipeline.RADIUS])
            assert kept[name] == {ids[k] for k in set(root)}
        elif name == "decontamination":
            found = plain_contaminated([(i, text[i]) for i in before], [(1, item)])
            assert found and kept[name] == before - {d for d, _ in found}
        else:
            pieces = out.toPandas()
            plain = Tokenizer.from_file(packing.default_tokenizer())
            assert set(pieces.doc_id) == before
            for i, g in pieces.groupby("doc_id"):
                assert g.length.sum() == len(plain.encode(text[i], add_special_tokens=False).ids) + 1
            whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
            order = ["sequence_id", "offset"]
            assert whole.sort_values(order).values.tolist() == pieces.sort_values(order).values.tolist()


def test_pipeline_keeps_clashing_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, prose(random.Random(i), 60), "en", "mine", "other") for i in range(8)], "doc_id long, text string, lang string, __lang_pred string, __LANG_score string")
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns and {(r[3], r[4]) for r in out.collect()} <= {("mine", "other")}


def test_hilbert_curve_is_continuous():
    n = 1 << 4
    points = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)]).T
    index = hilbert.hilbert_index(points, 4)
    assert sorted(index.tolist()) == list(range(n**3))
    walk = points[:, np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_hilbert_shards(docs, rows, empty):
    out = hilbert.hilbert_shards(docs, ["lang", "size", "source"], shards=7).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == len(rows) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    order = out.sort_values(["shard", "slot"]).hilbert.tolist()
    assert order == sorted(order)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in out.itertuples())
    assert hilbert.hilbert_shards(empty, ["lang", "size"]).count() == 0
    assert sorted(hilbert.hilbert_shards(docs.limit(3), ["lang"], shards=7).toPandas().slot) == [0, 0, 0]


def test_url_rules(spark):
    urls = [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://b.net/", "b.net", "/", "net/", "block"),
        ("http://example.com/de/7", "example.com", "/de/7", "example.com/de/", "block"), ("ftp://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://notnet/x", "notnet", "/x", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("x://h?q/p", "h", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, F.lit(None).cast("boolean"), urlfilter.RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert urlfilter.judge_urls(pages.filter("false"), F.lit(None).cast("boolean")).count() == 0


def plain_templates(paths, significance=1.96):
    """(host, typed path) -> template, by recursion from the root."""
    out = {}

    def split(node, rows, template):
        level, branches = len(template), defaultdict(list)
        for typed, segments, l, b in rows:
            if level == len(segments):
                out[node, typed] = "".join("/" + x for x in template)
            else:
                branches[segments[level]].append((typed, segments, l, b))
        rows = [r for x in branches.values() for r in x]
        p = (sum(r[3] for r in rows) + 1) / (sum(r[2] for r in rows) + 2)
        merged = defaultdict(list)
        for name, own in branches.items():
            l, b = sum(r[2] for r in own), sum(r[3] for r in own)
            z = abs(b - l * p) / (max(l, 1) * p * (1 - p)) ** 0.5
            merged[name if name[0] == "{" or l and z > significance else "*"] += own
        for name, own in merged.items():
            split(node, own, [*template, name])

    hosts = defaultdict(list)
    for host, typed, l, b in paths:
        hosts[host].append((typed, [x for x in typed.split("/") if x], l, b))
    for host, rows in hosts.items():
        split(host, rows, [])
    return out


def test_url_tree_against_recursion(spark, empty):
    """Paths of up to 30 segments, labelled and not, repeated rows, one large host; purity and verdicts follow from the templates."""
    rng = random.Random(17)
    names = ["a", "b", "spam", "c", "7", "2024-01-02", "x9"]
    urls = [(f"http://{rng.choice(['big.org', 'big.org', 'small.de'])}/" + "/".join(rng.choice(names) for _ in range(rng.choice([0, 1, 2, 3, 4, 30])))) for _ in range(400)]
    rows = [(i, u, None if rng.random() < 0.3 else "spam" in u and rng.random() < 0.9) for i, u in enumerate(urls + urls[:50] + ["http://deep.org/" + "/".join("ab" * 150)])]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in urlfilter.judge_urls(pages, F.col("bad")).collect()}
    kind = {"7": "{num}", "2024-01-02": "{date}", "x9": "{id}"}
    split = [(u.split("/")[2], "".join("/" + kind.get(x, x) for x in u.split("/")[3:] if x)) for _, u, _ in rows]
    labels = defaultdict(list)
    for key, (_, _, bad) in zip(split, rows, strict=True):
        labels[key].append(bad)
    found = plain_templates([(h, t, sum(b is not None for b in v), sum(b is True for b in v)) for (h, t), v in labels.items()])
    assert {i: r.template for i, r in got.items()} == {i: found[k] for i, k in enumerate(split)}
    share = [r[2] for r in rows if r[2] is not None]
    prior = (sum(share) + 1) / (len(share) + 2)
    for i, (host, _) in enumerate(split):
        own = [bad for k, (_, _, bad) in zip(split, rows, strict=True) if k[0] == host and bad is not None]
        same = [bad for k, (_, _, bad) in zip(split, rows, strict=True) if k[0] == host and found[k] == got[i].template and bad is not None]
        expected = (sum(same) + 8 * (sum(own) + 8 * prior) / (len(own) + 8)) / (len(same) + 8)
        assert abs(1 - expected - got[i].purity) < 1e-9 and (got[i].verdict == "block") == (expected > 0.5)


def test_url_templates_are_learnt(spark):
    rows = [(i, f"http://h.org/{['news', 'spam', 'art'][i % 3]}/{i}", i % 3 == 1 if i < 240 else None) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = urlfilter.judge_urls(pages, F.col("bad")).collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 1) for r in got)
    assert {"/spam/{num}"} == {r.template for r in got if r.page_id % 3 == 1}


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
