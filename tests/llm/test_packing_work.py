"""Work that op4_packing saves: words that end in marks are no words of their own, and used items leave a shard's index."""

import random

import numpy as np
import pyarrow as pa

from millwright.llm import packing
from millwright.llm.common import text_bytes


def test_marks_behind_a_word_are_apart_and_ids_are_those_of_the_tokenizer():
    own, rng = packing.WordTokenizer(packing.default_tokenizer()), random.Random(4)
    marks = ["", "!!", ")", '"', ",\"", "?!.", "'", "!'", "'!", "{|}~", "<", "/", "@"]
    words = ["pump", "seal", "straße", "é", "b4", "7", "Ü", "x'", "a.b"]
    texts = [" ".join(rng.choice(marks) + rng.choice(words) + rng.choice(marks) for _ in range(40)).replace("<|", "<") for _ in range(60)]
    data, at = text_bytes(pa.array(texts))
    ids, bounds = own.encode_block(data, at)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == own.whole.encode(text, add_special_tokens=False).ids
    own.reset()
    own.encode(" ".join(f"{w}{m}" for w in ("pump", "seal", "rotor") for m in ("!!", ")", '"', "{|}~", "<")).encode())
    assert len(own.start) == 3 + 5  # not 15


def test_words_are_found_again_in_either_table():
    own, rng = packing.WordTokenizer(packing.default_tokenizer()), random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(4000)]
    for k in range(40):
        text = " ".join(rng.choices(words[: 100 * (k + 1)], k=300))
        assert own.encode(text.encode()).tolist() == own.whole.encode(text, add_special_tokens=False).ids
        for table in (own.known, own.recent):
            assert (table[0][1:] > table[0][:-1]).all() and len({len(t) for t in table}) == 1
    kept = len(own.start)
    assert kept == len(own.known[0]) + len(own.recent[0])  # no word twice
    own.encode(text.encode())
    assert len(own.start) == kept


def test_used_items_leave_the_index_and_order_stays():
    rng = np.random.default_rng(6)
    n, size = 400, 30
    ids, at = rng.integers(0, 300, n * size).astype(np.uint16), np.arange(n + 1) * size
    idf = rng.random(1 << 16) + 0.1
    index, unused = packing._Index(ids, at, idf, size, None), np.ones(n, bool)
    postings = len(index.item)
    for seed in rng.permutation(n)[: n - 20].tolist():
        unused[seed] = False
        whole = packing._Index(ids, at, idf, size, None)
        spans = [slice(whole.bounds[t], whole.bounds[t + 1]) for t in whole.queries[seed].tolist()] if seed % 8 == 0 else []
        if spans:
            score = np.bincount(np.concatenate([whole.item[s] for s in spans]), np.concatenate([whole.weight[s] for s in spans]), n)
            want = np.flatnonzero((score > 0) & unused)
            assert index.neighbours(seed, unused).tolist() == want[np.argsort(-score[want], kind="stable")].tolist()
    assert len(index.item) < postings / 4
