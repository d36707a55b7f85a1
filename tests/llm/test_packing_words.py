"""Words of the packing tokenizer: plain ones are split by the library, all give the tokenizer's ids."""

import random

from millwright.llm import packing


class _Counted:
    def __init__(self, whole):
        self.whole, self.model, self.calls = whole, whole.model, 0

    def encode(self, *args, **named):
        self.calls += 1
        return self.whole.encode(*args, **named)


def test_plain_words_are_split_without_the_whole_tokenizer():
    own, rng = packing.WordTokenizer(packing.default_tokenizer()), random.Random(1)
    own.whole = counted = _Counted(own.whole)
    alphabet = [chr(c) for c in range(33, 127) if chr(c) != "'"] + list("äéßñ0123456789") + ["ing", "the", "%%%"]
    words = ["".join(rng.choices(alphabet, k=rng.randrange(1, 12))).replace("<|", "<") for _ in range(3000)]
    text = " ".join(["(825)", "65.38.191.115", "aneding%%%", "añon4x!", "a.b,", "...", "é9é", *words])
    assert own.encode(text.encode()).tolist() == counted.whole.encode(text, add_special_tokens=False).ids
    assert counted.calls == 0
    odd = "it's we'll 'tis a'b'c 1's \x01x \x7fy x́ ß² Ünï 中文 ... don't. <|endoftext|> İx"
    assert own.encode(odd.encode()).tolist() == counted.whole.encode(odd, add_special_tokens=False).ids


def test_parts_of_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "PARTS", 4)
    own = packing.WordTokenizer(packing.default_tokenizer())
    text = " ".join(f"x{i}!y{i * 7}?" for i in range(200))
    assert own.encode(text.encode()).tolist() == own.whole.encode(text, add_special_tokens=False).ids
    assert len(own.parts) <= 4
