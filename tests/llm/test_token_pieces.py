"""Pre-tokens read once by the tokenizer's model, against the tokenizer as it is given."""

import json
import random
import re

import numpy as np
import pyarrow as pa

from citeloom.llm import tokens


class Counting:
    """Counts the characters that go through a tokenizer."""

    def __init__(self, inner):
        self.inner, self.read = inner, 0

    def encode(self, text, **options):
        self.read += len(text)
        return self.inner.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.read += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)


def same(own, texts):
    ids, sizes = own.column(pa.array(texts, pa.string()))
    assert sizes.sum() == len(ids)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tobytes() == own.whole(text), repr(text)


def test_plain_pieces_are_read_once_and_not_by_the_whole_tokenizer():
    own = tokens.Encoder(tokens.tokenizer_path())
    texts = ["Stone stone, stone. élan, élan.\nStone élan x1;y 12,5", "élan stone.\nStone\nstone (stone) élan"] * 50
    same(own, texts)
    own.tokenizer, own.model = Counting(own.tokenizer), Counting(own.model)
    own.known, own.ids = own.known.slice(0, 0), own.ids.slice(0, 0)
    first = own.column(pa.array(texts))
    assert own.tokenizer.read == 0
    # Distinct pre-tokens with a sign after each: far fewer characters than the texts have.
    assert 0 < own.model.read < 100
    read = own.model.read
    again = own.column(pa.array(texts[::-1]))
    assert own.model.read == read
    assert sorted(first[1]) == sorted(again[1])


def test_letters_are_those_of_the_tokenizers_pattern():
    own = tokens.Encoder(tokens.tokenizer_path())
    spans = re.findall("(.)-(.)|(.)", tokens.LETTERS)
    letters = [chr(c) for a, b, one in spans for c in range(ord(a or one), ord(b or one) + 1)]
    signs = [chr(c) for c in range(128)]
    same(own, [f"{c}a {c}1{c}.{c} b{c}, 2{c}\n{c}c ({c}{c}" for c in letters + signs])


def test_random_texts():
    own = tokens.Encoder(tokens.tokenizer_path())
    rng = random.Random(8)
    alphabet = ["a", "The", "é", "中文", "й", "7", ".", ",", "'", "'s", "!?", "\n", " ", " ", " ", "\t"]
    alphabet += ["\r", "\u00a0", "\x85", "×", "º", "\u0663", "\u0301", "😀", "_", "\x00", "\x1f", "\u2003"]
    alphabet += ["\ufeff", "ÿ", "\u200b", "\u3000", "\x0b", "\x7f", "<|endoftext|>"]
    for some in range(20):
        same(own, ["".join(rng.choices(alphabet[: 16 + some], k=rng.randrange(14))) for _ in range(400)])


def test_a_full_memory_begins_again(monkeypatch):
    own = tokens.Encoder(tokens.tokenizer_path())
    rng = random.Random(3)
    for most in (0, 300, 3000):
        monkeypatch.setattr(tokens, "REMEMBERED", most)
        for _ in range(6):
            same(own, [" ".join("".join(rng.choices("abcé", k=5)) for _ in range(40))])
            assert own.known.nbytes <= most
            assert len(own.known) == len(own.ids)


def test_long_pieces_and_texts():
    own = tokens.Encoder(tokens.tokenizer_path())
    long = "".join(random.Random(5).choices("abcdefgh", k=3 * tokens.CHUNK))
    words = " ".join(long[i : i + 9] for i in range(0, len(long), 7))
    same(own, [long, f"a {long}, {long}1", words, "", " "])


def test_a_tokenizer_with_another_pattern_encodes_whole_texts(tmp_path):
    with open(tokens.tokenizer_path(), encoding="utf-8") as f:
        other = json.load(f)
    other["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other), encoding="utf-8")
    own = tokens.Encoder(str(path))
    assert not own.separable
    same(own, ["plain words", "", "two\n\nlines  x"])
