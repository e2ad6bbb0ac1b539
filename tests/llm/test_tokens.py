from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scenewright.llm import tokens

PARTS = [
    "a",
    "The",
    "word",
    "\n",
    "\n\n",
    "\n\n\n",
    " ",
    "  ",
    "\t",
    "\r\n",
    "été",
    "Straße",
    "x1",
    "42",
    "'s",
    "don't",
    "!!",
    "***",
    "日本",
    " ",
    "　",
    "<|endoftext|>",
    "<|startoftext|>",
    "<|ENDOFTEXT|>",
    "<|",
    "é",
    "İ",
    "ǅ",
    "\0",
    "-",
    "ﬁ",
    "ªº",
    "µ",
    ".",
    ",",
]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words")])
@pytest.mark.parametrize("cache", [50, 1_000_000])
def test_cached_encoding_equals_the_tokenizers(monkeypatch, name, kind, cache):
    monkeypatch.setattr(tokens, "CACHE", cache)
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(8000)]
    texts += ["".join(rng.choice(["word", "été", "The", "x"]) + rng.choice([" ", "\n", "\n\n", ". ", ",\n"]) for _ in range(9)) for _ in range(2000)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = [np.asarray(e.ids, dtype="<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    own = tokens.Encoder(public_tokenizers.path(name))
    assert own.kind == kind
    got = [x for i in range(0, len(texts), 1000) for x in own.encode(texts[i : i + 1000])]
    assert got == want


def test_any_other_tokenizer_gets_whole_texts(tmp_path):
    """A byte-level tokenizer that puts a space in front isn't one of the two kinds."""
    made = json.loads(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).to_str())
    made["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    own, plain = tokens.Encoder(str(path)), Tokenizer.from_file(str(path))
    assert own.kind == "whole"
    texts = ["one two", "", " x  <|endoftext|> y"]
    assert own.encode(texts) == [np.asarray(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
