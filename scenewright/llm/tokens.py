"""Token ids of whole texts from the tokenizers library, each distinct word encoded once per worker.

Two kinds of tokenizer never merge across a single space between two other characters, so that a text can be encoded
piece by piece: byte-level BPE that keeps the space before a word, and word BPE that drops white space and case. Any
other tokenizer gets every text whole. So do texts with other uses of white space, and texts that hold an added
token, which the library by default finds in a text like any other caller of encode().
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache
from itertools import islice, takewhile

import numpy as np

#: Entries in a worker's cache of encoded pieces, some 200 MB. When it is full its later half goes: frequent pieces come early.
CACHE = 1_000_000
#: Pieces that one call of the tokenizer encodes.
CALL = 2_000
#: Endings that are a token run of their own after a letter.
ENDINGS = (".", ",", "!!")


#: Fixed value: the pattern of words, with its contractions, that marks a tokenizer of the kind words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: How both vocabularies write bytes that are no printable character of Latin-1: as the characters from U+0100 on, in order.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def _is_latin1(piece: str) -> bool:
    """Only letters of Latin-1: no tokenizer splits such a piece, so the model itself can be asked for it."""
    return piece.isalpha() and (piece.isascii() or max(piece) <= "\u00ff")


def _is_word(piece: str) -> bool:
    """Only Latin letters, for which this Python's and the tokenizer's Unicode tables agree; but for the one whose lower case has a combining dot."""
    return piece.isalpha() and max(piece) < "\u0250" and "\u0130" not in piece


def kind_of(tokenizer) -> str:
    """spaced, words, or whole: how texts may be cut for a tokenizer, by what it is made of."""
    made = json.loads(tokenizer.to_str())
    model, before, norm = made["model"], made["pre_tokenizer"] or {}, made["normalizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not plain or made["truncation"] or made["padding"] or any(t[k] for t in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return "whole"
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
    if norm is None and before == byte_level | {"use_regex": True} and not model.get("end_of_word_suffix"):
        return "spaced"
    steps = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    if norm == {"type": "Sequence", "normalizers": steps} and before == {
        "type": "Sequence", "pretokenizers": [split, byte_level | {"use_regex": False}],
    } and model.get("end_of_word_suffix") == "</w>":
        return "words"
    return "whole"


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, the same as encode(text, add_special_tokens=False) of the tokenizer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind_of(self.tokenizer)
        self.spaced = self.kind == "spaced"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What all added tokens begin with, as far as case doesn't count there: few texts hold it.
        self.begin = "".join(takewhile(lambda c: c.lower() == c.upper(), os.path.commonprefix(self.added)))
        if self.kind == "whole":
            return
        self.model = self.tokenizer.model
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.endings = dict(zip(ENDINGS, self._one_by_one(list(ENDINGS)), strict=True))
        # ids that begin with a space begin a piece; without spaces, ids with the word-end mark end a word
        vocabulary = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.marked[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if self.spaced else t.endswith("</w>"))]] = True
        self.newline = self._one_by_one(["\n"])[0] if self.spaced else b""
        if not self.spaced:  # a piece of its own that is one id; it ends the pieces before it
            self.between = " \0 "
            (self.between_id,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str], words: bool = False) -> list[bytes]:
        """What each piece (after a space, if spaced) gives, from one call for all of them. words: all are words."""
        prefix = " " if self.spaced else ""
        joined = prefix + (" " if self.spaced or words else self.between).join(pieces)
        ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        if self.spaced:
            begin = np.flatnonzero(self.marked[ids])
            end = np.append(begin[1:], len(ids))
        elif words:
            end = np.flatnonzero(self.marked[ids]) + 1
            begin = np.concatenate([[0], end[:-1]])
        else:
            cut = np.flatnonzero(ids == self.between_id)
            begin, end = np.concatenate([[0], cut + 1]), np.append(cut, len(ids))
        if len(begin) != len(pieces) or begin[0] or end[-1] != len(ids):
            return self._one_by_one([prefix + p for p in pieces])
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    def _directly(self, words: list[str]) -> None:
        """What the model makes of words that normalizing changes in case only and splitting not at all."""
        ask, known = self.model.tokenize, self.rest
        for p in words:
            w = p.lower()
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(LETTERS)
            known[p] = array("I", [t.id for t in ask(w)]).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        known = self.rest
        ended = {}
        for piece in pieces:
            for e in ENDINGS:
                if piece.endswith(e) and _is_word(piece[: -len(e)]):
                    ended[piece] = e
                    break
        stems = {p[: -len(e)] for p, e in ended.items()} | pieces.difference(ended)
        plain = [p for p in stems.difference(known) if p]
        if self.spaced:
            plain = [p for p in plain if not p[0].isspace() and not p[-1].isspace()]
        latin = [] if self.spaced else [p for p in plain if _is_latin1(p)]  # joined calls are as fast where spaces are kept
        self._directly(latin)
        plain = list(set(plain).difference(latin))
        odd = [p for p in plain if "\0" in p]
        plain = [p for p in plain if "\0" not in p]
        words = [] if self.spaced else [p for p in plain if _is_word(p)]
        for part in (words, list(set(plain).difference(words))):
            for i in range(0, len(part), CALL):
                run = part[i : i + CALL]
                known.update(zip(run, self._together(run, part is words), strict=True))
        if odd:
            known.update(zip(odd, self._one_by_one([(" " if self.spaced else "") + p for p in odd]), strict=True))
        for p, e in ended.items():
            known[p] = known[p[: -len(e)]] + self.endings[e]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return self._one_by_one(texts)
        # Lower case too: pieces are lowered before they are encoded, and what that makes is no added token.
        whole = [i for i, t in enumerate(texts) if self.begin in t and any(a in t or a in t.lower() for a in self.added)]
        if not whole:
            return self._by_pieces(texts)
        odd = set(whole)
        out = self._by_pieces([t for i, t in enumerate(texts) if i not in odd])
        for i, ids in zip(whole, self._one_by_one([texts[i] for i in whole]), strict=True):
            out.insert(i, ids)
        return out

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.rest) > CACHE:
            self.first.clear()
            self.rest = dict(islice(self.rest.items(), CACHE // 2))
        if self.spaced:
            split = [[line.split(" ") for line in t.split("\n")] for t in texts]
            firsts = {line[0] for lines in split for line in lines}.difference(self.first)
            self.first.update(zip(firsts, self._one_by_one(list(firsts)), strict=True))
            self._learn(set().union(*(line[1:] for lines in split for line in lines)).difference(self.rest))
            return [self._of_lines(text, lines) for text, lines in zip(texts, split, strict=True)]
        self.rest[""] = b""
        split = [(t.lower() if t.isascii() else t).replace("\n", " ").split(" ") for t in texts]
        self._learn(set().union(*split).difference(self.rest))
        return [self._joined(text, pieces) for text, pieces in zip(texts, split, strict=True)]

    def _joined(self, text: str, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.rest.__getitem__, pieces))
        except KeyError:  # white space that isn't one space between two words
            return self._one_by_one([text])[0]

    def _of_lines(self, text: str, lines: list[list[str]]) -> bytes:
        """A line break between two words, or two of them, are ids of their own; other uses of white space go through the tokenizer whole."""
        try:
            out, blank = [], False
            for line in lines:
                head = line[0]
                if head[-1:].isspace() or head[:1].isspace() or not head and (blank or len(line) > 1):
                    raise KeyError
                blank = not head
                out.append(self.first[head] + b"".join(map(self.rest.__getitem__, line[1:])))
            return self.newline.join(out)
        except KeyError:
            return self._one_by_one([text])[0]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def grouped(texts: list[str], most: int = 1 << 22):
    """(start, texts) in runs of about most characters."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t)
        size += len(t)
        if size >= most:
            yield at, run
            at, run, size = i + 1, [], 0
    if run:
        yield at, run
