"""Token ids of texts by a public tokenizer file, with each distinct word encoded once.

The tokenizers library splits a normalised text into words and encodes each word for itself.  Here
a text is cut at single spaces, where a word always begins, and the library's model encodes only
those parts that a bounded memo does not hold; a test holds the ids against the library's own for
whole texts.
"""

from __future__ import annotations

import unicodedata
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Parts of texts that a worker remembers; beyond that it starts anew.
MEMO = 400_000

# The word patterns that the tokenizer files name or imply.
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


MARK_TEXT = ".,;:!?"
MARKS = frozenset(MARK_TEXT)


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in the files' vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Encoder:
    """A special token's string in a text is that token, as for the library: texts are cut there first."""

    def __init__(self, file: str, pattern: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        # The files' added tokens all match raw text, whatever stands beside them.
        self.special = {t.content: array("H", [i]).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.begins = {t[:2] for t in self.special}
        self.model = self.tokenizer.model
        self.model._resize_cache(0)
        self.words = regex.compile(pattern).findall
        self.shown = str.maketrans(dict(enumerate(_byte_characters())))
        self.memo: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        shown = word.encode("utf-8", "replace").decode("latin-1").translate(self.shown)
        return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _ids(self, part: str) -> bytes:
        return b"".join(map(self._word, self.words(part)))

    def _known(self, parts: list[str], lead: str) -> bytes:
        """The ids of parts that each follow ``lead``."""
        found = list(map(self.memo.get, parts))
        if None in found:
            if len(self.memo) > MEMO:
                self.memo.clear()
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = self._part(parts[at], lead)
        return b"".join(found)

    def _part(self, part: str, lead: str) -> bytes:
        memo = self.memo
        found = memo.get(part)
        if found is None:
            word, mark = part[:-1], part[-1:]
            head, line, tail = part.partition("\n")
            if part.isalpha():  # one word; and letters before a mark are one too
                found = self._letters(part, lead)
            elif mark in MARKS and word.isalpha():
                found = self._part(word, lead) + self._word(mark)
            elif line and head and tail.strip(MARK_TEXT).isalpha() and tail[0].isalpha() and not head[-1].isspace():
                # A line end between two words is a word of its own or none.
                return self._part(head, lead) + self._part(line + tail, "")
            else:
                found = self._ids(part if part[0] == "\n" else lead + part) if part else self._ids(lead)
            memo[part] = found
        return found

    def _letters(self, part: str, lead: str) -> bytes:
        if part.isascii():  # ASCII letters stand for themselves
            return array("H", [t.id for t in self.model.tokenize("\u0120" + part if lead else part)]).tobytes()
        return self._word(lead + part)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 16-bit integers."""
        return [np.frombuffer(self._whole(t), np.uint16) for t in texts]

    def _whole(self, text: str) -> bytes:
        if not any(map(text.__contains__, self.begins)):
            return self._encode(text)
        return b"".join(self.special.get(part) or self._encode(part) for part in self.split(text) if part)


class ByteEncoder(Encoder):
    odd_space = regex.compile(r" (?:\s|$)").search

    def _encode(self, text: str) -> bytes:
        if ByteEncoder.odd_space(text):  # some space does not begin a word
            return self._ids(text)
        first, *rest = text.split(" ")
        return self._ids(first) + self._known(rest, " ")


class WordEncoder(Encoder):
    def _encode(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            # One code point at a time, as the library lowers: no final sigma.
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return self._known(text.split(" "), "")


@cache
def byte_encoder(file: str = "byte_bpe_50k.json") -> Encoder:
    return ByteEncoder(file, BYTE_WORDS)


@cache
def word_encoder(file: str = "word_bpe_49k.json") -> Encoder:
    return WordEncoder(file, WORD_WORDS)
