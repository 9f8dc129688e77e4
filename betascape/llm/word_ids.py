"""Ids of whole texts under a lower-casing BPE tokenizer that drops white space.

A text's ids are those of its words, cut at ASCII white space, one after another; so each worker
keeps the ids of words that it has met twice, as little-endian unsigned 32-bit numbers.  Words of
Latin letters skip the library's full path: they are composed, lowered and split as the
tokenizer's file says and go to its BPE model at once, which gives the same ids for less.  Special
tokens that a text spells out are recognised as the library does by default, and none are added.
"""

from __future__ import annotations

import unicodedata

import regex
from tokenizers import Tokenizer

#: Words that a worker remembers; it starts afresh when they are more.
MEMO = 700_000
#: Longer words are never kept, so that the memory stays bounded.
LONG = 64

# The split pattern of the tokenizer's file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if it prints, else one of
    those from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """word (UTF-8) -> its packed ids; looks up or makes them."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(SPLIT).findall
        self.letters = byte_letters()
        self.once: set[bytes] = set()
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(m.split() != [m] for m in marks):
            raise ValueError("added tokens must not hold white space")
        self.spelled = regex.compile("|".join(map(regex.escape, marks)) or "(?!)").search

    def fresh(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return [t.id for t in self.model.tokenize(word.lower())]
        if max(word, default="") < "ƀ" and not self.spelled(word):
            pieces = self.split(unicodedata.normalize("NFC", word).lower())
            return [t.id for p in pieces for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> bytes:
        ids = b"".join([i.to_bytes(4, "little") for i in self.fresh(word.decode(errors="replace"))])
        if word in self.once:
            self[word] = ids
        elif len(word) <= LONG:
            self.once.add(word)
        return ids

    def documents(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of each text (UTF-8)."""
        if len(self) > MEMO or len(self.once) > 2 * MEMO:
            self.clear()
            self.once.clear()
        find = self.__getitem__
        return [b"".join(map(find, t.split())) for t in texts]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
