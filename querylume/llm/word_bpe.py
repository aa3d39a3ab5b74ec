"""Exact, cached encoding with a lower-casing word-level BPE vocabulary.

The vocabulary's own pre-tokenizer never joins text over white space, and its merges never leave a
pre-token.  So the ids of a text are the ids of its pieces between ASCII white space, one after the other,
and each distinct piece is encoded once per worker, as long as the cache has room.  Pieces with characters outside the ranges listed in
UNUSUAL (normalisation and character classes matter there) go through the library's whole pipeline.
"""

from __future__ import annotations

import re
from functools import cache
from struct import pack

import numpy as np

#: Bytes of the longest pieces and pre-tokens that are kept, so that a cache of so many entries is bounded.
KEPT = 64
#: Control characters, no-break space, and everything from U+0250 on.
UNUSUAL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0ɐ-\U0010ffff]")
#: The vocabulary's pre-token pattern over the other characters, after lower-casing.
PRE_TOKEN = re.compile("[a-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾]+")


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class PreTokens(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model, limit: int):
        self.model, self.limit, self.letters = model, limit, byte_characters()

    def __missing__(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(spelled)]
        out = pack(f"<{len(ids)}I", *ids)  # an array for each word would cost as much again
        if len(self) < self.limit and len(word) <= KEPT:
            self[word] = out
        return out


class Pieces(dict):
    """Text between white space -> its ids.  `limit` bounds the cache; what doesn't fit is encoded again."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.words = PreTokens(self.tokenizer.model, limit // 2)
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        low = text.lower()
        if self.unusual(text, low):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out = np.array(ids, dtype="<u4").tobytes()
        elif low.isascii() and low.isalpha():  # most pieces: one pre-token
            out = self.words[low]
        else:
            out = b"".join(map(self.words.__getitem__, PRE_TOKEN.findall(low)))
        if len(self) < self.limit and len(piece) <= KEPT:
            self[piece] = out
        return out

    def unusual(self, text: str, low: str) -> bool:
        if text.isascii():  # and so is what is lower-cased
            return not text.isprintable() or any(map(text.__contains__, self.special))
        if UNUSUAL.search(text) or UNUSUAL.search(low):  # lower-casing may add a combining mark
            return True
        return any(map(text.__contains__, self.special))

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text, four bytes each."""
        return b"".join(map(self.__getitem__, text.split()))


@cache
def shared_pieces(path: str) -> Pieces:
    """One for all tasks of a worker, so that what their texts have in common is encoded once."""
    return Pieces(path)
