"""Tokenise whole texts through a cache of their space-separated chunks."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable

import regex

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are packed as the machine's unsigned integers, which must be 32-bit and little-endian")


class ChunkCache(dict):
    """Encodes texts pre-token by pre-token, each distinct chunk once while the cache holds it.

    ``pattern`` cuts a text into pre-tokens, none of which reaches over a lone space, and takes a
    space with following letters as one and a run of marks after letters as one; ``encode_one``
    maps a pre-token to its ids. A text is cut before each space that stands between two
    characters other than white space, so its ids are those of its chunks, one after another. A
    text in which a space touches other white space is cut by the pattern as a whole.

    As a dictionary it maps a chunk to the packed ids of a space and the chunk, which are encoded
    when asked for first; a chunk with white space at an end has none and raises KeyError. The
    cache is emptied between texts when it exceeds ``max_entries``; that bounds memory and changes
    no result.
    """

    def __init__(self, pattern: str, encode_one: Callable[[str], list[int]], max_entries: int = 500_000):
        super().__init__()
        self.cut = regex.compile(pattern).findall
        self.encode_one = encode_one
        self.max_entries = max_entries
        self.others: dict[str, bytes] = {}  # ids of pre-tokens that are no space with letters

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = array("I", self.encode_one(" " + chunk)).tobytes()
        else:
            word = chunk.rstrip(".,;:!?")
            if word.isalpha():
                known = word in self
                ids = self[word] + self._other(chunk[len(word) :])
                if not known:  # a word that is new is seldom met again with the same marks
                    return ids
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise KeyError(chunk)
            else:
                ids = self._joined(self.cut(" " + chunk))
        self[chunk] = ids
        return ids

    def _other(self, token: str) -> bytes:
        ids = self.others.get(token)
        if ids is None:
            ids = self.others[token] = array("I", self.encode_one(token)).tobytes()
        return ids

    def _joined(self, tokens: list[str]) -> bytes:
        return b"".join([self[t[1:]] if t[0] == " " and t[1:].isalpha() else self._other(t) for t in tokens])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if len(self) + len(self.others) > self.max_entries:
                self.clear()
                self.others.clear()
            first, *parts = (text or "").split(" ")
            try:
                if first[-1:].isspace():
                    raise KeyError(first)
                ids = b"".join(map(self.__getitem__, parts))
            except KeyError:
                ids = self._joined(self.cut(text))
            else:
                if first:
                    ids = self._joined(self.cut(first)) + ids
            out.append(ids)
        return out
