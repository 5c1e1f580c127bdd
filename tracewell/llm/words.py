"""Words and their hashes."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import xxhash

_WORD = re.compile(r"\w+")
#: Invisible format characters, as a class of ranges; built from the character database.
_CF = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"]
_INVISIBLE = dict.fromkeys(_CF)
#: Characters of a text that are looked at together; a text of any length passes in such pieces.
PIECE = 400_000


def clean(text: str) -> str:
    """``text`` after compatibility normalisation, without format characters, in lower case."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).translate(_INVISIBLE)


def word_pieces(text: str | None) -> Iterator[list[str]]:
    """The words of a text, whole and in order, in lists of bounded length. Null and blank texts have none."""
    if not text:
        return
    plain = text.isascii()
    body = clean(text)
    if len(body) <= PIECE:
        got = _WORD.findall(body)
        yield got if plain else [w.lower() for w in got]
        return
    got, size = [], 0
    for m in _WORD.finditer(body):
        got.append(m.group() if plain else m.group().lower())
        size += len(got[-1]) + 1
        if size > PIECE:
            yield got
            got, size = [], 0
    if got:
        yield got


class WordHashes(dict):
    """word -> 64-bit hash, kept for words that come again; forgets all when it grows beyond ``most`` words."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (finaliser of a well-known generator; fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(out)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values."""
    n = len(x) - size + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    have, out = 1, x
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:n]
