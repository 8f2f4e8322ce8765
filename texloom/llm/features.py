"""Hashed letter features of many words at once, as numpy arrays.

A word is a run of letters in lower case; combining marks belong to the letter before them, numerals are no letters. Its code points are one stretch of a long array; the hash of an
n-gram, of a prefix or suffix, or of the whole word is arithmetic modulo 2**32 on that array, so no
Python runs a word at a time.
"""

from __future__ import annotations

import re

import numpy as np
import regex

from texloom.llm.common import starts_of

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PLAIN_LETTERS = re.compile(r"[a-z]+")
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (_PLAIN_LETTERS if text.isascii() else LETTERS).findall(text)


def _mix(h: np.ndarray, x: np.ndarray | np.uint32) -> np.ndarray:
    h = (h ^ x) * _M1
    return h ^ (h >> np.uint32(15))


class WordCodes:
    """The code points of some words, end to end."""

    def __init__(self, words: list[str]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.bounds = starts_of(self.sizes)
        self.codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)

    def edges(self, n: int, salt: int, last: bool = False) -> np.ndarray:
        """Hash of the first (or last) n letters of each word; shorter words hash whole."""
        h = np.full(len(self.sizes), salt, np.uint32)
        for k in range(n):
            inside = self.sizes > k
            at = self.bounds[1:] - 1 - k if last else self.bounds[:-1] + k
            code = np.zeros(len(h), np.uint32)
            code[inside] = self.codes[at[inside]]
            h = _mix(h, code)
        return h

    def grams(self, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams within words, with how many each word has."""
        total = len(self.codes)
        h = np.full(max(total - n + 1, 0), salt, np.uint32)
        for k in range(n):
            h = _mix(h, self.codes[k : total - n + 1 + k])
        counts = np.maximum(self.sizes - n + 1, 0)
        word = np.repeat(np.arange(len(self.sizes)), counts)
        first = np.repeat(self.bounds[:-1], counts)
        step = np.arange(len(word)) - np.repeat(starts_of(counts)[:-1], counts)
        return h[first + step], counts

    def whole(self, salt: int) -> np.ndarray:
        """Hash of each whole word."""
        place = np.arange(len(self.codes)) - np.repeat(self.bounds[:-1], self.sizes)
        x = _mix(_mix(np.full(len(self.codes), salt, np.uint32), self.codes), place.astype(np.uint32))
        total = np.zeros(len(x) + 1, np.uint32)
        np.cumsum(x, dtype=np.uint32, out=total[1:])
        h = total[self.bounds[1:]] - total[self.bounds[:-1]]
        h = (h ^ self.sizes.astype(np.uint32)) * _M2
        return h ^ (h >> np.uint32(13))
