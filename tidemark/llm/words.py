"""Words and shingles of whole texts, vectorised over the UTF-8 bytes of a batch.

A batch of texts becomes one byte array; words are maximal runs of word bytes, so all work is a few numpy passes and no
Python object is made per word. Texts are separated by a byte that is never part of a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space: space and the control characters from tab to carriage return.
SPACE = " \t\n\v\f\r"
#: Regular expressions of words of letters and digits, for lower-cased and for raw text.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_WORD_RAW = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACED = np.ones(256, bool)
_SPACED[[32, 9, 10, 11, 12, 13]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_ALNUM[128:] = True
#: Odd multiplier of the polynomial hash, and constants of a 64-bit finaliser.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Bytes of text handled at once, so that temporary arrays stay small whatever the batch holds.
BLOCK_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of several texts in order: byte spans, 64-bit hashes, and where each text's words begin (n_texts + 1)."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def split_words(texts: list[str | None], spaced: bool) -> Words:
    """Words of ASCII-lower-cased texts; ``spaced``: runs of anything but white space, else runs of letters and digits."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    data = _FOLD[np.frombuffer(b" ".join(raw) + b" ", np.uint8)] if raw else np.zeros(0, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = (_SPACED if spaced else _ALNUM)[data]
    edge = np.diff(inside, prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = end - begin
    total = int(length.sum())
    if total:
        starts = np.cumsum(length) - length
        at = np.arange(total) - np.repeat(starts, length)
        letters = data[np.flatnonzero(inside[:-1])].astype(np.uint64) + np.uint64(1)
        h = np.add.reduceat(letters * _powers(int(length.max()))[at], starts)
        h = mix(h + length.astype(np.uint64) * _M2)
    else:
        h = np.zeros(0, np.uint64)
    return Words(data, begin, end, h, np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)])))


def word_counts(texts: list[str | None], spaced: bool) -> np.ndarray:
    """How many words each text has: those that ``split_words`` gives, counted by their beginnings."""
    out = np.zeros(len(texts), np.int64)
    for a, b in blocks(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
        ends = np.cumsum([len(r) + 1 for r in raw])
        inside = (_SPACED if spaced else _ALNUM)[_FOLD[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]]
        begin = np.flatnonzero(inside[1:] & ~inside[:-1])
        out[a:b] = np.diff(np.searchsorted(begin, np.concatenate([[0], ends])))
    return out


def count_words(text: Column, spaced: bool) -> Column:
    """``word_counts`` as a column, for operators that may use Python: a regular expression over each text takes several times as long."""
    return F.pandas_udf(lambda s: pd.Series(word_counts(list(s), spaced)), "long")(text.cast("string"))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (len(h) - k + 1 of them; none if there are fewer words)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * _BASE + h[j : j + len(out)]
    return mix(out)


def gram_hashes_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The same hashes, at some positions only."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * _BASE + h[at + j]
    return mix(out)


def shingle_lists(texts: list[str | None], k: int, spaced: bool = True) -> list[np.ndarray]:
    """Per text the hashes of its k-word shingles in order; of fewer words the whole sequence; of none, nothing."""
    w = split_words(texts, spaced)
    grams = gram_hashes(w.hash, k)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        n = int(b - a)
        out.append(grams[a : b - k + 1] if n >= k else gram_hashes(w.hash[a:b], n) if n else np.zeros(0, np.uint64))
    return out


def blocks(texts: list, limit: int = BLOCK_BYTES):
    """Slices of a batch with about ``limit`` characters each; a longer text is alone in its slice."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
