"""Word shingles of whole texts, many documents at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, which is what
``bytes.lower().split()`` gives. A word's key is a keyed BLAKE2b digest of 128
bits, remembered for the words that a worker meets again; a shingle's key mixes
its words' keys. exact_sets() numbers the words themselves instead, so that sets
of the texts it is given are compared without any hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

from bipartrix.llm.common import mix64

#: Bytes of a text that are cut into words at once.
SEGMENT = 1 << 20
CHUNK = 1 << 20
#: Words that a worker remembers (some 150 bytes each), and the longest of them.
MAX_WORDS, MAX_LENGTH = 1 << 18, 40

SPACE = re.compile(rb"[\x20\x09-\x0D]")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class WordKeys(dict):
    """128-bit keys of words; those not remembered are digested again."""

    def __missing__(self, word: bytes) -> bytes:
        key = blake2b(word, digest_size=16, key=b"words").digest()
        if len(word) <= MAX_LENGTH and len(self) < MAX_WORDS:
            self[word] = key
        return key


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


KEYS = WordKeys()


def forget() -> None:
    KEYS.clear()


def cuts(sizes: list[int], limit: int) -> Iterator[slice]:
    """Slices of so many bytes together or a little more, one item at least."""
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield slice(start, len(sizes))


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[slice]:
    return cuts([len(t) for t in texts], limit)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a segment at a time."""
    a = 0
    while len(text) - a > SEGMENT:
        z = SPACE.search(text, a + SEGMENT)
        if z is None:
            break
        yield text[a : z.end()].lower().split()
        a = z.end()
    yield (text[a:] if a else text).lower().split()


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, two 64-bit halves of the key) of every word, in order."""
    counts, out = [], []
    for t in texts:
        n = 0
        for words in words_of(t):
            out.append(b"".join(map(KEYS.__getitem__, words)))
            n += len(words)
        counts.append(n)
    return np.repeat(np.arange(len(texts)), counts), np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


def _whole(doc: np.ndarray, k: int) -> np.ndarray:
    """Where a window of k words starts that lies in one text."""
    n = max(0, len(doc) - k + 1)
    return np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n])


def _distinct(d: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by both, each pair once; with the first place of each and the texts' offsets."""
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    if len(d):
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
        d, h, order = d[new], h[new], order[new]
    return d, h, order, np.searchsorted(d, np.arange(n + 1))


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, 64-bit key) of each different shingle, sorted by both, a second 64-bit key of each, and offsets of the texts in them.

    A text with fewer than k words, but one, has the whole sequence as its only shingle.
    """
    doc, w = word_keys(texts)
    n = len(texts)
    counts = np.bincount(doc, minlength=n)
    at, keys = _whole(doc, k), []
    first = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < k))
    with np.errstate(over="ignore"):
        for half in (0, 1):
            x = w[:, half]
            h = mix64(x[at] + np.uint64(k))
            for i in range(1, k):
                h = mix64(h * GOLDEN + x[at + i])
            short = mix64(x[first[few]] + counts[few].astype(np.uint64)) if len(few) else x[:0].copy()
            for i in range(1, k - 1):
                on = counts[few] > i
                short[on] = mix64(short[on] * GOLDEN + x[first[few[on]] + i])
            keys.append(np.concatenate([h, short]))
    d, h, order, offsets = _distinct(np.concatenate([doc[at], few]), keys[0], n)
    return d, h, keys[1][order], offsets


def exact_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of the shingle) of each different shingle, sorted by both, and offsets; equal shingles of these texts have one number, different ones two."""
    numbers, counts, parts = Numbers(), [], []
    for t in texts:
        own = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in words_of(t)]
        parts += own
        counts.append(sum(map(len, own)))
    counts = np.array(counts, np.int64)
    doc, w = np.repeat(np.arange(len(texts)), counts), np.concatenate(parts) if parts else np.zeros(0, np.int64)
    at, size = _whole(doc, k), len(numbers) + 1
    code, top = w[at], size
    for i in range(1, k):
        if top > (1 << 62) // size:  # number them anew
            _, code = np.unique(code, return_inverse=True)
            top = len(code) + 1
        code, top = code * size + w[at + i], top * size
    few, first = np.flatnonzero((counts > 0) & (counts < k)), np.cumsum(counts) - counts
    whole: dict[tuple, int] = {}
    short = np.array([-1 - whole.setdefault(tuple(w[first[i] : first[i] + counts[i]].tolist()), len(whole)) for i in few], np.int64)
    d, h, _, offsets = _distinct(np.concatenate([doc[at], few]), np.concatenate([code, short]), len(texts))
    return d, h, offsets
