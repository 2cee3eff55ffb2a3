"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces seen before.

Both vocabularies used here split a text at white space before anything else,
so the ids of a text are the ids of its pieces in order. Pieces repeat far more
than texts do: many texts are cut into pieces at once with numpy, found by 64-bit
keys and told apart by their bytes, and only pieces that the task's memory lacks
go to the library.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
from tokenizers.pre_tokenizers import ByteLevel

from bipartrix.llm.common import holds, mix64, only

#: Unicode White_Space, which the tokenizers' ``\s`` means.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: byte_bpe: a space goes with the word after it; other white space stands alone.
WITH_SPACE = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: word_bpe: white space is dropped.
WORDS = re.compile(rf"[^{WS}]+")
#: White space beyond ASCII, in UTF-8; its texts are cut by the patterns above.
OTHER_WS = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

#: Pieces remembered in a Python worker (about 40 MB with their ids).
MAX_PIECES = 1 << 20
#: Longer pieces (bytes) aren't remembered, nor told apart.
MAX_LENGTH = 60
#: Bytes of texts that are cut at once; longer texts go in parts, cut where white space starts.
CHUNK = 1 << 19

WS_LEADS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")
COMBINING = re.compile(rb"[\xcc\xcd]")
#: A byte that isn't ASCII white space, before one that is.
SPACE_STARTS = re.compile(rb"[^\t-\r ](?=[\t-\r ])")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII marks that never join a word (no apostrophe).
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b".,;:!?|#$%&*", np.uint8)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def latin(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes, A-Z and À-Þ lower-cased if asked, and which of them belong to A-Z, a-z or À-ÿ (without × and ÷)."""
    letter = _LETTER[data]
    if lower:
        data = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        after = data[lead + 1]
        own = lead[(after != 0x97) & (after != 0xB7)]
        letter[own] = letter[own + 1] = True
        if lower:
            high = own[data[own + 1] < 0x9F] + 1
            data[high] += 32
    return data, letter


class Spans:
    """Short pieces of a byte string as 64-bit words: word j of a piece has its bytes from 8 j on, zeros after its end."""

    def __init__(self, raw: bytes, start: np.ndarray, end: np.ndarray):
        self.words = np.ndarray((len(raw) + 1,), ">u8", raw + bytes(8), strides=(1,))
        self.start, self.size = start, end - start

    def take(self, at: np.ndarray) -> Spans:
        out = object.__new__(Spans)
        out.words, out.start, out.size = self.words, self.start[at], self.size[at]
        return out

    def word(self, j: int, at: np.ndarray) -> np.ndarray:
        """Word j of some pieces, which have more than 8 j bytes."""
        left = np.minimum(self.size[at] - 8 * j, 8).astype(np.uint64)
        return self.words[self.start[at] + 8 * j].astype(np.uint64) & (np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(64) - np.uint64(8) * left))

    def keys(self) -> np.ndarray:
        """64-bit keys, never 0; one-to-one for pieces of equal length up to 8 bytes, but for that."""
        out = self.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at, j = np.arange(len(out)), 0
        while len(at):
            out[at] = mix64(out[at] ^ self.word(j, at))
            j += 1
            at = at[self.size[at] > 8 * j]
        return np.maximum(out, np.uint64(1))


class Memory:
    """Keys of pieces in an open-addressing table, their bytes, and their ids one after another."""

    def __init__(self, most: int):
        self.most, self.mask, self.n, self.end = most, 2 * most - 1, 0, 0
        self.key, self.at = np.zeros(2 * most, np.uint64), np.zeros(2 * most, np.int32)
        self.first, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        #: Where the words of an entry's bytes lie, and how many bytes it has (0: without a key).
        self.word_at, self.length, self.words, self.n_words = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.uint64), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            there = self.key[slot]
            same = there == keys[left]
            out[left[same]] = self.at[slot[same]]
            on = ~same & (there != 0)
            left, slot = left[on], slot[on] + 1 & self.mask
        return out

    def same_bytes(self, entries: np.ndarray, pieces: Spans) -> np.ndarray:
        """Whether each piece has the bytes that its entry was named for."""
        out = self.length[entries] == pieces.size
        at, j = np.flatnonzero(out), 0
        while len(at):
            out[at] = self.words[self.word_at[entries[at]] + j] == pieces.word(j, at)
            j += 1
            at = at[out[at] & (pieces.size[at] > 8 * j)]
        return out

    def add(self, ids: list[int], sizes: list[int]) -> np.ndarray:
        """Entries for pieces with so many of these ids each, without keys."""
        n, size, flat = len(sizes), np.array(sizes, np.int32), np.array(ids, np.uint32)
        while self.n + n > len(self.first):
            self.first, self.size, self.word_at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.word_at, self.length))
        while self.end + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.first[self.n : self.n + n] = self.end + np.cumsum(size) - size
        self.size[self.n : self.n + n] = size
        self.ids[self.end : self.end + len(flat)] = flat
        self.n, self.end = self.n + n, self.end + len(flat)
        return np.arange(self.n - n, self.n, dtype=np.int32)

    def name(self, keys: np.ndarray, entries: np.ndarray, pieces: Spans) -> None:
        """Give entries their keys, all of which are new, and the bytes they stand for."""
        self.length[entries] = pieces.size
        many = (pieces.size + 7) // 8
        self.word_at[entries] = self.n_words + np.cumsum(many) - many
        while self.n_words + int(many.sum()) > len(self.words):
            self.words = np.concatenate([self.words, np.zeros_like(self.words)])
        at, j = np.flatnonzero(many), 0
        while len(at):
            self.words[self.word_at[entries[at]] + j] = pieces.word(j, at)
            j += 1
            at = at[many[at] > j]
        self.n_words += int(many.sum())
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.key[slot] == 0)
            own = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[own]], self.at[slot[own]] = keys[left[own]], entries[left[own]]
            on = np.ones(len(left), bool)
            on[own] = False
            left, slot = left[on], slot[on] + 1 & self.mask

    def gather(self, entries: np.ndarray) -> np.ndarray:
        """The ids of the entries, joined."""
        size = self.size[entries]
        total = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.first[entries] - (total - size), size)
        return self.ids[at + np.arange(len(at))]


class PieceEncoder:
    """encode() gives a text's ids as little-endian unsigned 32-bit bytes, encode_all() those of many texts."""

    breaks = SPACE_STARTS

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.by_space = name.startswith("byte_bpe")
        self.pattern = WITH_SPACE if self.by_space else WORDS
        self.bpe = self.tokenizer.model.tokenize
        self.memory = Memory(MAX_PIECES)
        # Byte-level vocabularies spell a byte as a letter; the pre-tokenizer shows which.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spell = np.array([0, *[ord(level.pre_tokenize_str(chr(b))[0][0][-1]) for b in range(1, 128)], *[ord(_spelling(level, b)) for b in range(128, 256)]], np.uint16)

    def piece(self, p: str) -> list[int]:
        return self.tokenizer.encode(p, add_special_tokens=False).ids

    def pieces(self, data: np.ndarray, letter: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
        """(ids joined, number of ids of each) of some pieces; words of Latin letters go straight to the vocabulary's merges."""
        letters = np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])
        from_ = start + (data[start] == 32) if self.by_space else start
        plain = (letters[end] - letters[from_] == end - from_) & (end > from_)
        spelt = self.spell[data].tobytes().decode("utf-16-le")
        raw, ids, size = data.tobytes(), [], []
        for a, z, quick in zip(start.tolist(), end.tolist(), plain.tolist(), strict=True):
            own = [t.id for t in self.bpe(spelt[a:z])] if quick else self.piece(raw[a:z].decode())
            ids += own
            size.append(len(own))
        return ids, size

    def bounds(self, data: np.ndarray, letter: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the pieces of texts that start at ``first`` and have no white space beyond ASCII."""
        n, space = len(data), _SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[first] = True
        # Such an ASCII mark after a letter starts a new word part in either vocabulary.
        cut[1:n] |= letter[:-1] & _MARK[data[1:]]
        if not self.by_space:
            cut[1:n] |= space[1:] != space[:-1]
            start = np.flatnonzero(cut[:n])
            end = np.append(start[1:], n)
            words = ~space[start]
            return start[words], end[words]
        cut[1:n] |= space[1:] & ~space[:-1]
        within = np.ones(n, bool)  # not the last byte of its text
        within[np.append(first[1:], n) - 1] = False
        last = np.flatnonzero(space[:-1] & ~space[1:] & within[:-1])  # of white space before a word
        cut[last] = True
        cut[last[data[last] != 32] + 1] = True
        start = np.flatnonzero(cut[:n])
        return start, np.append(start[1:], n)

    def _chunk(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part)."""
        raw = b"".join(parts)
        size = np.array([len(x) for x in parts], np.int64)
        begin = np.cumsum(size) - size
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
        # Lower-casing first would keep some combining marks (from U+0300 on) from composing.
        lower = not self.by_space and not COMBINING.search(raw)
        data, letter = latin(np.frombuffer(raw, np.uint8), lower)
        start, end = self.bounds(data, letter, begin[size > 0])
        entry, n0, end0 = self._entries(raw if not lower else data.tobytes(), data, letter & (lower or self.by_space), start, end)
        ids = self.memory.gather(entry)
        self.memory.n, self.memory.end = n0, end0  # the rest is forgotten
        piece_of = np.searchsorted(start, begin)
        total = np.concatenate([[0], np.cumsum(self.memory.size[entry], dtype=np.int64)])
        return ids, total[np.append(piece_of[1:], len(start))] - total[piece_of]

    def _entries(self, raw: bytes, data: np.ndarray, letter: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int, int]:
        """(entry of each piece, number of entries and of ids that are to be kept after this chunk).

        Pieces over MAX_LENGTH bytes, those beyond the memory's bounds, and those
        whose key another piece has, are encoded for this chunk alone.
        """
        memory = self.memory
        entry = np.full(len(start), -1, np.int32)
        short = np.flatnonzero(end - start <= MAX_LENGTH)
        spans = Spans(raw, start[short], end[short])
        keys = spans.keys()
        found = memory.find(keys)
        known = np.flatnonzero(found >= 0)
        right = memory.same_bytes(found[known], spans.take(known))
        entry[short[known[right]]] = found[known[right]]
        miss = np.flatnonzero(found < 0)
        n0, end0 = memory.n, memory.end
        _, at, back = np.unique(keys[miss], return_index=True, return_inverse=True)
        first = miss[at]  # one piece for each new key
        held = min(len(first), memory.most - n0)
        new = memory.add(*self.pieces(data, letter, start[short[first]], end[short[first]]))
        memory.name(keys[first[:held]], new[:held], spans.take(first[:held]))
        if held:
            n0, end0 = n0 + held, int(memory.first[n0 + held]) if n0 + held < memory.n else memory.end
        same = _same(spans, miss, first[back])
        entry[short[miss[same]]] = new[back[same]]
        rest = np.flatnonzero(entry < 0)
        if len(rest):
            entry[rest] = memory.add(*self.pieces(data, letter, start[rest], end[rest]))
        return entry, n0, end0

    def whole(self, raw: bytes) -> bool:
        """Whether a text is cut by the pattern instead: it has white space beyond ASCII."""
        return any(x in raw for x in WS_LEADS) and OTHER_WS.search(raw) is not None

    def encode_all(self, texts: list[bytes | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, joined; number of ids of each), each text's with ``end_id`` after them."""
        owner, parts, size, out = [], [], 0, []

        def done() -> None:
            ids, counts = self._chunk(parts)
            out.append((owner[:], counts, ids))
            owner.clear()
            parts.clear()

        for i, t in enumerate(texts):
            if t and self.whole(t):
                if parts:
                    done()
                    size = 0
                ids = np.array([x for m in self.pattern.finditer(t.decode()) for x in self.piece(m[0])], np.uint32)
                out.append(([i], np.array([len(ids)]), ids))
            else:
                for p in _segments(t or b"", self.breaks):
                    if parts and size + len(p) > CHUNK:
                        done()
                        size = 0
                    owner.append(i)
                    parts.append(p)
                    size += len(p)
        if parts:
            done()
        counts = np.zeros(len(texts), np.int64)
        for who, n, _ in out:
            np.add.at(counts, who, n)
        ids = np.concatenate([x for _, _, x in out]) if out else np.zeros(0, np.uint32)
        if end_id is None:
            return ids, counts
        return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([(text or "").encode()])[0].tobytes()


def _same(spans: Spans, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pieces a[i] and b[i] have the same bytes."""
    out = spans.size[a] == spans.size[b]
    at, j = np.flatnonzero(out & (a != b)), 0
    while len(at):
        out[at] = spans.word(j, a[at]) == spans.word(j, b[at])
        j += 1
        at = at[out[at] & (spans.size[a[at]] > 8 * j)]
    return out


def _segments(raw: bytes, breaks: re.Pattern) -> Iterator[bytes]:
    """Parts of about CHUNK bytes that end before white space."""
    a = 0
    while len(raw) - a > CHUNK:
        z = breaks.search(raw, a + CHUNK)
        if z is None:
            break
        yield raw[a : z.start() + 1]
        a = z.start() + 1
    yield raw[a:]


def _spelling(level, b: int) -> str:
    """The letter for a byte from 128 on: the last byte of a character that ends with it, or the first of one that starts so."""
    for c in range(0x80, 0x800):
        raw = chr(c).encode()
        if b in raw:
            return level.pre_tokenize_str(chr(c))[0][0][raw.index(b)]
    return chr(b)


@functools.cache
def _encoder(name: str) -> PieceEncoder:
    return PieceEncoder(name)


def encoder(name: str) -> PieceEncoder:
    """One for each Python worker, until the worker turns to another operator."""
    only("tokens")
    holds("tokens", _encoder.cache_clear)
    return _encoder(name)
