"""Benchmark decontamination: near copies of benchmark items inside documents, by edit distance over words.

For each item the windows of its own size are embedded with CGK random walks
(Chakraborty, Goldenberg, Koucky 2016): the walk repeats or steps on by a random
bit of the symbol it reads, so that few edits become few differing places.
Independent walks, each read at a few sampled steps, are the LSH tables; a
window that agrees with its item in one of them is checked exactly, with a
bit-parallel edit distance of the item to any stretch of the document there.

Before that, a bound without loss picks the windows worth embedding: with at
most k edits, all but k of any chosen subset of the item's words are near each
other in the document. Documents are judged one by one, so nothing is shuffled
but the matches. The items lie in written blocks of bounded size, which tasks
read: the driver holds the blocks' names, and one scan of the documents serves
all blocks.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.llm import files
from bipartrix.llm.common import holds, materialise, mix64, new_path, only, slices

#: ASCII marks become spaces; A-Z is lowered by str.lower before.
_MARKS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_SPACE = re.compile(r"\s")
#: Characters of a document that are split into words at once, up to the next space.
SEGMENT = 1 << 20
TABLES_AT_ONCE = 6
#: Bytes of item texts in one block.
BLOCK_BYTES = 8 << 20
#: Bytes of document texts that a task holds while it goes through several blocks.
HELD_BYTES = 64 << 20
#: The share of items at the limit of edits that the tables are to meet.
RECALL = 0.9
PAD = -2
#: Items of more words are embedded in pieces of at most as many.
PIECE = 59


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_MARKS).split()


def allowed_edits(n: int, similarity_pct: int) -> int:
    return n * (100 - similarity_pct) // 100


def pieces_of(n: int) -> list[tuple[int, int]]:
    """(first word, end) of the pieces of an item of n words: as few equal ones as have at most PIECE words.

    Of p pieces, one has at most a p-th of the item's edits, so it lies within
    the same similarity bound as the whole.
    """
    p = max(1, -(-n // PIECE))
    return [(n * j // p, n * (j + 1) // p) for j in range(p)]


class Walks:
    """CGK walks with sampled steps.

    repeats tables of ``samples`` steps each; ``tables_for`` says how many meet
    a target recall. Over windows of more than some dozens of words walks that
    fell out of step rarely meet again, so that longer items are embedded in
    pieces (see ``pieces_of``).
    """

    def __init__(self, repeats: int = 24, samples: int = 2, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(1, 1 << 62, repeats).astype(np.uint64)
        self.places = np.sort(rng.random((repeats, samples)), axis=1)

    def keys(self, ids: np.ndarray, starts: np.ndarray, n: int, tables: slice = slice(None)) -> np.ndarray:
        """(table, start): key of the window of n symbols from each start."""
        seeds = self.seeds[tables, None]
        steps = np.minimum((self.places[tables] * 2 * n).astype(np.int64), 2 * n - 1)
        padded = np.concatenate([ids, np.full(n + 1, -1, ids.dtype)]).astype(np.int64)
        at = np.zeros((len(seeds), len(starts)), np.int64)
        key = np.broadcast_to(seeds, at.shape).copy()
        with np.errstate(over="ignore"):
            for j in range(int(steps.max()) + 1):
                symbol = np.where(at < n, padded[starts[None, :] + np.minimum(at, n)], PAD)
                read = (steps == j).any(axis=1)
                if read.any():
                    key[read] = mix64(key[read] * np.uint64(0x9E3779B97F4A7C15) + symbol[read].astype(np.uint64))
                bits = mix64(symbol.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + seeds + np.uint64(j // 64))
                at += (bits >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
        return key


@functools.cache
def tables_for(recall: float, similarity_pct: int, samples: int = 2, trials: int = 32, most: int = 256) -> int:
    """Tables by which windows at the limit of edits meet with probability ``recall`` at least.

    Draws windows of three lengths, with all their edits deletions, insertions or
    replacements, and walks both sides. Of a pair that agrees in a share h of
    many tables, t tables miss (1 - h) ** t; the mean of that over the pairs must
    stay below 1 - recall in each class. The search also tries shifted starts, so
    that this errs on the side of more tables. ``most`` is where it gives up.
    """
    rng, walks, worst = np.random.default_rng(5), Walks(most // 2, samples, seed=29), 1
    for n in (12, 30, PIECE):
        k = allowed_edits(n, similarity_pct)
        whole = rng.integers(0, 1 << 40, (trials, 2 * n))
        mine = walks.keys(whole.ravel(), np.arange(trials) * 2 * n, n)
        for kind in ("delete", "insert", "replace"):
            other = []
            for row in whole:
                at = np.sort(rng.choice(n, k, replace=False))
                drawn = rng.integers(0, 1 << 40, k)
                if kind == "delete":
                    new = np.delete(row, at)
                elif kind == "insert":
                    new = np.insert(row, at, drawn)
                else:
                    new = row.copy()
                    new[at] = drawn
                other.append(new[:n])
            hit = (walks.keys(np.concatenate(other), np.arange(trials) * n, n) == mine).mean(axis=0)
            t = worst
            while t < most and ((1 - hit) ** t).mean() > 1 - recall:
                t += 1
            worst = t
    return worst


def infix_distance(item: list[int], text: list[int], from_start: bool = False) -> tuple[int, int]:
    """Least edit distance of ``item`` to a stretch of ``text``, and the first end of such a stretch (Myers' bit vectors).

    With ``from_start`` the stretch begins where the text does.
    """
    n = len(item)
    top, mask = 1 << (n - 1), (1 << n) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    up, down, score = mask, 0, n
    best, end = n, 0
    for j, x in enumerate(text):
        eq = where.get(x, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & mask, up & zero
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | from_start) & mask, minus << 1 & mask
        up, down = minus | ~(zero | plus) & mask, plus & zero
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """A block of items, ready to search documents."""

    def __init__(self, items: list[tuple], similarity_pct: int, min_words: int, walks: Walks):
        self.walks, self.ids = walks, [i for i, _ in items]
        split = [words_of(t) for _, t in items]
        self.vocab: dict[bytes, int] = {}
        self.words = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for ws in split]
        holders = np.bincount([w for ws in self.words for w in set(ws)], minlength=len(self.vocab)) if self.vocab else np.zeros(0, int)
        common = holders > max(2, len(items) // 50)
        pairs, self.need, self.edits = [], np.zeros(len(items), np.int64), [allowed_edits(len(ws), similarity_pct) for ws in self.words]
        self.own: list[np.ndarray] = []
        for i, ws in enumerate(self.words):
            k = self.edits[i]
            if len(ws) < max(1, min_words):
                self.own.append(np.zeros(0, np.int64))
                continue
            rare = [w for w in ws if not common[w]]
            chosen = rare if len(set(rare)) - k >= max(3, len(ws) // 4) else ws
            own = np.unique(chosen)
            self.need[i] = max(1, len(own) - k)  # distinct words that k edits leave; an item of few distinct words needs one
            self.own.append(own)
            pairs += [(w, i) for w in own.tolist()]
        pairs.sort()
        self.posted = np.array([i for _, i in pairs], np.int64)
        self.first = np.searchsorted(np.array([w for w, _ in pairs], np.int64), np.arange(len(self.vocab) + 1))
        self.pieces: dict[int, list[tuple]] = {}
        self.span = max((len(ws) + 2 * k for ws, k in zip(self.words, self.edits, strict=True)), default=0)

    def search(self, text: str | None) -> list[tuple]:
        """(item_id, distance, first word, item's words) of every item found, the best place of each."""
        best: dict[int, tuple[int, int]] = {}
        if not text or not self.vocab:
            return []
        at, base, held = 0, 0, []
        while at < len(text):
            gap = _SPACE.search(text, at + SEGMENT)
            end = gap.start() if gap else len(text)
            held += words_of(text[at:end])
            self._search(held, base, best)
            drop = max(0, len(held) - 2 * self.span)
            held, base, at = held[drop:], base + drop, end
        return [(self.ids[i], d, s, len(self.words[i])) for i, (d, s) in sorted(best.items())]

    def _search(self, words: list[bytes], base: int, best: dict[int, tuple[int, int]]) -> None:
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        hit_at = np.flatnonzero(ids >= 0)
        hits = ids[hit_at]
        some = np.unique(hits)
        n_posted = self.first[some + 1] - self.first[some]
        total = int(n_posted.sum())
        if not total:
            return
        places = np.arange(total) - np.repeat(np.cumsum(n_posted) - n_posted, n_posted) + np.repeat(self.first[some], n_posted)
        counts = np.bincount(self.posted[places], minlength=len(self.need))
        for i in np.flatnonzero((counts >= self.need) & (counts > 0)).tolist():
            n, k, need = len(self.words[i]), self.edits[i], int(self.need[i])
            mine = hit_at[np.isin(hits, self.own[i])]
            lo, hi = mine[need - 1 :] - (n + k) + 1, mine[: len(mine) - need + 1]
            close = lo <= hi  # so many of the words within n + k
            if not close.any():
                continue
            # Windows that start from k before such a stretch to k after its first hit.
            # A later piece may lie up to k before its place in an item that starts at 0.
            a, z = np.maximum(-k, lo[close] - k), hi[close] + k + 1
            mark = np.zeros(len(ids) + n + 3 * k + 2, np.int64)
            np.add.at(mark, a + k, 1)
            np.add.at(mark, np.minimum(z + k, len(mark) - 1), -1)
            starts = np.flatnonzero(np.cumsum(mark)[: len(ids) + k] > 0) - k
            for c in range(0, len(starts), 4096):
                part = starts[c : c + 4096]
                for t in range(0, len(self.walks.seeds), TABLES_AT_ONCE):
                    few = slice(t, t + TABLES_AT_ONCE)
                    if self._verify(i, ids, self._meet(i, ids, part, few), base, best):
                        break

    def _pieces(self, i: int) -> list[tuple]:
        """(offset, words, keys) of each piece of an item, walked when a document first comes near the item."""
        if i not in self.pieces:
            ws, one = self.words[i], np.zeros(1, np.int64)
            self.pieces[i] = [(a, z - a, self.walks.keys(np.array(ws[a:z], np.int64), one, z - a)[:, 0]) for a, z in pieces_of(len(ws))]
        return self.pieces[i]

    def _meet(self, i: int, ids: np.ndarray, starts: np.ndarray, tables: slice) -> np.ndarray:
        """The starts at which a piece of the item agrees with the document in one of the tables."""
        met = np.zeros(len(starts), bool)
        for offset, n, keys in self._pieces(i):
            at = starts + offset
            own = np.flatnonzero((at >= 0) & (at < len(ids)))
            if len(own):
                met[own] |= (self.walks.keys(ids, at[own], n, tables) == keys[tables, None]).any(axis=0)
        return starts[met]

    def _verify(self, i: int, ids: np.ndarray, met: np.ndarray, base: int, best: dict[int, tuple[int, int]]) -> bool:
        """Whether the item as it is was found; then no better place is to come."""
        n, k = len(self.words[i]), self.edits[i]
        done = -1
        for p in met.tolist():
            if p <= done:
                continue
            a, z = max(0, p - 2 * k), min(len(ids), p + n + 3 * k)
            near = ids[a:z].tolist()
            d, end = infix_distance(self.words[i], near)
            done = p + k  # later windows up to here lie in the stretch just read
            if d <= k:
                # Backwards from its end, the shortest stretch at that distance says where it starts.
                back = infix_distance(self.words[i][::-1], near[:end][::-1], from_start=True)[1]
                found = (d, base + a + end - back)
                best[i] = min(best.get(i, found), found)
        return i in best and best[i][0] == 0


_last: dict = {}

RESULT = "distance int, first_word long, item_words int"


def write_items(items: DataFrame) -> list[list[str]]:
    """Items in written files: the paths of each block of about BLOCK_BYTES of text, which is all the driver gets.

    Items without text are left out; a larger item is a block of its own. The
    blocks follow the bytes, whatever the partitions of ``items``.
    """
    folder = new_path(items.sparkSession, "decontam-items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def close() -> tuple[str, int]:
            path, out = files.create(folder, "block", ".arrow")
            with out, pa.ipc.new_stream(out, rows[0].schema) as sink:
                sink.write_table(pa.Table.from_batches(rows).combine_chunks())
            return path, held

        done = []
        for b in slices(batches, rows=1):
            size = b.column(1).nbytes
            if rows and held + size > BLOCK_BYTES:
                done.append(close())
                rows, held = [], 0
            rows.append(pa.RecordBatch.from_arrays(b.columns, ["item_id", "text"]))
            held += size
        if held:
            done.append(close())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"])

    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = items.where("text IS NOT NULL").select("item_id", "text").coalesce(max(1, -(-size // BLOCK_BYTES)))
    blocks, room = [], 0
    for path, n in own.mapInArrow(run, "path string, bytes long").collect():
        if n > room:
            blocks.append([])
            room = BLOCK_BYTES
        blocks[-1].append(path)
        room -= n
    return blocks


def find_leaks(docs: DataFrame, items: DataFrame, similarity_pct: int = 80, min_words: int = 1, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, distance, first_word, item_words, similarity): documents that hold an item's text.

    A document holds an item of n words if some stretch of it is within
    n * (100 - similarity_pct) / 100 word edits of the item, case and ASCII
    marks aside; items of so few words that this allows none are found as they
    stand, all of them. The best, then first, place of each pair is named. Null
    and empty texts match nothing, nor do items of fewer than ``min_words`` words.
    Repeated documents or items give repeated rows. Other columns are ignored.
    ``recall`` is what the tables must reach at the limit of edits.
    """
    kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (items, "item_id")))
    walks = Walks(tables_for(recall, similarity_pct))
    search = _searcher(write_items(items), similarity_pct, min_words, walks, items.schema["item_id"].dataType)
    found = docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, item_id {item_kind}, {RESULT}")
    return found.withColumn("similarity", 1 - F.col("distance") / F.col("item_words"))


def _in_turn(batches: Iterable[pa.RecordBatch], blocks: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches to be searched together: one by one for a single block, else up to HELD_BYTES of them."""
    held, size = [], 0
    for b in slices(batches):
        held.append(b)
        size += b.column(1).nbytes
        if blocks == 1 or size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _searcher(blocks: list[list[str]], similarity_pct: int, min_words: int, walks: Walks, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(item_type)

    def index_of(block: list[str]) -> Index:
        if _last.get("block") != block:  # a single block is read once by each Python worker, not by each task
            _last.clear()
            rows: list[tuple] = []
            for path in block:
                with files.open_input(path) as raw, pa.ipc.open_stream(raw) as stream:
                    rows += zip(*(c.to_pylist() for c in stream.read_all().columns), strict=True)
            _last.update(block=block, index=Index(rows, similarity_pct, min_words, walks))
        return _last["index"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontam")
        holds("decontam", _last.clear)
        for together in _in_turn(batches, len(blocks)):
            for block in blocks:
                index = index_of(block)
                for b in together:
                    found = [(i, *x) for i, t in enumerate(b.column(1)) for x in index.search(t.as_py())]
                    cols = list(zip(*found, strict=True)) if found else [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], arrow), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32())],
                        ["doc_id", "item_id", "distance", "first_word", "item_words"],
                    )

    return run


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that hold no item, told by doc_id: all rows of a leaking id go, and rows with a null one stay.

    Where ids repeat or are null, drop_leaking judges each row by its own text.
    """
    return docs.join(leaks.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_leaking(docs: DataFrame, items: DataFrame, similarity_pct: int = 80, min_words: int = 5) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item of ``min_words`` words; doc_id may repeat or be null.

    Shorter items say nothing about a document that holds them: clean prose does,
    too. ``find_leaks`` reports them; ``min_words=1`` drops such rows as well.
    """
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "decontam-rows")
    leaks = find_leaks(rows.select(F.col("_row").alias("doc_id"), "text"), items, similarity_pct, min_words)
    return rows.join(leaks.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*docs.columns)
