"""Alignment of two tokenizers' tokens over the bytes of a text.

A is a byte-level BPE over space and text, B a sentencepiece model over the text
(which adds the space itself). Where token bytes joined give space and text, the
running sums of token lengths are byte offsets; offsets where tokens of both end
cut them into groups, and tokens whose byte ranges overlap are linked. All of
this is done for many texts at once with numpy.

How many documents hold an id pair linked is counted over all documents: each
task sums what it holds, a salted shuffle sums tasks, a second one the salts.
The counts, a row for each id pair, are looked up by tasks from a written table
block by block, so that documents are never shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.llm.common import holds, materialise, only, partitions, release, slices
from bipartrix.llm.files import open_file
from bipartrix.llm.tokens import MAX_PIECES, Memory, PieceEncoder, encoder

#: Bytes of texts that are aligned at once; longer texts go in parts.
CHUNK = 1 << 19
#: Id pairs that a task sums before it hands them on (16 bytes each).
SUMMED = 1 << 22
#: Rows of the pair table that a worker keeps (13 bytes each); larger tables are read block by block for each SUMMED pairs.
HELD = 1 << 22
SALTS = 8

#: Both tokenizers end a token before white space that follows something else.
BREAK = re.compile(rb"[^ \n](?=[ \n])")


class SentencePieces(PieceEncoder):
    """encode_all() over texts that begin with the space that the model adds.

    No piece of such a vocabulary has its space mark behind another character, and
    none has a line feed (both are checked), so merges never cross the start of a
    run of spaces or a line feed: the ids of a text are those of its parts.
    """

    breaks = BREAK

    def __init__(self, name: str):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=public_tokenizers.path(name))
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in x.lstrip("▁") or "\n" in x for x in names):
            raise ValueError(f"{name} has pieces that reach over spaces or lines")
        self.by_space = True
        self.mark = self.model.piece_to_id("▁")
        self.memory = Memory(MAX_PIECES)

    def whole(self, raw: bytes) -> bool:
        return False

    def bounds(self, data: np.ndarray, letter: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.zeros(len(data), bool)
        cut[first] = True
        cut[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        cut |= data == 10
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], len(data))

    def pieces(self, data: np.ndarray, letter: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
        raw = data.tobytes()
        own = [raw[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)]
        # The model puts a space mark before each text, which stands for the piece's own space, or goes again before a line feed.
        found = self.model.encode([(p if p[0] == 10 else p[1:]).decode() for p in own], num_threads=1)
        found = [x[1:] if p[0] == 10 else x or [self.mark] for p, x in zip(own, found, strict=True)]
        return [i for x in found for i in x], [len(x) for x in found]


class Vocabulary:
    """The bytes of each id, one after another, and the digits of each id."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.length = np.array([len(x) for x in entries], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        total = np.cumsum(n)
        return self.flat[np.repeat(self.first[ids] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]


def byte_level_vocabulary(enc: PieceEncoder) -> Vocabulary:
    """Entries are spelt with a letter for each byte."""
    byte = {chr(x): bytes([b]) for b, x in enumerate(enc.spell.tolist()) if b}
    byte |= {enc.tokenizer.pre_tokenizer.pre_tokenize_str("\0")[0][0][-1]: b"\0"}
    names = enc.tokenizer.get_vocab()
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = b"".join(byte.get(c, c.encode()) for c in name)
    return Vocabulary(out)


def piece_vocabulary(enc: SentencePieces) -> Vocabulary:
    m = enc.model
    return Vocabulary([bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())])


class Aligner:
    """Two encoders with their vocabularies; ids and digits of groups for many texts at once."""

    def __init__(self, a: str, b: str):
        self.a, self.b = encoder(a), SentencePieces(b)
        self.va, self.vb = byte_level_vocabulary(self.a), piece_vocabulary(self.b)
        top = max(self.va.size, self.vb.size)
        self.width = len(str(top - 1))
        text = np.array([f"{i:{self.width}d}" for i in range(top)], f"S{self.width}").view(np.uint8).reshape(top, self.width)
        self.digits = np.concatenate([text, np.zeros((top, 1), np.uint8)], axis=1)
        self.shown = np.concatenate([text != 32, np.ones((top, 1), bool)], axis=1)

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whether each part's bytes come back, ids of A and their number for each part, the same of B); other parts have no ids."""
        size = np.array([len(p) for p in parts], np.int64)
        good, out = np.ones(len(parts), bool), []
        for enc, v in ((self.a, self.va), (self.b, self.vb)):
            ids, n = enc.encode_all(parts)
            ends = np.cumsum(n)
            total = np.concatenate([[0], np.cumsum(v.length[ids])])
            right = total[ends] - total[ends - n] == size
            if right.all():
                differs = np.flatnonzero(v.joined(ids) != np.frombuffer(b"".join(parts), np.uint8))
                right[np.searchsorted(np.cumsum(size), differs, side="right")] = False
            else:  # one by one
                for i in np.flatnonzero(right):
                    right[i] = v.joined(ids[ends[i] - n[i] : ends[i]]).tobytes() == parts[i]
            good &= right
            out.append((ids, n))
        for k, (ids, n) in enumerate(out):
            out[k] = (ids[np.repeat(good, n)].astype(np.int64), np.where(good, n, 0))
        return good, *out[0], *out[1]

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray, bytes_of: np.ndarray) -> tuple[np.ndarray, ...]:
        """For token streams over the same bytes, of parts with so many bytes each.

        Returns the groups' end offsets, part and code (A id * size of B + B id)
        of each link, the groups' digits, and where each part's digits end in them.
        """
        ends = np.cumsum(bytes_of)
        end_a, end_b = np.cumsum(self.va.length[ids_a]), np.cumsum(self.vb.length[ids_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        start_a, start_b = end_a - self.va.length[ids_a], end_b - self.vb.length[ids_b]
        low = np.searchsorted(end_b, start_a, side="right")
        n = np.searchsorted(start_b, end_a) - low
        link_a = np.repeat(np.arange(len(ids_a)), n)
        link_b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)
        codes = ids_a[link_a] * self.vb.size + ids_b[link_b]
        part = np.repeat(np.searchsorted(ends, start_a, side="right"), n)
        # Digits: the tokens of A of a group, then those of B.
        many_a, many_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        to_a, to_b = np.cumsum(many_a), np.cumsum(many_b)
        ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[np.arange(len(ids_a)) + (to_b - many_b)[group_a]] = ids_a
        ids[np.arange(len(ids_b)) + to_a[group_b]] = ids_b
        mark[to_a + to_b - many_b - 1] = ord("|")
        mark[to_a + to_b - 1] = ord(";")
        shown = self.shown[ids]
        text = self.digits[ids]
        text[:, self.width] = mark
        last = (to_a + to_b)[np.searchsorted(cuts, ends)] - 1  # the last token of each part
        long = np.cumsum(shown.sum(1))
        return cuts, part, codes, text[shown], long[last]


@functools.cache
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def aligner(a: str, b: str) -> Aligner:
    only("tokens")  # the A side's encoder lives there
    out = _aligner(a, b)
    holds("alignment", _aligner.cache_clear)
    return out


class _Row:
    """What the parts of one document add up to."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.good, self.sha, self.text, self.codes = True, hashlib.sha256(), [], []


def aligned(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", with_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (if asked), pairs, times for each row of ``docs``.

    groups is ``a1,a2|b1;a3|b2,b3``: the decimal ids of A and of B, group by group;
    pairs has the codes of the document's different id pairs as little-endian
    64-bit integers, rising, and times how often each is linked, as 32-bit ones.
    Null and empty texts, and those whose tokens don't give their bytes back (as
    with U+2581 in them), have no tokens: zeros and empty strings. Long texts are
    aligned in parts that both tokenizers cut. Null and repeated doc_ids each give
    their row; other columns are ignored, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else []), "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a, b)
        for batch in slices(batches):
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            rows, todo, size = [_Row() for _ in raw], [], 0
            for i, t in enumerate(raw):
                for p in _parts(b" " + t if t else b""):
                    todo.append((i, p))
                    size += len(p)
                    if size >= CHUNK:
                        _add(al, rows, todo, with_groups)
                        todo, size = [], 0
            if todo:
                _add(al, rows, todo, with_groups)
            pairs, times = zip(*map(_pairs, rows), strict=True) if rows else ((), ())
            live = [r.good and r.n_a > 0 for r in rows]
            count = lambda f: pa.array([getattr(r, f) if x else 0 for r, x in zip(rows, live, strict=True)], pa.int64())
            cols = [batch.column(0), *map(count, ("n_a", "n_b", "n_groups", "n_links")), pa.array([r.sha.hexdigest() if x else "" for r, x in zip(rows, live, strict=True)], pa.string())]
            if with_groups:
                cols.append(pa.array([b"".join(r.text).decode() if x else "" for r, x in zip(rows, live, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pairs, pa.binary()), pa.array(times, pa.binary())], names)

    kinds = {"doc_id": kind, "groups_sha256": "string", "groups": "string", "pairs": "binary", "times": "binary"}
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def _parts(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > CHUNK:
        z = BREAK.search(raw, at + CHUNK)
        if z is None:
            break
        yield raw[at : z.start() + 1]
        at = z.start() + 1
    if len(raw) > at:
        yield raw[at:]


def _add(al: Aligner, rows: list[_Row], todo: list[tuple[int, bytes]], with_groups: bool) -> None:
    parts = [p for _, p in todo]
    good, ids_a, n_a, ids_b, n_b = al.encode(parts)
    for (i, _), ok in zip(todo, good.tolist(), strict=True):
        rows[i].good &= ok
    kept = [i for (i, _), ok in zip(todo, good.tolist(), strict=True) if ok]
    if not kept:
        return
    sizes = np.array([len(p) for p in parts], np.int64)[good]
    cuts, part, codes, text, to = al.align(ids_a, ids_b, sizes)
    groups = np.diff(np.searchsorted(cuts, np.cumsum(sizes), side="right"), prepend=0)
    links = np.bincount(part, minlength=len(kept))
    at, raw, begin = 0, memoryview(text.tobytes()), 0
    order = np.argsort((part << 33) | codes, kind="stable") if codes.max(initial=0) < 1 << 33 else np.lexsort((codes, part))
    codes = codes[order]
    for k, i in enumerate(kept):
        r, end = rows[i], int(to[k])
        own = raw[begin : end - 1]  # without the last mark
        if r.n_a:
            r.sha.update(b";")
        r.sha.update(own)
        if with_groups:
            r.text += [b";"] * bool(r.text) + [bytes(own)]
        r.n_a += int(n_a[good][k])
        r.n_b += int(n_b[good][k])
        r.n_groups += int(groups[k])
        r.n_links += int(links[k])
        r.codes.append(codes[at : at + int(links[k])])
        begin, at = end, at + int(links[k])


def _pairs(r: _Row) -> tuple[bytes, bytes]:
    if not (r.good and r.codes):
        return b"", b""
    if len(r.codes) == 1:  # sorted already
        x = r.codes[0]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return x[first].astype("<i8").tobytes(), np.diff(np.append(first, len(x))).astype("<i4").tobytes()
    x, n = np.unique(np.concatenate(r.codes), return_counts=True)
    return x.astype("<i8").tobytes(), n.astype("<i4").tobytes()


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """code, a, b, docs, best from aligned() rows: how many documents hold each id pair linked, and whether none of its A id's pairs is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS

        def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            x, back = np.unique(np.concatenate(codes), return_inverse=True)
            return x, np.bincount(back, np.concatenate(counts), len(x)).astype(np.int64)

        codes, counts, size = [], [], 0
        for batch in batches:
            x = np.frombuffer(b"".join(y or b"" for y in batch.column(0).to_pylist()), "<i8")
            codes.append(x)
            counts.append(np.ones(len(x), np.int64))
            size += len(x)
            if size >= SUMMED:
                x, n = summed(codes, counts)
                codes, counts, size = [x], [n], len(x)
                if size > SUMMED // 2:  # mostly different ones: hand them on
                    yield _counted(x, n, salt)
                    codes, counts, size = [], [], 0
        if size:
            yield _counted(*summed(codes, counts), salt)

    each = rows.select("pairs").mapInArrow(run, "code long, n long, salt int")
    salted = each.repartition(partitions(rows.sparkSession), "code", "salt").groupBy("code", "salt").agg(F.sum("n").alias("n"))
    counts = salted.groupBy("code").agg(F.sum("n").alias("docs"))
    counts = materialise(counts.select("code", F.expr(f"cast(code div {n_b} as int)").alias("a"), F.expr(f"cast(code % {n_b} as int)").alias("b"), "docs"), "align-counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each entry of A at most
    out = materialise(counts.join(most, "a").select("code", "a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")), "align-pairs")
    release(counts)
    return out


def _counted(x: np.ndarray, n: np.ndarray, salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(n), pa.array(np.full(len(x), salt, np.int32))], ["code", "n", "salt"])


class PairTable:
    """Counts of id pairs, from the files of a pair_counts() table."""

    def __init__(self, files: tuple[str, ...]):
        self.files, self.kept = files, None
        if sum(pq.ParquetFile(open_file(f)).metadata.num_rows for f in files) <= HELD:
            blocks = [*self.blocks(), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
            code, docs, best = (np.concatenate(x) for x in zip(*blocks, strict=True))
            order = np.argsort(code)
            self.kept = code[order], docs[order], best[order]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for f in self.files:
            for b in pq.ParquetFile(open_file(f)).iter_batches(1 << 20, columns=["code", "docs", "best"]):
                yield b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(docs, best) of each code."""
        if self.kept is not None:
            at = np.searchsorted(self.kept[0], codes)
            return self.kept[1][at], self.kept[2][at]
        own, back = np.unique(codes, return_inverse=True)
        docs, best = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        for code, n, top in self.blocks():
            at = np.minimum(np.searchsorted(own, code), max(0, len(own) - 1))
            here = np.flatnonzero(own[at] == code) if len(own) else at[:0]
            docs[at[here]], best[at[here]] = n[here], top[here]
        return docs[back], best[back]


@functools.cache
def _table(files: tuple[str, ...]) -> PairTable:
    return PairTable(files)


def cross_alignment(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", with_groups: bool = True) -> DataFrame:
    """aligned() rows with n_best and count_sum instead of pairs and times.

    A link's count is the number of documents (rows of ``docs``) that hold its id
    pair linked; count_sum adds it over the document's links, and n_best counts
    links whose count is the highest of any pair with their A id, ties included.
    Rows without tokens have zeros; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialise(aligned(docs, a, b, with_groups), "align-rows")
    table = pair_counts(rows, _piece_count(b))
    files = tuple(sorted(table.inputFiles()))
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pairs")
        known = _table(files)
        holds("pairs", _table.cache_clear)
        held, size = [], 0
        for batch in slices(batches):
            held.append(batch)
            size += sum(len(x.as_py() or b"") for x in batch.column("pairs")) // 8
            if size >= SUMMED or known.kept is not None:
                yield from score(known, held)
                held, size = [], 0
        yield from score(known, held)

    def score(known: PairTable, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in [pa.Table.from_batches(held).combine_chunks().to_batches()] if held else []:
            for x in batch:
                codes = [np.frombuffer(y or b"", "<i8") for y in x.column("pairs").to_pylist()]
                times = np.frombuffer(b"".join(y or b"" for y in x.column("times").to_pylist()), "<i4").astype(np.int64)
                n, best = known.look_up(np.concatenate([np.zeros(0, np.int64), *codes]))
                ends = np.cumsum([len(y) for y in codes])
                per = lambda v, ends=ends: np.diff(np.concatenate([[0], np.cumsum(v)])[ends], prepend=0)
                yield pa.RecordBatch.from_arrays([*[x.column(c) for c in keep], pa.array(per(times * best)), pa.array(per(times * n))], [*keep, "n_best", "count_sum"])

    kinds = {"doc_id": kind, "groups_sha256": "string", "groups": "string"}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in [*keep, "n_best", "count_sum"]))


def _piece_count(name: str) -> int:
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path(name)).get_piece_size()
