"""Repeated passages by longest-previous-factor tests in a partitioned suffix order.

A byte goes when a string of ``length`` bytes that covers it also starts
elsewhere. For a position that is the test LPF >= length, of the longest
previous factor array, or its mirror image for later copies. LPF is the larger
common prefix with the previous or next suffix, in suffix order, that starts at
a smaller position (Crochemore and Ilie 2008).

No task ever sorts the suffixes of the whole corpus. Each suffix is sent to a
bucket that its first ``length`` bytes alone decide: the k-gram of least hash in
them (winnowing, Schleimer et al. 2003). Suffixes that agree on ``length`` bytes
share a bucket, so the suffix order of each bucket decides every test: values of
LPF below ``length`` only say that, for shorter matches may lie in other buckets.
Neighbouring positions with the same anchor travel as one row, a run; runs with
equal text (by its BLAKE2b digest of 128 bits) are one class, counted before the
shuffle. Only buckets that hold different classes are put in suffix order; those
with more classes than a task should order are dealt anew by shorter runs, and by
the bytes that all strings of such a run share, until a run is one string. The
rolling hash picks anchors and buckets only: what it takes for equal meets, and is
then told apart by bytes or digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bipartrix.llm.common import is_empty, materialise, only, partitions, prefix_hash, release, slices, span_hash, text_or_empty

#: Positions that are scanned at once; longer texts are scanned in pieces.
PIECE = (1 << 19) - 1024
#: Buckets with more classes than this are dealt anew before they meet in one task; so many runs are 3 MB of text.
LARGE_BUCKET = 4096
#: Positions of the runs that they are dealt by, in turn.
SHORTER = (32, 4, 1)

ANCHOR = "struct<key:bigint,hull:bigint,more:bigint,s:bigint,n:int,o:int,c:bigint>"
#: What names a class of runs with one text.
CLASS = ["key", "o", "n", "hull", "more"]
SPANS = "array<struct<s:bigint,e:bigint>>"


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b of raw[start:end] as two 64-bit numbers each."""
    view = memoryview(raw)
    out = b"".join([hashlib.blake2b(view[a:z], digest_size=16).digest() for a, z in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def runs_of(data: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of suffix positions with one anchor in the concatenated pieces data[bounds[i]:bounds[i + 1]].

    Returns piece, start, number of positions, offset of the start from the
    anchor (0 or less), bucket key and digest of the run's text (its hull).
    """
    w = length - k + 1
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n < 1:
        return none, none, none, none, none.astype(np.uint64), np.zeros((0, 2), np.int64)
    h = prefix_hash(data)
    at = np.arange(len(data) - k + 1)
    grams = span_hash(h, at, at + k)
    v = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties go to the left
    full = np.concatenate([v, np.full(-len(v) % w, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)[w - 1 : w - 1 + n]
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    anchor = (np.minimum(ahead, behind) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    piece = np.searchsorted(bounds, np.arange(n), side="right") - 1
    inside = np.arange(n) + length <= bounds[piece + 1]
    starts = np.flatnonzero(inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
    last = np.flatnonzero(inside & np.concatenate([(anchor[1:] != anchor[:-1]) | ~inside[1:] | (piece[1:] != piece[:-1]), [True]]))
    return piece[starts], starts, last - starts + 1, starts - anchor[starts], grams[anchor[starts]], digests(data.tobytes(), starts, last + length)


def merge_spans(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [s, e), touching ones joined."""
    if not len(s):
        return s, e
    order = np.argsort(s, kind="stable")
    s, top = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], s[1:] > top[:-1]])
    return s[new], top[np.concatenate([new[1:], [True]])]


def text_hash() -> F.Column:
    """With doc_id, this names a document; rows that repeat both are one document here."""
    return F.xxhash64(text_or_empty("text")).alias("th")


def scan(docs: DataFrame, length: int, k: int, keep_first: bool) -> DataFrame:
    """doc_id, th (64-bit hash of the text), n_bytes, sha256 (hex), anchors (one per distinct run of the text), own (spans that repeat inside the text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in texts]
            todo = [(i, a) for i, t in enumerate(texts) if len(t) >= length for a in range(0, len(t) - length + 1, PIECE)]
            while todo:
                parts, size = [], 0
                while todo and (not parts or size < PIECE):
                    i, a = todo.pop()
                    parts.append((i, a, texts[i][a : a + PIECE + length - 1]))
                    size += len(parts[-1][2])
                bounds = np.cumsum([0, *[len(p[2]) for p in parts]])
                piece, start, n, o, key, hull = runs_of(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), bounds, length, k)
                cut = np.searchsorted(piece, np.arange(len(parts) + 1))
                for j, (i, a, _) in enumerate(parts):
                    sl = slice(cut[j], cut[j + 1])
                    found[i].append((start[sl] - bounds[j] + a, n[sl], o[sl], key[sl], hull[sl]))
            out = []
            for i, runs in enumerate(found):
                if not runs:
                    out.append(([], []))
                    continue
                s, n, o, key, hull = (np.concatenate(x) for x in zip(*runs, strict=True))
                order = np.lexsort((s, n, o, hull[:, 1], hull[:, 0], key))
                s, n, o, key, hull = s[order], n[order], o[order], key[order], hull[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (hull[1:] != hull[:-1]).any(1) | (o[1:] != o[:-1]) | (n[1:] != n[:-1])])
                c = np.diff(np.append(np.flatnonzero(new), len(s)))
                again = ~new if keep_first else np.repeat(c > 1, c)
                spans = merge_spans(s[again], (s + n + length - 1)[again])
                cols = key[new].view(np.int64), hull[new, 0], hull[new, 1], s[new], n[new], o[new], c
                out.append(([dict(zip(("key", "hull", "more", "s", "n", "o", "c"), r, strict=True)) for r in zip(*(x.tolist() for x in cols), strict=True)], [{"s": x, "e": y} for x, y in zip(*(z.tolist() for z in spans), strict=True)]))
            anchor = pa.list_(pa.struct([("key", pa.int64()), ("hull", pa.int64()), ("more", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("o", pa.int32()), ("c", pa.int64())]))
            span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([x[0] for x in out], anchor), pa.array([x[1] for x in out], span)],
                ["doc_id", "th", "n_bytes", "sha256", "anchors", "own"],
            )

    return docs.select("doc_id", "text", text_hash()).mapInArrow(run, f"doc_id {kind}, th long, n_bytes long, sha256 string, anchors array<{ANCHOR}>, own {SPANS}")


def prefix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(m, rank of each position's first m bytes in lexicographic order) for m = 1, 2, 4, ... 8, 16, ... and length.

    Rank doubling: a string of 2 m bytes is the pair of its halves' ranks. Only
    positions with m bytes left have a rank that means something.
    """
    n = len(data)
    word = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    m = min(8, length)
    for i in range(m):
        word |= padded[i : i + n] << np.uint64(8 * (7 - i))
    out = [(m, np.unique(word, return_inverse=True)[1])]
    while m < length:
        step = min(m, length - m)  # the last pair overlaps
        rank = out[-1][1]
        second = np.concatenate([rank[step:], np.zeros(step, rank.dtype)])
        m += step
        out.append((m, np.unique(rank * (int(rank.max(initial=0)) + 1) + second, return_inverse=True)[1]))
    return out


def common_prefix(data: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share, up to the longest length ranked."""
    length = ranks[-1][0]
    out = np.where(ranks[-1][1][a] == ranks[-1][1][b], length, 0)
    some = np.flatnonzero(out == 0)
    at = np.zeros(len(some), np.int64)
    for m, rank in ranks[-2::-1]:
        same = rank[a[some] + at] == rank[b[some] + at]
        at[same] += m
    for _ in range(min(7, length)):  # within the 8 bytes that differ
        same = data[a[some] + at] == data[b[some] + at]
        at[same] += 1
        if not same.any():
            break
    out[some] = np.minimum(at, length - 1)
    return out


def nearest_smaller(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix in suffix order, the common prefix with the nearest one before it whose place is smaller; 0 if there is none.

    lcp[i] is that of suffixes i - 1 and i. All suffixes jump at once: past one
    with a larger place lie only larger ones, up to where that one has got.
    """
    n = len(place)
    at, least = np.arange(-1, n - 1), lcp.copy()
    while True:
        go = np.flatnonzero((at >= 0) & (least > 0))
        go = go[place[at[go]] > place[go]]
        if not len(go):
            break
        to = at[go]
        at[go], least[go] = at[to], np.minimum(least[go], least[to])
    least[at < 0] = 0
    return least


def longest_previous_factors(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF of suffixes in suffix order: the longer of the matches with the previous and the next smaller place."""
    after = np.concatenate([lcp[1:], [0]])[::-1]
    return np.maximum(nearest_smaller(place, lcp), nearest_smaller(place[::-1], after)[::-1])


def small_buckets(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(doc_id, th, s, e) to remove, from the runs of whole buckets; a bucket's runs meet in one task, LARGE_BUCKET at most.

    A bucket's suffixes are put in suffix order by rank doubling on their bytes,
    and LPF follows from common prefixes and nearest smaller positions.
    """
    kind = contexts.schema["doc_id"].dataType.simpleString()

    def solve(t: pa.Table) -> pa.RecordBatch:
        b = t.combine_chunks().to_batches()[0]
        key, o, s, n = (b.column(c).to_numpy() for c in ("key", "o", "s", "n"))
        raw = b.column("ctx").to_pylist()
        data = np.frombuffer(b"".join(raw), np.uint8)
        off = np.cumsum([0, *[len(x) for x in raw]])[:-1]
        row = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = off[row] + j
        ranks = prefix_ranks(data, length)
        # Runs come by document and place; of one document, a suffix's place grows with its anchor's and its offset from it.
        document = np.cumsum(np.concatenate([[False], _changes(b, ("doc_id", "th"))]))[row]
        place = np.empty(len(row), np.int64)
        place[np.lexsort((s[row] + j, document))] = np.arange(len(row))
        order = np.lexsort((place, ranks[-1][1][at], key[row]))
        lcp = np.zeros(len(row), np.int64)
        same = key[row[order]][1:] == key[row[order]][:-1]
        lcp[1:][same] = common_prefix(data, ranks, at[order][:-1][same], at[order][1:][same])
        gone = np.empty(len(row), bool)
        gone[order] = longest_previous_factors(place[order], lcp) >= length
        if not keep_first:  # later copies count too
            gone[order] |= longest_previous_factors(-place[order], lcp) >= length
        edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
        cut = np.concatenate([[False], (row[1:] != row[:-1]) & gone[1:] & gone[:-1], [False]]) if len(row) else np.zeros(1, bool)
        a, z = np.flatnonzero((edge == 1) | cut), np.flatnonzero((edge == -1) | cut) - 1
        r = row[a]
        first = s[r] + j[a]
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(r)), b.column("th").take(pa.array(r)), pa.array(first), pa.array(first + (z - a) + length)], ["doc_id", "th", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            key = held.column("key").to_numpy()
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on in the next batch
            for a in range(0, done, 500):
                lo, hi = (int(np.searchsorted(key, key[x])) if x < done else done for x in (a, min(a + 500, done)))
                if hi > lo:
                    yield solve(held.slice(lo, hi - lo))
            held = held.slice(done)
        if held is not None and held.num_rows:
            yield solve(held)

    ordered = contexts.repartition(partitions(contexts.sparkSession), "key").sortWithinPartitions("key", "doc_id", "th", F.col("s") - F.col("o"))
    return ordered.mapInArrow(run, f"doc_id {kind}, th long, s long, e long")


def _changes(b: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Whether each row but the first differs from the one before in any of the columns."""
    out = np.zeros(max(0, b.num_rows - 1), bool)
    for c in names:
        x = b.column(c)
        code = x.dictionary_encode(null_encoding="encode").indices.to_numpy()
        out |= code[1:] != code[:-1]
    return out


def shorter_runs(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """The runs of some contexts cut at multiples of ``block`` from their anchor, in buckets of their own.

    All strings of such a run share the bytes from its last possible start to the
    end of its first possible string. Two strings that are equal lie equally far
    from equal anchors, so they share those bytes too: their digest is the bucket.
    """
    kind = contexts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        for b in slices(batches):
            key, o, s, n = (b.column(c).to_numpy().astype(np.int64) for c in ("key", "o", "s", "n"))
            raw = b.column("ctx").to_pylist()
            row, at, size, names, texts = [], [], [], [], []
            for r, text in enumerate(raw):
                end = o[r] + n[r]
                for j in range(o[r] // block, (end - 1) // block + 1):
                    a, z = max(o[r], j * block), min(end, (j + 1) * block)
                    core = text[(j + 1) * block - 1 - o[r] : j * block + length - o[r]]
                    names.append(hashlib.blake2b(core, digest_size=8, key=(f"{key[r]} {j}").encode()).digest())
                    texts.append(text[a - o[r] : z - o[r] + length - 1])
                    row.append(r)
                    at.append(a)
                    size.append(z - a)
            row, at, size = np.array(row, np.int64), np.array(at, np.int64), np.array(size, np.int64)
            hull = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in texts]), np.int64).reshape(-1, 2)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(names), np.int64)), pa.array(at), pa.array(size), pa.array(hull[:, 0]), pa.array(hull[:, 1]), pa.array(s[row] + at - o[row]), b.column("doc_id").take(take), b.column("th").take(take), pa.array(texts, pa.binary())],
                ["key", "o", "n", "hull", "more", "s", "doc_id", "th", "ctx"],
            )

    return contexts.select("key", "o", "s", "n", "doc_id", "th", "ctx").mapInArrow(run, f"key long, o long, n long, hull long, more long, s long, doc_id {kind}, th long, ctx binary")


def mixed_buckets(contexts: DataFrame, length: int, keep_first: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(spans to remove from the runs of contexts with their bucket's number of classes m, the tables made for it)."""
    spans, made = small_buckets(contexts.where(F.col("m") <= LARGE_BUCKET), length, keep_first), []
    for block in SHORTER:
        large = contexts.where(F.col("m") > LARGE_BUCKET)
        if is_empty(large):
            break
        runs = materialise(shorter_runs(large, length, block), "lpf-shorter")
        place = F.struct("doc_id", "th", "s")
        classes = materialise(runs.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("first")), "lpf-shorter-classes")
        copies = runs.drop("ctx").join(classes.where("rows > 1").select(*CLASS, "first"), CLASS)
        if keep_first:
            copies = copies.where(~place.eqNullSafe(F.col("first")))
        spans = spans.unionByName(copies.select("doc_id", "th", "s", (F.col("s") + F.col("n") + length - 1).alias("e")))
        # One run of each class goes on, where its bucket has others.
        several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "m")
        first = classes.join(several, "key").select(*CLASS, "m", "first")
        contexts = materialise(runs.join(first, CLASS).where(place.eqNullSafe(F.col("first"))).select("key", "o", "n", "m", "s", "doc_id", "th", "ctx"), "lpf-shorter-contexts")
        made += [runs, classes, contexts]
        last = block == SHORTER[-1]  # then a bucket's runs are equal, but for keys that clash
        spans = spans.unionByName(small_buckets(contexts if last else contexts.where(F.col("m") <= LARGE_BUCKET), length, keep_first))
    return spans, made


def repeated_spans(docs: DataFrame, length: int = 400, anchor: int = 100, keep_first: bool = True) -> DataFrame:
    """doc_id, th, n_bytes, sha256 (of the whole text), spans, n_removed, n_spans for each row of ``docs``.

    spans are the maximal byte runs covered by strings of ``length`` bytes that
    also start elsewhere: with ``keep_first`` at an earlier place (by doc_id,
    nulls first, then position; rows that repeat doc_id and text are one
    document), else at any other place (repeated rows count as places). Matches
    never cross documents. Null texts count as empty; texts under ``length`` bytes
    have no span. 1 <= anchor <= length.
    """
    if not 1 <= anchor <= length:
        raise ValueError("anchor must be between 1 and length")
    found = materialise(scan(docs, length, anchor, keep_first), "lpf-scan")
    runs = found.select("doc_id", "th", F.inline("anchors"))
    crowded = runs.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    runs = materialise(runs.join(crowded, "key", "left_semi"), "lpf-runs")
    who = F.struct("doc_id", "th", "s")
    classes = materialise(runs.groupBy(*CLASS).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("rows"), F.min(who).alias("first")), "lpf-classes")
    # Whole runs that occur elsewhere as they are.
    copies = runs.join(classes.where("rows > 1").select(*CLASS, "first"), CLASS)
    if keep_first:
        copies = copies.where(~F.struct("doc_id", "th").eqNullSafe(F.struct("first.doc_id", "first.th")))
    spans = copies.select("doc_id", "th", "s", (F.col("s") + F.col("n") + length - 1).alias("e"))
    # Buckets of different classes: look at each position of one run of each class.
    mixed = classes.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least")).where("m > 1" if keep_first else "m > 1 AND least = 1").select("key", "m")
    runs_at = classes.join(mixed, "key").select(*CLASS, "m", "first.*")
    wanted = runs_at.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*CLASS, "m", "s")).alias("runs"))
    texts = docs.select(F.col("doc_id").alias("_d"), text_or_empty("text").alias("text")).withColumn("_t", F.xxhash64("text"))
    at = texts.join(wanted.hint("shuffle_hash"), F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("th")))
    cut = at.select("doc_id", "th", F.encode("text", "UTF-8").alias("raw"), F.explode("runs").alias("r")).select(
        "doc_id", "th", *[f"r.{c}" for c in CLASS], "r.m", "r.s", F.expr(f"substring(raw, cast(r.s AS int) + 1, r.n + {length - 1})").alias("ctx")
    )
    contexts = materialise(cut.dropDuplicates(CLASS).select("key", "o", "n", "m", "s", "doc_id", "th", "ctx"), "lpf-contexts")
    mixed_spans, made = mixed_buckets(contexts, length, keep_first)
    spans = spans.unionByName(mixed_spans)
    per_doc = spans.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("more"))
    per_doc = per_doc.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "more")
    all_spans = found.drop("anchors").join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    whole = all_spans.select("doc_id", "th", "n_bytes", "sha256", F.concat("own", F.coalesce("more", F.array().cast(SPANS))).alias("spans")).mapInArrow(
        merge_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n_bytes long, sha256 string, spans {SPANS}, n_removed long, n_spans long"
    )
    out = materialise(whole, "lpf-found")
    release(found, runs, classes, contexts, *made)
    return out


def merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, removed = [], []
        for row in b.column("spans").to_pylist():
            s, e = merge_spans(np.array([x["s"] for x in row], np.int64), np.array([x["e"] for x in row], np.int64))
            spans.append([{"s": x, "e": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
            removed.append(int((e - s).sum()))
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(spans, kind), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64())], ["doc_id", "th", "n_bytes", "sha256", "spans", "n_removed", "n_spans"])


def cut_spans(raw: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for x in spans:
        out.append(raw[at : x["s"]])
        at = x["e"]
    out.append(raw[at:])
    return b"".join(out)


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lose a part of their text, with ``spans``, ``n_bytes``, ``n_removed`` and ``n_spans``."""
    part = found.where("n_removed > 0 AND n_removed < n_bytes").dropDuplicates(["doc_id", "th"])
    part = part.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans", "n_bytes", "n_removed", "n_spans")
    return docs.withColumn("_th", F.xxhash64(text_or_empty("text"))).join(part.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))).drop("_th", "_d", "_t")


def removal_digest(docs: DataFrame, length: int = 400, anchor: int = 100, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``.

    Spans are those of repeated_spans(). Null texts count as empty, and an empty
    text has the digest of no bytes; null and repeated doc_ids each give their
    row; very long texts are scanned in pieces; other columns are ignored; an
    empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeated_spans(docs, length, anchor, keep_first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, spans = b.column(4).cast(pa.binary()).to_pylist(), b.column(5).to_pylist()
            digest = [hashlib.sha256(cut_spans(t, s)).hexdigest() for t, s in zip(raw, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    part = with_spans(docs.select("doc_id", "text"), found).select("doc_id", "n_bytes", "n_removed", "n_spans", "text", "spans")
    part = part.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rest = found.where("n_removed = 0 OR n_removed = n_bytes")
    rest = rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.when(F.col("n_removed") == 0, F.col("sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("kept_sha256"))
    return rest.unionByName(part)


def cleaned(docs: DataFrame, length: int = 200, anchor: int = 100) -> DataFrame:
    """``docs`` without the bytes that earlier documents, or earlier places, hold: the first copy stays.

    Rows and columns stay as they are but for ``text`` (and ``n_chars``, where
    there is one, which follows it) of documents that lose something; a text that
    goes whole becomes empty. Characters cut in two are dropped.
    """
    found = repeated_spans(docs, length, anchor, keep_first=True).where("n_removed > 0")
    kept = found.dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans")
    # The row travels as one struct, so that no column's name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(text_or_empty("text")).alias("_h"))
    both = rows.join(kept.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left")
    whole, row = F.col("spans").isNull(), F.col("row")
    both = both.select("row", "spans", F.when(whole, row["text"]).otherwise(_without(row["text"], F.col("spans"))).alias("cut"))
    out = {c: row[c] for c in docs.columns} | {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("spans").isNull(), row["n_chars"]).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType)
    return both.select(*[x.alias(c) for c, x in out.items()])


@F.pandas_udf(StringType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without their spans; most rows have none and pass unread."""
    return pd.Series([None if s is None else cut_spans(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)])
