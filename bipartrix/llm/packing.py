"""Packing token sequences with minimum bin slack.

Documents longer than a window fill whole windows first; what is left over has
a length below the capacity. Each window is then planned from the counts of
remaining lengths alone: the longest length left, and of the others the
multiset that comes closest to the capacity, found by a subset-sum over a
bitset and traced back to counts. A plan repeats while the counts last, so
there are about as many plans as lengths, whatever the number of documents.
Pieces find their place by their rank among those of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.llm import tokens
from bipartrix.llm.common import materialise, running_totals, slices

#: (times, [(length, how many in the window)])
Plan = tuple[int, list[tuple[int, int]]]


def fullest(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """The multiset of lengths, within their counts, whose sum comes closest to ``room`` from below."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(size, left)  # 1, 2, 4, ... of this length at a time
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return list(used.items())


def plan_windows(counts: dict[int, int], capacity: int) -> list[Plan]:
    """Windows that use up all counts, by minimum bin slack with the longest length fixed in each."""
    left = {k: v for k, v in counts.items() if v}
    plans: list[Plan] = []
    while left:
        top = max(left)
        left[top] -= 1
        use = dict(fullest(capacity - top, {k: v for k, v in left.items() if v}))
        left[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(left[k] // n for k, n in use.items())
        for k, n in use.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        plans.append((times, sorted(use.items(), reverse=True)))
    return plans


def places(plans: list[Plan]) -> dict[str, np.ndarray]:
    """For each length and first rank: the first sequence, pieces of that length in one, and the offset of their first."""
    rows, done, seq = [], {}, 0
    for times, use in plans:
        at = 0
        for length, n in use:
            rank = done.get(length, 0)
            rows.append((length, rank, seq, n, at))
            done[length] = rank + times * n
            at += length * n
        seq += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "seq", "n", "at"), cols, strict=True))


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """Pieces of the documents: whole windows, then the rest; rank counts pieces of equal length in a partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = tokens.encoder(tokenizer).encode_all, TaskContext.get().partitionId(), {}
        for b in slices(batches):
            row, start, length, crc, total, rank, ids = [], [], [], [], [], [], []
            flat, counts = encode(b.column(1).cast(pa.binary()).to_pylist(), end_id)
            raw, at = memoryview(flat.astype("<u4").tobytes()), 0
            for i, n in enumerate(counts.tolist()):
                for s in range(0, n, capacity):
                    m = min(capacity, n - s)
                    piece = raw[4 * (at + s) : 4 * (at + s + m)]
                    row.append(i)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    rank.append(seen.get(m, 0))
                    seen[m] = rank[-1] + 1
                    ids.append(bytes(piece) if with_ids else None)
                at += n
            nums = [pa.array(x, pa.int64()) for x in (start, length, crc, total, rank)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *nums, pa.array([part] * len(row), pa.int32()), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "pid", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, rank long, pid int, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 1024, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document's tokens are its text's ids and ``end_id``; null texts count as
    empty. sequence_id and offset are gapless from 0; ids (little-endian
    unsigned 32-bit) is null without ``with_ids``. Each row of ``docs`` is packed,
    repeated rows and null doc_ids too; other columns are ignored; an empty table
    gives no rows.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, capacity, with_ids), "packing-pieces")
    parts = materialise(pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("pieces")), "packing-counts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}  # capacity rows at most
    plan = places(plan_windows(counts, capacity))
    ranked = pieces.join(running_totals(parts, "pid", ["pieces"], ["length"]), ["pid", "length"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1 << 44)
        keys = plan["length"] * wide + plan["rank"]
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(keys, length * wide + rank, side="right") - 1
            k = rank - plan["rank"][i]
            seq, at = plan["seq"][i] + k // plan["n"][i], plan["at"][i] + k % plan["n"][i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(at), b.column(6)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("pieces_before")).alias("rank"), "ids")
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
