"""Token-id files in ascending doc_id order, in range-coded, checksummed blocks.

A file is a row of groups. A group holds whole documents: a zlib'd JSON list of
their doc_ids and id counts, the different ids with their shares of the group,
then the blocks of the joined ids, each with its number of ids, its length and
the CRC-32 of its ids and of its bytes, and each coded from an empty model. The
range partitions of the doc_ids become one file each.

    group:  head, index, shares (zlib'd: the ids, then their shares, both uint32),
            then (uint32 ids, uint32 bytes, uint32 crc32 of ids, uint32 crc32 of bytes) per block, then the blocks
    head:   b"BXT3", uint32 bytes of index, uint32 bytes of shares, uint32 number of blocks, uint64 bytes of blocks,
            uint64 ids of the file before the group, uint32 crc32 of what lies between head and blocks, uint32 crc32 of the head

Damage is named, or passed over: a broken block loses the documents that have ids
in it, what stands before the blocks its group. Groups are found again by a head
that has its checksum.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.llm import files, rangecoder, tokens
from bipartrix.llm.common import materialise, new_path, partitions, running_totals, slices

MAGIC, HEAD = b"BXT3", struct.Struct("<4sIIIQQII")
#: Ids that a group holds at most, unless a single document has more: what the coder takes in one go.
GROUP_IDS = rangecoder.BLOCK * rangecoder.LANES
#: Ids lie below this (the shares of a group's different ids need room beside each other).
ID_LIMIT = rangecoder.MOST_IDS


def write_group(out, doc_ids: list, counts: list[int], ids: np.ndarray, before: int = 0) -> None:
    if len(ids) and int(ids.max()) >= ID_LIMIT:
        raise ValueError(f"ids must be below {ID_LIMIT}")
    index = zlib.compress(json.dumps([doc_ids, counts]).encode(), 1)
    shares = rangecoder.Shares.of(np.bincount(ids))
    named = zlib.compress(shares.ids.astype("<u4").tobytes() + shares.share.astype("<u4").tobytes(), 6)
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
    rank[shares.ids] = np.arange(len(shares.ids))
    cut = [ids[a : a + rangecoder.BLOCK] for a in range(0, len(ids), rangecoder.BLOCK)]
    coded: list[bytes] = []
    for a in range(0, len(cut), rangecoder.LANES):
        coded += rangecoder.encode([rank[x] for x in cut[a : a + rangecoder.LANES]], shares)
    table = b"".join(struct.pack("<IIII", len(b), len(c), zlib.crc32(b.astype("<u4").tobytes()), zlib.crc32(c)) for b, c in zip(cut, coded, strict=True))
    body = index + named + table
    head = HEAD.pack(MAGIC, len(index), len(named), len(cut), sum(map(len, coded)), before, zlib.crc32(body), 0)[:-4]
    out.write(head + struct.pack("<I", zlib.crc32(head)) + body)
    for c in coded:
        out.write(c)


class Damaged(ValueError):
    """Bytes of a token file don't have their checksum."""


def _next_head(raw, skip: bool) -> bytes:
    """The next head of a group that has its checksum; empty at the end of the file."""
    held = raw.read(HEAD.size)
    while held:
        if len(held) == HEAD.size and held[:4] == MAGIC and zlib.crc32(held[:-4]) == HEAD.unpack(held)[-1]:
            return held
        if not skip:
            raise Damaged("the head of a group of token ids is damaged")
        if len(held) < HEAD.size:
            return b""
        at = held.find(MAGIC[:1], 1)
        held = held[at if at > 0 else len(held) :]
        held += raw.read(HEAD.size - len(held))
    return held


def read_groups(raw, on_damage: str = "raise") -> Iterator[tuple[list, list[int], np.ndarray, list[bool], int]]:
    """(doc_ids, counts, ids, which documents are sound, ids of the file before) of each group.

    A wrong checksum raises Damaged. With ``on_damage="skip"`` a group is left
    out if its head or index has one, and documents with ids in a broken block
    aren't sound: their ids there are 0.
    """
    skip = on_damage == "skip"
    while head := _next_head(raw, skip):
        _, size, named, n, size_blocks, before, check, _ = HEAD.unpack(head)
        body = raw.read(size + named + 16 * n)
        if zlib.crc32(body) != check:
            if not skip:
                raise Damaged("the index of a group of token ids is damaged")
            while size_blocks and (passed := raw.read(min(size_blocks, 1 << 20))):
                size_blocks -= len(passed)
            continue
        doc_ids, counts = json.loads(zlib.decompress(body[:size]))
        ids, share = np.frombuffer(zlib.decompress(body[size : size + named]), "<u4").reshape(2, -1)
        shares = rangecoder.Shares(ids.astype(np.int64), share)
        blocks = np.frombuffer(body[size + named :], "<u4").reshape(n, 4)
        got: list[np.ndarray] = []
        broken: list[int] = []
        for a in range(0, n, rangecoder.LANES):
            part = blocks[a : a + rangecoder.LANES]
            coded = [raw.read(x) for x in part[:, 1].tolist()]
            whole = [zlib.crc32(c) == x for c, x in zip(coded, part[:, 3].tolist(), strict=True)]
            sizes = part[:, 0].tolist()
            read = iter(rangecoder.decode([c for c, w in zip(coded, whole, strict=True) if w], [s for s, w in zip(sizes, whole, strict=True) if w], shares))
            for j, w in enumerate(whole):
                x = ids[next(read)] if w else np.zeros(sizes[j], "<u4")
                if not w or zlib.crc32(x.tobytes()) != int(part[j, 2]):
                    if not skip:
                        raise Damaged("a block of token ids doesn't have its checksum")
                    broken.append(a + j)
                got.append(x)
        ends, starts = np.cumsum(counts), np.cumsum(counts) - counts
        bad = np.zeros(len(counts), bool)
        for j in broken:
            bad |= (starts < (j + 1) * rangecoder.BLOCK) & (ends > j * rangecoder.BLOCK)
        sound = ~bad | (ends == starts)  # an empty document has no ids to lose
        yield doc_ids, counts, np.concatenate(got) if got else np.zeros(0, "<u4"), sound.tolist(), before


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, n_files: int) -> DataFrame:
    """Encode and write; (file_no, path) in ascending order of doc_id, nulls first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = tokens.encoder(tokenizer).encode_all, TaskContext.get().partitionId()
        path = out = None
        doc_ids, counts, ids, size, written = [], [], [], 0, 0

        def close_group() -> None:
            nonlocal written
            write_group(out, doc_ids, counts, np.concatenate(ids), written)
            written += sum(counts)
            for x in (doc_ids, counts, ids):
                x.clear()

        for b in slices(batches):
            if out is None:
                path, out = files.create(folder, f"part-{part:05d}", ".tokens")
            flat, n = encode(b.column(1).cast(pa.binary()).to_pylist(), end_id)
            names, ends, row, at = b.column(0).to_pylist(), np.cumsum(n), 0, 0
            while row < len(n):
                room = int(np.searchsorted(ends, at + GROUP_IDS - size, side="right"))
                if room == row and size:  # the next document doesn't fit
                    close_group()
                    size = 0
                    continue
                to = max(room, row + 1)
                doc_ids += names[row:to]
                counts += n[row:to].tolist()
                ids.append(flat[at : ends[to - 1]])
                size += int(ends[to - 1]) - at
                row, at = to, int(ends[to - 1])
        if out is not None:
            close_group()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path])], ["file_no", "path"])

    # The text itself stays out of the range key, of which the driver gets samples.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = docs.select("doc_id", "text").repartitionByRange(n_files, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return ranged.mapInArrow(run, "file_no int, path string")


def read_token_files(written: DataFrame, doc_id_type: str, with_ids: bool = True, on_damage: str = "raise") -> DataFrame:
    """A row for each document of the files: file_no, doc_id, start_in_file, n_tokens, ids_crc32, ids.

    With ``on_damage="skip"``, documents of damaged groups are absent and those
    of damaged blocks have null ids and ids_crc32; the others are as written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_no", "doc_id", "start_in_file", "n_tokens", "ids_crc32", "ids"]
        for b in batches:
            for no, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input(path) as raw:
                    for doc_ids, counts, ids, sound, at in read_groups(raw, on_damage):
                        cut = np.cumsum([0, *counts])
                        own = [ids[x:y].tobytes() if ok else None for x, y, ok in zip(cut[:-1], cut[1:], sound, strict=True)]
                        cols = [pa.array([no] * len(own), pa.int32()), pa.array([None if i is None else str(i) for i in doc_ids], pa.string()), pa.array(at + cut[:-1], pa.int64()), pa.array(counts, pa.int64())]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([None if x is None else zlib.crc32(x) for x in own], pa.int64()), pa.array(own if with_ids else [None] * len(own), pa.binary())], names)

    rows = written.select("file_no", "path").mapInArrow(run, "file_no int, doc_id string, start_in_file long, n_tokens long, ids_crc32 long, ids binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast(doc_id_type))


def store_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, folder: str | None = None, n_files: int | None = None, with_ids: bool = True) -> DataFrame:
    """Write the ids of all documents, read the files back: doc_id, start, n_tokens, ids_crc32, ids.

    A document's ids are its text's and ``end_id``; null texts count as empty.
    start counts the ids of all documents before it by doc_id (nulls first, ties
    by a hash of the text, then the text). doc_ids are integers or strings, ids
    lie below ID_LIMIT. Each row of ``docs`` is stored; other columns are ignored;
    an empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    written = materialise(write_token_files(docs, folder, tokenizer, end_id, n_files or partitions(spark)), "token-files")
    n = written.count()  # the names of the files: one to a task
    read = read_token_files(written.repartition(max(1, n)), docs.schema["doc_id"].dataType.simpleString(), with_ids)
    read = materialise(read, "token-rows")
    before = running_totals(read.groupBy("file_no").agg(F.sum("n_tokens").alias("n")), "file_no", ["n"])
    return read.join(F.broadcast(before), "file_no").select("doc_id", (F.col("n_before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32", "ids")
