"""WARC archives from pages, written and read as streams of chunks.

A payload travels as rows (record, chunk number, bytes): the writer feeds the
rows of a record to its gzip member one by one, and the reader yields rows of
the same kind, each with the SHA-1 of the payload up to its end. No task ever
holds a whole record of its own making. Of equal payloads one record is the
response; the others are revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.llm import files
from bipartrix.llm.common import materialise, new_path, text_or_empty

CHUNK = 1 << 20
#: Rows and bytes of an Arrow batch of chunks.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
DATE = "2000-01-01T00:00:00Z"
RECORD_ID = "urn:x-page:"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, n_bytes, sha1 (hex) and ``first``: the response's page_id where the row is a revisit, else null."""
    rows = pages.select("page_id", "url", F.encode(text_or_empty("html"), "UTF-8").alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    # Only payloads that occur twice need a look-up; written out first, so that the join knows its size.
    heads = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
    again = materialise(heads.where("c > 1 AND first IS NOT NULL").select(F.col("sha1").alias("_s"), F.col("n_bytes").alias("_n"), "first"), "warc-again")
    return rows.join(again, (F.col("sha1") == F.col("_s")) & (F.col("n_bytes") == F.col("_n")), "left").select(
        "page_id", "url", "payload", "n_bytes", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    )


def payload_chunks(records: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunk rows of records, those of a record in a run and in order; a revisit or empty payload has one, empty."""
    n = F.when(F.col("first").isNull(), F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes))).otherwise(F.lit(1)).cast("int")
    cut = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    data = F.when(F.col("first").isNull(), F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return cut.select("page_id", "url", "n_bytes", "sha1", "first", "chunk_no", data.alias("data"))


def header(page_id, url: str | None, n_bytes: int, sha1: str, first, date: str) -> bytes:
    """The head of a record; a null page_id is named ``null``."""
    name = "null" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{_b32(bytes.fromhex(sha1))}")
    if first is not None:
        lines += [f"WARC-Refers-To: <{RECORD_ID}{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    # An extension field: how long the payload is that a revisit leaves out.
    lines += [f"WARC-Payload-Length: {n_bytes}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {n_bytes if first is None else 0}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def write_warc(chunks: DataFrame, folder: str, date: str = DATE, level: int = 1) -> DataFrame:
    """Write chunk rows to one ``.warc.gz`` file for each partition, a gzip member for each record; (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = out = gz = digest = want = None
        n = 0

        def end() -> None:
            if gz is not None:
                if want is not None and digest.hexdigest() != want:
                    raise ValueError("a payload's chunks don't have its digest")
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())

        for b in batches:
            for page_id, url, n_bytes, sha1, first, number, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, out = files.create(folder, f"part-{TaskContext.get().partitionId():05d}", ".warc.gz")
                if number == 0:
                    end()
                    gz, digest, want = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1(), sha1 if first is None else None
                    out.write(gz.compress(header(page_id, url, n_bytes, sha1, first, date)))
                    n += 1
                digest.update(data)
                out.write(gz.compress(data))
        if out is not None:
            end()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return chunks.mapInArrow(run, "path string, records long")


class Members:
    """The gzip members of a stream, decompressed piece by piece."""

    def __init__(self, raw, piece: int):
        self.raw, self.piece, self.rest = raw, piece, b""

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while self.rest or self._more():
            gz = zlib.decompressobj(31)
            yield self._member(gz)

    def _more(self) -> bool:
        self.rest = self.raw.read(self.piece)
        return bool(self.rest)

    def _member(self, gz) -> Iterator[bytes]:
        while not gz.eof:
            if not self.rest and not self._more():
                raise EOFError("a record ends too early")
            data = gz.decompress(self.rest, self.piece)
            self.rest = gz.unused_data if gz.eof else gz.unconsumed_tail
            if data:
                yield data


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def _records(raw, piece: int) -> Iterator[tuple]:
    """(head, chunk number, data, SHA-1 so far, bytes so far, last) of each chunk of a file."""
    for member in Members(raw, piece):
        buf = b""
        while (cut := buf.find(b"\r\n\r\n")) < 0:
            buf += next(member)
        head, buf = parse_head(buf[:cut]), buf[cut + 4 :]
        left, digest, number, seen = int(head["content-length"]), hashlib.sha1(), 0, 0
        while True:
            while left and len(buf) < min(left, piece):
                buf += next(member)
            data, buf = buf[: min(left, piece)], buf[min(left, piece) :]
            digest.update(data)
            left, seen = left - len(data), seen + len(data)
            yield head, number, data, _b32(digest.digest()), seen, not left
            number += 1
            if not left:
                break
        for more in member:
            buf += more
        if buf != b"\r\n\r\n":
            raise ValueError("a record isn't closed by two line ends")


CHUNKS = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, chunk_no int, data binary, digest_so_far string, bytes_so_far long, last boolean"


def read_warc(written: DataFrame, chunk_bytes: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows of the files in ``written`` (path): see CHUNKS; ``data`` is null without ``with_data``.

    payload_digest and payload_bytes are as the record's head has them,
    digest_so_far and bytes_so_far as the stream has them.
    """
    types = [pa.string()] * 5 + [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with files.open_input(path) as raw:
                    for head, number, data, digest, seen, last in _records(raw, chunk_bytes):
                        bare = lambda k: head[k].strip("<>") if k in head else None  # noqa: B023, E731
                        yield bare("warc-record-id"), head.get("warc-target-uri"), head["warc-type"], bare("warc-refers-to"), head["warc-payload-digest"].removeprefix("sha1:"), int(head["warc-payload-length"]), number, data if with_data else None, digest, seen, last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for row in rows(batches):
            held.append(row)
            size += len(row[7] or b"")
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return written.select("path").mapInArrow(run, CHUNKS)


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write a record for each row of ``pages``; (path, records) of the files.

    Null html is an empty payload, a null url no target. Of equal payloads of at
    least ``min_bytes`` bytes the rows with the least page_id are responses (all
    of them, should that id be repeated), the others revisits; payloads that only
    rows without page_id have are all responses. Other columns are ignored.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    return materialise(write_warc(payload_chunks(record_types(pages, min_bytes), chunk_bytes), folder), "warc-files")


def record_summary(chunks: DataFrame) -> DataFrame:
    """A row for each record of a chunk table: record_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of responses are those of the stream that was read, and must
    be the head's; revisits have the head's.
    """
    real = F.col("record_type") == "response"
    same = (F.col("digest_so_far") == F.col("payload_digest")) & (F.col("bytes_so_far") == F.col("payload_bytes"))
    digest = F.when(real & ~same, F.raise_error("a record's payload isn't what its head says").cast("string")).otherwise(F.col("payload_digest"))
    return chunks.where("last").select("record_id", F.when(real, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
