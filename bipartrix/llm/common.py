"""Helpers shared by the training-data operators.

Intermediate tables are written as Parquet below the folder that the cluster
names in ``spark.checkpoint.dir``: a lost executor then costs a re-read, not a
recomputation, and no data stay on one machine only.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="bipartrix-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, one subfolder for each application.

    ``spark.checkpoint.dir`` decides. Only a local master, which has no other
    machine to share with, may go without: it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that no result will read again."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def running_totals(parts: DataFrame, pid: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """Exclusive running sums over partition numbers of a table of per-partition totals.

    ``parts`` has one row for each partition (and each ``by`` value), so that it
    is small against the data whatever their size.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*(by or [])).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(pid, *(by or []), *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long").alias(f"{c}_before") for c in sums])


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


# --- memory of Python workers, which live on from task to task and operator to operator ---

_held: dict[str, Callable[[], None]] = {}


def holds(name: str, forget: Callable[[], None]) -> None:
    """Say that this worker keeps something for later tasks of operator ``name``, and how to drop it."""
    _held[name] = forget


def only(name: str) -> None:
    """Drop what other operators keep in this worker: an executor's memory then doesn't add up over a pipeline."""
    pa.set_memory_pool(pa.system_memory_pool())  # one heap, which trim() can shrink
    for other in [x for x in _held if x != name]:
        _held.pop(other)()


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, more of them than run at a time."""
    POWERS.reset()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its heap stays as it is
        pass


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a task never holds a large batch's rows as Python objects at once."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
        del b
    trim()


# --- 64-bit mixing, the same on every executor -----------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n pseudo-random words from a seed."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


BASE = 0x5851F42D4C957F2D  # odd and 5 mod 8: its powers have the longest period mod 2**64
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_CODE = stream64(256, 0xB17E)


def powers(x: int, m: int) -> np.ndarray:
    out = np.full(m, x, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class PowerTable:
    """Powers of BASE and of its inverse mod 2**64, grown when a longer text comes."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up, self.down = (powers(x, m) for x in (BASE, BASE_INV))
        return self.up[:n], self.down[:n]


POWERS = PowerTable()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of code(data[j]) * BASE**j over j < i, mod 2**64; one longer than data."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[data] * up[:-1], dtype=np.uint64, out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], wherever in the text it lies."""
    _, down = POWERS.get(len(h))
    with np.errstate(over="ignore"):
        return mix64((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64))
