"""SuperMinHash near-duplicates: signatures, banding, verification on full sets, components.

SuperMinHash (Ertl 2017) gives each element a random permutation of the
signature's slots; its j-th value, j plus a uniform number, goes to its j-th
slot. Levels run over all elements of many documents at once, and a document
leaves as soon as all its slots are filled, for later levels can't lower any.

Signatures are cut into bands, whose keys are buckets; what meets in one is
compared on full sets in groups.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.llm.common import mix64
from bipartrix.llm.groups import similar_groups

SLOTS = 256
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def slot_at(h: np.ndarray, level: int) -> np.ndarray:
    """The level-th slot of each element's permutation: odd multiplications, additions and shifts, each one-to-one mod 256."""
    key = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    byte = lambda i: (key >> np.uint64(8 * i)).astype(np.uint8)
    with np.errstate(over="ignore"):
        x = np.uint8(level) ^ byte(0)
        for i in (1, 3, 5):
            x = x * (byte(i) | np.uint8(1)) + byte(i + 1)
            x = x ^ (x >> np.uint8(4))
            x = x * np.uint8(0x9D)
            x = x ^ (x >> np.uint8(3))
    return x.astype(np.int64)


def superminhash(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Signatures (n_docs, SLOTS) of 64-bit values: level in the upper bits, a uniform number in the lower 40."""
    sig = np.full(n_docs * SLOTS, EMPTY, np.uint64)
    with np.errstate(over="ignore"):
        for level in range(SLOTS):
            if not len(h):
                break
            value = (mix64(h + np.uint64(level + 1) * GOLDEN) >> np.uint64(24)) | np.uint64(level << 40)
            np.minimum.at(sig, doc * SLOTS + slot_at(h, level), value)
            still = (sig.reshape(n_docs, SLOTS) == EMPTY).any(axis=1)[doc]
            doc, h = doc[still], h[still]
    return sig.reshape(n_docs, SLOTS)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(n_docs, SLOTS // rows) hashes of each band with its number."""
    n = SLOTS // rows
    parts = sig[:, : n * rows].reshape(len(sig), n, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(1, n + 1, dtype=np.uint64)), (len(sig), n)).copy()
        for i in range(rows):
            key = mix64(key * GOLDEN + parts[:, :, i])
    return key


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold_pct: int = 80, band_rows: int = 6, pivot_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Links, components and odd rows are as in groups.similar_groups(); ``kept`` says
    whether component_id is the row's own doc_id, so rows with a null doc_id stay.
    With bands of ``band_rows`` = 6 of 256 slots, a pair at similarity 0.8 meets
    in none of 42 bands with probability 3e-6.
    """
    n_bands = SLOTS // band_rows

    def bands(d: np.ndarray, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.diff(off) > 0
        rank = np.cumsum(some) - 1  # documents with a set, numbered
        keys = band_keys(superminhash(rank[d], h, int(some.sum())), band_rows)
        return keys.reshape(-1), np.concatenate([[0], np.cumsum(np.where(some, n_bands, 0))])

    out = similar_groups(docs, shingle_words, threshold_pct, bands, pivot_rounds=pivot_rounds)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
