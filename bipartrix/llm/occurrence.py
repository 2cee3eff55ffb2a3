"""Jaccard join of word shingles by T-occurrence search.

A document similar enough to a query occurs in at least T of the inverted lists
of the query's shingles. DivideSkip (Li, Lu and Lu 2008) sets the L longest lists
aside, merges the short ones with a heap and keeps documents found T - L times
or more, which are then looked for in the long lists by binary search.

What is searched for what: sets are cut into parts by a hash of their shingles,
so many that two similar sets differ in fewer shingles than they have parts, and
some part is the same in both (Arasu et al. 2006). Documents that share a part
meet; groups.py deals them to queries and puts links together.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from bipartrix.llm.common import mix64
from bipartrix.llm.groups import similar_groups
from bipartrix.llm.shingles import GOLDEN

#: Cost of a probe against that of a merge step; sets how many lists are long.
MU = 0.01


def least_overlap(n: int, m: int, threshold_pct: int) -> int:
    """Shingles that similar sets of n and m share at least."""
    return -(-threshold_pct * (n + m) // (100 + threshold_pct))


def divide_skip(lists: list[list[int]], needed: list[int]) -> list[int]:
    """Documents (numbers) that occur in ``needed`` of the lists, each of which is sorted.

    ``needed`` has each document's T, at least 1.
    """
    lists = sorted(lists, key=len)
    low = min(needed, default=0)
    if not lists or len(lists) < low:
        return []
    n_long = min(low - 1, int(low / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found: dict[int, int] = {}
    for d in heapq.merge(*short):
        found[d] = found.get(d, 0) + 1
    out = []
    for d, count in found.items():
        t = needed[d]
        left = len(long)
        if count + left < t:
            continue
        for own in long:
            if count >= t or count + left < t:
                break
            at = bisect_left(own, d)
            count += at < len(own) and own[at] == d
            left -= 1
        if count >= t:
            out.append(d)
    return sorted(out)


def search(query: np.ndarray, sets: list[np.ndarray], threshold_pct: int) -> np.ndarray:
    """Which of the sets are similar enough to the query's: a T-occurrence search in the inverted lists of the query's shingles."""
    sizes = np.array([len(s) for s in sets])
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    same = query[at] == flat
    token, doc = at[same], own[same]
    order = np.argsort(token, kind="stable")  # documents rise within a list
    lists = [x.tolist() for x in np.split(doc[order], np.flatnonzero(np.diff(token[order])) + 1) if len(x)]
    good = np.zeros(len(sets), bool)
    good[divide_skip(lists, [least_overlap(len(query), n, threshold_pct) for n in sizes.tolist()])] = True
    return good


def size_groups(threshold_pct: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, number of parts, empty parts that a set may have unmentioned) of each group of sizes.

    Similar sets of at most n shingles differ in at most 2 n (1 - t) / (1 + t); one
    part more than that leaves some part the same, and ``spare`` more leave one that
    isn't empty.
    """
    differ = lambda n: 2 * n * (100 - threshold_pct) // (100 + threshold_pct)
    top = 1
    while differ(top + 1) == 0 and top < most:
        top += 1
    low, parts, spare = [1], [1], [0]
    while top < most:
        low.append(top + 1)
        top = max(top + 1, low[-1] * 3 // 2)
        spare.append((differ(top) + 1) // 50)
        parts.append(differ(top) + 1 + spare[-1])
    return np.array(low), np.array(parts), np.array(spare)


def equal_parts(doc: np.ndarray, h: np.ndarray, offsets: np.ndarray, threshold_pct: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the parts of each set, offsets of documents in them); two sets of different content that are similar share a key.

    A set is cut up for its own group of sizes and, where similar ones may be in
    it, for the next larger one. Sets so small that similar ones are equal have no
    key for their own.
    """
    n = np.diff(offsets)
    low, parts, spare = size_groups(threshold_pct, int(n.max(initial=1)) * 100 // threshold_pct + 1)
    own = np.maximum(np.searchsorted(low, n, side="right") - 1, 0)
    up = np.minimum(own + 1, len(low) - 1)
    entries = [(np.flatnonzero((n > 0) & (parts[own] > 1)), own), (np.flatnonzero((n > 0) & (up > own) & (100 * n >= threshold_pct * low[up])), up)]
    who = np.concatenate([e for e, _ in entries])
    group = np.concatenate([g[e] for e, g in entries])
    order = np.argsort(who, kind="stable")
    who, group = who[order], group[order]
    m = parts[group]
    base = np.cumsum(m) - m
    size = n[who]
    entry = np.repeat(np.arange(len(who)), size)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size - offsets[:-1][who], size)
    token = h[at]
    with np.errstate(over="ignore"):
        part = base[entry] + ((mix64(token + GOLDEN) >> np.uint64(32)) * m[entry].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        sums, filled = np.zeros(int(m.sum()), np.uint64), np.zeros(int(m.sum()), bool)
        np.add.at(sums, part, mix64(token))
        filled[part] = True
        of = np.repeat(np.arange(len(who)), m)
        nth = np.arange(len(of)) - base[of]
        keys = mix64(sums + mix64(nth.astype(np.uint64) * GOLDEN + group[of].astype(np.uint64)))
    empty = np.bincount(of[~filled], minlength=len(who))
    kept = filled | (empty > spare[group])[of]
    return keys[kept], np.searchsorted(who[of[kept]], np.arange(len(n) + 1))


def jaccard_groups(docs: DataFrame, shingle_words: int = 3, threshold_pct: int = 90, pivot_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``; links, components and odd rows are as in groups.similar_groups().

    No link is lost: similar sets share a part, so they meet in a bucket.
    """
    return similar_groups(docs, shingle_words, threshold_pct, lambda d, h, off: equal_parts(d, h, off, threshold_pct), search, pivot_rounds)
