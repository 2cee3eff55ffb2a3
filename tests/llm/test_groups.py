"""Shingles, T-occurrence search and components against plain sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from bipartrix.llm import groups, minhash, occurrence, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(t, k):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def components(rows, k, pct):
    """(doc_id, size, least doc_id reachable) of all rows, by all pairs."""
    sets = [plain(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (a, x) in enumerate(zip(rows, sets, strict=True)):
        for j in range(i):
            if x and sets[j] and a[0] is not None and rows[j][0] is not None:
                common = len(x & sets[j])
                if 100 * common >= pct * (len(x) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), None if d is None else least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, words, lex, n):
    w = list(words)
    for _ in range(n):
        kind, at = rng.random(), rng.randrange(len(w))
        if kind < 0.5:
            w[at] = rng.choice(lex)
        elif kind < 0.75 and len(w) > 3:
            del w[at]
        else:
            w.insert(at, rng.choice(lex))
    return w


def some_rows(seed, n=140):
    rng = random.Random(seed)
    lex = [f"w{i}" for i in range(400)] + ["É", "The", "the"]
    bases = [rng.choices(lex, k=rng.choice([5, 9, 12, 20, 60, 150, 400])) for _ in range(25)]
    out = [" ".join(edited(rng, rng.choice(bases), lex, rng.choice([0, 0, 1, 1, 2, 3, 5, 8]))) for _ in range(n)]
    out += [None, "", " \n", "one", "One", "a b", "A  B", "b a", "la " * 50, "la " * 60]
    return [*enumerate(out), (3, out[3]), (4, "another text of an old id"), (None, out[5]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", "x") for i, t in rows], "doc_id long, text string, node int, bucket string, comp string")


def test_shingle_sets(monkeypatch):
    texts = [(t or "") for _, t in some_rows(2)] + ["a\x1fb\x85 c d"]
    for k in (1, 2, 3, 5):
        want = [plain(t, k) for t in texts]
        for segment in (1 << 20, 7):
            monkeypatch.setattr(shingles, "SEGMENT", segment)
            raw = [t.encode() for t in texts]
            _, h, second, off = shingles.shingle_sets(raw, k)
            _, code, off2 = shingles.exact_sets(raw, k)
            assert np.diff(off).tolist() == np.diff(off2).tolist() == [len(x) for x in want]
            for i in range(len(texts)):
                for j in range(0, i, 7):
                    n = len(want[i] & want[j])
                    for x, o in ((h, off), (second, off), (code, off2)):
                        assert len(np.intersect1d(x[o[i] : o[i + 1]], x[o[j] : o[j + 1]])) == n


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_take_for_equal(spark):
    a, b = thue_morse(1024)
    rows = [(1, a), (2, b), (3, f"{a} {b} x y"), (4, f"{b} {a} x y")]
    for out in (minhash.near_duplicates(frame(spark, rows), 2, 80).drop("kept"), occurrence.jaccard_groups(frame(spark, rows))):
        assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """With all keys the same, sets aren't told apart before their words are looked at."""
    rows = [(i, f"w{i} x{i} y{i} z{i}") for i in range(6)]
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(i)], "a long, b long")
    texts = spark.createDataFrame(rows, "node long, text string")
    for search in (groups.found_by_overlap, occurrence.search):
        assert groups.verified(texts, pairs, 2, 80, search).count() == 0


def test_divide_skip():
    rng = random.Random(5)
    for _ in range(300):
        n, docs = rng.randint(1, 30), rng.randint(1, 12)
        lists = [sorted(rng.sample(range(docs), rng.randint(1, docs))) for _ in range(n)]
        needed = [rng.randint(1, n + 1) for _ in range(docs)]
        count = Counter(d for x in lists for d in x)
        assert occurrence.divide_skip(lists, needed) == [d for d in range(docs) if count[d] >= needed[d]]
    assert occurrence.divide_skip([], [1]) == []


@pytest.mark.parametrize("pct", [80, 90, 95])
def test_similar_sets_share_a_part(pct):
    """Brute force over sets at the limit, small ones and such with empty parts included."""
    rng = np.random.default_rng(pct)
    met = 0
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            x = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            d = int(rng.integers(0, 1 + 2 * n * (100 - pct) // (100 + pct) // 2 + 1))
            gone = int(rng.integers(0, d + 1))
            y = np.unique(np.concatenate([x[gone:], rng.integers(1, 1 << 62, d - gone).astype(np.uint64)]))
            common = len(np.intersect1d(x, y))
            if len(y) == 0 or 100 * common < pct * (len(x) + len(y) - common) or (len(x) == len(y) == common):
                continue
            # In one call and in two: the keys depend on the set alone.
            keys, off = occurrence.equal_parts(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), pct)
            assert np.intersect1d(keys[: off[1]], keys[off[1] :]).size
            alone, _ = occurrence.equal_parts(np.zeros(len(y), int), y, np.array([0, len(y)]), pct)
            assert np.array_equal(np.sort(alone), np.sort(keys[off[1] :]))
            met += 1
    assert met > 100
    keys, off = occurrence.equal_parts(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(3, int), pct)
    assert len(keys) == 0 and off.tolist() == [0, 0, 0]


@pytest.mark.parametrize(("k", "pct", "rounds"), [(3, 90, 2), (3, 90, 0), (1, 80, 1), (5, 95, 2)])
def test_jaccard_groups(spark, k, pct, rounds):
    rows = some_rows(k)
    d = frame(spark, rows)
    got = Counter(map(tuple, occurrence.jaccard_groups(d, k, pct, rounds).collect()))
    assert got == components(rows, k, pct)
    assert occurrence.jaccard_groups(d.limit(0), k, pct).count() == 0


def test_crowded_group(spark):
    """Near copies around the threshold: components as all pairs give."""
    rng = random.Random(8)
    lex = [f"w{i}" for i in range(600)]
    base = rng.choices(lex, k=200)
    rows = list(enumerate(" ".join(edited(rng, base, lex, rng.choice([0, 1, 2, 3, 4, 5, 6]))) for _ in range(400)))
    want = components(rows, 3, 90)
    assert len({c for _, _, c in want}) > 20
    for rounds in (0, 2):
        assert Counter(map(tuple, occurrence.jaccard_groups(frame(spark, rows), 3, 90, rounds).collect())) == want


@pytest.mark.parametrize("pct", [80, 90])
def test_unlinked_documents_of_one_template_never_meet(spark, pct):
    """5,000 sets that share nearly what links need: no pair is formed from what all of them hold."""
    n, own = 100, 25 if pct == 80 else 12
    rng = np.random.default_rng(1)
    shared = rng.integers(1, 1 << 62, n - own)
    rows = [(i, i, [*shared.tolist(), *rng.integers(1, 1 << 62, own).tolist()]) for i in range(5000)]
    sets = spark.createDataFrame(rows, "node long, comp long, shingles array<long>")
    rare = groups.rare_shingles(sets, pct).cache()
    pairs = groups.first_shared(rare, pct)
    assert pairs.count() == 0
    assert rare.where("index").count() == 0  # so the join meets nothing
