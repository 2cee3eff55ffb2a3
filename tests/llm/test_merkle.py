"""The manifest against a plain tree, for buckets of few and many nodes."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest

from bipartrix.llm import merkle, oracle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos int, steps string"


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, for each node the levels' (left, right) siblings)."""
    proofs, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for at, members in enumerate(own):
            other = nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
            for i in members:
                proofs[i].append((other, "") if at & 1 else ("", other))
        own = [own[i] + (own[i + 1] if i + 1 < len(own) else []) for i in range(0, len(own), 2)]
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return (nodes[0] if nodes else None), proofs


def brute(rows):
    by = {}
    for r in rows:
        i, text, lang, source, n = r[:5]
        leaf = sha(*map(field, (i, source, lang, n, text)))
        bad = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        start = sha(*map(field, (i, source, lang, n + 1, text))) if bad else leaf
        by.setdefault(lang, []).append(((i is not None, i or 0, leaf), i, leaf, start))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for x in langs:
        by[x].sort()
        subs[x] = tree([r[2] for r in by[x]])
    root, outer = tree([subs[x][0] for x in langs])
    out = Counter()
    for x, up in zip(langs, outer, strict=True):
        for (_, i, leaf, start), proof in zip(by[x], subs[x][1], strict=True):
            h = start
            for a, b in proof + up:
                h = sha(a, h, b)
            out[i, leaf, subs[x][0], root, sha(*[s for p in proof + up for s in p]), h, h == root] += 1
    return out


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", "tëxt", "a:b-", None, "long " * 50]), rng.choice(langs), rng.choice(["s", None]), rng.choice([None, 0, 17]), "z", 1, "s") for i in range(n)]
    return [*rows, rows[3], rows[3], (4, "other", *rows[4][2:]), (None, "x", *rows[5][2:]), (None, None, None, None, None, None, None, None)]


@pytest.mark.parametrize(("n", "langs", "height"), [(200, ["en", "fr", None, "", "é"], 12), (300, ["en", "en", "en", "fr"], 2), (100, ["en"], 1), (70, [f"l{i}" for i in range(40)], 3)])
def test_manifest(spark, monkeypatch, n, langs, height):
    monkeypatch.setattr(merkle, "ROWS", 16)
    rows = rows_of(n, langs)
    d = spark.createDataFrame(rows, SCHEMA)
    got = merkle.document_manifest(d, height)
    assert Counter(map(tuple, got.collect())) == brute(rows)
    assert merkle.document_manifest(d.limit(0), height).count() == 0
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert Counter(map(tuple, merkle.document_manifest(one, height).collect())) == brute(rows[:1])


def test_sql_says_the_same(spark):
    rows = rows_of(90, ["en", "fr", None, "é"])
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, SCHEMA).toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(con.execute(f"SELECT {', '.join(cols)} FROM ({oracle.OP13})").fetchall()) == brute(rows)
