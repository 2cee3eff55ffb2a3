"""Benchmark items in prose: short ones, many blocks of them, and long ones with as many edits as are allowed."""

from __future__ import annotations

import random

import pytest

from bipartrix.llm import decontam


@pytest.fixture(scope="module")
def prose(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").limit(400).collect()
    return [" ".join(w.decode() for w in decontam.words_of(r.text)) for r in rows]


def test_short_items_are_found_as_they_stand(spark, prose):
    words = [t.split() for t in prose]
    items = [(n, i, " ".join(words[i][at : at + n])) for n in (1, 2, 3, 4) for i, at in ((3, 5), (8, 0), (20, 9))] + [(9, 0, "zzz not there")]
    bench = spark.createDataFrame([(f"{n}-{i}", t) for n, i, t in items], "item_id string, text string")
    docs = spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.distance, r.first_word, r.item_words) for r in decontam.find_leaks(docs, bench).collect()]
    want = []
    for d, ws in enumerate(words):
        for n, i, t in items:
            v = t.split()
            at = next((a for a in range(len(ws) - len(v) + 1) if ws[a : a + len(v)] == v), None)
            if at is not None:
                want.append((d, f"{n}-{i}", 0, at, len(v)))
    assert sorted(got) == sorted(want) and len(want) > 12
    assert decontam.find_leaks(docs, bench, min_words=3).count() == sum(w[4] >= 3 for w in want)


def test_blocks_and_what_a_task_holds_change_nothing(spark, prose, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(prose).split()[:25])) for i in range(60)] + [(60, None), (61, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate([*prose, None, ""])), "doc_id long, text string")
    whole = decontam.find_leaks(docs, bench)
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(decontam, "HELD_BYTES", 5000)
    assert len(decontam.write_items(bench)) > 5 and len(decontam.write_items(bench.limit(0))) == 0
    parts = decontam.find_leaks(docs, bench)
    assert parts.schema == whole.schema
    assert sorted(map(tuple, parts.collect())) == want and len(want) >= 60
    monkeypatch.undo()
    dealt = bench.repartition(40)
    assert len(decontam.write_items(dealt)) == 1
    assert sorted(map(tuple, decontam.find_leaks(docs, dealt).collect())) == want


def test_tables_follow_the_target():
    few, more = decontam.tables_for(0.5, 80), decontam.tables_for(0.9, 80)
    assert 1 < few < more < decontam.tables_for(0.9, 70)
    assert decontam.tables_for(0.9, 100) == 1  # without edits any table meets


@pytest.mark.parametrize(("n", "trials"), [(20, 20), (59, 12), (150, 8), (400, 6), (1000, 4)])
def test_recall_in_prose(prose, n, trials):
    """Items of prose with as many edits as are allowed, of mixed kinds, inside other prose."""
    rng, walks, found = random.Random(n), decontam.Walks(decontam.tables_for(decontam.RECALL, 80)), 0
    stream = " ".join(prose).split()
    for _ in range(trials):
        at = rng.randrange(len(stream) - n)
        item = stream[at : at + n]
        v = list(item)
        for p in sorted(rng.sample(range(1, n), n // 5), reverse=True):
            kind = rng.choice(("delete", "insert", "replace"))
            v[p : p + (kind != "insert")] = [] if kind == "delete" else [rng.choice(stream)]
        a, z = rng.randrange(len(stream) - 100), rng.randrange(len(stream) - 100)
        doc = stream[a : a + 100] + v + stream[z : z + 100]
        found += bool(decontam.Index([(0, " ".join(item))], 80, 1, walks).search(" ".join(doc)))
    assert found >= 0.9 * trials
