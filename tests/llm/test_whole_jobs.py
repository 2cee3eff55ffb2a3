"""Operators that once did a part of their job now do all of it."""

import random

import pytest

import corpus_pipeline
from bipartrix.llm import decontam, urlfilter


def prose(rng, n):
    return " ".join("".join(rng.choices("abdeiklmnorstu", k=rng.randint(3, 9))) for _ in range(n))


def test_verdicts_are_by_row(spark, tmp_path):
    rng = random.Random(8)
    same, other, clean, item, free = (prose(rng, 80) for _ in range(5))
    leak = prose(rng, 40) + " " + item + " " + prose(rng, 40)
    rows = [(1, same), (1, same), (1, same), (2, other), (3, other), (3, clean), (4, leak), (4, free), (None, leak + " end"), (None, other), (None, same + " z"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    seen = sorted(map(tuple, got.collect()), key=str)
    assert seen == sorted([(1, same), (2, other), (3, clean), (4, leak), (4, free), (None, None)], key=str)
    got = corpus_pipeline.cut_repeated_passages(spark, got, str(tmp_path))
    assert (1, same) in set(map(tuple, got.collect()))
    left = set(map(tuple, corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()))
    assert left == set(rows) - {(4, leak), (None, leak + " end")}


def test_documents_that_come_blank_pass(spark, tmp_path):
    rng = random.Random(9)
    whole = prose(rng, 80)
    rows = [(1, whole), (2, whole), (3, None), (4, ""), (5, " \n\t "), (6, prose(rng, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.cut_repeated_passages(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert set(map(tuple, got.collect())) == set(rows) - {(2, whole)}


@pytest.mark.parametrize(("n", "kind", "trials"), [(100, "delete", 12), (200, "delete", 12), (200, "insert", 6), (400, "delete", 8), (400, "insert", 8), (400, "replace", 6)])
def test_long_items_are_found_at_the_limit(n, kind, trials):
    rng = random.Random(n)
    lex = [f"w{i}" for i in range(5000)]
    found = 0
    for _ in range(trials):
        item = rng.choices(lex, k=n)
        v = list(item)
        for p in sorted(rng.sample(range(1, n), n // 5), reverse=True):
            v[p : p + (kind != "insert")] = [] if kind == "delete" else [rng.choice(lex)]
        doc = rng.choices(lex, k=100) + v + rng.choices(lex, k=100)
        found += bool(decontam.Index([(0, " ".join(item))], 80, 5, decontam.Walks()).search(" ".join(doc)))
    assert found == trials


def test_alias_links_resolve(spark):
    tag = '<link rel=canonical href="{}">'.format
    cases = [  # page, html, its alias
        ("HTTP://Example.com/A", tag("b"), "http://example.com/b"),
        ("http://x.org/a/b/c", tag("../d"), "http://x.org/a/d"),
        ("http://x.org/a/b/c", tag("./d"), "http://x.org/a/b/d"),
        ("http://x.org/a/b/c", tag("../../../d/."), "http://x.org/d/"),
        ("http://x.org/a/b?y", tag("?x=1"), "http://x.org/a/b?x=1"),
        ("http://x.org/a", tag("?x=1&amp;y=&#50;&#x33;&amp;amp;"), "http://x.org/a?x=1&y=23&amp;"),
        ("http://x.org", tag("d#e"), "http://x.org/d"),
        ("http://x.org/a", tag("HTTPS://Y.org/./Q?../z"), "https://y.org/Q?../z"),
        ("http://x.org/a", "<link " + "data-x='" + "x" * 5000 + "' rel=canonical href=/long>", "http://x.org/long"),
        ("http://x.org/a", tag("mailto:me"), None),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = sorted((r.u, r.v) for r in urlfilter.alias_links(pages).collect())
    assert got == sorted((u.replace("HTTP://Example", "http://example"), v) for u, _, v in cases if v)
    rows = [(1, "HTTP://B.org/p/../a", '<link rel=canonical href="../A.html">'), (2, "http://b.org/x/y", tag("//X.net/es/1")), (3, "http://B.org/x/y", "")]
    out = {r.page_id: r.verdict for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), [("net", "/es/", "block")]).collect()}
    assert out == {1: "allow", 2: "block", 3: "block"}
