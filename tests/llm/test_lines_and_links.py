"""Lines learned from the corpus, and alias links through the registered query and its SQL."""

import random
from collections import Counter

import duckdb
import pytest

from bipartrix.llm import linerules, oracle, queries

SCHEMA = "doc_id long, text string, source string, common string, src int"


def prose(rng, lex, n):
    return " ".join(rng.choices(lex, k=n)).capitalize() + "."


def corpus(rng):
    """300 documents of two sources; site a closes with a footer of its own, and has 40 copies of one document."""
    lex = ["".join(rng.choices("abdeiklmnorstu", k=rng.randint(3, 9))) for _ in range(3000)]
    copied = "\n".join(prose(rng, lex, 20) for _ in range(6))
    rows = []
    for i in range(300):
        site = "ab"[i % 2]
        lines = [prose(rng, lex, 15) for _ in range(4)]
        if site == "a" and i % 4 == 0:
            lines.append(f"Visit the {'red' if i % 3 else 'RED'}  house of page {i} for more of this kind.")
        rows.append((i, "\n".join(lines), site, "x", 1))
    rows += [(1000 + i, copied, "a", "x", 1) for i in range(40)]
    rows += [(2000, None, "a", None, None), (2001, "", None, None, None), (2002, prose(rng, lex, 30), None, None, None)]
    return rows, copied


def test_footers_are_learned(spark):
    rows, copied = corpus(random.Random(1))
    d = spark.createDataFrame(rows, SCHEMA)
    found = {r.src: set(r.common) for r in linerules.common_lines(d).collect()}
    assert found == {"a": {linerules.line_key(b"visit the red house of page 7 for more of this kind.")}}
    out = {r.doc_id: r for r in linerules.clean_lines(d).collect()}
    assert len(out) == len(rows)
    plain = {r.doc_id: r for r in linerules.clean_lines(d, share=None).collect()}
    for i, t, site, *_ in rows:
        footer = site == "a" and i < 300 and i % 4 == 0
        assert out[i].n_lines_removed == plain[i].n_lines_removed + footer
        if footer:
            assert out[i].clean_text == "\n".join(t.split("\n")[:-1]) and out[i].kept
    # Copies of a document hold their lines between the same neighbours.
    assert out[1000].kept and out[1000].clean_text == copied
    assert linerules.clean_lines(d.limit(0)).count() == 0
    without = linerules.clean_lines(d.drop("source")).collect()
    assert Counter((r.doc_id, r.kept) for r in without) == Counter((i, r.kept) for i, r in out.items())


@pytest.mark.parametrize("uncrawled", [False, True])
def test_alias_links_through_the_query(spark, tmp_path, uncrawled):
    """Chains and stars of canonical and refresh links: the registered query, a walk and, over crawled pages, the SQL agree."""
    rng = random.Random(1)
    hosts = ["example.com", "www.example.com", "a.net", "b.net", "c.org", "d.org"]
    paths = ["/en/", "/es/", "/fr/", "/", "/de/x"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}p{i}" for i in range(120)]
    links, rows = {}, []
    for i, u in enumerate(urls):
        html = "<html><body>text</body></html>"
        if rng.random() < 0.5:
            v = urls[rng.randrange(len(urls))] if rng.random() < 0.8 or not uncrawled else f"http://never.net/es/{i}"
            links[i] = v
            html = f'<link rel="canonical" href="{v}">' if rng.random() < 0.5 else f'<meta http-equiv="refresh" content="0; url={v}">'
        rows.append((i, u, html))
    rows += [(200, None, None), (201, "no url", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op9_redirect_equivalence(spark, str(tmp_path)).collect()
    cols = ["page_id", "host", "path", "rule", "verdict"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    if not uncrawled:
        assert Counter(tuple(r[c] for c in cols) for r in got) == Counter(con.execute(f"SELECT {', '.join(cols)} FROM ({oracle.OP9})").fetchall())
    root = {u: u for u in [*urls, *links.values()]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v in links.items():
        root[find(urls[i])] = find(v)
    own = {u: _own(u) for u in root}
    for r in got:
        if r.page_id < 200 and r.rule is None:
            of_class = {own[u] for u in root if find(u) == find(urls[r.page_id])}
            assert r.verdict == ("allow" if "allow" in of_class else "block" if "block" in of_class else "allow")
    spread = [r for r in got if r.rule is None and r.verdict == "block"]
    assert len(spread) > 3  # blocked by an alias alone


def _own(url):
    host, path = url.split("://")[1].split("/", 1)
    fits = [(h, p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith(f".{h}")) and f"/{path}".startswith(p)]
    return max(fits, key=lambda x: len(x[0] + x[1]))[2] if fits else None
