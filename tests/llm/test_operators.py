"""Each operator against brute force on small tables with nulls, empty and repeated rows, and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bipartrix.llm import components, decontam, linerules, minhash, packing, rangecoder, sharding, suffix, tokenfile, tokens, toxicity, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, bands string, spans int, shard string"


def docs_of(spark, texts, extra=()):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(i, t, None, None, None) for i, t in extra]
    return spark.createDataFrame(rows, DOCS)


def texts(seed, n, words=60, vocab=300):
    rng = random.Random(seed)
    lex = ["".join(rng.choices("abcdeénorst", k=rng.randint(1, 9))) for _ in range(vocab)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            w = (rng.choice(out) or "x").split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(lex)
            out.append(" ".join(w))
        elif out and kind < 0.3:
            out.append(rng.choice(out))
        else:
            out.append(" ".join(rng.choices(lex, k=rng.randint(1, words))) + rng.choice([".", "\n", " end.\nNext one. "]))
    return [*out, "", None, " \n\t", "one", "A b", "a B", "la " * 400, "ü" * 500]


@pytest.fixture(scope="module")
def docs(spark):
    t = texts(1, 120)
    return docs_of(spark, t, [(3, t[3]), (4, "another text under an old id."), (None, "no id here at all.")]).cache()


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_warc_round_trip(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 3000, "\r\n\r\nWARC/1.1\r\n", "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i} \n" if i else None, h, "c") for i, h in enumerate(html)] + [(None, "u", "<p>z</p>", None)], "page_id long, url string, html string, sha1 string")
    written = warc.archive_pages(pages, chunk_bytes=1000)
    chunks = warc.read_warc(written, chunk_bytes=1000).collect()
    assert max(len(c.data) for c in chunks) <= 1000
    got = {r.record_id.rpartition(":")[2]: r for r in warc.record_summary(warc.read_warc(written, 1000)).collect()}
    assert len(got) == len(html) + 1
    first = {}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        r = got[str(i)]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.record_type == ("revisit" if raw in first else "response")
        assert r.refers_to == (f"urn:x-page:{first[raw]}" if raw in first else None)
        first.setdefault(raw, i)
        if r.record_type == "response":
            mine = sorted((c for c in chunks if c.record_id == r.record_id), key=lambda c: c.chunk_no)
            assert b"".join(c.data for c in mine) == raw
            assert [c.digest_so_far for c in mine][0] == base64.b32encode(hashlib.sha1(raw[:1000]).digest()).decode()
    assert warc.archive_pages(pages.limit(0)).count() == 0
    big = {r.record_type for r in warc.record_summary(warc.read_warc(warc.archive_pages(pages, min_bytes=10**6))).collect()}
    assert big == {"response"}


def brute_repeat(w):
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, mark = Counter(win), set()
    for i, x in enumerate(win):
        if c[x] > 1:
            mark |= set(range(i, i + 5))
    return len(mark)


def test_line_cleaning(spark, docs):
    out = {(r.doc_id, r.clean_text): r for r in linerules.clean_lines(docs).collect()}
    assert linerules.clean_lines(docs).count() == docs.count()
    for i, t in rows_of(docs):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), brute_repeat(w))
        assert any(k[0] == i and (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want for k, r in out.items())
    rng = random.Random(4)
    w = [str(rng.randrange(40)).encode() for _ in range(400)]
    assert linerules.repeated_window_words(w) == brute_repeat(w)
    linerules.LONG_TEXT, old = 5, linerules.LONG_TEXT
    assert linerules.repeated_window_words(w) == brute_repeat(w)
    linerules.LONG_TEXT = old
    assert linerules.line_verdict("Home | News | About | Contact", 7) == "navigation"
    assert linerules.line_verdict("All rights reserved.", 3) == "boilerplate"
    assert linerules.line_verdict("no end", 2) == "punctuation"
    assert linerules.line_verdict('He said "so."', 3) is None
    prose = "This is a sentence of some length. Here comes another one that differs from it in each word."
    keep = docs_of(spark, [prose + "\nHome | News | About", "menu\n" * 30 + "One sentence is here."])
    assert [r.kept for r in linerules.clean_lines(keep).orderBy("doc_id").collect()] == [True, False]
    assert linerules.clean_lines(keep).orderBy("doc_id").first().clean_text == prose


def test_packing(spark, docs):
    plans = packing.plan_windows({5: 3, 4: 2, 10: 1, 1: 4}, 10)
    used = Counter()
    for times, use in plans:
        assert sum(k * n for k, n in use) <= 10
        for k, n in use:
            used[k] += times * n
    assert used == {5: 3, 4: 2, 10: 1, 1: 4}
    rng = random.Random(2)
    for _ in range(50):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room, items = rng.randint(1, 20), [k for k, v in counts.items() for _ in range(v)]
        best = max(sum(x for j, x in enumerate(items) if m >> j & 1) for m in range(1 << len(items)) if sum(x for j, x in enumerate(items) if m >> j & 1) <= room)
        assert sum(k * n for k, n in packing.fullest(room, counts)) == best
    p = packing.pack_documents(docs, capacity=32).collect()
    seqs, enc = {}, tokens.PieceEncoder("byte_bpe_50k.json")
    for r in p:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 32
    for i, t in rows_of(docs):
        if i not in (3, 4, None):
            ids = np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
            assert b"".join(r.ids for r in sorted((r for r in p if r.doc_id == i), key=lambda r: r.start)) == ids
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piecewise_tokens(name, monkeypatch):
    enc = tokens.PieceEncoder(name)
    cases = [*[t or "" for t in texts(3, 60)], "don't I'LL we've he 's", "日本語 テスト　空白", "é ́a İI ΑΣ ς", "<|endoftext|> a", "\x1c\x1d a\x1eb\x85c", "1234 5,6 $$$!!   x", " Ünï, ÀÉ; ß."]
    for t in cases * 2:
        assert enc.encode(t) == np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    rng = random.Random(6)
    marks = ["a", "B", "é", "I", "\u0307", "\u0338", " ", "  ", "\n", "\t", "\u00a0", "\u2003", ".", ",", "'s", "1", "23", "日", "$", "_", "À", "ß"]
    many = ["".join(rng.choices(marks, k=rng.randint(0, 25))) for _ in range(600)]
    for chunk, most in ((tokens.CHUNK, tokens.MAX_PIECES), (37, 64)):  # in parts, and with a memory that runs full
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        monkeypatch.setattr(tokens, "MAX_PIECES", most)
        ids, counts = tokens.PieceEncoder(name).encode_all([x.encode() for x in many] + [None], 7)
        for x, got in zip([*many, ""], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == [*enc.tokenizer.encode(x, add_special_tokens=False).ids, 7]


def test_texts_over_a_megabyte(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(30_000)}" for _ in range(230_000)]
    item = [f"q{i}" for i in range(30)]
    leaky = [*words[:229_000], *item[:20], "other", *item[21:], *words[229_000:]]
    edited = list(words)
    edited[1000] = edited[200_000] = "changed"
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(leaky)), (4, "short text")], "doc_id long, text string")
    assert len(" ".join(words)) > 1 << 20
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(d, 2, 80).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    leak = decontam.find_leaks(d, spark.createDataFrame([("x", " ".join(item))], "item_id string, text string")).collect()
    assert [(r.doc_id, r.distance, r.first_word) for r in leak] == [(3, 1, 229_000)]
    enc = tokens.PieceEncoder("byte_bpe_50k.json")
    assert enc.encode(" ".join(words)) == np.array(enc.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()


def test_toxicity_features():
    lexicon = ["=bad", "awfu"]
    make = toxicity.Featuriser(lexicon)
    got = dict(zip(toxicity.FEATURES, make("You are BAD, awful! b4d loooong"), strict=True))
    # Words: you are bad awful b d loooong; hits: bad (whole), awful (prefix); near you or not by five words.
    assert got["word_density"] == 1 / 7 and got["prefix_density"] == 1 / 7 and got["near_second_person"] == 2 / 7
    assert got["hidden_hits"] == 1 and got["obfuscated"] == 1 / 7 and got["stretched"] == 1 / 7
    assert got["capitals"] == 4 / 31 and got["exclamations"] == 1 / 31 and got["distinct_hits"] == 2
    assert make(None) == make("") == [0.0] * len(toxicity.FEATURES)


def word_distance(a, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(6)
    lex = [f"w{i}" for i in range(400)] + ["the", "of"] * 40
    items = [(i, " ".join(rng.choices(lex, k=rng.randint(5, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "too short")]
    found = []
    for d in range(150):
        w = rng.choices(lex, k=rng.randint(0, 150))
        if d % 2:
            v = rng.choice(items[:30])[1].split()
            for _ in range(rng.randint(0, len(v) // 4)):
                p = rng.randrange(len(v))
                v[p : p + rng.randint(0, 1)] = rng.choices(["NEW!", "x"], k=rng.randint(0, 1))
            at = rng.randint(0, len(w))
            w[at:at] = v
        found.append(" ".join(w))
    docs = docs_of(spark, [*found, None, ""])
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, distance string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find_leaks(docs, bench).collect()}
    want = {}
    for d, t in enumerate(found):
        for i, x in items[:30]:
            n = word_distance(decontam.words_of(x), decontam.words_of(t))
            if n <= decontam.allowed_edits(len(x.split()), 80):
                want[d, i] = n
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 40
    assert all(got[k] == want[k] for k in got if want[k] == 0)
    assert decontam.without_leaks(docs, decontam.find_leaks(docs, bench)).columns == docs.columns
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_shards(spark, docs):
    out = sharding.shard_documents(docs, 5).collect()
    assert len(out) == docs.count()
    size = {}
    for r in out:
        size.setdefault(r.shard, []).append(r.size)
    assert set(size) == set(range(5))
    total, most = sum(map(sum, size.values())), max(r.size for r in out)
    assert all(abs(sum(v) - total / 5) <= most for v in size.values())
    for s in size:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(len(size[s])))
    order = sorted(out, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32))
    assert [r.shard for r in order] == sorted(r.shard for r in out)
    crc = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of(docs))
    assert crc == Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(8)
    lex = [f"{a}{b}" for a in ("ta", "ro", "mi", "sel") for b in ("na", "ko", "lu", "pe")]
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = rng.choices(lex, k=40)
        if bad:
            for _ in range(4):
                w[rng.randrange(40)] = rng.choice(["vilk", "gorp", "you", "zub"])
        rows.append((i, " ".join(w) + ".", "k"))
        marks.append((i, int(bad), "x"))
    docs = spark.createDataFrame([*rows, (900, None, ""), (901, "", ""), (None, "taro", "")], "doc_id long, text string, features string")
    labels = spark.createDataFrame([*marks, (None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, score string")
    model = toxicity.fit_toxicity(docs, labels, trees=5)
    out = {r.doc_id: r.score for r in model.score(docs).collect()}
    assert len(out) == 603 and all(0 <= s <= 1 for s in out.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((out[i] >= 0.7) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.score for r in none.score(docs).collect()} == {0.0}
    assert model.score(docs.limit(0)).count() == 0


def shingles(t, k):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    base = texts(5, 150, words=120)
    d = docs_of(spark, base, [(2, base[2]), (None, base[2])])
    out = minhash.near_duplicates(d, k, 80).collect()
    sets = [shingles(t, k) for t in base]
    parent = list(range(len(base)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(base)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert len(out) == len(base) + 2
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert len({find(i) for i in range(len(base))}) < len(base) - 20
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_minhash_crowded_group(spark):
    """Near copies that share bands but often no link: the same components as all pairs give."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    out = []
    for _ in range(500):
        w = list(base)
        for _ in range(rng.choice([0, 2, 6, 9, 12, 16, 20, 24])):
            kind, at = rng.random(), rng.randrange(len(w))
            if kind < 0.4:
                w[at] = f"w{rng.randrange(500)}"
            elif kind < 0.7:
                del w[at]
            else:
                w.insert(at, rng.choice(base))
        out.append(" ".join(w))
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in out]
    root = list(range(len(out)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(out)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    d = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    want = {i: find(i) for i in range(len(out))}
    assert len(set(want.values())) > 50  # many are alone
    for rounds in (0, 2):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(d, 2, 80, pivot_rounds=rounds).collect()} == want


def test_superminhash_estimates():
    rng = np.random.default_rng(3)
    for n in (4, 100, 1000):
        off = []
        for _ in range(30):
            x = rng.integers(1, 1 << 62, 3 * n // 2).astype(np.uint64)
            sig = minhash.superminhash(np.repeat([0, 1], n), np.concatenate([x[:n], x[-n:]]), 2)
            off.append((sig[0] == sig[1]).mean() - 1 / 3)
        assert abs(np.mean(off) - (0 if n > 4 else 0)) < 0.02
    assert all(len({int(minhash.slot_at(np.array([h], np.uint64), j)[0]) for j in range(256)}) == 256 for h in (0, 7, 2**63))


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 380)] + [(400, 401), (401, 400), (5, 5), (None, 3)]
    out = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert len({out[i] for i in range(201)}) == 1 and len({out[i] for i in range(300, 380)}) == 1
    assert len(set(out.values())) == 3 and out[400] == out[401]


@pytest.mark.parametrize("sizes", [[1], [5, 3], [300, 299, 2, 1], [2048, 17]])
def test_range_coder(sizes):
    rng = np.random.default_rng(1)
    for top in (2, 40, 65536):
        blocks = [rng.integers(0, top, s).astype(np.int32) for s in sizes]
        shares = rangecoder.Shares.of(np.bincount(np.concatenate(blocks), minlength=top) + 1)  # every id below top has a share
        assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode(rangecoder.encode(blocks, shares), sizes, shares), strict=True))


def test_range_coder_size():
    """Within a bit of the ids' order-0 entropy, and far below it where ids follow each other."""
    rng = np.random.default_rng(2)
    for ids, saved in ((np.minimum(rng.zipf(1.3, 60_000), 40_000), -1), (np.tile(np.arange(50), 1200), 4)):
        counts = np.bincount(ids)
        shares = rangecoder.Shares.of(counts)
        blocks = np.split(np.searchsorted(shares.ids, ids).astype(np.int32), range(1000, len(ids), 1000))
        p = counts[counts > 0] / len(ids)
        bits = 8 * sum(map(len, rangecoder.encode(blocks, shares))) / len(ids)
        assert -(p * np.log2(p)).sum() - bits > saved


def test_token_files(spark, docs):
    out = tokenfile.store_tokens(docs, n_files=3).collect()
    enc = tokens.PieceEncoder("word_bpe_49k.json")
    at = 0
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [(r[0], r[1]) for r in sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1] is not None, (r[1] or "").encode()))]
    want = []
    for i, t in order:
        ids = np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want.append((i, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in sorted(out, key=lambda r: r.start)] == want
    assert tokenfile.store_tokens(docs.limit(0)).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def test_url_rules(spark):
    urls = ["http://A.example.com/en/1?x", "https://www.example.com/en/", "http://x.net/es/2", "http://x.net/pt#a/b", "no scheme", None, "http://com/", "x://q.example.org", "http://x.org/alias", "http://x.org/other", "http://www.example.com/en/z", "http://b.org/1"]
    html = [None] * 7 + ["", '<link rel="canonical" href="//x.net/es/2">', "<meta http-equiv=refresh content='0; url=/alias'>", '<LINK href="http://b.org/1" REL=canonical>', ""]
    pages = spark.createDataFrame([(i, u, h, 1) for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string, root int")
    want = [("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("x.net", "/es/2", "net/es/", "block"), ("x.net", "/pt", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "/", "com/", "allow"), ("q.example.org", "", None, "allow"), ("x.org", "/alias", None, "block"), ("x.org", "/other", None, "block"), ("www.example.com", "/en/z", "www.example.com/en/", "allow"), ("b.org", "/1", None, "allow")]
    for rules in (RULES, spark.createDataFrame(RULES, "host string, path string, verdict string")):
        out = urlfilter.judge_urls(pages, rules).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in out] == want
    log = spark.createDataFrame([("http://x.org/alias", "http://www.example.com/en/q")], "source string, target string")
    out = urlfilter.judge_urls(pages, RULES, log).orderBy("page_id").collect()
    assert out[8].verdict == out[9].verdict == "allow" and out[2].verdict == "block"
    assert urlfilter.judge_urls(pages.limit(0), RULES).count() == 0


def brute_spans(rows, n, keep_first):
    seen, order = {}, sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    raw = [(t or "").encode() for _, t in rows]
    for i in order:
        for s in range(len(raw[i]) - n + 1):
            seen.setdefault(raw[i][s : s + n], []).append((i, s))
    out = []
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            places = seen[b[s : s + n]]
            if len(places) > 1 and not (keep_first and places[0] == (i, s)):
                gone[s : s + n] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("keep_first", "large"), [(False, 4096), (True, 4096), (False, 1), (True, 1)])
def test_repeated_passages(spark, monkeypatch, keep_first, large):
    monkeypatch.setattr(suffix, "LARGE_BUCKET", large)
    monkeypatch.setattr(suffix, "PIECE", 500)
    rng = random.Random(9)
    t = texts(7, 60, words=80)
    passage = t[0] + t[1]
    for i in range(10, 30, 3):
        cut = rng.randrange(len(t[i]) + 1)
        a = rng.randrange(len(passage) // 2)
        t[i] = t[i][:cut] + passage[a : a + rng.randint(30, 200)] + t[i][cut:]
    d = docs_of(spark, t, [] if keep_first else [(3, t[3]), (None, t[5])])
    rows = rows_of(d)
    want = brute_spans(rows, 40, keep_first)
    got = suffix.removal_digest(d, 40, 12, keep_first).collect()
    left = Counter()
    for (i, x), gone in zip(rows, want, strict=True):
        b = (x or "").encode()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left[i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    assert Counter(map(tuple, got)) == left and sum(r.n_removed for r in got) > 500
    assert suffix.removal_digest(d.limit(0), 40, 12, keep_first).count() == 0
    if keep_first:
        cut = suffix.cleaned(d, 40, 12)
        assert cut.columns == d.columns and cut.count() == d.count()


@pytest.mark.parametrize("large", [4096, 1])
def test_texts_that_polynomial_hashes_take_for_equal(spark, monkeypatch, large):
    """No string of 40 bytes in common, but Thue-Morse words and their complements in the same places."""
    monkeypatch.setattr(suffix, "LARGE_BUCKET", large)
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rng = random.Random(3)
    tail = "".join(rng.choices("cdefgh", k=60))
    rows = [(1, word + tail), (2, other + tail), (3, "x" + tail[:50])]
    got = {r.doc_id: r for r in suffix.removal_digest(spark.createDataFrame(rows, "doc_id long, text string"), 40, 12).collect()}
    for (i, t), gone in zip(rows, brute_spans(rows, 40, False), strict=True):
        assert got[i].n_removed == int(gone.sum()) and got[i].kept_sha256 == hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("keep_first", [False, True])
def test_a_bucket_of_many_classes(spark, keep_first):
    """10,000 texts with one passage between different neighbours: more classes in a bucket than a task orders."""
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh", k=50))
    t = ["".join(rng.choices("stuvw", k=rng.randint(0, 30))) + passage + "".join(rng.choices("stuvw", k=30)) for _ in range(10_000)]
    d = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    found = suffix.scan(d, 40, 12, keep_first).select(F.inline("anchors")).groupBy("key").agg(F.countDistinct("o", "n", "hull").alias("m")).agg(F.max("m")).first()[0]
    assert found > suffix.LARGE_BUCKET
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.removal_digest(d, 40, 12, keep_first).collect()}
    for i, gone in enumerate(brute_spans(list(enumerate(t)), 40, keep_first)):
        assert got[i] == (int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()))


def test_longest_previous_factors():
    """LPF from suffix order, common prefixes and nearest smaller positions against its definition."""
    rng = np.random.default_rng(4)
    for alphabet, size in ((2, 60), (3, 200), (26, 80)):
        for length in (1, 5, 8, 13, 40):
            data = rng.integers(0, alphabet, size).astype(np.uint8)
            at = np.arange(size - length + 1)
            ranks = suffix.prefix_ranks(data, length)
            order = np.lexsort((at, ranks[-1][1][at]))
            raw = data.tobytes()
            assert [raw[i : i + length] for i in order] == sorted(raw[i : i + length] for i in at)
            lcp = np.concatenate([[0], suffix.common_prefix(data, ranks, order[:-1], order[1:])])
            lpf = np.empty(len(at), int)
            lpf[order] = suffix.longest_previous_factors(order, lcp)

            def shared(i, j):
                return next((m for m in range(length) if raw[i + m] != raw[j + m]), length)

            assert lpf.tolist() == [max((shared(i, j) for j in range(i)), default=0) for i in at]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_that_share_a_key_are_told_apart(name, monkeypatch):
    """Thue-Morse words and their complements, which polynomial hashes mod 2**64 can't tell apart, and keys that all clash."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    cases = [word, other, word[:32] + " " + other[:32], *(t or "" for t in texts(12, 30))]
    enc = tokens.PieceEncoder(name)
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(tokens.Spans, "keys", lambda self: np.full(len(self.size), 5, np.uint64))
        ids, counts = tokens.PieceEncoder(name).encode_all([x.encode() for x in cases])
        for x, got in zip(cases, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == enc.tokenizer.encode(x, add_special_tokens=False).ids
