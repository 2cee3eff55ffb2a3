"""Cross-tokenizer alignment against a plain one, text by text."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bipartrix.llm import alignment

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def letters():
    """Byte of each letter of a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = letters()
NAMES = {i: t for t, i in A.get_vocab().items()}


def a_bytes(i):
    return bytes(LETTERS[c] for c in NAMES[i])


def b_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def plain(text):
    """(groups as pairs of id lists, links) or None where there are no tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    want = (" " + text).encode()
    if b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
        return None
    spans = []
    for ids, f in ((a, a_bytes), (b, b_bytes)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(f(i)), i))
            at += len(f(i))
        spans.append(own)
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = [([i for s, e, i in spans[0] if lo < e <= hi], [i for s, e, i in spans[1] if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
    return groups, links


def brute(texts):
    each = [plain(t) for t in texts]
    docs = Counter(p for x in each if x for p in set(x[1]))
    top = defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    out = []
    for x in each:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = x
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        best = sum(docs[p] == top[p[0]] for p in links)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), best, sum(docs[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def some_texts():
    rng = random.Random(4)
    marks = ["the", "Ünter", "ing", " ", "  ", "\n", "\t", ".", "é", "日本", " ", " ", "'s", "12", "$", "<s>", "<|endoftext|>", "<0x0A>", "😀", "\x00", "́", "▁", "ß", "retitioning", "\r\n"]
    out = ["".join(rng.choices(marks[: rng.choice([4, 12, 25])], k=rng.randint(1, 40))) for _ in range(150)]
    return [*out, None, "", " ", "  ", "a ", "\n", "\n\n x", out[0], out[1], "a▁b", "x" * 300, "la " * 200]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def as_rows(df):
    return [tuple(r[c] for c in FIELDS) for r in sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))]


def table(spark, texts, last_id=True):
    rows = [(i, t, "x", 1, None) for i, t in enumerate(texts)]
    if not last_id:
        rows[-1] = (None, *rows[-1][1:])
    return spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int, code long")


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    if small:  # texts in parts, tables in blocks, sums handed on
        monkeypatch.setattr(alignment, "CHUNK", 40)
    texts = some_texts()
    d = table(spark, texts, last_id=False)
    got = alignment.cross_alignment(d)
    assert as_rows(got) == brute(texts)
    for r in got.collect():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 or (r.groups, r.groups_sha256, r.n_a) == ("", "", 0)
    assert alignment.cross_alignment(d.limit(0)).count() == 0
    twice = table(spark, [*texts, *texts])
    assert Counter(as_rows(alignment.cross_alignment(twice, with_groups=False))) == Counter(brute([*texts, *texts]))


def test_parts_of_long_texts(monkeypatch):
    """Parts that are cut at spaces and line feeds give the whole text's groups and counts."""
    monkeypatch.setattr(alignment, "CHUNK", 30)
    al = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    for t in some_texts():
        if not t:
            continue
        row = alignment._Row()
        for p in alignment._parts(b" " + t.encode()):
            alignment._add(al, [row], [(0, p)], True)
        want = plain(t)
        assert row.good == (want is not None)
        if want:
            assert b"".join(row.text).decode() == ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in want[0])
            x, n = (np.frombuffer(y, k) for y, k in zip(alignment._pairs(row), ("<i8", "<i4"), strict=True))
            assert dict(zip(x.tolist(), n.tolist(), strict=True)) == Counter(a * 32_000 + b for a, b in want[1])


def test_large_pair_tables_are_read_in_blocks(spark, monkeypatch):
    rows = alignment.aligned(table(spark, some_texts()), with_groups=False)
    pairs = alignment.pair_counts(rows, 32_000)
    files, known = tuple(pairs.inputFiles()), {r.code: (r.docs, r.best) for r in pairs.collect()}
    asked = np.array(random.Random(1).choices(sorted(known), k=500))
    whole = alignment.PairTable(files)
    monkeypatch.setattr(alignment, "HELD", 0)
    parts = alignment.PairTable(files)
    assert whole.kept is not None and parts.kept is None
    for t in (whole, parts):
        n, best = t.look_up(asked)
        assert list(zip(n.tolist(), best.tolist(), strict=True)) == [known[c] for c in asked.tolist()]
    assert all(x.size == 0 for x in parts.look_up(asked[:0]))


def test_sums_that_a_task_hands_on(spark, monkeypatch):
    rows = alignment.aligned(table(spark, some_texts()), with_groups=False).cache()
    want = Counter(map(tuple, alignment.pair_counts(rows, 32_000).collect()))
    monkeypatch.setattr(alignment, "SUMMED", 50)
    assert Counter(map(tuple, alignment.pair_counts(rows, 32_000).collect())) == want
