"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

Most rules look at a line alone. One is learned from the corpus: a line that many
documents of a source hold between different neighbours is that site's footer or
menu, in no list of phrases. How many neighbours a line has is counted once over
all documents; copies of one document count as one, for their lines have the same
neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Set
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bipartrix.llm.common import materialise, only, slices

SPACES = "\t\n\x0b\x0c\r "  # \x09-\x0D and \x20
SYMBOLS = "#*$%&|<>"

TERMINAL = tuple(".!?…:;。！？")
CLOSING = "\"'”’»)]}"
SENTENCE_END = re.compile(r"[.!?…。][\"'”’»)]* ")
SEPARATORS = re.compile(r"[|›»•·>]")
BOILERPLATE = re.compile(
    r"all rights reserved|copyright|©|licen[sc]ed under|terms of (?:use|service)|privacy policy|cookie"
    r"|javascript|sign (?:in|up)|log ?in|subscribe|newsletter|click here|share this|read more"
    r"|tous droits réservés|mentions légales|alle rechte vorbehalten|impressum|todos los derechos reservados",
    re.IGNORECASE,
)

#: Windows of this many words count as repeated when found twice.
WINDOW = 5
#: From so many words on, windows are compared in numpy instead of as tuples.
LONG_TEXT = 50_000


def repeated_window_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n < LONG_TEXT:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) == n:
            return 0
        seen = Counter(windows)
        again = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    else:
        codes: dict[bytes, int] = {}
        ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
        pair = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)[1].astype(np.int64)
        four = np.unique(pair[:-2] * (pair.max() + 1) + pair[2:], return_inverse=True)[1].astype(np.int64)
        _, which, counts = np.unique(four[:-1] * len(codes) + ids[4:], return_inverse=True, return_counts=True)
        again = counts[which] > 1
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def line_verdict(line: str, n_words: int, symbols_per_word: float = 0.5, caps_share: float = 0.6, long_line: int = 20) -> str | None:
    """The first rule that the line fails, or None. ``n_words`` is at least 1.

    A line of ``long_line`` words or more may lack its last mark if it holds a sentence's end elsewhere.
    """
    s = line.strip(SPACES)
    if len(SEPARATORS.findall(s)) >= 2 and len(SEPARATORS.findall(s)) * 4 >= n_words:
        return "navigation"
    if sum(map(s.count, SYMBOLS)) > symbols_per_word * n_words:
        return "symbols"
    upper = sum(map(str.isupper, s)) if not s.islower() else 0
    if upper >= 12 and upper > caps_share * sum(map(str.isalpha, s)):
        return "capitals"
    if BOILERPLATE.search(s):
        return "boilerplate"
    if not s.rstrip(CLOSING).endswith(TERMINAL) and (n_words < long_line or not SENTENCE_END.search(s)):
        return "punctuation"
    return None


#: Numbers are alike in a line's key, so that pages and years don't tell footers apart.
NUMBERS = re.compile(rb"[0-9]+")


def line_key(line: bytes) -> int:
    """64 bits of a line's words, lower-cased, whatever white space lies between them."""
    return int.from_bytes(blake2b(NUMBERS.sub(b"0", b" ".join(line.lower().split())), digest_size=8).digest(), "little", signed=True)


def _source(docs: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def common_lines(docs: DataFrame, share: float = 0.02, least: int = 10) -> DataFrame:
    """(src, common): for each source the keys of its footers and menus.

    Those are lines with at least ``least`` different lines before them, in as
    many documents as are ``share`` of the source's. A document's first line comes
    after nothing, and a line that it holds twice counts once. There are at most
    1 / share times as many of them as a document of the source has lines on average.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("lines")
        for batch in slices(batches):
            seen: set[tuple[str, int, int]] = set()
            for src, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                before, own = 0, set()
                for line in (text or b"").split(b"\n"):
                    if line.strip():
                        key = line_key(line)
                        if key not in own:
                            seen.add((src, key, before))
                            own.add(key)
                        before = key
            src, key, before = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(key, pa.int64()), pa.array(before, pa.int64())], ["src", "line", "before"])

    places = docs.select(_source(docs).alias("src"), "text").mapInArrow(run, "src string, line long, before long").distinct()
    met = places.groupBy("src", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    size = docs.groupBy(_source(docs).alias("src")).agg(F.count(F.lit(1)).alias("docs"))
    return met.join(size, "src").where(F.col("n") >= share * F.col("docs")).groupBy("src").agg(F.collect_set("line").alias("common"))


class LineCleaner:
    """Base measures and the line-first verdict of one text.

    max_lost: share of the words above which the loss rejects the document.
    """

    def __init__(self, max_lost: float = 0.5, min_words: int = 10, max_repeat_pct: int = 20):
        self.max_lost, self.min_words, self.max_repeat_pct = max_lost, min_words, max_repeat_pct

    def __call__(self, text: str | None, with_text: bool, common: Set[int] = frozenset()) -> tuple:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
        n = len(words)
        chars = len(text) - sum(map(text.count, SPACES))
        symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        dup_lines = len(lines) - len(set(lines))
        repeat = repeated_window_words(words)
        base_failed = n < self.min_words or 100 * repeat > self.max_repeat_pct * n
        lost = removed = 0
        kept_lines = []
        for line in text.split("\n"):
            own = line.encode("utf-8", "surrogatepass")
            k = len(own.split())
            if k and (line_verdict(line, k) or (common and line_key(own) in common)):
                lost += k
                removed += 1
            elif with_text:
                kept_lines.append(line)
        kept = not base_failed and lost <= self.max_lost * n
        return (n, chars, symbols, dup_lines, repeat, base_failed, kept, removed, lost, "\n".join(kept_lines) if with_text else None)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long, clean_text string"


def clean_lines(docs: DataFrame, cleaner: LineCleaner | None = None, with_text: bool = True, share: float | None = 0.02, least: int = 10) -> DataFrame:
    """doc_id, the base measures, the verdict, what was removed, and the cleaned text (null without ``with_text``).

    One row for each row of ``docs``, also where doc_ids or texts repeat or are
    null. Lines fail by their own look or as common_lines() of their source, for
    which ``share`` and ``least`` stand (no such rule with a null share; null
    sources, or a table without that column, are one source). Null texts count as
    empty and fail for want of words. Very long texts are read whole, line by line.
    Columns other than doc_id, text and source are ignored, and an empty table
    gives no rows.
    """
    cleaner = cleaner or LineCleaner()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
        only("lines")
        known: dict[str, frozenset[int]] = {}
        for batch in slices(batches):
            for i, src in enumerate(batch.column(2).to_pylist()):
                if src not in known:
                    known[src] = frozenset(batch.column(3)[i].as_py() or ())
            rows = [cleaner(t.as_py(), with_text, known[src]) for t, src in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)
            if len(known) > 1000:
                known.clear()

    own = docs.select("doc_id", "text", _source(docs).alias("src"))
    if share is None:
        own = own.withColumn("common", F.lit(None).cast("array<long>"))
    else:
        own = own.join(materialise(common_lines(docs, share, least), "common-lines"), "src", "left").select("doc_id", "text", "src", "common")
    return own.mapInArrow(clean, f"doc_id {kind}, {SCHEMA}")
