"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a lexicon that is itself learned from the training
rows, its nearness to second-person words, and rates of capitals, punctuation
and obfuscated spellings. Labels are read only while fitting, from a bounded
sample; every document is scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.llm.common import materialise, only, release, slices

WORD = re.compile(r"[^\W\d_]+")
#: Letters with a digit or symbol inside the word.
OBFUSCATED = re.compile(r"(?<![^\W\d_])[^\W\d_]+[0-9@$!*+]+[^\W\d_]+")
PLAIN = str.maketrans("0134578@$!+", "oleastbasit")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre vos ton tes du dich dir dein deine ihr euch euer usted ustedes vosotros ti tus".split())

#: A stem is a whole word ("=word") or a prefix of one of these lengths.
PREFIXES = range(4, 9)
NEAR = 5
FEATURES = ("log_words", "word_density", "prefix_density", "log_hits", "distinct_hits", "near_second_person", "hidden_hits", "capitals", "capital_words", "exclamations", "punctuation", "obfuscated", "stretched")
#: Bound of the cache of looked-up words in a task.
CACHE_WORDS = 200_000


def stems(word: str) -> list[str]:
    return [f"={word}", *[word[:k] for k in PREFIXES if len(word) >= k]]


class Featuriser:
    """Dense features of a text under a lexicon of stems."""

    def __init__(self, lexicon: list[str]):
        self.whole = frozenset(x[1:] for x in lexicon if x[0] == "=")
        self.prefix = frozenset(x for x in lexicon if x[0] != "=")
        self.cache: dict[str, int] = {}

    def hit(self, word: str) -> int:
        """2: a word of the lexicon, 1: has one of its prefixes, 0: neither."""
        got = self.cache.get(word)
        if got is None:
            got = 2 if word in self.whole else int(any(word[:k] in self.prefix for k in PREFIXES))
            if len(self.cache) < CACHE_WORDS:
                self.cache[word] = got
        return got

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = WORD.findall(low)
        n, size = max(1, len(words)), max(1, len(text))
        hits = [self.hit(w) for w in words]
        at = [i for i, h in enumerate(hits) if h]
        near = 0
        if at:
            near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
        hidden = OBFUSCATED.findall(low)
        upper = sum(map(str.isupper, text)) if low != text else 0
        return [
            math.log1p(len(words)),
            hits.count(2) / n,
            hits.count(1) / n,
            math.log1p(len(at)),
            float(len({words[i] for i in at})),
            near / n,
            float(sum(self.hit(x.translate(PLAIN)) > 0 for x in hidden)),
            upper / size,
            sum(map(str.isupper, text.split())) / n if upper else 0.0,
            text.count("!") / size,
            sum(map(text.count, ".,;:?\"'()-")) / size,
            len(hidden) / n,
            len(STRETCHED.findall(low)) / n,
        ]


def with_features(docs: DataFrame, lexicon: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``features`` (array of doubles)."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        make = Featuriser(lexicon)
        for b in slices(batches):
            rows = [make(t.as_py()) for t in b.column(b.num_columns - 1)]
            flat = pa.array(np.array(rows, np.float64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists], [*keep, "features"])

    return docs.select(*keep, F.col("text").alias("_scored_text")).mapInArrow(run, f"{kinds}, features array<double>")


def learn_lexicon(train: DataFrame, size: int, min_docs: int) -> list[str]:
    """The stems whose document frequency speaks most for label 1; counted over all training rows in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for b in slices(batches):
            names, labels = [], []
            for t, y in zip(b.column(0), b.column(1), strict=True):
                own = {s for w in set(WORD.findall((t.as_py() or "").lower())) if len(w) > 2 for s in stems(w)}
                names += own
                labels += [y.as_py()] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(labels, pa.int32())], ["stem", "label"])

    totals = train.agg(F.sum("label"), F.count(F.lit(1))).first()
    pos, rows = totals[0] or 0, totals[1]
    if not pos or pos == rows:
        return []
    counts = train.select("text", "label").mapInArrow(run, "stem string, label int").groupBy("stem").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("a") + 0.5) / (pos + 1.0)) - F.log((F.col("n") - F.col("a") + 0.5) / (rows - pos + 1.0))
    best = counts.where(F.col("a") >= min_docs).withColumn("odds", odds).where("odds > 2.5")
    return [r["stem"] for r in best.orderBy((F.col("odds") * F.log1p("a")).desc(), "stem").limit(size).collect()]


@dataclass
class ToxicityModel:
    lexicon: list[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def score(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """``keep`` columns and ``score`` in 0 to 1 for every row, empty and null texts too."""
        if self.trees is None:
            return docs.select(*keep, F.lit(self.prior).alias("score"))
        out = self.trees.transform(with_features(docs, self.lexicon, keep).withColumn("features", array_to_vector("features")))
        out = out.withColumn("raw", vector_to_array("probability")[1]).select(*keep, "raw")
        out = self.calibration.transform(out)
        # Calibration has flat steps; a thousandth of the raw score orders the rows on one.
        return out.select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("prediction") + 0.001 * F.col("raw"))).alias("score"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, lexicon_size: int = 512, min_docs: int = 5, trees: int = 20, depth: int = 4) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows (least hashes of doc_id) whose doc_id isn't held out.

    The lexicon and the trees come from about two thirds of them, the
    calibration from the rest. Without both labels in each part, the model is the
    share of label 1 (0 for no labels at all). Null labels and ids are left out;
    of repeated labels the largest counts; of repeated documents each row counts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    picked = known.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(max_rows)
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", F.pmod("_h", F.lit(3)).alias("part")), "toxicity-sample")
    parts = {r["part"] == 0: r for r in sample.groupBy((F.col("part") == 0).alias("part")).agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n")).collect()}
    n, a = sum(r["n"] for r in parts.values()), sum(r["a"] for r in parts.values())
    if len(parts) < 2 or any(not 0 < r["a"] < r["n"] for r in parts.values()):
        return ToxicityModel([], None, None, a / n if n else 0.0)
    fit_rows = sample.where("part <> 0")
    lexicon = learn_lexicon(fit_rows, lexicon_size, min_docs)
    dense = materialise(with_features(sample.select("text", F.col("label").cast("double").alias("label"), "part"), lexicon, ("label", "part")), "toxicity-features")
    # Some thousand short rows: each turn of boosting is a few jobs over them.
    dense = dense.coalesce(2).withColumn("features", array_to_vector("features"))
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64).fit(dense.where("part <> 0"))
    raw = boosted.transform(dense.where("part = 0")).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw)
    release(sample)
    return ToxicityModel(lexicon, boosted, calibration, a / n)
