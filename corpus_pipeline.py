"""A training corpus from ``documents``: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), judges all that the stage before it
kept, and returns a DataFrame; run() writes each one's result to the shared
folder as Parquet, for the next to read.

Each stage judges rows one by one, whatever their doc_id: ids may repeat or be
null. Null and empty texts pass all of them (as one end token at last); very
long texts are worked on in parts; columns beyond doc_id and text are carried
along under any name; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartrix.llm import decontam, minhash, packing, suffix, toxicity
from bipartrix.llm.common import materialise

#: Scores from here on are rejected.
TOXIC_FROM = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, scores below TOXIC_FROM."""
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    # The row travels as one struct, so that no column's name can clash.
    scored = model.score(docs.select(F.struct(*docs.columns).alias("row"), "text"), keep=("row",))
    return scored.where(F.col("score") < TOXIC_FROM).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share 80 % of their five-word shingles: that with the least doc_id.

    Rows are judged one by one: those that repeat a doc_id, or have none, too. Of
    equal ids the first row stays, and a null id counts as the greatest.
    """
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("_row").alias("row"))
    found = minhash.near_duplicates(rows.select(name.alias("doc_id"), "text"), shingle_words=5, threshold_pct=80)
    gone = found.where("NOT kept").select(F.col("doc_id.row").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 200 bytes or more that an earlier text holds; documents that this leaves without a word go.

    Those that came without one (null, empty, blank) pass as they are.
    """
    has_word = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    cut = suffix.cleaned(docs.withColumn("_blank", ~has_word), length=200, anchor=60)
    return cut.where(F.col("_blank") | has_word).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item within a fifth of its words, whatever their doc_id."""
    return decontam.drop_leaking(docs, _table(spark, sf_dir, "benchmark"), similarity_pct=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in windows of 1024 tokens, with their ids."""
    return packing.pack_documents(docs, "byte_bpe_50k.json", end_id=0, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Trees, walks and token ids aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
