"""The queries opN_<name>, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartrix.llm import alignment, decontam, linerules, merkle, minhash, occurrence, oracle, packing, sharding, suffix, tokenfile, toxicity, urlfilter, warc

URL_RULES: list[urlfilter.Rule] = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    written = warc.archive_pages(pages, min_bytes=0)
    # A file to a task; the names are few.
    read = warc.read_warc(written.repartition(max(1, written.count())), with_data=False)
    # A row without page_id is named "null", which is no number.
    page = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast(pages.schema["page_id"].dataType)
    return warc.record_summary(read).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op2_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.clean_lines(table(spark, sf_dir, "documents"), with_text=False).drop("clean_text")


def op3_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=0, capacity=1024, with_ids=False).drop("ids")


def op4_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity_pct=80)


def op5_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, threshold_pct=80)


def op8_context_mixing_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.store_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1, with_ids=False).drop("ids")


def op9_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("alias_class")


def op10_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digest(table(spark, sf_dir, "documents"), length=400, keep_first=False)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_alignment(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model", with_groups=False)


def op12_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrence.jaccard_groups(table(spark, sf_dir, "documents"), shingle_words=3, threshold_pct=90)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
