"""Sinks: Parquet and CSV folders, and a JSON file of metadata beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from bipartrix.model import Bundle


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(metadata, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_bundle(b: Bundle, path: str) -> None:
    for name in ("edges", "rows", "cols"):
        write_parquet(getattr(b, name), f"{path}/{name}")
    write_metadata(b.edges.sparkSession, b.metadata, f"{path}/metadata")


def read_bundle(spark: SparkSession, path: str) -> Bundle:
    e, r, c = (spark.read.parquet(f"{path}/{name}") for name in ("edges", "rows", "cols"))
    return Bundle(e, r, c, json.loads(spark.read.text(f"{path}/metadata").first()[0]))
