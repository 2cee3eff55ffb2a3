"""Contiguous shards of near-equal bytes by global prefix sums.

The rows are range-partitioned by key once, narrow (key, size, checksum). Every
partition's total is one row; running sums over these few rows give each
partition its global offset, and a sum inside the partition completes the
prefix. A row goes to the shard in whose equal share of the bytes its middle
byte lies, so every cut lies within half a row of its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bipartrix.llm.common import materialise, partitions, running_totals, text_or_empty


def balanced_shards(rows: DataFrame, key: str, size: str, n_shards: int, name: str = "shards") -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in it).

    rows: the columns to carry; ``size`` is a non-negative number of bytes.
    Order is that of ``key``, nulls first; rows with equal keys follow the other
    columns' order, and rows equal in all columns are interchangeable. An empty
    table gives no rows. Where all sizes are 0, all rows go to shard 0.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    order = [F.col(c).asc_nulls_first() for c in [key, *[c for c in rows.columns if c != key]]]
    ranged = materialise(
        rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()), name
    )
    parts = ranged.groupBy("_pid").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    # At most one row for each shuffle partition: small by construction.
    offsets = F.broadcast(running_totals(parts, "_pid", ["_bytes", "_rows"]))
    total = F.broadcast(parts.agg(F.sum("_bytes").alias("_total")))
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    number = Window.partitionBy("_pid").orderBy(*order)
    placed = (
        ranged.join(offsets, "_pid")
        .join(total)
        .withColumn("_before", F.col("_bytes_before") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .withColumn("_nth", F.col("_rows_before") + F.row_number().over(number) - 1)
        .withColumn("shard", F.coalesce(F.least(F.lit(n_shards - 1), F.expr(f"((2 * _before + {size}) * {n_shards}) div nullif(2 * _total, 0)")), F.lit(0)).cast("int"))
    )
    placed = materialise(placed.select(*rows.columns, "shard", "_nth"), f"{name}-placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("_nth").alias("_first")))  # n_shards rows
    return placed.join(first, "shard").select(*rows.columns, "shard", (F.col("_nth") - F.col("_first")).alias("slot"))


def document_sizes(docs: DataFrame, overhead: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus overhead, null: none), text_crc32."""
    text = text_or_empty("text")
    return docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The ``bytes`` law over documents: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    Null texts count as empty. Columns other than doc_id and text are ignored,
    whatever their names.
    """
    placed = balanced_shards(document_sizes(docs), "doc_id", "size", n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
