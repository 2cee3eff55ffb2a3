"""The data model: a bipartite network as edges (row_id, col_id, w) with optional dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bipartrix.session import cut_lineage

EDGES = "row_id string, col_id string, w double"


@dataclass
class Bundle:
    """Edges with their row and column dimensions (idx, id) and provenance."""

    edges: DataFrame
    rows: DataFrame
    cols: DataFrame
    metadata: dict[str, str] = field(default_factory=dict)


class Loader(Protocol):
    """Anything that loads a Bundle."""

    def load(self) -> Bundle: ...


def edges_of(df: DataFrame, row: str, col: str, weight: str | None = None) -> DataFrame:
    """Edges from long rows: equal pairs are summed, zero and null weights are absent."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    out = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    out = out.groupBy(F.col(row).cast("string").alias("row_id"), F.col(col).cast("string").alias("col_id")).agg(F.sum(w).alias("w"))
    return out.where("w <> 0")


def _in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range partitions of a table with their number ``_p``; written out, as numbers taken from them must fit each other."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))


def row_numbers(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """df with ``name``, the row's number in an order, from ``first`` on.

    Numbers come from a range partitioning: each partition counts on its own, and
    only the partitions' totals, a row each, are summed in one place.
    """
    own = _in_order(df, order)
    totals = own.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + (first - 1)
    return own.join(F.broadcast(before), "_p").withColumn(name, (F.col("_b") + rank).cast("int")).drop("_p", "_b")


def sums_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with ``name``, the sum of ``value`` over the rows before it in an order; the same way."""
    own = _in_order(df, order)
    totals = own.groupBy("_p").agg(F.sum(value).alias("_n"))
    before = totals.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    here = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + here).drop("_p", "_b")


def quantiles(df: DataFrame, c: str, shares: list[float], names: list[str]) -> DataFrame:
    """One row: exact quantiles of a number, interpolated between the two values around a rank; null without values.

    Range partitions and their counts say in which of them a rank lies. Only those
    are read again, as counts of their different values.
    """
    own = _in_order(df.select(F.col(c).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"), [F.col("v")])
    counts = sorted((r["_p"], r["n"]) for r in own.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    n, found = sum(x for _, x in counts), {}
    for share in shares:
        for rank in {int(share * (n - 1)), -int(-share * (n - 1) // 1)} if n else ():
            before = 0
            for p, size in counts:
                if before <= rank < before + size:
                    found[rank] = (p, rank - before)
                before += size
    here = own.where(F.col("_p").isin(sorted({p for p, _ in found.values()}))).groupBy("_p", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = cut_lineage(here.withColumn("upto", F.sum("n").over(Window.partitionBy("_p").orderBy("v"))))
    value = {}
    for rank, (p, at) in found.items():
        value[rank] = upto.where((F.col("_p") == p) & (F.col("upto") > at)).agg(F.min("v")).first()[0]
    row = []
    for share in shares:
        x = share * (n - 1)
        lo, hi = int(x), -int(-x // 1)
        row.append(value[lo] + (x - lo) * (value[hi] - value[lo]) if n else None)
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{x} double" for x in names))


def dimension(df: DataFrame, label: str, name: str = "id") -> DataFrame:
    """(idx, name): distinct labels, numbered from 0 in their order."""
    labels = df.select(F.col(label).alias(name)).where(F.col(name).isNotNull()).distinct()
    return row_numbers(labels, [F.col(name)], "idx", 0).select("idx", name)


def bundle(edges: DataFrame, source: str, **metadata: str) -> Bundle:
    stamp = datetime.now(UTC).isoformat()
    return Bundle(edges, dimension(edges, "row_id"), dimension(edges, "col_id"), {"source": source, "created_at": stamp, **metadata})


def transposed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "w")


def same_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``equal``: whether two edge sets hold the same pairs and weights."""
    pick = ["row_id", "col_id", "w"]
    left, right = a.select(pick).exceptAll(b.select(pick)).limit(1), b.select(pick).exceptAll(a.select(pick)).limit(1)
    return left.unionByName(right).agg((F.count(F.lit(1)) == 0).alias("equal"))
