"""Distributed connected components by randomised contraction.

In each round every node adopts the neighbour (or itself) of least priority,
a hash of node and round, and edges are rewritten to the adopted nodes. The
number of nodes falls by a constant factor in expectation whatever the shape
of the graph, long chains and stars included. Minima are aggregated before the
shuffle, so a hub costs no more than its edges; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.llm.common import materialise, partitions, release

MAX_ROUNDS = 200
ROWS_PER_TASK = 100_000


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, root): every node with an edge to another one, and one node that stands for its component.

    Edges are undirected; null ends, self-loops and repeated edges are harmless.
    ``root`` is an arbitrary member, the same for all of a component. An empty
    table gives an empty result.
    """
    kind = edges.schema[src].dataType
    e = edges.select(F.col(src).cast(kind).alias("u"), F.col(dst).cast(kind).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = materialise(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    labels, parts = None, partitions(edges.sparkSession)
    for turn in range(MAX_ROUNDS):
        left = e.count()
        if not left:
            break
        # Small tables are written by few tasks.
        few = min(parts, 1 + left // ROWS_PER_TASK)
        few0 = few if labels is None else few0
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("n"))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("b"))
        step = materialise(best.select(F.col("u").alias("node"), F.least(F.col("b"), rank("u"))["n"].alias("to")).coalesce(few), "cc-step")
        to_u, to_v = step.select(F.col("node").alias("u"), F.col("to").alias("mu")), step.select(F.col("node").alias("v"), F.col("to").alias("mv"))
        moved = e.join(to_u, "u").join(to_v, "v").where("mu <> mv")
        smaller = materialise(moved.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct().coalesce(few), "cc-edges")
        if labels is None:
            grown = step.select("node", F.col("to").alias("root"))
        else:
            grown = labels.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        old, labels = labels, materialise(grown.coalesce(few0), "cc-labels")
        release(e, step, *([old] if old is not None else []))
        e = smaller
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    release(e)
    if labels is None:
        return edges.sparkSession.range(0).select(F.lit(None).cast(kind).alias("node"), F.lit(None).cast(kind).alias("root"))
    return labels
