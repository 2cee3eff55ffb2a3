"""A Merkle manifest of a table: leaves by row, a binary tree for each group, one over the groups' roots, and a proof for each row.

Rows are numbered within their group by range partitions and totals. Numbers cut
them into aligned buckets of 2**HEIGHT consecutive nodes, whose trees are whole
subtrees. Executors work on Arrow batches of whole buckets with DuckDB, a query
for each level: ``string_agg`` in order and ``sha256``. Bucket roots are the nodes
of the next round, so that a group of any size needs a few rounds; Spark joins
the proofs of the upper rounds, and of the tree over groups, to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bipartrix.llm.common import materialise, only, partitions, release, running_totals

#: Levels that a bucket covers; it has at most 2**HEIGHT nodes.
HEIGHT = 12
#: Nodes in a DuckDB query: whole buckets, some 10 MB.
ROWS = 1 << 15


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts joined."""
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with ``pos``, the row's number from 0 within its ``g``, in the order of some columns (nulls first), and ``n``, its group's rows.

    A range partition counts its own rows; only totals, a row for each partition
    and group, are summed in one place.
    """
    by = [F.col(c).asc_nulls_first() for c in ["g", *order]]
    ranged = materialise(df.repartitionByRange(partitions(df.sparkSession), *by).withColumn("_pid", F.spark_partition_id()), name)
    parts = ranged.groupBy("_pid", "g").agg(F.count(F.lit(1)).alias("_n"))
    before = running_totals(parts, "_pid", ["_n"], by=["g"]).join(parts.groupBy("g").agg(F.sum("_n").alias("n")), "g")
    number = F.row_number().over(Window.partitionBy("_pid", "g").orderBy(*by)) - 1
    return ranged.withColumn("_at", number).join(before, ["_pid", "g"]).select(*df.columns, (F.col("_n_before") + F.col("_at")).cast("long").alias("pos"), "n")


def _queries(height: int) -> tuple[list[str], str, str]:
    """(a query for each level, that of the roots, that of the steps) over a table ``nodes`` (k, b, pos, levels, h)."""
    levels = ["CREATE TEMP TABLE l0 AS SELECT b, pos, levels, h FROM nodes"]
    for i in range(height):
        levels.append(
            f"CREATE TEMP TABLE l{i + 1} AS SELECT b, pos // 2 AS pos, any_value(levels) AS levels, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l{i} WHERE levels > {i} GROUP BY b, l{i}.pos // 2"
        )
    roots = "SELECT b, h FROM (" + " UNION ALL ".join(f"SELECT b, h FROM l{i} WHERE levels = {i}" for i in range(height + 1)) + ") ORDER BY b"
    step = "CASE WHEN f.levels <= {0} THEN NULL WHEN s{0}.h IS NULL THEN '-' WHEN (f.pos >> {0}) & 1 = 1 THEN 'L' || s{0}.h ELSE 'R' || s{0}.h END"
    joins = " ".join(f"LEFT JOIN l{i} s{i} ON s{i}.b = f.b AND s{i}.pos = xor(f.pos >> {i}, 1) AND f.levels > {i}" for i in range(height))
    steps = f"SELECT list_filter([{', '.join(step.format(i) for i in range(height))}], x -> x IS NOT NULL) AS steps FROM nodes f {joins} ORDER BY f.k"
    return levels, roots, steps.replace("x -> x", "lambda x: x")


def bucket_trees(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes`` (g, pos, n, h and others) with ``steps`` and ``top``: what leads from a node to its bucket's root, and that root.

    A step is ``L`` or ``R`` and the sibling on that side, or ``-`` where a node is
    alone. Buckets of groups with more than one all have ``height`` levels; in a
    group of one bucket, levels end where one node remains.
    """
    size = 1 << height
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    levels, roots, steps = _queries(height)

    def solve(t: pa.Table) -> pa.Table:
        import duckdb

        pos, n, g = t.column("pos").to_numpy(), t.column("n").to_numpy(), t.column("g").combine_chunks().dictionary_encode().indices.to_numpy()
        bucket = pos >> height
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (bucket[1:] != bucket[:-1])])
        b = np.cumsum(new) - 1
        most = np.minimum(n, size)
        depth = np.ceil(np.log2(most)).astype(np.int64)
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        con.register("nodes", pa.table({"k": np.arange(len(pos)), "b": b, "pos": pos - (bucket << height), "levels": depth, "h": t.column("h")}))
        for q in levels:
            con.execute(q)
        top = con.execute(roots).to_arrow_table().column("h").combine_chunks().cast(pa.string())
        found = con.execute(steps).to_arrow_table().column("steps").combine_chunks().cast(pa.list_(pa.string()))
        con.close()
        return t.append_column("steps", found).append_column("top", top.take(pa.array(b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("merkle")
        held: pa.Table | None = None
        for x in batches:
            t = pa.Table.from_batches([x])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= ROWS + size:
                pos, g = held.column("pos").slice(0, ROWS + size).to_numpy() >> height, held.column("g").slice(0, ROWS + size).combine_chunks().dictionary_encode().indices.to_numpy()
                cut = 1 + int(np.flatnonzero((pos[1:] != pos[:-1]) | (g[1:] != g[:-1]))[-1])  # a bucket's end
                yield from solve(held.slice(0, cut)).combine_chunks().to_batches()
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from solve(held).combine_chunks().to_batches()

    bucket = F.shiftright("pos", height)
    dealt = nodes.withColumn("_b", bucket).repartition(partitions(nodes.sparkSession), "g", "_b").sortWithinPartitions("g", "pos").drop("_b")
    return dealt.mapInArrow(run, f"{kinds}, steps array<string>, top string")


def trees(nodes: DataFrame, height: int, name: str) -> DataFrame:
    """``nodes`` (g, pos, n, h and others) with ``steps`` to the root of their group's tree and that ``root``."""
    found = materialise(bucket_trees(nodes, height), name)
    most = found.agg(F.max("n")).first()[0] or 0
    if most <= 1 << height:
        return found.withColumnRenamed("top", "root")
    first = found.where(F.col("pos") % (1 << height) == 0)
    tops = first.select("g", F.shiftright("pos", height).alias("pos"), F.shiftright(F.col("n") + ((1 << height) - 1), height).alias("n"), F.col("top").alias("h"))
    upper = trees(tops, height, f"{name}-up").select("g", F.col("pos").alias("_b"), F.col("steps").alias("_more"), "root")
    both = found.withColumn("_b", F.shiftright("pos", height)).join(upper, ["g", "_b"])
    return both.select(*nodes.columns, F.concat("steps", "_more").alias("steps"), "root")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps from it give."""
    other = lambda s: F.substring(s, 2, 64)
    return F.aggregate(steps, leaf, lambda h, s: digest(F.when(s.startswith("L"), F.concat(other(s), h)).when(s.startswith("R"), F.concat(h, other(s))).otherwise(h)))


def siblings_digest(steps: Column) -> Column:
    return digest(F.array_join(F.transform(F.filter(steps, lambda s: s != "-"), lambda s: F.substring(s, 2, 64)), ""))


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """For ``rows`` (g, key, leaf and others) all columns with ``subroot``, ``root`` and ``steps``.

    Leaves of a group ascend by ``key``, nulls first, then by leaf; rows equal in
    both are interchangeable. Groups ascend by ``g``, null first, strings by their
    UTF-8 bytes. While several nodes remain, every two consecutive ones, or a last
    one alone, become their digest. No rows give no rows.
    """
    if height < 1:
        raise ValueError("height must be at least 1")
    others = [c for c in rows.columns if c != "g"]
    own = rows.select(F.coalesce(F.concat(F.lit("1"), F.col("g").cast("string")), F.lit("0")).alias("g"), F.struct(*others).alias("r"), F.col("key"), F.col("leaf").alias("h"), F.monotonically_increasing_id().alias("u"))
    own = materialise(own, "merkle-leaves")
    placed = numbered(own, ["key", "h", "u"], "merkle-order").select("g", "pos", "n", "h", "r")
    inner = trees(placed, height, "merkle-trees").withColumnRenamed("root", "subroot")
    subroots = inner.where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("own"), F.col("subroot").alias("h"))
    outer = trees(numbered(subroots, ["own"], "merkle-groups"), height, "merkle-outer")
    outer = outer.select(F.col("own").alias("g"), F.col("steps").alias("_more"), "root")  # a row for each group
    out = inner.join(outer, "g")
    release(own)
    group = F.when(F.col("g") != "0", F.substring("g", 2, 1 << 30)).cast(rows.schema["g"].dataType)
    return out.select(group.alias("g"), *[F.col("r")[c].alias(c) for c in others], "subroot", "root", F.concat("steps", "_more").alias("steps"))


def document_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    A leaf covers doc_id, source, lang, n_chars and text; groups are langs. Where
    7 divides the CRC-32 of the decimal doc_id, the row that is folded back to the
    root is a tampered one, with 1 added to n_chars (a null stays): it isn't
    verified. Null doc_ids come first and aren't tampered with; rows that repeat a
    doc_id follow one another by leaf. Other columns are ignored.
    """
    c = {x: F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")}
    leaf = digest(*[field(x) for x in c.values()])
    more = c | {"n_chars": c["n_chars"].cast("decimal(38,0)") + 1}
    tampered = F.when((F.crc32(F.encode(c["doc_id"].cast("string"), "UTF-8")) % 7 == 0) & c["n_chars"].isNotNull(), digest(*[field(x) for x in more.values()]))
    rows = docs.select(c["lang"].alias("g"), c["doc_id"].alias("key"), leaf.alias("leaf"), tampered.alias("tampered"))
    found = manifest(rows, height).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("steps")))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
