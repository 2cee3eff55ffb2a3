"""Revealed comparative advantage, margins and connectivity filters over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.model import row_numbers
from bipartrix.session import cut_lineage


def rca(facts: DataFrame, row: str = "row_id", col: str = "col_id", value: str = "w") -> DataFrame:
    """facts with ``rca`` = (value / row total) / (column total / grand total).

    Margins are aggregated, then joined; they are far smaller than the facts,
    and a row that holds a third of all facts still spreads over tasks.
    """
    rows = facts.groupBy(row).agg(F.sum(value).alias("_row"))
    cols = facts.groupBy(col).agg(F.sum(value).alias("_col"))
    total = F.broadcast(rows.agg(F.sum("_row").alias("_all")))  # one row
    joined = facts.join(rows, row).join(cols, col).join(total)
    return joined.withColumn("rca", (F.col(value) / F.col("_row")) / (F.col("_col") / F.col("_all"))).drop("_row", "_col", "_all")


def rca_edges(facts: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Binary edges where RCA reaches the threshold (inclusive)."""
    return rca(facts).where(F.col("rca") >= threshold).select("row_id", "col_id", F.lit(1.0).alias("w"))


def pearson(x: str | F.Column, y: str | F.Column) -> F.Column:
    """Pearson's correlation as an aggregate; null where one side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def binarise(edges: DataFrame) -> DataFrame:
    return edges.where("w <> 0").select("row_id", "col_id", F.lit(1.0).alias("w"))


def margin(edges: DataFrame, side: str) -> DataFrame:
    """(id, degree: number of edges, strength: sum of weights) of one side, ``row_id`` or ``col_id``."""
    return edges.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def density(edges: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, nnz, density."""
    out = edges.agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct("col_id").alias("n_cols"), F.count(F.lit(1)).alias("nnz"))
    return out.withColumn("density", F.col("nnz") / (F.col("n_rows") * F.col("n_cols")))


def _keep(edges: DataFrame, base: DataFrame, side: str, least: float) -> DataFrame:
    good = base.groupBy(side).agg(F.sum("w").alias("_s")).where(F.col("_s") >= least).select(side)
    return edges.join(good, side, "left_semi")


def mass_filter(edges: DataFrame, min_row: float, min_col: float) -> DataFrame:
    """Rows and columns with enough mass, both measured before either is cut."""
    return _keep(_keep(edges, edges, "row_id", min_row), edges, "col_id", min_col).select("row_id", "col_id", "w")


def degree_filter(edges: DataFrame, min_row: float, min_col: float, iterative: bool = True, max_rounds: int = 100) -> DataFrame:
    """Rows first, then columns of what is left; with ``iterative`` until nothing more goes."""
    size = None
    for _ in range(max_rounds + 1):
        rows = _keep(edges, edges, "row_id", min_row)
        edges = _keep(rows, rows, "col_id", min_col).select("row_id", "col_id", "w")
        if not iterative:
            return edges
        edges = cut_lineage(edges)
        now = edges.count()
        if now == size or not now:
            return edges
        size = now
    raise RuntimeError(f"the filter did not settle in {max_rounds} rounds")


def unique_cols(edges: DataFrame) -> DataFrame:
    """Columns that only one row has, with that row."""
    single = edges.groupBy("col_id").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("col_id")
    return edges.join(single, "col_id", "left_semi").select("row_id", "col_id")


def projection(edges: DataFrame) -> DataFrame:
    """Row-row transition (r1, r2, t) = sum over columns of w1 * w2 / (k_row(r1) * k_col).

    A self-join on columns: its size is the sum of squared column degrees, which
    is the size of the result asked for. The solvers never form it.
    """
    k_row = edges.groupBy("row_id").agg(F.sum("w").alias("kr"))
    k_col = edges.groupBy("col_id").agg(F.sum("w").alias("kc"))
    a = edges.join(k_row, "row_id").join(k_col, "col_id").select("col_id", F.col("row_id").alias("r1"), (F.col("w") / F.col("kr") / F.col("kc")).alias("x"))
    b = edges.select("col_id", F.col("row_id").alias("r2"), F.col("w").alias("y"))
    return a.join(b, "col_id").groupBy("r1", "r2").agg(F.sum(F.col("x") * F.col("y")).alias("t"))


def nestedness(edges: DataFrame) -> DataFrame:
    """One row: ones, violations, nestedness = 1 - violations / (ones * n_rows).

    A violation is a zero below a one, in a matrix whose rows and columns are
    sorted by falling degree (ties by id): rows after the one's that lack it. Of
    the n - pos rows after a row's place, a column's ones see k (k - 1) / 2 ones
    below them altogether, so that degrees of rows and columns are all it takes.
    """
    k = margin(edges, "row_id")
    order = row_numbers(k.select("id", "degree"), [F.desc("degree"), F.col("id").asc()], "pos")
    n = F.broadcast(k.agg(F.count(F.lit(1)).alias("n")))
    below = order.join(n).agg(F.sum(F.col("degree") * (F.col("n") - F.col("pos"))).alias("below"), F.sum("degree").alias("ones"), F.first("n").alias("_n"))
    c = F.col("degree")
    both = margin(edges, "col_id").agg(F.sum((c * (c - 1) / 2).cast("long")).alias("both"))
    out = below.join(both).withColumn("violations", F.col("below") - F.col("both"))
    return out.select("ones", "violations", (1 - F.col("violations") / (F.col("ones") * F.col("_n"))).alias("nestedness"))


def shared_product_ratio(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """One row: columns that rows of both sides have, over the smaller side's volume. sides: (row_id, side boolean)."""
    per = edges.join(sides, "row_id").groupBy("col_id").agg(F.bool_or("side").alias("a"), F.bool_or(~F.col("side")).alias("b"), F.sum(F.when(F.col("side"), F.col("w"))).alias("va"), F.sum(F.when(~F.col("side"), F.col("w"))).alias("vb"))
    out = per.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.coalesce(F.sum("va"), F.lit(0.0)).alias("va"), F.coalesce(F.sum("vb"), F.lit(0.0)).alias("vb"))
    return out.select("shared", F.least("va", "vb").alias("volume"), F.when(F.least("va", "vb") > 0, F.col("shared") / F.least("va", "vb")).alias("ratio"))


def conductance(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, cut, volume, conductance, lower_bound) of the row-row projection w' = M D_col^-1 M^T.

    labels: (row_id, community). Rows without a label count as outside. Sums run
    over columns, so the projection isn't formed: a column with mass m_c in
    community c and m in all adds m_c * (m - m_c) / m to the cut.
    """
    part = edges.join(labels, "row_id", "left").groupBy("col_id", "community").agg(F.sum("w").alias("m_c"))
    whole = edges.groupBy("col_id").agg(F.sum("w").alias("m"))
    per = part.join(whole, "col_id").where("community IS NOT NULL")
    sums = per.groupBy("community").agg(F.sum(F.col("m_c") * (F.col("m") - F.col("m_c")) / F.col("m")).alias("cut"), F.sum("m_c").alias("volume"))
    total = F.broadcast(whole.agg(F.sum("m").alias("_all")))
    out = sums.join(total).withColumn("conductance", F.col("cut") / F.least(F.col("volume"), F.col("_all") - F.col("volume")))
    return out.select("community", "cut", "volume", "conductance", (F.col("conductance") * F.col("conductance") / 2).alias("lower_bound"))


def community_network(edges: DataFrame, labels: DataFrame, min_rows: int = 3, min_edges: int = 10) -> DataFrame:
    """Edges with their row's community, communities with too few rows or edges left out."""
    own = edges.join(labels, "row_id")
    good = own.groupBy("community").agg(F.countDistinct("row_id").alias("_r"), F.count(F.lit(1)).alias("_e")).where((F.col("_r") >= min_rows) & (F.col("_e") >= min_edges)).select("community")
    return own.join(good, "community", "left_semi").select("community", "row_id", "col_id", "w")
