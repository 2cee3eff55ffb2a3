"""Ranks, comparisons, correlations and the tables behind flow pictures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bipartrix.model import quantiles, row_numbers, sums_before
from bipartrix.operators.network import pearson
from bipartrix.session import cut_lineage


def ranked(scores: DataFrame, score: str = "score", by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based rank by falling score, nulls last, ties by id; within ``by``, or over the whole table by range partitions."""
    if not by:
        return row_numbers(scores, [F.col(score).desc_nulls_last(), F.col("id").asc()], name)
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), "id")
    return scores.withColumn(name, F.row_number().over(w))


def places(scores: DataFrame, score: str = "score", by: list[str] | None = None, name: str = "place") -> DataFrame:
    """0-based rank by falling score: the place of each id in that order."""
    return ranked(scores, score, by, name).withColumn(name, F.col(name) - 1)


def positive_log(df: DataFrame, c: str, name: str, base: float = 10.0) -> DataFrame:
    """Rows whose value has a logarithm, with it: zeros, negative numbers, nulls and NaN go."""
    x = F.col(c)
    return df.where((x > 0) & ~F.isnan(x.cast("double"))).withColumn(name, F.log10(x) if base == 10 else F.log(x) / math.log(base))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a number in all of the columns: no null, NaN or infinity."""
    for c in columns:
        x = F.col(c).cast("double")
        df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df


def on_support(flow: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of a flow (row_id, col_id, ...) where the network has an edge; what rounding left elsewhere goes."""
    return flow.join(edges.where("w <> 0").select("row_id", "col_id").distinct(), ["row_id", "col_id"], "left_semi")


def compared(old: DataFrame, new: DataFrame, score: str = "score", missing_rank: int = 999) -> DataFrame:
    """(id, old_score, new_score, old_rank, new_rank, rank_change, change, change_pct) of two ranked periods, absent ids ranked ``missing_rank``."""
    a = ranked(old, score).select("id", F.col(score).alias("old_score"), F.col("rank").alias("old_rank"))
    b = ranked(new, score).select("id", F.col(score).alias("new_score"), F.col("rank").alias("new_rank"))
    out = a.join(b, "id", "full_outer").withColumns({c: F.coalesce(c, F.lit(missing_rank)) for c in ("old_rank", "new_rank")})
    change = F.col("new_score") - F.col("old_score")
    return out.select("id", "old_score", "new_score", "old_rank", "new_rank", (F.col("old_rank") - F.col("new_rank")).alias("rank_change"), change.alias("change"), F.when(F.col("old_score") != 0, 100 * change / F.col("old_score")).alias("change_pct"))


def average_ranks(df: DataFrame, c: str, name: str) -> DataFrame:
    """df with the rank by rising value of a column, ties sharing their mean rank.

    Values are counted first; the counts before each come from range partitions.
    The table is written out, for ranks find its rows by their values: a sum made
    anew may differ in its last bits.
    """
    df = df if getattr(df, "_is_cut", False) else cut_lineage(df)
    n = df.groupBy(c).agg(F.count(F.lit(1)).alias("_k"))
    ranks = sums_before(n, [F.col(c).asc()], "_k", "_before").select(F.col(c).alias("_v"), (F.col("_before") + (F.col("_k") + 1) / 2).alias(name))
    return df.join(ranks, F.col(c) == F.col("_v")).drop("_v")


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, pearson, spearman of the rows where neither is null; null where a side doesn't vary."""
    both = cut_lineage(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_c")))
    both = average_ranks(average_ranks(both, "_a", "_ra"), "_c", "_rb")
    return both.agg(F.count(F.lit(1)).alias("n"), pearson("_a", "_c").alias("pearson"), pearson("_ra", "_rb").alias("spearman"))


def _pair(a: str, b: str) -> Column:
    """Pearson's correlation of the rows where neither is null."""
    there = F.col(a).isNotNull() & F.col(b).isNotNull()
    return pearson(F.when(there, F.col(a)), F.when(there, F.col(b)))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of the named columns in one pass, nulls left out pairwise."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[_pair(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*cells)))


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p of a Pearson r over n points: the incomplete beta function by its continued fraction."""
    if n < 3 or not abs(r) < 1:
        return 0.0 if abs(r) >= 1 and n > 2 else float("nan")
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = (b, a, 1 - x) if flip else (a, b, x)
    c, d = 1.0, 1 / (1 - (p + q) * z / (p + 1))
    h = d
    for m in range(1, 300):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / (1 + top * d or 1e-300), 1 + top / c or 1e-300
            h *= d * c
    value = front * h / p
    return 1 - value if flip else value


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept of y over x by least squares."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def residuals(df: DataFrame, x: str, y: str) -> DataFrame:
    fit = F.broadcast(line_fit(df, x, y))
    return df.join(fit).withColumn("residual", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")).drop("slope", "intercept")


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """(bin, lo, n) of equal bins from minimum to maximum, the maximum in the last; empty bins are absent."""
    ends = F.broadcast(df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    i = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(c) - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    return df.where(F.col(c).isNotNull()).join(ends).select(i.alias("bin"), (F.col("_lo") + i * width).alias("lo")).groupBy("bin", "lo").agg(F.count(F.lit(1)).alias("n"))


def top_subset(edges: DataFrame, top_rows: int = 20, top_cols: int = 30, by: str = "mass", row_scores: DataFrame | None = None, col_scores: DataFrame | None = None) -> DataFrame:
    """Edges among the leading rows and columns, by mass or by given scores (id, score)."""
    if by == "mass":
        row_scores, col_scores = (edges.groupBy(F.col(k).alias("id")).agg(F.sum("w").alias("score")) for k in ("row_id", "col_id"))
    elif by != "fitness_complexity":
        raise ValueError("by must be mass or fitness_complexity")
    elif row_scores is None or col_scores is None:
        raise ValueError("scores are needed for by='fitness_complexity'")
    lead = lambda s, n, k: s.orderBy(F.col("score").desc_nulls_last(), "id").limit(n).select(F.col("id").alias(k))
    return edges.join(F.broadcast(lead(row_scores, top_rows, "row_id")), "row_id", "left_semi").join(F.broadcast(lead(col_scores, top_cols, "col_id")), "col_id", "left_semi").select("row_id", "col_id", "w")


def top_edges(edges: DataFrame, n: int = 200, min_mass: float = 0.0) -> DataFrame:
    """The heaviest edges, with line widths for a picture: 0.2 + 6 (w / max)^0.75."""
    best = edges.where((F.col("w") > 0) & (F.col("w") >= min_mass)).orderBy(F.desc("w"), "row_id", "col_id").limit(n)
    most = F.broadcast(best.agg(F.max("w").alias("_m")))
    return best.join(most).select("row_id", "col_id", "w", (0.2 + 6 * F.pow(F.col("w") / F.col("_m"), 0.75)).alias("width"))


def circle_positions(ids: DataFrame, start: float, end: float) -> DataFrame:
    """(id, x, y) of ids, in their order, on an arc of the unit circle."""
    n = F.broadcast(ids.agg(F.count(F.lit(1)).alias("_n")))  # one row
    at = F.lit(start) + (F.col("_i") - 0.5) / F.col("_n") * (end - start)
    return row_numbers(ids.select("id"), [F.col("id").asc()], "_i").join(n).select("id", at.alias("_a")).select("id", F.cos("_a").alias("x"), F.sin("_a").alias("y"))


def alluvial_spans(edges: DataFrame, side: str, pad: float = 0.01) -> DataFrame:
    """(id, mass, lo, hi): one side's nodes stacked in [0, 1] by falling mass with padding between; for displayed edges."""
    m = edges.groupBy(F.col(side).alias("id")).agg(F.sum("w").alias("mass"))
    total = F.broadcast(m.agg(F.sum("mass").alias("_t"), F.count(F.lit(1)).alias("_n")))
    # A node takes its share and the padding after it.
    each = m.join(total).withColumn("_x", F.col("mass") / F.col("_t") + pad)
    each = sums_before(each, [F.desc("mass"), F.col("id").asc()], "_x", "_lo")
    scale = 1 + pad * (F.col("_n") - 1)
    return each.select("id", "mass", (F.col("_lo") / scale).alias("lo"), ((F.col("_lo") + F.col("mass") / F.col("_t")) / scale).alias("hi"))


def alluvial_bands(edges: DataFrame, pad: float = 0.01) -> DataFrame:
    """(row_id, col_id, w, row_lo, row_hi, col_lo, col_hi): where each displayed edge leaves its row's span and enters its column's.

    Within a node, edges follow each other by falling weight (ties by the other
    end), each as thick as its share of the node's mass.
    """
    out = edges.select("row_id", "col_id", "w")
    for side, other, name in (("row_id", "col_id", "row"), ("col_id", "row_id", "col")):
        span = alluvial_spans(edges, side, pad).select(F.col("id").alias(side), "mass", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        w = Window.partitionBy(side).orderBy(F.desc("w"), other).rowsBetween(Window.unboundedPreceding, -1)
        part = (F.col("_hi") - F.col("_lo")) / F.col("mass")
        before = F.coalesce(F.sum("w").over(w), F.lit(0.0))
        out = out.join(span, side).withColumn(f"{name}_lo", F.col("_lo") + before * part).withColumn(f"{name}_hi", F.col(f"{name}_lo") + F.col("w") * part).drop("mass", "_lo", "_hi")
    return out.select("row_id", "col_id", "w", "row_lo", "row_hi", "col_lo", "col_hi")


def circular_flow(edges: DataFrame, n: int = 200, min_mass: float = 0.0) -> DataFrame:
    """(row_id, col_id, w, width, row_x, row_y, col_x, col_y): the heaviest edges, rows on the right half circle, columns on the left."""
    best = top_edges(edges, n, min_mass)
    at = []
    for side, name, start in (("row_id", "row", -math.pi / 2), ("col_id", "col", math.pi / 2)):
        ids = best.select(F.col(side).alias("id")).distinct()
        at.append(circle_positions(ids, start, start + math.pi).toDF(side, f"{name}_x", f"{name}_y"))
    return best.join(at[0], "row_id").join(at[1], "col_id")


def sorted_by_scores(edges: DataFrame, row_scores: DataFrame, col_scores: DataFrame) -> DataFrame:
    """(row_pos, col_pos, row_id, col_id, w): the matrix with both axes by falling score (id, score), positions from 0."""
    pos = lambda s, side, name: row_numbers(s.select("id", "score"), [F.col("score").desc_nulls_last(), F.col("id").asc()], name, 0).select(F.col("id").alias(side), name)
    return edges.join(pos(row_scores, "row_id", "row_pos"), "row_id").join(pos(col_scores, "col_id", "col_pos"), "col_id").select("row_pos", "col_pos", "row_id", "col_id", "w")


def cluster_purity(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n, clusters, purity. Of each cluster (id, label), the share of its most frequent class (id, class), weighed by size."""
    each = labels.join(truth, "id").groupBy("label", "class").agg(F.count(F.lit(1)).alias("k"))
    per = each.groupBy("label").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    return per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"), F.try_divide(F.sum("most"), F.sum("n")).alias("purity"))


def dual_potentials(scales: DataFrame) -> DataFrame:
    """(side, id, potential = ln(scale + 1e-30), pos): order of the potentials on each side."""
    phi = F.log(F.col("scale") + 1e-30)
    each = scales.select("side", "id", phi.alias("potential"))
    sides = [row_numbers(each.where(F.col("side") == s), [F.desc("potential"), F.col("id").asc()], "pos") for s in ("row", "col")]
    return sides[0].unionByName(sides[1])


def ranked_barcodes(scores: DataFrame, margins: DataFrame, n: int = 30) -> DataFrame:
    """(pos, id, score, degree) of the leading scores."""
    best = scores.where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(n)
    return ranked(best, name="pos").join(margins.select("id", "degree"), "id", "left").select("pos", "id", "score", "degree")


def community_stats(labels: DataFrame, scores: DataFrame, margins: DataFrame, top: int = 3) -> DataFrame:
    """(community, n, share, mean_degree, mean_score, leaders): leaders are the ids of the best scores, in order."""
    own = labels.join(scores.select(F.col("id").alias("row_id"), "score"), "row_id", "left").join(margins.select(F.col("id").alias("row_id"), "degree"), "row_id", "left")
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.col("score").desc_nulls_last(), "row_id"))
    best = F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", "row_id"))))
    out = own.withColumn("_r", place).groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.avg("degree").alias("mean_degree"), F.avg("score").alias("mean_score"), best.alias("_b"))
    total = F.broadcast(out.agg(F.sum("n").alias("_t")))
    return out.join(total).select("community", "n", (F.col("n") / F.col("_t")).alias("share"), "mean_degree", "mean_score", F.array_join(F.transform("_b", lambda x: x["row_id"]), ",").alias("leaders"))


def collapse_check(scores: DataFrame, limit: float = 100.0) -> DataFrame:
    """One row: largest and median score, their ratio, and whether the ratio says that few rows hold everything."""
    own = scores.where("score IS NOT NULL")
    s = own.agg(F.max("score").alias("most"), F.avg((F.col("score") > 1e-10).cast("double")).alias("positive_share")).join(F.broadcast(quantiles(own, "score", [0.5], ["median"])))  # one row each
    ratio = F.when(F.col("median") > 0, F.col("most") / F.col("median"))
    return s.select("most", "median", "positive_share", ratio.alias("ratio"), (F.coalesce(ratio, F.lit(float("inf"))) > limit).alias("collapsed"))


def low_degree(margins: DataFrame, ids: DataFrame, below: int = 10) -> DataFrame:
    """(id, degree) of the entities of ``ids`` with fewer edges than ``below``, those without any included."""
    return ids.select("id").distinct().join(margins, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")).where(F.col("degree") < below)


def describe(df: DataFrame, c: str, shares: dict[str, float]) -> DataFrame:
    """One row: n, mean, sd (of a sample), least, the quantiles named by ``shares``, most of a number."""
    x = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("least"), F.max(c).alias("most"))
    return x.join(F.broadcast(quantiles(df, c, [*shares.values()], [*shares]))).select("n", "mean", "sd", "least", *shares, "most")
