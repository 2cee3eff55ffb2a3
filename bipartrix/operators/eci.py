"""Economic complexity: ECI/PCI by spectral solution and by reflections, and spectral diagnostics.

With B = D_r^-1/2 M D_c^-1/2, the walk's second eigenvector is D_r^-1/2 times
B's second left singular vector, and its eigenvalues are B's squared singular
values, which spectra.py finds. B is never made dense nor multiplied out.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.operators.grid import Program, Scalars, State, solve
from bipartrix.operators.network import pearson
from bipartrix.operators.spectra import MOST_TURNS, MOST_VECTORS, SETTLED, Subspace, spectrum, traces, width_for
from bipartrix.session import cut_lineage


def eci_scores(edges: DataFrame, by: list[str] | None = None, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """(by..., side, id, score, lambda2, degenerate): ECI of rows and PCI of columns, each with mean 0 and deviation 1.

    The sign makes ECI go with the rows' degrees. ``degenerate``: the second
    eigenvalue is 1 or the third one, so that its vector isn't unique. rows and
    cols: optional (id) tables of entities that may have no edge; those have a
    null score, of which a warning tells. With ``by``, networks are solved side by
    side; those with under two rows or columns have no score and no row.
    """
    if not by:
        edges = cut_lineage(edges.select("row_id", "col_id", "w"))
        n, m = edges.agg(F.countDistinct("row_id"), F.countDistinct("col_id")).first()
        if min(n, m) < 2:
            raise ValueError("Not enough dimensions")
        return _with_lone(_standardised(_leading_vectors(edges, [], min(n, m)), []), edges, rows, cols, "ECI")
    sizes = edges.groupBy(*by).agg(F.countDistinct("row_id").alias("_n"), F.countDistinct("col_id").alias("_m")).where("_n > 1 AND _m > 1")
    many = sizes.select(*[F.col(c).alias(f"_{c}") for c in by])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return _standardised(_leading_vectors(edges.join(many, same, "left_semi"), by, None), by)


def _leading_vectors(edges: DataFrame, by: list[str], ids: int | None) -> DataFrame:
    """(by..., RESULT) with the three leading vectors; ids: those of the smaller side, where it is known."""
    width = width_for(3, ids) if ids else 64
    return cut_lineage(solve(edges, lambda: Subspace(3, width), MOST_TURNS, SETTLED, by).where("side <> 'log'"))


def _standardised(found: DataFrame, by: list[str]) -> DataFrame:
    second = lambda i: F.coalesce(F.get("notes", F.lit(i)), F.lit(0.0))
    degenerate = (1 - second(1) < 1e-6) | (F.abs(second(1) - second(2)) < 1e-9)
    x = found.select(*by, "side", "id", "k", (F.get("x", F.lit(1)) / F.sqrt("k")).alias("x"), second(1).alias("lambda2"), degenerate.alias("degenerate"))
    stats = x.groupBy(*by, "side").agg(F.avg("x").alias("_a"), F.stddev_pop("x").alias("_s"), pearson("x", "k").alias("_c"))
    # Both vectors of a pair turn together.
    sign = stats.where("side = 'row'").select(*[F.col(c).alias(f"_{c}") for c in by], F.when(F.col("_c") < 0, -1.0).otherwise(1.0).alias("_sign"))
    stats = stats.join(sign, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or None).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("side").alias("_side"), "_a", "_s", "_sign")
    both = x.join(stats, [F.col("side") == F.col("_side"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]])
    return both.select(*by, "side", "id", (F.col("_sign") * (F.col("x") - F.col("_a")) / (F.col("_s") + 1e-12)).alias("score"), "lambda2", "degenerate")


def _with_lone(scores: DataFrame, edges: DataFrame, rows: DataFrame | None, cols: DataFrame | None, what: str) -> DataFrame:
    """The scores, and null ones for ids of ``rows`` and ``cols`` that have no edge."""
    out = scores
    for ids, name, side in ((rows, "row", "row_id"), (cols, "col", "col_id")):
        if ids is None:
            continue
        lone = cut_lineage(ids.select("id").distinct().join(edges.select(F.col(side).alias("id")).distinct(), "id", "left_anti"))
        if n := lone.count():
            warnings.warn(f"{what}: {n} ids without an edge ({side}) have no score", UserWarning, stacklevel=3)
            rest = {c: F.lit(None).cast(scores.schema[c].dataType) for c in scores.columns} | {"side": F.lit(name), "id": F.col("id")}
            out = out.unionByName(lone.select(*[x.alias(c) for c, x in rest.items()]))
    return out


class Reflections(Program):
    """k_row from k_col, and then k_col from the new k_row; prev is the one of the turn before."""

    def start(self, side: str, k: np.ndarray, extra: np.ndarray | None, first: int) -> State:
        return {"k": k, "x": np.ones(len(k)) if side == "row" else k}

    def send(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        return state["x"]

    def update(self, side: str, sums: np.ndarray, state: State, scalars: Scalars) -> tuple[State, Scalars]:
        x = sums / state["k"]
        return state | {"x": x}, {"moved": float(((x - state["x"]) ** 2).sum()), "length": float((x * x).sum())}

    def changes(self, stats: dict[str, Scalars], scalars: Scalars) -> tuple[float, float]:
        return tuple(math.sqrt(stats[s]["moved"]) / (math.sqrt(stats[s]["length"]) + 1e-12) for s in ("row", "col"))

    def value(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        return state["x"]


def reflections(edges: DataFrame, n_iter: int = 200, tol: float | None = 1e-6, check_gap: bool = True, rows: DataFrame | None = None, cols: DataFrame | None = None, history: list | None = None) -> DataFrame:
    """(side, id, k_n, score, n_iter, converged): Method of Reflections, k_row from k_col and then k_col from the new k_row.

    score is k_n with mean 0 and deviation 1, turned so that the rows' goes with
    their degrees. The vectors tend to constants, their direction only slowly to
    ECI, so eci_scores() is the solver to use. A null ``tol`` runs all turns.
    With ``check_gap`` a degenerate spectrum is an error, and one that needs more
    turns than n_iter a warning, as are turns that ran out. ``history`` gets
    (turn, relative change of rows, of columns). Ids of ``rows`` and ``cols``
    without an edge have nulls.
    """
    if n_iter < 1:
        raise ValueError("n_iter must be at least 1")
    if check_gap:
        a, b = _leading(edges)
        if a - b < 1e-6:
            raise ValueError(f"the gap of the leading eigenvalues is {a - b:.2e}: reflections are undefined, use eci_scores()")
        if (need := _turns(b / a, 0.01)) > n_iter:
            warnings.warn(f"the gap of the leading eigenvalues is {a - b:.4f}: about {need:.0f} turns are needed, {n_iter} are allowed", RuntimeWarning, stacklevel=2)
    found = cut_lineage(solve(edges, Reflections, n_iter, tol))
    log = sorted((int(r.id), *r.x) for r in found.where("side = 'log'").select("id", "x").collect())  # a row for each turn
    if history is not None:
        history += log
    if tol and log and max(log[-1][1:]) >= tol:
        warnings.warn(f"reflections did not settle in {n_iter} turns; last changes {log[-1][1]:.2e} and {log[-1][2]:.2e}", RuntimeWarning, stacklevel=2)
    table = found.where("side <> 'log'").select("side", "id", F.col("x")[0].alias("k_n"), "n_iter", "converged")
    degree = edges.groupBy(F.col("row_id").alias("id")).agg(F.sum("w").alias("k"))
    corr = table.where("side = 'row'").join(degree, "id").agg(F.when(pearson("k_n", "k") < 0, -1.0).otherwise(1.0).alias("_sign"))
    stats = table.groupBy("side").agg(F.avg("k_n").alias("_a"), F.stddev_pop("k_n").alias("_s"))
    score = F.col("_sign") * (F.col("k_n") - F.col("_a")) / (F.col("_s") + 1e-12)
    scored = table.join(F.broadcast(stats), "side").join(F.broadcast(corr)).select("side", "id", "k_n", score.alias("score"), "n_iter", "converged")
    return _with_lone(scored, edges, rows, cols, "Reflections")


def eigenvalues(edges: DataFrame, n: int = 15, by: list[str] | None = None) -> DataFrame:
    """(by..., idx, eigenvalue) of the row walk, largest first."""
    if not by:
        return edges.sparkSession.createDataFrame(list(enumerate(spectrum(edges, n).eigenvalues)), "idx int, eigenvalue double")  # n rows

    found = solve(edges, lambda: Subspace(n, max(64, 2 * n)), MOST_TURNS, SETTLED, by).where("side = 'log' AND id = '1'")
    return found.select(*by, F.posexplode("notes").alias("idx", "eigenvalue"))


def _turns(ratio: float, left: float) -> float:
    return float(int(math.log(left) / math.log(ratio))) if 0 < ratio < 0.999 else math.inf


def _leading(edges: DataFrame) -> tuple[float, float]:
    a, b = [*spectrum(edges, 2).eigenvalues, 0.0, 0.0][:2]
    return a, b


GAP = ["eigenvalue_0", "eigenvalue_1", "eigengap", "ratio", "iterations_99pct", "iterations_999pct", "is_degenerate"]


def eigengap(edges: DataFrame) -> DataFrame:
    """One row: the two leading eigenvalues, their gap and ratio, reflections to 99 and 99.9 per cent, degenerate."""
    a, b = _leading(edges)
    r = b / a if a else 0.0
    kinds = ", ".join(f"{c} {'boolean' if c == 'is_degenerate' else 'double'}" for c in GAP)
    return edges.sparkSession.createDataFrame([(a, b, a - b, r, _turns(r, 0.01), _turns(r, 0.001), a - b < 1e-6)], kinds)


def spectrum_report(edges: DataFrame, n: int = 15, share: float = 0.2) -> DataFrame:
    """(idx, eigenvalue, over_second, significant, lambda2_over_lambda3, n_significant): which eigenvalues exceed ``share`` of the second."""
    from pyspark.sql import Window

    ev = eigenvalues(edges, n)  # n rows
    every = Window.partitionBy(F.lit(1).cast("int"))
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col("eigenvalue"))).over(every)
    big = F.col("eigenvalue") > share * F.coalesce(at(1), F.lit(0.0))
    out = ev.select("idx", "eigenvalue", (F.col("eigenvalue") / at(1)).alias("over_second"), big.alias("significant"), (at(1) / at(2)).alias("lambda2_over_lambda3"))
    return out.withColumn("n_significant", F.sum(F.col("significant").cast("int")).over(every).cast("int"))


def laplacian_gap(edges: DataFrame, n: int = 10) -> DataFrame:
    """One row of gap measures over Laplacian eigenvalues l = 1 - lambda: that of the third over the second, absolute and relative."""
    lam = spectrum(edges, n).eigenvalues
    if len(lam) < 3:
        raise ValueError("three eigenvalues are needed")
    low = [1 - x for x in lam]
    gaps = [y - x for x, y in zip(low[1:5], low[2:5], strict=False)]
    gap = low[2] - low[1]
    row = (low[1], low[2], gap, low[2] / (low[1] + 1e-10), gap / (low[1] + 1e-10), gap / (max(low) - min(low) + 1e-10), gap / (sum(gaps) / len(gaps) + 1e-10))
    return edges.sparkSession.createDataFrame([row], "lambda2_l double, lambda3_l double, absolute_gap double, ratio double, relative_gap double, gap_over_range double, gap_over_average double")


def principled_diagnosis(edges: DataFrame, persistent: float = 0.8, one_dimensional: float = 0.3) -> DataFrame:
    """One row: leading eigenvalues and whether one persistent mode rules, with the two plainer rules beside it.

    ``diagnosis`` asks for both lambda2 > persistent and lambda2 - lambda3 >
    one_dimensional; ``by_gap`` for a gap over 0.1 and ``by_persistence`` for
    lambda2 over 0.8 alone.
    """
    a, b, c = [*spectrum(edges, 3).eigenvalues, 0.0, 0.0, 0.0][:3]
    name = lambda nested: "1D nested hierarchy" if nested else "Multi-dimensional structure"
    row = (a, b, c, 1 - b, b - c, 1 - b, b > persistent, b - c > one_dimensional, name(b > persistent and b - c > one_dimensional), name(b - c > 0.1), name(b > 0.8))
    kinds = "lambda1 double, lambda2 double, lambda3 double, lambda2_l double, eigengap double, spectral_gap double, is_persistent boolean, is_1d boolean, diagnosis string, by_gap string, by_persistence string"
    return edges.sparkSession.createDataFrame([row], kinds)


def both_sides(edges: DataFrame, n: int = 10) -> DataFrame:
    """(side, idx, eigenvalue, gap_ratio): leading eigenvalues of the walks over rows and over columns, which share all that aren't nought.

    A side has one value less than ids at most. gap_ratio is (1 - lambda3) /
    (1 - lambda2 + 1e-10), 0 with fewer than three values.
    """
    sizes = {"row": edges.select("row_id").distinct().count(), "col": edges.select("col_id").distinct().count()}
    lam = spectrum(edges, n).eigenvalues
    out = []
    for side, size in sizes.items():
        own = [*lam, *[0.0] * n][: min(n, size - 1)] if size > 2 else [1.0, 0.0]
        ratio = (1 - own[2]) / (1 - own[1] + 1e-10) if len(own) > 2 else 0.0
        out += [(side, i, float(x), float(ratio)) for i, x in enumerate(own)]
    return edges.sparkSession.createDataFrame(out, "side string, idx int, eigenvalue double, gap_ratio double")


def gap_measures(edges: DataFrame) -> DataFrame:
    """(idx, eigenvalue, gap, gap_ratio, relative_gap, gap_over_range, gap_over_average) to each next eigenvalue."""
    from pyspark.sql import Window

    ev = eigenvalues(edges, 15)  # 15 rows
    w = Window.orderBy("idx")
    g = ev.withColumn("next", F.lead("eigenvalue").over(w)).where("next IS NOT NULL").withColumn("gap", F.col("eigenvalue") - F.col("next"))
    every = Window.partitionBy(F.lit(1).cast("int"))
    return g.select("idx", "eigenvalue", "gap", (F.col("eigenvalue") / (F.col("next") + 1e-10)).alias("gap_ratio"), (F.col("gap") / (F.col("eigenvalue") + 1e-10)).alias("relative_gap"), (F.col("gap") / (F.max("eigenvalue").over(every) - F.min("next").over(every) + 1e-10)).alias("gap_over_range"), (F.col("gap") / (F.avg("gap").over(every) + 1e-10)).alias("gap_over_average"))


def cheeger_diagnosis(edges: DataFrame) -> DataFrame:
    """One row: lambda2, lambda3, spectral gap ratio (1 - l3) / (1 - l2), and what they say of the network's shape."""
    ev = eigenvalues(edges, 3)
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col("eigenvalue")))
    l2, l3 = F.coalesce(F.col("lambda2"), F.lit(0.0)), F.coalesce(F.col("lambda3"), F.lit(0.0))
    shape = F.when((l2 > 0.8) & (l2 - l3 > 0.3), "one-dimensional nested").when(l2 > 0.8, "communities").when(l2 - l3 > 0.1, "weak gradient").otherwise("no structure")
    return ev.agg(at(1).alias("lambda2"), at(2).alias("lambda3")).select("lambda2", "lambda3", ((1 - l3) / (1 - l2 + 1e-10)).alias("gap_ratio"), shape.alias("diagnosis"))


def effective_rank(edges: DataFrame, t_max: int = 10) -> DataFrame:
    """(t, rank): exp of the entropy of p_i ~ exp(-(1 - lambda_i) t), t from 0 to t_max, over the smaller side's eigenvalues, up to MOST_VECTORS ids of it."""
    ev = eigenvalues(edges, MOST_VECTORS).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(t_max))))
    z = ev.withColumn("e", F.exp(-(1 - F.col("eigenvalue")) * F.col("t"))).groupBy("t").agg(F.sum("e").alias("z"), F.sum(F.col("e") * F.log("e")).alias("s"))
    return z.select("t", F.exp(F.log("z") - F.col("s") / F.col("z")).alias("rank"))


def heat_traces(edges: DataFrame, t_max: int = 10, probes: int = 32, steps: int = 30) -> DataFrame:
    """(t, trace, error, rank): the sum of exp(-(1 - lambda_i) t) over the smaller side's eigenvalues, the standard error of that estimate, and the effective rank.

    For any number of ids: from random probes, without any eigenvalue.
    """
    heat = [(lambda x, t=t: np.exp(-(1 - x) * t)) for t in range(t_max + 1)]
    own = [(lambda x, t=t: -(1 - x) * t * np.exp(-(1 - x) * t)) for t in range(t_max + 1)]
    found = traces(edges, heat + own, probes, steps)
    rows = [(t, z, e, float(np.exp(np.log(z) - s / z)) if z > 0 else None) for t, ((z, e), (s, _)) in enumerate(zip(found[: t_max + 1], found[t_max + 1 :], strict=True))]
    return edges.sparkSession.createDataFrame(rows, "t int, trace double, error double, rank double")
