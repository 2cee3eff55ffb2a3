"""Masked Sinkhorn scaling: W = diag(u) K diag(v) with given margins on the support of K."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.operators.grid import Program, Scalars, State, solve
from bipartrix.session import cut_lineage

SCALES = "side string, id string, scale double, target double, n_iter int, converged boolean"

#: Masses by id, as a dict or as a table (id, mass).
Masses = dict[str, float] | DataFrame | None


def _given(ids: DataFrame, masses: dict[str, float] | DataFrame) -> DataFrame:
    table = masses if isinstance(masses, DataFrame) else ids.sparkSession.createDataFrame(list(masses.items()), "id string, mass double")
    return table.groupBy("id").agg(F.sum("mass").alias("m"))


def _targets(ids: DataFrame, masses: Masses, mode: str, side: str) -> DataFrame:
    """(id, t) of ids (id, k): what each id with an edge should hold; masses of other ids are left out with a warning."""
    if masses is None:
        total = F.broadcast(ids.agg(F.sum("k").alias("_s"), F.count(F.lit(1)).alias("_n")))  # one row
        return cut_lineage(ids.join(total).select("id", (1 / F.col("_n") if mode == "uniform" else F.col("k") / F.col("_s")).alias("t")))
    given = cut_lineage(_given(ids, masses))
    there = given.join(ids.select("id", F.lit(1).alias("_e")), "id", "left")
    x = there.agg(F.sum("m"), F.min("m"), F.count_if(F.col("_e").isNull() & (F.col("m") > 0)), F.sum(F.when(F.col("_e") == 1, F.col("m")))).first()
    if (x[0] or 0) <= 0 or x[1] < 0:
        raise ValueError("masses must be non-negative with a positive sum")
    if x[2]:
        warnings.warn(f"{x[2]} ids of the {side}s have mass but no edge; their mass is dropped", UserWarning, stacklevel=4)
    if (x[3] or 0) <= 0:
        raise ValueError("no mass is left on ids with an edge")
    return cut_lineage(ids.join(given, "id", "left").select("id", F.coalesce("m", F.lit(0.0)).alias("t")))


class Sinkhorn(Program):
    """Columns hold v = t / K^T u. Rows hold the turn's u (x), K v (kv), and the u that this gives for the next turn.

    After v's half of a turn, column margins are off by rounding only, and those of
    the rows come with K v, which the next turn needs anyway.
    """

    order, opening = ("col", "row"), ("row",)

    def __init__(self, eps: float):
        self.eps = eps

    def start(self, side: str, k: np.ndarray, extra: np.ndarray | None, first: int) -> State:
        return {"t": np.nan_to_num(extra) if extra is not None else np.zeros(len(k)), "x": np.ones(len(k)), "next": np.ones(len(k))}

    def send(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        return state["next" if side == "row" else "x"]

    def update(self, side: str, sums: np.ndarray, state: State, scalars: Scalars) -> tuple[State, Scalars]:
        x = state["t"] / np.maximum(sums, self.eps)
        own = {"t": state["t"], "x": state["next"], "next": x} if side == "row" else state | {"x": x}
        return own, {"max_error": float(np.abs(own["x"] * sums - own["t"]).max(initial=0))}

    def changes(self, stats: dict[str, Scalars], scalars: Scalars) -> tuple[float, float]:
        return stats["row"]["max_error"], stats["col"]["max_error"]

    def value(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        return state["x"]


class SinkhornScaler:
    """fit() finds the scales, transform() applies them to any edges over the same ids.

    margins: "uniform" or "degree", where no masses are given. Masses of ids
    without an edge can't be placed: they are dropped with a warning, and column
    masses are rescaled to the rows' total. ``history`` has (turn, largest error
    of a row margin, of a column margin) of every turn.
    """

    def __init__(self, n_iter: int = 2000, tol: float = 1e-12, eps: float = 1e-30, margins: str = "uniform"):
        if margins not in ("uniform", "degree"):
            raise ValueError("margins must be uniform or degree")
        if n_iter < 1:
            raise ValueError("n_iter must be at least 1")
        self.n_iter, self.tol, self.eps, self.margins = n_iter, tol, eps, margins
        self.scales: DataFrame | None = None
        self.n_iter_, self.converged, self.history = 0, False, []

    def fit(self, edges: DataFrame, row_mass: Masses = None, col_mass: Masses = None) -> SinkhornScaler:
        """row_mass and col_mass: masses by id, of which those left out are 0."""
        degree = lambda side: edges.groupBy(F.col(side).alias("id")).agg(F.sum("w").alias("k"))
        if edges.isEmpty():
            self.scales = edges.limit(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in SCALES.split(", "))])
            self.n_iter_, self.converged, self.history = 0, False, []
            return self
        r, c = _targets(degree("row_id"), row_mass, self.margins, "row"), _targets(degree("col_id"), col_mass, self.margins, "column")
        total = F.broadcast(r.agg(F.sum("t").alias("_r")).join(c.agg(F.sum("t").alias("_c"))))  # one row
        scaled = c.join(total).select(F.lit("col").alias("side"), "id", (F.col("t") * (F.col("_r") / F.col("_c"))).alias("t"))
        targets = cut_lineage(r.select(F.lit("row").alias("side"), "id", "t").unionByName(scaled))
        eps = self.eps
        found = cut_lineage(solve(edges, lambda: Sinkhorn(eps), self.n_iter, self.tol, extra=targets))
        self.history = sorted((int(x.id), *x.x) for x in found.where("side = 'log'").select("id", "x").collect())  # a row for each turn
        state = found.select("n_iter", "converged").first()
        self.n_iter_, self.converged = state[0], state[1]
        table = found.where("side <> 'log'").select("side", "id", F.col("x")[0].alias("scale"), "n_iter", "converged")
        self.scales = table.join(targets.withColumnRenamed("t", "target"), ["side", "id"]).select("side", "id", "scale", "target", "n_iter", "converged")
        return self

    def transform(self, edges: DataFrame) -> DataFrame:
        """edges with w_scaled = u * w * v."""
        if self.scales is None:
            raise ValueError("fit first")
        u = self.scales.where("side = 'row'").select(F.col("id").alias("row_id"), F.col("scale").alias("_u"))
        v = self.scales.where("side = 'col'").select(F.col("id").alias("col_id"), F.col("scale").alias("_v"))
        return edges.join(u, "row_id").join(v, "col_id").withColumn("w_scaled", F.col("_u") * F.col("w") * F.col("_v")).drop("_u", "_v")

    def fit_transform(self, edges: DataFrame, **masses) -> DataFrame:
        return self.fit(edges, **masses).transform(edges)


def scale_with_fallback(edges: DataFrame, n_iter: int = 2000, tol: float = 1e-12) -> SinkhornScaler:
    """Uniform margins; degree margins if those don't converge."""
    out = SinkhornScaler(n_iter, tol).fit(edges)
    return out if out.converged else SinkhornScaler(n_iter, tol, margins="degree").fit(edges)


def fitness_flow(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """w_scaled = w * Q / F: at a fixed point of Fitness-Complexity, rows sum to a constant and so do columns."""
    f = scores.where("side = 'row'").select(F.col("id").alias("row_id"), F.col("score").alias("_f"))
    q = scores.where("side = 'col'").select(F.col("id").alias("col_id"), F.col("score").alias("_q"))
    return edges.join(f, "row_id").join(q, "col_id").withColumn("w_scaled", F.col("w") * F.col("_q") / F.col("_f")).drop("_f", "_q")
