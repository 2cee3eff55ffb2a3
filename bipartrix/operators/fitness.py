"""Fitness-Complexity: F = M Q, Q = 1 / (M^T 1/F), each scaled to mean 1."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.operators.grid import Program, Scalars, State, solve
from bipartrix.operators.network import binarise, degree_filter
from bipartrix.session import cut_lineage

FLOOR = 1e-12


class Fitness(Program):
    """x is the value before it is divided by its side's mean, prev the one of the turn before, divided."""

    def start(self, side: str, k: np.ndarray, extra: np.ndarray | None, first: int) -> State:
        return {"x": np.ones(len(k)), "prev": np.ones(len(k))}

    def value(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        return state["x"] / scalars.get(side, 1.0)

    def send(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        x = self.value(side, state, scalars)
        return 1 / x if side == "row" else x

    def update(self, side: str, sums: np.ndarray, state: State, scalars: Scalars) -> tuple[State, Scalars]:
        x = np.maximum(sums, FLOOR)
        x = x if side == "row" else 1 / x
        return {"x": x, "prev": self.value(side, state, scalars)}, {"sum": x.sum(), "n": len(x)}

    def gather(self, side: str, stats: Scalars, scalars: Scalars) -> None:
        scalars[side] = stats["sum"] / stats["n"]

    def settle(self, side: str, state: State, scalars: Scalars) -> Scalars:
        return {"max_change": float(np.abs(self.value(side, state, scalars) - state["prev"]).max(initial=0))}

    def changes(self, stats: dict[str, Scalars], scalars: Scalars) -> tuple[float, float]:
        return stats["row"]["max_change"], stats["col"]["max_change"]


def _solved(edges: DataFrame, n_iter: int, tol: float, by: list[str] | None = None, log: bool = False) -> DataFrame:
    if n_iter < 1:
        raise ValueError("n_iter must be at least 1")
    return solve(edges, Fitness, n_iter, tol, by or [], log=log)


def fitness_scores(edges: DataFrame, n_iter: int = 200, tol: float = 1e-10, by: list[str] | None = None) -> DataFrame:
    """(by..., side, id, score, n_iter, converged): fitness of rows, complexity of columns.

    ``by`` names the columns that tell networks apart; all of them are solved side
    by side, and each stops on its own.
    """
    found = _solved(edges, n_iter, tol, by).where("side <> 'log'")
    return found.select(*(by or []), "side", "id", F.col("x")[0].alias("score"), "n_iter", "converged")


def fitness_history(edges: DataFrame, n_iter: int = 200, tol: float = 1e-10) -> DataFrame:
    """(iter, d_row, d_col): the largest change of each turn."""
    log = _solved(edges, n_iter, tol, log=True).where("side = 'log'")
    return log.select(F.col("id").cast("int").alias("iter"), F.col("x")[0].alias("d_row"), F.col("x")[1].alias("d_col"))


@dataclass
class FitnessResult:
    """Scores of all rows and columns, null where the filter dropped them (``kept`` false)."""

    fitness: DataFrame
    complexity: DataFrame
    edges: DataFrame
    n_iter: int
    converged: bool


class FitnessComplexity:
    """Filter weakly connected rows and columns, then iterate.

    min_diversification and min_ubiquity bound the sums of rows and of columns;
    ``iterative_filter`` repeats the filter until it settles.
    """

    def __init__(self, n_iter: int = 200, tol: float = 1e-10, min_ubiquity: float = 3, min_diversification: float = 5, iterative_filter: bool = True):
        if n_iter < 1:
            raise ValueError("n_iter must be at least 1")
        self.n_iter, self.tol = n_iter, tol
        self.min_ubiquity, self.min_diversification, self.iterative_filter = min_ubiquity, min_diversification, iterative_filter

    def fit(self, edges: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> FitnessResult:
        """rows and cols: optional (id) tables of entities that may have no edge.

        The filter and the results read the edges several times: they are written out, not made anew.
        """
        edges = edges if getattr(edges, "_is_cut", False) else cut_lineage(edges)
        kept = edges
        if self.min_ubiquity > 1 or self.min_diversification > 1:
            kept = degree_filter(edges, self.min_diversification, self.min_ubiquity, self.iterative_filter)
        scores = cut_lineage(fitness_scores(kept, self.n_iter, self.tol))
        state = scores.select("n_iter", "converged").first()
        out = []
        for side, ids in (("row", rows or edges.select(F.col("row_id").alias("id"))), ("col", cols or edges.select(F.col("col_id").alias("id")))):
            own = scores.where(F.col("side") == side).select("id", "score")
            out.append(ids.select("id").distinct().join(own, "id", "left").select("id", "score", F.col("score").isNotNull().alias("kept")))
        return FitnessResult(out[0], out[1], kept, state[0] if state else 0, bool(state and state[1]))


def fitness_complexity(edges: DataFrame, n_iter: int = 200, tol: float = 1e-10) -> FitnessResult:
    """The old function: binary edges, no filter."""
    warnings.warn("use FitnessComplexity", DeprecationWarning, stacklevel=2)
    return FitnessComplexity(n_iter, tol, 1, 1).fit(binarise(edges))
