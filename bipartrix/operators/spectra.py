"""Leading singular triplets of B = D_r^-1/2 M D_c^-1/2 by block subspace iteration.

Vectors of the columns' side are iterated together, V to B^T B V, and a small
eigenproblem over their Gram matrices (Rayleigh-Ritz) turns them into estimates
of the leading ones. A few more vectors than asked for are carried along, so that
those that are asked for settle fast, also where eigenvalues are equal; where
there are no more ids than vectors, one turn is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.model import transposed
from bipartrix.operators.grid import Program, Scalars, State, solve
from bipartrix.session import cut_lineage

#: Vectors that can be iterated together: the driver solves an eigenproblem of that size (32 MB).
MOST_VECTORS = 2000
#: Turns after which vectors that haven't settled are given as they are, with a warning.
MOST_TURNS = 500
SETTLED = 1e-12
#: Of the largest eigenvalue; below it a direction is taken for one of the null space.
NOUGHT = 1e-13


class Subspace(Program):
    """Columns hold v (n x width), their image w = B^T B v; rows hold u = B v."""

    def __init__(self, k: int, width: int, seed: int = 1):
        self.k, self.width, self.seed = k, width, seed

    def start(self, side: str, k: np.ndarray, extra: np.ndarray | None, first: int) -> State:
        out = {"root": np.sqrt(k), "v": np.zeros((len(k), 0)), "w": np.zeros((len(k), 0))}
        if side == "col":
            out["w"] = np.random.default_rng([self.seed, first]).standard_normal((len(k), self.width))
            out["w"][:, 0] = out["root"]  # the leading one is known
        return out

    def send(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        x = state["v"] if side == "row" else state["w"] @ scalars["turn"] if "turn" in scalars else state["w"]
        return x / state["root"][:, None]

    def update(self, side: str, sums: np.ndarray, state: State, scalars: Scalars) -> tuple[State, Scalars]:
        w = sums / state["root"][:, None]
        if side == "row":
            return state | {"v": w}, {}
        v = state["w"] @ scalars["turn"] if "turn" in scalars else state["w"]
        moved = np.zeros(0)
        if "ritz" in scalars:  # the estimates of the turn before, against what a step makes of them
            moved = ((v - state["v"] @ scalars["ritz"]) ** 2).sum(0)
        return state | {"v": v, "w": w}, {"vv": v.T @ v, "vw": v.T @ w, "moved": moved}

    def gather(self, side: str, stats: Scalars, scalars: Scalars) -> None:
        if side == "row":
            return
        before = scalars.get("lambda")
        scale = 1 / np.sqrt(np.maximum(np.diag(stats["vv"]), 1e-300))
        vv, vw = (stats[x] * np.outer(scale, scale) for x in ("vv", "vw"))
        d, q = np.linalg.eigh((vv + vv.T) / 2)
        own = d > 1e-14 * d[-1]  # directions that are there
        t = scale[:, None] * q[:, own] / np.sqrt(d[own])
        h = (q[:, own] / np.sqrt(d[own])).T @ vw @ (q[:, own] / np.sqrt(d[own]))
        lam, s = np.linalg.eigh((h + h.T) / 2)
        lam, s = lam[::-1], s[:, ::-1]
        good = lam > NOUGHT * max(lam[0], 0)
        scalars["left"] = float(np.max(before[: self.k] * np.sqrt(stats["moved"][: self.k]), initial=0)) if before is not None else np.inf
        scalars["lambda"], scalars["ritz"] = lam[good], t @ s[:, good]
        scalars["turn"] = scalars["ritz"] / lam[good]

    def changes(self, stats: dict[str, Scalars], scalars: Scalars) -> tuple[float, float]:
        return scalars["left"], scalars["left"]

    def value(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        x = state["v"] @ scalars["ritz"][:, : self.k]
        return x / np.sqrt(scalars["lambda"][: self.k]) if side == "row" else x

    def notes(self, scalars: Scalars) -> list[float]:
        return [float(x) for x in scalars["lambda"][: self.k]]


def width_for(k: int, ids: int) -> int:
    """Vectors to iterate for k that are asked for, of a side with so many ids."""
    return min(ids, 64 if ids <= 64 else max(2 * k, k + 20))


@dataclass
class Spectrum:
    """Eigenvalues of the row walk, largest first, and B's singular vectors (id, k, vector) of either side; k is the id's degree."""

    eigenvalues: list[float]
    rows: DataFrame | None
    cols: DataFrame | None
    settled: bool = True


def spectrum(edges: DataFrame, k: int, vectors: bool = False) -> Spectrum:
    """The k leading eigenvalues (fewer where the smaller side is; nought ones at the end as 0) and, if asked, singular vectors of those that aren't nought.

    Both sides may have any number of ids; at most MOST_VECTORS values can be asked for.
    """
    import warnings

    e = cut_lineage(edges.select("row_id", "col_id", "w"))
    n, m = e.agg(F.countDistinct("row_id"), F.countDistinct("col_id")).first()
    flipped = n < m
    if flipped:
        e, n, m = transposed(e), m, n
        e._is_cut = True
    k = min(k, m)
    if k < 1:
        return Spectrum([], None, None)
    width = width_for(k, m)
    if k > MOST_VECTORS:
        raise ValueError(f"{k} of {m} eigenvalues: at most {MOST_VECTORS} can be asked for")
    found = cut_lineage(solve(e, lambda: Subspace(k, width), MOST_TURNS, SETTLED))
    notes, settled = found.select("notes", "converged").first()
    if not settled:
        warnings.warn(f"eigenvectors did not settle in {MOST_TURNS} turns", RuntimeWarning, stacklevel=2)
    values = [*notes, *[0.0] * (k - len(notes))]
    if not vectors:
        return Spectrum(values, None, None, settled)
    sides = [found.where(F.col("side") == s).select("id", "k", F.col("x").alias("vector")) for s in ("row", "col")]
    return Spectrum(values, *(sides[::-1] if flipped else sides), settled)


class Probes(Program):
    """Lanczos steps of B^T B from random signs, a column for each probe: v, the one before, and w = B^T B v - beta * before.

    The known leading vector is taken out of the signs first, which leaves less to chance.
    """

    opening = ("col",)

    def __init__(self, probes: int, ids: int, seed: int):
        self.probes, self.ids, self.seed = probes, ids, seed

    def start(self, side: str, k: np.ndarray, extra: np.ndarray | None, first: int) -> State:
        out = {"root": np.sqrt(k), "v": np.zeros((len(k), self.probes)), "w": np.zeros((len(k), self.probes))}
        if side == "col":
            out["w"] = np.random.default_rng([self.seed, first]).choice([-1.0, 1.0], (len(k), self.probes)) / np.sqrt(self.ids)
        return out

    def _next(self, state: State, scalars: Scalars) -> np.ndarray:
        """The coming Lanczos vectors, of length 1."""
        if "beta" not in scalars:
            return (state["w"] - scalars["along"] * state["root"][:, None]) / np.sqrt(np.maximum(scalars["weight"], 1e-300))
        left = state["w"] - scalars["alpha"][-1] * state["v"]
        return np.where(scalars["live"], left / np.where(scalars["live"], scalars["beta"][-1], 1), 0.0)

    def send(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        x = state["v"] if side == "row" or "weight" not in scalars else self._next(state, scalars)
        return x / state["root"][:, None]

    def update(self, side: str, sums: np.ndarray, state: State, scalars: Scalars) -> tuple[State, Scalars]:
        w = sums / state["root"][:, None]
        if side == "row":
            return state | {"v": w}, {}
        if "weight" not in scalars:
            return state, {"signs": state["root"] @ state["w"], "roots": float(state["root"] @ state["root"])}
        v = self._next(state, scalars)
        before = scalars["beta"][-1] * state["v"] if "beta" in scalars else 0.0
        return state | {"v": v, "w": w - before}, {"vw": (v * (w - before)).sum(0)}

    def gather(self, side: str, stats: Scalars, scalars: Scalars) -> None:
        if side == "row":
            return
        if "weight" not in scalars:
            scalars["along"] = stats["signs"] / stats["roots"]
            scalars["weight"] = np.maximum(1 - stats["signs"] ** 2 / stats["roots"], 0.0)
            return
        scalars.setdefault("alpha", []).append(stats["vw"])

    def settle(self, side: str, state: State, scalars: Scalars) -> Scalars | None:
        if side == "row" or "alpha" not in scalars:
            return None
        return {"left": ((state["w"] - scalars["alpha"][-1] * state["v"]) ** 2).sum(0)}

    def changes(self, stats: dict[str, Scalars], scalars: Scalars) -> tuple[float, float]:
        scalars.setdefault("beta", []).append(np.sqrt(stats["col"]["left"]))
        scalars["live"] = scalars["beta"][-1] > 1e-10
        return 1.0, 1.0

    def value(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        return np.zeros(len(state["root"]))

    def notes(self, scalars: Scalars) -> list[float]:
        return np.concatenate([scalars["weight"], *scalars["alpha"], *scalars["beta"]]).tolist()


def traces(edges: DataFrame, functions: list[Callable[[np.ndarray], np.ndarray]], probes: int = 32, steps: int = 30, seed: int = 1) -> list[tuple[float, float]]:
    """(estimate, its standard error) of the sum of each function over the smaller side's eigenvalues, by stochastic Lanczos quadrature.

    Only vectors over ids are iterated, and they stay in the cluster; the driver
    sees 2 * steps numbers for each probe.
    """
    e = cut_lineage(edges.select("row_id", "col_id", "w"))
    n, m = e.agg(F.countDistinct("row_id"), F.countDistinct("col_id")).first()
    if n < m:
        e, m = transposed(e), n
        e._is_cut = True
    if not m:
        return [(0.0, 0.0) for _ in functions]
    steps = min(steps, m)
    notes = solve(e, lambda: Probes(probes, m, seed), steps, None).where("side = 'log'").select("notes").first()[0]
    weight = np.array(notes[:probes])
    alpha, beta = np.array(notes[probes:]).reshape(2, steps, probes)
    each = np.zeros((len(functions), probes))
    for p in range(probes):
        b = beta[:, p]  # a probe ends where nothing is left
        end = next((i + 1 for i in range(steps) if b[i] <= 1e-10), steps)
        theta, y = np.linalg.eigh(np.diag(alpha[:end, p]) + np.diag(b[: end - 1], 1) + np.diag(b[: end - 1], -1))
        each[:, p] = [float(f(np.ones(1))[0] + m * weight[p] * (y[0] ** 2 * f(np.clip(theta, 0, 1))).sum()) for f in functions]
    return [(float(x.mean()), float(x.std(ddof=1) / np.sqrt(probes)) if probes > 1 else np.inf) for x in each]
