"""Solvers against plain numpy on nested, random and modular matrices, at the thresholds that independent packages are held to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bipartrix.model import EDGES
from bipartrix.operators import eci as ec
from bipartrix.operators import fitness as ft
from bipartrix.sources import readers as rd

CASES = ("nested", "random", "modular")


def case(name):
    rng = np.random.default_rng(7)
    if name == "nested":
        m = np.array([[float(j < 30 - i) for j in range(30)] for i in range(20)])
        noise = rng.random(m.shape) < 0.05
        m = np.abs(m - noise)
    elif name == "random":
        m = (rng.random((20, 30)) < 0.3).astype(float)
    else:
        m = (rng.random((20, 30)) < np.kron(np.eye(2), np.full((10, 15), 0.5)) + 0.05).astype(float)
    m[:, 0] = m[0, :] = 1
    return m


def frame(spark, m):
    return spark.createDataFrame([(f"r{i:02d}", f"c{j:02d}", 1.0) for i, j in zip(*np.nonzero(m), strict=True)], EDGES)


def values(df, side):
    return np.array([r.score for r in df.where(F.col("side") == side).orderBy("id").collect()])


def plain_fitness(m, n):
    f, q = np.ones(m.shape[0]), np.ones(m.shape[1])
    for _ in range(n):
        f, q = m @ q, 1 / (m.T @ (1 / f))
        f, q = f / f.mean(), q / q.mean()
    return f, q


@pytest.mark.parametrize("name", CASES)
def test_fitness(spark, name):
    """Both sides from the turn before, as the method is published: the same fixed point as ours."""
    m = case(name)
    got = ft.fitness_scores(frame(spark, m), 300, 1e-12)
    f, q = plain_fitness(m, 600)
    for side, want in (("row", f), ("col", q)):
        assert np.corrcoef(values(got, side), want)[0, 1] > 0.9999


@pytest.mark.parametrize("name", CASES)
def test_eci(spark, name):
    m = case(name)
    got = ec.eci_scores(frame(spark, m))
    for side, x in (("row", m), ("col", m.T)):
        walk = (x / x.sum(1, keepdims=True)) @ (x / x.sum(0)).T
        lam, v = np.linalg.eig(walk)
        v = np.real(v[:, np.argsort(-np.real(lam))[1]])
        v = (v - v.mean()) / v.std()
        mine = values(got, side)
        assert min(np.abs(mine - v).max(), np.abs(mine + v).max()) < 1e-8


def test_degenerate(spark):
    assert ec.eci_scores(frame(spark, np.kron(np.eye(2), np.ones((4, 5))))).first().degenerate


def test_stored_results_are_read(spark, tmp_path):
    """A matrix file and a score file as independent packages store them."""
    m = case("random")
    cells = [f"{i},{j},{x:g}" for i, row in enumerate(m) for j, x in enumerate(row)]
    (tmp_path / "random_matrix.csv").write_text("\n".join(["row,col,value", *cells]))
    f, _ = plain_fitness(m, 600)
    (tmp_path / "scores.csv").write_text("\n".join(["index,score,more", *[f"{i},{x!r},0" for i, x in enumerate(f.tolist())]]))
    e = rd.read_golden(spark, f"{tmp_path}/random")
    assert e.count() == int(m.sum())
    ours = ft.fitness_scores(e, 300, 1e-12).where("side = 'row'").select("id", F.col("score").alias("ours"))
    both = ours.join(rd.read_golden_scores(spark, f"{tmp_path}/scores.csv", "r"), "id").collect()
    assert len(both) == 20 and all(abs(r.ours / r.score - 1) < 1e-6 for r in both)
