"""Networks laid out in cells and blocks against the same in one task, and against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bipartrix.model import EDGES
from bipartrix.operators import community as cm
from bipartrix.operators import eci as ec
from bipartrix.operators import fitness as ft
from bipartrix.operators import grid as gr
from bipartrix.operators import sinkhorn as sk
from bipartrix.operators.spectra import SETTLED, Subspace, spectrum
from bipartrix.sources import readers as rd


def edges(spark, m, weights=False):
    return spark.createDataFrame([(f"r{i:02d}", f"c{j:02d}", float(m[i, j]) if weights else 1.0) for i, j in zip(*np.nonzero(m), strict=True)], EDGES)


@pytest.fixture(scope="module")
def m():
    rng = np.random.default_rng(2)
    m = (rng.random((11, 14)) < 0.4).astype(float)
    m[:, 0] = m[0, :] = 1
    return m


@pytest.fixture(scope="module")
def e(spark, m):
    return edges(spark, m).cache()


def by_id(df, value):
    return {(r.side, r.id): r[value] for r in df.collect()}


def same(a, b, rel=1e-9):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=rel, abs_tol=1e-12) for k in a)


def test_fitness_in_cells(e, m):
    one = ft.fitness_scores(e, 60, 1e-2)
    with gr.spread_out(20, 4):
        cells = ft.fitness_scores(e, 60, 1e-2)
    assert same(by_id(one, "score"), by_id(cells, "score"))
    assert one.first().n_iter == cells.first().n_iter < 60 and cells.first().converged  # the same turn
    with gr.spread_out(20, 4):
        log = ft.fitness_history(e, 3, 0.0).orderBy("iter").collect()
    f, q = np.ones(11), np.ones(14)
    for r in log:
        f1 = m @ q
        f1 /= f1.mean()
        q1 = 1 / (m.T @ (1 / f1))
        q1 /= q1.mean()
        assert math.isclose(r.d_row, np.abs(f1 - f).max(), rel_tol=1e-9) and math.isclose(r.d_col, np.abs(q1 - q).max(), rel_tol=1e-9)
        f, q = f1, q1


def test_sinkhorn_and_reflections_in_cells(e):
    one, cells = sk.SinkhornScaler(5, 0.0).fit(e), sk.SinkhornScaler(5, 0.0)
    with gr.spread_out(20, 4):
        cells.fit(e)
        p = ec.reflections(e, 4, None, check_gap=False)
    assert same(by_id(one.scales, "scale"), by_id(cells.scales, "scale"))
    assert np.allclose(one.history, cells.history, atol=1e-14)
    assert same(by_id(ec.reflections(e, 4, None, check_gap=False), "k_n"), by_id(p, "k_n"))


def test_spectrum_in_cells(e, m):
    lam = np.linalg.svd(m / np.sqrt(np.outer(m.sum(1), m.sum(0))), compute_uv=False) ** 2
    with gr.spread_out(20, 4):
        found = spectrum(e, 3, vectors=True)
        scores = ec.eci_scores(e)
    assert found.settled and np.allclose(found.eigenvalues, lam[:3], atol=1e-12)
    assert same(by_id(scores, "score"), by_id(ec.eci_scores(e), "score"), 1e-8)


def test_few_vectors_settle_on_many_ids():
    """With far fewer vectors than ids, against a dense solution; equal eigenvalues included."""
    rng = np.random.default_rng(3)
    block = (rng.random((60, 80)) < 0.2).astype(float)
    block[:, 0] = block[0, :] = 1
    for m in (block, np.kron(np.eye(2), block)):
        pdf = pd.DataFrame([(f"{i:04d}", f"{j:04d}", 1.0) for i, j in zip(*np.nonzero(m), strict=True)], columns=["row_id", "col_id", "w"])
        op, program = gr.Local(pdf), Subspace(4, 20)
        out = gr.turns(op, program, 400, SETTLED)[0]
        b = m / np.sqrt(np.outer(m.sum(1), m.sum(0)))
        u, s, vt = np.linalg.svd(b)
        assert out.converged and np.allclose(program.notes(out.scalars), s[:4] ** 2, atol=1e-11)
        x, y = op.value("row"), op.value("col")
        assert np.allclose(x.T @ x, np.eye(4), atol=1e-9) and np.allclose(b @ y, x * s[:4], atol=1e-9)
        if m is block:
            assert np.allclose(np.abs((u[:, :4] * x).sum(0)), 1, atol=1e-9)


def test_edges_stay_where_they_lie(e):
    """A half-turn deals out the vector and the sums; the cells are read from where they were put."""
    with gr.spread_out(20, 4):
        grid = gr.Grid(e.select(F.lit(0).alias("g"), "row_id", "col_id", "w"), None, {0: {"row": 11, "col": 14}})
        grid.begin(ft.Fitness(), {0: {}})
        plan = grid.shipped("row")._jdf.queryExecution().executedPlan().toString()
        assert grid.cells.count() > 6
        grid.cells.unpersist()
    cells, vector = plan.split("FlatMapCoGroupsInArrow")[1].split("InMemoryTableScan")[0], plan.count("Exchange hashpartitioning")
    assert "Exchange" not in cells and "InMemoryTableScan" in plan
    assert vector >= 1  # the vector's side, and what the cells were dealt out by once


def test_a_half_turn_has_tasks_for_its_cells(spark, e):
    """Not for each shuffle partition, whose results would go to the driver in every half-turn; and the vector finds its cells without a join."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        with gr.spread_out(50, 8):
            grid = gr.Grid(e.select(F.lit(0).alias("g"), "row_id", "col_id", "w"), None, {0: {"row": 11, "col": 14}})
            grid.begin(ft.Fitness(), {0: {}})
        cells, shipped = grid.index.count(), grid.shipped("row")
        assert 1 < cells < 10 and grid.cells.count() == cells
        assert shipped.rdd.getNumPartitions() <= 2 * cells
        assert "Join" not in shipped._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[-1]
        grid.cells.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_filtered_fitness_of_a_large_network(e):
    """The filter and its nulls with the network in cells, as in one task."""
    fit = lambda: {r.id: (r.score, r.kept) for r in ft.FitnessComplexity(10, 0.0, 3, 5).fit(e).fitness.collect()}
    one = fit()
    with gr.spread_out(20, 4):
        cells = fit()
    assert one.keys() == cells.keys() and {k for _, k in one.values()} == {True, False}
    assert all(kept == cells[i][1] and (score is None and cells[i][0] is None or math.isclose(score, cells[i][0], rel_tol=1e-9)) for i, (score, kept) in one.items())


def test_filtered_fitness_makes_its_edges_once(spark, e):
    """The filter and the result read them several times; made anew, sums near a threshold may fall on its other side."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    n = e.count()
    fit = ft.FitnessComplexity(3, 0.0, 3, 5).fit(e.mapInArrow(count, EDGES))
    rows, cols = fit.fitness.collect(), fit.complexity.collect()
    assert len(rows) == 11 and len(cols) == 14 and made.value == n


def test_one_network_of_many_holds_most_edges(spark, m):
    """A large network in cells, small ones in a task each, and each stops at its own turn."""
    rng = np.random.default_rng(4)
    nets = {"large": m, "small": np.triu(np.ones((4, 4))), "other": (rng.random((3, 5)) < 0.7).astype(float), None: np.ones((2, 3))}
    nets["other"][:, 0] = 1
    rows = [(g, f"r{i:02d}", f"c{j:02d}", 1.0) for g, x in nets.items() for i, j in zip(*np.nonzero(x), strict=True)]
    many = spark.createDataFrame(rows, "net string, " + EDGES)
    assert (m > 0).sum() > 0.6 * len(rows)
    with gr.spread_out(30, 4):
        f = ft.fitness_scores(many, 40, 1e-3, by=["net"]).collect()
        s = ec.eci_scores(many, by=["net"]).collect()
        v = ec.eigenvalues(many, 3, by=["net"]).collect()
    for g, x in nets.items():
        own = edges(spark, x)
        alone = ft.fitness_scores(own, 40, 1e-3)
        assert same({(r.side, r.id): r.score for r in f if r.net == g}, by_id(alone, "score"))
        assert {r.n_iter for r in f if r.net == g} == {alone.first().n_iter}
        lam = np.linalg.svd(x / np.sqrt(np.outer(x.sum(1), x.sum(0))), compute_uv=False) ** 2
        mine = [r.eigenvalue for r in sorted(v, key=lambda r: r.idx) if r.net == g]
        assert np.allclose(mine, lam[: len(mine)], atol=1e-10) and len(mine) == min(3, int((lam > 1e-12).sum()))
        if g in ("large", "small"):
            assert same({(r.side, r.id): r.score for r in s if r.net == g}, by_id(ec.eci_scores(own), "score"), 1e-7)


def test_equal_eigenvalues_are_flagged_at_every_size(spark):
    e = rd.block_network(spark, 8, 8, 2)
    three = edges(spark, 1 - np.eye(4))  # the second to fourth eigenvalue are equal
    for size in (1 << 19, 10):
        with gr.spread_out(size, 3):
            assert ec.eci_scores(e).first().degenerate and ec.eci_scores(three).first().degenerate


def test_communities_by_network(spark, m):
    e = edges(spark, m)
    want = {r.row_id: r.community for r in cm.detect_communities(e).collect()}
    twice = e.withColumn("net", F.explode(F.array(F.lit(1), F.lit(2))))
    for r in cm.detect_communities(twice, by=["net"]).collect():
        assert want[r.row_id] == r.community


def test_swap_chain_keeps_degrees(spark, m):
    """Every degree as before, no double edge, most edges moved; networks don't mix."""
    rng = np.random.default_rng(9)
    big = (rng.random((30, 40)) < 0.3).astype(float)
    rows = [(g, f"r{i:02d}", f"c{j:02d}") for g, x in ((1, big), (2, m)) for i, j in zip(*np.nonzero(x), strict=True)]
    before = spark.createDataFrame(rows, "net int, row_id string, col_id string")
    after = cm.swap_chain(before, 3, by=["net"]).collect()
    assert len(after) == len(set(after)) == len(rows)
    for k in (1, 2):
        count = lambda edges, k=k: {x: sum(e[0] == x[0] and e[k] == x[1] for e in edges) for x in {(e[0], e[k]) for e in edges}}
        assert count(rows) == count([tuple(e) for e in after])
    moved = {tuple(e) for e in after} - set(rows)
    assert len([e for e in moved if e[0] == 1]) > 0.4 * big.sum()
    alone = cm.swap_chain(before.where("net = 1").drop("net"), 2).collect()
    assert len(set(alone)) == int(big.sum())


def test_null_model_of_large_networks(e, monkeypatch):
    """A nested network's gap is beyond that of most shuffles in either way of shuffling."""
    small = cm.eigengap_null_model(e, 8, swaps_per_edge=2)
    monkeypatch.setattr(cm, "NULL_MODEL_EDGES", 10)
    for model in ("swaps", "permutation"):
        got = cm.eigengap_null_model(e, 8, swaps_per_edge=2, model=model).first()
        assert math.isclose(got.observed, small.first().observed, rel_tol=1e-9) and 0 <= got.p_value <= 1


def test_heat_traces_from_probes(spark, e, m):
    """Within 1 % of the dense values with as many steps as ids, and near it with few."""
    rng = np.random.default_rng(5)
    wide = (rng.random((150, 200)) < 0.1).astype(float)
    wide[:, 0] = wide[0, :] = 1
    for x, own, probes, steps, off in ((m, e, 400, 11, 0.01), (wide, edges(spark, wide), 64, 20, 0.01)):
        lam = np.linalg.svd(x / np.sqrt(np.outer(x.sum(1), x.sum(0))), compute_uv=False) ** 2
        for r in ec.heat_traces(own, 3, probes, steps).collect():
            p = np.exp(-(1 - lam) * r.t)
            assert abs(r.trace - p.sum()) <= max(off * p.sum(), 4 * r.error) and r.error < 0.02 * p.sum()
            p /= p.sum()
            assert abs(r.rank / math.exp(-(p * np.log(p)).sum()) - 1) < 0.02
    with gr.spread_out(20, 4):
        cells = ec.heat_traces(e, 1, 64, 3).collect()
    dense = np.linalg.svd(m / np.sqrt(np.outer(m.sum(1), m.sum(0))), compute_uv=False) ** 2
    assert abs(cells[1].trace - np.exp(dense - 1).sum()) <= max(0.02 * np.exp(dense - 1).sum(), 4 * cells[1].error)
