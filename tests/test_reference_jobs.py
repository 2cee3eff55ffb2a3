"""Queries that once did a part of their job now do all of it."""

import math

import duckdb
import numpy as np

from bipartrix.operators import community as cm
from bipartrix.operators import reports as rp
from bipartrix.plans import registry


def test_affinities_of_all_embeddings(spark, sf):
    ids, x = zip(*duckdb.sql(f"SELECT vec_id, embedding::DOUBLE[] FROM '{sf}/embeddings.parquet' ORDER BY 1").fetchall(), strict=True)
    x = np.array(x)
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2)
    at = {v: i for i, v in enumerate(ids)}
    got = registry.queries()["affinity_rbf"](spark, sf).toPandas()
    assert len(got) == len(ids) ** 2 > 50**2
    assert np.abs(got.w.to_numpy() - want[got.a.map(at), got.b.map(at)]).max() < 1e-6
    s = 1 / np.sqrt(want.sum(1) + 1e-10)
    got = registry.queries()["laplacian_normalised"](spark, sf).toPandas()
    assert len(got) == len(ids) ** 2
    assert np.abs(got.w.to_numpy() - (want * s * s[:, None])[got.a.map(at), got.b.map(at)]).max() < 1e-6


def test_affinities_above_a_threshold(spark):
    pts = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [9.0, 9.0]), (4, None), (5, [0.0])], "id int, features array<float>")
    got = {(r.a, r.b): r.w for r in cm.affinity_rbf(pts, 1.0).collect()}
    assert len(got) == 25 and got[4, 4] is None and got[1, 5] is None and got[5, 5] == 1.0
    near = {(r.a, r.b) for r in cm.affinity_rbf(pts, 1.0, min_weight=0.5).collect()}
    assert near == {k for k, w in got.items() if w is not None and w >= 0.5}


def test_every_year_is_solved(spark, sf):
    got = registry.queries()["fc_by_year"](spark, sf).toPandas()
    sold = duckdb.sql(f"""SELECT year(l_shipdate)::INT y, n_name r, p_brand p, sum(l_extendedprice * (1 - l_discount))::DOUBLE v FROM '{sf}/lineitem.parquet'
      JOIN '{sf}/supplier.parquet' ON l_suppkey = s_suppkey JOIN '{sf}/nation.parquet' ON s_nationkey = n_nationkey JOIN '{sf}/part.parquet' ON l_partkey = p_partkey GROUP BY 1, 2, 3""").df()
    assert set(got.year) == set(sold.y) and len(set(sold.y)) > 2
    for year, own in sold.groupby("y"):
        w = own.pivot(index="r", columns="p", values="v").fillna(0.0)
        x = w.to_numpy()
        m = ((x / x.sum(1, keepdims=True)) / (x.sum(0) / x.sum()) >= 1).astype(float)
        brands = w.columns[m.any(0)]
        m = m[m.any(1)][:, m.any(0)]
        q = np.ones(m.shape[1])
        for _ in range(20):
            f = np.maximum(m @ q, 1e-12)
            q = 1 / np.maximum((1 / (f / f.mean())) @ m, 1e-12)
            q = q / q.mean()
        mine = got[got.year == year].set_index("id").complexity
        assert sorted(mine.index) == sorted(brands)
        assert np.allclose(mine[brands].to_numpy(float), q, atol=2e-6, rtol=1e-6)


def test_null_model_takes_its_default_of_shuffles(spark, sf):
    p = registry.queries()["null_model_pvalue"](spark, sf).first()
    own = cm.eigengap_null_model(registry.flagship(spark, sf), 100).first()
    assert (p.observed, p.p_value) == (round(own.observed, 6), round(own.p_value, 6))


def test_aggregates_are_excluded_from_the_indicator_table(spark, sf):
    got = [r.country_code for r in registry.queries()["exclude_aggregates"](spark, sf).collect()]
    sql = f"SELECT DISTINCT n_name FROM '{sf}/orders.parquet' JOIN '{sf}/customer.parquet' ON o_custkey = c_custkey JOIN '{sf}/nation.parquet' ON c_nationkey = n_nationkey ORDER BY 1"
    assert sorted(got) == [r[0] for r in duckdb.sql(sql).fetchall()]


def test_pairs_of_points_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(cm, "BLOCK_POINTS", 16)
    pts = spark.createDataFrame([(i, [float(i % 7), i / 9]) for i in range(60)], "id int, features array<float>")
    for got in (cm.affinity_rbf(pts, 1.0), cm.laplacian_rbf(pts, 1.0)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan and got.rdd.getNumPartitions() == 16
        assert got.count() == got.select("a", "b").distinct().count() == 3600


def test_a_written_pair_takes_some_bytes(spark, sf, tmp_path, monkeypatch):
    """Both ways of a pair stand close together, so that compression finds the second; the pairs of many tiles and blocks are all there."""
    monkeypatch.setattr(cm, "BLOCK_POINTS", 512)
    d, out = sf.replace("sf0.001", "sf0.1"), str(tmp_path / "out")
    registry.queries()["affinity_rbf"](spark, d).write.parquet(out)
    ids, x = zip(*duckdb.sql(f"SELECT vec_id, embedding::DOUBLE[] FROM '{d}/embeddings.parquet' ORDER BY 1").fetchall(), strict=True)
    x, got = np.array(x), duckdb.sql(f"SELECT a, b, w FROM '{out}/*.parquet' ORDER BY 1, 2").fetchnumpy()
    assert (got["a"] == np.repeat(ids, len(ids))).all() and (got["b"] == np.tile(ids, len(ids))).all()
    want = np.exp(-np.array([((x - v) ** 2).sum(1) for v in x]) / 2)
    assert np.abs(got["w"] - want.ravel()).max() < 5.001e-7
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6.5 * len(ids) ** 2


def test_tasks_send_a_pair_once(spark, sf, monkeypatch):
    """A weight and an id for both ways of a pair, rounded before: Spark only lays them out."""
    monkeypatch.setattr(cm, "BLOCK_POINTS", 64)
    for name in ("laplacian_normalised", "affinity_rbf"):
        got = registry.queries()[name](spark, sf)
        n, plan = len(got.collect()), got._jdf.queryExecution().executedPlan()
        assert "round(" not in plan.toString()
        while plan.nodeName() != "MapInArrow":
            plan = plan.children().apply(0)
        assert plan.metrics().apply("pythonDataReceived").value() < 12 * n


def test_affinities_of_odd_points(spark, monkeypatch):
    """Absent, empty and short features, nulls in them, repeated ids, and points so far out that products of them would cancel."""
    monkeypatch.setattr(cm, "BLOCK_POINTS", 4)
    rows = [(1, [0.0, 0.0]), (1, [1.0, 0.0]), (None, [0.2, 0.1]), (4, None), (5, [0.5]), (6, [None, 1.0]), (7, []), (8, [1.5]), (9, None)]
    rows += [(i, [1e8 + i / 8, 3.0]) for i in range(10, 20)] + [(i, [i / 20, 1.0]) for i in range(20, 30)]
    plain = lambda x: x is not None and x and None not in x
    weight = lambda x, y: math.exp(-sum((u - v) ** 2 for u, v in zip(x, y, strict=True)) / 2) if plain(x) and plain(y) and len(x) == len(y) else None
    told = lambda pairs: sorted((str(a), str(b), "-" if w is None else f"{w:.9f}") for a, b, w in pairs)
    got = cm.affinity_rbf(spark.createDataFrame(rows, "id int, features array<double>"), 1.0)
    assert told(got.collect()) == told((a, b, weight(x, y)) for a, x in rows for b, y in rows)


def test_laplacian_of_odd_points(spark, monkeypatch):
    """Repeated and null ids, features that are absent, hold a null or have another length: as from the table of pairs."""
    monkeypatch.setattr(cm, "BLOCK_POINTS", 4)
    odd = [(1, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (None, [0.2, 0.1]), (4, None), (5, [0.0]), (6, [None, 1.0]), (7, []), (8, [0.3, float("nan")])]
    pts = spark.createDataFrame(odd + [(i, [i / 20, 1.0]) for i in range(10, 20)], "id int, features array<float>")
    rows = lambda df: sorted((r.a, r.b, "-" if r.w is None else f"{r.w:.9f}") for r in df.collect())
    assert rows(cm.laplacian_rbf(pts, 1.0)) == rows(cm.normalised_laplacian(cm.affinity_rbf(pts, 1.0)))
    assert cm.laplacian_rbf(pts.limit(0), 1.0).count() == 0


def test_ranks_find_sums_whose_last_bits_change(spark):
    """Sums in another order, as shuffles make them, here by numbers drawn anew each time the table is made."""

    def last_bits(frames):
        rng = np.random.default_rng()
        for x in frames:
            yield x.assign(v=x.v * (1 + rng.integers(-8, 9, len(x)) * 2.0**-52))

    made = spark.range(40).selectExpr("id * 1.1e9D + 7 AS v", "id % 5 + id AS c").mapInPandas(last_bits, "v double, c long")
    r = rp.correlations(made, "v", "c").first()
    assert r.n == 40 and 0.9 < r.pearson <= 1 and 0.9 < r.spearman <= 1
    assert rp.average_ranks(made, "v", "k").count() == 40
