"""Spectral reports, contracts and community reports against numpy on a small network."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from bipartrix.model import EDGES, row_numbers
from bipartrix.operators import community as cm
from bipartrix.operators import eci as ec
from bipartrix.operators import fitness as ft
from bipartrix.operators import reports as rp
from bipartrix.operators import sinkhorn as sk
from bipartrix.sources import readers as rd


@pytest.fixture(scope="module")
def m():
    rng = np.random.default_rng(11)
    m = (rng.random((12, 15)) < 0.45).astype(float)
    m[:, 0] = m[0, :] = 1
    return m


@pytest.fixture(scope="module")
def e(spark, m):
    return spark.createDataFrame([(f"r{i:02d}", f"c{j:02d}", 1.0) for i, j in zip(*np.nonzero(m), strict=True)], EDGES).cache()


@pytest.fixture(scope="module")
def lam(m):
    return np.linalg.svd(m / np.sqrt(np.outer(m.sum(1), m.sum(0))), compute_uv=False) ** 2


def test_spectral_reports(e, lam):
    assert np.allclose([r.eigenvalue for r in ec.eigenvalues(e, 99).orderBy("idx").collect()], lam, atol=1e-9)
    for r in ec.effective_rank(e, 3).collect():
        p = np.exp(-(1 - lam) * r.t)
        p /= p.sum()
        assert math.isclose(r.rank, math.exp(-(p * np.log(p)).sum()), rel_tol=1e-9)
    gaps = {r.idx: r for r in ec.gap_measures(e).collect()}
    d = -np.diff(lam)
    assert np.allclose([gaps[i].gap for i in range(11)], d, atol=1e-9) and math.isclose(gaps[3].gap_over_average, d[3] / (d.mean() + 1e-10), rel_tol=1e-6)
    low = 1 - lam[:10]
    one = ec.laplacian_gap(e).first()
    assert math.isclose(one.ratio, low[2] / (low[1] + 1e-10), rel_tol=1e-9) and math.isclose(one.gap_over_average, (low[2] - low[1]) / (np.diff(low[1:5]).mean() + 1e-10), rel_tol=1e-6)
    rep = ec.spectrum_report(e).collect()
    assert rep[0].n_significant == int((lam > 0.2 * lam[1]).sum()) and math.isclose(rep[0].lambda2_over_lambda3, lam[1] / lam[2], rel_tol=1e-9)
    plain = ec.principled_diagnosis(e).first()
    assert plain.is_persistent == (lam[1] > 0.8) and math.isclose(plain.eigengap, lam[1] - lam[2], rel_tol=1e-6)
    both = ec.both_sides(e, 10).collect()
    assert len(both) == 20 and all(math.isclose(r.gap_ratio, (1 - lam[2]) / (1 - lam[1] + 1e-10), rel_tol=1e-9) for r in both)


def test_communities_match_the_kernel(e, m):
    whole = {r.row_id: r.community for r in cm.detect_communities(e).collect()}
    own = {r.row_id: r.community for r in cm.detect_communities(e.withColumn("g", F.lit(1)), by=["g"]).collect()}
    # Signs of the vectors may turn, which the detector doesn't mind.
    assert whole == own
    labels = e.select("row_id").distinct().withColumn("community", (F.substring("row_id", 3, 1).cast("int") % 2))
    inside = {r.community: r for r in cm.within_communities(e, labels).collect()}
    every = cm.within_communities(e, labels.withColumn("community", F.lit(0))).first()
    one = cm.score_correlations(e).first()
    for c in ("pearson", "spearman", "pearson_cols", "spearman_cols"):
        assert math.isclose(one[c], every[c], abs_tol=1e-7)
    assert set(inside) == {0, 1} and inside[0].n_rows == 6
    report = cm.network_report(e).first()
    assert math.isclose(report.pearson, one.pearson, rel_tol=1e-9) and report.nnz == int(m.sum()) and report.agreement in ("strong", "partial", "weak")
    assert 0 <= cm.eigengap_null_model(e, 9, model="permutation").first().p_value <= 1
    k = cm.user_clusters(e)
    assert k.count() == 12


def test_contracts(spark, e):
    ids = spark.createDataFrame([("r00",), ("alone",)], "id string")
    with pytest.warns(UserWarning, match="without an edge"):
        got = ec.eci_scores(e, rows=ids)
    assert [r.score for r in got.where("id = 'alone'").collect()] == [None]
    history = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = ec.reflections(e, 40, 1e-6, history=history)
    assert len(history) == out.first().n_iter and history[-1][1] < 1e-6
    with pytest.warns(RuntimeWarning, match="did not settle"):
        ec.reflections(e, 1, 1e-15, check_gap=False)
    with pytest.raises(ValueError, match="undefined"):
        ec.reflections(rd.block_network(spark, 8, 8, 2))
    masses = spark.createDataFrame([("r00", 3.0), ("r01", 1.0), ("nobody", 1.0)], "id string, mass double")
    with pytest.warns(UserWarning, match="no edge"):
        w = sk.SinkhornScaler(50, 1e-9).fit(e, row_mass=masses)
    assert {r.id: r.target for r in w.scales.where("side = 'row' AND target > 0").collect()} == {"r00": 3.0, "r01": 1.0}
    assert math.isclose(w.scales.where("side = 'col'").agg(F.sum("target")).first()[0], 4.0)
    none = e.limit(0)
    assert ft.fitness_scores(none).count() == 0 and sk.SinkhornScaler().fit(none).scales.count() == 0 and ec.reflections(none, check_gap=False).count() == 0


def test_reports_over_range_partitions(spark, e):
    s = spark.createDataFrame([(f"k{i:03d}", float(i * 7 % 50)) for i in range(200)], "id string, score double")
    got = [(r.id, r.rank) for r in rp.ranked(s).orderBy("rank").collect()]
    want = sorted(((i, x) for i, x in ((r.id, r.score) for r in s.collect())), key=lambda p: (-p[1], p[0]))
    assert got == [(i, k + 1) for k, (i, _) in enumerate(want)]
    assert {r.n for r in row_numbers(s, [F.col("id").asc()], "n", 0).collect()} == set(range(200))
    bands = rp.alluvial_bands(e).collect()
    for side in ("row", "col"):
        spans = {r.id: r for r in rp.alluvial_spans(e, f"{side}_id").collect()}
        for node, span in spans.items():
            own = sorted((b for b in bands if b[f"{side}_id"] == node), key=lambda b: b[f"{side}_lo"])
            assert math.isclose(own[0][f"{side}_lo"], span.lo, abs_tol=1e-9) and math.isclose(own[-1][f"{side}_hi"], span.hi, abs_tol=1e-9)
            assert all(math.isclose(a[f"{side}_hi"], b[f"{side}_lo"], abs_tol=1e-9) for a, b in zip(own, own[1:], strict=False))
    labels = spark.createDataFrame([(i, i // 3) for i in range(9)], "id int, label int")
    assert math.isclose(rp.cluster_purity(labels, labels.select("id", (F.col("id") % 2).alias("class"))).first().purity, 6 / 9)


def test_sources(spark, tmp_path):
    import zipfile

    text = "product_id,hs_product_code,hs_product_name_short_en\n1,0101,Horses\n2,0102,\"Cattle, live\"\n"
    (tmp_path / "p.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("a.txt", "x")
        z.writestr("hs_product.csv", text)
    for name in ("p.csv", "p.zip"):
        assert sorted(map(tuple, rd.read_product_names(spark, str(tmp_path / name)).collect())) == [("0101", "Horses"), ("0102", "Cattle, live")]
    long = spark.createDataFrame([("FRA", 2000, 1.0), ("WLD", 2000, 2.0), ("LIE", 2000, 3.0), ("DEU", 2000, None)], "country_code string, year int, value double")
    assert rd.available_countries(long) == ["FRA", "LIE", "WLD"] and rd.available_countries(long, True) == ["FRA", "LIE"] and rd.available_countries(long, True, True) == ["FRA"]
    with pytest.warns(UserWarning, match="XXX"):
        assert rd.select_series(long, ["FRA", "XXX"]).count() == 1
    assert rd.small_fixture(spark).edges.count() == 12
    n = rd.random_network(spark, 30, 30, 0.3)
    assert rd.remove_share(n, 0.25).count() == n.count() - int(0.25 * n.count())
    base = rd.nested_network(spark, 20, 30)
    more = rd.add_shortcuts(base, 1.0).join(base, ["row_id", "col_id"], "left_anti").groupBy("row_id").count()
    assert 1 <= more.agg(F.min("count")).first()[0] and more.agg(F.max("count")).first()[0] <= 3
    assert rd.multi_scale_network(spark, 30, 30).count() > 100 and rd.smooth_network(spark, 20, 20).count() > 40
    assert rd.circle_points(spark, 20).groupBy("class").count().count() == 3
