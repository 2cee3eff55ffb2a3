"""Solvers, filters and sources on small networks with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bipartrix.functions import text as tx
from bipartrix.model import EDGES, bundle, dimension, edges_of, quantiles, same_edges
from bipartrix.operators import community as cm
from bipartrix.operators import eci as ec
from bipartrix.operators import fitness as ft
from bipartrix.operators import metric
from bipartrix.operators import network as nw
from bipartrix.operators import reports as rp
from bipartrix.operators import sinkhorn as sk
from bipartrix.sources import readers as rd
from bipartrix.sources import sinks
from bipartrix.streaming import margins


def matrix(spark, m):
    cells = [(f"r{i:02d}", f"c{j:02d}", float(x)) for i, row in enumerate(m) for j, x in enumerate(row) if x]
    return spark.createDataFrame(cells, EDGES)


def scores(df, which):
    return {r.id: r.score for r in df.where(F.col("side") == which).collect()}


BANDED = [[1, 1, 1, 0], [1, 1, 0, 1], [1, 0, 1, 1], [1, 1, 1, 1], [1, 0, 0, 0]]


def test_fitness(spark):
    e = matrix(spark, BANDED)
    one, many = ft.fitness_scores(e, 12, 0.0), ft.fitness_scores(e.withColumn("g", F.lit(1)), 12, 0.0, by=["g"])
    for which in ("row", "col"):
        a, b = scores(one, which), scores(many, which)
        assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)
        assert math.isclose(np.mean(list(a.values())), 1)
    assert ft.fitness_scores(e, 60, 1e-3).first().n_iter < 60
    f = scores(one, "row")
    assert f["r03"] == max(f.values()) and f["r04"] == min(f.values())
    assert ft.fitness_history(e, 12, 0.0).count() == 12
    with pytest.raises(ValueError):
        ft.fitness_scores(e, 0)


def test_fitness_filter_leaves_nulls(spark):
    m = np.ones((8, 9))
    m[7, 1:] = 0
    out = ft.FitnessComplexity(50, 1e-10).fit(matrix(spark, m))
    rows = {r.id: r for r in out.fitness.collect()}
    assert rows["r07"].score is None and not rows["r07"].kept and all(math.isclose(rows[f"r{i:02d}"].score, 1) for i in range(7))
    assert out.converged
    none = ft.FitnessComplexity(50, 1e-10, 100, 100).fit(matrix(spark, m))
    assert none.n_iter == 0 and not none.converged and none.fitness.where("score IS NOT NULL").count() == 0
    with pytest.warns(DeprecationWarning):
        ft.fitness_complexity(matrix(spark, BANDED), 5)


def test_eci_solves_the_walk(spark):
    rng = np.random.default_rng(5)
    m = (rng.random((9, 12)) < 0.5).astype(float)
    m[:, 0] = m[0, :] = 1
    e = matrix(spark, m)
    got = ec.eci_scores(e)
    eci = np.array([scores(got, "row")[f"r{i:02d}"] for i in range(9)])
    walk = m / m.sum(1)[:, None] @ (m / m.sum(0)).T
    vals, vecs = np.linalg.eig(walk)
    v = np.real(vecs[:, np.argsort(-np.real(vals))[1]])
    v = (v - v.mean()) / v.std()
    assert np.allclose(eci, v, atol=1e-8) or np.allclose(eci, -v, atol=1e-8)
    assert np.corrcoef(eci, m.sum(1))[0, 1] >= 0
    assert math.isclose(ec.eigenvalues(e, 20).agg(F.sum("eigenvalue")).first()[0], np.trace(walk), rel_tol=1e-9)
    pci = np.array([scores(got, "col")[f"c{i:02d}"] for i in range(12)])
    assert abs(pci.mean()) < 1e-9 and math.isclose(pci.std(), 1)


def test_eci_of_many_networks(spark):
    m = np.zeros((6, 8))
    for i in range(6):
        m[i, : i + 3] = 1
    a = ec.eci_scores(matrix(spark, m))
    one = ec.eci_scores(matrix(spark, m).withColumn("g", F.lit(1)), by=["g"])
    assert all(abs(scores(a, w)[k] - x) < 1e-9 for w in ("row", "col") for k, x in scores(one, w).items())


def test_degenerate_blocks_are_flagged(spark):
    e = rd.block_network(spark, 8, 8, 2)
    assert ec.eci_scores(e).first().degenerate and ec.eigengap(e).first().is_degenerate
    with pytest.raises(Exception, match="Not enough dimensions"):
        ec.eci_scores(matrix(spark, [[1, 1]])).collect()


def test_sinkhorn(spark):
    e = matrix(spark, BANDED)
    w = sk.SinkhornScaler(3000, 1e-13, margins="degree").fit_transform(e)
    n = e.count()
    for key, axis in (("row_id", 1), ("col_id", 0)):
        mass = {r[0]: r[1] for r in w.groupBy(key).agg(F.sum("w_scaled")).collect()}
        assert np.allclose([mass[k] for k in sorted(mass)], np.array(BANDED).sum(axis) / n, atol=1e-9)
    assert w.count() == n
    k = np.array(BANDED, float)
    u, v = np.ones(5), np.ones(4)
    for _ in range(7):
        u = 0.2 / (k @ v)
        v = 0.25 / (u @ k)
    seven = sk.SinkhornScaler(7, 0.0).fit(e)
    a = {r.id: r.scale for r in seven.scales.collect()}
    assert np.allclose([a[f"r{i:02d}"] for i in range(5)], u, rtol=1e-9) and np.allclose([a[f"c{i:02d}"] for i in range(4)], v, rtol=1e-9)
    assert [t for t, _, _ in seven.history] == list(range(1, 8)) and math.isclose(seven.history[-1][1], np.abs(u * (k @ v) - 0.2).max(), rel_tol=1e-6)
    with pytest.raises(ValueError):
        sk.SinkhornScaler().transform(e)
    with pytest.raises(ValueError):
        sk.SinkhornScaler().fit(e, row_mass={"r00": -1.0})
    with pytest.warns(UserWarning):
        sk.SinkhornScaler(10).fit(e, row_mass={**{f"r{i:02d}": 1.0 for i in range(5)}, "nobody": 1.0})


def test_filters(spark):
    chain = matrix(spark, [[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 1], [0, 0, 0, 1]])
    assert nw.degree_filter(chain, 2, 2).count() == 0
    assert nw.degree_filter(chain, 2, 2, iterative=False).count() == 4
    assert nw.mass_filter(chain, 2, 2).count() == 5
    assert nw.unique_cols(chain).collect()[0].col_id == "c00"
    assert nw.density(chain).first().nnz == 7
    assert nw.nestedness(matrix(spark, np.ones((4, 4)))).first().violations == 0
    # A one's measure counts every row below it that lacks its column, so a staircase has some too.
    assert nw.nestedness(matrix(spark, np.tril(np.ones((4, 4))))).first().violations == 10


def test_nestedness_counts(spark):
    rng = np.random.default_rng(2)
    m = (rng.random((7, 9)) < 0.5).astype(int)
    m[:, 0] = 1
    order = sorted(range(7), key=lambda i: (-m[i].sum(), i))
    s = m[order]
    bad = sum((s[i + 1 :, j] == 0).sum() for i in range(7) for j in range(9) if s[i, j])
    assert nw.nestedness(matrix(spark, m)).first().violations == bad


def test_communities(spark):
    for blocks in (2, 3):
        e = rd.block_network(spark, 10 * blocks, 8 * blocks, blocks)
        got = {r.row_id: r.community for r in cm.detect_communities(e).collect()}
        assert [got[f"r{i:04d}"] for i in range(10 * blocks)] == [i // 10 for i in range(10 * blocks)]
    noisy = rd.block_network(spark, 20, 16, 2, 1.0, 0.12)
    got = {r.row_id: r.community for r in cm.detect_communities(noisy).collect()}
    assert len({got[f"r{i:04d}"] for i in range(10)}) == 1 and len(set(got.values())) == 2
    labels = spark.createDataFrame([(k, v) for k, v in got.items()], "row_id string, community int")
    phi = nw.conductance(noisy, labels).collect()
    assert all(0 < r.conductance < 0.5 and math.isclose(r.lower_bound, r.conductance**2 / 2) for r in phi)
    p = cm.eigengap_null_model(noisy, 19).first()
    assert 0 <= p.p_value <= 1 and p.observed > 1
    assert cm.global_vs_local(noisy, labels).first().communities == 2


def test_circles_and_elongated_kmeans(spark):
    # Even angles, as in the published case: random ones leave gaps that split a circle.
    a, noise = 2 * np.pi * np.arange(100) / 100, 0.1 * np.random.RandomState(7).randn(100)
    x = np.vstack([(r + noise)[:, None] * np.c_[np.cos(a), np.sin(a)] for r in (1, 2, 3)])
    label = cm.cluster_points(x, math.sqrt(0.05))
    assert len(set(label)) == 3 and all(len(set(label[100 * k : 100 * k + 100])) == 1 for k in range(3))
    sampled = np.r_[0:300:5]
    circles = spark.createDataFrame([(int(i), x[i].tolist(), int(i) // 100) for i in sampled], "id int, features array<double>, class int")
    own = cm.SpectralCluster(math.sqrt(0.05)).fit_predict(circles)
    few = cm.cluster_points(x[sampled], math.sqrt(0.05)).tolist()
    order = {v: i for i, v in enumerate(dict.fromkeys(few))}
    assert {r.id: r.community for r in own.collect()} == {int(i): order[v] for i, v in zip(sampled, few, strict=True)}
    rays = [(i, [math.cos(0.5 * (i % 3)) * (1 + i / 30), math.sin(0.5 * (i % 3)) * (1 + i / 30), 0.01 * i]) for i in range(30)]
    there = cm.origin_detector(np.array([v for _, v in rays]), max_k=3).tolist()
    assert [r.label for r in cm.origin_labels(spark.createDataFrame(rays, "id int, features array<double>"), 3, max_k=3).orderBy("id").collect()] == there
    pts = spark.createDataFrame([(i, [float(i % 2) * 3 + 1, 0.1 * (i % 5)]) for i in range(40)], "id int, features array<double>")
    km = cm.ElongatedKMeans([[1.0, 0.0], [4.0, 0.1]]).fit(pts)
    assert {(r.id % 2, r.label) for r in km.predict(pts).collect()} == {(0, 0), (1, 1)}


def test_reports(spark):
    s = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None), ("d", 3.0)], "id string, score double")
    assert [r.id for r in rp.ranked(s).orderBy("rank").collect()] == ["a", "d", "b", "c"]
    old = spark.createDataFrame([("a", 1.0), ("x", 2.0)], "id string, score double")
    both = {r.id: r for r in rp.compared(old, s).collect()}
    assert both["x"].new_rank == 999 and both["a"].rank_change == 1 and both["a"].change_pct == 200.0
    xy = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (None, 1.0)], "x double, y double")
    r = rp.correlations(xy, "x", "y").first()
    assert r.n == 3 and math.isclose(r.pearson, np.corrcoef([1, 2, 3], [2, 2, 5])[0, 1]) and math.isclose(r.spearman, np.corrcoef([1, 2, 3], [1.5, 1.5, 3])[0, 1])
    assert math.isclose(rp.correlation_p_value(0.5, 10), 0.1411, abs_tol=2e-4) and rp.correlation_p_value(-0.9, 12) < 1e-3
    h = rp.histogram(xy, "x", 2).collect()
    assert sorted((b.bin, b.n) for b in h) == [(0, 1), (1, 2)]
    e = matrix(spark, BANDED)
    with pytest.raises(ValueError):
        rp.top_subset(e, by="fitness_complexity")
    assert rp.top_subset(e, 2, 2).count() == 4
    spans = sorted(rp.alluvial_spans(e, "row_id").collect(), key=lambda r: r.lo)
    assert math.isclose(spans[-1].hi, 1) and all(p.hi < q.lo for p, q in zip(spans, spans[1:], strict=False))


def test_text(spark):
    d = spark.createDataFrame([("ann", "The cat /* x */ sat, cat"), ("ann", "<b>dog</b>"), ("helper_bot", "beep beep"), ("bob", None)], "author string, body string")
    counts = {(r.author, r.word): r.n for r in tx.word_counts(d, "author", "body").collect()}
    assert counts["ann", "cat"] == 2 and ("ann", "the") not in counts
    q = rd.CommentQuery(min_comments=1, min_length=2)
    b = rd.CommentLoader(d, q).load()
    assert {r.row_id for r in b.edges.collect()} == {"ann"} and b.metadata["source"] == "comments"
    assert tx.longest_texts(d, "author", "body", 1).where("author = 'ann'").first().user_text.startswith("The cat")


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("country_iso3_code,product_hs92_code,year,export_value\nAAA,0101,2000,5\nAAA,0102,2000,1\nBBB,0101,2000,1\nBBB,0202,2000,9\nBBB,0202,1999,3\nCCC,0303,2000,0\n")
    raw = rd.read_trade_csv(spark, str(tmp_path / "t.csv"))
    facts = {(r.row_id, r.col_id): r.w for r in rd.trade_facts(raw, 2000, 2).collect()}
    assert facts == {("AAA", "01"): 6.0, ("BBB", "01"): 1.0, ("BBB", "02"): 9.0}
    assert rd.available_years(raw) == [1999, 2000]
    with pytest.raises(ValueError, match="1999"):
        rd.trade_facts(raw, 1980)
    with pytest.raises(ValueError, match="no column"):
        rd.resolve(raw.drop("year"), "year")
    names = spark.createDataFrame([("01", "horses")], "id string, name string")
    out = rd.load_trade(raw, 2000, 2, names=names)
    assert {r.id: r.name for r in out.cols.collect()} == {"01": "horses", "02": "Unknown"}
    (tmp_path / "i.json").write_text('[{"page":1},[{"countryiso3code":"AAA","country":{"id":"A","value":"Aland"},"date":"2001","value":1.5},{"countryiso3code":"AAA","country":{"id":"A","value":"Aland"},"date":"2001","value":2.5},{"countryiso3code":"BBB","country":{"id":"B","value":"Bland"},"date":"2002","value":null},{"countryiso3code":"WLD","country":{"id":"W","value":"World"},"date":"2002","value":7}]]')
    ind = rd.read_indicator_json(spark, str(tmp_path / "i.json"))
    assert sorted((r.country_code, r.year, r.value) for r in ind.collect()) == [("AAA", 2001, 2.5), ("WLD", 2002, 7.0)]
    assert rd.without_aggregates(ind).count() == 1
    assert rd.indicator_long(rd.indicator_wide(ind, [2001, 2002])).count() == 2
    assert [r[0] for r in rd.missing_codes(ind, ["AAA", "ZZZ"]).collect()] == ["ZZZ"]
    assert rd.select_series(ind, ["AAA"], 2000, 2001).count() == 1
    sinks.write_bundle(rd.small_fixture(spark), str(tmp_path / "b"))
    back = sinks.read_bundle(spark, str(tmp_path / "b"))
    assert same_edges(back.edges, rd.small_fixture(spark).edges).first().equal and back.metadata["source"] == "fixture"


def test_generators(spark):
    assert rd.nested_network(spark, 20, 30).count() == sum(min(30, (i + 1) * 30 // 20 + 5) for i in range(20))
    r = rd.random_network(spark, 40, 50, 0.3)
    assert 450 < r.count() < 750 and same_edges(r, rd.random_network(spark, 40, 50, 0.3)).first().equal
    assert 0.7 < rd.remove_edges(r, 0.2).count() / r.count() < 0.9
    assert rd.path_network(spark, 6).count() == 12 and rd.core_periphery_network(spark, 20, 20).count() > 0
    grown = rd.add_shortcuts(rd.nested_network(spark, 20, 30), 1.0)
    assert grown.count() > rd.nested_network(spark, 20, 30).count() and grown.groupBy("row_id", "col_id").count().where("count > 1").count() == 0


def test_skip_sampling_gives_the_stated_chances(spark):
    """Degrees and blocks of generated edges against their chances, within five standard deviations."""

    def share(df, lo, hi, a, b):
        i, j = F.substring("row_id", 2, 9).cast("int"), F.substring("col_id", 2, 9).cast("int")
        return df.where(i.between(lo, hi - 1) & j.between(a, b - 1)).count() / ((hi - lo) * (b - a))

    near = lambda x, p, n: abs(x - p) <= 5 * math.sqrt(p * (1 - p) / n) + 1e-12
    r = rd.random_network(spark, 200, 300, 0.1)
    assert near(share(r, 0, 200, 0, 300), 0.1, 60_000)
    k = [x.k for x in r.groupBy("row_id").agg(F.count(F.lit(1)).alias("k")).collect()]
    assert abs(np.mean(k) - 30) < 2 and abs(np.var(k) - 27) < 14  # binomial
    cols = [x.k for x in r.groupBy("col_id").agg(F.count(F.lit(1)).alias("k")).collect()]
    assert len(cols) == 300 and abs(np.var(cols) - 18) < 8
    b = rd.block_network(spark, 90, 120, 3, 0.6, 0.02)
    assert near(share(b, 0, 30, 0, 40), 0.6, 1200) and near(share(b, 30, 60, 80, 120), 0.02, 1200)
    whole = rd.block_network(spark, 8, 8, 2)
    assert whole.count() == 32 and share(whole, 0, 4, 0, 4) == 1
    c = rd.core_periphery_network(spark, 100, 100)
    assert near(share(c, 0, 30, 0, 30), 0.9, 900) and near(share(c, 0, 30, 30, 100), 0.4, 2100) and near(share(c, 30, 100, 30, 100), 0.05, 4900)
    m = {(x.row_id, x.col_id) for x in rd.multi_scale_network(spark, 30, 60, 3, 0.0).collect()}
    assert m == {(f"r{i:04d}", f"c{j:04d}") for i in range(30) for j in range(60) if i // 10 == j // 20 and j <= 2 * i + 4}
    s = rd.smooth_network(spark, 100, 100, 0.2)
    assert near(share(s, 0, 100, 0, 100), np.mean([[math.exp(-(((i - j) / 99) ** 2) / 0.08) for j in range(100)] for i in range(100)]), 10_000)
    assert same_edges(s, rd.smooth_network(spark, 100, 100, 0.2)).first().equal


def test_quantiles(spark):
    rng = random.Random(2)
    for values in ([rng.gauss(0, 1) for _ in range(501)], [1.0] * 90 + [2.0] * 10, [3.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = quantiles(df, "v", [0.0, 0.3, 0.5, 0.99, 1.0], list("abcde"))
        assert np.allclose(list(got.first()), np.quantile(values, [0.0, 0.3, 0.5, 0.99, 1.0]), atol=1e-12)
    assert list(quantiles(df.where("v IS NULL"), "v", [0.5], ["a"]).first()) == [None]
    d = rp.describe(df, "v", {"half": 0.5}).first()
    assert (d.n, d.mean, d.least, d.half, d.most) == (2, 1.5, 1.0, 1.5, 2.0)


def test_masks_and_places(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert StopWordsRemover.loadDefaultStopWords("english") == tx.STOP_WORDS
    df = spark.createDataFrame([("a", 10.0, 1.0), ("b", 0.0, 2.0), ("c", -1.0, None), ("d", None, 3.0), ("e", float("nan"), 4.0), ("f", 100.0, float("inf"))], "id string, x double, y double")
    assert [(r.id, r.l) for r in rp.positive_log(df, "x", "l").orderBy("id").collect()] == [("a", 1.0), ("f", 2.0)]
    assert [r.id for r in rp.complete(df, ["x", "y"]).orderBy("id").collect()] == ["a", "b"]
    assert {r.id: r.place for r in rp.places(df.where("x > -5 AND NOT isnan(x)"), "x").collect()} == {"f": 0, "a": 1, "b": 2, "c": 3}
    flow = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 1e-17)], EDGES)
    assert [r.col_id for r in rp.on_support(flow, spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.0)], EDGES)).collect()] == ["x"]


def test_range_join(spark):
    """Equal to brute force, with repeated points, two lengths and odd rows; far points aren't compared."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 20, (40, 3))
    x = np.vstack([c + rng.normal(0, 0.5, (60, 3)) for c in centres] + [np.tile(centres[0], (30, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [1.0, None, 0.0]), (-3, [0.0, 0.0]), (-4, [0.1, 0.0]), (5, x[5].tolist())]
    p = spark.createDataFrame(rows, "id int, features array<double>")
    for radius in (0.4, 2.5):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(metric, "POINTS_PER_PIVOT", 50)
            patch.setattr(metric, "BLOCK_POINTS", 40)
            got = sorted((min(r.a, r.b), max(r.a, r.b)) for r in metric.near_pairs(p, radius).collect())
            formed = metric.pairs_formed(p, radius)
        good = [(i, np.array(v)) for i, v in rows if v is not None and None not in v]
        want = sorted((min(i, j), max(i, j)) for n, (i, v) in enumerate(good) for j, w in good[:n] if len(v) == len(w) and math.sqrt(((v - w) ** 2).sum()) <= radius)
        assert got == want and len(want) > 500
        assert formed < 0.25 * len(good) ** 2  # of the ordered pairs
    with pytest.raises(ValueError):
        metric.near_pairs(p, 0.0)


def test_model(spark):
    raw = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), (None, "x", 1.0), ("b", "y", 0.0)], "r string, c string, v double")
    assert [tuple(r) for r in edges_of(raw, "r", "c", "v").collect()] == [("a", "x", 3.0)]
    labels = [f"k{random.Random(i).randrange(1000):03d}" for i in range(200)]
    d = dimension(spark.createDataFrame([(x,) for x in labels], "l string"), "l")
    assert [(r.idx, r.id) for r in d.orderBy("idx").collect()] == list(enumerate(sorted(set(labels))))
    assert bundle(matrix(spark, BANDED), "test").metadata["source"] == "test"


def test_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = margins.running_edges(stream, "user_id", "event_type").writeStream.outputMode("complete").format("memory").queryName("live_edges").start()
    q.processAllAvailable()
    q.stop()
    want = edges_of(events, "user_id", "event_type")
    assert same_edges(spark.table("live_edges"), want).first().equal
    w = margins.windowed_margin(events, "ts", "event_type", "1 day", "1 hour")
    assert w.agg(F.sum("n")).first()[0] == events.where("event_type IS NOT NULL").count()
