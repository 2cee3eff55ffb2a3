"""Queries over the driver's tables by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartrix.functions import text as tx
from bipartrix.model import dimension, edges_of, same_edges, transposed
from bipartrix.operators import community as cm
from bipartrix.operators import eci as ec
from bipartrix.operators import fitness as ft
from bipartrix.operators import grid as gr
from bipartrix.operators import network as nw
from bipartrix.operators import reports as rp
from bipartrix.operators import sinkhorn as sk
from bipartrix.sources import readers as rd

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- the tables as networks ----------------------------------------------------------


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Line items with supplier, nation and part; value = price after discount."""
    li = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    s = t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))


def trade(spark: SparkSession, d: str, row: str = "n_name") -> DataFrame:
    return edges_of(sales(spark, d), row, "p_brand", "value")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Nations and the brands in which they have a comparative advantage."""
    return nw.rca_edges(trade(spark, d))


def supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    return nw.rca_edges(trade(spark, d, "s_name"))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(t(spark, d, "events"), "user_id", "event_type")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """(id, year, value): nations' sales by year."""
    return sales(spark, d).groupBy(F.col("n_name").alias("id"), F.year("l_shipdate").alias("year")).agg(F.sum("value").alias("value"))


def rounded(df: DataFrame, places: int = 6, **columns: int) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, columns.get(c, places)) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def side(df: DataFrame, which: str, name: str, score: str = "score") -> DataFrame:
    return df.where(F.col("side") == which).select("id", F.col(score).alias(name))


SALES = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"
VALUE = "l_extendedprice * (1 - l_discount)"


def facts_sql(row: str = "n_name") -> str:
    return f"SELECT {row} r, p_brand p, sum({VALUE}) v FROM {SALES} GROUP BY 1, 2"


def m_sql(row: str = "n_name") -> str:
    """CTEs: facts f and binary edges m."""
    return f"f AS ({facts_sql(row)}), m AS (SELECT r, p FROM (SELECT *, (v / sum(v) OVER (PARTITION BY r)) / (sum(v) OVER (PARTITION BY p) / sum(v) OVER ()) x FROM f) WHERE x >= 1)"


# --- facts, advantage, margins --------------------------------------------------------


@query("trade_facts", f"SELECT r AS row_id, p AS col_id, round(v, 4) AS w FROM ({facts_sql()})")
def trade_facts(spark, d):
    return rounded(trade(spark, d), 4)


@query("group_export_totals", f"SELECT n_name, round(sum({VALUE}), 4) AS total, count(*) AS items FROM {SALES} GROUP BY 1")
def group_export_totals(spark, d):
    return sales(spark, d).groupBy("n_name").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("items"))


@query("rca_values", f"WITH {m_sql()} SELECT r AS row_id, p AS col_id, round((v / sum(v) OVER (PARTITION BY r)) / (sum(v) OVER (PARTITION BY p) / sum(v) OVER ()), 6) AS rca FROM f")
def rca_values(spark, d):
    return rounded(nw.rca(trade(spark, d)).select("row_id", "col_id", "rca"))


@query("rca_binary_edges", f"WITH {m_sql()} SELECT r AS row_id, p AS col_id, 1.0::DOUBLE AS w FROM m")
def rca_binary_edges(spark, d):
    return flagship(spark, d)


@query("rca_supplier_edges", f"WITH {m_sql('s_name')} SELECT r AS row_id, p AS col_id, 1.0::DOUBLE AS w FROM m")
def rca_supplier_edges(spark, d):
    return supplier_edges(spark, d)


@query("product_level_rollup", f"SELECT n_name AS row_id, substr(p_name, 1, 4) AS col_id, round(sum({VALUE}), 4) AS w FROM {SALES} GROUP BY 1, 2 HAVING sum({VALUE}) > 0")
def product_level_rollup(spark, d):
    s = sales(spark, d).withColumn("p4", F.substring("p_name", 1, 4))
    return rounded(edges_of(s, "n_name", "p4", "value").where("w > 0"), 4)


@query("year_filter_facts", f"SELECT n_name AS row_id, p_brand AS col_id, round(sum({VALUE}), 4) AS w FROM {SALES} WHERE year(l_shipdate) = 1997 GROUP BY 1, 2 HAVING sum({VALUE}) > 0")
def year_filter_facts(spark, d):
    facts = sales(spark, d).select(F.col("n_name").alias("country_iso3_code"), F.regexp_extract("p_brand", r"(\d+)$", 1).alias("b"), F.col("p_brand").alias("hs_product_code"), F.year("l_shipdate").alias("year"), F.col("value").alias("export_value"))
    own = rd.resolve(facts, "location_code", "product_code", "year", "value").where("year = 1997")
    return rounded(edges_of(own, "location_code", "product_code", "value").where("w > 0"), 4)


@query("available_years", "SELECT DISTINCT year(l_shipdate)::INT AS year FROM lineitem")
def available_years(spark, d):
    return t(spark, d, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()


@query("dim_rows", f"WITH {m_sql()} SELECT (dense_rank() OVER (ORDER BY r) - 1)::INT AS idx, r AS id FROM (SELECT DISTINCT r FROM f)")
def dim_rows(spark, d):
    return dimension(trade(spark, d), "row_id")


@query("dim_cols", f"WITH {m_sql()} SELECT (dense_rank() OVER (ORDER BY p) - 1)::INT AS idx, p AS id FROM (SELECT DISTINCT p FROM f)")
def dim_cols(spark, d):
    return dimension(trade(spark, d), "col_id")


@query("degree_diversification", f"WITH {m_sql()} SELECT r AS id, count(*) AS degree, count(*)::DOUBLE AS strength FROM m GROUP BY 1")
def degree_diversification(spark, d):
    return nw.margin(flagship(spark, d), "row_id")


@query("degree_ubiquity", f"WITH {m_sql()} SELECT p AS id, count(*) AS degree, count(*)::DOUBLE AS strength FROM m GROUP BY 1")
def degree_ubiquity(spark, d):
    return nw.margin(flagship(spark, d), "col_id")


@query("matrix_density", f"WITH {m_sql('s_name')} SELECT count(DISTINCT r) AS n_rows, count(DISTINCT p) AS n_cols, count(*) AS nnz, round(count(*) / (count(DISTINCT r) * count(DISTINCT p)), 6) AS density FROM m")
def matrix_density(spark, d):
    return rounded(nw.density(supplier_edges(spark, d)))


@query("binarise_counts", "SELECT DISTINCT user_id::VARCHAR AS row_id, event_type AS col_id, 1.0::DOUBLE AS w FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def binarise_counts(spark, d):
    return nw.binarise(event_counts(spark, d))


EV = "e AS (SELECT user_id::VARCHAR r, event_type p, count(*)::DOUBLE w FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2)"


@query("mass_filter", f"WITH {EV} SELECT r AS row_id, p AS col_id, w FROM e WHERE r IN (SELECT r FROM e GROUP BY r HAVING sum(w) >= 6) AND p IN (SELECT p FROM e GROUP BY p HAVING sum(w) >= 100)")
def mass_filter(spark, d):
    return nw.mass_filter(event_counts(spark, d), 6, 100)


@query("degree_filter_once", f"WITH {m_sql('s_name')}, a AS (SELECT * FROM m WHERE r IN (SELECT r FROM m GROUP BY r HAVING count(*) >= 11)) SELECT r AS row_id, p AS col_id, 1.0::DOUBLE AS w FROM a WHERE p IN (SELECT p FROM a GROUP BY p HAVING count(*) >= 20)")
def degree_filter_once(spark, d):
    return nw.degree_filter(supplier_edges(spark, d), 11, 20, iterative=False)


def _rounds(n: int, rows: int, cols: int) -> str:
    """CTEs a1..an: the filter unrolled."""
    out, last = [], "m"
    for i in range(1, n + 1):
        out.append(f"b{i} AS (SELECT * FROM {last} WHERE r IN (SELECT r FROM {last} GROUP BY r HAVING count(*) >= {rows})), a{i} AS (SELECT * FROM b{i} WHERE p IN (SELECT p FROM b{i} GROUP BY p HAVING count(*) >= {cols}))")
        last = f"a{i}"
    return ", ".join(out)


@query("degree_filter_iterative", f"WITH {m_sql('s_name')}, {_rounds(12, 11, 20)} SELECT r AS row_id, p AS col_id, 1.0::DOUBLE AS w FROM a12")
def degree_filter_iterative(spark, d):
    return nw.degree_filter(supplier_edges(spark, d), 11, 20)


PARTS = f"SELECT DISTINCT s_name r, p_partkey::VARCHAR p FROM {SALES}"


@query("unique_columns", f"WITH g AS ({PARTS}) SELECT r AS row_id, p AS col_id FROM g WHERE p IN (SELECT p FROM g GROUP BY 1 HAVING count(*) = 1)")
def unique_columns(spark, d):
    return nw.unique_cols(edges_of(sales(spark, d), "s_name", "p_partkey"))


def _same(cond: str) -> str:
    g = f"SELECT DISTINCT s_name r, p_brand p FROM {SALES} WHERE {cond}"
    return f"(NOT EXISTS ({g.format(y=1995)} EXCEPT {g.format(y=2000)}) AND NOT EXISTS ({g.format(y=2000)} EXCEPT {g.format(y=1995)}))"


@query("edges_equal", f"SELECT 'suppliers' AS network, {_same('year(l_shipdate) = {y}')} AS equal UNION ALL SELECT 'turned twice', {_same('{y} > 0')}")
def edges_equal(spark, d):
    """Whether two years' supplier-brand pairs are the same, and those of all years and their transpose's transpose."""
    s = sales(spark, d).withColumn("year", F.year("l_shipdate"))
    pairs = lambda df: nw.binarise(edges_of(df, "s_name", "p_brand"))
    every = pairs(s)
    two = same_edges(pairs(s.where("year = 1995")), pairs(s.where("year = 2000"))).select(F.lit("suppliers").alias("network"), "equal")
    return two.unionByName(same_edges(every, transposed(transposed(every))).select(F.lit("turned twice").alias("network"), "equal"))


# --- fixed-point solvers --------------------------------------------------------------

N_FC = 50


def fc_sql(n: int, edges: str = "m") -> str:
    """CTEs: q after each iteration (it), and the fitness that gave the last (fit)."""
    return f"""it AS (SELECT 0 i, p, 1.0::DOUBLE q FROM (SELECT DISTINCT p FROM {edges}) UNION ALL
 SELECT i + 1, p, q / avg(q) OVER () q FROM (SELECT i, x.p, 1 / greatest(sum(1 / f), 1e-12) q FROM {edges} x JOIN (
  SELECT i, r, f / avg(f) OVER () f FROM (SELECT i, y.r, greatest(sum(q), 1e-12) f FROM {edges} y JOIN it USING (p) WHERE i < {n} GROUP BY 1, 2)) USING (r) GROUP BY 1, 2)),
fit AS (SELECT r, f / avg(f) OVER () f FROM (SELECT y.r, greatest(sum(q), 1e-12) f FROM {edges} y JOIN it USING (p) WHERE i = {n} - 1 GROUP BY 1))"""


@query("fc_fitness", f"WITH RECURSIVE {m_sql()}, {fc_sql(N_FC)} SELECT r AS id, round(f, 6) AS fitness FROM fit")
def fc_fitness(spark, d):
    return rounded(side(ft.fitness_scores(flagship(spark, d), N_FC, 0.0), "row", "fitness"))


@query("fc_complexity", f"WITH RECURSIVE {m_sql()}, {fc_sql(N_FC)} SELECT p AS id, round(q, 6) AS complexity FROM it WHERE i = {N_FC}")
def fc_complexity(spark, d):
    return rounded(side(ft.fitness_scores(flagship(spark, d), N_FC, 0.0), "col", "complexity"))


@query("fc_supplier_fitness", f"WITH RECURSIVE {m_sql('s_name')}, {fc_sql(N_FC)} SELECT r AS id, round(f, 6) AS fitness FROM fit")
def fc_supplier_fitness(spark, d):
    return rounded(side(ft.fitness_scores(supplier_edges(spark, d), N_FC, 0.0), "row", "fitness"))


@query("fc_by_joins", f"WITH RECURSIVE {m_sql()}, {fc_sql(N_FC)} SELECT r AS id, round(f, 6) AS fitness FROM fit")
def fc_by_joins(spark, d):
    """The network laid out as cells that half-turns ship blocks to, as if it were a large one."""
    with gr.spread_out():
        return rounded(side(ft.fitness_scores(flagship(spark, d), N_FC, 0.0), "row", "fitness"))


@query("fc_history", f"WITH RECURSIVE {m_sql()}, {fc_sql(20)} SELECT i::INT AS iter, round(max(abs(q - o)), 6) AS d_col FROM (SELECT i, q, lag(q) OVER (PARTITION BY p ORDER BY i) o FROM it) WHERE i > 0 GROUP BY 1")
def fc_history(spark, d):
    return rounded(ft.fitness_history(flagship(spark, d), 20, 0.0).select("iter", "d_col"))


@query("fc_filtered_with_nulls", f"WITH RECURSIVE {m_sql('s_name')}, {_rounds(12, 11, 20)}, {fc_sql(N_FC, 'a12')} SELECT id, round(f, 6) AS score, f IS NOT NULL AS kept FROM (SELECT DISTINCT r AS id FROM m) LEFT JOIN fit ON r = id")
def fc_filtered_with_nulls(spark, d):
    return rounded(ft.FitnessComplexity(N_FC, 0.0, 20, 11).fit(supplier_edges(spark, d)).fitness)


PANEL_M = f"""g AS (SELECT year(l_shipdate)::INT y, n_name r, p_brand p, sum({VALUE}) v FROM {SALES} GROUP BY 1, 2, 3),
h AS (SELECT y, r, p FROM (SELECT *, (v / sum(v) OVER (PARTITION BY y, r)) / (sum(v) OVER (PARTITION BY y, p) / sum(v) OVER (PARTITION BY y)) x FROM g) WHERE x >= 1)"""


@query("fc_by_year", f"""WITH RECURSIVE {PANEL_M}, it AS (SELECT 0 i, y, p, 1.0::DOUBLE q FROM (SELECT DISTINCT y, p FROM h) UNION ALL
 SELECT i + 1, y, p, q / avg(q) OVER (PARTITION BY y) FROM (SELECT i, h.y, h.p, 1 / greatest(sum(1 / f), 1e-12) q FROM h JOIN (
  SELECT i, y, r, f / avg(f) OVER (PARTITION BY y) f FROM (SELECT i, h.y, h.r, greatest(sum(q), 1e-12) f FROM h JOIN it ON it.p = h.p AND it.y = h.y WHERE i < 20 GROUP BY 1, 2, 3)) z ON z.r = h.r AND z.y = h.y GROUP BY 1, 2, 3))
SELECT y AS year, p AS id, round(q, 6) AS complexity FROM it WHERE i = 20""")
def fc_by_year(spark, d):
    """The years' networks are solved side by side."""
    s = sales(spark, d).withColumn("year", F.year("l_shipdate"))
    v = s.groupBy("year", F.col("n_name").alias("row_id"), F.col("p_brand").alias("col_id")).agg(F.sum("value").alias("w"))
    rows, cols = v.groupBy("year", "row_id").agg(F.sum("w").alias("wr")), v.groupBy("year", "col_id").agg(F.sum("w").alias("wc"))
    whole = rows.groupBy("year").agg(F.sum("wr").alias("wa"))
    e = v.join(rows, ["year", "row_id"]).join(cols, ["year", "col_id"]).join(whole, "year").where((F.col("w") / F.col("wr")) / (F.col("wc") / F.col("wa")) >= 1)
    out = ft.fitness_scores(e.select("year", "row_id", "col_id", F.lit(1.0).alias("w")), 20, 0.0, by=["year"])
    return rounded(out.where("side = 'col'").select("year", "id", F.col("score").alias("complexity")))


def sk_sql(n: int, target_r: str, target_c: str) -> str:
    return f"""k AS (SELECT (SELECT count(DISTINCT r) FROM m)::DOUBLE nr, (SELECT count(DISTINCT p) FROM m)::DOUBLE nc, (SELECT count(*) FROM m)::DOUBLE nn),
kr AS (SELECT r, count(*)::DOUBLE d FROM m GROUP BY 1), kp AS (SELECT p, count(*)::DOUBLE d FROM m GROUP BY 1),
tr AS (SELECT r, {target_r} t FROM kr, k), tc AS (SELECT p, {target_c} t FROM kp, k),
it AS (SELECT 0 i, p, 1.0::DOUBLE v FROM kp UNION ALL
 SELECT u.i + 1, m.p, any_value(tc.t) / greatest(sum(u.u), 1e-30) FROM (
  SELECT it.i, m.r, any_value(tr.t) / greatest(sum(it.v), 1e-30) u FROM m JOIN it USING (p) JOIN tr USING (r) WHERE it.i < {n} GROUP BY 1, 2) u
  JOIN m USING (r) JOIN tc ON tc.p = m.p GROUP BY u.i, m.p),
us AS (SELECT m.r, any_value(tr.t) / greatest(sum(it.v), 1e-30) u FROM m JOIN it USING (p) JOIN tr USING (r) WHERE it.i = {n} - 1 GROUP BY 1)"""


UNIFORM, DEGREE = ("1 / nr", "1 / nc"), ("d / nn", "d / nn")
FLOW = "SELECT m.r AS row_id, m.p AS col_id, round(us.u * it.v, 9) AS w_scaled FROM m JOIN us USING (r) JOIN it ON it.p = m.p WHERE it.i = 200"


@query("sinkhorn_uniform", f"WITH RECURSIVE {m_sql()}, {sk_sql(200, *UNIFORM)} {FLOW}")
def sinkhorn_uniform(spark, d):
    return rounded(sk.SinkhornScaler().fit_transform(flagship(spark, d)).select("row_id", "col_id", "w_scaled"), 9)


@query("sinkhorn_degree", f"WITH RECURSIVE {m_sql()}, {sk_sql(200, *DEGREE)} {FLOW}")
def sinkhorn_degree(spark, d):
    return rounded(sk.SinkhornScaler(margins="degree").fit_transform(flagship(spark, d)).select("row_id", "col_id", "w_scaled"), 9)


@query("sinkhorn_by_joins", f"WITH RECURSIVE {m_sql()}, {sk_sql(200, *UNIFORM)} {FLOW}")
def sinkhorn_by_joins(spark, d):
    """The network laid out as cells, as if it were a large one; until the margins are met."""
    with gr.spread_out():
        return rounded(sk.SinkhornScaler().fit_transform(flagship(spark, d)).select("row_id", "col_id", "w_scaled"), 9)


@query("sinkhorn_marginals", f"WITH RECURSIVE {m_sql()}, {sk_sql(200, *UNIFORM)} SELECT r AS id, round(sum(us.u * it.v), 6) AS mass FROM m JOIN us USING (r) JOIN it ON it.p = m.p WHERE it.i = 200 GROUP BY 1")
def sinkhorn_marginals(spark, d):
    w = sk.SinkhornScaler().fit_transform(flagship(spark, d))
    return rounded(w.groupBy(F.col("row_id").alias("id")).agg(F.sum("w_scaled").alias("mass")))


@query("fc_sinkhorn_flow", f"WITH RECURSIVE {m_sql()}, {fc_sql(N_FC)} SELECT m.r AS row_id, m.p AS col_id, round(it.q / fit.f, 6) AS w_scaled FROM m JOIN fit USING (r) JOIN it ON it.p = m.p WHERE it.i = {N_FC}")
def fc_sinkhorn_flow(spark, d):
    e = flagship(spark, d)
    return rounded(sk.fitness_flow(e, ft.fitness_scores(e, N_FC, 0.0)).select("row_id", "col_id", "w_scaled"))


def eci_sql(n: int = 300) -> str:
    return f"""kc AS (SELECT r, count(*)::DOUBLE k FROM m GROUP BY 1), kp AS (SELECT p, count(*)::DOUBLE k FROM m GROUP BY 1),
it AS (SELECT 0 i, r, k c FROM kc UNION ALL
 SELECT i + 1, r, c / sqrt(sum(c * c) OVER ()) c FROM (SELECT i, r, c - sum(k * c) OVER () / sum(k) OVER () c FROM (
  SELECT s.i, m.r, any_value(kc.k) k, sum(s.d) / any_value(kc.k) c FROM m JOIN (
   SELECT it.i, m.p, sum(it.c) / any_value(kp.k) d FROM m JOIN it USING (r) JOIN kp USING (p) WHERE it.i < {n} GROUP BY 1, 2) s USING (p)
  JOIN kc USING (r) GROUP BY 1, 2))),
e AS (SELECT r, c * CASE WHEN corr(c, k) OVER () < 0 THEN -1 ELSE 1 END c FROM it JOIN kc USING (r) WHERE i = {n})"""


@query("eci", f"WITH RECURSIVE {m_sql()}, {eci_sql()} SELECT r AS id, round((c - avg(c) OVER ()) / stddev_pop(c) OVER (), 6) + 0.0 AS eci FROM e")
def eci(spark, d):
    return rounded(side(ec.eci_scores(flagship(spark, d)), "row", "eci"))


@query("pci", f"WITH RECURSIVE {m_sql()}, {eci_sql()}, z AS (SELECT p, avg(c) x FROM m JOIN e USING (r) GROUP BY 1) SELECT p AS id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) + 0.0 AS pci FROM z")
def pci(spark, d):
    return rounded(side(ec.eci_scores(flagship(spark, d)), "col", "pci"))


def _reflections(n: int) -> None:
    sql = f"""WITH RECURSIVE {m_sql()}, kc AS (SELECT r, count(*)::DOUBLE d FROM m GROUP BY 1), kp AS (SELECT p, count(*)::DOUBLE d FROM m GROUP BY 1),
it AS (SELECT 0 i, p, d k FROM kp UNION ALL SELECT c.i + 1, m.p, sum(c.k) / any_value(kp.d) FROM (
 SELECT it.i, m.r, sum(it.k) / any_value(kc.d) k FROM m JOIN it USING (p) JOIN kc USING (r) WHERE it.i < {n} GROUP BY 1, 2) c JOIN m USING (r) JOIN kp USING (p) GROUP BY c.i, m.p)
SELECT p AS id, round(k, 6) AS k_n FROM it WHERE i = {n}"""

    @query(f"eci_reflections_{n}", sql)
    def run(spark, d):
        return rounded(side(ec.reflections(flagship(spark, d), n, None, check_gap=False), "col", "k_n", "k_n"))


_reflections(2)
_reflections(10)


# --- spectra and communities ----------------------------------------------------------


@query("projection_matrix", f"WITH {m_sql()}, kc AS (SELECT r, count(*)::DOUBLE k FROM m GROUP BY 1), kp AS (SELECT p, count(*)::DOUBLE k FROM m GROUP BY 1) SELECT a.r AS r1, b.r AS r2, round(sum(1 / kc.k / kp.k), 6) AS t FROM m a JOIN m b USING (p) JOIN kp USING (p) JOIN kc ON kc.r = a.r GROUP BY 1, 2")
def projection_matrix(spark, d):
    return rounded(nw.projection(flagship(spark, d)))


def lambda_sql(n: int = 300) -> str:
    """CTEs after eci_sql(): l2 and l3, lengths that the walk leaves of its second and third direction."""
    step = "SELECT m.r, any_value(kc.k) k, sum(s.d) / any_value(kc.k) c FROM m JOIN (SELECT m.p, sum({v}.c) / any_value(kp.k) d FROM m JOIN {v} USING (r) JOIN kp USING (p) GROUP BY 1) s USING (p) JOIN kc USING (r) GROUP BY 1"
    return f"""v2 AS (SELECT r, c, k FROM it JOIN kc USING (r) WHERE i = {n}), w2 AS ({step.format(v="v2")}), l2 AS (SELECT sqrt(sum(c * c)) x FROM w2),
jt AS (SELECT 0 i, r, sin(row_number() OVER (ORDER BY r)) c FROM kc UNION ALL
 SELECT i + 1, r, c / sqrt(sum(c * c) OVER ()) c FROM (SELECT i, q.r, q.c - sum(q.k * q.c) OVER () / sum(q.k) OVER () - v2.c * sum(q.k * q.c * v2.c) OVER () / sum(q.k * v2.c * v2.c) OVER () c FROM (
  SELECT s.i, m.r, any_value(kc.k) k, sum(s.d) / any_value(kc.k) c FROM m JOIN (
   SELECT jt.i, m.p, sum(jt.c) / any_value(kp.k) d FROM m JOIN jt USING (r) JOIN kp USING (p) WHERE jt.i < {n} GROUP BY 1, 2) s USING (p)
  JOIN kc USING (r) GROUP BY 1, 2) q JOIN v2 USING (r))),
v3 AS (SELECT r, c FROM jt WHERE i = {n}), w3 AS ({step.format(v="v3")}), l3 AS (SELECT sqrt(sum(c * c)) x FROM w3), l AS (SELECT l2.x AS l2, l3.x AS l3 FROM l2, l3)"""


SPECTRA = f"WITH RECURSIVE {m_sql()}, {eci_sql()}, {lambda_sql()}"


@query("eigengap", f"{SPECTRA} SELECT 1.0::DOUBLE AS eigenvalue_0, round(l2, 6) AS eigenvalue_1, round(1 - l2, 6) AS eigengap, round(l2, 6) AS ratio, trunc(ln(0.01) / ln(l2))::DOUBLE AS iterations_99pct, trunc(ln(0.001) / ln(l2))::DOUBLE AS iterations_999pct, 1 - l2 < 1e-6 AS is_degenerate FROM l")
def eigengap(spark, d):
    return rounded(ec.eigengap(flagship(spark, d)))


@query("eigenvalue_trace", f"WITH {m_sql()}, kc AS (SELECT r, count(*)::DOUBLE k FROM m GROUP BY 1), kp AS (SELECT p, count(*)::DOUBLE k FROM m GROUP BY 1) SELECT round(sum(1 / kc.k / kp.k), 6) AS trace FROM m JOIN kc USING (r) JOIN kp USING (p)")
def eigenvalue_trace(spark, d):
    """The sum of all eigenvalues is the walk's trace."""
    return rounded(ec.eigenvalues(flagship(spark, d), 1000).agg(F.sum("eigenvalue").alias("trace")))


@query("gap_measures")
def gap_measures(spark, d):
    return rounded(ec.gap_measures(flagship(spark, d)))


@query("cheeger_diagnosis", f"{SPECTRA} SELECT round(l2, 6) AS lambda2, round(l3, 6) AS lambda3, round((1 - l3) / (1 - l2 + 1e-10), 6) AS gap_ratio, CASE WHEN l2 > 0.8 AND l2 - l3 > 0.3 THEN 'one-dimensional nested' WHEN l2 > 0.8 THEN 'communities' WHEN l2 - l3 > 0.1 THEN 'weak gradient' ELSE 'no structure' END AS diagnosis FROM l")
def cheeger_diagnosis(spark, d):
    return rounded(ec.cheeger_diagnosis(flagship(spark, d)))


@query("principled_diagnosis", f"""{SPECTRA} SELECT 1.0::DOUBLE AS lambda1, round(l2, 6) AS lambda2, round(l3, 6) AS lambda3, round(1 - l2, 6) AS lambda2_l, round(l2 - l3, 6) AS eigengap, round(1 - l2, 6) AS spectral_gap, l2 > 0.8 AS is_persistent, l2 - l3 > 0.3 AS is_1d,
 CASE WHEN l2 > 0.8 AND l2 - l3 > 0.3 THEN '1D nested hierarchy' ELSE 'Multi-dimensional structure' END AS diagnosis, CASE WHEN l2 - l3 > 0.1 THEN '1D nested hierarchy' ELSE 'Multi-dimensional structure' END AS by_gap, CASE WHEN l2 > 0.8 THEN '1D nested hierarchy' ELSE 'Multi-dimensional structure' END AS by_persistence FROM l""")
def principled_diagnosis(spark, d):
    return rounded(ec.principled_diagnosis(flagship(spark, d)))


@query("spectrum_report")
def spectrum_report(spark, d):
    return rounded(ec.spectrum_report(flagship(spark, d)))


@query("laplacian_gap")
def laplacian_gap(spark, d):
    return rounded(ec.laplacian_gap(flagship(spark, d)))


@query("both_sides_spectra")
def both_sides_spectra(spark, d):
    return rounded(ec.both_sides(supplier_edges(spark, d)))


@query("network_report")
def network_report(spark, d):
    return rounded(cm.network_report(flagship(spark, d)))


@query("effective_rank")
def effective_rank(spark, d):
    return rounded(ec.effective_rank(flagship(spark, d)))


@query("null_model_pvalue")
def null_model_pvalue(spark, d):
    return rounded(cm.eigengap_null_model(flagship(spark, d)))


@query("community_labels")
def community_labels(spark, d):
    return cm.detect_communities(flagship(spark, d))


def region_labels(spark, d):
    return t(spark, d, "nation").select(F.col("n_name").alias("row_id"), F.col("n_regionkey").alias("community"))


@query("within_community_corr")
def within_community_corr(spark, d):
    return rounded(cm.within_communities(flagship(spark, d), region_labels(spark, d)))


@query("global_vs_local")
def global_vs_local(spark, d):
    return rounded(cm.global_vs_local(flagship(spark, d), region_labels(spark, d)))


@query("community_conductance", f"""WITH {m_sql()}, a AS (SELECT p, n_regionkey c, count(*)::DOUBLE x FROM m JOIN nation ON n_name = r GROUP BY 1, 2), b AS (SELECT p, count(*)::DOUBLE y FROM m GROUP BY 1),
s AS (SELECT c, sum(x * (y - x) / y) cut, sum(x) vol FROM a JOIN b USING (p) GROUP BY 1), z AS (SELECT *, cut / least(vol, (SELECT sum(y) FROM b) - vol) phi FROM s)
SELECT c AS community, round(cut, 6) AS cut, vol AS volume, round(phi, 6) AS conductance, round(phi * phi / 2, 6) AS lower_bound FROM z""")
def community_conductance(spark, d):
    return rounded(nw.conductance(flagship(spark, d), region_labels(spark, d)))


@query("shared_product_ratio", f"""WITH {m_sql()}, a AS (SELECT p, bool_or(n_regionkey <= 1) x, bool_or(n_regionkey > 1) y, sum((n_regionkey <= 1)::INT)::DOUBLE vx, sum((n_regionkey > 1)::INT)::DOUBLE vy FROM m JOIN nation ON n_name = r GROUP BY 1)
SELECT count(*) FILTER (x AND y) AS shared, least(sum(vx), sum(vy)) AS volume, round(count(*) FILTER (x AND y) / least(sum(vx), sum(vy)), 6) AS ratio FROM a""")
def shared_product_ratio(spark, d):
    return rounded(nw.shared_product_ratio(flagship(spark, d), region_labels(spark, d).select("row_id", (F.col("community") <= 1).alias("side"))))


@query("nestedness", f"""WITH {m_sql()}, o AS (SELECT r, row_number() OVER (ORDER BY k DESC, r) pos FROM (SELECT r, count(*) k FROM m GROUP BY 1)), n AS (SELECT count(*) n FROM o),
g AS (SELECT DISTINCT p FROM m), v AS (SELECT count(*) x FROM m JOIN o USING (r) JOIN o q ON q.pos > o.pos LEFT JOIN m w ON w.r = q.r AND w.p = m.p WHERE w.r IS NULL)
SELECT (SELECT count(*) FROM m) AS ones, x AS violations, round(1 - x / ((SELECT count(*) FROM m) * (SELECT n FROM n)), 6) AS nestedness FROM v""")
def nestedness(spark, d):
    return rounded(nw.nestedness(flagship(spark, d)))


def points(spark, d):
    """All embeddings."""
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


AFF = "pts AS (SELECT vec_id id, embedding::DOUBLE[] x FROM embeddings), aff AS (SELECT a.id a, b.id b, exp(-list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 2) w FROM pts a, pts b)"


@query("affinity_rbf", f"WITH {AFF} SELECT a, b, round(w, 6) AS w FROM aff")
def affinity_rbf(spark, d):
    return cm.affinity_rbf(points(spark, d), 1.0, places=6)


@query("laplacian_normalised", f"WITH {AFF}, g AS (SELECT a, 1 / sqrt(sum(w) + 1e-10) s FROM aff GROUP BY 1) SELECT aff.a, aff.b, round(w * g.s * h.s, 6) AS w FROM aff JOIN g ON g.a = aff.a JOIN g h ON h.a = aff.b")
def laplacian_normalised(spark, d):
    return cm.laplacian_rbf(points(spark, d), 1.0, places=6)


CENTRES = [[0.1] * 64, [0.1 if i % 2 else -0.1 for i in range(64)], [0.0] * 64]


def _elongated(i: int) -> str:
    c = f"{CENTRES[i]}::DOUBLE[]"
    sq = f"list_sum(list_transform(list_zip(x, {c}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    norm = sum(v * v for v in CENTRES[i])
    if norm <= 1e-4:
        return sq
    a = f"(power(list_sum(list_transform(list_zip(x, {c}), lambda z: (z[1] - z[2]) * z[2])), 2) / {norm!r})"
    return f"greatest(0.0, ({sq} - {a}) / 0.2 + 0.2 * {a})"


@query("nearest_centre", f"WITH q AS (SELECT vec_id id, embedding::DOUBLE[] x FROM embeddings), y AS (SELECT id, [{', '.join(map(_elongated, range(3)))}] l FROM q) SELECT id, (list_position(l, list_min(l)) - 1)::INT AS label, round(list_min(l), 6) AS distance FROM y")
def nearest_centre(spark, d):
    p = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return rounded(cm.nearest_centre(p, CENTRES))


# --- reports --------------------------------------------------------------------------

YEAR = "SELECT n_name id, sum({v}) score FROM {s} WHERE year(l_shipdate) = {y} GROUP BY 1"
COMPARE = f"""a AS ({YEAR.format(v=VALUE, s=SALES, y=1995)}), b AS ({YEAR.format(v=VALUE, s=SALES, y=2000)}),
ra AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) k FROM a), rb AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) k FROM b)"""


def _two_years(spark, d):
    p = panel(spark, d)
    return tuple(p.where(F.col("year") == y).select("id", F.col("value").alias("score")) for y in (1995, 2000))


@query("rank_change", f"WITH {COMPARE} SELECT id, ra.k::INT AS old_rank, rb.k::INT AS new_rank, (ra.k - rb.k)::INT AS rank_change, round(100 * (rb.score - ra.score) / ra.score, 6) AS change_pct FROM ra JOIN rb USING (id)")
def rank_change(spark, d):
    both = rp.compared(*_two_years(spark, d)).where("old_score IS NOT NULL AND new_score IS NOT NULL")
    return rounded(both.select("id", "old_rank", "new_rank", "rank_change", "change_pct"))


@query("top_gainers", f"WITH {COMPARE} SELECT id, round(rb.score - ra.score, 2) AS change FROM ra JOIN rb USING (id) ORDER BY rb.score - ra.score DESC, id LIMIT 5")
def top_gainers(spark, d):
    return rounded(rp.compared(*_two_years(spark, d)).select("id", "change").orderBy(F.desc_nulls_last("change"), "id").limit(5), 2)


@query("top_outer_merge", f"WITH {COMPARE} SELECT coalesce(x.id, y.id) AS id, coalesce(x.k, 999)::INT AS old_rank, coalesce(y.k, 999)::INT AS new_rank FROM (SELECT * FROM ra WHERE k <= 10) x FULL JOIN (SELECT * FROM rb WHERE k <= 10) y ON x.id = y.id")
def top_outer_merge(spark, d):
    a, b = (s.orderBy(F.desc("score"), "id").limit(10) for s in _two_years(spark, d))
    return rp.compared(a, b).select("id", "old_rank", "new_rank")


NATIONS = f"nn AS (SELECT n_name id, sum({VALUE}) v, count(*)::DOUBLE c, avg(l_quantity) q FROM {SALES} GROUP BY 1)"


def nation_table(spark, d):
    li = t(spark, d, "lineitem")
    s, n, p = t(spark, d, "supplier"), t(spark, d, "nation"), t(spark, d, "part").select("p_partkey")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("n_name").alias("id")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"), F.count(F.lit(1)).cast("double").alias("c"), F.avg("l_quantity").alias("q"))


@query("pearson", f"WITH {NATIONS} SELECT count(*) AS n, round(corr(v, c), 6) AS pearson FROM nn")
def pearson(spark, d):
    return rounded(rp.correlations(nation_table(spark, d), "v", "c").select("n", "pearson"))


@query("spearman_avg_ties", f"WITH {NATIONS}, w AS (SELECT rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 b FROM nn) SELECT round(corr(a, b), 6) AS spearman FROM w")
def spearman_avg_ties(spark, d):
    return rounded(rp.correlations(nation_table(spark, d), "c", "v").select("spearman"))


@query("corr_matrix", f"WITH {NATIONS}, u AS (SELECT 'v' a, 'v' b, corr(v, v) r FROM nn UNION ALL SELECT 'v', 'c', corr(v, c) FROM nn UNION ALL SELECT 'v', 'q', corr(v, q) FROM nn UNION ALL SELECT 'c', 'v', corr(c, v) FROM nn UNION ALL SELECT 'c', 'c', corr(c, c) FROM nn UNION ALL SELECT 'c', 'q', corr(c, q) FROM nn UNION ALL SELECT 'q', 'v', corr(q, v) FROM nn UNION ALL SELECT 'q', 'c', corr(q, c) FROM nn UNION ALL SELECT 'q', 'q', corr(q, q) FROM nn) SELECT a, b, round(r, 6) AS r FROM u")
def corr_matrix(spark, d):
    return rounded(rp.correlation_matrix(nation_table(spark, d), ["v", "c", "q"]))


@query("ols_residual_topk", f"WITH {NATIONS}, l AS (SELECT regr_slope(v, c) s, regr_intercept(v, c) i FROM nn) SELECT id, round(v - s * c - i, 2) AS residual FROM nn, l ORDER BY v - s * c - i DESC, id LIMIT 5")
def ols_residual_topk(spark, d):
    return rounded(rp.residuals(nation_table(spark, d), "c", "v").orderBy(F.desc("residual"), "id").limit(5).select("id", "residual"), 2)


@query("describe_margins", f"WITH {m_sql('s_name')}, k AS (SELECT count(*)::DOUBLE d FROM m GROUP BY r) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, min(d) AS least, round(quantile_cont(d, 0.3), 6) AS p30, round(quantile_cont(d, 0.5), 6) AS median, max(d) AS most FROM k")
def describe_margins(spark, d):
    k = nw.margin(supplier_edges(spark, d), "row_id")
    return rounded(rp.describe(k, "strength", {"p30": 0.3, "median": 0.5}))


@query("histogram_log_value", f"WITH {m_sql('s_name')}, l AS (SELECT log10(v) x FROM f WHERE v > 0), e AS (SELECT min(x) lo, max(x) hi FROM l) SELECT least(floor((x - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM l, e GROUP BY 1")
def histogram_log_value(spark, d):
    return rp.histogram(rp.positive_log(trade(spark, d, "s_name"), "w", "x"), "x", 20).select("bin", "n")


@query("zero_based_places", f"WITH {m_sql('s_name')}, k AS (SELECT r, count(*)::DOUBLE d FROM m GROUP BY r) SELECT r AS id, (row_number() OVER (ORDER BY d DESC, r) - 1)::INT AS place FROM k")
def zero_based_places(spark, d):
    return rp.places(nw.margin(supplier_edges(spark, d), "row_id"), "strength").select("id", "place")


@query("flow_on_support", f"WITH {m_sql()} SELECT f.r AS row_id, f.p AS col_id, round(f.v, 6) AS w FROM f JOIN m ON m.r = f.r AND m.p = f.p")
def flow_on_support(spark, d):
    """Of all trade, what lies on the network's edges."""
    return rounded(rp.on_support(trade(spark, d), flagship(spark, d)).select("row_id", "col_id", "w"))


@query("conditional_counts", f"WITH {m_sql('s_name')}, k AS (SELECT r, count(*) d FROM m GROUP BY r) SELECT count(*) FILTER (d < 10) AS low, count(*) FILTER (d BETWEEN 10 AND 12) AS middle, count(*) FILTER (d > 12) AS high FROM k")
def conditional_counts(spark, d):
    k = nw.margin(supplier_edges(spark, d), "row_id")
    return k.agg(F.count_if(F.col("degree") < 10).alias("low"), F.count_if(F.col("degree").between(10, 12)).alias("middle"), F.count_if(F.col("degree") > 12).alias("high"))


# --- indicators and names --------------------------------------------------------------

IND = "i AS (SELECT n_name country_code, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def indicator(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_name").alias("country_code"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("indicator_wide", f"WITH {IND} SELECT country_code, max(value) FILTER (year = 1996) AS y1996, max(value) FILTER (year = 1997) AS y1997 FROM i WHERE year IN (1996, 1997) GROUP BY 1")
def indicator_wide(spark, d):
    wide = rd.indicator_wide(rd.select_series(indicator(spark, d), start=1996, end=1997), [1996, 1997])
    return wide.select("country_code", F.col("1996").alias("y1996"), F.col("1997").alias("y1997"))


@query("indicator_long", f"WITH {IND} SELECT * FROM i WHERE year BETWEEN 1996 AND 1998")
def indicator_long(spark, d):
    return rd.indicator_long(rd.indicator_wide(indicator(spark, d), [1996, 1997, 1998]))


@query("indicator_dedupe_last", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1")
def indicator_dedupe_last(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("last_price"))


@query("fitness_with_indicator", f"WITH RECURSIVE {m_sql()}, {fc_sql(N_FC)}, {IND} SELECT r AS id, year, round(f, 6) AS fitness, value FROM fit JOIN i ON country_code = r")
def fitness_with_indicator(spark, d):
    fit = side(ft.fitness_scores(flagship(spark, d), N_FC, 0.0), "row", "fitness")
    return rounded(fit.join(indicator(spark, d).withColumnRenamed("country_code", "id"), "id").select("id", "year", "fitness", "value"))


@query("indicators_joined", f"WITH {IND}, a AS (SELECT country_code, year, value v FROM i), b AS (SELECT n_name country_code, year(l_shipdate)::INT AS year, count(*) n FROM {SALES} GROUP BY 1, 2), c AS (SELECT n_name country_code, count(*) s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT country_code, year, v AS value, n AS items, s AS suppliers FROM a JOIN b USING (country_code, year) JOIN c USING (country_code)")
def indicators_joined(spark, d):
    """Three indicators by country, two of them by year."""
    items = sales(spark, d).groupBy(F.col("n_name").alias("country_code"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("items"))
    n = t(spark, d, "nation").join(t(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy(F.col("n_name").alias("country_code")).agg(F.count(F.lit(1)).alias("suppliers"))
    return indicator(spark, d).join(items, ["country_code", "year"]).join(n, "country_code")


@query("name_lookup_default", "SELECT n_name, coalesce(CASE WHEN r_regionkey <= 2 THEN r_name END, 'Unknown') AS region, coalesce(CASE WHEN r_regionkey <= 2 THEN r_name END, n_name) AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def name_lookup_default(spark, d):
    names = t(spark, d, "region").where("r_regionkey <= 2")
    j = t(spark, d, "nation").join(names, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("n_name", F.coalesce("r_name", F.lit("Unknown")).alias("region"), F.coalesce("r_name", "n_name").alias("label"))


@query("known_codes", "SELECT c AS country_code FROM (VALUES ('NATION_1'), ('NATION_99'), ('XXX')) v(c) WHERE c IN (SELECT n_name FROM nation)")
def known_codes(spark, d):
    return rd.known_codes(t(spark, d, "nation").select(F.col("n_name").alias("country_code")), ["NATION_1", "NATION_99", "XXX"])


@query("missing_codes", "SELECT c AS country_code FROM (VALUES ('NATION_1'), ('NATION_99'), ('XXX')) v(c) WHERE c NOT IN (SELECT n_name FROM nation)")
def missing_codes(spark, d):
    return rd.missing_codes(t(spark, d, "nation").select(F.col("n_name").alias("country_code")), ["NATION_1", "NATION_99", "XXX"])


@query("exclude_aggregates", f"WITH {IND} SELECT DISTINCT country_code FROM i WHERE country_code NOT IN ({', '.join(repr(c) for c in rd.AGGREGATES)})")
def exclude_aggregates(spark, d):
    """The codes of the whole indicator table but for aggregates."""
    return rd.without_aggregates(indicator(spark, d)).select("country_code").distinct()


@query("json_props_flatten", "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events WHERE (props::JSON ->> '$.k') IS NOT NULL")
def json_props_flatten(spark, d):
    e = t(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return e.where("k IS NOT NULL")


# --- text -----------------------------------------------------------------------------


@query("clean_text", "SELECT page_id, md5(regexp_replace(coalesce(html, ''), '/\\*.*?\\*/|<[^>]+>', '', 'g')) AS digest FROM pages")
def clean_text(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(tx.clean_comment(F.coalesce("html", F.lit(""))).cast("binary")).alias("digest"))


@query("bot_filter", "SELECT role, count(*) AS n FROM conversations WHERE role IS NOT NULL AND NOT regexp_matches(lower(role), 'bot$') GROUP BY 1")
def bot_filter(spark, d):
    c = t(spark, d, "conversations")
    return c.where(F.col("role").isNotNull() & ~tx.is_bot(F.col("role"))).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("valid_comments", "SELECT conv_id, count(*) AS n FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL AND length(trim(text)) > 40 GROUP BY 1 HAVING count(*) >= 2")
def valid_comments(spark, d):
    c = t(spark, d, "conversations").where("role IS NOT NULL AND text IS NOT NULL").where(F.length(F.trim("text")) > 40)
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("author_sample_hash", "SELECT source AS author FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) ORDER BY md5('s' || source), source LIMIT 7")
def author_sample_hash(spark, d):
    return tx.author_sample(t(spark, d, "documents"), "source", 7, "s")


@query("author_concat_topk", """WITH c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, text) k, count(*) OVER (PARTITION BY conv_id) n FROM conversations WHERE text IS NOT NULL)
SELECT conv_id AS author, md5(string_agg(text, chr(10) ORDER BY k)) AS digest, any_value(n) AS n FROM c WHERE k <= 2 GROUP BY 1""")
def author_concat_topk(spark, d):
    c = tx.longest_texts(t(spark, d, "conversations").where("text IS NOT NULL"), "conv_id", "text", 2)
    return c.select("author", F.md5(F.col("user_text").cast("binary")).alias("digest"), "n")


TOK = "w AS (SELECT source a, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) word FROM documents WHERE source IS NOT NULL), c AS (SELECT a, word, count(*) n FROM w GROUP BY 1, 2)"
VOC = "v AS (SELECT word, count(*) AS df, sum(n)::BIGINT AS total FROM c GROUP BY 1 HAVING count(*) >= 3 ORDER BY sum(n) DESC, word LIMIT 500)"


@query("token_counts", f"WITH {TOK} SELECT a AS author, word, n FROM c")
def token_counts(spark, d):
    return tx.word_counts(t(spark, d, "documents"), "source", "text", [])


@query("vocabulary", f"WITH {TOK}, {VOC} SELECT word, df, total FROM v")
def vocabulary(spark, d):
    return tx.vocabulary(tx.word_counts(t(spark, d, "documents"), "source", "text", []), 3, 500)


STOPPED = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP_WORDS)


@query("vocabulary_without_stop_words", f"WITH {TOK}, k AS (SELECT * FROM c WHERE word NOT IN ({STOPPED})) SELECT word, count(*) AS df, sum(n)::BIGINT AS total FROM k GROUP BY 1 HAVING count(*) >= 3")
def vocabulary_without_stop_words(spark, d):
    return tx.vocabulary(tx.word_counts(t(spark, d, "documents"), "source", "text"), 3)


@query("user_word_edges", f"WITH {TOK}, {VOC} SELECT a AS row_id, word AS col_id, n::DOUBLE AS w FROM c WHERE word IN (SELECT word FROM v)")
def user_word_edges(spark, d):
    return tx.user_word_edges(t(spark, d, "documents"), "source", "text", 3, 500, stop_words=[])


# --- pictures' tables -----------------------------------------------------------------

TOPS = f"tr AS (SELECT r FROM f GROUP BY r ORDER BY sum(v) DESC, r LIMIT 8), tc AS (SELECT p FROM f GROUP BY p ORDER BY sum(v) DESC, p LIMIT 9)"


@query("top_subset_flow", f"WITH f AS ({facts_sql()}), {TOPS} SELECT r AS row_id, p AS col_id, round(v, 4) AS w FROM f WHERE r IN (SELECT r FROM tr) AND p IN (SELECT p FROM tc)")
def top_subset_flow(spark, d):
    return rounded(rp.top_subset(trade(spark, d), 8, 9), 4)


@query("top_edges", f"WITH f AS ({facts_sql()}) SELECT r AS row_id, p AS col_id, round(v, 4) AS w, round(0.2 + 6 * power(v / max(v) OVER (), 0.75), 6) AS width FROM (SELECT * FROM f ORDER BY v DESC, r, p LIMIT 40)")
def top_edges(spark, d):
    return rounded(rp.top_edges(trade(spark, d), 40), 6, w=4)


@query("alluvial_spans", f"""WITH f AS ({facts_sql()}), g AS (SELECT r, sum(v) m FROM f GROUP BY 1), h AS (SELECT r, m, m / sum(m) OVER () x, row_number() OVER (ORDER BY m DESC, r) k, count(*) OVER () n FROM g),
j AS (SELECT *, coalesce(sum(x) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.01 * (k - 1) lo FROM h)
SELECT r AS id, round(m, 4) AS mass, round(lo / (1 + 0.01 * (n - 1)), 6) AS lo, round((lo + x) / (1 + 0.01 * (n - 1)), 6) AS hi FROM j""")
def alluvial_spans(spark, d):
    return rounded(rp.alluvial_spans(trade(spark, d), "row_id"), 6, mass=4)


@query("alluvial_bands", f"""WITH f AS ({facts_sql()}), {', '.join(f"""{x}g AS (SELECT {x}, sum(v) m FROM f GROUP BY 1), {x}h AS (SELECT {x}, m, m / sum(m) OVER () x, row_number() OVER (ORDER BY m DESC, {x}) k, count(*) OVER () n FROM {x}g),
{x}s AS (SELECT {x}, m, x / (1 + 0.01 * (n - 1)) high, (coalesce(sum(x) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.01 * (k - 1)) / (1 + 0.01 * (n - 1)) lo FROM {x}h)""" for x in "rp")},
b AS (SELECT r, p, v, rs.lo + coalesce(sum(v) OVER (PARTITION BY r ORDER BY v DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * rs.high / rs.m a, rs.high / rs.m ra,
 ps.lo + coalesce(sum(v) OVER (PARTITION BY p ORDER BY v DESC, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * ps.high / ps.m c, ps.high / ps.m pa FROM f JOIN rs USING (r) JOIN ps USING (p))
SELECT r AS row_id, p AS col_id, round(v, 4) AS w, round(a, 6) AS row_lo, round(a + v * ra, 6) AS row_hi, round(c, 6) AS col_lo, round(c + v * pa, 6) AS col_hi FROM b""")
def alluvial_bands(spark, d):
    return rounded(rp.alluvial_bands(trade(spark, d)), 6, w=4)


ARC = "SELECT {x} id, row_number() OVER (ORDER BY {x}) i, count(*) OVER () n FROM (SELECT DISTINCT {x} FROM b)"


@query("circular_flow", f"""WITH f AS ({facts_sql()}), b AS (SELECT * FROM f ORDER BY v DESC, r, p LIMIT 40), x AS ({ARC.format(x="r")}), y AS ({ARC.format(x="p")})
SELECT r AS row_id, p AS col_id, round(v, 4) AS w, round(0.2 + 6 * power(v / max(v) OVER (), 0.75), 6) AS width, round(cos(-pi() / 2 + (x.i - 0.5) / x.n * pi()), 6) + 0.0 AS row_x, round(sin(-pi() / 2 + (x.i - 0.5) / x.n * pi()), 6) + 0.0 AS row_y,
 round(cos(pi() / 2 + (y.i - 0.5) / y.n * pi()), 6) + 0.0 AS col_x, round(sin(pi() / 2 + (y.i - 0.5) / y.n * pi()), 6) + 0.0 AS col_y FROM b JOIN x ON x.id = r JOIN y ON y.id = p""")
def circular_flow(spark, d):
    return rounded(rp.circular_flow(trade(spark, d), 40), 6, w=4)


@query("sorted_matrix", f"""WITH f AS ({facts_sql()}), x AS (SELECT r, row_number() OVER (ORDER BY sum(v) DESC, r) - 1 k FROM f GROUP BY 1), y AS (SELECT p, row_number() OVER (ORDER BY sum(v) DESC, p) - 1 k FROM f GROUP BY 1)
SELECT x.k::INT AS row_pos, y.k::INT AS col_pos, r AS row_id, p AS col_id, round(v, 4) AS w FROM f JOIN x USING (r) JOIN y USING (p)""")
def sorted_matrix(spark, d):
    e = trade(spark, d)
    total = lambda side: e.groupBy(F.col(side).alias("id")).agg(F.sum("w").alias("score"))
    return rounded(rp.sorted_by_scores(e, total("row_id"), total("col_id")), 4)


@query("cluster_purity", "WITH e AS (SELECT o_custkey % 7 label, o_orderpriority AS class, count(*) k FROM orders GROUP BY 1, 2), g AS (SELECT label, sum(k) n, max(k) most FROM e GROUP BY 1) SELECT sum(n)::BIGINT AS n, count(*) AS clusters, round(sum(most) / sum(n), 6) AS purity FROM g")
def cluster_purity(spark, d):
    o = t(spark, d, "orders")
    return rounded(rp.cluster_purity(o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("label")), o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("class"))))


@query("dual_potentials", f"WITH RECURSIVE {m_sql()}, {sk_sql(200, *UNIFORM)} SELECT r AS id, round(ln(u + 1e-30), 6) AS potential, (row_number() OVER (ORDER BY u DESC, r))::INT AS pos FROM us")
def dual_potentials(spark, d):
    scales = sk.SinkhornScaler().fit(flagship(spark, d)).scales
    return rounded(rp.dual_potentials(scales).where("side = 'row'").select("id", "potential", "pos"))


@query("ranked_barcodes", f"WITH RECURSIVE {m_sql()}, {fc_sql(N_FC)} SELECT (row_number() OVER (ORDER BY f DESC, r))::INT AS pos, r AS id, round(f, 6) AS score, (SELECT count(*) FROM m WHERE m.r = fit.r) AS degree FROM fit ORDER BY f DESC, r LIMIT 10")
def ranked_barcodes(spark, d):
    e = flagship(spark, d)
    return rounded(rp.ranked_barcodes(side(ft.fitness_scores(e, N_FC, 0.0), "row", "score"), nw.margin(e, "row_id"), 10))


HASH = "(('0x' || substr(md5('7|' || r || '|' || p), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


@query("perturb_remove_edges", f"WITH {m_sql()} SELECT r AS row_id, p AS col_id, 1.0::DOUBLE AS w FROM m WHERE {HASH} >= 0.2")
def perturb_remove_edges(spark, d):
    return rd.remove_edges(flagship(spark, d), 0.2, 7)


@query("generator_nested", """WITH n AS (SELECT (SELECT count(*) FROM nation) AS x, (SELECT count(DISTINCT p_brand) FROM part) AS y), g AS (SELECT i, unnest(range(least(y, floor((i + 1) * y / x) + 5)::BIGINT)) AS j FROM (SELECT x, y, unnest(range(x)) AS i FROM n))
SELECT printf('r%04d', i) AS row_id, printf('c%04d', j) AS col_id, 1.0::DOUBLE AS w FROM g""")
def generator_nested(spark, d):
    """As many rows as nations and columns as brands."""
    return rd.nested_network(spark, t(spark, d, "nation").count(), t(spark, d, "part").select("p_brand").distinct().count())


# --- further reports and generators ------------------------------------------------------


@query("community_stats", f"""WITH RECURSIVE {m_sql()}, {fc_sql(N_FC)}, o AS (SELECT n_regionkey c, r, f, (SELECT count(*) FROM m WHERE m.r = fit.r) k, row_number() OVER (PARTITION BY n_regionkey ORDER BY f DESC, r) p FROM fit JOIN nation ON n_name = r)
SELECT c AS community, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(k), 6) AS mean_degree, round(avg(f), 6) AS mean_score, string_agg(r, ',' ORDER BY p) FILTER (p <= 3) AS leaders FROM o GROUP BY 1""")
def community_stats(spark, d):
    e = flagship(spark, d)
    return rounded(rp.community_stats(region_labels(spark, d), side(ft.fitness_scores(e, N_FC, 0.0), "row", "score"), nw.margin(e, "row_id")))


@query("collapse_check", f"WITH RECURSIVE {m_sql()}, {fc_sql(N_FC)} SELECT round(max(f), 6) AS most, round(quantile_cont(f, 0.5), 6) AS median, avg((f > 1e-10)::INT)::DOUBLE AS positive_share, round(max(f) / quantile_cont(f, 0.5), 6) AS ratio, max(f) / quantile_cont(f, 0.5) > 100 AS collapsed FROM fit")
def collapse_check(spark, d):
    return rounded(rp.collapse_check(side(ft.fitness_scores(flagship(spark, d), N_FC, 0.0), "row", "score")))


@query("low_degree", f"WITH {m_sql('s_name')} SELECT s_name AS id, count(m.r) AS degree FROM (SELECT DISTINCT s_name FROM supplier) LEFT JOIN m ON m.r = s_name GROUP BY 1 HAVING count(m.r) < 11")
def low_degree(spark, d):
    return rp.low_degree(nw.margin(supplier_edges(spark, d), "row_id"), t(spark, d, "supplier").select(F.col("s_name").alias("id")), 11)


def _u(seed: int, *keys: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {" || '|' || ".join(keys)}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


@query("synthetic_users", f"""WITH g AS (SELECT i, j FROM (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i), (SELECT unnest(range((SELECT count(DISTINCT p_type) FROM part))) AS j)), k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY {_u(43, "i", "j")}, j) k, 5 + floor({_u(42, "i")} * (least((SELECT count(DISTINCT p_type) FROM part), 30) - 5)) take, 1 + floor(ln(1 - {_u(44, "i", "j")}) / ln(0.7)) w FROM g)
SELECT 'user_' || i AS row_id, 'word_' || j AS col_id, w::DOUBLE AS w FROM k WHERE k <= take""")
def synthetic_users(spark, d):
    """As many users as suppliers and words as part types."""
    return rd.synthetic_users(spark, t(spark, d, "supplier").count(), t(spark, d, "part").select("p_type").distinct().count())


@query("kmeans_communities")
def kmeans_communities(spark, d):
    return cm.kmeans_communities(flagship(spark, d))


@query("user_clusters")
def user_clusters(spark, d):
    return cm.user_clusters(flagship(spark, d))
