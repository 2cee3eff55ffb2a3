"""Sources: trade files, indicators, comments, fixtures and generators; all with explicit schemas, codes as strings."""

from __future__ import annotations

import csv
import io
import math
import warnings
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bipartrix.functions import text as tx
from bipartrix.model import EDGES, Bundle, bundle, quantiles, row_numbers
from bipartrix.operators.network import mass_filter, rca_edges

#: Other names of the trade columns.
ALIASES = {
    "location_code": ["location_code", "country_iso3_code"],
    "product_code": ["product_code", "product_hs92_code", "hs_product_code", "product_sitc_code", "sitc_product_code"],
    "value": ["export_value", "value"],
    "year": ["year"],
}

#: World Bank codes of regions and income groups, which are not countries.
AGGREGATES = "AFE AFW ARB CEB CSS EAP EAR EAS ECA ECS EMU EUU FCS HIC HPC IBD IBT IDA IDB IDX INX LAC LCN LDC LIC LMC LMY LTE MEA MIC MNA NAC NOC OEC OED OSS PRE PSS PST SAS SSA SSF SST TEA TEC TLA TMN TSA TSS UMC WLD".split()
#: Countries that older exclusion lists leave out too.
COMPAT_EXCLUDED = ["LIE", "MAF", "MCO"]


def resolve(df: DataFrame, *names: str) -> DataFrame:
    """Columns under their usual names; an error lists what is there."""
    out = []
    for name in names:
        found = next((c for c in ALIASES[name] if c in df.columns), None)
        if found is None:
            raise ValueError(f"no column for {name} (any of {ALIASES[name]}); there are {df.columns}")
        out.append(F.col(found).alias(name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_trade_csv(spark: SparkSession, path: str) -> DataFrame:
    """A trade file with a header, all columns as strings but year and value."""
    head = spark.read.csv(path, header=True, inferSchema=False)
    kinds = {"year": "int", "export_value": "double", "value": "double"}
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in head.columns))


def trade_facts(df: DataFrame, year: int, level: int = 4) -> DataFrame:
    """(row_id, col_id, w): a year's positive exports by country and product prefix of ``level`` digits."""
    if not 1 <= level <= 4:
        raise ValueError("product level must be 1 to 4")
    facts = resolve(df, "location_code", "product_code", "year", "value")
    own = facts.where(F.col("year") == year)
    if own.isEmpty():
        raise ValueError(f"no data for {year}; there are {available_years(df)}")
    return own.groupBy(F.col("location_code").alias("row_id"), F.substring("product_code", 1, level).alias("col_id")).agg(F.sum("value").alias("w")).where("w > 0")


def available_years(df: DataFrame) -> list[int]:
    return [r[0] for r in resolve(df, "year").distinct().orderBy("year").collect()]


def load_trade(df: DataFrame, year: int, level: int = 4, rca_threshold: float = 1.0, names: DataFrame | None = None) -> Bundle:
    """Binary edges where comparative advantage reaches the threshold; dims keep labels without an edge; names default to Unknown."""
    facts = trade_facts(df, year, level)
    out = bundle(facts, "trade", year=str(year), rca_threshold=str(rca_threshold))
    out.edges = rca_edges(facts, rca_threshold)
    if names is not None:  # (id, name)
        out.cols = out.cols.join(names, "id", "left").withColumn("name", F.coalesce("name", F.lit("Unknown")))
    return out


def read_triplets(spark: SparkSession, triplets: str, rows: str, cols: str, row_name: str, col_name: str) -> Bundle:
    """A matrix kept as index triplets with two label files."""
    t = read_csv(spark, triplets, "i int, j int, value double")
    r, c = read_csv(spark, rows, f"i int, {row_name} string"), read_csv(spark, cols, f"j int, {col_name} string")
    edges = t.join(r, "i").join(c, "j").select(F.col(row_name).alias("row_id"), F.col(col_name).alias("col_id"), F.col("value").alias("w"))
    return Bundle(edges, r.select(F.col("i").alias("idx"), F.col(row_name).alias("id")), c.select(F.col("j").alias("idx"), F.col(col_name).alias("id")), {"source": triplets})


INDICATOR_JSON = "array<struct<countryiso3code:string,country:struct<id:string,value:string>,date:string,value:double>>"


def read_indicator_json(spark: SparkSession, path: str) -> DataFrame:
    """(country_code, country_name, year, value) of API pages ``[meta, records]``: nulls skipped, the last of repeated records kept."""
    raw = spark.read.text(path, wholetext=True).withColumn("_file", F.monotonically_increasing_id())
    records = F.from_json(F.get_json_object("value", "$[1]"), INDICATOR_JSON)
    flat = raw.select("_file", F.posexplode(records).alias("_at", "r")).where("r.value IS NOT NULL AND r.countryiso3code <> ''")
    last = flat.groupBy(F.col("r.countryiso3code").alias("country_code"), F.col("r.date").cast("int").alias("year")).agg(F.max_by("r", F.struct("_file", "_at")).alias("r"))
    return last.select("country_code", F.col("r.country.value").alias("country_name"), "year", F.col("r.value").alias("value"))


def indicator_wide(long: DataFrame, years: list[int]) -> DataFrame:
    return long.groupBy("country_code").pivot("year", years).agg(F.first("value"))


def indicator_long(wide: DataFrame) -> DataFrame:
    years = [c for c in wide.columns if c != "country_code"]
    return wide.unpivot("country_code", [F.col(f"`{c}`") for c in years], "year", "value").select("country_code", F.col("year").cast("int").alias("year"), "value").where("value IS NOT NULL")


def select_series(long: DataFrame, countries: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """A range of years of some countries; a warning names unknown ones, and if none is known the table is empty."""
    if countries is not None:
        if lost := [r[0] for r in missing_codes(long, countries).collect()]:  # of the codes asked for
            warnings.warn(f"no data for {', '.join(sorted(lost))}", UserWarning, stacklevel=2)
        long = long.where(F.col("country_code").isin(countries))
    if start is not None:
        long = long.where(F.col("year") >= start)
    return long if end is None else long.where(F.col("year") <= end)


def known_codes(long: DataFrame, codes: list[str]) -> DataFrame:
    """Of the codes asked for, those that the table has."""
    asked = long.sparkSession.createDataFrame([(c,) for c in codes], "country_code string")
    return asked.intersect(long.select("country_code"))


def missing_codes(long: DataFrame, codes: list[str]) -> DataFrame:
    asked = long.sparkSession.createDataFrame([(c,) for c in codes], "country_code string")
    return asked.join(long.select("country_code").distinct(), "country_code", "left_anti")


def without_aggregates(long: DataFrame, compat: bool = False) -> DataFrame:
    """Rows of countries; ``compat`` also leaves out those that older lists did."""
    return long.where(~F.col("country_code").isin([*AGGREGATES, *(COMPAT_EXCLUDED if compat else [])]))


def available_countries(long: DataFrame, exclude_aggregates: bool = False, compat: bool = False) -> list[str]:
    """Codes with a value, sorted."""
    own = long.where("country_code IS NOT NULL AND value IS NOT NULL")
    own = without_aggregates(own, compat) if exclude_aggregates else own
    return [r[0] for r in own.select("country_code").distinct().orderBy("country_code").collect()]  # a few hundred codes


def read_product_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of a classification's products from a CSV file, or from the first one in a zip file.

    Codes stay strings. The file is a few hundred kilobytes; Spark reads it, and
    the driver unpacks a zip's member.
    """
    text = spark.read.text(path, wholetext=True) if not path.endswith(".zip") else None
    if text is not None:
        lines = text.select(F.explode(F.split("value", "\r?\n")).alias("value"))
    else:
        raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            members = [n for n in z.namelist() if n.endswith(".csv")]
            if not members:
                raise ValueError(f"no CSV file in {path}")
            own = z.read(members[0]).decode("utf-8-sig").splitlines()
        lines = spark.createDataFrame([(x,) for x in own], "value string")
    lines = [r[0] for r in lines.where("value <> ''").collect()]  # some thousand short lines
    out = list(csv.DictReader(lines))
    if not out:
        raise ValueError(f"no products in {path}")
    code, name = (next((c for c in out[0] if c.endswith(end)), None) for end in ("_product_code", "_name_short_en"))
    if code is None or name is None:
        raise ValueError(f"no code and name columns; there are {list(out[0])}")
    return spark.createDataFrame([(r[code], r[name]) for r in out], "id string, name string")


@dataclass(frozen=True)
class CommentQuery:
    """Which comments make the author-word network."""

    min_comments: int = 5
    min_length: int = 10
    max_authors: int = 1000
    texts_per_author: int = 50
    min_df: int = 1
    max_features: int | None = None
    min_author_mass: float = 0.0
    min_word_mass: float = 0.0
    binary: bool = False
    seed: str = ""


class CommentLoader:
    """Authors and their words from a comment table (author, body)."""

    def __init__(self, comments: DataFrame, query: CommentQuery = CommentQuery(), cache_path: str | None = None):  # noqa: B008  frozen
        self.comments, self.query, self.cache_path = comments, query, cache_path

    def texts(self) -> DataFrame:
        """(author, user_text, n) of a sample of the authors with enough valid comments."""
        q = self.query
        body = tx.clean_comment(F.col("body"))
        valid = self.comments.where(F.col("author").isNotNull() & F.col("body").isNotNull() & ~tx.is_bot(F.col("author"))).select("author", body.alias("body")).where(F.length(F.trim("body")) > q.min_length)
        often = valid.groupBy("author").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= q.min_comments)
        chosen = tx.author_sample(often, "author", q.max_authors, q.seed)
        return tx.longest_texts(valid.join(chosen, "author", "left_semi"), "author", "body", q.texts_per_author).orderBy(F.desc("n"), "author")

    def load(self) -> Bundle:
        q, texts = self.query, None
        if self.cache_path:
            spark = self.comments.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(self.cache_path)
            if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
                self.texts().write.parquet(self.cache_path)
            texts = spark.read.parquet(self.cache_path)
        edges = tx.user_word_edges(texts if texts is not None else self.texts(), "author", "user_text", q.min_df, q.max_features, q.binary)
        return bundle(mass_filter(edges, q.min_author_mass, q.min_word_mass), "comments", cache_path=str(self.cache_path), query=str(q))


#: Codes of the usual indicators.
INDICATORS = {"gdp_per_capita": "NY.GDP.PCAP.CD", "human_capital_index": "HD.HCI.OVRL", "life_expectancy": "SP.DYN.LE00.IN"}


def load_indicator(spark: SparkSession, folder: str, name: str, countries: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """A series by name or code from ``folder/<code>.json``, whole on disk and cut to the asked range on reading."""
    return select_series(read_indicator_json(spark, f"{folder}/{INDICATORS.get(name, name)}.json"), countries, start, end)


def country_names(long: DataFrame, exclude_aggregates: bool = True) -> DataFrame:
    """(country_code, country_name) of an indicator table, one name for each code."""
    own = without_aggregates(long) if exclude_aggregates else long
    return own.where("country_code IS NOT NULL").groupBy("country_code").agg(F.max_by("country_name", "year").alias("country_name"))


def read_golden(spark: SparkSession, stem: str) -> DataFrame:
    """Edges of a stored test matrix: ``<stem>_matrix.csv`` with row, col, value; ids as in read_golden_scores()."""
    m = read_csv(spark, f"{stem}_matrix.csv", "row int, col int, value double").where("value <> 0")
    return m.select(F.format_string("r%04d", "row").alias("row_id"), F.format_string("c%04d", "col").alias("col_id"), F.col("value").alias("w"))


def read_golden_scores(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(id, score) of a stored result: a CSV file whose first two columns are a 0-based index and the score; ids start with ``prefix``."""
    t = read_csv(spark, path, "i int, score double, more double")
    return t.select(F.concat(F.lit(prefix), F.format_string("%04d", "i")).alias("id"), "score")


# --- fixtures and generators -------------------------------------------------------


def small_fixture(spark: SparkSession) -> Bundle:
    """A tiny author-word network: 5 authors, 8 words, 12 edges, one author with a word of their own."""
    words = {"ann": "map 5 tree 3 river 2", "ben": "map 9 road 7", "cat": "tree 4 river 6 stone 3", "dan": "road 2 cloud 8 rain 5", "eve": "snow 1"}
    cells = [(a, x[i], float(x[i + 1])) for a, x in ((a, t.split()) for a, t in words.items()) for i in range(0, len(x), 2)]
    return bundle(spark.createDataFrame(cells, EDGES), "fixture")


def uniform(*keys: str, seed: int = 42) -> F.Column:
    """A number in [0, 1) from a hash of the columns: the same wherever and however often it runs."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 4294967296.0


def synthetic_users(spark: SparkSession, users: int, words: int, seed: int = 42, binary: bool = False) -> DataFrame:
    """Each user takes 5 to min(words, 30) - 1 different words, with geometric counts (0.3) or 1."""
    grid = _grid(spark, users, words)
    most = min(words, 30) - 5
    take = 5 + F.floor(uniform("i", seed=seed) * most)
    order = F.row_number().over(Window.partitionBy("i").orderBy(uniform("i", "j", seed=seed + 1), "j"))
    count = F.lit(1.0) if binary else 1.0 + F.floor(F.log(1 - uniform("i", "j", seed=seed + 2)) / F.log(F.lit(0.7)))
    picked = grid.select("i", "j", order.alias("k"), take.alias("take"), count.cast("double").alias("w")).where("k <= take")
    return picked.select(F.format_string("user_%d", "i").alias("row_id"), F.format_string("word_%d", "j").alias("col_id"), "w")


def _grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("j"))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.format_string("r%04d", F.col("i")).alias("row_id"), F.format_string("c%04d", F.col("j")).alias("col_id"), F.lit(1.0).alias("w"))


def _runs(spark: SparkSession, rows: int, first: F.Column, last: F.Column) -> DataFrame:
    """Row i has the columns from ``first`` up to but not ``last``."""
    run = spark.range(rows).select(F.col("id").alias("i")).select("i", first.cast("long").alias("a"), last.cast("long").alias("b")).where("a < b")
    return _named(run.select("i", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("j")))


def _jumps(rng: np.random.Generator, n: int, p: float) -> np.ndarray:
    """Of n places those taken, each with chance p: jumps of geometric lengths, so that the work goes with what is taken."""
    if p >= 1:
        return np.arange(n)
    out, at = [], -1
    while p > 0 and at < n:
        step = rng.geometric(p, 16 + int(1.1 * p * (n - at)))
        places = at + np.cumsum(step)
        out.append(places[places < n])
        at = int(places[-1])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sampled(spark: SparkSession, rows: int, segments: Callable[[int], list[tuple[int, int, float]]], seed: int, accept: Callable[[int, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Edges by skip sampling: in each of a row's segments (first, last, chance) places are taken by jumps, and then kept with the chance that ``accept`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], []
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                own = np.concatenate([np.zeros(0, np.int64), *[a + _jumps(rng, b - a, p) for a, b, p in segments(i)]])
                if accept is not None:
                    own = own[rng.random(len(own)) < accept(i, own)]
                at.append(np.full(len(own), i))
                cols.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(cols))], ["i", "j"])

    return _named(spark.range(rows).mapInArrow(run, "i long, j long"))


def nested_network(spark: SparkSession, rows: int, cols: int, offset: int = 5) -> DataFrame:
    """Row i has the first floor((i + 1) cols / rows) + offset columns."""
    return _runs(spark, rows, F.lit(0), F.least(F.lit(cols), F.floor((F.col("i") + 1) * cols / rows) + offset))


def block_network(spark: SparkSession, rows: int, cols: int, blocks: int, p_in: float = 1.0, p_out: float = 0.0, seed: int = 42) -> DataFrame:
    """Equal diagonal blocks: edges with chance p_in inside and p_out outside of them."""

    def segments(i: int) -> list[tuple[int, int, float]]:
        b = i * blocks // rows
        lo, hi = -(-b * cols // blocks), min(cols, -(-(b + 1) * cols // blocks))
        return [(0, lo, p_out), (lo, hi, p_in), (hi, cols, p_out)]

    return _sampled(spark, rows, segments, seed)


def random_network(spark: SparkSession, rows: int, cols: int, p: float, seed: int = 42) -> DataFrame:
    return block_network(spark, rows, cols, 1, p, p, seed)


def core_periphery_network(spark: SparkSession, rows: int, cols: int, core: float = 0.3, p_core: float = 0.9, p_cross: float = 0.4, p_rim: float = 0.05, seed: int = 42) -> DataFrame:
    inner = math.ceil(core * cols)
    return _sampled(spark, rows, lambda i: [(0, inner, p_core if i < core * rows else p_cross), (inner, cols, p_cross if i < core * rows else p_rim)], seed)


def path_network(spark: SparkSession, n: int, width: int = 2) -> DataFrame:
    """Row i has columns i to i + width - 1: a one-dimensional chain."""
    return _runs(spark, n, F.col("i"), F.col("i") + width)


def multi_scale_network(spark: SparkSession, rows: int, cols: int, blocks: int = 3, p_out: float = 0.05, seed: int = 42) -> DataFrame:
    """Diagonal blocks, each nested inside: a block's later rows have more of its columns; a few edges leave the blocks."""

    def segments(i: int) -> list[tuple[int, int, float]]:
        b = i * blocks // rows
        lo, end = -(-b * cols // blocks), min(cols, -(-(b + 1) * cols // blocks))
        hi = min(end, cols * (5 * i * blocks + rows) // (5 * rows * blocks) + 1)  # up to a fifth of a block further
        return [(0, lo, p_out), (lo, hi, 1.0), (hi, cols, p_out)]

    return _sampled(spark, rows, segments, seed)


def smooth_network(spark: SparkSession, rows: int, cols: int, width: float = 0.15, seed: int = 42) -> DataFrame:
    """Edges with a chance that falls as a bell curve of ``width`` with the distance of row and column along one gradient.

    Segments of a third of the width are sampled at their largest chance and thinned.
    """
    place = lambda i: i / max(rows - 1, 1)
    chance = lambda d: np.exp(-d * d / (2 * width * width))
    step = max(1, int(width * cols / 3))

    def segments(i: int) -> list[tuple[int, int, float]]:
        out = []
        for a in range(0, cols, step):
            b = min(cols, a + step)
            ends = [place(i) - x / max(cols - 1, 1) for x in (a, b - 1)]
            out.append((a, b, 1.0 if ends[0] * ends[1] <= 0 else float(chance(min(map(abs, ends))))))
        return out

    def accept(i: int, cols_taken: np.ndarray) -> np.ndarray:
        start, end, chances = zip(*segments(i), strict=True)
        most = np.repeat(chances, np.subtract(end, start))
        return chance(place(i) - cols_taken / max(cols - 1, 1)) / most[cols_taken]

    return _sampled(spark, rows, segments, seed, accept)


def circle_points(spark: SparkSession, per_circle: int = 100, circles: int = 3, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """(id, features, class): points on circles of radius 1, 2, ... with noise, evenly spread in angle."""
    n = spark.range(per_circle * circles).select("id", F.floor(F.col("id") / per_circle).cast("int").alias("class"))
    # Box and Muller: a normal number from two uniform ones.
    normal = F.sqrt(-2 * F.log(1 - uniform("id", seed=seed))) * F.cos(2 * math.pi * uniform("id", seed=seed + 1))
    r, a = F.col("class") + 1 + noise * normal, 2 * math.pi * (F.col("id") % per_circle) / per_circle
    return n.select("id", F.array(r * F.cos(a), r * F.sin(a)).alias("features"), "class")


def remove_edges(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Without each edge with chance ``share``."""
    return edges.where(uniform("row_id", "col_id", seed=seed) >= share)


def remove_share(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Without exactly floor(share * edges) of them, those of least hash."""
    n = int(share * edges.count())
    order = [uniform("row_id", "col_id", seed=seed).asc(), F.col("row_id").asc(), F.col("col_id").asc()]
    return row_numbers(edges, order, "_i").where(F.col("_i") > n).drop("_i")


def add_shortcuts(edges: DataFrame, chance: float, seed: int = 42, most: int = 3) -> DataFrame:
    """Rows of the lowest 30 per cent of degrees get, with a chance, 1 to ``most`` of the 30 per cent last columns that they lack.

    Columns are taken by falling degree, ties by id, so that the last ones are the rarest.
    """
    k = edges.groupBy("row_id").agg(F.count(F.lit(1)).alias("k"))
    cut = F.broadcast(quantiles(k, "k", [0.3], ["_p"]))  # one row
    poor = k.join(cut).where("k <= _p").where(uniform("row_id", seed=seed) < chance)
    poor = poor.select("row_id", (1 + F.floor(uniform("row_id", seed=seed + 1) * most)).alias("_take"))
    c = row_numbers(edges.groupBy("col_id").agg(F.count(F.lit(1)).alias("k")), [F.desc("k"), F.col("col_id").asc()], "_i", 0)
    n = F.broadcast(c.agg(F.count(F.lit(1)).alias("_n")))
    rare = c.join(n).where(F.col("_i") >= F.floor(0.7 * F.col("_n"))).select("col_id")
    free = poor.join(rare).join(edges.select("row_id", "col_id"), ["row_id", "col_id"], "left_anti")
    order = F.row_number().over(Window.partitionBy("row_id").orderBy(uniform("row_id", "col_id", seed=seed + 2), "col_id"))
    new = free.withColumn("_o", order).where(F.col("_o") <= F.col("_take")).select("row_id", "col_id", F.lit(1.0).alias("w"))
    return edges.select("row_id", "col_id", "w").unionByName(new)
