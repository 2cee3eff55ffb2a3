"""Components of documents whose shingle sets are similar, from buckets in which similar ones meet.

Documents with equal sets are one class. In turns, members of a bucket are
searched for what is similar to one of them, its pivot; components are found
after each turn, and only buckets that still hold several go on. What is then
left is compared by its rarest shingles: sets that are similar enough share one
of them, and sizes and places bound what they can share at all (prefix and
position filters, Xiao et al. 2008), so that no link is lost and members of a
large bucket that can't be linked never meet. No bucket is capped. Links are
confirmed on the words themselves, not on keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartrix.llm.common import holds, is_empty, materialise, only, release, slices
from bipartrix.llm.components import connected_components
from bipartrix.llm.shingles import chunks, cuts, exact_sets, forget, shingle_sets

#: From the size of a query's set, sets of documents and their sizes: which documents are similar enough.
Search = Callable[[np.ndarray, list[np.ndarray], int], np.ndarray]
#: (text of each shingle, its key, offsets of texts) to (bucket keys, offsets of texts in them).
Buckets = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def begin() -> None:
    only("shingles")
    holds("shingles", forget)


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))


def set_keys(h: np.ndarray, second: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits of each whole set, null for empty ones."""
    both = np.stack([h, second], axis=1)
    return [hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def signatures(docs: DataFrame, shingle_words: int, buckets: Buckets) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set), buckets; the last two null or empty for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for part in chunks(texts):
                d, h, second, off = shingle_sets(texts[part], shingle_words)
                keys, ends = buckets(d, h, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], pa.array(np.diff(off).astype(np.int64)), pa.array(set_keys(h, second, off), pa.binary()), lists(keys, ends)],
                    ["doc_id", "n_shingles", "set_key", "buckets"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, buckets array<long>")


def texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """(node, text) of some classes: a text that does have the class's set."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", "set_key", F.col("rep").alias("_rep"))
    texts = docs.select(F.col("doc_id").alias("_rep"), "text").join(wanted, "_rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in slices(batches):
            raw = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            keys = batch.column(1).to_pylist()
            for part in chunks(raw):
                _, h, second, off = shingle_sets(raw[part], shingle_words)
                same = [x == y for x, y in zip(set_keys(h, second, off), keys[part], strict=True)]
                yield pa.RecordBatch.from_arrays([c[part.start : part.stop].filter(pa.array(same, pa.bool_())) for c in (batch.column(0), batch.column(2))], ["node", "text"])

    return texts.select("node", "set_key", "text").mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def found_by_overlap(query: np.ndarray, sets: list[np.ndarray], threshold_pct: int) -> np.ndarray:
    """Which of the sets are similar enough to the query's, by what they share."""
    sizes = np.array([len(s) for s in sets])
    own = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    common = np.bincount(own[query[at] == flat], minlength=len(sets))
    return 100 * common >= threshold_pct * (sizes + len(query) - common)


def verified(texts: DataFrame, pairs: DataFrame, shingle_words: int, threshold_pct: int, search: Search) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough; b's text is the query, and a's of one batch are its documents."""
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("shingles")
        for batch in slices(batches):
            node = [batch.column(c).to_numpy() for c in ("a", "b")]
            text = [batch.column(c).cast(pa.binary()).to_pylist() for c in ("ta", "tb")]
            for part in cuts([len(x) + len(y) for x, y in zip(*text, strict=True)], 1 << 22):
                own = dict(zip(node[0][part].tolist() + node[1][part].tolist(), text[0][part] + text[1][part], strict=True))  # each text once
                place = {x: i for i, x in enumerate(own)}
                _, code, off = exact_sets(list(own.values()), shingle_words)
                sets = lambda x, code=code, off=off, place=place: code[off[place[x]] : off[place[x] + 1]]
                order = part.start + np.argsort(node[1][part], kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(node[1][order])) + 1):
                    if len(rows):
                        good = search(sets(node[1][rows[0]]), [sets(x) for x in node[0][rows]], threshold_pct)
                        yield pa.RecordBatch.from_arrays([pa.array(node[0][rows[good]]), pa.array(node[1][rows[good]])], ["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "ta", "b", "tb").mapInArrow(run, "a long, b long")


def open_sets(texts: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """(node, comp, shingles as 64-bit keys) of some nodes (node, comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in slices(batches):
            raw = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            for part in chunks(raw):
                _, h, _, off = shingle_sets(raw[part], shingle_words)
                yield pa.RecordBatch.from_arrays([*[c[part.start : part.stop] for c in batch.columns[:2]], lists(h, off)], ["node", "comp", "shingles"])

    return nodes.join(texts, "node").select("node", "comp", "text").mapInArrow(run, "node long, comp long, shingles array<long>")


def rare_shingles(sets: DataFrame, threshold_pct: int) -> DataFrame:
    """(token, node, n, comp, pos, index): of (node, comp, shingles) those, from the rarest on, of which similar sets share one.

    A set of n shingles and one of m <= n that are similar enough share at least
    t * n, so one of the larger's first n - ceil(t * n) + 1 in an order common to
    all; and at least 2 t m / (1 + t), so it is one of the smaller's first
    m - ceil(2 t m / (1 + t)) + 1, which ``index`` marks. Shingles that no other set
    here holds count as places but can't be shared.
    """
    each = sets.select("node", "comp", F.explode("shingles").alias("token"))
    often = materialise(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "groups-often")
    ranked = each.join(often, "token", "left").select("node", "comp", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token").alias("x"))
    ranked = ranked.groupBy("node").agg(F.first("comp").alias("comp"), F.array_sort(F.collect_list("x")).alias("t"))
    ranked = ranked.select("node", "comp", "t", F.size("t").cast("long").alias("n"))
    head = F.slice("t", F.lit(1), (F.col("n") - F.expr(f"({threshold_pct} * n + 99) div 100") + 1).cast("int"))
    short = F.col("n") - F.expr(f"({2 * threshold_pct} * n + {99 + threshold_pct}) div {100 + threshold_pct}") + 1
    out = ranked.select("node", "comp", "n", short.alias("short"), F.posexplode(head).alias("pos", "x")).where("x.df > 1")
    out = materialise(out.select("x.token", "node", "n", "comp", "pos", (F.col("pos") < F.col("short")).alias("index")), "groups-rare")
    release(often)
    return out


def first_shared(rare: DataFrame, threshold_pct: int) -> DataFrame:
    """(node, pivot) of different components that may be similar enough; pivot has no more shingles.

    Where two sets first share a shingle, at places i and j of their common
    order, they share n - i and pn - j at most.
    """
    other = rare.where("index").select("token", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("comp").alias("pc"), F.col("pos").alias("pp"))
    need = threshold_pct * (F.col("n") + F.col("pn"))  # 100 |A and B| >= t |A or B|, with |A or B| = n + pn - |A and B|
    may = ((100 + threshold_pct) * (F.col("n") - F.col("pos")) >= need) & ((100 + threshold_pct) * (F.col("pn") - F.col("pp")) >= need)
    smaller = (F.col("pn") < F.col("n")) | ((F.col("pn") == F.col("n")) & (F.col("pivot") < F.col("node")))
    return rare.join(other, "token").where((F.col("comp") != F.col("pc")) & smaller & may).select("node", "pivot")


def similar_groups(docs: DataFrame, shingle_words: int, threshold_pct: int, buckets: Buckets, search: Search = found_by_overlap, pivot_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Two documents are linked when 100 * |A and B| >= threshold_pct * |A or B| for
    their shingle sets and a bucket holds both; component_id is the least doc_id
    that links reach. Texts that are null or without a word have an empty set and
    no link. Rows with a null doc_id can't be named: they take no part in linking
    and have a null component_id. Rows that repeat a doc_id each get a row.
    Columns other than doc_id and text are ignored, whatever their names.
    """
    found = materialise(signatures(docs, shingle_words, buckets).withColumn("uid", F.monotonically_increasing_id()), "groups-signatures")
    first = F.min(F.struct(F.col("doc_id").alias("d"), F.col("uid").alias("u")))
    classes = materialise(
        found.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(first.alias("f")).select("set_key", F.col("f.d").alias("rep"), F.col("f.u").alias("node")),
        "groups-classes",
    )
    own = found.select(F.col("uid").alias("node"), "buckets", "n_shingles").join(classes.select("node"), "node", "left_semi")
    postings = own.select(F.explode("buckets").alias("bucket"), "node", F.col("n_shingles").alias("n"))
    crowded = postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    postings = materialise(postings.join(crowded, "bucket", "left_semi"), "groups-buckets")
    texts = materialise(texts_of(docs, classes, postings.select("node").distinct(), shingle_words), "groups-texts")

    fits = (100 * F.least("n", "pn") >= threshold_pct * F.greatest("n", "pn")) & (F.col("node") != F.col("pivot"))
    links, comp, done = None, None, [postings, texts]
    for turn in range(pivot_rounds + 1):
        open_ = postings.withColumn("comp", F.col("node"))
        if comp is not None:
            open_ = postings.join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
            mixed = open_.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
            open_ = materialise(open_.join(mixed, "bucket", "left_semi"), "groups-open")
            done.append(open_)
        if is_empty(open_):
            break
        if turn < pivot_rounds:  # every member against one pivot of its bucket: the least node, later a random one for each bucket
            order = F.struct(F.col("node").alias("o")) if turn == 0 else F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("o"))
            pivots = open_.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("comp").alias("pc"))).alias("p")).select("bucket", "p.pivot", "p.pn", "p.pc")
            met = open_.join(pivots, "bucket").where(fits)
            met = met.where("comp <> pc") if comp is not None else met
        else:
            rare = rare_shingles(open_sets(texts, open_.select("node", "comp").distinct(), shingle_words), threshold_pct)
            done.append(rare)
            met = first_shared(rare, threshold_pct)
        pairs = materialise(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "groups-pairs")
        done.append(pairs)
        if is_empty(pairs):
            continue
        new = materialise(verified(texts, pairs, shingle_words, threshold_pct, search), "groups-links")
        done.append(new)
        links = new if links is None else links.unionByName(new)
        if comp is not None:
            release(comp)
        comp = connected_components(links, "a", "b")
    if comp is None:
        named = classes.select("set_key", F.col("rep").alias("component_id"))
    else:
        joined = classes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = joined.select("set_key", "root").join(least, "root").drop("root")
    release(*done)
    out = found.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
