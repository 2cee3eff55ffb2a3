"""How fixed points of bipartite networks are found, at any size and for many networks at once.

A Program says what a block of ids of one side holds, what it sends over the
edges, and how sums that come back change it; it never sees more than a block.
Networks that fit a task (EDGES_PER_CELL edges) are one block a side and run in a
task each, all turns in one go. The edges of larger ones are laid out once as
cells, row range by column range, and stay where they lie; a half-turn ships
blocks of the vector to the cells and their partial sums to the blocks of the
other side. The driver sees a few numbers for each block (sums, largest changes,
small Gram matrices), never ids or vectors. Networks leave the loop as they
settle. Both ways run the same Program and stop at the same turn.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bipartrix.model import row_numbers
from bipartrix.session import cut_lineage

#: Edges of a cell (8 MB); a network of no more is solved in one task.
EDGES_PER_CELL = 1 << 19
#: Ids of a block (1 MB a number) at least; more where a side would have over MOST_BLOCKS.
IDS_PER_BLOCK = 1 << 17
MOST_BLOCKS = 256

SIDES = ("row", "col")


@contextmanager
def spread_out(edges: int = 128, ids: int = 16) -> Iterator[None]:
    """Within it, networks of over so many edges are laid out in cells and blocks of about so many: large ones' way at any size."""
    global EDGES_PER_CELL, IDS_PER_BLOCK
    before = EDGES_PER_CELL, IDS_PER_BLOCK
    EDGES_PER_CELL, IDS_PER_BLOCK = edges, ids
    try:
        yield
    finally:
        EDGES_PER_CELL, IDS_PER_BLOCK = before


State = dict[str, np.ndarray]
Scalars = dict[str, Any]


class Program:
    """What is iterated. Stats are added up over blocks, those named ``max...`` maximised."""

    #: The sides in the order in which a turn changes them, and sides changed once before the first turn.
    order: tuple[str, ...] = ("row", "col")
    opening: tuple[str, ...] = ()

    def start(self, side: str, k: np.ndarray, extra: np.ndarray | None, first: int) -> State:
        """A block's state; k: sums of the edges' weights, ``first``: number of the block's first id."""
        raise NotImplementedError

    def send(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        """What goes over the edges, an entry (or a row of entries) for each id."""
        raise NotImplementedError

    def update(self, side: str, sums: np.ndarray, state: State, scalars: Scalars) -> tuple[State, Scalars]:
        """The block's new state and its stats."""
        raise NotImplementedError

    def gather(self, side: str, stats: Scalars, scalars: Scalars) -> None:
        """Take what the next steps need from the stats of all blocks of a side."""

    def settle(self, side: str, state: State, scalars: Scalars) -> Scalars | None:
        """Stats that need what gather() took; null where there are none."""
        return None

    def changes(self, stats: dict[str, Scalars], scalars: Scalars) -> tuple[float, float]:
        """(change of rows, of columns) in a turn, from both sides' stats."""
        raise NotImplementedError

    def value(self, side: str, state: State, scalars: Scalars) -> np.ndarray:
        """The result: an entry, or a row of entries, for each id."""
        raise NotImplementedError

    def notes(self, scalars: Scalars) -> list[float]:
        """Numbers of the whole network that go with the result."""
        return []


class Outcome:
    """Turns taken, whether they settled, (turn, d_row, d_col) of each, and the scalars at the end."""

    def __init__(self) -> None:
        self.n_iter, self.converged, self.changes, self.scalars = 0, False, [], {}


def turns(op: Local | Grid, program: Program, n_iter: int, tol: float | None, log: bool = True) -> dict[int, Outcome]:
    """Until both changes of a network are below ``tol`` (null or 0: never) or n_iter turns are done.

    Without ``log`` changes that nothing stops at aren't looked for.
    """
    log = log or bool(tol)
    out = {g: Outcome() for g in op.active}
    scalars = {g: x.scalars for g, x in out.items()}
    op.begin(program, scalars)

    def half(side: str) -> dict[int, Scalars]:
        stats = op.half(side)
        for g in op.active:
            program.gather(side, stats[g], scalars[g])
        more = op.settle(side) if log else {}
        return {g: stats[g] | more.get(g, {}) for g in op.active}

    for side in program.opening:
        half(side)
    for turn in range(1, n_iter + 1):
        stats = {side: half(side) for side in program.order}
        done = []
        for g in op.active:
            own = out[g]
            own.n_iter = turn
            if log:
                own.changes.append((turn, *program.changes({side: stats[side][g] for side in SIDES}, scalars[g])))
                own.converged = bool(tol and max(own.changes[-1][1:]) < tol)
            if own.converged or turn == n_iter:
                done.append(g)
        if done:
            op.finish(done)
        if not op.active:
            break
    return out


def _add(a: Scalars, b: Scalars) -> Scalars:
    return {x: (np.maximum if x.startswith("max") else np.add)(a[x], b[x]) for x in b} if a else dict(b)


def product(to: np.ndarray, frm: np.ndarray, w: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Sums of w * x[frm] by ``to``."""
    if x.ndim == 1:
        return np.bincount(to, w * x[frm], size)
    return np.stack([np.bincount(to, w * c[frm], size) for c in np.ascontiguousarray(x.T)], axis=1) if x.shape[1] else np.zeros((size, 0))


# --- a network in a task ---------------------------------------------------------------


class Local:
    """A network in memory: edges (row_id, col_id, w), and rows with a null side that carry the other side's extra number."""

    def __init__(self, pdf: pd.DataFrame):
        edge = pdf["row_id"].notna() & pdf["col_id"].notna()
        e = pdf[edge].sort_values(["row_id", "col_id"])
        self.ids, self.at, self.extra = {}, {}, {}
        for side in SIDES:
            self.ids[side], self.at[side] = np.unique(e[f"{side}_id"].to_numpy(object).astype(str), return_inverse=True)
            own = pdf[~edge & pdf[f"{side}_id"].notna()]
            self.extra[side] = own.set_index(f"{side}_id")["w"].reindex(self.ids[side]).to_numpy(float) if len(own) else None
        self.w = e["w"].to_numpy(float)
        self.k = {side: np.bincount(self.at[side], self.w, len(self.ids[side])) for side in SIDES}
        self.active = [0]

    def begin(self, program: Program, scalars: dict[int, Scalars]) -> None:
        self.program, self.scalars = program, scalars[0]
        self.state = {side: program.start(side, self.k[side], self.extra[side], 0) for side in SIDES}

    def half(self, side: str) -> dict[int, Scalars]:
        other = SIDES[side == "row"]
        x = self.program.send(other, self.state[other], self.scalars)
        sums = product(self.at[side], self.at[other], self.w, x, len(self.ids[side]))
        self.state[side], stats = self.program.update(side, sums, self.state[side], self.scalars)
        return {0: stats}

    def settle(self, side: str) -> dict[int, Scalars]:
        stats = self.program.settle(side, self.state[side], self.scalars)
        return {0: stats} if stats else {}

    def finish(self, groups: list[int]) -> None:
        self.active = []

    def value(self, side: str) -> np.ndarray:
        return self.program.value(side, self.state[side], self.scalars)


RESULT = "side string, id string, k double, x array<double>, n_iter int, converged boolean, notes array<double>"


def solve_in_task(pdf: pd.DataFrame, make: Callable[[], Program], n_iter: int, tol: float | None, log: bool = True) -> pd.DataFrame:
    """RESULT rows of one network, and a row (side ``log``, id: turn, x: changes) for each turn."""
    m, program = Local(pdf), make()
    out = turns(m, program, n_iter, tol, log)[0]
    frames = [pd.DataFrame({"side": side, "id": m.ids[side], "k": m.k[side], "x": [*np.atleast_2d(m.value(side).T).T.tolist()]}) for side in SIDES]
    frames.append(pd.DataFrame({"side": "log", "id": [str(t) for t, *_ in out.changes], "k": np.nan, "x": [list(map(float, d)) for _, *d in out.changes]}))
    whole = pd.concat(frames, ignore_index=True)
    whole["n_iter"], whole["converged"] = out.n_iter, out.converged
    whole["notes"] = [program.notes(out.scalars)] * len(whole)
    return whole


# --- networks that are spread over the cluster -------------------------------------------

KEY = ["g", "p", "q", "s"]


class Grid:
    """Large networks g, side by side. Tables: cells (g, p, q, s, i, j, w), and for each side ids (g, id, k, b, o) and blocks (g, b, state, ways: the cells that its vector goes to)."""

    def __init__(self, edges: DataFrame, extra: DataFrame | None, sizes: dict[int, dict[str, int]]):
        """edges: (g, row_id, col_id, w); extra: (g, side, id, t); sizes: ids of either side of each network."""
        self.spark, self.active = edges.sparkSession, sorted(sizes)
        self.block = {side: {g: max(IDS_PER_BLOCK, -(-n[side] // MOST_BLOCKS)) for g, n in sizes.items()} for side in SIDES}
        self.ids = {side: self._ids(edges, extra, side) for side in SIDES}
        at = {side: self.ids[side].select("g", F.col("id").alias(f"{side}_id"), F.col("b").alias(b), F.col("o").alias(o)) for side, b, o in (("row", "p", "i"), ("col", "q", "j"))}
        placed = cut_lineage(edges.join(at["row"], ["g", "row_id"]).join(at["col"], ["g", "col_id"]).select("g", "p", "q", "i", "j", "w"))
        # A cell with too many edges is split: its blocks are shipped to each part.
        count = placed.groupBy("g", "p", "q").agg(F.count(F.lit(1)).alias("c")).select("g", "p", "q", F.ceil(F.col("c") / EDGES_PER_CELL).cast("int").alias("n"))
        count = cut_lineage(count)
        self.index = cut_lineage(count.select("g", "p", "q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s")))
        dealt = placed.join(count, ["g", "p", "q"]).select("g", "p", "q", F.pmod(F.xxhash64("i", "j"), "n").cast("int").alias("s"), "i", "j", "w")
        packed = cut_lineage(dealt.groupBy(*KEY).applyInArrow(_pack, "g int, p int, q int, s int, i binary, j binary, w binary"))
        # Kept as they are dealt: half-turns bring the vector to them. No more partitions than cells call for: each is a task of every half-turn.
        parts = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2 * self.index.count())
        self.cells = packed.repartition(parts, *KEY).sortWithinPartitions(*KEY).persist(StorageLevel.MEMORY_AND_DISK)
        self.cells.count()  # now, so that plans know how they are dealt
        self.done: dict[str, list[DataFrame]] = {side: [] for side in SIDES}

    def _ids(self, edges: DataFrame, extra: DataFrame | None, side: str) -> DataFrame:
        ids = edges.groupBy("g", F.col(f"{side}_id").alias("id")).agg(F.sum("w").alias("k"))
        t = extra.where(F.col("side") == side).select("g", "id", "t") if extra is not None else None
        ids = ids.join(t, ["g", "id"], "left") if t is not None else ids.withColumn("t", F.lit(None).cast("double"))
        numbered = cut_lineage(row_numbers(ids, [F.col("g"), F.col("id")], "n", 0))
        first = numbered.groupBy("g").agg(F.min("n").alias("f"))
        size = _choose("g", self.block[side])
        return cut_lineage(numbered.join(first, "g").select("g", "id", "k", "t", F.floor((F.col("n") - F.col("f")) / size).cast("int").alias("b"), ((F.col("n") - F.col("f")) % size).cast("int").alias("o")))

    def begin(self, program: Program, scalars: dict[int, Scalars]) -> None:
        self.program, self.scalars = program, scalars
        size = self.block

        def start(side: str) -> DataFrame:
            own = size[side]
            b, c = ("p", "q") if side == "row" else ("q", "p")
            ways = self.index.select("g", F.col(b).alias("b"), F.col(c).alias("c"), "s")

            def f(key: tuple, t: pa.Table, to: pa.Table) -> pa.Table:
                g, b = key[0].as_py(), key[1].as_py()
                order = np.argsort(t.column("o").to_numpy())
                k, x = (t.column(c).to_numpy()[order] for c in ("k", "t"))
                return _block(g, b, program.start(side, k, None if np.isnan(x).all() else x, b * own[g]), {}, np.stack([to.column(x).to_numpy() for x in ("c", "s")]).astype(np.int32).tobytes())

            return cut_lineage(self.ids[side].groupBy("g", "b").cogroup(ways.groupBy("g", "b")).applyInArrow(f, BLOCK))

        self.state = {side: start(side) for side in SIDES}

    def shipped(self, side: str) -> DataFrame:
        """(g, b, y): partial sums for the blocks of a side."""
        other = SIDES[side == "row"]
        to, frm, own, theirs = (("i", "j", "p", "q") if side == "row" else ("j", "i", "q", "p"))
        program, scalars = self.program, self.scalars

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, b, state, ways in zip(*(batch.column(c).to_pylist() for c in ("g", "b", "state", "ways")), strict=True):
                    x = pickle.dumps(program.send(other, pickle.loads(state), scalars[g]))
                    for c, s in np.frombuffer(ways, np.int32).reshape(2, -1).T.tolist():  # a copy a cell, one at a time
                        at = {"g": g, theirs: b, own: c, "s": s}
                        yield pa.RecordBatch.from_arrays([*(pa.array([at[k]], pa.int32()) for k in KEY), pa.array([x], pa.binary())], [*KEY, "x"])

        def partial(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for x in map(pickle.loads, right.column("x").to_pylist()):
                for c in left.select(["g", own, "i", "j", "w"]).to_pylist():
                    at = np.frombuffer(c[to], np.int32)
                    y = product(at, np.frombuffer(c[frm], np.int32), np.frombuffer(c["w"]), x, int(at.max(initial=-1)) + 1)
                    rows.append((c["g"], c[own], pickle.dumps(y)))
            g, b, y = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.table({"g": pa.array(g, pa.int32()), "b": pa.array(b, pa.int32()), "y": pa.array(y, pa.binary())})

        ship = self.state[other].mapInArrow(send, "g int, p int, q int, s int, x binary")
        return self.cells.groupBy(*KEY).cogroup(ship.groupBy(*KEY)).applyInArrow(partial, "g int, b int, y binary")

    def half(self, side: str) -> dict[int, Scalars]:
        program, scalars = self.program, self.scalars

        def update(key: tuple, t: pa.Table) -> pa.Table:
            g, b = key[0].as_py(), key[1].as_py()
            state, ways = next((pickle.loads(x), way) for x, way in zip(t.column("state").to_pylist(), t.column("ways").to_pylist(), strict=True) if x is not None)
            n, sums = len(next(iter(state.values()))), None
            for y in t.column("y").to_pylist():
                if y is not None:
                    y = pickle.loads(y)
                    sums = np.zeros((n, *y.shape[1:])) if sums is None else sums
                    sums[: len(y)] += y
            return _block(g, b, *program.update(side, sums, state, scalars[g]), ways)

        none = F.lit(None).cast("binary")
        both = self.shipped(side).select("g", "b", "y", none.alias("state"), none.alias("ways")).unionByName(self.state[side].select("g", "b", none.alias("y"), "state", "ways"))
        self.state[side] = cut_lineage(both.groupBy("g", "b").applyInArrow(update, BLOCK))
        return self._stats(self.state[side])

    def _stats(self, blocks: DataFrame) -> dict[int, Scalars]:
        out: dict[int, Scalars] = {g: {} for g in self.active}
        for g, stats in blocks.select("g", "stats").collect():  # a few numbers for each block
            out[g] = _add(out[g], pickle.loads(stats))
        return out

    def settle(self, side: str) -> dict[int, Scalars]:
        program, scalars = self.program, self.scalars
        if type(program).settle is Program.settle:
            return {}

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, b, state in zip(*(batch.column(c).to_pylist() for c in ("g", "b", "state")), strict=True):
                    yield from _block(g, b, {}, program.settle(side, pickle.loads(state), scalars[g]) or {}).to_batches()

        return self._stats(self.state[side].mapInArrow(f, BLOCK))

    def finish(self, groups: list[int]) -> None:
        for side in SIDES:
            self.done[side].append(self.state[side].where(F.col("g").isin(groups)))
            self.state[side] = self.state[side].where(~F.col("g").isin(groups))
        self.active = [g for g in self.active if g not in groups]

    def values(self) -> DataFrame:
        """(g, side, id, k, x) of all networks."""
        program, scalars = self.program, self.scalars
        out = []
        for side in SIDES:

            def f(batches: Iterator[pa.RecordBatch], side: str = side) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for g, b, state in zip(*(batch.column(c).to_pylist() for c in ("g", "b", "state")), strict=True):
                        x = np.atleast_2d(program.value(side, pickle.loads(state), scalars[g]).T).T
                        at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), g, np.int32)), pa.array(np.full(len(x), b, np.int32)), pa.array(np.arange(len(x), dtype=np.int32)), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["g", "b", "o", "x"])

            blocks = self.done[side][0]
            for more in self.done[side][1:]:
                blocks = blocks.unionByName(more)
            own = blocks.mapInArrow(f, "g int, b int, o int, x array<double>").join(self.ids[side], ["g", "b", "o"])
            out.append(own.select("g", F.lit(side).alias("side"), "id", "k", "x"))
        return out[0].unionByName(out[1])


BLOCK = "g int, b int, state binary, stats binary, ways binary"


def _block(g: int, b: int, state: State, stats: Scalars, ways: bytes = b"") -> pa.Table:
    blobs = {"state": pickle.dumps(state), "stats": pickle.dumps(stats), "ways": ways}
    return pa.table({"g": pa.array([g], pa.int32()), "b": pa.array([b], pa.int32())} | {k: pa.array([x], pa.binary()) for k, x in blobs.items()})


def _pack(key: tuple, t: pa.Table) -> pa.Table:
    cols = {c: pa.array([t.column(c).to_numpy().astype(k).tobytes()], pa.binary()) for c, k in (("i", np.int32), ("j", np.int32), ("w", np.float64))}
    return pa.table({c: pa.array([x.as_py()], pa.int32()) for c, x in zip(KEY, key, strict=True)} | cols)


def _choose(name: str, values: dict[int, int]) -> Column:
    """The value of each key, of which there are few."""
    out = F.lit(None).cast("long")
    for g, v in values.items():
        out = F.when(F.col(name) == g, F.lit(v)).otherwise(out)
    return out


# --- both -------------------------------------------------------------------------------


def solve(edges: DataFrame, make: Callable[[], Program], n_iter: int, tol: float | None, by: Iterable[str] = (), extra: DataFrame | None = None, log: bool = True) -> DataFrame:
    """(by..., RESULT) of each network of ``edges``, which the columns ``by`` tell apart; the log, if asked, as rows of side ``log``.

    extra: (side, id, t), a number for each id, where there is one network.
    """
    by = list(by)
    e = edges.select(*by, "row_id", "col_id", "w")
    if not getattr(edges, "_is_cut", False):
        e = cut_lineage(e)
    kinds = "".join(f"{c} {edges.schema[c].dataType.simpleString()}, " for c in by)
    large = e.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > EDGES_PER_CELL).collect()  # a row for each large network
    small = e
    if by and large:
        names = cut_lineage(edges.sparkSession.createDataFrame([(*[r[c] for c in by], g) for g, r in enumerate(large)], f"{kinds}g int"))
        same = [e[c].eqNullSafe(names[c]) for c in by]
        small, spread = e.join(F.broadcast(names), same, "left_anti"), e.join(F.broadcast(names), same).select("g", "row_id", "col_id", "w")
    else:
        spread = e.select(F.lit(0).alias("g"), "row_id", "col_id", "w")
    out = None
    if by or not large:

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            found = solve_in_task(pdf, make, n_iter, tol, log)
            for name, value in zip(by, key, strict=False):
                found[name] = value
            return found

        if extra is not None:
            row = F.when(F.col("side") == "row", F.col("id")).alias("row_id")
            small = small.unionByName(extra.select(row, F.when(F.col("side") == "col", F.col("id")).alias("col_id"), F.col("t").alias("w")))
        keyed = small if by else small.withColumn("_g", F.lit(0))
        out = keyed.groupBy(*(by or ["_g"])).applyInPandas(run, kinds + RESULT)
    if large:
        sizes = {g: {"row": n, "col": m} for g, n, m in spread.groupBy("g").agg(F.countDistinct("row_id"), F.countDistinct("col_id")).collect()}
        grid = Grid(spread, None if extra is None else extra.withColumn("g", F.lit(0)), sizes)
        program = make()
        ends = turns(grid, program, n_iter, tol, log)
        info = [(g, x.n_iter, x.converged, program.notes(x.scalars)) for g, x in ends.items()]
        info = edges.sparkSession.createDataFrame(info, "g int, n_iter int, converged boolean, notes array<double>")
        seen = [(g, "log", str(t), None, list(map(float, d))) for g, x in ends.items() for t, *d in x.changes]
        seen = edges.sparkSession.createDataFrame(seen, "g int, side string, id string, k double, x array<double>")
        found = cut_lineage(grid.values()).unionByName(seen).join(F.broadcast(info), "g")  # a row for each large network
        grid.cells.unpersist()
        found = found.join(F.broadcast(names), "g") if by else found
        found = found.select(*by, *[x.split()[0] for x in RESULT.split(", ")])
        out = found if out is None else out.unionByName(found)
    return out
