"""Histogram gradient boosting (MOD-2, 3, 5, 6, 9, 10, 12, 13): softmax objective, leaf-wise growth, learned directions for nulls.

Spark aggregates, the driver only decides.  Features are binned once at quantiles, and a row is its label, its
scores and the codes (feature x bins + bin) of the features it has.  A pass over the rows computes gradients and hessians
of all classes from the scores, routes each row through the K trees being grown and emits partial sums per (class, node,
code); Spark adds them up to histograms.  Of two siblings only the one with fewer rows is summed, the other's
histogram is its parent's minus that one.  Windows over the histograms give both children's sums for each split, once with the
rows that lack the feature on the left and once on the right, and one row per node, the best split, reaches the driver.
Histograms of up to ``CELLS_ON_DRIVER`` cells, whatever the number of rows, are not written and searched by Spark: the driver
takes the summed cells of a pass and finds the same splits, so that a pass is one job.  Rows of up to ``CODES_AT_ONCE`` codes, which a
task holds anyway, are not passed over again and again: one task grows all rounds from them, in the same way.

``growth="leaf"`` splits the leaf of the largest gain first, from a priority queue, until ``num_leaves``; the leaves that
the queue would take next are expanded in the same pass, which changes the number of passes and never the tree.
``growth="depth"`` splits every leaf with a gain down to ``max_depth``.  All K trees of a round grow in the same passes.

Null and NaN features are absent, and so are zeros of a sparse vector; each split learns which way absent rows go.  Ties go to
the lower feature, then the lower bin, then absent rows to the right.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table

#: Scores are written anew after so many rounds, so that a pass applies few trees.
CUT_ROUNDS = 10
ROWS_PER_PARTITION = 500_000
TOTAL = -1  # the code of a node's sums over all of its rows
#: A task sums so many codes before it hands cells over: few rows for Spark to add up, and some 200 MB at most.
CODES_AT_ONCE = 1 << 22
#: The driver searches the histograms of a round for splits if they have so many cells at most: 28 bytes a cell.
CELLS_ON_DRIVER = 1 << 22

try:  # the tasks run this module's functions: send them by value
    from pyspark import cloudpickle as _cp
    import sys as _sys
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files
    pass


@dataclass(frozen=True)
class Settings:
    """``leaf`` and ``depth`` below hold the usual settings of the two kinds of boosters."""

    objective: str  # softmax, logistic or squared
    rounds: int = 100
    learning_rate: float = 0.1
    growth: str = "leaf"
    num_leaves: int = 31
    max_depth: int = 0  # 0: no bound
    min_rows: int = 20
    min_hessian: float = 1e-3
    reg_lambda: float = 0.0
    max_bins: int = 255


def leaf(objective: str, **more) -> Settings:
    return Settings(objective, **more)


def depth(objective: str, **more) -> Settings:
    return Settings(objective, **({"growth": "depth", "learning_rate": 0.3, "max_depth": 6, "min_rows": 1, "min_hessian": 1.0,
                                   "reg_lambda": 1.0, "max_bins": 256} | more))


# ---------------------------------------------------------------- trees

@dataclass
class Tree:
    """Nodes as lists; a leaf has ``left`` -1.  ``bin``: present rows of a bin up to it go left."""

    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, s: dict) -> tuple[int, int]:
        kids = len(self.left), len(self.left) + 1
        self.left[node], self.right[node] = kids
        self.feature[node], self.bin[node], self.missing_left[node], self.gain[node] = s["feature"], s["bin"], s["missing_left"], s["gain"]
        for n in (s["n_left"], s["n"] - s["n_left"]):
            for column, empty in ((self.left, -1), (self.right, -1), (self.feature, -1), (self.bin, 0), (self.missing_left, False),
                                  (self.gain, 0.0), (self.rows, n), (self.value, 0.0)):
                column.append(empty)
        return kids


class Rows:
    """The codes of some rows, by feature."""

    def __init__(self, codes: pa.ListArray, bins: int):
        self.n, self.bins = len(codes), bins
        self.flat = codes.flatten().to_numpy()
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(codes.offsets.to_numpy()))
        self.columns: dict[int, np.ndarray] = {}

    def find(self, features: set[int]) -> None:
        """Pick out the columns of features that trees ask for, in one pass over the codes."""
        new = np.array(sorted(features - self.columns.keys()), np.int64)
        if not len(new):
            return
        last = int(max(new[-1], self.flat.max() // self.bins if len(self.flat) else 0))
        asked = np.zeros(last + 1, bool)
        asked[new] = True
        feature = self.flat // self.bins
        at = np.flatnonzero(asked[feature])
        at = at[np.argsort(feature[at], kind="stable")]
        ends = np.searchsorted(feature[at], np.append(new, last + 1))
        for f, a, b in zip(new.tolist(), ends, ends[1:]):
            column = np.full(self.n, -1, np.int32)
            column[self.row[at[a:b]]] = self.flat[at[a:b]] - f * self.bins
            self.columns[f] = column

    def column(self, feature: int) -> np.ndarray:
        """Each row's bin of the feature, -1 where it is absent."""
        self.find({feature})
        return self.columns[feature]

    def route(self, t: Tree) -> np.ndarray:
        """The leaf of each row."""
        self.find({f for f, left in zip(t.feature, t.left) if left >= 0})
        node, rows = np.zeros(self.n, np.int64), {0: np.arange(self.n)}
        for j in range(len(t.left)):  # children have higher numbers than their parent
            if t.left[j] >= 0:
                at = rows.pop(j)
                b = self.columns[t.feature[j]][at]
                goes_left = np.where(b < 0, t.missing_left[j], b <= t.bin[j])
                for kid, some in ((t.left[j], at[goes_left]), (t.right[j], at[~goes_left])):
                    rows[kid] = some
                    node[some] = kid
        return node


def gradients(objective: str, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x outputs) first and second derivatives of the loss."""
    if objective == "squared":
        return scores - y[:, None], np.ones_like(scores)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-scores))
        return p - y[:, None], p * (1 - p)
    e = np.exp(scores - scores.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    g = p.copy()
    g[np.arange(len(y)), y.astype(int)] -= 1
    return g, p * (1 - p)


def added(rows: Rows, scores: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    """The scores after some more rounds."""
    scores = scores.copy()
    for trees in rounds:
        for k, t in enumerate(trees):
            scores[:, k] += np.array(t.value)[rows.route(t)]
    return scores


def _matrix(column: pa.ListArray, k: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, k)


# ---------------------------------------------------------------- binning

def _present(features: Column, kind: str) -> Column:
    """(feature, value) of what a row has."""
    pair = lambda v, i: F.struct(i.cast("int").alias("f"), v.cast("double").alias("v"))
    if kind == "vector":  # its own entries: a sparse vector is not filled up
        own = F.unwrap_udt(features)
        sparse = F.zip_with(own["indices"], own["values"], lambda i, v: pair(v, i))
        pairs = F.when(own["type"] == 0, sparse).otherwise(F.transform(own["values"], pair))
    else:
        pairs = F.transform(features, pair)
    there = lambda p: p["v"].isNotNull() & ~F.isnan(p["v"])
    return F.filter(pairs, (lambda p: there(p) & (p["v"] != 0)) if kind == "vector" else there)


def sparse_rows(df: DataFrame, features: str | Sequence[str], key: str, label: str | None) -> DataFrame:
    """``key, y, has``: a vector column (zeros absent) or numeric columns (nulls and NaN absent) as present features."""
    has = _present(F.col(features), "vector") if isinstance(features, str) else _present(F.array(*[F.col(c).cast("double") for c in features]), "array")
    y = F.col(label).cast("double") if label else F.lit(None).cast("double")
    return df.select(F.col(key).alias("key"), y.alias("y"), has.alias("has"))


def bin_edges(rows: DataFrame, bins: int) -> dict[int, np.ndarray]:
    """Per feature the upper ends of its bins: quantiles of the values that rows have, the largest included."""
    at = [float(i + 1) / bins for i in range(bins)]
    got = (rows.select(F.explode("has").alias("e")).groupBy(F.col("e.f").alias("f"))
           .agg(F.array_sort(F.array_distinct(F.percentile_approx("e.v", F.array(*map(F.lit, at)), F.lit(10_000)))).alias("edges")).collect())
    return {r["f"]: np.array(r["edges"]) for r in got}


def binned(rows: DataFrame, edges: dict[int, np.ndarray], bins: int) -> DataFrame:
    """``key, y, codes``; values beyond the last edge are in the last bin, features without edges are absent."""
    bc = rows.sparkSession.sparkContext.broadcast(edges)
    flat = rows.select("key", "y", F.col("has.f").alias("f"), F.col("has.v").alias("v"))
    types = dict(flat.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs = batch.column("f").offsets.to_numpy()
            f, v = (batch.column(c).flatten().to_numpy().astype(t) for c, t in (("f", np.int64), ("v", float)))
            code = np.full(len(f), -1, np.int64)
            order = np.argsort(f, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(f[order]) != 0, True)) + 1 if len(f) else []
            low = 0
            for high in ends:
                at = order[low:high]
                e = bc.value.get(int(f[at[0]]))
                if e is not None:
                    code[at] = f[at] * bins + np.minimum(np.searchsorted(e, v[at], "left"), len(e) - 1)
                low = high
            keep = code >= 0
            before = np.concatenate([[0], np.cumsum(keep)])
            lists = pa.ListArray.from_arrays(pa.array(before[offs], pa.int32()), pa.array(code[keep], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), lists], names=["key", "y", "codes"])

    return flat.mapInArrow(run, f"key {types['key']}, y double, codes array<int>")


# ---------------------------------------------------------------- histograms and splits

def joined(batches: Iterator[pa.RecordBatch], lists: str, entries: int) -> Iterator[pa.RecordBatch]:
    """The rows in larger batches: of about so many entries of the list column ``lists``, or one batch at least."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(lists).flatten())
        if size >= entries:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def cell_sums(rows: Rows, tree: Tree, nodes: dict[int, int | None], g: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
    """Per wanted node: the node, its sibling, codes (``TOTAL`` first, then in order) and the sums of g, h and 1 of the rows with a code."""
    place = np.full(len(tree.left), len(nodes), np.int16 if len(nodes) < 1 << 15 else np.int32)  # of a node among those wanted, the others' last
    place[list(nodes)] = np.arange(len(nodes))
    place = place[rows.route(tree)]
    totals = [np.bincount(place, w, len(nodes) + 1) for w in (g, h)] + [np.bincount(place, minlength=len(nodes) + 1)]
    at = place[rows.row]
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(len(nodes) + 1))
    for j, (own, other) in enumerate(nodes.items()):
        if not totals[2][j]:
            continue
        some = order[ends[j]:ends[j + 1]]
        code, row = rows.flat[some], rows.row[some]
        span = int(code.max()) + 1 if len(code) else 0
        if span > 8 * len(code):  # few of the cells occur
            cell, code = np.unique(code, return_inverse=True)
            span = len(cell)
        else:
            cell = np.arange(span)
        n = np.bincount(code, minlength=span)
        used = np.flatnonzero(n)
        yield (own, other, np.append(TOTAL, cell[used]), *(np.append(t[j], np.bincount(code, w[row], span)[used]) for t, w in zip(totals, (g, h))),
               np.append(totals[2][j], n[used]))


def histograms(rows: DataFrame, settings: Settings, done: list[list[Tree]], growing: list[Tree], wanted: list[dict[int, int | None]],
               parents: DataFrame | None = None) -> DataFrame:
    """``k, node, code, g, h, n`` of nodes of each class's tree; code ``TOTAL`` has the sums over all rows.

    ``wanted``: per class the nodes whose rows are summed, each with its sibling or None.  A sibling is never summed: its
    histogram is its parent's (``parents``, under the sibling's number) minus that of the node."""
    s = settings  # trees travel with the task, whose classes are sent by value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, "codes", CODES_AT_ONCE):
            r = Rows(batch.column("codes"), s.max_bins)
            scores = added(r, _matrix(batch.column("f"), len(growing)), done)
            g, h = gradients(s.objective, scores, batch.column("y").to_numpy())
            for k, (tree, nodes) in enumerate(zip(growing, wanted)):
                if not nodes:
                    continue
                for own, other, code, *sums in cell_sums(r, tree, nodes, g[:, k], h[:, k]):
                    n = len(code)
                    for node, sign in ((own, 1), (other, -1)):
                        if node is not None:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, k), pa.int32()), pa.array(np.full(n, node), pa.int32()), pa.array(code, pa.int32()),
                                 *(pa.array((sign * v).astype(t)) for v, t in zip(sums, (float, float, np.int64)))],
                                names=["k", "node", "code", "g", "h", "n"])

    cells = rows.select("y", "codes", "f").mapInArrow(run, "k int, node int, code int, g double, h double, n long")
    cells = cells if parents is None else cells.unionByName(parents)
    return cells.groupBy("k", "node", "code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).filter("n > 0")


def split_gains(hist: DataFrame, s: Settings) -> DataFrame:
    """Every allowed split of every node: ``k, node, feature, bin, missing_left, gain, n_left, n, ...`` (sums of the left child and
    of the node)."""
    total = hist.filter(F.col("code") == TOTAL).select("k", "node", *[F.col(c).alias(f"{c}_all") for c in "ghn"])
    cells = hist.filter(F.col("code") != TOTAL).withColumns({"feature": F.floor(F.col("code") / s.max_bins).cast("int"),
                                                             "bin": F.pmod("code", F.lit(s.max_bins))})
    of = Window.partitionBy("k", "node", "feature")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.withColumns({f"{c}_upto": F.sum(c).over(upto) for c in "ghn"} | {f"{c}_have": F.sum(c).over(every) for c in "ghn"})
    # One row per node: at most as many as the trees being grown have leaves.
    cells = cells.join(F.broadcast(total), ["k", "node"])
    ways = cells.withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True)))).filter(
        ~F.col("missing_left") | (F.col("n_all") > F.col("n_have")))
    for c in "ghn":
        absent = F.col(f"{c}_all") - F.col(f"{c}_have")
        ways = ways.withColumn(f"{c}_left", F.col(f"{c}_upto") + F.when(F.col("missing_left"), absent).otherwise(F.lit(0)))
    right = lambda c: F.col(f"{c}_all") - F.col(f"{c}_left")
    part = lambda g, h: g * g / (h + F.lit(s.reg_lambda))
    gain = part(F.col("g_left"), F.col("h_left")) + part(right("g"), right("h")) - part(F.col("g_all"), F.col("h_all"))
    least = float(max(s.min_hessian, 1e-12))
    allowed = ((F.col("n_left") >= max(1, s.min_rows)) & (right("n") >= max(1, s.min_rows)) & (F.col("h_left") >= least) & (right("h") >= least))
    return ways.filter(allowed).select("k", "node", "feature", "bin", "missing_left", gain.alias("gain"), "g_left", "h_left", "n_left",
                                       F.col("g_all").alias("g"), F.col("h_all").alias("h"), F.col("n_all").alias("n"))


def best_splits(hist: DataFrame, s: Settings) -> DataFrame:
    """One row per node: its sums ``g, h, n`` and its best split (``feature`` null if none gains)."""
    gains = split_gains(hist, s).filter("gain > 1e-12")
    # Gains that differ by rounding only are a tie: compare nine digits of their logarithm.
    order = F.struct(F.round(F.log2("gain"), 9).alias("o"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("m"),
                     *[F.col(c) for c in ("gain", "feature", "bin", "missing_left", "g_left", "h_left", "n_left")])
    best = gains.groupBy("k", "node").agg(F.max(order).alias("best"))
    total = hist.filter(F.col("code") == TOTAL).select("k", "node", "g", "h", "n")
    return total.join(best, ["k", "node"], "left").select("k", "node", "g", "h", "n", *[
        f"best.{c}" for c in ("gain", "feature", "bin", "missing_left", "g_left", "h_left", "n_left")])


Cells = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # a node's codes in order (``TOTAL`` first), sums of g, h and 1


def sibling_cells(parent: Cells, own: Cells) -> Cells:
    """The parent's cells minus those of a child: the other child's."""
    at = np.searchsorted(parent[0], own[0])
    sums = [p.copy() for p in parent[1:]]
    for p, o in zip(sums, own[1:]):
        p[at] -= o
    left = sums[2] > 0
    return parent[0][left], *(p[left] for p in sums)


def best_split(cells: Cells, s: Settings) -> dict:
    """What ``best_splits`` finds for one node, from cells that the driver holds."""
    code, *sums = (c[1:] for c in cells)
    g_all, h_all, n_all = (c[0].item() for c in cells[1:])
    out = {"g": g_all, "h": h_all, "n": n_all} | dict.fromkeys(("gain", "feature", "bin", "missing_left", "g_left", "h_left", "n_left"))
    if not len(code):
        return out
    feature = code // s.max_bins
    first = np.flatnonzero(np.append(True, np.diff(feature) != 0))
    cells_of = np.diff(np.append(first, len(code)))
    ways = []
    for c, every in zip(sums, (g_all, h_all, n_all)):
        run = np.cumsum(c, dtype=c.dtype if c.dtype.kind == "i" else np.longdouble)  # sums of a feature: no digits lost to those before it
        upto = (run - np.repeat(run[first] - c[first], cells_of)).astype(c.dtype)
        have = np.repeat(upto[first + cells_of - 1], cells_of)
        ways.append(np.stack([upto, upto + (every - have)], 1))  # without and with the rows that lack the feature
        lacks = every > have  # at last of the row counts
    g, h, n = ways
    least, rows = float(max(s.min_hessian, 1e-12)), max(1, s.min_rows)
    allowed = (n >= rows) & (n_all - n >= rows) & (h >= least) & (h_all - h >= least)
    allowed[:, 1] &= lacks
    cell, way = np.nonzero(allowed)
    g, h, n = (w[cell, way] for w in (g, h, n))
    part = lambda a, b: a * a / (b + s.reg_lambda)
    gain = part(g, h) + part(g_all - g, h_all - h) - part(g_all, h_all)
    some = np.flatnonzero(gain > 1e-12)
    if not len(some):
        return out
    order = np.round(np.log2(gain[some]), 9)
    at = some[np.argmax(order)]  # the first of equals: lower feature, lower bin, absent rows to the right
    f = int(feature[cell[at]])
    return out | {"gain": float(gain[at]), "feature": f, "bin": int(code[cell[at]] - f * s.max_bins), "missing_left": bool(way[at]),
                  "g_left": float(g[at]), "h_left": float(h[at]), "n_left": int(n[at])}


def collected(hist: DataFrame) -> dict[tuple[int, int], Cells]:
    """The cells of each (class, node)."""
    t = hist.toArrow()
    k, node, *cells = (t.column(c).to_numpy() for c in ("k", "node", "code", "g", "h", "n"))
    order = np.lexsort((cells[0], node, k))
    k, node, cells = k[order], node[order], [c[order] for c in cells]
    ends = np.flatnonzero(np.append(True, (np.diff(k) != 0) | (np.diff(node) != 0))) if len(k) else []
    return {(int(k[a]), int(node[a])): tuple(c[a:b] for c in cells) for a, b in zip(ends, [*ends[1:], len(k)])}


# ---------------------------------------------------------------- growing

class Grower:
    """One tree: which leaf is split next, given the best splits known so far."""

    def __init__(self, s: Settings):
        self.s, self.tree = s, Tree()      # the tree as expanded: the final one and leaves tried ahead
        self.known: dict[int, dict] = {}   # node -> its sums and best split
        self.depth, self.path = {0: 0}, {0: ""}
        self.taken: set[int] = set()       # nodes that the final tree splits
        self.queue: list[tuple[float, str, int]] = []  # largest gain first, then the leftmost leaf
        self.leaves = 1
        self.pending: list[tuple[int, int]] = []  # children whose splits are to be found: (parent, child)

    def learn(self, node: int, best: dict) -> None:
        self.known[node] = best
        if not node:
            self.tree.rows[0] = best["n"]
            self._offer(0)

    def _entry(self, node: int) -> tuple[float, str, int] | None:
        """The node's place in the queue, if it may be split."""
        b = self.known[node]
        if b["feature"] is None or 0 < self.s.max_depth <= self.depth[node]:
            return None
        return -round(float(np.log2(b["gain"])), 9), self.path[node], node

    def _offer(self, node: int) -> None:
        if (entry := self._entry(node)) is not None:
            heapq.heappush(self.queue, entry)

    def _frontier(self) -> list[tuple[float, str, int]]:
        """The queue's leaves that are not expanded, and those below its expanded ones: what the queue may hold later."""
        out, todo = [], [n for _, _, n in self.queue]
        for node in todo:  # grows as it goes
            if self.tree.left[node] >= 0:
                todo += [self.tree.left[node], self.tree.right[node]]
            elif (entry := self._entry(node)) is not None:
                out.append(entry)
        return out

    def _expand(self, node: int) -> None:
        for side, child in zip("lr", self.tree.split(node, self.known[node])):
            self.depth[child], self.path[child] = self.depth[node] + 1, self.path[node] + side
            self.pending.append((node, child))

    def advance(self) -> list[tuple[int, int]]:
        """Split leaves while their children are known; the (parent, child) pairs whose splits must be found now."""
        self.pending = []
        limit = self.s.num_leaves if self.s.growth == "leaf" else 1 << 30
        while self.queue and self.leaves < limit:
            node = self.queue[0][2]
            if self.tree.left[node] < 0:
                # the next ones, too, whether in the queue or below its expanded leaves: they are split in the end unless new
                # leaves gain more.  So a tree takes about a pass a level, not one for each time that the queue's order turns.
                ahead = heapq.nsmallest(limit - self.leaves, self._frontier())
                for other in dict.fromkeys([node, *(n for _, _, n in ahead)]):
                    self._expand(other)
                return self.pending
            heapq.heappop(self.queue)
            self.taken.add(node)
            self.leaves += 1
            for child in (self.tree.left[node], self.tree.right[node]):
                self._offer(child)
        return []

    def finish(self) -> Tree:
        """The final tree: leaves tried ahead and not taken are leaves again."""
        out = Tree(rows=[self.tree.rows[0]])
        todo = [(0, 0)]
        for old, new in todo:  # grows as it goes: parents before children
            b = self.known.get(old, {"g": 0.0, "h": 0.0})  # none: a table without rows
            out.value[new] = float(-b["g"] / (b["h"] + self.s.reg_lambda) * self.s.learning_rate) if b["h"] + self.s.reg_lambda > 0 else 0.0
            if old in self.taken:
                todo += zip((self.tree.left[old], self.tree.right[old]), out.split(new, b))
        return out


def _wanted(growers: list[Grower], needs: list[list[tuple[int, int]]]) -> tuple[list[dict[int, int | None]], list[tuple[int, int, int, int]]]:
    """Per class the nodes to be summed, each with its sibling, and (class, parent, node, sibling) of those that have one: of two
    siblings the one with fewer rows is summed; a root has no sibling."""
    wanted, pairs = [{} for _ in growers], []
    for k, (gr, need) in enumerate(zip(growers, needs)):
        for parent in dict.fromkeys(p for p, _ in need):
            if parent < 0:
                wanted[k][0] = None
                continue
            small, big = sorted((gr.tree.left[parent], gr.tree.right[parent]), key=lambda c: gr.tree.rows[c])
            wanted[k][small] = big
            pairs.append((k, parent, small, big))
    return wanted, pairs


def grown(sums: Callable[[list[Tree], list[dict[int, None]]], dict[tuple[int, int], Cells]], s: Settings, outputs: int) -> list[Tree]:
    """A round's trees, one per output, from cells held here: ``sums`` gives those of the wanted nodes of the growing trees."""
    growers = [Grower(s) for _ in range(outputs)]
    held: dict[tuple[int, int], Cells] = {}  # (class, node) -> its cells, until its children's are known
    needs = [[(-1, 0)] for _ in growers]
    while any(needs):
        wanted, pairs = _wanted(growers, needs)
        new = sums([g.tree for g in growers], [dict.fromkeys(w) for w in wanted])
        for k, parent, small, big in pairs:
            new[k, big] = sibling_cells(held.pop((k, parent)), new[k, small])
        held.update(new)
        for (k, node), cells in new.items():
            growers[k].learn(node, best_split(cells, s))
        needs = [g.advance() for g in growers]
    return [g.finish() for g in growers]


def grow_round(rows: DataFrame, s: Settings, done: list[list[Tree]], outputs: int, on_driver: bool = False) -> list[Tree]:
    """The next round's trees, one per output.  ``on_driver``: the driver searches the histograms."""
    if on_driver:
        return grown(lambda trees, wanted: collected(histograms(rows, s, done, trees, wanted)), s, outputs)
    spark = rows.sparkSession
    growers = [Grower(s) for _ in range(outputs)]
    found: dict[int, DataFrame] = {}             # pass -> the histograms it found, a written table
    where: dict[tuple[int, int], int] = {}       # (class, node) -> its pass
    needs = [[(-1, 0)] for _ in growers]
    while any(needs):
        now = len(found)
        wanted, pairs = _wanted(growers, needs)
        where.update({(k, child): now for k, need in enumerate(needs) for _, child in need})
        parents = None
        for at in sorted({where[k, p] for k, p, _, _ in pairs}):
            named = spark.createDataFrame([(k, p, big) for k, p, _, big in pairs if where[k, p] == at], "k int, node int, big int")  # a row per open leaf
            of = found[at].join(F.broadcast(named), ["k", "node"]).select("k", F.col("big").alias("node"), "code", "g", "h", "n")
            parents = of if parents is None else parents.unionByName(of)
        found[now] = written_table(histograms(rows, s, done, [g.tree for g in growers], wanted, parents), "boost-histograms")
        for r in best_splits(found[now], s).collect():  # a row per node
            growers[r["k"]].learn(r["node"], r.asDict())
        needs = [g.advance() for g in growers]
    return [g.finish() for g in growers]


def grow_in_task(rows: DataFrame, s: Settings, outputs: int) -> list[list[Tree]]:
    """All rounds, grown by the one task that holds the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, "codes", 1 << 62):
            scores, y = _matrix(batch.column("f"), outputs), batch.column("y").to_numpy()
            for i in range(s.rounds):
                r = Rows(batch.column("codes"), s.max_bins)  # anew: it keeps the columns that a round's trees ask for
                g, h = gradients(s.objective, scores, y)
                trees = grown(lambda growing, wanted: {(k, own): tuple(cells) for k, (t, nodes) in enumerate(zip(growing, wanted)) if nodes
                                                       for own, _, *cells in cell_sums(r, t, nodes, g[:, k], h[:, k])}, s, outputs)
                if all(len(t.left) == 1 for t in trees):
                    break
                scores = added(r, scores, [trees])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([json.dumps([asdict(t) for t in trees])])], names=["round", "trees"])

    got = rows.select("y", "codes", "f").coalesce(1).mapInArrow(run, "round int, trees string").collect()  # a row a round
    return [[Tree(**t) for t in json.loads(r["trees"])] for r in sorted(got, key=lambda r: r["round"])]


def searched_on_driver(edges: dict[int, np.ndarray], s: Settings, outputs: int, codes: int) -> bool:
    """Whether the histograms of a round's open nodes are small: a cell for each bin and node, and no more for a class than rows have codes."""
    nodes = s.num_leaves if s.growth == "leaf" else 1 << min(s.max_depth or 30, 30)
    return outputs * min(codes, nodes * sum(map(len, edges.values()))) <= CELLS_ON_DRIVER


# ---------------------------------------------------------------- models

def starting_scores(rows: DataFrame, objective: str, outputs: int) -> list[float]:
    """Log shares of the classes, log odds of class 1, or the mean."""
    if objective == "squared":
        return [rows.agg(F.avg("y")).first()[0] or 0.0]
    n = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    total = max(1, sum(n.values()))
    share = [max(n.get(k, 0) / total, 1e-12) for k in range(max(outputs, 2))]
    return [float(np.log(share[1] / share[0]))] if objective == "logistic" else [float(np.log(p)) for p in share]


def _with_scores(rows: DataFrame, rounds: list[list[Tree]], bins: int, staged: bool = False) -> DataFrame:
    """``f`` after some more rounds; ``staged``: one row per round 0, 1, ... with ``round``."""
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = Rows(batch.column("codes"), bins)
            scores = _matrix(batch.column("f"), len(batch.column("f").flatten()) // batch.num_rows)
            names = [c for c in batch.schema.names if c != "f" and not (staged and c == "codes")]
            for i in range(len(rounds) + 1) if staged else [len(rounds)]:
                scores = added(r, scores, (rounds[i - 1:i] if i else []) if staged else rounds)
                f = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), scores.shape[1]).cast(pa.list_(pa.float64()))
                extra = [pa.array(np.full(r.n, i), pa.int32())] if staged else []
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *extra, f], names=[*names, *(["round"] if staged else []), "f"])

    schema = f"key {types['key']}, y double, round int, f array<double>" if staged else f"key {types['key']}, y double, codes array<int>, f array<double>"
    return rows.select("key", "y", "codes", "f").mapInArrow(run, schema)


@dataclass
class BoostedModel:
    """A fitted ensemble over ``features`` (a vector column or numeric columns)."""

    settings: Settings
    features: str | list[str]
    edges: dict[int, np.ndarray]
    start: list[float]
    rounds: list[list[Tree]]

    def _codes(self, df: DataFrame, key: str, label: str | None) -> DataFrame:
        rows = binned(sparse_rows(df, self.features, key, label), self.edges, self.settings.max_bins)
        return rows.withColumn("f", F.array(*map(F.lit, self.start)))

    def scores(self, df: DataFrame, key: str = "key", label: str | None = None) -> DataFrame:
        """``key, y, f``: the raw scores of each row (``y``: its label, if one is named)."""
        return _with_scores(self._codes(df, key, label), self.rounds, self.settings.max_bins).drop("codes")

    def staged_scores(self, df: DataFrame, key: str = "key", label: str | None = None) -> DataFrame:
        """``key, y, round, f``: the scores after each round, round 0 being the start, in one pass."""
        return _with_scores(self._codes(df, key, label), self.rounds, self.settings.max_bins, staged=True)

    def predictions(self, scored: DataFrame) -> DataFrame:
        """``p`` (class probabilities, or none for a regressor) and ``prediction`` (class code or value) of ``f``."""
        kind = self.settings.objective
        if kind == "squared":
            return scored.withColumn("prediction", F.col("f")[0])
        if kind == "logistic":
            one = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("f")[0]))
            return scored.withColumn("p", F.array(F.lit(1.0) - one, one)).withColumn("prediction", (F.col("f")[0] > 0).cast("double"))
        from ..functions.scalars import argmax, softmax
        return scored.withColumn("p", softmax("f")).withColumn("prediction", argmax("f").cast("double"))

    def specs(self) -> list[tuple[int | None, dict]]:
        """The ensemble of each output, as the tree explainers take it (margin space)."""
        out = []
        for k in range(len(self.start)):
            trees = []
            for r in self.rounds:
                t = r[k]
                thr = [float(self.edges[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin)]
                trees.append(dict(left=np.array(t.left), right=np.array(t.right), feature=np.array(t.feature), threshold=np.array(thr),
                                  value=np.array(t.value)[:, None], cover=np.array(t.rows, float), missing_left=np.array(t.missing_left)))
            out.append((k if len(self.start) > 1 else None, {"kind": "gbt", "trees": trees, "weights": [1.0] * len(trees)}))
        return out


def training_table(df: DataFrame, features: str | Sequence[str], label: str, key: str, settings: Settings,
                   outputs: int) -> tuple[DataFrame, dict[int, np.ndarray], list[float]]:
    """(``key, y, codes, f`` as a written table, bin edges, starting scores)."""
    spark = df.sparkSession
    rows = written_table(sparse_rows(df, features, key, label).filter("y is not null"), "boost-rows")
    edges = bin_edges(rows, settings.max_bins)
    start = starting_scores(rows, settings.objective, outputs)
    n = rows.count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(cores, n // 5000), -(-n // ROWS_PER_PARTITION))
    table = binned(rows.repartition(parts, "key"), edges, settings.max_bins).withColumn("f", F.array(*map(F.lit, start)))
    return written_table(table, "boost-codes"), edges, start


def fit(df: DataFrame, features: str | Sequence[str], label: str, settings: Settings, outputs: int = 1, key: str = "key") -> BoostedModel:
    """Fit on all rows with a label.  ``outputs``: classes of a softmax, else 1.  Ends early when no tree of a round has a split."""
    table, edges, start = training_table(df, features, label, key, settings, outputs)
    rounds: list[list[Tree]] = []
    done: list[list[Tree]] = []
    codes = table.agg(F.sum(F.size("codes") + 1)).first()[0] or 0
    in_task = settings.rounds > 1 and codes * len(start) <= CODES_AT_ONCE  # one round is grown in passes
    if in_task:
        rounds = grow_in_task(table, settings, len(start))
    on_driver = searched_on_driver(edges, settings, len(start), codes)
    for _ in range(0 if in_task else settings.rounds):
        trees = grow_round(table, settings, done, len(start), on_driver)
        if all(len(t.left) == 1 for t in trees):
            break
        rounds.append(trees)
        done.append(trees)
        if len(done) == CUT_ROUNDS:
            table, done = written_table(_with_scores(table, done, settings.max_bins), "boost-scores"), []
    return BoostedModel(settings, features if isinstance(features, str) else list(features), edges, start, rounds)
