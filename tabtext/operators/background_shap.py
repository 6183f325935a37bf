"""Tree attributions against background data (XPL-1, XPL-2): interventional TreeSHAP.

The value of a coalition S is the mean prediction of rows that take the features in S from the explained row x and the
others from a background row z.  For one tree and one pair (x, z) a leaf counts only if, for each feature on its path,
x or z satisfies the path's conditions on it.  Features that only x satisfies form Sx, those that only z satisfies
form Sz, and the leaf of value v gives ``v (|Sx|-1)! |Sz|! / (|Sx|+|Sz|)!`` to each feature of Sx and
``-v |Sx|! (|Sz|-1)! / (|Sx|+|Sz|)!`` to each of Sz (the two-sample weights).

So all that matters of a row at a leaf is the set of path features whose conditions it satisfies, a bit mask.  Rows with the
same place between the ensemble's thresholds in every feature, a cell, agree on all of them: Spark counts the background rows
per cell, walks each cell once through the trees and counts the rows per (tree, leaf, mask).  This table (bounded by
``MAX_MASKS``) is broadcast, the cells of the explained rows meet masks with counts instead of rows, once per cell, and the rows
join their cell's values.  The background may be the whole train split at the cost of one pass over it, and the result is the
exact mean over all of its rows.  Walks grow with the cells, of which there are as many as rows at most.

Null features are not expected here (models impute them, FEA-9), except in trees with ``missing_left``, where a NaN goes the
node's default way.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the (tree, leaf, mask) table that may be gathered and broadcast (32 bytes each).
MAX_MASKS = 2_000_000
#: Explained rows x used features x outputs held at once, and pairs of masks met at once.
MAX_PHI_CELLS, MAX_PAIRS = 20_000_000, 4_000_000
#: Counts of masks that a task hands over at once.
MAX_COUNTS = 100_000

try:  # the tasks run this module's functions: send them by value
    from pyspark import cloudpickle as _cp
    import sys as _sys
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files
    pass


# ---------------------------------------------------------------- numpy core

def leaf_masks(x: np.ndarray, tree: dict) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(leaf, its path's distinct features, per row the bits of those whose conditions the row satisfies)."""
    left, right, feature = tree["left"], tree["right"], tree["feature"]
    cats, missing = tree.get("cats", {}), tree.get("missing_left")

    def walk(node, slots, ok):
        if left[node] < 0:
            mask = np.zeros(len(x), np.int64)
            for s, o in enumerate(ok):
                mask |= o.astype(np.int64) << s
            yield node, slots, mask
            return
        f = int(feature[node])
        way = np.isin(x[:, f], cats[node]) if node in cats else x[:, f] <= tree["threshold"][node]
        if missing is not None:
            way = np.where(np.isnan(x[:, f]), bool(missing[node]), way)
        for child, goes in ((left[node], way), (right[node], ~way)):
            if f in slots:
                s = slots.index(f)
                yield from walk(child, slots, [*ok[:s], ok[s] & goes, *ok[s + 1:]])
            else:
                yield from walk(child, [*slots, f], [*ok, goes])

    yield from walk(0, [], [])


@functools.cache
def _orders(k: int) -> np.ndarray:
    """``i! j! / (i + j + 1)!`` for i and j up to ``k``."""
    return np.array([[math.factorial(i) * math.factorial(j) / math.factorial(i + j + 1) for j in range(k + 1)] for i in range(k + 1)])


def two_sample_weights(a: np.ndarray, b: np.ndarray, share: np.ndarray, k: int) -> np.ndarray:
    """Per mask of ``a`` and path feature: the weight of the leaf's value, summed over the background masks ``b``."""
    first = _orders(k)
    full = (1 << k) - 1
    out = np.zeros((len(a), k))
    step = max(1, MAX_PAIRS // max(1, len(b)))
    for low in range(0, len(a), step):
        x, z = a[low:low + step, None], b[None, :]
        alive = (x | z) == full
        sx, sz = x & ~z, z & ~x
        nx, nz = np.bitwise_count(sx).astype(int), np.bitwise_count(sz).astype(int)
        up = np.where(alive & (nx > 0), first[np.maximum(nx - 1, 0), nz], 0.0)
        down = np.where(alive & (nz > 0), first[nx, np.maximum(nz - 1, 0)], 0.0)
        for s in range(k):
            out[low:low + step, s] = (((sx >> s) & 1) * up - ((sz >> s) & 1) * down) @ share
    return out


def mask_counts(x: np.ndarray, trees: Sequence[dict], n: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(tree, leaf, masks, rows of each mask); ``n``: how many rows each row of ``x`` stands for, one by default."""
    for t, tree in enumerate(trees):
        for leaf, _, mask in leaf_masks(x, tree):
            masks, which = np.unique(mask, return_inverse=True)
            rows = np.zeros(len(masks), np.int64)
            np.add.at(rows, which, 1 if n is None else n)
            yield t, leaf, masks, rows


def thresholds(trees: Sequence[dict], features: int) -> list[np.ndarray | None]:
    """Per feature its distinct thresholds in order; None if a tree splits it by categories."""
    seen: list[set | None] = [set() for _ in range(features)]
    for tree in trees:
        for node in np.flatnonzero(np.asarray(tree["left"]) >= 0):
            f = int(tree["feature"][node])
            if node in tree.get("cats", {}):
                seen[f] = None
            elif seen[f] is not None:
                seen[f].add(float(tree["threshold"][node]))
    return [None if s is None else np.array(sorted(s)) for s in seen]


def cells(x: np.ndarray, cuts: Sequence[np.ndarray | None]) -> np.ndarray:
    """Each value replaced by the number of thresholds below it; NaN and values of categories stay."""
    out = x.copy()
    for f, cut in enumerate(cuts):
        if cut is not None:
            out[:, f] = np.where(np.isnan(x[:, f]), np.nan, np.searchsorted(cut, x[:, f], "left"))
    return out


def over_cells(tree: dict, cuts: Sequence[np.ndarray | None]) -> dict:
    """The tree that takes a cell where ``tree`` takes its rows."""
    threshold = np.array(tree["threshold"], float)
    for node in np.flatnonzero(np.asarray(tree["left"]) >= 0):
        cut = cuts[int(tree["feature"][node])]
        if cut is not None:
            threshold[node] = np.searchsorted(cut, threshold[node], "left")
    return tree | {"threshold": threshold}


def background_shap(x: np.ndarray, tree: dict, background: dict, phi: np.ndarray, weight: float = 1.0) -> None:
    """Add ``weight`` x attributions of one tree to ``phi`` (rows, features, outputs); ``background``: leaf ->
    (masks, shares of the background rows)."""
    for leaf, slots, mask in leaf_masks(x, tree):
        if not slots or leaf not in background:
            continue
        own, which = np.unique(mask, return_inverse=True)
        w = two_sample_weights(own, *background[leaf], len(slots))[which] * weight
        for s, f in enumerate(slots):
            phi[:, f, :] += w[:, s, None] * tree["value"][leaf][None, :]


def background_value(tree: dict, background: dict, paths: dict[int, int]) -> np.ndarray:
    """The mean prediction over the background; ``paths``: leaf -> number of its path's features."""
    out = np.zeros(tree["value"].shape[1])
    for leaf, (masks, share) in background.items():
        out += tree["value"][leaf] * share[masks == (1 << paths[leaf]) - 1].sum()
    return out


# ---------------------------------------------------------------- Spark side

def _rows(df: DataFrame, key: str, features_col: str, used: list[int], cuts: list[np.ndarray | None]) -> DataFrame:
    """``sample, cell`` of every row."""
    col = F.col(features_col)
    x = col if dict(df.dtypes)[features_col].startswith("array") else vector_to_array(col)
    picked = F.array(*[x[i] for i in used]) if used else F.array().cast("array<double>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf["cell"] = [*cells(np.stack(pdf["x"].to_numpy()).astype(float), cuts)]
                yield pdf[["sample", "cell"]]

    # A null sample stays null: pandas has no null in a column of numbers.
    return (df.select(F.col(key).cast("long").cast("string").alias("sample"), picked.alias("x"))
            .mapInPandas(run, "sample string, cell array<double>").withColumn("sample", F.col("sample").cast("long")))


def _dealt(rows: DataFrame) -> DataFrame:
    """Cells over all cores: a cell is walked through every leaf, so few of them are work for many tasks."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "cell")


def count_masks(trees: list[dict], rows: DataFrame) -> tuple[list[dict], int]:
    """Per tree: leaf -> (masks, shares) of all background rows (``cell``), counted by Spark; and the number of rows."""
    bc = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, n = np.stack(pdf["cell"].to_numpy()).astype(float), pdf["n"].to_numpy(np.int64)
                parts, held = [], 0
                for part in mask_counts(x, bc.value, n):
                    parts.append(part)
                    held += len(part[2])
                    if held >= MAX_COUNTS:
                        yield _counts(parts)
                        parts, held = [], 0
                if parts:
                    yield _counts(parts)

    same = _dealt(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    counts = same.mapInPandas(run, "tree int, leaf int, mask long, n long").groupBy("tree", "leaf", "mask").agg(F.sum("n").alias("n"))
    got = counts.limit(MAX_MASKS + 1).toPandas()
    if len(got) > MAX_MASKS:
        raise ValueError(f"more than {MAX_MASKS} (leaf, mask) pairs: the trees are too deep for an exact background table")
    out: list[dict] = [{} for _ in trees]
    if not len(got):
        return out, 0
    got = got.sort_values(["tree", "leaf", "mask"])
    tree, leaf, mask, n = (got[c].to_numpy(np.int64) for c in ("tree", "leaf", "mask", "n"))
    starts = np.flatnonzero(np.r_[True, (np.diff(tree) != 0) | (np.diff(leaf) != 0)])
    ends = np.r_[starts[1:], len(got)]
    total = int(n[starts[0]:ends[0]].sum())  # every row has a mask at every leaf
    for a, b in zip(starts, ends):
        out[tree[a]][int(leaf[a])] = (mask[a:b], n[a:b] / total)
    return out, total


def _counts(parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    size = [len(m) for _, _, m, _ in parts]
    return pd.DataFrame({"tree": np.repeat(np.array([t for t, *_ in parts], np.int32), size), "leaf": np.repeat(np.array([p[1] for p in parts], np.int32), size),
                         "mask": np.concatenate([p[2] for p in parts]), "n": np.concatenate([p[3] for p in parts])})


def background_attributions(specs: list[tuple[int | None, dict]], df: DataFrame, background: DataFrame, names: Sequence[str],
                            key: str = "key", features_col: str = "features", classes: Sequence | None = None,
                            binary_positive_only: bool = True) -> tuple[DataFrame, list[np.ndarray]]:
    """(``(sample, feature, class, shap_value)`` of every row of ``df``, per spec the mean prediction over ``background``).

    ``specs``: (class or None, ensemble of ``treeshap.extract_trees``).  Every row of ``background`` counts."""
    used = sorted({int(f) for _, s in specs for t in s["trees"] for f in t["feature"] if f >= 0})
    place = {f: j for j, f in enumerate(used)}
    specs = [(c, s | {"trees": [t | {"feature": np.array([place.get(int(f), -1) for f in t["feature"]])} for t in s["trees"]]})
             for c, s in specs]
    cuts = thresholds([t for _, s in specs for t in s["trees"]], len(used))
    specs = [(c, s | {"trees": [over_cells(t, cuts) for t in s["trees"]]}) for c, s in specs]
    every = [t for _, s in specs for t in s["trees"]]
    masks, total = count_masks(every, _rows(background, key, features_col, used, cuts))
    if not total:
        raise ValueError("the background has no rows")
    base, at = [], 0
    for _, s in specs:
        value = 0.0
        for t, w in zip(s["trees"], s["weights"]):
            paths = {leaf: len(slots) for leaf, slots, _ in leaf_masks(np.zeros((0, max(1, len(used)))), t)}
            value = value + w * background_value(t, masks[at], paths)
            at += 1
        base.append(value)
    bc = df.sparkSession.sparkContext.broadcast((specs, masks, [names[i] for i in used], list(classes or []), binary_positive_only))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        specs, masks, names, labels, positive_only = bc.value
        for pdf in batches:
            if not len(pdf) or not names:
                continue
            own = pdf["cell"].to_numpy()
            whole = np.stack(own).astype(float)
            at = 0
            for c, spec in specs:
                outputs = spec["trees"][0]["value"].shape[1]
                step = max(1, MAX_PHI_CELLS // (len(names) * outputs))
                for low in range(0, len(whole), step):
                    x = whole[low:low + step]
                    phi = np.zeros((len(x), len(names), outputs))
                    for i, (t, w) in enumerate(zip(spec["trees"], spec["weights"])):
                        background_shap(x, t, masks[at + i], phi, w)
                    for o in [1] if c is None and outputs == 2 and positive_only else range(outputs):
                        cls = c if c is not None else o
                        r, f = np.nonzero(phi[:, :, o])
                        yield pd.DataFrame({"cell": own[low:low + step][r], "feature": np.asarray(names, dtype=object)[f],
                                            "class": np.full(len(r), int(labels[cls] if labels else cls), np.int32), "shap_value": phi[r, f, o]})
                at += len(spec["trees"])

    rows = _rows(df, key, features_col, used, cuts)
    values = _dealt(rows.select("cell").distinct()).mapInPandas(run, "cell array<double>, feature string, class int, shap_value double")
    return rows.join(values, "cell").select("sample", "feature", "class", "shap_value"), base
