"""Gradient-boosted trees of many parameter settings and folds at once, on histograms that they share.

Features are binned once (absent values are missing, as in a sparse matrix).  Up to WHOLE cells (V/J usage), a task holds the
bins of all rows and grows whole fits: one job for all of them.  Wider features are kept as blocks, so that no task holds the
matrix.  There all fits advance together: one Spark job a tree level sums, in every block, the gradients of all fits by
(node, feature, bin), and gives each node's best split there with the rows that it sends left; Spark keeps the best over the
blocks.  Rows are repertoires: what the driver holds is their gradients and nodes, fits x rows numbers (10,000 repertoires
and 129 fits: 26 MB), and the trees.

A split maximises G_l^2 / (H_l + 1) + G_r^2 / (H_r + 1) - G^2 / (H + 1), each side's H at least ``leaf``, missing values on the
better side; ties go to the smaller feature, then to the lower bin.  A leaf adds -step G / (H + 1).  A fit ends after
``patience`` trees without a better AUROC of its validation rows and is cut back to its best tree.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Present values of a feature fall into so many bins at most; cells of a block of features.
BINS, CELLS = 32, 1_000_000

_BLOCK = "block int, features array<string>, cuts array<array<double>>, row binary, feature binary, bin binary"
_SPLIT = "fit int, node int, gain double, feature string, cut double, missing_left boolean, left binary"


@dataclass
class Fit:
    """One boosted model: parameters, rows it is trained and validated on, and its trees once it is fitted."""

    params: dict
    train: np.ndarray
    valid: np.ndarray
    base: float = 0.0
    trees: list[dict] = field(default_factory=list)  # node -> ("split", feature, cut, missing_left) or ("leaf", weight)
    auroc: float = -1.0
    best: int = 0


def auroc(y: np.ndarray, score: np.ndarray) -> float | None:
    """By mid-ranks; None with one class."""
    ones = int(y.sum())
    if ones in (0, len(y)):
        return None
    _, which, size = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - (size - 1) / 2)[which]
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)))


def _blocks(keys: list, groups: int):
    number = {k: i for i, k in enumerate(keys)}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["feature", "key"])
        names, which = np.unique(group["feature"].to_numpy(), return_inverse=True)
        value = group["value"].to_numpy(float)
        bins, cuts = np.zeros(len(group), np.uint8), []
        edges = np.searchsorted(which, np.arange(len(names) + 1))
        for a, b in zip(edges, edges[1:], strict=False):
            seen = np.unique(value[a:b])
            upper = seen[:-1] if len(seen) <= BINS else np.unique(np.quantile(seen, np.arange(1, BINS) / BINS, method="lower"))
            bins[a:b] = np.searchsorted(upper, value[a:b], "left")
            cuts.append(upper.tolist())
        row = np.array([number[k] for k in group["key"]], np.int32)
        return pd.DataFrame({"block": group["block"].iloc[:1], "features": [names.tolist()], "cuts": [cuts], "row": [row.tobytes()], "feature": [which.astype(np.int32).tobytes()], "bin": [bins.tobytes()]})

    return run


def _drawn(marks: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which features a tree may use."""
    return (marks * np.uint64(2654435761) + np.uint64(seed)) % np.uint64(1000003) < share * 1000003


def _best_splits(hg: np.ndarray, hh: np.ndarray, total_g: np.ndarray, total_h: np.ndarray, least: float, used: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin, whether missing values go left) of each node's best split, by sums over (node, feature, bin)."""
    left_g, left_h = np.cumsum(hg, axis=2), np.cumsum(hh, axis=2)
    lost_g, lost_h = total_g[:, None] - left_g[:, :, -1], total_h[:, None] - left_h[:, :, -1]
    tried = []
    for left in (False, True):  # where missing values go
        a_g, a_h = left_g + left * lost_g[:, :, None], left_h + left * lost_h[:, :, None]
        b_g, b_h = total_g[:, None, None] - a_g, total_h[:, None, None] - a_h
        gain = a_g**2 / (a_h + 1) + b_g**2 / (b_h + 1) - (total_g**2 / (total_h + 1))[:, None, None]
        gain = np.where((a_h >= least) & (b_h >= least) & used[None, :, None], np.round(gain, 9), -1.0)
        pick = gain.argmax(axis=2)
        tried.append((np.take_along_axis(gain, pick[:, :, None], 2)[:, :, 0], pick))
    (stay, low), (move, high) = tried
    better = move > stay
    gain = np.where(better, move, stay)
    at, f = np.arange(len(gain)), gain.argmax(axis=1)
    return gain[at, f], f, np.where(better, high, low)[at, f], better[at, f]


def _splits(state, leafs: list[float], columns: list[float], seeds: list[int], n_rows: int):
    """The best split of every (fit, node) in each block of features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits, nodes, g, h = state.value
        for batch in batches:
            for block in batch.itertuples():
                row, feature, bins = np.frombuffer(block.row, np.int32), np.frombuffer(block.feature, np.int32), np.frombuffer(block.bin, np.uint8)
                n_features, out = len(block.features), []
                marks = pd.util.hash_array(np.array(block.features, object)).astype(np.uint64)
                for k, fit in enumerate(fits):
                    own = nodes[k] >= 0
                    names, place = np.unique(nodes[k][own], return_inverse=True)
                    at = np.zeros(n_rows, np.int64)
                    at[own] = place
                    here = own[row]
                    cell = (at[row[here]] * n_features + feature[here]) * BINS + bins[here]
                    shape = (len(names), n_features, BINS)
                    hg = np.bincount(cell, g[k][row[here]], np.prod(shape)).reshape(shape)
                    hh = np.bincount(cell, h[k][row[here]], np.prod(shape)).reshape(shape)
                    total_g, total_h = np.bincount(place, g[k][own], len(names)), np.bincount(place, h[k][own], len(names))
                    used = _drawn(marks, seeds[k], columns[k])
                    best = _best_splits(hg, hh, total_g, total_h, leafs[k], used)
                    for i in np.flatnonzero(best[0] > 1e-6):
                        f, b = int(best[1][i]), int(best[2][i])
                        goes = nodes[k] == names[i]
                        held = feature == f
                        present = np.zeros(n_rows, bool)
                        present[row[held]] = True
                        low = np.zeros(n_rows, bool)
                        low[row[held & (bins <= b)]] = True
                        left = goes & (low | (~present & bool(best[3][i])))
                        cuts = block.cuts[f]
                        cut = float(cuts[b]) if b < len(cuts) else float("inf")  # all that is present goes left
                        out.append((fit, int(names[i]), float(best[0][i]), block.features[f], cut, bool(best[3][i]), np.packbits(left).tobytes()))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _SPLIT.split(", ")])

    return run


#: Cells (rows x features, a byte each) up to which a task holds them all and grows whole fits; of a part of them.
WHOLE, PART = 32_000_000, 1_000_000
_MATRIX = "block int, features array<string>, cuts array<array<double>>, bins binary"
_GROWN = "fit int, auroc double, best int, trees binary"


def _matrix(keys: list):
    """``_blocks``, as bytes of (row, feature); BINS where a value is missing."""
    make = _blocks(keys, 0)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        block = make(group)
        (features,), (row,), (feature,), (bins,) = (block[c] for c in ("features", "row", "feature", "bin"))
        out = np.full((len(keys), len(features)), BINS, np.uint8)
        out[np.frombuffer(row, np.int32), np.frombuffer(feature, np.int32)] = np.frombuffer(bins, np.uint8)
        return block[["block", "features", "cuts"]].assign(bins=[out.tobytes()])

    return run


def _grow(fit: Fit, k: int, codes: np.ndarray, names: list, cuts: list, y: np.ndarray, drawn: np.ndarray, rounds: int, patience: int, bins: int) -> Fit:
    """Fit number ``k`` on the bins of all rows and features (in sorted order)."""
    (n, width), params = codes.shape, fit.params
    marks = pd.util.hash_array(np.array(names, object)).astype(np.uint64)
    margin, waits = np.full(n, fit.base), 0
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        inside = fit.train & (((drawn + 0.61803398875 * (t + 1) * (1 + 7 * (k % 97))) % 1.0) < params["rows"])
        g, h = (p - y) * inside, p * (1 - p) * inside
        used = _drawn(marks, t * 7919 + k * 104729, float(params["columns"]))
        node, tree, open_ = np.zeros(n, np.int64), {}, np.arange(n)
        for _ in range(params["depth"]):
            if not len(open_):
                break
            numbers, place = np.unique(node[open_], return_inverse=True)
            total_g, total_h = np.bincount(place, g[open_], len(numbers)), np.bincount(place, h[open_], len(numbers))
            shape = (len(numbers), width, bins)
            hg, hh = np.empty(shape), np.empty(shape)
            counted = inside[open_]
            rows, at = open_[counted], place[counted]
            step = max(1, PART // max(len(rows), 1))
            for low in range(0, width, step):
                part = codes[rows, low : low + step]
                m = part.shape[1]
                cell = ((at[:, None] * m + np.arange(m)) * (bins + 1) + part).ravel()
                for sums, weight in ((hg, g), (hh, h)):
                    sums[:, low : low + m] = np.bincount(cell, np.repeat(weight[rows], m), len(numbers) * m * (bins + 1)).reshape(len(numbers), m, -1)[:, :, :bins]
            gain, feature, bin_, missing = _best_splits(hg, hh, total_g, total_h, float(params["leaf"]), used)
            split = gain > 1e-6
            for i in np.flatnonzero(split):
                own, b = cuts[feature[i]], int(bin_[i])
                tree[int(numbers[i])] = ("split", names[feature[i]], float(own[b]) if b < len(own) else float("inf"), bool(missing[i]))
            open_, place = open_[split[place]], place[split[place]]
            held = codes[open_, feature[place]]
            left = np.where(held == bins, missing[place], held <= bin_[place])
            node[open_] = 2 * node[open_] + np.where(left, 1, 2)
        leaves, place = np.unique(node, return_inverse=True)
        weight = -params["step"] * np.bincount(place, g, len(leaves)) / (np.bincount(place, h, len(leaves)) + 1)
        margin += weight[place]
        waits = _add_tree(fit, tree, leaves, weight, auroc(y[fit.valid], np.round(margin[fit.valid], 9)), waits)
        if waits >= patience:
            break
    return fit


def _add_tree(fit: Fit, tree: dict, leaves: np.ndarray, weight: np.ndarray, now: float, waits: int) -> int:
    """``tree`` (splits) with its leaves added to ``fit``; the trees that ``fit`` has waited for a better one."""
    tree |= {int(x): ("leaf", float(w)) for x, w in zip(leaves, weight, strict=True)}
    # Leaves that no row reached.
    tree |= {c: ("leaf", 0.0) for s, v in list(tree.items()) if v[0] == "split" for c in (2 * s + 1, 2 * s + 2) if c not in tree}
    fit.trees.append(tree)
    if now > fit.auroc + 1e-12:
        fit.auroc, fit.best = now, len(fit.trees)
        return 0
    return waits + 1


def _grown(own: DataFrame, fits: list[Fit], active: list[int], keys: list, y: np.ndarray, drawn: np.ndarray, rounds: int, patience: int, kept: bool) -> None:
    """``fits`` grown, each in one task that holds the bins of all rows; all of them in one job."""
    if not active:
        return
    spark = own.sparkSession
    groups = max(spark.sparkContext.defaultParallelism, -(-own.count() // CELLS))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("feature"), F.lit(groups)).cast("int"))
    blocks = Scratch(spark).write(dealt.groupBy("block").applyInPandas(_matrix(keys), _MATRIX))
    order = sorted(active, key=lambda k: (-fits[k].params["depth"], fits[k].params["step"], k))  # long ones spread over the parts
    parts = max(1, min(len(active), 4 * spark.sparkContext.defaultParallelism))
    pack = lambda name: np.stack([np.packbits(getattr(fits[k], name)) for k in order])
    state = spark.sparkContext.broadcast(([(k, fits[k].params, fits[k].base) for k in order], pack("train"), pack("valid"), y, drawn))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        models, train, valid, y, drawn = state.value
        n, names = len(y), np.concatenate(group["features"].to_list())
        by = np.argsort(names)
        codes = np.empty((n, len(names)), np.uint8)
        to = np.empty(len(names), np.int64)
        to[by] = np.arange(len(names))
        first = 0
        for features, bins in zip(group["features"], group["bins"], strict=True):
            codes[:, to[first : first + len(features)]] = np.frombuffer(bins, np.uint8).reshape(n, -1)
            first += len(features)
        every, sorted_ = [list(c) for own_cuts in group["cuts"] for c in own_cuts], names[by].tolist()
        cuts, out = [every[i] for i in by], []
        for i in range(int(group["part"].iloc[0]), len(models), parts):
            k, params, base = models[i]
            rows = [np.unpackbits(v[i], count=n).astype(bool) for v in (train, valid)]
            fit = _grow(Fit(params, *rows, base), k, codes, sorted_, cuts, y, drawn, rounds, patience, BINS)
            out.append((k, fit.auroc, fit.best, pickle.dumps(fit.trees[: fit.best] if kept else [])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _GROWN.split(", ")])

    sent = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "part")
    for r in sent.groupBy("part").applyInPandas(run, _GROWN).collect():
        fit = fits[r["fit"]]
        fit.auroc, fit.best, fit.trees = r["auroc"], r["best"], pickle.loads(r["trees"])
    state.destroy()


def boost(long: DataFrame, fits: list[Fit], keys: list, y: np.ndarray, rounds: int = 1000, patience: int = 20, key: str = "repertoire_id", kept: bool = True) -> list[Fit]:
    """``fits`` fitted on the features (``key``, feature, value) of the rows ``keys`` with labels ``y``; without ``kept`` trees
    need not be returned.

    ``params``: depth, step, rows and columns (shares used by a tree), leaf.  Shares are drawn by hash, so a fit can be
    repeated.
    """
    spark, n = long.sparkSession, len(keys)
    own = long.select(F.col(key).alias("key"), "feature", F.col("value").cast("double").alias("value")).where(F.col("value") != 0)
    wanted = spark.createDataFrame([(k,) for k in keys], own.select("key").schema)
    own = Scratch(spark).write(own.join(wanted, "key", "left_semi"))
    margin, node = np.zeros((len(fits), n)), np.zeros((len(fits), n), np.int32)
    for k, f in enumerate(fits):
        share = min(max(y[f.train].mean() if f.train.any() else 0.5, 1e-6), 1 - 1e-6)
        f.base = margin[k] = float(np.log(share / (1 - share)))
    waits = np.zeros(len(fits), int)
    active = [k for k, f in enumerate(fits) if auroc(y[f.valid], margin[k][f.valid]) is not None]
    drawn = np.array([hash_unit(str(k)) for k in keys])
    width = own.select("feature").distinct().count()
    if width and n * width <= WHOLE:
        _grown(own, fits, active, keys, y, drawn, rounds, patience, kept)
        return fits
    groups = max(spark.sparkContext.defaultParallelism, -(-own.count() // CELLS))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("feature"), F.lit(groups)).cast("int"))
    blocks = Scratch(spark).write(dealt.groupBy("block").applyInPandas(_blocks(keys, groups), _BLOCK).repartition(groups))
    for t in range(rounds):
        if not active:
            break
        p = 1 / (1 + np.exp(-margin[active]))
        inside = np.stack([fits[k].train & (((drawn + 0.61803398875 * (t + 1) * (1 + 7 * (k % 97))) % 1.0) < fits[k].params["rows"]) for k in active])
        g, h = (p - y) * inside, p * (1 - p) * inside
        node[active] = 0
        trees: dict[int, dict] = {k: {} for k in active}
        frontier = {k: {0} for k in active}
        for level in range(max(fits[k].params["depth"] for k in active)):
            at = [i for i, k in enumerate(active) if frontier[k] and level < fits[k].params["depth"]]
            if not at:
                break
            ks = [active[i] for i in at]
            open_ = np.stack([np.where(np.isin(node[k], list(frontier[k])), node[k], -1) for k in ks]).astype(np.int32)
            state = spark.sparkContext.broadcast((ks, open_, g[at], h[at]))
            param = lambda name: [float(fits[k].params[name]) for k in ks]  # noqa: B023, E731
            found = blocks.mapInPandas(_splits(state, param("leaf"), param("columns"), [t * 7919 + k * 104729 for k in ks], n), _SPLIT)
            best = found.groupBy("fit", "node").agg(F.min_by(F.struct("feature", "cut", "missing_left", "left"), F.struct(-F.col("gain"), "feature")).alias("s")).select("fit", "node", "s.*").collect()
            state.destroy()
            frontier = {k: set() for k in active}
            for r in best:
                k, at_node = r["fit"], r["node"]
                left = np.unpackbits(np.frombuffer(r["left"], np.uint8), count=n).astype(bool)
                here = node[k] == at_node
                node[k][here & left], node[k][here & ~left] = 2 * at_node + 1, 2 * at_node + 2
                trees[k][at_node] = ("split", r["feature"], r["cut"], r["missing_left"])
                frontier[k] |= {2 * at_node + 1, 2 * at_node + 2}
        for i, k in enumerate(active):
            leaves, place = np.unique(node[k], return_inverse=True)
            weight = -fits[k].params["step"] * np.bincount(place, g[i], len(leaves)) / (np.bincount(place, h[i], len(leaves)) + 1)
            margin[k] += weight[place]
            now = auroc(y[fits[k].valid], np.round(margin[k][fits[k].valid], 9))
            waits[k] = _add_tree(fits[k], trees[k], leaves, weight, now, waits[k])
        active = [k for k in active if waits[k] < patience]
    for f in fits:
        f.trees = f.trees[: f.best]
    return fits


def hash_unit(text: str) -> float:
    """A number of [0, 1) by hash."""
    return int(pd.util.hash_array(np.array([text], object))[0]) / 2.0**64


# Two grids, the second at the best of the first; where the second starts from; folds.
GRIDS = ({"depth": [3, 4, 5, 6], "step": [0.01, 0.03, 0.05, 0.1]}, {"rows": [0.7, 0.8, 1.0], "columns": [0.7, 0.8, 1.0], "leaf": [1, 3, 5]})
START = {"depth": 5, "step": 0.05, "rows": 0.8, "columns": 0.8, "leaf": 3}


def _rows(train: DataFrame, validation: DataFrame, folds: int, key: str, label: str):
    """(keys, labels, fold of each row, -1 for validation rows)."""
    from .sampling import stratified_folds

    tagged = stratified_folds(train, label, key, folds).select(key, label, "cv_fold").unionByName(validation.select(key, label, F.lit(-1).alias("cv_fold")))
    rows = sorted(tuple(r) for r in tagged.collect())  # one row for each repertoire
    return [r[0] for r in rows], np.array([float(r[1]) for r in rows]), np.array([r[2] for r in rows])


def fitted(long: DataFrame, train: DataFrame, validation: DataFrame, rounds: int = 1000, patience: int = 20, key: str = "repertoire_id", label: str = "label", **params) -> Fit:
    """One model with ``params`` (others as in START)."""
    keys, y, fold = _rows(train, validation, 2, key, label)
    return boost(long, [Fit(START | params, fold >= 0, fold == -1)], keys, y, rounds, patience, key)[0]


def tuned(long: DataFrame, train: DataFrame, validation: DataFrame, grids=GRIDS, folds: int = 3, rounds: int = 1000, patience: int = 20, key: str = "repertoire_id", label: str = "label") -> tuple[Fit, list[tuple[dict, float]]]:
    """(model, (parameters, mean AUROC) of every setting): in each grid the first setting of best mean AUROC over stratified
    folds, all settings and folds fitted together; then a fit on ``train`` that ends by ``validation``."""
    keys, y, fold = _rows(train, validation, folds, key, label)
    best, tried = dict(START), []
    for grid in grids:
        settings = [best | dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
        fits = boost(long, [Fit(s, (fold >= 0) & (fold != f), fold == f) for s in settings for f in range(folds)], keys, y, rounds, patience, key, kept=False)
        top = -1.0
        for i, s in enumerate(settings):
            scores = [f.auroc for f in fits[i * folds : (i + 1) * folds] if f.auroc >= 0]
            mean = float(np.mean(scores)) if scores else -1.0
            tried.append((s, mean))
            if mean > top:
                top, best = mean, s
    return boost(long, [Fit(best, fold >= 0, fold == -1)], keys, y, rounds, patience, key)[0], tried


def tree_table(spark, model: Fit) -> DataFrame:
    """(tree, node, feature, cut, missing_left, weight): splits have a feature, leaves a weight; tree -1 is the base."""
    rows = [(-1, 0, None, None, None, model.base)]
    for t, tree in enumerate(model.trees):
        rows += [(t, n, *v[1:], None) if v[0] == "split" else (t, n, None, None, None, v[1]) for n, v in sorted(tree.items())]
    return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, missing_left boolean, weight double")


def predict(long: DataFrame, table: DataFrame, rows: DataFrame, key: str = "repertoire_id", name: str = "score") -> DataFrame:
    """``rows`` with the probability that a table of trees gives their long features: a tree level is one join on (row,
    feature), so no row's features are gathered."""
    scratch = Scratch(long.sparkSession)
    splits = F.broadcast(table.where("feature is not null").drop("weight"))  # the model's size
    leaves = F.broadcast(table.where("feature is null and tree >= 0").select("tree", "node", "weight"))
    base = table.where("tree = -1").first()["weight"]
    used = table.where("feature is not null").select("feature").distinct()
    cells = scratch.write(long.select(F.col(key).alias("__k"), "feature", "value").where(F.col("value") != 0).join(F.broadcast(used), "feature", "left_semi"))
    own = rows.select(F.col(key).alias("__k")).distinct()
    trees = F.broadcast(table.where("tree >= 0").select("tree").distinct())
    at = scratch.write(own.join(trees).select("__k", "tree", F.lit(0).alias("node")))  # a row in each tree
    depth = table.agg(F.max(F.floor(F.log2(F.col("node") + 1)))).first()[0] or 0
    for _ in range(int(depth)):
        moved = at.join(splits, ["tree", "node"], "left").join(cells, ["__k", "feature"], "left")
        left = F.when(F.col("value").isNull(), F.col("missing_left")).otherwise(F.col("value") <= F.col("cut"))
        node = F.when(F.col("feature").isNull(), F.col("node")).when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
        at = scratch.write(moved.select("__k", "tree", node.alias("node")))
    total = at.join(leaves, ["tree", "node"]).groupBy("__k").agg(F.sum("weight").alias("__z"))
    out = rows.join(total.withColumnRenamed("__k", key), key, "left")
    return out.withColumn(name, 1 / (1 + F.exp(-(F.coalesce("__z", F.lit(0.0)) + F.lit(base))))).drop("__z")
