"""Boosted trees on shared histograms against plain loops, tuning and scoring from a table of trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting


def data(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 7)), 2)
    x[rng.random(x.shape) < 0.3] = 0  # absent
    y = ((x[:, 0] > 0.1) ^ (x[:, 1] > 0.2)).astype(float)
    y[rng.random(n) < 0.1] = 1 - y[0]
    keys = [f"r{i:03d}" for i in range(n)]
    long = spark.createDataFrame([(k, f"f{j}", float(v)) for k, row in zip(keys, x, strict=True) for j, v in enumerate(row) if v], "repertoire_id string, feature string, value double")
    return long, keys, x, y


def tree_by_loops(x, g, h, depth, leaf):
    """Node of every row and {node: (feature, cut, missing_left)}; 0 is missing."""
    node, splits = np.zeros(len(x), int), {}
    for level in range(depth):
        for m in sorted(set(node[node >= 2**level - 1])):
            rows = np.flatnonzero(node == m)
            best = (1e-6, None)
            for f in range(x.shape[1]):
                seen = np.unique(x[x[:, f] != 0, f])
                for cut in [*seen[:-1], np.inf]:
                    for missing in (False, True):
                        left = rows[((x[rows, f] != 0) & (x[rows, f] <= cut)) | ((x[rows, f] == 0) & missing)]
                        right = np.setdiff1d(rows, left)
                        a, b = h[left].sum(), h[right].sum()
                        if a >= leaf and b >= leaf:
                            gain = round(g[left].sum() ** 2 / (a + 1) + g[right].sum() ** 2 / (b + 1) - g[rows].sum() ** 2 / (a + b + 1), 9)
                            if gain > best[0] + 1e-7:
                                best = (gain, (f, cut, missing, left, right))
            if best[1]:
                f, cut, missing, left, right = best[1]
                splits[m] = best[0]
                node[left], node[right] = 2 * m + 1, 2 * m + 2
    return node, splits


def test_trees_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BINS", 64)
    long, keys, x, y = data(spark)
    train, valid = np.arange(len(y)) % 4 != 0, np.arange(len(y)) % 4 == 0
    params = {"depth": 3, "step": 0.3, "rows": 1.0, "columns": 1.0, "leaf": 1}
    fit = boosting.boost(long, [boosting.Fit(params, train, valid)], keys, y, rounds=4, patience=9)[0]
    margin, aurocs = np.full(len(y), fit.base), []
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * train, p * (1 - p) * train
        node, _ = tree_by_loops(x, g, h, 3, 1)
        for m in set(node):
            own = node == m
            margin[own] -= 0.3 * g[own].sum() / (h[own].sum() + 1)
        aurocs.append(boosting.auroc(y[valid], np.round(margin[valid], 9)))
    assert fit.auroc == pytest.approx(max(aurocs)) and fit.best == 1 + int(np.argmax(np.round(aurocs, 12)))
    table = boosting.tree_table(spark, fit)
    rows = spark.createDataFrame([(k,) for k in [*keys, "unseen"]], "repertoire_id string")
    got = {r[0]: r[1] for r in boosting.predict(long, table, rows).collect()}
    walked = {}
    for k, row in zip(keys, x, strict=True):
        z = fit.base
        for tree in fit.trees:
            at = 0
            while tree[at][0] == "split":
                _, f, cut, missing = tree[at]
                v = row[int(f[1:])]
                at = 2 * at + (1 if (missing if v == 0 else v <= cut) else 2)
            z += tree[at][1]
        walked[k] = 1 / (1 + np.exp(-z))
    assert all(got[k] == pytest.approx(v) for k, v in walked.items()) and 0 < got["unseen"] < 1
    if fit.best == 4:
        assert np.allclose([walked[k] for k in keys], 1 / (1 + np.exp(-margin)))


def test_tuned_takes_the_first_best_setting(spark):
    long, keys, x, y = data(spark, 90, 2)
    task = spark.createDataFrame([(k, int(v)) for k, v in zip(keys, y, strict=True)], "repertoire_id string, label int")
    held = task.where("repertoire_id < 'r020'")
    grids = ({"depth": [1, 3], "step": [0.1, 0.4]}, {"rows": [0.8, 1.0], "columns": [0.6, 1.0], "leaf": [1]})
    model, tried = boosting.tuned(long, task.where("repertoire_id >= 'r020'"), held, grids, folds=3, rounds=12, patience=4)
    assert len(tried) == 8 and model.auroc > 0.6
    top = max(m for _, m in tried[4:])
    assert model.params == next(s for s, m in tried[4:] if m == top)
    again, _ = boosting.tuned(long.repartition(3), task.where("repertoire_id >= 'r020'").orderBy(F.desc("repertoire_id")), held, grids, folds=3, rounds=12, patience=4)
    assert again.trees == model.trees


def test_boosting_without_a_second_class_or_features(spark):
    long, keys, _, y = data(spark, 20, 3)
    one = boosting.boost(long, [boosting.Fit({"depth": 2, "step": 0.1, "rows": 1.0, "columns": 1.0, "leaf": 1}, np.ones(20, bool), np.zeros(20, bool))], keys, y)[0]
    assert one.trees == [] and one.auroc == -1.0
    none = boosting.boost(long.limit(0), [boosting.Fit(one.params, np.arange(20) % 2 == 0, np.arange(20) % 2 == 1)], keys, y, rounds=3)[0]
    assert none.auroc == 0.5
    rows = spark.createDataFrame([("r000",)], "repertoire_id string")
    assert boosting.predict(long, boosting.tree_table(spark, one), rows).count() == 1
