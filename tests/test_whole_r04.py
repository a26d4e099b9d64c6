"""Findings of round 4: whole jobs, and steps whose cost must follow the input, against plain versions."""

import random
import re

import numpy as np
import pytest

from tessera.functions import sequences
from tessera.operators import boosting, contraction, features, learners, similarity
from tessera.plans import more_queries
from tessera.plans.fixtures import repertoire

SMALL = "/root/testdata/sf0.001"
CODES = sequences.isometric_codes()


def test_evidence_is_attributed_to_v_and_j_genes(spark):
    usage = features.gene_usage(repertoire(spark, SMALL))
    want = {r["feature"] for r in usage.select("feature").distinct().collect()}
    got = [r["feature"] for r in more_queries.score_attribution(spark, SMALL).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {f[:2] for f in got} == {"V:", "J:"}


@pytest.mark.parametrize("names", [40, 7])
def test_close_pairs_are_made_once_and_not_shuffled(spark, monkeypatch, names):
    rng = random.Random(names)
    texts = {"".join(rng.choice("ILVMSé") for _ in range(n)) for n in (1, 5, 6, 10, 11, 12, 17) for _ in range(40)} | {""}
    table, want = contraction._table(CODES), {}
    known = {s: contraction.encode([s], table, 3, 2).ravel() for s in texts if s}
    for threshold in (7.0, 12.0):
        want = {(a, b): float(((x - y) ** 2).sum()) for a, x in known.items() for b, y in known.items() if a != b and len(a) == len(b)}
        want = {k: d for k, d in want.items() if d <= threshold - 0.5 * (15 - len(k[0]))}
        monkeypatch.setattr(similarity, "BLOCK_NAMES", names, raising=False)
        monkeypatch.setattr(similarity, "NEAR", 30)
        monkeypatch.setattr(similarity, "ACROSS", 8, raising=False)
        rows = spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "cdr3_aa string")
        few = rows.where("cdr3_aa like 'I%' or cdr3_aa like 'S%'")
        for left, right in ((rows, rows), (few, rows)):
            found = contraction.block_pairs(left, right, CODES, threshold)
            got = [(r["a"], r["b"], round(r["distance"], 6)) for r in found.collect()]
            own = {k: round(d, 6) for k, d in want.items() if left is rows or k[0][0] in "IS"}
            assert len(got) == len(own) and {(a, b): d for a, b, d in got} == own
            assert not re.search(r"hashpartitioning\(a#\d+, b#", found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0])
            near = {r["a"]: r["b"] for r in similarity.nearest(contraction.block_pairs(left, right, CODES, threshold, nearest_only=True)).collect()}
            best = {a: min((round(want[a, b], 9), b.encode()) for x, b in own if x == a)[1].decode() for a, _ in own}
            assert near == best


def test_only_what_may_be_nearest_is_told_by_differences(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    monkeypatch.setattr(similarity, "NEAR", 1_000)
    monkeypatch.setattr(similarity, "ACROSS", 60, raising=False)
    told = sum(len(i) for i, _, _ in similarity._within(x, x, 1e3, np.arange(300), True))
    assert 600 <= told < 300 * 40  # of 90,000 pairs, all within the limit


def test_fits_of_narrow_features_are_grown_in_one_job(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((120, 7)) * (rng.random((120, 7)) < 0.8), 1)  # ties, and missing values
    x[:, 5] = x[:, 2]
    y = (x[:, 0] + x[:, 2] + rng.random(120) > 1.2).astype(float)
    keys = [f"r{i:03}" for i in range(120)]
    cells = [(k, f"f{j}", float(v)) for k, row in zip(keys, x, strict=True) for j, v in enumerate(row)]
    long = spark.createDataFrame(cells, "repertoire_id string, feature string, value double")
    params = [{"depth": d, "step": 0.2, "rows": r, "columns": c, "leaf": leaf} for d, r, c, leaf in ((1, 1.0, 1.0, 1), (4, 0.7, 0.6, 1), (3, 0.8, 1.0, 3))]
    fold = np.arange(120) % 3

    def fitted():
        return boosting.boost(long, [boosting.Fit(p, fold != f, fold == f) for f, p in enumerate(params)], keys, y, rounds=6, patience=3)

    monkeypatch.setattr(boosting, "PART", 50, raising=False)

    def jobs():
        spark.sparkContext.setJobGroup(name := f"boosting-{getattr(boosting, 'WHOLE', 1)}", "")
        try:
            return fitted(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    (whole, few), _ = jobs(), monkeypatch.setattr(boosting, "WHOLE", 0, raising=False)
    blocks, many = jobs()
    assert few < many / 2  # not one for each level of a tree
    for a, b in zip(whole, blocks, strict=True):
        assert a.trees and a.trees == b.trees and (a.auroc, a.best, a.base) == (b.auroc, b.best, b.base)


def test_wide_l1_fits_go_in_step_and_are_not_held(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import DataFrame

    rng = np.random.default_rng(6)
    x = (5 + rng.normal(size=(150, 9))) * (rng.random((150, 9)) < np.append(np.ones(5), np.full(4, 0.3)))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=150) > 0).astype(int)
    sparse = [Vectors.sparse(9, np.flatnonzero(v).tolist(), v[v != 0].tolist()) if i % 3 else Vectors.dense(v) for i, v in enumerate(x)]
    rows = spark.createDataFrame([(f"r{i:03}", int(y[i]), v) for i, v in enumerate(sparse)], ["repertoire_id", "label", "features"]).repartition(3)
    chosen = learners.choose_c(rows, [0.001, 0.05, 1.0])  # narrow: Newton steps
    monkeypatch.setattr(learners, "NARROW", 4)
    monkeypatch.setattr(learners, "DENSE", 40, raising=False)
    held = []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: held.append(self) or self)
    for points in (1_000_000, 20):  # in the second two fits a group
        monkeypatch.setattr(learners, "POINTS", points, raising=False)
        assert learners.choose_c(rows, [0.001, 0.05, 1.0]) == chosen
    for c in (0.05, 1.0):
        model = learners.l1_logistic(rows, c, 150, tol=1e-10, steps=300)
        w, b = model.coefficients.toArray(), model.intercept
        slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / 150
        bound = 1 / (c * 150)
        assert np.all(np.abs(slope + np.sign(w) * bound)[w != 0] < 1e-5) and np.all(np.abs(slope)[w == 0] < bound + 1e-5)
        got = {r["repertoire_id"]: r["score"] for r in learners.probability(model, rows).collect()}
        assert np.allclose([got[f"r{i:03}"] for i in range(150)], 1 / (1 + np.exp(-(x @ w + b))))
    assert not held


def test_large_blocks_of_repertoires_are_compared_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x = rng.integers(0, 4, (40, 6)) + (np.arange(6) == 0)
    share = x / x.sum(axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"S{i:02}", f"c{c}", float(share[i, c])) for i in range(40) for c in range(6) if x[i, c]], "repertoire_id string, cluster string, share double")
    blocks = similarity.ALL_PAIRS
    monkeypatch.setattr(similarity, "TILE", 4, raising=False)
    found = similarity.repertoire_distances(rows).collect()
    got = {(r["a"], r["b"]): (r["euclidean"], r["wasserstein"]) for r in found}
    assert len(found) == len(got) == 40 * 39 // 2 and all(a < b for a, b in got)
    for (a, b), (e, w) in got.items():
        p, q = share[int(a[1:])], share[int(b[1:])]
        assert abs(e - ((p - q) ** 2).sum() ** 0.5) < 1e-7 and abs(w - np.abs(np.sort(p) - np.sort(q)).mean()) < 1e-7
    assert 60_000 / blocks < 10  # 60,000 repertoires are shuffled less than ten times
