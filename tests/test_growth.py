"""Steps whose cost must follow the input: partitions, blocks and what leaves them, against plain loops."""

import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from tessera.llm import secret_scan
from tessera.operators import features, learners, metrics, sampling, similarity
from tessera.scratch import Scratch


def labelled_vectors(spark, n=60):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, 4))
    y = (x[:, 0] + 0.5 * rng.normal(0, 1, n) > 0).astype(int)
    rows = [(f"r{i:02}", int(y[i]), Vectors.dense(x[i].tolist())) for i in range(n)]
    return spark.createDataFrame(rows, ["repertoire_id", "label", "features"])


def test_training_vectors_leave_many_tiny_partitions(spark):
    rows = labelled_vectors(spark)
    held = learners.spread(rows.repartition(64))
    assert held.rdd.getNumPartitions() == 1
    assert sorted(held.collect()) == sorted(rows.collect())
    assert learners.spread(rows.limit(0)).count() == 0


def test_c_equals_one_fit_after_the_other(spark):
    rows, grid = labelled_vectors(spark), [0.001, 1.0, 0.3]
    tagged, n = sampling.stratified_folds(rows, "label", "repertoire_id", 5).persist(), rows.count()
    means = []
    for c in grid:
        parts = [learners.probability(learners.l1_logistic(tagged.where(F.col("cv_fold") != f), c, n - n // 5), tagged.where(F.col("cv_fold") == f)) for f in range(5)]
        means.append(np.mean([metrics.auroc(p, ["cv_fold"], "score", "label").first()["auroc"] for p in parts]))
    assert learners.choose_c(rows, grid) == grid[int(np.argmax(means))]


def test_nearest_vectors_write_each_block_once_for_every_other(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (90, 3)).astype(float)  # ties
    folds = [None if i % 4 == 3 else i % 3 for i in range(90)]
    rows = spark.createDataFrame([(i, folds[i], x[i].tolist()) for i in range(90)], "id long, fold int, v array<float>")
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 10)
    monkeypatch.setattr(similarity, "PART", 50)
    written = []
    monkeypatch.setattr(Scratch, "write", lambda self, df, write=Scratch.write: written.append(write(self, df)) or written[-1])
    found = {(r["id"], r["rank"]): (r["other"], round(r["distance"], 9)) for r in similarity.nearest_vectors(rows.where("fold is not null"), "id", "v", "fold", 4).collect()}
    want = {}
    for i in range(90):
        near = sorted((round(float(((x[i] - x[j]) ** 2).sum()) ** 0.5, 9), j) for j in range(90) if None not in (folds[i], folds[j]) and folds[i] != folds[j])
        want |= {(i, r + 1): (j, d) for r, (d, j) in enumerate(near[:4]) if folds[i] is not None}
    assert found == want
    blocks = written[0].count()
    assert written[-1].count() <= blocks * (blocks - 1) / 2  # a pair of blocks meets once


def test_kmers_are_counted_where_they_are_made(spark, monkeypatch):
    texts = {"a": ["CASSL", "CASSLG", "CAS", "CASSL"], "b": ["CASSLCASSL"] * 3 + ["", None], "c": ["CASSQ"] * 9}
    rows = spark.createDataFrame([(r, t) for r, own in texts.items() for t in own], "repertoire_id string, cdr3_aa string")
    want = Counter()
    for r, own in texts.items():
        for t in own:
            for i in range(len(t or "") - 3):
                want.update((r, f) for f in [t[i : i + 4], *(t[i : i + j] + "_" + t[i + j + 1 : i + 4] for j in range(4))])
    total = Counter()
    for (r, _), n in want.items():
        total[r] += n
    for most in (100_000, 6):  # repertoire c is large in the second
        monkeypatch.setattr(features, "KMER_ROWS", most)
        out = features.kmer_frequencies(rows)
        assert {(r["repertoire_id"], r["feature"]): (r["n"], round(r["value"], 9)) for r in out.collect()} == {k: (n, round(n / total[k[0]], 9)) for k, n in want.items()}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert bool(re.search(r"hashpartitioning\(repertoire_id#\d+, feature#\d+", plan)) == (most == 6)


def test_bags_are_read_in_small_batches_and_not_held(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = [rng.normal(size=(n, 3)) for n in (1, 7, 12)]
    points = rng.normal(size=(5, 4))
    monkeypatch.setattr(learners, "INSTANCES", 4)
    batch = pa.RecordBatch.from_arrays([pa.array([0.0, 1.0, 1.0]), pa.array([v.ravel().tolist() for v in x])], names=["y", "flat"])
    (out,) = learners._bag_sums(SimpleNamespace(value=points), 3)([batch])
    total = np.frombuffer(out.column(0)[0].as_py()).reshape(5, -1)
    for k, w in enumerate(points):
        want = np.zeros(5)
        for y, v in zip((0, 1, 1), x, strict=True):
            z = v @ w[:3] + w[3]
            p = 1 / (1 + np.exp(-z.max()))
            want += [-np.log(p if y else 1 - p), *((p - y) * v[z.argmax()]), p - y]
        assert np.allclose(total[k], want)
    bags = spark.createDataFrame([(f"S{i}", v.tolist()) for i, own in enumerate(x) for v in own], "repertoire_id string, x array<double>")
    held = []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: held.append(self) or self)
    learners.mil_fit(bags, spark.createDataFrame([("S0", 0), ("S1", 1), ("S2", 1)], "repertoire_id string, label int"), restarts=2, steps=2)
    assert not held and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_every_character_of_text_is_measured(monkeypatch):
    seen = []
    monkeypatch.setattr(secret_scan, "battery", lambda data, ends: seen.append((data.tobytes().decode(), ends)) or (np.zeros(len(ends), int), np.zeros(len(ends))))
    texts = ["".join(chr(97 + (i * i + k) % 26) + " " * (i % 3 == 0) for i in range(17)) for k in range(11)]
    whole = "".join(texts).replace(" ", "")
    secret_scan.pieces(texts)
    assert len(seen) == 3
    for (data, ends), n in zip(seen, secret_scan.LENGTHS, strict=True):
        parts = [data[e - n : e] for e in ends]
        rest = len(whole) % n
        assert "".join(parts[: len(whole) // n]) == whole[: len(whole) - rest] and parts[-1] == whole[-n:] and len(parts) == -(-len(whole) // n)


def test_only_the_nearest_of_a_block_leave_it(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(f"t{i:03}", 15, [float(v) for v in rng.integers(0, 2, 3)]) for i in range(120)], "cdr3_aa string, len int, code array<double>")
    left = []
    monkeypatch.setattr(similarity, "nearest", lambda pairs, own=similarity.nearest: left.append(pairs.count()) or own(pairs))
    queries, reference = rows.where("cdr3_aa < 't030'"), rows.where("cdr3_aa >= 't030'")
    got = {r["a"]: (r["b"], r["side"], r["distance"]) for r in similarity.query_nearest(queries, reference, 3, 7.0).collect()}
    code = {r["cdr3_aa"]: np.array(r["code"]) for r in rows.collect()}
    for a in sorted(code)[:30]:
        d, b = min((float(((code[a] - code[o]) ** 2).sum()), o) for o in code if o != a)
        assert got[a] == (b, "query" if b < "t030" else "reference", d)
    assert len(got) == 30 and left[0] < 30 * 119 / 4
