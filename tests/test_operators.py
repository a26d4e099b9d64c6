"""Properties and small cases of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import scratch
from tessera.operators import association, cleaning, cohorts, features, learners, metrics, sampling, similarity
from tessera.operators.graph import components


def rep(spark, rows):
    return spark.createDataFrame(rows, "repertoire_id string, row_idx int, cdr3_aa string, v_call string, j_call string, duplicate_count int")


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(9, 15))) for _ in range(40)]
    rows = [(f"S{r}", i, rng.choice(pool), f"TRBV{rng.randint(1, 4)}-1*01", f"TRBJ1-{rng.randint(1, 3)}*01", rng.randint(1, 20)) for r in range(8) for i in range(60)]
    return rep(spark, rows).persist()


def test_funnel_sums_to_input(spark):
    rows = [("S1", 0, "In", "CASSF", "TCRBV07-02", "TCRBJ01-02", 3), ("S1", 1, "Out", "CASSF", "TCRBV07-02", "TCRBJ01-02", 3), ("S1", 2, "In", "unresolved", "TCRBV07-02", "TCRBJ01-02", None),
            ("S1", 3, "In", None, "TCRBV07-02", "TCRBJ01-02", 1), ("S1", 4, "In", "CA*SF", "TCRBV07-02", "TCRBJ01-02", 1), ("S2", 0, "In", "CASSF", "TCRBV04", "TCRBJ01-02", 1), ("S2", 1, None, "CASSF", "TCRBV07-02", "TCRBJ01-02", None)]
    raw = spark.createDataFrame(rows, "repertoire_id string, row_idx int, frame_type string, amino_acid string, v_gene string, j_gene string, templates int")
    steps = ["productive", "resolved", "present", "standard", "gene_level"]
    total = [r for r in cleaning.funnel(cleaning.adaptive_steps(raw), steps).collect() if r["repertoire_id"] is None][0]
    assert [total[f"n_{s}"] for s in steps] == [2, 1, 1, 1, 1] and total["n_kept"] == 1 and total["n_input"] == 7
    kept = cleaning.clean_adaptive(raw).collect()
    assert [tuple(r) for r in kept] == [("S1", 0, "ASS", "TRBV7-2", "TRBJ1-2", 3)]


def test_layout_errors(spark):
    df = spark.createDataFrame([("t", "x")], "productive string, other string")
    with pytest.raises(ValueError):
        cleaning.airr_layout(df, {}, ["productive"])
    out = cleaning.airr_layout(df, {"other": "note"}, ["note", "productive", "locus"], ["locus"], ["productive"])
    assert out.columns == ["note", "productive", "locus"] and out.first()["productive"] == "T"


def test_nucleotides(spark):
    df = spark.createDataFrame([("AAATGTTTTCCC", "CF"), ("AAATGNTTTCCC", "CF"), ("AAATGTTTCCC", "CF"), ("AAATGTTTTCCC", "CC"), (None, "C")], "cdr3_rearrangement string, cdr3_aa string")
    assert [r["nt_reason"] for r in cleaning.nucleotide_reasons(df).collect()] == [None, "letters", "length", "translation", "missing"]


def test_frequencies_sum_to_one(small):
    for df in (features.kmer_frequencies(small), features.gene_usage(small)):
        sums = df.groupBy("repertoire_id").agg(F.sum("value").alias("s")).collect()
        assert all(abs(r["s"] - (2 if r["s"] > 1.5 else 1)) < 1e-9 for r in sums)


def test_depths_nest(small):
    d = sampling.nested_depths(small, [5, 10], 2).collect()
    by = {(r["repertoire_id"], r["replicate"], n): {x["row_idx"] for x in d if (x["repertoire_id"], x["replicate"], x["depth"]) == (r["repertoire_id"], r["replicate"], n)} for r in d for n in (5, 10)}
    assert all(len(v) == k[2] for k, v in by.items())
    assert all(by[k[0], k[1], 5] <= by[k[0], k[1], 10] for k in by)


def test_repartition_invariance(small):
    a = {tuple(r) for r in sampling.sample(small, n=7).select("repertoire_id", "row_idx").collect()}
    b = {tuple(r) for r in sampling.sample(small.repartition(13), n=7).select("repertoire_id", "row_idx").collect()}
    assert a == b and len(a) == 56


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ACDEFG") for _ in range(rng.randint(8, 22))) for _ in range(60)]
    more = []
    for s in base:
        t = list(s)
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(t))
            kind = rng.randrange(3)
            t[p : p + (kind != 1)] = [rng.choice("ACDEFG")] * (kind != 2)
        more.append("".join(t))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    left, right = spark.createDataFrame([(s,) for s in base], "cdr3_aa string"), spark.createDataFrame([(s,) for s in more], "cdr3_aa string")
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(left, right).collect()}
    want = {(a, b) for a in set(base) for b in set(more) if 1 - lev(a, b) / max(len(a), len(b)) >= 0.9}
    assert got == want


def test_similar_pairs_of_long_strings(spark):
    rng = random.Random(17)
    amino = "ACDEFGHIKLMNPQRSTVWY"
    left, right = set(), set()
    for n in [*range(25, 64), 30, 30, 30, 39, 40, 90]:
        s = "".join(rng.choice(amino) for _ in range(n))
        left.add(s)
        for most in (n // 10, n // 10, n // 9, n // 9 + 1):
            spread = sorted(rng.sample(range(n), most), reverse=True)
            for kinds in ("s", "i", "d", "sid"):
                t = list(s)
                for p in spread:
                    kind = rng.choice(kinds)
                    t[p : p + (kind != "i")] = [] if kind == "d" else rng.choice(amino)
                right.add("".join(t))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    want = {(a, b) for a in left for b in right if abs(len(a) - len(b)) <= 10 and 10 * distance(a, b) <= max(len(a), len(b))}
    assert len(want) > 200
    frames = [spark.createDataFrame([(x,) for x in sorted(own)], "cdr3_aa string") for own in (left, right)]
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(*frames).collect()} == want
    assert {(r["b"], r["a"]) for r in similarity.similar_pairs(*frames[::-1]).collect()} == want


def test_components_of_a_path_and_loops(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "x"), ("y", "z"), ("z", "y"), (None, "q")]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert all(got[f"n{i:03d}"] == "n000" for i in range(61)) and got["x"] == "x" and got["y"] == got["z"] == "y"
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_auroc_symmetry_and_edges(spark):
    rng = random.Random(7)
    rows = [("a", rng.randint(0, 9) / 10, rng.randint(0, 1)) for _ in range(80)] + [("tied", 0.5, i % 2) for i in range(4)] + [("one", 0.3, 1)]
    df = spark.createDataFrame(rows, "g string, model_score double, disease_label int")
    a = {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"]).collect()}
    b = {r["g"]: r["auroc"] for r in metrics.auroc(df.withColumn("model_score", -F.col("model_score")), ["g"]).collect()}
    assert abs(a["a"] + b["a"] - 1) < 1e-12 and a["tied"] == 0.5 and a["one"] is None


def test_fisher(spark):
    labels = spark.createDataFrame([(f"S{i}", int(i < 4)) for i in range(10)], "repertoire_id string, label int")
    counts = spark.createDataFrame([("x", "v", "j", 3, 1), ("y", "v", "j", 4, 6), ("z", "v", "j", 0, 2)], "cdr3_aa string, v_call string, j_call string, n_pos bigint, n_neg bigint")
    got = {r["cdr3_aa"]: r["p_value"] for r in association.fisher_greater(counts, labels).collect()}
    for name, a, b in (("x", 3, 1), ("y", 4, 6), ("z", 0, 2)):
        want = sum(math.comb(4, i) * math.comb(6, a + b - i) for i in range(a, min(4, a + b) + 1)) / math.comb(10, a + b)
        assert abs(got[name] - want) < 1e-9


def test_beta_binomial_fit_beats_neighbours(spark):
    rng = random.Random(11)
    rows = [(1, 1000 + rng.randint(0, 500), rng.randint(0, 12)) for _ in range(60)]
    fit = association.fit_beta_binomial(spark.createDataFrame(rows, "label int, n bigint, k bigint"), ["label"]).first()

    def value(a, b):
        return sum(math.lgamma(k + a) + math.lgamma(n - k + b) - math.lgamma(n + a + b) for _, n, k in rows) - len(rows) * (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))

    best = value(fit["a"], fit["b"])
    assert best >= value(1.0, 1000.0) and all(best >= value(fit["a"] * x, fit["b"] * y) - 1e-6 for x, y in itertools.product((0.9, 1, 1.1), repeat=2))


def test_isometric_pairs_equal_brute_force(small):
    from tessera.functions import sequences

    own = similarity.encoded(small, sequences.ATCHLEY).persist()
    got = {(r["a"], r["b"]) for r in similarity.isometric_pairs(own, own, 30, 60.0).collect()}
    rows = own.collect()
    want = {(x["cdr3_aa"], y["cdr3_aa"]) for x in rows for y in rows if x["len"] == y["len"] and x["cdr3_aa"] != y["cdr3_aa"] and sum((p - q) ** 2 for p, q in zip(x["code"], y["code"], strict=True)) <= 60 - 0.5 * (15 - x["len"])}
    assert got == want


def test_age_match_and_folds(spark):
    rows = [(f"P{i}", int(i % 3 == 0), float(20 + i % 40) if i % 7 else None) for i in range(90)]
    task = spark.createDataFrame(rows, "participant_label string, label int, age double")
    out = cohorts.age_match(task).collect()
    assert sum(r["label"] for r in out) == 30 and all(r["age"] is not None for r in out if r["label"] == 0)
    none = task.where("label = 1 or age is null")
    assert cohorts.age_match(none).count() == none.count()
    folds = sampling.alternating_folds(task.withColumn("label", F.when(F.col("participant_label") != "P1", F.col("label"))), "label", "participant_label").groupBy("fold").count().collect()
    assert abs(folds[0]["count"] - folds[1]["count"]) <= 1


def test_source_mismatch_and_pool(spark):
    s = spark.createDataFrame([("a", "F", "pos", 30.0), ("b", "M", "neg", 40.0)], "id string, sex string, status string, age double")
    f = spark.createDataFrame([("a", "F", "pos", 31.0), ("b", "F", "neg", 40.0), ("c", "F", "neg", 1.0)], "id string, sex string, status string, age double")
    assert cohorts.source_mismatches(s, f, "id").count() == 2
    with pytest.raises(ValueError):
        cohorts.pool({"a": s})


def test_linear_model_round_trip(spark, small):
    long = features.gene_usage(small)
    rows = small.select("repertoire_id").distinct().withColumn("label", (F.substring("repertoire_id", 2, 2).cast("int") % 2))
    index = learners.feature_index(long, rows)
    scaled = learners.scales(long, index, rows)
    v = learners.vectors(long, scaled, rows)
    model = learners.l1_logistic(v, 10.0, 8)
    direct = {r["repertoire_id"]: r["score"] for r in learners.probability(model, v).collect()}
    table = learners.coefficient_table(spark, model, scaled)
    again = {r["repertoire_id"]: r["score"] for r in learners.predict_long(long, table, rows).collect()}
    assert all(abs(direct[k] - again[k]) < 1e-9 for k in direct)


def test_residuals_are_orthogonal(spark):
    rng = random.Random(2)
    rows = [(f"S{i}", rng.random(), rng.random()) for i in range(30)]
    cov = spark.createDataFrame([(k, a, b) for k, a, b in rows], "repertoire_id string, c1 double, c2 double")
    long = spark.createDataFrame([(k, "f", 2 * a - b + 0.1 * rng.random()) for k, a, b in rows], "repertoire_id string, feature string, value double")
    r = learners.residualized(long, cov, cov, ["c1", "c2"]).join(cov, "repertoire_id")
    s = r.agg(F.sum("value"), F.sum(F.col("value") * F.col("c1")), F.sum(F.col("value") * F.col("c2"))).first()
    assert all(abs(x) < 1e-8 for x in s)


def test_residuals_need_not_be_made(spark):
    """Vectors, deviations and scores from sparse features equal those of the table of residuals."""
    rng = random.Random(8)
    cov = spark.createDataFrame([(f"S{i}", rng.random(), float(i % 2)) for i in range(24)], "repertoire_id string, c1 double, c2 double")
    long = spark.createDataFrame([(f"S{i}", f, rng.random()) for i in range(23) for f in "abcd" if rng.random() < 0.6] + [(f"S{i}", "same", 2.0) for i in range(24)], "repertoire_id string, feature string, value double")
    train, names = cov.where("repertoire_id < 'S20'").select("repertoire_id"), ["c1", "c2"]
    fitted = scratch.numbered(learners.residual_fit(long, cov, train, names), ["feature"], "id")
    table = learners.residualized(long, cov, train, names)
    std = {r["feature"]: r["std"] for r in learners.scales(table, learners.feature_index(table, train), train).collect()}
    own = {r["feature"]: r for r in fitted.collect()}
    assert set(own) == {"a", "b", "c", "d", "same"} and own["same"]["std"] == 1.0
    assert all(abs(own[f]["std"] - std[f]) < 1e-9 for f in "abcd")
    want = {(r["repertoire_id"], r["feature"]): r["value"] for r in table.collect()}
    got = learners.residual_vectors(long, fitted, cov.select("repertoire_id"), cov, names).collect()
    assert len(got) == 24
    for r in got:
        assert all(abs(r["features"][x["id"]] * x["std"] - want[r["repertoire_id"], f]) < 1e-9 for f, x in own.items())
    weights = spark.createDataFrame([("a", 0.5), ("c", -1.5), ("", 0.2)], "feature string, weight double")
    scores = learners.predict_residuals(long, weights, fitted, cov.select("repertoire_id"), cov, names).collect()
    plain = {r["repertoire_id"]: r["score"] for r in learners.predict_long(table, weights, cov.select("repertoire_id")).collect()}
    assert len(scores) == 24 and all(abs(r["score"] - plain[r["repertoire_id"]]) < 1e-12 for r in scores)


def test_mil_fit_learns(spark):
    rng = random.Random(4)
    rows = [(f"S{i}", [rng.gauss(0, 1) + (3 if (i % 2 and k == 0) else 0), rng.gauss(0, 1)]) for i in range(20) for k in range(5)]
    bags = spark.createDataFrame(rows, "repertoire_id string, x array<double>")
    labels = spark.createDataFrame([(f"S{i}", i % 2) for i in range(20)], "repertoire_id string, label int")
    w, b, loss = learners.mil_fit(bags, labels, restarts=3, steps=12)
    assert loss < 0.69 and len(w) == 2
    scores = learners.mil_scores(bags, w.tolist(), b, labels.select("repertoire_id").unionByName(spark.createDataFrame([("empty",)], "repertoire_id string"))).collect()
    assert {r["score"] for r in scores if r["repertoire_id"] == "empty"} == {0.5}


def test_restarts_reach_the_loss_of_long_descents(spark):
    """No restart's best is worse than plain descents from the same kind of start, with the same loss."""
    rng = np.random.default_rng(12)
    bags = {f"S{i}": rng.normal(size=(rng.integers(1, 7), 3)) + [1.5 * (i % 2), 0, 0] for i in range(30)}
    frame = spark.createDataFrame([(k, x.tolist()) for k, own in bags.items() for x in own], "repertoire_id string, x array<double>")
    y = {k: int(k[1:]) % 2 for k in bags}
    _, _, loss = learners.mil_fit(frame.repartition(5), spark.createDataFrame(list(y.items()), "repertoire_id string, label int"), restarts=40)

    def at(w):
        total, slope = 0.0, np.zeros(4)
        for k, x in bags.items():
            z = x @ w[:3] + w[3]
            i = int(z.argmax())
            p = 1 / (1 + np.exp(-z[i]))
            total -= np.log(p if y[k] else 1 - p) / len(bags)
            slope += (p - y[k]) * np.append(x[i], 1) / len(bags)
        return total, slope

    best = np.inf
    for _ in range(8):
        w = np.append(rng.normal(0, 1 / 20, 2), [0, rng.normal(0, 1 / 20)])
        for step in range(1500):
            now, slope = at(w)
            best = min(best, now)
            w = w - 0.5 / (1 + step / 300) * slope
    assert loss <= best + 1e-3


def test_sequence_decisions_and_optimality(spark):
    rep = spark.createDataFrame([("r", "ABCDE", "v1", "j1"), ("r", "ABCDE", "v2", "j1"), ("s", "AB", "v1", None), ("s", "AB", "v9", "j9")], "repertoire_id string, cdr3_aa string, v_call string, j_call string")
    kmer = spark.createDataFrame([("", 0.5), ("ABCD", 1.0), ("A_CD", 2.0), ("BCD_", 4.0), ("ZZZZ", 8.0), ("BCDE", 0.0)], "feature string, weight double")
    gene = spark.createDataFrame([("", -1.0), ("V:v1", 1.0), ("V:v2", 3.0), ("J:j1", 0.25)], "feature string, weight double")
    got = {(r["repertoire_id"], r["cdr3_aa"]): r["score"] for r in learners.sequence_decisions(rep, kmer, gene, 0.4).collect()}
    assert got == pytest.approx({("r", "ABCDE"): 0.4 * 7.5 + 0.6 * 2.25, ("s", "AB"): 0.4 * 0.5 - 0.6})
    long, rows = _vectors(spark)
    scaled = learners.scales(long, learners.feature_index(long, rows), rows)
    model = learners.l1_logistic(learners.vectors(long, scaled, rows), 0.5, rows.count(), tol=1e-10, steps=2000)
    table = learners.coefficient_table(spark, model, scaled)
    assert all(r["excess"] < 1e-3 for r in learners.optimality(long, rows, table, scaled, 0.5).collect())
    wrong = table.withColumn("weight", F.col("weight") * 1.3)
    assert any(r["excess"] > 5e-3 for r in learners.optimality(long, rows, wrong, scaled, 0.5).collect())


def test_numbered(spark):
    from tessera.scratch import numbered

    rows = [(k * 7919 % 503, str(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(7)
    got = [(r["n"], r["k"]) for r in numbered(df, ["k", "s"], "n").orderBy("n").collect()]
    assert [n for n, _ in got] == list(range(500)) and [k for _, k in got] == sorted(k for k, _ in rows)
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def test_specimen_scores_leave_excluded_clusters_out(spark):
    assigned = spark.createDataFrame([("a", "big"), ("a", "c1"), ("a", "none"), ("b", "big")], "repertoire_id string, cluster string")
    reference = [("r1", "big")] * 101 + [("r1", "c1"), ("r2", "c1"), ("r1", "c1")]
    labels = spark.createDataFrame([("r1", 1), ("r2", 0)], "repertoire_id string, label int")
    fractions = similarity.cluster_disease_fraction(spark.createDataFrame(reference, "repertoire_id string, cluster string"), labels)
    specimens = spark.createDataFrame([("a",), ("b",), ("c",)], "repertoire_id string")
    got = {r["repertoire_id"]: r["score"] for r in similarity.specimen_scores(assigned, fractions, specimens).collect()}
    assert got == {"a": pytest.approx((2 / 3 + 0) / 2), "b": 0.0, "c": 0.0}


def test_repertoire_distances_equal_dense_form(spark):
    rng = np.random.default_rng(1)
    n, k = 6, 9
    w = rng.random((n, k)) * (rng.random((n, k)) < 0.6)
    w[:, 0] += 0.1
    w[1, 1:] = 0
    p = w / w.sum(axis=1, keepdims=True)
    shares = spark.createDataFrame([(f"r{i}", f"c{j}", float(p[i, j])) for i in range(n) for j in range(k) if p[i, j] > 0], "repertoire_id string, cluster string, share double")
    k = len({j for i in range(n) for j in range(k) if p[i, j] > 0})
    q = p + 1e-9
    got = {(r["a"], r["b"]): r for r in similarity.repertoire_distances(shares).collect()}
    assert len(got) == n * (n - 1) // 2
    for (a, b), r in got.items():
        x, y = q[int(a[1])], q[int(b[1])]
        m = (x + y) / 2
        assert r["euclidean"] == pytest.approx(np.sqrt(((x - y) ** 2).sum()))
        assert r["symmetric_kl"] == pytest.approx(((x - y) * np.log(x / y)).sum())
        assert r["jensen_shannon"] == pytest.approx(np.sqrt((x * np.log(x / m) + y * np.log(y / m)).sum() / 2), abs=1e-7)
        assert r["correlation"] == pytest.approx(1 - np.corrcoef(x, y)[0, 1])
        assert r["wasserstein"] == pytest.approx(np.abs(np.sort(x) - np.sort(y)).sum() / k)


def test_two_sided_p_and_enriched(spark):
    df = spark.createDataFrame([(f, float(v), y) for f in ("same", "apart") for y in (0, 1) for v in [*range(30)] for v in [v + (40 if f == "apart" and y else 0)]], "f string, v double, y int")
    tests = association.mann_whitney(df, "f", "v", "y")
    p = {r["f"]: (r["z"], r["p_value"]) for r in tests.collect()}
    assert p["same"] == (0.0, 1.0) and p["apart"][1] == pytest.approx(math.erfc(abs(p["apart"][0]) / math.sqrt(2)))
    assert [r["f"] for r in association.enriched(tests).collect()] == ["apart"]


def test_tuned_posterior_without_clones(spark):
    subjects = spark.createDataFrame([("a", 1, "train"), ("b", 0, "test")], "repertoire_id string, label int, role string")
    empty = spark.createDataFrame([], "repertoire_id string, threshold double, n int, k int")
    threshold, scores = association.tuned_posterior(empty, subjects)
    assert threshold is None and {r["score"] for r in scores.collect()} == {0.5}


def test_tuned_posterior_takes_the_best_threshold(spark):
    rng = random.Random(5)
    subjects = [(f"s{i}", i % 2, ["train", "train", "validation", "test"][i // 2 % 4]) for i in range(80)]
    counts = [(s, t, 500, (rng.randint(4, 9) if y and t == 0.001 else rng.randint(0, 2) if t == 0.001 else rng.randint(0, 6))) for s, y, _ in subjects for t in (0.01, 0.001)]
    threshold, scores = association.tuned_posterior(spark.createDataFrame(counts, "repertoire_id string, threshold double, n int, k int"), spark.createDataFrame(subjects, "repertoire_id string, label int, role string"))
    assert threshold == 0.001 and all((r["score"] > 0.5) == bool(r["label"]) for r in scores.where("role = 'test'").collect())


def _vectors(spark, n=90):
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", f, float(v)) for i in range(n) for f, v in zip("abc", (rng.normal(2 * (i % 2), 1), rng.normal(), rng.random()), strict=True)]
    return spark.createDataFrame(rows, "repertoire_id string, feature string, value double"), spark.createDataFrame([(f"r{i}", i % 2) for i in range(n)], "repertoire_id string, label int")


def test_sequence_scores_of_trees(spark):
    from tessera.operators import boosting

    long, rows = _vectors(spark)
    split = sampling.stratified_split(rows, "label", "repertoire_id", 0.8)
    model, _ = boosting.tuned(long, split.where("role = 'train'").drop("role"), split.where("role <> 'train'").drop("role"), ({"depth": [2], "step": [0.1], "rows": [1.0], "columns": [1.0], "leaf": [1]},), folds=2, rounds=5)
    units = spark.createDataFrame([("x", "CA", "v1", "a", 3.0), ("x", "CA", "v2", "a", -2.0), ("y", "CA", "v2", "a", -2.0)], "repertoire_id string, cdr3_aa string, v_call string, feature string, value double")
    got = {r["repertoire_id"]: r["score"] for r in learners.tree_sequence_scores(units, boosting.tree_table(spark, model), ["cdr3_aa", "v_call"]).collect()}
    assert got["x"] > got["y"]


def test_models_with_demographics(spark):
    long, rows = _vectors(spark)
    meta = spark.createDataFrame([(f"r{i}", float(20 + i), "M" if i % 3 else "F", ["African", "Asian", None][i % 3], [float(i % 2), 1.0]) for i in range(90)], "specimen_label string, age double, sex string, ancestry string, vector array<double>")
    split = sampling.stratified_split(rows, "label", "repertoire_id", 0.7)
    train, test = split.where("role = 'train'").drop("role"), split.where("role <> 'train'").drop("role")
    c, scored = learners.usage_and_demographics(long, meta, train, test, [1.0, 0.1], 2)
    assert c in (1.0, 0.1) and metrics.auroc(scored.withColumn("g", F.lit(1)), ["g"], "score", "label").first()["auroc"] > 0.7
    few, _ = learners.usage_and_demographics(long, meta, train.limit(8), test, [0.1], 2)
    assert few == 1.0
    ancestry = learners.ancestry_columns(meta, ["African", "Asian"])
    own = learners.demographic_features(meta.withColumns(ancestry), 40.0).join(rows.withColumnRenamed("repertoire_id", "specimen_label"), "specimen_label")
    parts = sampling.three_way_split(own, "label", "specimen_label").persist()
    part = lambda role: parts.where(F.col("role") == role).drop("role")
    cols = ["c_age", "c_sex_m", *ancestry]
    c, scores = learners.demographic_model(part("train"), part("validation"), cols, [0.1, 1.0])
    assert c in (0.1, 1.0) and scores(part("test")).where("score between 0 and 1").count() == part("test").count()
    c, scored = learners.embedding_and_demographics(part("test"), part("train"), "vector", cols, [1.0], 2)
    assert c == 1.0 and metrics.auroc(scored.withColumn("g", F.lit(1)), ["g"], "score", "label").first()["auroc"] == 1.0


def test_abundance_method_takes_the_better_encoding(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{i}", rng.normal(size=3).tolist()) for i in range(40) for _ in range(4)]
    good = [(r, [x[0] + 4.0 * (int(r[1:]) % 2), *x[1:]]) for r, x in rows]
    frame = lambda x: spark.createDataFrame(x, "repertoire_id string, x array<double>")
    y = spark.createDataFrame([(f"r{i}", i % 2) for i in range(40)], "repertoire_id string, label int")
    name, model = learners.abundance_method({"a": frame(rows), "b": frame(good)}, y, y, restarts=3, steps=25)
    assert name == "b" and len(model[0]) == 3


def test_simulated_chance_is_near_the_closed_form(spark):
    hits = spark.createDataFrame([("a", 10, 100, 5, 5), ("b", 10, 50, 4, 2)], "repertoire_id string, k int, n int, n_drivers int, n_present int")
    got = metrics.simulated_chance_recall(hits.unionByName(hits.limit(1).selectExpr("'none' repertoire_id", "k", "0 n", "n_drivers", "0 n_present")), 4000).first()
    assert got["closed_form"] == pytest.approx((0.1 + 0.2 * 2 / 4) / 2) and abs(got["chance_recall"] - got["closed_form"]) < 4 * got["standard_error"] < 0.02
    for n, good, k in ((50, 7, 20), (9, 9, 4), (9, 0, 4), (12, 5, 12), (1000, 400, 900)):
        chance = metrics.hypergeometric(n, good, k)
        low = max(0, k - n + good)
        assert np.allclose(chance, [math.comb(good, x) * math.comb(n - good, k - x) / math.comb(n, k) for x in range(low, low + len(chance))])
