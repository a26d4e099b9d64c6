"""Steps of findings of round 3 whose cost must follow the input, against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from tessera.functions import sequences
from tessera.operators import association, cleaning, contraction, features, learners, similarity
from tessera.plans import file_queries
from tessera.sources import tables


def raw_rows(spark):
    rows = [("S1", 0, "In", "CASSLF", "TCRBV07-02", "TCRBJ01-02", 3), ("S1", 1, "Out", "CASSLF", "TCRBV07-02", "TCRBJ01-02", 1), ("S1", 2, "In", "CAS*LF", "TCRBV20-or9_2", "TCRBJ02-07", 1)]
    rows += [("S2", 0, "In", None, "TCRBV12-04", "TCRBJ02-07", None), ("S2", 1, "In", "CASSF", "TCRBV12-04*01", "TCRBJ02-07", None), ("S2", 2, "In", "CASSF", "TCRBV04", "TCRBJ02", 2), ("S2", 3, "In", "CASSF", "unresolved", "TCRBJ02-01", 2)]
    return spark.createDataFrame(rows, "repertoire_id string, row_idx int, frame_type string, amino_acid string, v_gene string, j_gene string, templates int")


def test_cleaning_spells_out_the_names_once(spark):
    raw = raw_rows(spark)
    kept = cleaning.clean_adaptive(raw)
    assert sorted(tuple(r) for r in kept.collect()) == [("S1", 0, "ASSL", "TRBV7-2", "TRBJ1-2", 3), ("S2", 1, "ASS", "TRBV12-3", "TRBJ2-7", 1)]
    steps = cleaning.adaptive_steps(raw)
    assert [r["removed_by"] for r in steps.orderBy("repertoire_id", "row_idx").collect()] == [None, "productive", "standard", "present", None, "gene_level", "resolved"]
    for df in (kept, steps.where("removed_by is null or removed_by = 'gene_level'").groupBy("v_call").count()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("TCRB([VDJ])") == 2  # one chain for V, one for J


def test_pairs_of_a_group_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACDé-") for _ in range(rng.choice([0, 3, 4]))) for _ in range(60)]
    own = [(f"g{rng.randrange(9)}", rng.choice(texts)) for _ in range(400)] + [(None, "ACD"), ("g1", None)]
    scores = {"AA": 5.0, "AC": 2.0, "CA": 1.0, "DA": -1.0}
    want = {}
    for a, b in {(a, b) for g, a in own for h, b in own if g and g == h and a is not None and b is not None and a.encode() < b.encode() and len(a) == len(b)}:
        want[a, b] = sum(min(4.0, scores.get(x + y, scores.get(y + x, -6.0))) for x, y in zip(a, b, strict=True))
    rows = spark.createDataFrame(own, "g string, s string")
    for listed, side, columns in ((200, 1000, 4096), (3, 4, 2), (0, 5, 1)):
        monkeypatch.setattr(similarity, "LISTED", listed)
        monkeypatch.setattr(similarity, "SIDE", side)
        monkeypatch.setattr(similarity, "COLUMNS", columns)
        found = similarity.scores_within(rows, "g", "s", scores)
        got = [(r["a"], r["b"], r["score"]) for r in found.collect()]
        assert len(got) == len(want) and {(a, b): v for a, b, v in got} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert bool(re.search(r"hashpartitioning\(a#\d+, b#\d+", plan)) == (listed < 200)


def test_only_the_nearest_repertoires_of_a_block_leave_it(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (41, 9)) * (rng.random((41, 9)) < np.linspace(1, 0.05, 9))  # full and sparse columns, ties
    x[x.sum(axis=1) == 0, 0] = 1
    x[7] = x[30]
    share = x / x.sum(axis=1, keepdims=True)
    rows = [(f"S{i}", f"c{c}", float(share[i, c])) for i in range(41) for c in range(9) if x[i, c]]
    name = lambda i: f"S{i}".encode()
    for most, part in ((8192, 4_000_000), (5, 3)):
        monkeypatch.setattr(similarity, "NEAREST", most)
        monkeypatch.setattr(similarity, "PART", part)
        found = similarity.nearest_repertoires(spark.createDataFrame(rows, "repertoire_id string, cluster string, share double"), 3).collect()
        blocks = max(4, -(-41 // most))
        assert len(found) <= 41 * 3 * blocks
        for i in range(41):
            want = sorted((round(float(((share[i] - share[j]) ** 2).sum()) ** 0.5, 9), name(j)) for j in range(41) if j != i)[:3]
            got = sorted({(r["euclidean"], r["b"].encode()) for r in found if r["a"] == f"S{i}"})[:3]
            assert got == want


def test_all_pairs_of_repertoires_leave_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(1, 5, (33, 8)) * (rng.random((33, 8)) < np.linspace(1, 0.06, 8))  # full and sparse columns
    x[x.sum(axis=1) == 0, 0] = 1
    share, e = x / x.sum(axis=1, keepdims=True), 1e-9
    rows = [(f"S{i:02}", f"c{c}", float(share[i, c])) for i in range(33) for c in range(8) if x[i, c]]
    monkeypatch.setattr(similarity, "ALL_PAIRS", 6, raising=False)
    met, own = [], similarity._distances
    monkeypatch.setattr(similarity, "_distances", lambda k, epsilon: met.append(k) or own(k, epsilon))
    found = similarity.repertoire_distances(spark.createDataFrame(rows, "repertoire_id string, cluster string, share double"))
    got = {(int(r["a"][1:]), int(r["b"][1:])): r for r in found.collect()}
    assert len(got) == 33 * 32 // 2 and met == [8] and found.rdd.getNumPartitions() >= 6 * 7 // 2  # six blocks
    for (i, j), r in got.items():
        p, q = share[i] + e, share[j] + e
        want = [((p - q) ** 2).sum() ** 0.5, ((p - q) * np.log(p / q)).sum(), max(0, (p * np.log(2 * p / (p + q)) + q * np.log(2 * q / (p + q))).sum() / 2) ** 0.5, np.abs(np.sort(share[i]) - np.sort(share[j])).mean()]
        assert np.allclose([r[c] for c in ("euclidean", "symmetric_kl", "jensen_shannon", "wasserstein")], want, atol=1e-7)
        if r["correlation"] is not None:
            assert abs(r["correlation"] - (1 - np.corrcoef(p, q)[0, 1])) < 1e-7


def test_a_key_of_many_rows_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 6).selectExpr("cast(id % 2 as int) label", "md5(cast(id as string)) cdr3_aa", "'v' v_call", "'j' j_call", "id duplicate_count", "cast(null as string) cdr3")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "200k")
    try:
        tables.write_by(rows, str(tmp_path / "out"), ["label"], "csv")
    finally:
        spark.conf.unset(size)
    assert all(len(list((tmp_path / "out" / f"label={k}").glob("*.gz"))) > 1 for k in (0, 1))
    read = tables.read_labelled(spark, str(tmp_path / "out"))
    assert {r["label"]: (r["n"], r["s"]) for r in read.groupBy("label").agg(F.count("*").alias("n"), F.sum("duplicate_count").alias("s")).collect()} == {f"label={k}": (30_000, sum(range(k, 60_000, 2))) for k in (0, 1)}


def test_fourmers_are_counted_where_they_are_made(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACDX") for _ in range(rng.choice([8, 11, 12]))) for _ in range(12)]
    own = [(f"S{i % 3}", rng.choice(texts)) for i in range(60)] + [("S0", None)]
    want = {}
    for name in ("S0", "S1", "S2"):
        clones = Counter(t for r, t in own if r == name and t and len(t) >= 10)
        places = [(t[i : i + 4], n) for t, n in clones.items() for i in range(3, len(t) - 6) if "X" not in t[i : i + 4]]
        for w in {w for w, _ in places}:
            sizes = [n for v, n in places if v == w]
            want[name, w] = (math.log(sum(sizes) / sum(n for _, n in places)), math.log(max(sizes) / sum(clones.values())))
    for most in (100_000, 15):  # repertoires are large in the second
        monkeypatch.setattr(features, "KMER_ROWS", most)
        out = features.fourmer_abundance(spark.createDataFrame(own, "repertoire_id string, cdr3_aa string"))
        got = {(r["repertoire_id"], r["fourmer"]): (r["log_sum"], r["log_max"]) for r in out.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert bool(re.search(r"hashpartitioning\(repertoire_id#\d+, fourmer#\d+", plan)) == (most == 15)


def test_ordered_files_are_several_tasks_work(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 5).selectExpr("concat('V', id % 7) v_call", "md5(cast(id as string)) seq")
    size = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(size, "50k")
    try:
        place = file_queries._tsv(rows, str(tmp_path / "ref"), "v_call", "seq")
    finally:
        spark.conf.unset(size)
    assert len(list((tmp_path / "ref").glob("part-*"))) > 1
    want = {r["v_call"]: r["s"] for r in rows.groupBy("v_call").agg(F.min("seq").alias("s")).collect()}
    assert {r["v_call"]: r["seq"] for r in tables.read_v_reference(spark, place).collect()} == want


def test_candidates_are_verified_before_they_are_shuffled(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([("".join(rng.choice("ILVM") for _ in range(12)),) for _ in range(80)], "cdr3_aa string")
    found = contraction.indexed_pairs(rows, rows, sequences.isometric_codes())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(a#") < plan.index("MapInArrow") < plan.index("Join")  # from the result down
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    assert pairs and len(pairs) == len(set(pairs)) and set(pairs) == {(b, a) for a, b in pairs}


def test_blocks_of_codes_meet_once_for_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(12)
    for spread in (1.5, 9.0):  # one cell and many
        x = rng.normal(size=(90, 4)) * spread
        x[17] = x[60]
        rows = [(f"s{i:02}", 14 + i % 2, [float(v) for v in x[i]]) for i in range(90)]
        want = {}
        for i, j in ((i, j) for i in range(90) for j in range(90) if i != j and i % 2 == j % 2):
            d = float(((x[i] - x[j]) ** 2).sum())
            if d <= 7 - 0.5 * (15 - rows[i][1]):
                want[rows[i][0], rows[j][0]] = d
        monkeypatch.setattr(similarity, "NEAR", 50, raising=False)
        own = spark.createDataFrame(rows, "cdr3_aa string, len int, code array<double>")
        other = own.select("*")
        for left, right in ((own, own), (own, other)):
            got = [(r["a"], r["b"], r["distance"]) for r in similarity.isometric_pairs(left, right, 4, block=9).collect()]
            assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want
            near = {(r["a"], r["b"]) for r in similarity.nearest(similarity.isometric_pairs(left, right, 4, block=9, nearest_only=True)).collect()}
            assert near == {min((round(d, 9), b, a) for (a, b), d in want.items() if a == s)[:0:-1] for s in {a for a, _ in want}}
        once = similarity.isometric_pairs(own, own, 4, block=9)._jdf.queryExecution().executedPlan().toString()
        twice = similarity.isometric_pairs(own, other, 4, block=9)._jdf.queryExecution().executedPlan().toString()
        assert "a#" in once and once.count("<=") > twice.count("<=")  # of two blocks of a cell one order is left


def test_pairs_that_share_kmers_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(21)
    texts = sorted({"".join(rng.choice("AC?é") for _ in range(rng.choice([9, 10, 12, 13]))) for _ in range(150)})
    own = [(f"g{rng.randrange(2)}", rng.choice(texts)) for _ in range(260)] + [(None, texts[0]), ("g0", None), ("g0", ""), ("g1", "AC?AC")]

    def keys(s):
        mers = [s[3:-2][i : i + 5] for i in range(len(s) - 9)]
        return [{m[:j] + "?" + m[j + 1 :] for j in range(5)} for m in mers]

    want = {}
    for g, a, b in {(g, a, b) for g, a in own for h, b in own if g and g == h and a and b and len(a) == len(b) and a.encode() < b.encode()}:
        every = set().union(*keys(b))
        if n := sum(bool(k & every) for k in keys(a)):
            want[g, a, b] = n
    rows = spark.createDataFrame(own, "cluster string, cdr3_aa string")
    for met, compared in ((500, 100_000), (4, 7)):  # in the second k-mers are cut into blocks
        monkeypatch.setattr(similarity, "MET", met, raising=False)
        monkeypatch.setattr(similarity, "COMPARED", compared, raising=False)
        for least in (1, 2):
            found = similarity.kmer_share_edges(rows, least, within=["cluster"])
            got = [tuple(r) for r in found.select("cluster", "a", "b", "shared").collect()]
            assert len(got) == len(set(got)) and {r[:3]: r[3] for r in got} == {k: n for k, n in want.items() if n >= least}
        assert not re.search(r"hashpartitioning\([^)]*\ba#\d+, b#\d+", found._jdf.queryExecution().executedPlan().toString())


def test_first_rows_of_a_cdr3_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MATCH_ROWS", 10, raising=False)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACDE") for _ in range(12)) for _ in range(30)]
    own = [(f"S{i % 4}", i, rng.choice(texts), f"V{i % 7}", f"J{i % 3}") for i in range(200)] + [("S0", 900, None, "V", "J")]
    known = [(0, texts[0], "V1", "J1", 3), (1, texts[1][:5] + "W" + texts[1][6:], "V2", "J2", 4), (2, "W" * 12, "V3", "J3", 5)]
    rep = spark.createDataFrame(own, "repertoire_id string, row_idx int, cdr3_aa string, v_call string, j_call string")
    truth = spark.createDataFrame(known, "gt_idx int, cdr3_aa string, v_call string, j_call string, score int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = similarity.driver_matches(rep, truth)
        assert found.rdd.getNumPartitions() == 21  # 201 rows
        got = sorted(tuple(r)[:7] + (r["score"],) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = {}
    for r, _, s, v, j in own:
        first.setdefault((r, s), (v, j))
    want = []
    for (r, s), (v, j) in first.items():
        hits = [k for k in known if s and sum(x != y for x, y in zip(s, k[1], strict=True)) <= 1]
        want += [(r, s, v, j, hits[0][1], hits[0][2], hits[0][3], hits[0][4])] if hits else []
    assert got == sorted(want) and want


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"S{i:02}", n, f"C{i}", f"V{n}", "J", i + n) for i in range(40) for n in range(3)], "repertoire_id string, row_idx int, cdr3_aa string, v_call string, j_call string, duplicate_count int")
    files = rows.withColumn("cdr3", F.lit(None).cast("string")).repartition(4, "repertoire_id").sortWithinPartitions("repertoire_id", "row_idx").drop("row_idx")
    files.write.partitionBy("repertoire_id").option("sep", "\t").option("header", True).option("compression", "gzip").csv(str(tmp_path / "files"))
    tracker, group = spark.sparkContext.statusTracker(), "listing"
    spark.sparkContext.setJobGroup(group, group)
    try:
        read = tables.read_repertoires(spark, str(tmp_path / "files"), pattern=r"repertoire_id=([^/]+)/", below=True)
        stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert max((x.numTasks for x in stages if x), default=0) <= 16  # forty folders
    want = sorted(tuple(r) for r in rows.select("repertoire_id", "row_idx", "cdr3_aa", "v_call", "duplicate_count").collect())
    assert sorted(tuple(r) for r in read.select("repertoire_id", "row_idx", "cdr3_aa", "v_call", "duplicate_count").collect()) == want


def test_clones_are_made_distinct_once_for_all_steps(spark):
    rng = random.Random(9)
    rep = spark.createDataFrame([(f"S{rng.randrange(8)}", f"C{rng.randrange(12)}", "V", "J") for _ in range(150)] * 2, "repertoire_id string, cdr3_aa string, v_call string, j_call string")
    y = spark.createDataFrame([(f"S{i}", i % 2) for i in range(8)], "repertoire_id string, label int")
    held = association.clones_held(rep)
    dia = rep.select(*association.CLONE).where("cdr3_aa < 'C3'").distinct().withColumn("threshold", F.lit(0.01))
    for own, plain in (
        (association.incidence(held, y, distinct=True), association.incidence(rep, y)),
        (association.subject_counts(held, dia, y, distinct=True), association.subject_counts(rep, dia, y)),
    ):
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, plain.collect())) and own.count()
        wide = r"hashpartitioning\(repertoire_id#\d+L?, cdr3_aa#\d+, v_call"
        assert re.search(wide, plain._jdf.queryExecution().executedPlan().toString()) and not re.search(wide, own._jdf.queryExecution().executedPlan().toString())


def test_narrow_l1_fit_takes_few_steps(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(28)
    share = rng.dirichlet(np.full(6, 400.0), 900)  # shares add up to 1: collinear, far from centred
    x = np.hstack([share, np.zeros((900, 1))]) / np.append(share.std(axis=0), 1.0)
    z = x - x.mean(axis=0)
    y = (rng.random(900) < 1 / (1 + np.exp(-(z[:, 0] - 0.5 * z[:, 1])))).astype(int)
    df = spark.createDataFrame([(str(i), int(y[i]), Vectors.dense(x[i])) for i in range(900)], ["repertoire_id", "label", "features"]).repartition(3)
    model = learners.l1_logistic(df, 1.0, 900, tol=1e-10, steps=25)
    w, b = model.coefficients.toArray(), model.intercept
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / 900
    assert np.all(np.abs(np.where(w == 0, 0, slope + np.sign(w) / 900)) < 1e-7) and np.all(np.abs(slope) < 1 / 900 + 1e-7) and w[6] == 0
    direct = {r["repertoire_id"]: r["score"] for r in learners.probability(model, df).collect()}
    assert np.allclose([direct[str(i)] for i in range(900)], 1 / (1 + np.exp(-(x @ w + b))))
    monkeypatch.setattr(learners, "NARROW", 0)  # Spark's steps, many
    other = learners.l1_logistic(df, 1.0, 900, tol=1e-12, steps=2000)
    u, a = other.coefficients.toArray(), other.intercept
    loss = lambda w, b: np.mean(np.logaddexp(0, x @ w + b) - y * (x @ w + b)) + np.abs(w).sum() / 900
    assert loss(w, b) < loss(u, a) + 1e-9
    assert np.allclose(1 / (1 + np.exp(-(x @ w + b))), 1 / (1 + np.exp(-(x @ u + a))), atol=2e-3)


def test_narrow_l1_fit_of_one_class_and_of_separable_rows(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    rows = [(str(i), int(i > 4), Vectors.sparse(2, [(0, float(i))])) for i in range(10)]
    df = spark.createDataFrame(rows, ["repertoire_id", "label", "features"])
    for part in (df, df.where("label = 1"), df.where("label = 0")):
        scores = []
        for narrow in (128, 0):
            monkeypatch.setattr(learners, "NARROW", narrow)
            model = learners.l1_logistic(part, 100.0, 10, tol=1e-12, steps=2000)
            scores.append([r["score"] for r in learners.probability(model, part).orderBy("repertoire_id").collect()])
        assert np.allclose(*scores, atol=1e-3)
