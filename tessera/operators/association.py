"""Public clones and their association with a label: incidence, Fisher tests, beta-binomial model, rank tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import BROADCAST_ROWS, Scratch, numbered

CLONE = ["cdr3_aa", "v_call", "j_call"]
THRESHOLDS = [1e-2, 1e-3, 1e-4, 1e-5, 1e-6]


def log_gamma(x: Column) -> Column:
    return F.java_method(F.lit("org.apache.commons.math3.special.Gamma"), F.lit("logGamma"), x.cast("double")).cast("double")


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def clones_held(rep: DataFrame) -> DataFrame:
    """Each subject's distinct clones, written once: for several of the functions below, which take them with ``distinct``."""
    return Scratch(rep.sparkSession).write(rep.select("repertoire_id", *CLONE).distinct())


def incidence(rep: DataFrame, labels: DataFrame, least: int = 2, distinct: bool = False) -> DataFrame:
    """Per clone the positive and negative subjects that hold it; ``labels``: (repertoire_id, label 0/1).

    Rows are made distinct by subject first, so a clone's row count is bounded by the subjects; with ``distinct`` they are.
    """
    held = rep.select("repertoire_id", *CLONE)
    held = (held if distinct else held.distinct()).join(labels, "repertoire_id")
    return held.groupBy(*CLONE).agg(F.sum("label").alias("n_pos"), F.sum(1 - F.col("label")).alias("n_neg")).where(F.col("n_pos") + F.col("n_neg") >= least)


def _upper_tails(P: int, N: int):
    """(n_pos, n_neg) -> chance of n_pos or more positives among n_pos + n_neg of P + N subjects."""

    def run(batches):
        facts = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, P + N + 1)))])
        choose = lambda n, k: facts[n] - facts[k] - facts[n - k]
        for b in batches:
            p = []
            for x, y in zip(b["n_pos"].astype(int), b["n_neg"].astype(int), strict=True):
                k = x + y
                a = np.arange(x, min(k, P) + 1)
                p.append(min(1.0, float(np.exp(choose(P, a) + choose(N, k - a) - choose(P + N, k)).sum())))
            yield pd.DataFrame({"n_pos": b["n_pos"], "n_neg": b["n_neg"], "p_value": p})

    return run


def fisher_greater(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """One-sided Fisher p-value of every clone.  p depends on (n_pos, n_neg) alone, so it is found once for each such pair."""
    totals = labels.agg(F.sum("label").alias("P"), F.sum(1 - F.col("label")).alias("N")).first()
    P, N = int(totals[0] or 0), int(totals[1] or 0)
    pairs = counts.select("n_pos", "n_neg").distinct()
    p = Scratch(counts.sparkSession).write(pairs.mapInPandas(_upper_tails(P, N), "n_pos bigint, n_neg bigint, p_value double"))
    return counts.join(F.broadcast(p) if p.count() <= BROADCAST_ROWS else p, ["n_pos", "n_neg"])


def diagnostic_sets(clones: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Clones with p strictly under each threshold; all thresholds in one job."""
    return clones.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("p_value < threshold")


def subject_counts(rep: DataFrame, diagnostic: DataFrame, subjects: DataFrame, distinct: bool = False) -> DataFrame:
    """n (distinct clones) and k (those in the diagnostic set) of every subject and threshold."""
    held = rep.select("repertoire_id", *CLONE)
    held = held if distinct else held.distinct()
    n = held.groupBy("repertoire_id").agg(F.count("*").alias("n"))
    k = held.join(diagnostic.select(*CLONE, "threshold"), CLONE).groupBy("repertoire_id", "threshold").agg(F.count("*").alias("k"))
    grid = subjects.select("repertoire_id").join(F.broadcast(diagnostic.select("threshold").distinct()))
    return grid.join(n, "repertoire_id", "left").join(k, ["repertoire_id", "threshold"], "left").select("repertoire_id", "threshold", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))


def presence(rep: DataFrame, diagnostic: DataFrame) -> DataFrame:
    """Long 0/1 presence of diagnostic clones: the pairs that are 1."""
    return rep.select("repertoire_id", *CLONE).distinct().join(diagnostic.select(*CLONE), CLONE)


def beta_binomial_nll(counts: DataFrame, a: float, b: float, by: list[str]) -> DataFrame:
    """sum(lnB(k + a, n - k + b)) - m lnB(a, b), the log likelihood up to a constant, by group."""
    const = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    each = log_beta(F.col("k") + a, F.col("n") - F.col("k") + b)
    return counts.withColumn("__each", each).groupBy(*by).agg((F.sum("__each") - F.count("*") * const).alias("log_likelihood"))


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _fit_pair(k: np.ndarray, n: np.ndarray, start=(1.0, 1000.0), least: float = 1e-5) -> tuple[float, float]:
    """Maximum likelihood (a, b): Newton steps on (log a/b, log(a + b)), where share and spread hardly interact."""
    pairs, m = np.unique(np.stack([k, n], axis=1), axis=0, return_counts=True)
    k, n = pairs[:, 0], pairs[:, 1]

    def ab(t):
        total = np.exp(np.clip(t[1], -20, 30))
        share = 1 / (1 + np.exp(-np.clip(t[0], -40, 40)))
        return max(total * share, least), max(total * (1 - share), least)

    def value(t):
        a, b = ab(t)
        return float(m @ (_lgamma(k + a) + _lgamma(n - k + b) - _lgamma(n + a + b))) - float(m.sum()) * (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))

    t, h, e = np.array([math.log(start[0] / start[1]), math.log(start[0] + start[1])]), 1e-3, np.eye(2) * 1e-3
    best = value(t)
    for _ in range(200):
        g = np.array([(value(t + e[i]) - value(t - e[i])) / (2 * h) for i in range(2)])
        H = np.array([[(value(t + e[i] + e[j]) - value(t + e[i] - e[j]) - value(t - e[i] + e[j]) + value(t - e[i] - e[j])) / (4 * h * h) for j in range(2)] for i in range(2)])
        w, v = np.linalg.eigh((H + H.T) / 2)
        step = np.clip(v @ ((v.T @ g) / np.maximum(np.abs(w), 1e-3)), -2, 2)  # uphill whatever the curvature's sign
        scale = 1.0
        while scale > 1e-8 and not (new := value(t + scale * step)) > best:
            scale /= 2
        if scale <= 1e-8:
            break
        gain, t, best = new - best, t + scale * step, new
        if gain < 1e-10:
            break
    a, b = ab(t)
    return float(a), float(b)


def fit_beta_binomial(counts: DataFrame, by: list[str]) -> DataFrame:
    """(a, b) of each group of (n, k) rows; a group is one class of subjects, so it is small."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema.fields if f.name in by)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        a, b = _fit_pair(group["k"].to_numpy(float), group["n"].to_numpy(float))
        return pd.DataFrame([{**{c: group[c].iloc[0] for c in by}, "a": a, "b": b, "m": len(group)}])

    return counts.select(*by, "n", "k").groupBy(*by).applyInPandas(one, f"{kinds}, a double, b double, m bigint")


def beta_binomial_moments(counts: DataFrame, by: list[str]) -> DataFrame:
    """(a, b, m) of each group of (n, k) rows by moments, in one aggregation: a / (a + b) is the share of all k among all n, and
    a + b follows from how far the shares' variance is above the binomial one (within 10 and a million)."""
    share, extra = F.col("p"), F.greatest(F.col("v") - F.col("p") * (1 - F.col("p")) / F.col("n"), F.lit(0.0))
    spread = F.when(extra > 0, share * (1 - share) / extra - 1).otherwise(F.lit(1e6))
    spread = F.greatest(F.least(spread, F.lit(1e6)), F.lit(10.0))
    own = counts.where("n > 0").groupBy(*by).agg(F.count("*").alias("m"), (F.sum("k") / F.sum("n")).alias("p"), F.avg("n").alias("n"), F.var_pop(F.col("k") / F.col("n")).alias("v"))
    least = F.greatest(share, F.lit(1e-6))
    return own.select(*by, (least * spread).alias("a"), ((1 - least) * spread).alias("b"), "m")


def posterior(counts: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """P(positive | n, k) from the two classes' parameters (label 1 and 0) and the prior (m + 1) / (total + 2)."""
    wide = params.groupBy(*by).agg(*(F.max(F.when(F.col("label") == c, F.col(x))).alias(f"{x}{c}") for c in (0, 1) for x in ("a", "b", "m"))) if by else params.agg(*(F.max(F.when(F.col("label") == c, F.col(x))).alias(f"{x}{c}") for c in (0, 1) for x in ("a", "b", "m")))
    j = counts.join(F.broadcast(wide), by) if by else counts.join(F.broadcast(wide))
    ll = lambda c: log_beta(F.col("k") + F.col(f"a{c}"), F.col("n") - F.col("k") + F.col(f"b{c}")) - log_beta(F.col(f"a{c}"), F.col(f"b{c}"))
    prior = F.ln(F.col("m1") + 1) - F.ln(F.col("m0") + 1)
    return j.withColumn("score", 1 / (1 + F.exp(-(prior + ll(1) - ll(0))))).drop("a0", "b0", "m0", "a1", "b1", "m1")


def tuned_posterior(counts: DataFrame, subjects: DataFrame) -> tuple[float | None, DataFrame]:
    """(threshold, scores): beta-binomial models fitted on the training rows at every threshold, the one of best AUROC on
    the validation rows (the first of equals), and its posterior of all subjects.

    ``counts``: (repertoire_id, threshold, n, k) of ``subjects`` (repertoire_id, label, role: train, validation, test).
    Where no clone passes any threshold, or none can be judged, the threshold is None and all scores are 0.5.
    """
    from . import metrics

    rows = counts.join(subjects, "repertoire_id")
    params = fit_beta_binomial(rows.where("role = 'train'"), ["threshold", "label"])
    scored = Scratch(counts.sparkSession).write(posterior(rows, params, ["threshold"]))
    by = metrics.auroc(scored.where("role = 'validation'"), ["threshold"], "score", "label")
    best = by.where("auroc is not null").orderBy(F.desc("auroc"), F.desc("threshold")).first()
    if best is None:
        return None, subjects.withColumn("score", F.lit(0.5))
    own = scored.where(F.col("threshold") == best["threshold"]).select("repertoire_id", "score")
    return best["threshold"], subjects.join(own, "repertoire_id", "left").withColumn("score", F.coalesce("score", F.lit(0.5)))


def driver_p_scores(rep: DataFrame, clones: DataFrame) -> DataFrame:
    """Least p-value of each repertoire's CDR3s (1.0 for clones that were not tested)."""
    return rep.select("repertoire_id", *CLONE).distinct().join(clones.select(*CLONE, "p_value"), CLONE, "left").groupBy("repertoire_id", "cdr3_aa").agg(F.min(F.coalesce("p_value", F.lit(1.0))).alias("p_value"))


def mann_whitney(df: DataFrame, feature: str, value: str, label: str) -> DataFrame:
    """Per feature: U of the positives, its normal approximation with tie correction (z) and two-sided p-value (1 where
    there is no spread), means of both classes.

    Ranks come from counts by distinct value and their running sums, so no partition holds more than a feature's values.
    """
    by_value = df.groupBy(feature, value).agg(F.count("*").alias("c"), F.sum(label).alias("p"))
    before = Window.partitionBy(feature).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_value.withColumn("rank", F.coalesce(F.sum("c").over(before), F.lit(0)) + (F.col("c") + 1) / 2)
    sums = ranked.groupBy(feature).agg(
        F.sum(F.col("p") * F.col("rank")).alias("R"), F.sum("p").alias("n1"), F.sum(F.col("c") - F.col("p")).alias("n0"), F.sum("c").alias("n"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"),
        (F.sum(F.col(value) * F.col("p")) / F.sum("p")).alias("mean1"), (F.sum(F.col(value) * (F.col("c") - F.col("p"))) / F.sum(F.col("c") - F.col("p"))).alias("mean0"),
    )
    u = F.col("R") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n0") / 12 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    z = F.when(var > 0, (u - F.col("n1") * F.col("n0") / 2) / F.sqrt(var)).otherwise(F.lit(0.0))
    return sums.select(feature, u.alias("u"), z.alias("z"), two_sided(z).alias("p_value"), "mean1", "mean0")


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a normal Z."""
    erfc = F.java_method(F.lit("org.apache.commons.math3.special.Erf"), F.lit("erfc"), (F.abs(z) / math.sqrt(2)).cast("double"))
    return erfc.cast("double")


def enriched(tests: DataFrame, cut: float = 0.001) -> DataFrame:
    """Features of p < ``cut``, largest difference of the means first."""
    return tests.where(F.col("p_value") < cut).withColumn("difference", F.col("mean1") - F.col("mean0")).orderBy(F.desc("difference"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks, over a table of predictions (one row for each sample)."""

    def ranks(c: str) -> DataFrame:
        placed = numbered(df.select(c).where(F.col(c).isNotNull()), [c], "n")
        return placed.groupBy(c).agg((F.avg("n") + 1).alias(f"rank_{c}"))

    return df.join(ranks(x), x).join(ranks(y), y).agg(F.corr(f"rank_{x}", f"rank_{y}").alias("spearman"))
