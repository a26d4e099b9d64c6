"""Exact evaluation metrics of predictions, by any grouping columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_score(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Counts by group and score: afterwards a group has as many rows as distinct scores."""
    return df.groupBy(*by, F.col(score).alias("__s")).agg(F.count("*").alias("__c"), F.sum(label).alias("__p"))


def auroc(df: DataFrame, by: list[str], score: str = "model_score", label: str = "disease_label") -> DataFrame:
    """Area under the ROC curve with ties counted half; null where a class is missing."""
    w = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    r = _by_score(df, by, score, label).withColumn("__rank", F.coalesce(F.sum("__c").over(w), F.lit(0)) + (F.col("__c") + 1) / 2)
    s = r.groupBy(*by).agg(F.sum(F.col("__p") * F.col("__rank")).alias("R"), F.sum("__p").alias("n1"), F.sum(F.col("__c") - F.col("__p")).alias("n0"))
    return s.select(*by, F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("R") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], score: str = "model_score", label: str = "disease_label") -> DataFrame:
    """Sum of recall steps times precision, over distinct scores from the highest; null without positives."""
    w = Window.partitionBy(*by).orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("__p").over(Window.partitionBy(*by))
    r = _by_score(df, by, score, label).select(*by, F.col("__p"), (F.sum("__p").over(w) / F.sum("__c").over(w)).alias("precision"), total.alias("positives"))
    return r.groupBy(*by).agg(F.when(F.max("positives") > 0, F.sum(F.col("__p") * F.col("precision")) / F.max("positives")).alias("average_precision"))


def confusion(df: DataFrame, by: list[str], score: str = "model_score", label: str = "disease_label", cut: float = 0.5) -> DataFrame:
    """F1 (0 when undefined), balanced accuracy, recall, precision at score >= ``cut``."""
    hit, pos = F.col(score) >= cut, F.col(label) == 1
    c = df.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b)
    tpr, tnr = share(F.col("tp"), F.col("tp") + F.col("fn")), share(F.col("tn"), F.col("tn") + F.col("fp"))
    f1 = F.coalesce(share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    balanced = F.when(tpr.isNotNull() & tnr.isNotNull(), (tpr + tnr) / 2).otherwise(F.coalesce(tpr, tnr))
    return c.select(*by, f1.alias("f1"), balanced.alias("balanced_accuracy"), F.coalesce(tpr, F.lit(0.0)).alias("recall"), F.coalesce(share(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"))


def all_metrics(df: DataFrame, by: list[str], **names) -> DataFrame:
    return auroc(df, by, **names).join(average_precision(df, by, **names), by).join(confusion(df, by, **names), by)


def fold_summary(df: DataFrame, by: list[str], fold: str = "fold") -> DataFrame:
    """Mean and population standard deviation over folds, and the metric of all folds together."""
    per = all_metrics(df, [*by, fold])
    names = ["auroc", "average_precision", "f1", "balanced_accuracy"]
    means = per.groupBy(*by).agg(*(F.avg(n).alias(f"{n}_mean") for n in names), *(F.stddev_pop(n).alias(f"{n}_std") for n in names))
    whole = all_metrics(df, by).select(*by, *(F.col(n).alias(f"{n}_overall") for n in names))
    return means.join(whole, by)


def one_vs_rest(df: DataFrame, label: str, scores: str) -> DataFrame:
    """Metrics of every class against the rest; ``scores``: map class -> score."""
    long = df.select(F.col(label).alias("__own"), F.explode(scores).alias("class", "model_score")).withColumn("disease_label", (F.col("__own") == F.col("class")).cast("int"))
    return all_metrics(long, ["class"])


def ranked_hits(scored: DataFrame, drivers: DataFrame, ks: list[int], score: str = "score", descending: bool = True) -> DataFrame:
    """Recall and precision at every k in one pass, for repertoires that have listed drivers.

    ``scored``: one row for each (repertoire_id, cdr3_aa); ``drivers``: (repertoire_id, cdr3_aa).  Ties go by cdr3_aa.
    """
    order = F.desc(score) if descending else F.asc(score)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("repertoire_id").orderBy(order, "cdr3_aa")))
    listed = drivers.select("repertoire_id", "cdr3_aa").distinct()
    n_list = listed.groupBy("repertoire_id").agg(F.count("*").alias("n_drivers"))
    hits = ranked.join(listed, ["repertoire_id", "cdr3_aa"]).groupBy("repertoire_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks))
    size = scored.groupBy("repertoire_id").agg(F.count("*").alias("n"))
    wide = n_list.join(size, "repertoire_id").join(hits, "repertoire_id", "left")
    one = lambda k: F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("hits"))
    long = wide.select("repertoire_id", "n_drivers", "n", F.explode(F.array(*map(one, ks))).alias("x")).select("repertoire_id", "n_drivers", "n", "x.*")
    return long.withColumns({"recall": F.col("hits") / F.col("n_drivers"), "precision": F.col("hits") / F.col("k")})


def hit_summary(hits: DataFrame) -> DataFrame:
    """Macro (mean of repertoires) and micro (pooled) recall and precision at each k."""
    return hits.groupBy("k").agg(F.avg("recall").alias("macro_recall"), F.avg("precision").alias("macro_precision"), (F.sum("hits") / F.sum("n_drivers")).alias("micro_recall"), (F.sum("hits") / (F.count("*") * F.col("k"))).alias("micro_precision"))


def chance_recall(hits: DataFrame) -> DataFrame:
    """Expected recall of a random ranking: min(k, N) / N."""
    return hits.groupBy("k").agg(F.avg(F.least(F.col("k") / F.col("n"), F.lit(1.0))).alias("chance_recall"))


def simulated_chance_recall(hits: DataFrame, trials: int = 10_000, seed: int = 7) -> DataFrame:
    """(k, chance_recall, standard_error, closed_form): recall at k of random rankings, ``trials`` for each repertoire.

    ``hits``: (repertoire_id, k, n: sequences, n_drivers: listed, n_present: listed ones that occur).  The number of present
    drivers among k of n is hypergeometric: its distribution is written out once for each row, and uniform numbers are looked
    up in it.  The list's size divides; repertoires without sequences or list count for nothing.
    """
    import numpy as np
    import pandas as pd

    def draw(batches):
        for b in batches:
            mean, error = [], []
            for r, k, n, d, m in zip(b["repertoire_id"], b["k"], b["n"], b["n_drivers"], b["n_present"], strict=True):
                chance = hypergeometric(int(n), int(m), min(int(k), int(n)))
                low = max(0, min(int(k), int(n)) - int(n - m))
                uniform = np.random.default_rng([seed, int(k), *map(ord, str(r))]).random(trials)
                drawn = (low + np.minimum(np.searchsorted(np.cumsum(chance), uniform, "right"), len(chance) - 1)) / d
                mean.append(drawn.mean())
                error.append(drawn.var(ddof=1) / trials if trials > 1 else 0.0)
            yield pd.DataFrame({"k": b["k"], "recall": mean, "variance": error, "expected": np.minimum(b["k"], b["n"]) / b["n"] * b["n_present"] / b["n_drivers"]})

    rows = hits.where("n > 0 and n_drivers > 0").select(F.col("repertoire_id").cast("string").alias("repertoire_id"), "k", "n", "n_drivers", "n_present")
    by = rows.mapInPandas(draw, "k int, recall double, variance double, expected double").groupBy("k")
    return by.agg(F.avg("recall").alias("chance_recall"), (F.sqrt(F.sum("variance")) / F.count("*")).alias("standard_error"), F.avg("expected").alias("closed_form"))


def hypergeometric(n: int, good: int, k: int):
    """Chances of max(0, k - n + good) .. min(good, k) good ones among k of n, by the ratio of neighbouring terms."""
    import numpy as np

    low, high = max(0, k - n + good), min(good, k)
    x = np.arange(low, high)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - x) * (k - x)) - np.log((x + 1.0) * (n - good - k + x + 1.0)))])
    out = np.exp(logs - logs.max())
    return out / out.sum()


def depth_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and standard error by group; the error of a single value is 0."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count("*")), F.lit(0.0)).alias("standard_error"))


def standard_scores(df: DataFrame, probability: str) -> DataFrame:
    """Shared prediction columns; abstentions (null scores) are dropped."""
    return df.withColumnRenamed(probability, "model_score").where("model_score is not null").select("participant_label", "specimen_label", "disease_label", "model_score", "fold")
