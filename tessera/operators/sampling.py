"""Reproducible sampling, splits and depth subsets: random orders are md5 orders of (seed, keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import md5_order
from ..scratch import numbered

REP = "repertoire_id"


def nested_depths(df: DataFrame, depths: list[int], replicates: int = 5, seed: int = 7) -> DataFrame:
    """Rows with (replicate, depth): depth D holds the first D rows of the replicate's order, so depths nest."""
    tagged = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    order = Window.partitionBy(REP, "replicate").orderBy(md5_order(seed, F.col("replicate"), F.col(REP), F.col("row_idx")), "row_idx")
    ranked = tagged.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < max(depths))
    return ranked.withColumn("depth", F.explode(F.filter(F.array(*map(F.lit, sorted(depths))), lambda d: d > F.col("pos"))))


def depth_subset(df: DataFrame, indices: DataFrame, depth: int, replicate: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows named by published indices (repertoire_id, replicate, pos, row_idx) up to a depth; stale columns dropped."""
    chosen = indices.where((F.col("replicate") == replicate) & (F.col("pos") < depth)).select(REP, "row_idx")
    return df.join(chosen, [REP, "row_idx"]).drop(*drop)


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 7) -> DataFrame:
    """n rows (or a rounded fraction) of each repertoire without replacement."""
    w = Window.partitionBy(REP)
    ranked = df.withColumns({"__rank": F.row_number().over(w.orderBy(md5_order(seed, F.col(REP), F.col("row_idx")), "row_idx")), "__n": F.count("*").over(w)})
    most = F.lit(n) if n is not None else F.bround(F.col("__n") * fraction)
    return ranked.where(F.col("__rank") <= most).drop("__rank", "__n")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1] from the md5 of (seed, keys)."""
    return (F.conv(F.substring(md5_order(seed, *keys), 1, 8), 16, 10).cast("double") + 1) / 4294967296.0


def weighted_sample(df: DataFrame, n: int, weight: str, seed: int = 7) -> DataFrame:
    """n rows of each repertoire without replacement, with probability by weight (exponential keys)."""
    key = -F.ln(uniform(seed, F.col(REP), F.col("row_idx"))) / F.col(weight)
    ranked = df.where(F.col(weight) > 0).withColumn("__rank", F.row_number().over(Window.partitionBy(REP).orderBy(key, "row_idx")))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def sample_with_replacement(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Distinct rows of n draws with replacement from each repertoire."""
    sizes = df.groupBy(REP).agg(F.count("*").alias("size"))
    draws = sizes.select(REP, "size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    picked = draws.select(REP, F.least(F.floor(uniform(seed, F.col(REP), F.col("draw")) * F.col("size")), F.col("size") - 1).cast("int").alias("__i")).distinct()
    numbered = df.withColumn("__i", (F.row_number().over(Window.partitionBy(REP).orderBy("row_idx")) - 1).cast("int"))
    return numbered.join(picked, [REP, "__i"], "left_semi").drop("__i")


def head_per_class(df: DataFrame, n: int, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__rank") <= n).drop("__rank")


def alternating_folds(df: DataFrame, label: str, key: str, seed: int = 7) -> DataFrame:
    """Fold 0 or 1, alternating in random order within each class; unknown classes even the folds out."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy(md5_order(seed, F.col(key)), key)) - 1)
    lead = df.where(F.col(label).isNotNull()).groupBy(label).agg((F.count("*") % 2).alias("odd")).agg(F.coalesce(F.sum("odd"), F.lit(0)).alias("lead"))
    j = ranked.join(F.broadcast(lead))
    r, lead = F.col("__r"), F.col("lead")
    unknown = F.when(r < lead, F.lit(1)).otherwise((r - lead) % 2)  # the first ones fill fold 1, which is ``lead`` behind
    return j.withColumn("fold", F.when(F.col(label).isNull(), unknown).otherwise(r % 2).cast("int")).drop("__r", "lead")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.9, seed: int = 7) -> DataFrame:
    """``role`` train for the first rounded share of each class in random order, else validation."""
    w = Window.partitionBy(label)
    rank = F.row_number().over(w.orderBy(md5_order(seed, F.col(key)), key))
    return df.withColumn("role", F.when(rank <= F.bround(F.count("*").over(w) * share), "train").otherwise("validation"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 7) -> DataFrame:
    order = Window.partitionBy(label).orderBy(md5_order(seed, F.col(key)), key)
    return df.withColumn("cv_fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def outer_folds(df: DataFrame, fold: str, folds: list[int]) -> DataFrame:
    """Every row once for each outer fold, with its role there: one job covers all folds."""
    return df.withColumn("outer_fold", F.explode(F.array(*map(F.lit, folds)))).withColumn("role", F.when(F.col(fold) == F.col("outer_fold"), "test").otherwise("development"))


def three_way_split(df: DataFrame, label: str, key: str, test_share: float = 0.25, seed: int = 7) -> DataFrame:
    """Per class: the first 1 - t train, then validation and test by halves."""
    w = Window.partitionBy(label)
    rank, n = F.row_number().over(w.orderBy(md5_order(seed, F.col(key)), key)), F.count("*").over(w)
    held = F.floor(n * test_share)
    return df.withColumn("role", F.when(rank <= n - held, "train").when(rank <= n - held + F.ceil(held / 2), "validation").otherwise("test"))


def leave_out(df: DataFrame, label: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows held out, spread evenly over the classes."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(md5_order(seed, F.col(key)), key))
    turns = numbered(df.withColumn("__r", rank), ["__r", label], "__turn")
    return turns.withColumn("role", F.when(F.col("__turn") < n, "test").otherwise("train")).drop("__r", "__turn")


def only_allowed(meta: DataFrame, indices: DataFrame, key: str = "specimen_label") -> DataFrame:
    """Metadata of the specimens that a depth table names."""
    return meta.join(indices.select(F.col(REP).alias(key)).distinct(), key, "left_semi")
