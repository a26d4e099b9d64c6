"""Cohorts of specimens: labels, demographics, matched controls, pooling and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import md5_order
from ..scratch import numbered
from .sampling import stratified_folds

HEALTHY = "Healthy/Background"
# Cohort adjustment of each disease.
RULES = {
    "HIV": {"mode": "filter", "ancestry": "African"},
    "Lupus": {"mode": "age_match", "bin_width": 10},
    "T1D": {"mode": "age_match", "bin_width": 10},
    "Influenza": {"mode": "age_match", "bin_width": 10},
    "Covid19": {"mode": "age_match", "bin_width": 10},
}
BASELINE_SEEDS = [7, 14, 21, 28, 35]
# Source categories -> shared ancestry vocabulary.
ANCESTRY = {"White": "Caucasian", "Black or African American": "African", "Asian": "Asian", "Native Hawaiian or other Pacific Islander": "Asian"}


def binary_task(meta: DataFrame, disease: str, controls: list[str] = [HEALTHY]) -> DataFrame:  # noqa: B006
    return meta.where(F.col("disease").isin(disease, *controls)).withColumn("label", (F.col("disease") == disease).cast("int"))


def normalize_controls(meta: DataFrame, own: str, fold: str) -> DataFrame:
    return meta.withColumn("disease", F.when(F.col("disease") == own, HEALTHY).otherwise(F.col("disease"))).withColumnRenamed(fold, "fold_id")


def harmonize_metadata(meta: DataFrame, diseases: dict[str, str]) -> DataFrame:
    """Source disease names to common ones; an unknown value stops the job; harmonized tables pass through."""
    if "participant_label" in meta.columns:
        return meta
    known = F.create_map(*(F.lit(x) for kv in diseases.items() for x in kv))
    found = F.try_element_at(known, F.col("disease"))
    return meta.withColumn("disease", F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown disease: "), F.coalesce("disease", F.lit("null"))))).otherwise(found)).withColumnRenamed("sample_name", "participant_label")


def complete_cases(meta: DataFrame, every: list[str] = (), any_of: list[str] = ()) -> DataFrame:
    full = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    for c in every:
        meta = meta.where(full(c))
    if any_of:
        meta = meta.where(F.array_contains(F.array(*map(full, any_of)), True))
    return meta


def demographic_filter(meta: DataFrame, ancestry: str | None = None, sex: str | None = None, age_min: float | None = None, age_max: float | None = None) -> DataFrame:
    """The same bounds on both classes."""
    if ancestry is not None:
        meta = meta.where(F.col("ancestry") == ancestry)
    if sex is not None:
        meta = meta.where(F.col("sex") == sex)
    if age_min is not None:
        meta = meta.where(F.col("age") >= age_min)
    return meta if age_max is None else meta.where(F.col("age") <= age_max)


def _targets(task: DataFrame, width: int) -> DataFrame:
    """(bin, n1, n0, max_n, target) of the age bins that hold both classes."""
    bins = task.where("age is not null").groupBy((F.floor(F.col("age") / width) * width).alias("bin")).agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).where("n1 > 0 and n0 > 0")
    whole = Window.partitionBy()  # a handful of age bins
    share = F.col("n1") / F.sum("n1").over(whole)
    bins = bins.withColumn("share", share).withColumn("max_n", F.floor(F.min(F.col("n0") / F.col("share")).over(whole)))
    return bins.withColumn("target", F.least(F.bround(F.col("max_n") * F.col("share")), F.col("n0")).cast("bigint"))


def age_match(task: DataFrame, width: int = 10, seed: int = 7, key: str = "participant_label") -> DataFrame:
    """All disease rows and as many healthy ones in each age bin as the disease's age histogram allows.

    Where no bin holds both classes, the cohort is returned unchanged.
    """
    targets = _targets(task, width)
    some = targets.agg(F.coalesce(F.max("max_n"), F.lit(0)).alias("usable"))
    healthy = task.where("label = 0 and age is not null").withColumn("bin", F.floor(F.col("age") / width) * width)
    ranked = healthy.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy(md5_order(seed, F.col(key)), key)))
    kept = ranked.join(F.broadcast(targets.select("bin", "target")), "bin").where("rank <= target").select(key).withColumn("__kept", F.lit(True))
    marked = task.join(kept, key, "left").join(F.broadcast(some))
    return marked.where("usable <= 0 or label = 1 or __kept").drop("__kept", "usable")


def random_controls(task: DataFrame, width: int = 10, seeds: list[int] = BASELINE_SEEDS, key: str = "participant_label") -> DataFrame:  # noqa: B006
    """Per seed: all disease rows and the age match's number of healthy ones, drawn from all of them."""
    n = _targets(task, width).agg(F.coalesce(F.max("max_n"), F.lit(0)).alias("max_n"))
    tagged = task.withColumn("random_baseline_seed", F.explode(F.array(*map(F.lit, seeds))))
    order = Window.partitionBy("random_baseline_seed", "label").orderBy(F.md5(F.concat_ws("-", F.col("random_baseline_seed").cast("string"), key)), key)
    return tagged.withColumn("rank", F.row_number().over(order)).join(F.broadcast(n)).where("label = 1 or rank <= max_n or max_n <= 0").drop("rank", "max_n")


def adjusted(meta: DataFrame, disease: str, seed: int = 7) -> DataFrame:
    """The cohort of a disease under its rule; diseases without a rule are left unchanged."""
    task, rule = binary_task(meta, disease), RULES.get(disease)
    if not rule:
        return task
    if rule["mode"] == "filter":
        return demographic_filter(task, **{k: v for k, v in rule.items() if k != "mode"})
    return age_match(task, rule["bin_width"], seed)


def pool(cohorts: dict[str, DataFrame], required: list[str] = ("participant_label", "specimen_label", "disease", "fold_id")) -> DataFrame:
    """Union of cohorts over all their columns, with ``cohort`` and ids as text; a missing column is an error."""
    out = None
    for name, df in cohorts.items():
        if lacking := set(required) - set(df.columns):
            raise ValueError(f"cohort {name} lacks {sorted(lacking)}")
        df = df.withColumns({c: F.col(c).cast("string") for c in ("participant_label", "specimen_label")}).withColumn("cohort", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def shared_columns(frames: list[DataFrame]) -> list[DataFrame]:
    """Every table cut to the columns that all have."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return [f.select(*common) for f in frames]


def id_clashes(pooled: DataFrame) -> DataFrame:
    return pooled.groupBy("participant_label").agg(F.countDistinct("cohort").alias("n_cohorts")).where("n_cohorts > 1")


def class_checks(pooled: DataFrame) -> DataFrame:
    """Both classes of every cohort: n1, n0 and whether one is missing."""
    n = pooled.groupBy("cohort").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    return n.withColumn("status", F.when((F.col("n1") == 0) & (F.col("n0") == 0), "empty").when((F.col("n1") == 0) | (F.col("n0") == 0), "one class").otherwise("ok"))


def uniqueness_violations(meta: DataFrame) -> DataFrame:
    """Participants with more than one disease or fold, and specimens that repeat."""
    people = meta.groupBy("participant_label").agg(F.countDistinct("disease").alias("d"), F.countDistinct("fold_id").alias("f"))
    long = people.select(F.col("participant_label").alias("key"), F.explode(F.map_from_arrays(F.array(F.lit("diseases"), F.lit("folds")), F.array("d", "f"))).alias("what", "n"))
    specimens = meta.groupBy(F.col("specimen_label").alias("key")).agg(F.count("*").alias("n")).select("key", F.lit("specimens").alias("what"), "n")
    return long.unionByName(specimens).where("n > 1")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of disagreement of two metadata versions."""
    l = a.select("specimen_label", F.col("disease").alias("d1"), F.col("fold_id").alias("f1"), F.lit(True).alias("in1"))  # noqa: E741
    r = b.select("specimen_label", F.col("disease").alias("d2"), F.col("fold_id").alias("f2"), F.lit(True).alias("in2"))
    j = l.join(r, "specimen_label", "full")
    both = F.col("in1") & F.col("in2")
    return j.agg(F.count_if(both & ~F.col("d1").eqNullSafe(F.col("d2"))).alias("n_disease"), F.count_if(both & ~F.col("f1").eqNullSafe(F.col("f2"))).alias("n_fold"), F.count_if(F.col("in2").isNull()).alias("n_left_only"), F.count_if(F.col("in1").isNull()).alias("n_right_only"))


def source_mismatches(supplement: DataFrame, files: DataFrame, order: str, age_tolerance: float = 2) -> DataFrame:
    """Supplement rows and files paired by their order; pairs that differ in sex, status or age."""
    s = numbered(supplement, [order], "n").select(*(F.col(c).alias(f"s_{c}") for c in ("sex", "status", "age")), (F.col("n") + 1).alias("i"))
    f = numbered(files, [order], "n").select(*(F.col(c).alias(f"f_{c}") for c in ("sex", "status", "age")), (F.col("n") + 1).alias("i"))
    j = s.join(f, "i", "full")
    differs = lambda c: ~F.col(f"s_{c}").eqNullSafe(F.col(f"f_{c}"))
    age = F.coalesce(F.abs(F.col("s_age") - F.col("f_age")) > age_tolerance, F.col("s_age").isNull() != F.col("f_age").isNull())
    return j.where(differs("sex") | differs("status") | age)


def split_by_metadata(rep: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of known specimens, the unknown specimens with their rows)."""
    known = meta.select(F.col("specimen_label").alias("repertoire_id")).distinct()
    return rep.join(known, "repertoire_id", "left_semi"), rep.groupBy("repertoire_id").agg(F.count("*").alias("n_rows")).join(known, "repertoire_id", "left_anti")


def overview(rep: DataFrame, meta: DataFrame) -> DataFrame:
    return rep.groupBy("repertoire_id").agg(F.count("*").alias("n_rows")).join(meta.withColumnRenamed("specimen_label", "repertoire_id"), "repertoire_id", "left")


def availability(meta: DataFrame, rep: DataFrame) -> DataFrame:
    have = rep.select(F.col("repertoire_id").alias("specimen_label")).distinct().withColumn("has_tcr", F.lit(True))
    return meta.join(have, "specimen_label", "left").withColumn("has_tcr", F.coalesce("has_tcr", F.lit(False)))


def zero_filled(specimens: DataFrame, counts: DataFrame, key: str, n: str) -> DataFrame:
    return specimens.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def eligibility(rep: DataFrame, least: int = 75_000) -> DataFrame:
    n = rep.groupBy("repertoire_id").agg(F.count("*").alias("n_rows"))
    return n.withColumn("eligible", F.col("n_rows") >= least)


def specimens_per_participant(meta: DataFrame) -> DataFrame:
    return meta.groupBy("participant_label").agg(F.count("*").alias("n_specimens")).groupBy("n_specimens").agg(F.count("*").alias("n_participants"))


def demographic_counts(meta: DataFrame, width: int = 5) -> DataFrame:
    """Long counts by disease: sex (every value, with zeros), ancestry, age bins from the disease's youngest."""
    sex = meta.groupBy("disease").agg(*(F.count_if(F.coalesce("sex", F.lit("Unknown")) == s).alias(s) for s in ("F", "M", "Unknown")))
    sexes = sex.select("disease", F.lit("sex").alias("what"), F.explode(F.create_map(*(x for s in ("F", "M", "Unknown") for x in (F.lit(s), F.col(s))))).alias("value", "n"))
    ancestry = meta.groupBy("disease", F.coalesce("ancestry", F.lit("Unknown")).alias("value")).agg(F.count("*").alias("n")).select("disease", F.lit("ancestry").alias("what"), "value", "n")
    aged = meta.where("age is not null").withColumn("least", F.min("age").over(Window.partitionBy("disease")))
    ages = aged.groupBy("disease", F.floor((F.col("age") - F.col("least")) / width).cast("string").alias("value")).agg(F.count("*").alias("n")).select("disease", F.lit("age_bin").alias("what"), "value", "n")
    return sexes.unionByName(ancestry).unionByName(ages)


def race_ethnicity(c: Column) -> tuple[Column, Column]:
    c = F.when(F.trim(c) != "Unknown", F.trim(c))
    return F.split_part(c, F.lit(", "), F.lit(1)), F.when(c.contains(", "), F.regexp_extract(c, r"^.*?, (.*)$", 1))


def ancestry(race: Column, ethnicity: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in ANCESTRY.items() for x in kv))
    return F.when(ethnicity == "Hispanic or Latino", "Hispanic/Latino").otherwise(F.try_element_at(known, race))


def transfer_set(train: DataFrame, score: DataFrame) -> DataFrame:
    """Cohort A is all training, cohort B all scored: no fold."""
    return train.withColumn("role", F.lit("train")).unionByName(score.withColumn("role", F.lit("test")), allowMissingColumns=True)


def transfer_folds(train: DataFrame, score: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """k-fold form: cohort A trains every fold, cohort B's folds are scored in turn by models that saw A and the others.

    One row for each fold and specimen with its role; folds whose test part has no row do not occur.
    """
    folds = stratified_folds(score, label, key, k)
    grid = folds.select("cv_fold").distinct().withColumnRenamed("cv_fold", "fold")
    own = folds.join(F.broadcast(grid)).withColumn("role", F.when(F.col("cv_fold") == F.col("fold"), "test").otherwise("train")).drop("cv_fold")  # k rows
    return train.join(F.broadcast(grid)).withColumn("role", F.lit("train")).unionByName(own, allowMissingColumns=True)


def attach_scores(meta: DataFrame, scores: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    j = meta.join(scores, key, "left")
    return j.where("model_score is not null"), j.where("model_score is null").drop("model_score")


def tag_fields(tags: Column) -> dict[str, Column]:
    """sex, status and age of a sample's tag text; what is absent or unknown is null."""
    sex = F.regexp_extract(tags, r"(?i)\b(male|female)\b", 1)
    status = F.regexp_extract(tags, r"(?i)cytomegalovirus ([+-])", 1)
    age = F.regexp_extract(tags, r"(?i)(\d+) years", 1)
    return {"sex": F.when(F.lower(sex) == "male", "M").when(F.lower(sex) == "female", "F"), "status": F.nullif(status, F.lit("")), "age": F.nullif(age, F.lit("")).cast("double")}


def cohort_lists(meta: DataFrame, diseases: list[str], seeds: list[int] = BASELINE_SEEDS, width: int = 10) -> DataFrame:  # noqa: B006
    """(disease, cohort, specimen_label): one age-matched and one random cohort a seed for every disease."""
    out = None
    for disease in diseases:
        task = binary_task(meta, disease)
        matched = age_match(task, width).select(F.lit("age_matched").alias("cohort"), "specimen_label")
        drawn = random_controls(task, width, seeds).select(F.concat(F.lit("random_"), F.col("random_baseline_seed").cast("string")).alias("cohort"), "specimen_label")
        one = matched.unionByName(drawn).select(F.lit(disease).alias("disease"), "cohort", "specimen_label")
        out = one if out is None else out.unionByName(one)
    return out


def supertypes(df: DataFrame, key: str, alleles: str, table: DataFrame, keep_unmapped: bool = False) -> DataFrame:
    """Allele lists mapped by a table (allele, supertype); unmapped ones are dropped or kept."""
    long = df.select(key, F.explode(alleles).alias("allele")).join(table, "allele", "left")
    found = F.coalesce("supertype", "allele") if keep_unmapped else F.col("supertype")
    return long.groupBy(key).agg(F.sort_array(F.collect_set(found)).alias("supertypes"))
