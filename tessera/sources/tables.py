"""Readers and writers of repertoire data.  Schemas are declared; ids are always text."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import numbered

REPERTOIRE = T.StructType([T.StructField(c, T.StringType()) for c in ("cdr3_aa", "v_call", "j_call")] + [T.StructField("duplicate_count", T.LongType()), T.StructField("cdr3", T.StringType())])
METADATA = T.StructType([T.StructField(c, T.StringType()) for c in ("participant_label", "specimen_label", "disease", "study_name", "disease_subtype", "sex", "ancestry")] + [T.StructField("age", T.DoubleType()), T.StructField("fold_id", T.IntegerType())])
DEPTHS = "depths array<int>, n_reps int, min_sequences int, seed int, repertoires map<string,map<string,array<int>>>"


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextlib.contextmanager
def few_listing_tasks(spark: SparkSession):
    """Many folders are listed by four tasks a core inside, not by one task for each of up to 10,000."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def read_repertoires(spark: SparkSession, paths, schema: T.StructType = REPERTOIRE, pattern: str = r"([^/_]+)\.tsv(?:\.gz|\.bz2)?$", columns: list[str] | None = None, quarantine: str = "_corrupt", below: bool = False) -> DataFrame:
    """TSV files (plain, gz, bz2) to rows with repertoire_id from the file name and row_idx, the row's place in its file.

    Columns are matched by header name.  Lines that do not fit the schema keep their text in ``quarantine``.  With ``below`` the
    paths are folders and all files below them are read; tasks list them, where a pattern with stars is resolved by the driver.
    """
    full = T.StructType([*schema.fields, T.StructField(quarantine, T.StringType())])
    df = spark.read.schema(full).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", quarantine).option("enforceSchema", True)
    with few_listing_tasks(spark):
        df = df.option("recursiveFileLookup", below).csv(paths)
    at = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block")).withColumn("__order", F.monotonically_increasing_id())
    order = Window.partitionBy("__path").orderBy("__block", "__order")
    out = at.withColumns({"repertoire_id": F.regexp_extract("__path", pattern, 1), "row_idx": (F.row_number().over(order) - 1).cast("int")})
    out = out.drop("__path", "__block", "__order")
    return out if columns is None else out.select("repertoire_id", "row_idx", *columns)


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """The header names of a TSV file: which of two spellings it uses."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).columns


def read_cohorts(spark: SparkSession, registry: list[dict]) -> DataFrame:
    """Union of metadata tables named by registry rows (cohort, metadata, template, fold, control): canonical fold and
    control label, and each specimen's file path."""
    out = None
    for r in registry:
        df = spark.read.option("sep", "\t").option("header", True).csv(r["metadata"])
        df = df.withColumnRenamed(r["fold"], "fold_id").withColumn("disease", F.when(F.col("disease") == r["control"], "Healthy/Background").otherwise(F.col("disease")))
        df = df.withColumns({"cohort": F.lit(r["cohort"]), "path": F.format_string(r["template"], "specimen_label")})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_depth_indices(spark: SparkSession, path: str) -> DataFrame:
    """(repertoire_id, replicate, pos, row_idx) of a depth-index file (JSON, also gz)."""
    df = spark.read.schema(DEPTHS).option("multiLine", True).json(path)
    reps = df.select(F.explode("repertoires").alias("repertoire_id", "m")).select("repertoire_id", F.explode("m").alias("r", "idx"))
    return reps.select("repertoire_id", F.col("r").cast("int").alias("replicate"), F.posexplode("idx").alias("pos", "row_idx"))


def read_v_reference(spark: SparkSession, path: str) -> DataFrame:
    """A V-gene table (TSV with v_call); of a repeated gene the first row in the file counts."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path).where("v_call is not null")
    at = F.struct(F.input_file_name(), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rest = [c for c in df.columns if c != "v_call"]
    first = df.select("v_call", *rest, at.alias("__at")).groupBy("v_call").agg(F.min_by(F.struct(*rest), "__at").alias("r"))
    return first.select("v_call", "r.*")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq); of a repeated name the longest sequence, then the first by text."""
    rows = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    name = F.element_at(F.split(F.split_part("value", F.lit("\n"), F.lit(1)), r"[|\s]"), 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")
    return rows.select(F.trim(name).alias("name"), seq.alias("seq")).groupBy("name").agg(F.min_by("seq", F.struct(-F.length("seq"), F.col("seq"))).alias("seq"))


def read_driver_truth(spark: SparkSession, path: str, names: dict[str, str], sep: str = ",") -> DataFrame:
    """A ground-truth table projected to (gt_idx, cdr3_aa, v_call, j_call, score); ``names``: own -> common."""
    df = spark.read.option("header", True).option("sep", sep).csv(path).withColumnsRenamed(names)
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("v_call", "j_call", "score") if c not in df.columns})
    own = df.select("cdr3_aa", "v_call", "j_call", F.col("score").cast("int").alias("score"), F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    return numbered(own, ["__f", "__b", "__i"], "gt_idx").select("gt_idx", "cdr3_aa", "v_call", "j_call", "score")


def read_labelled(spark: SparkSession, path: str, schema: T.StructType = REPERTOIRE) -> DataFrame:
    """Files under class folders: ``label`` is the parent folder's name."""
    with few_listing_tasks(spark):
        df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("recursiveFileLookup", True).csv(path)
    return df.withColumn("label", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def write_by(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet") -> None:
    """One folder for each key; rows are gathered by key first, so a key has few files (csv: gzip TSV with a header).

    Partitions are rebalanced by size: a key of many rows is written by several tasks, keys of few rows share one.
    """
    out = df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys)
    out.parquet(path) if fmt == "parquet" else out.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_by_participant(df: DataFrame, meta: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder for each participant: its specimens' rows stacked, with participant and specimen as columns."""
    who = meta.select(F.col("specimen_label").alias("repertoire_id"), "participant_label")
    write_by(df.drop("participant_label").join(who, "repertoire_id").withColumn("specimen_label", F.col("repertoire_id")), path, ["participant_label"], fmt)


def compact(df: DataFrame, columns: list[str]) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {lacking}")
    return df.select(*columns)


def output_problems(written: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Expected keys without rows, and written keys that were not expected."""
    have = written.groupBy(key).agg(F.count("*").alias("n_rows"))
    missing = expected.select(key).distinct().join(have, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(have.select(key).join(expected.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("unexpected")))


def cohort_problems(meta: DataFrame, rep: DataFrame, required: list[str]) -> DataFrame:
    """Metadata rows without a repertoire; a missing column is an error."""
    compact(meta, required)
    return meta.select("specimen_label").join(rep.select(F.col("repertoire_id").alias("specimen_label")).distinct(), "specimen_label", "left_anti")


def report(df: DataFrame, key: str, counters: str, name: str) -> DataFrame:
    """Counters of each key as one JSON cell."""
    cell = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(counters), F.col(name))))))
    return df.groupBy(key).agg(cell.alias("report"))


def metrics_by_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Prediction files as one table with their file's name."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
