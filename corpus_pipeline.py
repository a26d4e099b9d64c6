"""A training-data pipeline: five of the library's operators in sequence over the table of documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as Parquet and reads again as the next
stage's documents.  All stages but the last return the columns of documents.  Two rows of one id are one document's rows:
they go or stay together where a decision names ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, near_duplicates, packing, queries, secret_scan
from tessera.scratch import Scratch, but, having, temporary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not reject."""
    return queries.toxicity_scores(spark, docs, sf_dir, docs.columns).where(~F.col("rejected")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class; equal rows of one id become one.  Rows without an id stay."""
    scratch = Scratch(spark)
    found = scratch.write(near_duplicates.near_duplicates(docs))
    gone = scratch.write(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = but(docs, gone, ["doc_id"]).select(*docs.columns)
    twice = scratch.write(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    return but(kept, twice, ["doc_id"]).unionByName(having(kept, twice, ["doc_id"]).dropDuplicates()).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = decontamination.contaminated(docs, queries.table(spark, sf_dir, "benchmark"))
    gone = Scratch(spark).write(found.select("doc_id").distinct())
    return but(docs, gone, ["doc_id"]).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars counted again."""
    return secret_scan.masked(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The stages on fitted models, edit distances and tokenizers have no SQL form; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark), queries.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with temporary():  # what the stage wrote on its way goes as soon as its result stands
            docs = scratch.write(stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = docs
    return docs
