"""Readers, writers and streams on small files."""

import bz2
import gzip
import json

from pyspark.sql import functions as F

from tessera.sources import tables
from tessera.streaming import ingest


def test_read_repertoires(spark, tmp_path):
    lines = "cdr3_aa\tv_call\tj_call\tduplicate_count\tcdr3\n" + "".join(f"AS{i}\tTRBV1\tTRBJ1\t{i}\tACG\n" for i in range(500))
    (tmp_path / "x_S1.tsv").write_text(lines)
    (tmp_path / "x_S2.tsv.gz").write_bytes(gzip.compress(lines.encode()))
    (tmp_path / "x_S3.tsv.bz2").write_bytes(bz2.compress(lines.encode()))
    df = tables.read_repertoires(spark, str(tmp_path))
    got = df.groupBy("repertoire_id").agg(F.count("*").alias("n"), F.count_if(F.col("cdr3_aa") == F.concat(F.lit("AS"), "row_idx")).alias("ok")).collect()
    assert sorted(map(tuple, got)) == [("S1", 500, 500), ("S2", 500, 500), ("S3", 500, 500)]


def test_depth_indices_and_fasta(spark, tmp_path):
    (tmp_path / "d.json.gz").write_bytes(gzip.compress(json.dumps({"depths": [2], "n_reps": 2, "min_sequences": 1, "seed": 7, "repertoires": {"S1": {"0": [5, 3], "1": [2, 9]}}}).encode()))
    got = tables.read_depth_indices(spark, str(tmp_path / "d.json.gz")).orderBy("replicate", "pos").collect()
    assert [tuple(r) for r in got] == [("S1", 0, 0, 5), ("S1", 0, 1, 3), ("S1", 1, 0, 2), ("S1", 1, 1, 9)]
    (tmp_path / "v.fasta").write_text(">TRBV1*01 x\nACD\nEFG\n>TRBV2*01\nKL\n>TRBV1*01\nAC\n")
    assert sorted(map(tuple, tables.read_fasta(spark, str(tmp_path / "v.fasta")).collect())) == [("TRBV1*01", "ACDEFG"), ("TRBV2*01", "KL")]


def test_write_by_and_checks(spark, tmp_path):
    df = spark.createDataFrame([("P1", "S1", "A"), ("P1", "S2", "B"), ("P2", "S3", "C")], "participant_label string, repertoire_id string, cdr3_aa string")
    tables.write_by(df, str(tmp_path / "out"), ["participant_label", "repertoire_id"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    expected = spark.createDataFrame([("S1",), ("S9",)], "repertoire_id string")
    assert sorted(map(tuple, tables.output_problems(back, expected, "repertoire_id").collect())) == [("S2", "unexpected"), ("S3", "unexpected"), ("S9", "missing")]


def test_report(spark):
    df = spark.createDataFrame([("P1", "a", 2), ("P1", "b", 1)], "k string, c string, n int")
    assert json.loads(tables.report(df, "k", "c", "n").first()["report"]) == {"a": 2, "b": 1}


RAW = "repertoire_id string, row_idx int, frame_type string, amino_acid string, v_gene string, j_gene string, templates int"


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = [(f"S{i % 3}", i, "In" if i % 4 else "Out", "CASSF", "TCRBV07-02", "TCRBJ01-02", 1) for i in range(40)]
    df = spark.createDataFrame(rows, RAW)
    df.where("row_idx < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), RAW, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    df.where("row_idx >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    from tessera.operators.cleaning import clean_adaptive

    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, clean_adaptive(df).collect()))


def test_running_funnel(spark, tmp_path):
    spark.createDataFrame([("S1", i, "In" if i % 2 else "Out", "CASSF", "TCRBV07-02", "TCRBJ01-02", 1) for i in range(10)], RAW).write.parquet(str(tmp_path / "in"))
    q = ingest.running_funnel(spark.readStream.schema(RAW).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("funnel").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("funnel").collect()] == [("S1", 10, 5)]
