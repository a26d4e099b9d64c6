"""Scalar functions on the edge rows."""

import math

from pyspark.sql import functions as F

from tessera.functions import genes, sequences


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("s"))).collect()]


def test_adaptive_names(spark):
    got = values(spark, genes.adaptive_to_airr, ["TCRBV07-02", "TCRBV03-01/03-02", "TRBV20/OR9-2*02", "TCRBJ02", " TCRBV12-04 ", "TRBV7-9", None, "unknown"])
    assert got == ["TRBV7-2", "TRBV3-1", "TRBV20/OR9-2*2", "TRBJ2", "TRBV12-4", "TRBV7-9", None, "unknown"]


def test_gene_chain(spark):
    assert values(spark, genes.collapse_singleton, ["TRBV13-1", "TRBV2-1", "TRBV7-9", "TRBV13", "TRBV3-1", None]) == ["TRBV13", "TRBV2", "TRBV7-9", "TRBV13", "TRBV3-1", None]
    assert values(spark, genes.harmonize_orphon, ["TRBV20-or9_2", "TRBVA-OR9-2", "TRBV7-9"]) == ["TRBV20/OR9-2", "TRBVA/OR9-2", "TRBV7-9"]
    assert values(spark, genes.v_gene, ["TCRBV20-or9_2", "TCRBV12-04*02", "TCRBV06-03", "TCRBV13-01*01", "TCRBV04"]) == ["TRBV20/OR9-2", "TRBV12-3", "TRBV6-2", "TRBV13", "TRBV4"]
    assert values(spark, genes.first_allele, ["TRBV7-2,TRBV7-3", "TRBV7-2*02", "", None]) == ["TRBV7-2*01", "TRBV7-2*02", None, None]
    assert values(spark, genes.rename_indistinguishable, ["TRBV12-4*02", "TRBV6-3*01", "TRBV6-30*01"]) == ["TRBV12-3*01", "TRBV6-2*01", "TRBV6-30*01"]
    assert values(spark, genes.fix_alleles, ["TRBV6-2*02", "TRBV6-2*01"]) == ["TRBV6-2*01", "TRBV6-2*01"]
    assert values(spark, genes.is_gene_level_v, ["TRBV7-2", "TRBV20", "TRBV28", None]) == [True, False, True, False]


def test_alleles_and_keys(spark):
    df = spark.createDataFrame([("TRBV7-2*3", None), ("TRBV7-2", "4"), (None, "x")], "r string, a string")
    allele, imputed = genes.resolved_allele(F.col("r"), F.col("a"))
    assert [tuple(r) for r in df.select(allele, imputed).collect()] == [("03", False), ("04", False), ("01", True)]
    df = spark.createDataFrame([("/x/part_table_A_S1.tsv.gz",), ("B-9_S2.tsv",)], "p string")
    who, what = genes.sample_key(F.col("p"))
    assert [tuple(r) for r in df.select(who, what).collect()] == [("part_table_A", "S1"), ("B-9", "S2")]
    assert values(spark, genes.padded_participant, ["T1D-9", "T1D-123", "x"]) == ["T1D-009", "T1D-123", "x"]


def test_residues(spark):
    assert values(spark, sequences.clean_aa, [None, "", " A S S ", "assf", "NAN", "nan"]) == [None, None, "ASS", "ASSF", None, None]
    assert values(spark, sequences.trim_cdr3, ["CASSF", "AS", "A", "", None]) == ["ASS", "AS", "A", "", None]
    assert values(spark, sequences.trim_ground_truth, ["CASSF", "ASS", "C", "FF"]) == ["ASS", "ASS", "", "F"]
    assert values(spark, sequences.is_standard, ["ASSF", "AS*F", "ASXF", "AS.F", "", None]) == [True, False, False, False, False, False]


def test_translation(spark):
    assert values(spark, sequences.translate_nt, ["ATGTTTTAA", "TGYAA", "", None]) == ["MF*", "XX", "", None]
    assert len(sequences.CODONS) == 64 and sequences.CODONS["TGG"] == "W" and sequences.CODONS["ATG"] == "M"


def test_kmers(spark):
    got = values(spark, lambda s: sequences.gapped_kmers(s, 4), ["ASSFG", "ASS"])
    assert sorted(got[0]) == sorted(["ASSF", "_SSF", "A_SF", "AS_F", "ASS_", "SSFG", "_SFG", "S_FG", "SS_G", "SSF_"]) and got[1] == []


def test_similarity(spark):
    df = spark.createDataFrame([("", ""), ("ASSF", "ASSG"), ("A", None)], "a string, b string")
    assert [r[0] for r in df.select(sequences.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.75, None]


def test_codes(spark):
    a = values(spark, sequences.atchley, ["ACDE", "ACXE"])
    assert a[0] == [*sequences.ATCHLEY["A"], *sequences.ATCHLEY["C"], *sequences.ATCHLEY["D"], *sequences.ATCHLEY["E"]] and a[1] is None
    assert values(spark, lambda s: sequences.integer_code(s, 4), ["AC", "YXAAA", None]) == [[1, 2, 0, 0], [20, 0, 1, 1], [0, 0, 0, 0]]
    code = values(spark, lambda s: sequences.phase_code(s, {"A": [1.0], "B": [10.0]}), ["ABABABA"])[0]
    want = [0.0] * 6
    for i, c in enumerate("ABABABA"):
        want[(7 - i) % 6] += 1.0 if c == "A" else 10.0
    assert code == want
    std = values(spark, lambda s: sequences.standardized_code(s, {"A": [1.0], "C": [3.0]}, 3), ["AC"])[0]
    assert std == [-1.0, 0.0, 1.0, 0.0, 0.0, 1.0]


def test_pair_scores(spark):
    scores = {"AA": 4, "CC": 9, "AC": 0}
    df = spark.createDataFrame([("AC", "CA"), ("CC", "CC"), ("A", "AC"), ("A", "AAC"), ("AX", "AA")], "a string, b string")
    assert [r[0] for r in df.select(sequences.pair_scores(F.col("a"), F.col("b"), scores)).collect()] == [0.0, 8.0, None, None, -2.0]
    assert [r[0] for r in df.select(sequences.one_gap_score(F.col("a"), F.col("b"), scores)).collect()] == [0.0, 4.0, -1.0, -1.0, -1.0]


def test_substitutions(spark):
    got = values(spark, sequences.substitutions, ["AS"])[0]
    assert len(got) == 40 and ("AA" in {r["variant"] for r in got}) and {r["pos"] for r in got} == {0, 1}
    assert values(spark, lambda s: F.round(sequences.count_scaling(F.length(s)), 6), ["AAA", ""]) == [round(math.log(3), 6), 0.0]
