"""Cleaning of rearrangement tables: every step a predicate, so rows removed can be counted in step order in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genes, sequences

# Spellings of the export formats, and the standard layout.
ADAPTIVE_NAMES = {
    "aminoAcid": "amino_acid", "vGeneName": "v_gene", "jGeneName": "j_gene", "sequenceStatus": "frame_type", "nucleotide": "rearrangement", "count (templates/reads)": "templates",
}
STANDARD_COLUMNS = ["repertoire_id", "cdr3_aa", "v_call", "j_call", "sequence", "num_reads", "participant_label"]


def normalize_names(df: DataFrame, names: dict[str, str] = ADAPTIVE_NAMES) -> DataFrame:
    """Rename export spellings, each only where its target is absent."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def first_failed(steps: dict[str, Column]) -> Column:
    """Name of the first step (in order) whose keep-condition is not true; null if all hold."""
    out = F.lit(None).cast("string")
    for name, keep in reversed(steps.items()):
        out = F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def adaptive_steps(raw: DataFrame) -> DataFrame:
    """``raw`` with harmonized v_call, j_call and cdr3_aa, and ``removed_by``, the first step that drops the row.

    Steps: productive, resolved, present, standard (residues), gene_level.  The chains of gene names and ``removed_by`` are
    generated, so they run once a row: plain columns are spelled out again in every step, filter and output that mentions them.
    """
    names = F.struct(genes.v_gene(F.col("v_gene")).alias("v_call"), genes.j_gene(F.col("j_gene")).alias("j_call"), sequences.trim_cdr3(F.col("amino_acid")).alias("cdr3_aa"))
    df = raw.withColumn("__names", F.explode(F.array(names)))
    df = df.withColumns({c: F.col(f"__names.{c}") for c in ("v_call", "j_call", "cdr3_aa")}).drop("__names")
    present = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    steps = {
        "productive": F.col("frame_type") == "In" if "frame_type" in raw.columns else F.lit(True),  # older exports lack it
        "resolved": ~(genes.is_unresolved(F.col("v_gene")) | genes.is_unresolved(F.col("j_gene")) | genes.is_unresolved(F.col("amino_acid"))),
        "present": present(F.col("cdr3_aa")) & present(F.col("v_call")) & present(F.col("j_call")),
        "standard": sequences.is_standard(F.upper("cdr3_aa")),
        "gene_level": genes.is_gene_level_v(F.col("v_call")) & genes.is_gene_level_j(F.col("j_call")),
    }
    return df.withColumn("removed_by", F.explode(F.array(first_failed(steps))))


def clean_adaptive(raw: DataFrame, count: str = "templates") -> DataFrame:
    kept = adaptive_steps(raw).where("removed_by is null")
    return kept.select("repertoire_id", "row_idx", "cdr3_aa", "v_call", "j_call", F.coalesce(F.col(count), F.lit(1)).alias("num_reads"))


def funnel(steps: DataFrame, names: list[str], key: str = "repertoire_id") -> DataFrame:
    """Input rows, rows removed by each step and rows kept, by key and in total (null key)."""
    return steps.rollup(key).agg(F.count("*").alias("n_input"), *(F.count_if(F.col("removed_by") == n).alias(f"n_{n}") for n in names), F.count_if(F.col("removed_by").isNull()).alias("n_kept"))


def invalid_residues(df: DataFrame, column: str) -> DataFrame:
    """Each character outside the 20 residues and the number of rows that hold it."""
    every = df.select(F.explode(F.array_distinct(sequences.letters(F.col(column)))).alias("residue"))
    return every.where(~F.col("residue").isin(*sequences.RESIDUES)).groupBy("residue").agg(F.count("*").alias("n_rows"))


def renamed_alleles(df: DataFrame, column: str = "v_segment") -> DataFrame:
    """Renames of indistinguishable V genes and alleles, with the rows of each."""
    new = genes.fix_alleles(genes.rename_indistinguishable(F.col(column)))
    return df.select(F.col(column).alias("old"), new.alias("new")).where("old <> new").groupBy("old", "new").agg(F.count("*").alias("n_rows"))


def igblast_steps(df: DataFrame) -> DataFrame:
    """The internal cleaning order on IgBLAST tables; ``removed_by`` as in adaptive_steps."""
    v = genes.fix_alleles(genes.rename_indistinguishable(F.col("v_segment")))
    df = df.withColumns({c: sequences.clean_aa(F.col(c)) for c in ("cdr3_seq_aa_q", "post_seq_aa_q") if c in df.columns}).withColumn("v_call", v)
    steps = {
        "productive": F.col("productive") == "t",
        "v_score": F.col("v_score") > 80,
        "present": F.col("cdr3_seq_aa_q").isNotNull() & F.coalesce(F.col("v_segment") != "", F.lit(False)) & F.coalesce(F.col("j_segment") != "", F.lit(False)),
        "standard": sequences.is_standard(F.col("cdr3_seq_aa_q")),
        "known_gene": ~F.col("v_call").isin(genes.DROPPED_GENES),
    }
    return df.withColumns({"removed_by": first_failed(steps), "sequence_id": F.concat_ws("|", "run_label", F.col("trimmed_read_id").cast("string"))})


def miss_totals(misses: dict[str, DataFrame], key: str = "v_call") -> DataFrame:
    """(step, key, n_rows) of several counters, such as renames and reference misses, summed over their tables."""
    out = None
    for step, df in misses.items():
        one = df.select(F.lit(step).alias("step"), F.col(key).alias("key"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("step", "key").agg(F.sum("n_rows").alias("n_rows"))


def still_missing(df: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of which each column is still null after a fill, in all or by group."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in columns]
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *counts)


def overwrite_from_reference(df: DataFrame, reference: DataFrame, columns: dict[str, str], on: str = "v_call") -> DataFrame:
    """Columns of ``df`` overwritten by the reference's where these are not null.  ``columns``: own -> reference's."""
    ref = reference.select(on, *(F.col(r).alias(f"__{o}") for o, r in columns.items()))
    return df.join(ref, on, "left").withColumns({o: F.coalesce(f"__{o}", o) for o in columns}).drop(*(f"__{o}" for o in columns))


def reference_misses(df: DataFrame, reference: DataFrame, on: str = "v_call") -> DataFrame:
    """Genes of ``df`` without a reference row, with their rows."""
    return df.groupBy(on).agg(F.count("*").alias("n_rows")).join(reference.select(on).distinct(), on, "left_anti")


def partial_misses(df: DataFrame, reference: DataFrame, columns: list[str], on: str = "v_call") -> DataFrame:
    """Genes in the reference with null columns, and their rows."""
    hit = df.groupBy(on).agg(F.count("*").alias("n_rows")).join(reference, on)
    return hit.where(" or ".join(f"{c} is null" for c in columns)).select(on, "n_rows", *(F.col(c).isNull().alias(f"no_{c}") for c in columns))


def airr_layout(df: DataFrame, renames: dict[str, str], order: list[str], empty: list[str] = (), upper_booleans: list[str] = ()) -> DataFrame:
    """Rename, add empty columns, check and order; a clash or an unexpected column is an error."""
    present = {a: b for a, b in renames.items() if a in df.columns}
    if clash := set(present.values()) & (set(df.columns) - set(present)):
        raise ValueError(f"renaming would hide columns: {sorted(clash)}")
    out = df.withColumnsRenamed(present).withColumns({c: F.lit(None).cast("string") for c in empty if c not in df.columns})
    if unexpected := set(out.columns) - set(order):
        raise ValueError(f"unexpected columns: {sorted(unexpected)}")
    return out.withColumns({c: F.when(F.col(c) == "t", "T").when(F.col(c) == "f", "F").otherwise(F.col(c)) for c in upper_booleans}).select(*[c for c in order if c in out.columns])


def nucleotide_reasons(df: DataFrame, nt: str = "cdr3_rearrangement", aa: str = "cdr3_aa") -> DataFrame:
    """``df`` with the trimmed CDR3 nucleotides and the first reason that makes them unusable (null: usable)."""
    trimmed = F.when(F.length(nt) > 6, F.col(nt).substr(F.lit(4), F.length(nt) - 6))
    steps = {
        "missing": trimmed.isNotNull(), "letters": trimmed.rlike("^[ACGT]+$"), "length": F.length(trimmed) == 3 * F.length(aa), "translation": sequences.translate_nt(trimmed) == F.col(aa),
    }
    return df.withColumns({"cdr3": trimmed, "nt_reason": first_failed(steps)})


def count_filter(df: DataFrame, column: str = "duplicate_count", null_is_one: bool = True) -> DataFrame:
    n = F.col(column).try_cast("double")
    n = F.coalesce(n, F.lit(1.0)) if null_is_one else n
    return df.withColumn(column, n).where(F.col(column) >= 1)


def length_filter(df: DataFrame, column: str = "cdr3_aa", least: int = 0, most: int = 1 << 30) -> DataFrame:
    return df.where(F.length(column).between(least, most))


def audit(df: DataFrame) -> DataFrame:
    """One row of violations: nulls in required columns, alleles, nucleotide and amino acid consistency."""
    return df.agg(
        F.count("*").alias("n_rows"),
        *(F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias(f"no_{c}") for c in ("cdr3_aa", "v_call", "j_call")),
        F.count_if(~F.col("v_call").rlike(r"^TRBV[0-9A-Z/-]+\*\d\d$")).alias("bad_v_allele"),
        F.count_if(~F.col("j_call").rlike(r"^TRBJ[0-9-]+\*\d\d$")).alias("bad_j_allele"),
    )


def audit_groups(df: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Specimens and rows by metadata columns such as fold and disease; ``keys`` of specimens without metadata are null."""
    n = df.groupBy("repertoire_id").agg(F.count("*").alias("n"))
    own = n.join(meta.select(F.col("specimen_label").alias("repertoire_id"), *keys), "repertoire_id", "left")
    return own.groupBy(*keys).agg(F.count("*").alias("n_specimens"), F.sum("n").alias("n_rows"))


def fill_reads(df: DataFrame, name: str = "num_reads", sources: tuple[str, ...] = ("templates", "seq_reads")) -> DataFrame:
    """Read counts from the first source that has one; a row without any stops the job."""
    have = [F.col(c) for c in sources if c in df.columns]
    if not have:
        raise ValueError(f"none of {list(sources)} is present")
    n = F.coalesce(*have)
    return df.withColumn(name, F.when(n.isNull(), F.raise_error(F.lit("a row has no read count")).cast("bigint")).otherwise(n))


def standard_columns(df: DataFrame, nucleotide: str = "rearrangement", participant: str | None = None) -> DataFrame:
    """sequence from the nucleotides and num_reads from the templates, with ids, in the standard layout."""
    out = df.withColumns({"sequence": F.col(nucleotide) if nucleotide in df.columns else F.lit(None).cast("string"), "participant_label": F.lit(participant) if participant else F.col("repertoire_id")})
    return fill_reads(out, "num_reads", ("num_reads", "templates", "seq_reads")).select(*STANDARD_COLUMNS)


def in_alphabet(c: Column, residues: str = sequences.RESIDUES, case_sensitive: bool = False) -> Column:
    """Whether the trimmed text holds letters of the alphabet alone."""
    return F.coalesce(F.trim(c if case_sensitive else F.upper(c)).rlike(f"^[{residues}]+$"), F.lit(False))
