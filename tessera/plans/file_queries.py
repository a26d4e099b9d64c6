"""Registered queries of readers, writers, cleaning of other layouts, and operators on neighbours, groups and folds.

Files are written to the scratch folder in the layouts that the readers expect, and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genes, sequences
from ..operators import association, boosting, cleaning, cohorts, features, learners, metrics, sampling, similarity
from ..scratch import Scratch, folder
from ..sources import tables
from ..streaming.ingest import running_funnel
from .fixtures import metadata, raw, repertoire, table
from .queries import HITS, LABELS, PRED, STEPS, TRUTH, _phase_sql, big, coded, labels, predictions, query, r6, truth


def _place(s) -> str:
    return f"{folder(s)}/files-{uuid.uuid4().hex}"


def _tsv(df: DataFrame, place: str, *sort: str) -> str:
    """TSV files with a header, rows in order within and over the files (by name): a small table is one file."""
    df.orderBy(*sort).write.option("sep", "\t").option("header", True).csv(place)
    return place


# ---- readers and writers ---------------------------------------------------------------------------------------------


@query("select repertoire_id, row_idx, cdr3_aa, v_call, cast(duplicate_count as bigint) duplicate_count from repertoire")
def repertoire_files(s, d):
    """Gzip TSV files, one for each specimen, written in row order and read with names from the path and row numbers."""
    base = _place(s)
    own = repertoire(s, d).select("repertoire_id", "row_idx", "cdr3_aa", "v_call", "j_call", "duplicate_count", F.lit(None).cast("string").alias("cdr3"))
    files = own.repartition("repertoire_id").sortWithinPartitions("repertoire_id", "row_idx").drop("row_idx")
    files.write.partitionBy("repertoire_id").option("sep", "\t").option("header", True).option("compression", "gzip").csv(base)
    return tables.read_repertoires(s, base, pattern=r"repertoire_id=([^/]+)/", columns=["cdr3_aa", "v_call", "duplicate_count"], below=True)


@query("select 'one' cohort, specimen_label, case when disease = 'Healthy/Background' then 'Healthy/Background' else disease end disease, cast(fold_id as varchar) fold_id, 'data/one/' || specimen_label || '.tsv.gz' path from metadata union all select 'two', specimen_label, disease, cast(fold_id as varchar), 'data/two/' || specimen_label || '.tsv' from metadata")
def cohort_registry(s, d):
    """Two cohorts with their own names of folds and controls, from a registry."""
    m, base = metadata(s, d), _place(s)
    _tsv(m.withColumnRenamed("fold_id", "CV_fold").withColumn("disease", F.when(F.col("disease") == "Healthy/Background", "control").otherwise(F.col("disease"))), f"{base}/one", "specimen_label")
    _tsv(m.withColumnRenamed("fold_id", "split").drop("age"), f"{base}/two", "specimen_label")
    found = tables.read_cohorts(s, [
        {"cohort": "one", "metadata": f"{base}/one", "template": "data/one/%s.tsv.gz", "fold": "CV_fold", "control": "control"},
        {"cohort": "two", "metadata": f"{base}/two", "template": "data/two/%s.tsv", "fold": "split", "control": "Healthy/Background"},
    ])
    return found.select("cohort", "specimen_label", "disease", "fold_id", "path")


DEPTH = ", o as (select repertoire_id, row_number() over (partition by repertoire_id order by md5(concat_ws('-', '9', repertoire_id, cast(row_idx as varchar)))) - 1 pos, row_idx from repertoire)"


def _depth_file(s, d, below: str | None = None) -> DataFrame:
    """A depth-index file of all repertoires, or of those below an id, read again."""
    order = F.struct(sequences.md5_order(9, F.col("repertoire_id"), F.col("row_idx")), "row_idx")
    rep = repertoire(s, d) if below is None else repertoire(s, d).where(F.col("repertoire_id") < below)
    idx = rep.groupBy("repertoire_id").agg(F.sort_array(F.collect_list(order)).alias("o"))
    own = idx.select("repertoire_id", F.map_from_arrays(F.array(F.lit("0"), F.lit("1")), F.array("o.row_idx", F.reverse("o.row_idx"))).alias("m"))
    one = own.agg(F.map_from_entries(F.collect_list(F.struct("repertoire_id", "m"))).alias("repertoires"))
    base = _place(s)
    one.select(F.array(F.lit(60)).alias("depths"), F.lit(2).alias("n_reps"), F.lit(60).alias("min_sequences"), F.lit(9).alias("seed"), "repertoires").coalesce(1).write.option("compression", "gzip").json(base)
    return tables.read_depth_indices(s, base)


@query(DEPTH + " select repertoire_id, row_idx, cdr3_aa from repertoire join o using (repertoire_id, row_idx) where pos < 60")
def depth_index_file(s, d):
    """A published depth-index file applied to a repertoire table; a column that no longer holds is dropped."""
    rep = repertoire(s, d).select("repertoire_id", "row_idx", "cdr3_aa", F.lit("old").alias("rank_in_file"))
    return sampling.depth_subset(rep, _depth_file(s, d), 60, 0, drop=("rank_in_file",))


@query(" select specimen_label, disease from metadata where specimen_label < 'S5'")
def allowed_specimens(s, d):
    return sampling.only_allowed(metadata(s, d), _depth_file(s, d, 'S5')).select("specimen_label", "disease")


@query(" select v_call, min(cdr3_aa) seq from repertoire group by 1")
def v_reference_file(s, d):
    return tables.read_v_reference(s, _tsv(repertoire(s, d).select("v_call", F.col("cdr3_aa").alias("seq")).distinct(), _place(s), "v_call", "seq"))


@query(" select v_call as name, arg_min(cdr3_aa, struct_pack(n := -length(cdr3_aa), s := cdr3_aa)) seq from repertoire group by 1")
def fasta_reference(s, d):
    base = _place(s)
    repertoire(s, d).select("v_call", "cdr3_aa").distinct().select(F.concat(F.lit(">"), "v_call", F.lit("|human\n"), F.expr("left(cdr3_aa, 5)"), F.lit("\n"), F.expr("substring(cdr3_aa, 6)"))).write.text(base)
    return tables.read_fasta(s, f"{base}/*.txt")


@query(TRUTH + " select gt_idx, cdr3_aa, v_call, j_call, score from truth")
def driver_truth_file(s, d):
    base, t = _place(s), truth(s, d)
    t.select(F.col("score").alias("Score"), F.col("cdr3_aa").alias("CDR3"), F.col("v_call").alias("V"), F.col("j_call").alias("J"), "gt_idx").coalesce(1).sortWithinPartitions("gt_idx").drop("gt_idx").write.option("header", True).csv(base)
    return tables.read_driver_truth(s, base, {"Score": "score", "CDR3": "cdr3_aa", "V": "v_call", "J": "j_call"})


@query(f", {LABELS} select 'label=' || y as label, count(*) n_rows, count(distinct cdr3_aa) n_cdr3 from repertoire join labels using (repertoire_id) group by 1")
def labelled_folders(s, d):
    base = _place(s)
    own = repertoire(s, d).join(labels(s, d), "repertoire_id").select("label", "cdr3_aa", "v_call", "j_call", "duplicate_count", F.lit(None).cast("string").alias("cdr3"))
    tables.write_by(own, base, ["label"], "csv")
    return tables.read_labelled(s, base).groupBy("label").agg(F.count("*").alias("n_rows"), F.countDistinct("cdr3_aa").alias("n_cdr3"))


@query(" select participant_label, specimen_label, count(*) n_rows, cast(sum(row_idx) as bigint) row_sum from repertoire join metadata on specimen_label = repertoire_id group by 1, 2")
def participant_folders(s, d):
    base = _place(s)
    tables.write_by_participant(repertoire(s, d), metadata(s, d), base)
    return s.read.parquet(base).groupBy("participant_label", "specimen_label").agg(F.count("*").alias("n_rows"), F.sum("row_idx").alias("row_sum"))


@query(" select specimen_label, 'missing' problem from metadata where fold_id = 1 union all select distinct repertoire_id, 'unexpected' from repertoire where repertoire_id not in (select specimen_label from metadata where disease = 'CMV' or fold_id = 1) and repertoire_id not in (select specimen_label from metadata where fold_id = 1)")
def output_problems(s, d):
    """Specimens that were not written, and those written that nobody asked for."""
    m, fold1 = metadata(s, d), metadata(s, d).where("fold_id = 1").select(F.col("specimen_label").alias("repertoire_id"))
    written = tables.compact(repertoire(s, d), ["repertoire_id", "row_idx"]).join(fold1, "repertoire_id", "left_anti").withColumnRenamed("repertoire_id", "specimen_label")
    return tables.output_problems(written, m.where("disease = 'CMV' or fold_id = 1"), "specimen_label")


@query(" select specimen_label from metadata where specimen_label not in (select repertoire_id from repertoire where length(cdr3_aa) = 16 and duplicate_count = 50)")
def cohort_problems(s, d):
    return tables.cohort_problems(metadata(s, d), repertoire(s, d).where("length(cdr3_aa) = 16 and duplicate_count = 50"), ["disease", "fold_id"])


# ---- other layouts ---------------------------------------------------------------------------------------------------

IGBLAST = """
, ig as (select repertoire_id, row_idx, case when row_idx % 17 = 0 then 'f' else 't' end productive, cast(60 + row_idx * 7 % 60 as double) v_score,
  case when row_idx % 23 = 0 then 'nan' when row_idx % 29 = 0 then ' ' || left(cdr3_aa, 3) || ' * ' else ' ' || left(cdr3_aa, 2) || ' ' || substr(cdr3_aa, 3) end cdr3_seq_aa_q,
  case when row_idx % 11 = 0 then 'TRBV12-4*02' when row_idx % 13 = 0 then 'TRBV6-3*01' when row_idx % 19 = 0 then 'TRBV6-2*02' when row_idx % 31 = 0 then 'TRBV25/OR9-2*01' when row_idx % 37 = 0 then '' else v_call end v_segment,
  case when row_idx % 41 = 0 then null else j_call end j_segment, 'run1' run_label, cast(row_idx as bigint) trimmed_read_id from repertoire),
 igs as (select *, nullif(nullif(upper(replace(cdr3_seq_aa_q, ' ', '')), 'NAN'), '') c,
  case when starts_with(v_segment, 'TRBV12-4*') then 'TRBV12-3*01' when starts_with(v_segment, 'TRBV6-3*') then 'TRBV6-2*01' when v_segment = 'TRBV6-2*02' then 'TRBV6-2*01' else v_segment end v from ig),
 igf as (select *, case when productive <> 't' then 'productive' when v_score <= 80 then 'v_score' when c is null or coalesce(v_segment, '') = '' or coalesce(j_segment, '') = '' then 'present'
  when not regexp_full_match(c, '[ACDEFGHIKLMNPQRSTVWY]+') then 'standard' when v = 'TRBV25/OR9-2*01' then 'known_gene' end removed_by from igs)
"""


def igblast(s, d) -> DataFrame:
    """The repertoire in the internal layout: spaces between residues, alleles, scores."""
    i, c = F.col("row_idx"), F.col("cdr3_aa")
    cdr3 = F.when(i % 23 == 0, "nan").when(i % 29 == 0, F.concat(F.lit(" "), F.expr("left(cdr3_aa, 3)"), F.lit(" * "))).otherwise(F.concat(F.lit(" "), F.expr("left(cdr3_aa, 2)"), F.lit(" "), c.substr(3, 100)))
    v = F.when(i % 11 == 0, "TRBV12-4*02").when(i % 13 == 0, "TRBV6-3*01").when(i % 19 == 0, "TRBV6-2*02").when(i % 31 == 0, "TRBV25/OR9-2*01").when(i % 37 == 0, "").otherwise(F.col("v_call"))
    return repertoire(s, d).select(
        "repertoire_id", "row_idx", F.when(i % 17 == 0, "f").otherwise("t").alias("productive"), (60 + i * 7 % 60).cast("double").alias("v_score"), cdr3.alias("cdr3_seq_aa_q"),
        v.alias("v_segment"), F.when(i % 41 != 0, F.col("j_call")).alias("j_segment"), F.lit("run1").alias("run_label"), i.cast("bigint").alias("trimmed_read_id"),
    )


@query(IGBLAST + " select repertoire_id, row_idx, c cdr3_aa, v v_call, removed_by, 'run1|' || trimmed_read_id sequence_id from igf")
def clean_igblast(s, d):
    return cleaning.igblast_steps(igblast(s, d)).select("repertoire_id", "row_idx", F.col("cdr3_seq_aa_q").alias("cdr3_aa"), "v_call", "removed_by", "sequence_id")


@query(IGBLAST + " select 'renamed' step, v_segment as key, count(*) n_rows from igs where v_segment <> v group by 2 union all select 'no reference', v, count(*) from igs where v not in (select v_call from repertoire where v_call < 'TRBV3') group by 2")
def cleaning_totals(s, d):
    ig = cleaning.igblast_steps(igblast(s, d))
    renamed = cleaning.renamed_alleles(ig).groupBy("old").agg(F.sum("n_rows").alias("n_rows")).withColumnRenamed("old", "v_call")
    misses = cleaning.reference_misses(ig, repertoire(s, d).where("v_call < 'TRBV3'").select("v_call"))
    return cleaning.miss_totals({"renamed": renamed, "no reference": misses})


FILLED = ", ref as (select v_call, min(cdr3_aa) cdr1, case when v_call < 'TRBV2' then max(cdr3_aa) end cdr2 from repertoire where v_call < 'TRBV3' group by 1)"


@query(FILLED + " select repertoire_id, count(*) n_rows, count(*) filter (where cdr1 is null) no_cdr1, count(*) filter (where cdr2 is null) no_cdr2 from repertoire left join ref using (v_call) group by 1")
def missing_after_fill(s, d):
    return cleaning.still_missing(_filled(s, d)[0], ["cdr1", "cdr2"], ["repertoire_id"])


def _filled(s, d) -> tuple[DataFrame, DataFrame]:
    rep = repertoire(s, d)
    ref = rep.where("v_call < 'TRBV3'").groupBy("v_call").agg(F.min("cdr3_aa").alias("cdr1"), F.when(F.col("v_call") < "TRBV2", F.max("cdr3_aa")).alias("cdr2"))
    own = rep.withColumns({c: F.lit(None).cast("string") for c in ("cdr1", "cdr2")})
    return cleaning.overwrite_from_reference(own, ref, {"cdr1": "cdr1", "cdr2": "cdr2"}), ref


@query(FILLED + " select v_call, count(*) n_rows, cdr1 is null no_cdr1, cdr2 is null no_cdr2 from repertoire join ref using (v_call) where cdr1 is null or cdr2 is null group by all")
def partial_reference_misses(s, d):
    return cleaning.partial_misses(repertoire(s, d), _filled(s, d)[1], ["cdr1", "cdr2"])


@query(" select repertoire_id, row_idx, amino_acid, v_gene, case when row_idx % 2 = 0 then 'T' else 'F' end productive, cast(null as varchar) locus from raw")
def airr_columns(s, d):
    """Export spellings renamed, then the exchange layout: order, empty columns, upper-case booleans."""
    df = raw(s, d).select("repertoire_id", "row_idx", F.col("amino_acid").alias("aminoAcid"), F.col("v_gene").alias("vGeneName"), F.when(F.col("row_idx") % 2 == 0, "t").otherwise("f").alias("prod"))
    return cleaning.airr_layout(cleaning.normalize_names(df), {"prod": "productive"}, ["repertoire_id", "row_idx", "amino_acid", "v_gene", "productive", "locus"], ["locus"], ["productive"])


@query(""", x as (select repertoire_id, row_idx, case when row_idx % 3 = 0 then v_call else split_part(v_call, '*', 1) end r, case when row_idx % 5 = 0 then '2' when row_idx % 5 = 1 then 'x' end a from repertoire)
select repertoire_id, row_idx, lpad(coalesce(nullif(regexp_extract(r, '\\*(\\d+)$', 1), ''), nullif(regexp_extract(coalesce(a, ''), '^(\\d+)$', 1), ''), '01'), 2, '0') allele, nullif(regexp_extract(r, '\\*(\\d+)$', 1), '') is null and nullif(regexp_extract(coalesce(a, ''), '^(\\d+)$', 1), '') is null imputed from x""")
def allele_resolution(s, d):
    i = F.col("row_idx")
    resolved = F.when(i % 3 == 0, F.col("v_call")).otherwise(F.substring_index("v_call", "*", 1))
    allele, imputed = genes.resolved_allele(resolved, F.when(i % 5 == 0, "2").when(i % 5 == 1, "x"))
    return repertoire(s, d).select("repertoire_id", "row_idx", allele.alias("allele"), imputed.alias("imputed"))


@query(" select specimen_label, case disease when 'CMV' then 'Cytomegalovirus' when 'HIV' then 'HIV' else 'Healthy/Background' end disease, fold_id from metadata")
def harmonized_metadata(s, d):
    """A source's disease and fold names in the common vocabulary."""
    own = metadata(s, d).select(F.col("specimen_label").alias("sample"), F.lower("disease").alias("disease"), F.col("fold_id").alias("CV_fold"))
    known = cohorts.harmonize_metadata(own, {"cmv": "Cytomegalovirus", "hiv": "HIV", "healthy/background": "none"})
    return cohorts.normalize_controls(known, "none", "CV_fold").select(F.col("sample").alias("specimen_label"), "disease", "fold_id")


@query(" select distinct v_call, case when trim(x) = '' then null when contains(x, '*') then x else x || '*01' end canonical from (select v_call, case when v in ('TRBV1-1', 'TRBV2-1', 'TRBV9-1', 'TRBV13-1', 'TRBV14-1', 'TRBV15-1', 'TRBV16-1', 'TRBV17-1', 'TRBV18-1', 'TRBV19-1', 'TRBV26-1', 'TRBV27-1', 'TRBV28-1', 'TRBV30-1') then split_part(v, '-', 1) else v end x from (select v_call, split_part(v_call, '*', 1) v from repertoire))")
def canonical_alleles(s, d):
    return repertoire(s, d).select("v_call", genes.first_allele(F.concat("v_call", F.lit(", TRBV9")), canonical=True).alias("canonical")).distinct()


@query(""", o as (select distinct cdr3_aa from repertoire),
 n as (select cdr3_aa, list_aggregate(list_transform(string_split(cdr3_aa, ''), lambda c: case c when 'A' then 'GCT' when 'C' then 'TGT' when 'D' then 'GAC' when 'E' then 'GAG' else 'NNN' end), 'string_agg', '') || 'G' nt from o)
select cdr3_aa, regexp_replace(cdr3_aa, '[^ACDE]', 'X', 'g') || 'X' translated from n""")
def translated_codons(s, d):
    codon = F.create_map(*map(F.lit, ("A", "GCT", "C", "TGT", "D", "GAC", "E", "GAG")))
    nt = F.concat(F.array_join(F.transform(sequences.letters(F.col("cdr3_aa")), lambda c: F.coalesce(F.try_element_at(codon, c), F.lit("NNN"))), ""), F.lit("G"))
    return repertoire(s, d).select("cdr3_aa").distinct().select("cdr3_aa", sequences.translate_nt(nt).alias("translated"))


@query(""", o as (select distinct cdr3_aa a from repertoire),
 p as (select a, left(a, 4) || substr(a, 6) b from o),
 g as (select a, b, unnest(range(0, length(b) + 1)) i from p),
 q as (select a, b, left(b, i) || '-' || substr(b, i + 1) x from g)
select a, round(max(list_sum(list_transform(range(1, length(a) + 1), lambda k: case when substr(a, k, 1) = substr(x, k, 1) then 4.0 else -6.0 end)) / length(a)), 6) score from q group by 1""")
def one_gap_scores(s, d):
    """Each CDR3 against itself without its fifth residue: the best place of one gap."""
    own = repertoire(s, d).select(F.col("cdr3_aa").alias("a")).distinct()
    short = F.concat(F.expr("left(a, 4)"), F.expr("substring(a, 6)"))
    return own.select("a", r6(sequences.one_gap_score(F.col("a"), short, {r + r: 5.0 for r in sequences.RESIDUES}), "score"))


@query(f", o as (select distinct cdr3_aa from repertoire) select cdr3_aa, round(list_sum(list_transform(range(1, length(cdr3_aa) + 1), lambda i: (instr('{sequences.RESIDUES}', substr(cdr3_aa, i, 1)) - 1 - 9.5) / sqrt(33.25))), 6) + 0.0 total, cast(20 - length(cdr3_aa) as double) gaps from o")
def standardized_codes(s, d):
    """Sum of a property's standardized values and number of padded places, from the per-position code."""
    code = sequences.standardized_code(F.col("cdr3_aa"), {c: [float(i)] for i, c in enumerate(sequences.RESIDUES)}, 20)
    own = repertoire(s, d).select("cdr3_aa").distinct().select("cdr3_aa", code.alias("code"))
    part = lambda k: F.aggregate(F.filter("code", lambda x, i: i % 2 == k), F.lit(0.0), lambda a, x: a + x)
    return own.select("cdr3_aa", (F.round(part(0), 6) + 0.0).alias("total"), part(1).alias("gaps"))


@query(f", {STEPS} select repertoire_id, count(*) n_input, count(*) filter (where removed_by is null) n_kept from steps group by 1")
def running_totals(s, d):
    """Cleaning totals kept up over a file stream, as they stand at its end."""
    base, name = _place(s), f"totals_{uuid.uuid4().hex}"
    rows = raw(s, d)
    rows.write.parquet(base)
    stream = s.readStream.schema(rows.schema).parquet(base)
    running_funnel(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", _place(s)).start().awaitTermination()
    return s.table(name)


# ---- predictions, cohorts, groups ------------------------------------------------------------------------------------


@query(PRED + " select participant_label, specimen_label, y disease_label, s model_score, fold from pred where s > 0.1")
def shared_scores(s, d):
    p = predictions(s, d).withColumn("p_disease", F.when(F.col("model_score") > 0.1, F.col("model_score"))).drop("model_score")
    return metrics.standard_scores(p, "p_disease")


@query(PRED + " select case when fold = 0 then 'a.csv' else 'b.csv' end file, round(avg(s), 6) mean, count(*) n from pred group by 1")
def prediction_files(s, d):
    base, p = _place(s), predictions(s, d)
    for name, rows in (("a", p.where("fold = 0")), ("b", p.where("fold > 0"))):
        rows.select("specimen_label", "model_score").coalesce(1).write.option("header", True).csv(f"{base}/{name}")
    found = None
    for name in "ab":
        one = tables.metrics_by_file(s, f"{base}/{name}", "specimen_label string, model_score double").withColumn("file", F.regexp_replace("file", r"^part-.*\.csv$", f"{name}.csv"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("file").agg(r6(F.avg("model_score"), "mean"), F.count("*").alias("n"))


@query(" select specimen_label, cast(disease = 'HIV' as int) as label from metadata where disease in ('HIV', 'Healthy/Background') and ancestry = 'AFRICA'")
def ruled_cohort(s, d):
    """The cohort of a disease whose rule is a filter of ancestry."""
    named = metadata(s, d).withColumn("ancestry", F.when(F.col("ancestry") == "AFRICA", "African").otherwise(F.col("ancestry")))
    return cohorts.adjusted(named, "HIV").select("specimen_label", "label")


@query(" select specimen_label, disease, fold_id from metadata union all select specimen_label, disease, fold_id from metadata where fold_id = 0")
def shared_columns(s, d):
    m = metadata(s, d)
    a, b = cohorts.shared_columns([m.drop("age", "sex", "ancestry", "participant_label"), m.where("fold_id = 0").drop("participant_label", "ancestry")])
    return a.unionByName(b).select("specimen_label", "disease", "fold_id")


@query(""", r as (select specimen_label, disease, row_number() over (partition by disease order by md5('7-' || specimen_label), specimen_label) r from metadata),
 t as (select specimen_label, row_number() over (order by r, disease) n from r)
select specimen_label, case when n <= 12 then 'test' else 'train' end as role from t""")
def leave_twelve_out(s, d):
    return sampling.leave_out(metadata(s, d).select("specimen_label", "disease"), "disease", "specimen_label", 12).select("specimen_label", "role")


@query(f", {LABELS}, b as (select repertoire_id, y, (row_number() over (partition by y order by md5('7-' || repertoire_id), repertoire_id) - 1) % 3 f from labels join metadata on specimen_label = repertoire_id where fold_id > 0), g as (select distinct f from b) select cast(g.f as int) fold, repertoire_id, 'train' as role from labels join metadata on specimen_label = repertoire_id, g where fold_id = 0 union all select cast(g.f as int), repertoire_id, case when b.f = g.f then 'test' else 'train' end from b, g")
def transfer_folds(s, d):
    own = labels(s, d).join(metadata(s, d).select(F.col("specimen_label").alias("repertoire_id"), "fold_id"), "repertoire_id")
    return cohorts.transfer_folds(own.where("fold_id = 0").drop("fold_id"), own.where("fold_id > 0").drop("fold_id"), "label", "repertoire_id", 3).select("fold", "repertoire_id", "role")


@query(f", {LABELS}, r as (select v_call, cdr3_aa, y, duplicate_count, row_number() over (partition by y order by duplicate_count desc, repertoire_id, row_idx) n from repertoire join labels using (repertoire_id)) select y as label, n as rank, cdr3_aa, duplicate_count from r where n <= 10")
def representative_sequences(s, d):
    rows = repertoire(s, d).join(labels(s, d), "repertoire_id")
    return features.representatives(rows, ["label"], [F.desc("duplicate_count"), "repertoire_id", "row_idx"], 10).select("label", *big("rank"), "cdr3_aa", "duplicate_count")


@query(" select v_call as cluster, count(*) n_rows, max(length(cdr3_aa)) - min(length(cdr3_aa)) length_spread, count(distinct length(cdr3_aa)) n_lengths from repertoire group by 1")
def cluster_lengths(s, d):
    return features.cluster_matrix(repertoire(s, d).withColumn("cluster", F.col("v_call")), "duplicate_count")[1]


@query(" select repertoire_id, v_call as cluster, cast(sum(duplicate_count) as bigint) weight from repertoire group by 1, 2")
def cluster_weights(s, d):
    return features.cluster_matrix(repertoire(s, d).withColumn("cluster", F.col("v_call")), "duplicate_count")[0]


@query(" select fold_id, disease, count(distinct repertoire_id) n_specimens, count(*) n_rows from repertoire join metadata on specimen_label = repertoire_id group by 1, 2")
def audit_by_fold(s, d):
    return cleaning.audit_groups(repertoire(s, d), metadata(s, d), ["fold_id", "disease"])


@query(""", e as (select repertoire_id, cdr3_aa, exp(duplicate_count / 10.0 - max(duplicate_count / 10.0) over (partition by repertoire_id)) e from repertoire),
 w as (select *, e / sum(e) over (partition by repertoire_id) w from e)
select repertoire_id, cdr3_aa, round(max(w), 9) score from w group by 1, 2""")
def attention_driver_scores(s, d):
    rep = repertoire(s, d).select("repertoire_id", "cdr3_aa", (F.col("duplicate_count") / 10.0).alias("weighting"))
    return features.attention_driver_scores(rep, "weighting").select("repertoire_id", "cdr3_aa", F.round("score", 9).alias("score"))


@query(TRUTH + """, m as (select distinct a.repertoire_id, a.cdr3_aa from repertoire a join truth using (cdr3_aa)),
 n as (select repertoire_id, count(*) n from m group by 1),
 f as (select disease, coalesce(n, 0) n from metadata left join n on repertoire_id = specimen_label)
select disease, count(*) specimens, round(avg(n), 6) mean, round(coalesce(stddev_samp(n), 0), 6) sd, min(n) least, round(quantile_cont(n, 0.5), 6) median, max(n) most from f group by 1""")
def unique_drivers(s, d):
    """Exact drivers of each specimen, described by disease."""
    held = repertoire(s, d).join(truth(s, d).select("cdr3_aa"), "cdr3_aa", "left_semi").select("repertoire_id", "cdr3_aa").distinct()
    n = cohorts.zero_filled(metadata(s, d), held.groupBy(F.col("repertoire_id").alias("specimen_label")).agg(F.count("*").alias("n")), "specimen_label", "n")
    return n.groupBy("disease").agg(
        F.count("*").alias("specimens"), r6(F.avg("n"), "mean"), r6(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), "sd"), F.min("n").alias("least"), r6(F.percentile("n", F.lit(0.5)), "median"), F.max("n").alias("most")
    )


# ---- neighbours and votes --------------------------------------------------------------------------------------------

@query("""
, known as (select cdr3_aa, max(cast(length(cdr3_aa) = 12 or cdr3_aa < 'G' as int)) k from repertoire group by 1)
, code as materialized (select cdr3_aa, k, length(cdr3_aa) len, CODE code from known),
 p as (select a.cdr3_aa a, b.cdr3_aa b, b.k, round(list_sum(list_transform(range(1, 31), lambda i: (a.code[i] - b.code[i]) * (a.code[i] - b.code[i]))), 9) dist, a.len from code a join code b on a.len = b.len and a.cdr3_aa <> b.cdr3_aa and a.k = 0),
 n as (select a, min(struct_pack(d := dist, b := b, k := k)) m from p where dist <= 40 - 0.5 * (15 - len) group by 1)
select a, m.b b, case when m.k = 1 then 'reference' else 'query' end side, round(m.d, 6) distance from n
""".replace("CODE", _phase_sql("cdr3_aa")))
def query_nearest(s, d):
    """Each query sequence's nearest among queries and reference, by isometric code."""
    own = coded(s, d)
    known = F.expr("length(cdr3_aa) = 12 or cdr3_aa < 'G'")
    out = similarity.query_nearest(own.where(~known), own.where(known), 30, 40.0)
    return out.select("a", "b", "side", F.round("distance", 6).alias("distance"))


@query(", g as (select distinct v_call v from repertoire), s as (select a.v v1, b.v v2, case when left(a.v, 5) = left(b.v, 5) then 4.0 else 3.0 end sc from g a, g b where a.v < 'TRBV25' and b.v < 'TRBV25') select a.v v1, b.v v2 from g a, g b left join s on s.v1 = a.v and s.v2 = b.v where coalesce(sc >= 3.7, a.v = b.v)".replace("from g a, g b left join s", "from g a cross join g b left join s"))
def compatible_genes(s, d):
    g = repertoire(s, d).select("v_call").distinct()
    pairs = g.withColumnRenamed("v_call", "v1").crossJoin(g.withColumnRenamed("v_call", "v2"))  # some 140 genes
    scores = pairs.where("v1 < 'TRBV25' and v2 < 'TRBV25'").withColumn("score", F.when(F.expr("left(v1, 5) = left(v2, 5)"), 4.0).otherwise(3.0))
    return similarity.compatible_genes(pairs, scores).select("v1", "v2")


@query(""", t as (select vec_id, vec_id % 3 f, label, embedding e from embeddings),
 p as (select a.vec_id, b.vec_id o, b.label, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.e[i]::double - b.e[i]::double) * (a.e[i]::double - b.e[i]::double)))), 9) q from t a join t b on a.f <> b.f),
 r as (select *, row_number() over (partition by vec_id order by q, o) rank from p),
 v as (select vec_id, k, label as class, sum(1 / (q + 1e-9)) w from (select *, unnest([1, 5, 10]) k from r where rank <= 10) where rank <= k group by 1, 2, 3)
select vec_id, k, class, round(w / sum(w) over (partition by vec_id, k), 5) score from v""")
def knn_votes(s, d):
    """Class shares among the k nearest vectors of other folds, for a grid of k."""
    v = table(s, d, "embeddings").select("vec_id", F.col("label").alias("class"), (F.col("vec_id") % 3).alias("fold"), F.col("embedding").alias("v"))
    near = similarity.nearest_vectors(v, "vec_id", "v", "fold", 10).withColumn("distance", F.round("distance", 9))
    return similarity.vote_by_k(near, v, "vec_id", [1, 5, 10]).select("vec_id", "k", "class", F.round("score", 5).alias("score"))


# ---- fitted models without an SQL form -------------------------------------------------------------------------------


@query()
def enriched_genes(s, d):
    """V genes whose usage differs between the classes, by Mann-Whitney p-value."""
    u = repertoire(s, d).join(labels(s, d), "repertoire_id").groupBy(F.col("v_call").alias("feature"), "repertoire_id", "label").agg(F.count("*").alias("v"))
    return association.enriched(association.mann_whitney(u, "feature", "v", "label"), 0.05)


@query()
def tree_sequence_scores(s, d):
    """Boosted trees on V/J usage, applied to single sequences; the largest score of each CDR3."""
    long = features.gene_usage(repertoire(s, d))
    rows = Scratch(s).write(sampling.stratified_split(labels(s, d), "label", "repertoire_id", 0.8))
    part = lambda role: rows.where(role).drop("role")
    model = boosting.fitted(long, part("role = 'train'"), part("role <> 'train'"), depth=3, step=0.1)
    own = repertoire(s, d)
    cells = F.explode(F.array(F.concat(F.lit("V:"), "v_call"), F.concat(F.lit("J:"), "j_call"))).alias("feature")
    units = own.select("repertoire_id", "cdr3_aa", "v_call", "j_call", cells).withColumn("value", F.lit(1.0))
    # A sequence's features are its genes alone, so distinct pairs of genes are what is scored.
    return learners.tree_sequence_scores(units, boosting.tree_table(s, model), ["v_call", "j_call"])


@query()
def usage_and_demographics(s, d):
    """L1 model on V/J usage and demographics together, C by cross-validation."""
    rows = sampling.stratified_split(labels(s, d), "label", "repertoire_id", 0.8)
    train, test = rows.where("role = 'train'").drop("role"), rows.where("role <> 'train'").drop("role")
    return learners.usage_and_demographics(features.gene_usage(repertoire(s, d)), metadata(s, d), train, test)[1]


@query()
def embedding_and_demographics(s, d):
    """Mean vectors and demographics, standardized apart, in one L1 model; specimens without a vector get the mean of all."""
    meta = metadata(s, d)
    n = F.expr("cast(substring(specimen_label, 2) as bigint)")
    cells = table(s, d, "embeddings").select((F.col("vec_id") % 100).alias("n"), F.posexplode("embedding").alias("i", "x"))
    mean = lambda *by: cells.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vector"))
    vectors, every = mean("n"), mean().withColumnRenamed("vector", "all")
    task = learners.demographic_features(cohorts.binary_task(meta, "CMV"), meta.agg(F.avg("age")).first()[0]).withColumn("n", n % 100)
    task = task.join(vectors, "n", "left").join(F.broadcast(every)).withColumn("vector", F.coalesce("vector", "all"))  # one row
    split = sampling.stratified_split(task.select("specimen_label", "label", "vector", "c_age", "c_age_missing", "c_sex_m", "c_sex_unknown"), "label", "specimen_label", 0.8).persist()
    _, scored = learners.embedding_and_demographics(split.where("role <> 'train'"), split.where("role = 'train'"), "vector", ["c_age", "c_age_missing", "c_sex_m", "c_sex_unknown"])
    return scored.select("specimen_label", "label", "score")


@query(HITS + " select k, round(avg(least(k / n, 1.0)), 6) closed_form, true near from hits group by k")
def simulated_chance(s, d):
    """Recall at k of 10,000 random rankings a repertoire beside its expectation, and whether they are within three errors."""
    from .queries import hits

    out = metrics.simulated_chance_recall(hits(s, d).withColumn("n_present", F.col("n_drivers")))
    near = F.abs(F.col("chance_recall") - F.col("closed_form")) <= 3 * F.col("standard_error") + 1e-9
    return out.select("k", F.round("closed_form", 6).alias("closed_form"), near.alias("near"))
