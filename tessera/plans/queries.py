"""Registered queries on the derived repertoire tables, each beside its equivalent in SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import genes, sequences
from ..operators import association, cleaning, cohorts, features, metrics, sampling, similarity
from ..operators.graph import components
from ..scratch import Scratch, numbered
from .fixtures import CTE, metadata, raw, repertoire, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """Register a query under its function's name; ``sql`` follows the common table expressions unless ``plain``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if plain else f"with recursive {CTE}{sql}" if sql.lstrip().startswith(",") else f"with {CTE} {sql}"
        return f

    return add


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def labels(s: SparkSession, d: str, disease: str = "CMV") -> DataFrame:
    return cohorts.binary_task(metadata(s, d), disease).select(F.col("specimen_label").alias("repertoire_id"), "label")


LABELS = "labels as (select specimen_label repertoire_id, cast(disease = 'CMV' as int) y from metadata where disease in ('CMV', 'Healthy/Background'))"

# ---- gene and sequence functions -------------------------------------------------------------------------------------


def _airr(g: str) -> str:
    return f"regexp_replace(regexp_replace(case when regexp_matches(trim({g}), '/OR\\d', 'i') then trim({g}) else split_part(trim({g}), '/', 1) end, '^TCRB([VDJ])', 'TRB\\1', 'i'), '([^0-9])0+([0-9])', '\\1\\2', 'g')"


def _allele(g: str) -> str:
    return f"split_part({g}, '*', 1)"


def _collapse(g: str) -> str:
    return f"case {g} when 'TRBV12-4' then 'TRBV12-3' when 'TRBV6-3' then 'TRBV6-2' else {g} end"


def _single(g: str) -> str:
    families = ", ".join(f"'{f}'" for f in genes.SINGLETON_FAMILIES)
    return f"case when ends_with({g}, '-1') and left({g}, length({g}) - 2) in ({families}) then left({g}, length({g}) - 2) else {g} end"


_ORPHON = "regexp_replace(v_gene, '-or9[_-]2$', '/OR9-2', 'i')"
STEPS = f"""
 s0 as (select *, {_allele(_airr(_ORPHON))} v0, {_allele(_airr('j_gene'))} j1, case when length(amino_acid) > 2 then substr(amino_acid, 2, length(amino_acid) - 2) else amino_acid end c1 from raw),
 s1 as (select *, {_collapse('v0')} v00 from s0), s2 as (select *, {_single('v00')} v1 from s1),
 steps as (select *, case when frame_type is distinct from 'In' then 'productive'
   when coalesce(lower(trim(v_gene)) = 'unresolved', false) or coalesce(lower(trim(j_gene)) = 'unresolved', false) or coalesce(lower(trim(amino_acid)) = 'unresolved', false) then 'resolved'
   when coalesce(trim(c1), '') = '' or coalesce(trim(v1), '') = '' or coalesce(trim(j1), '') = '' then 'present'
   when not regexp_full_match(upper(c1), '[{sequences.RESIDUES}]+') then 'standard'
   when not ((contains(v1, '-') or v1 in ({", ".join(f"'{f}'" for f in genes.SINGLETON_FAMILIES)})) and contains(j1, '-')) then 'gene_level' end removed_by from s2)
"""
STEP_NAMES = ["productive", "resolved", "present", "standard", "gene_level"]


@query(f", {STEPS} select distinct v_gene, j_gene, v1 v_call, j1 j_call from steps")
def gene_harmonize(s, d):
    return cleaning.adaptive_steps(raw(s, d)).select("v_gene", "j_gene", "v_call", "j_call").distinct()


@query(f", {STEPS} select repertoire_id, row_idx, c1 cdr3_aa, v1 v_call, j1 j_call, coalesce(templates, 1) num_reads from steps where removed_by is null")
def clean_adaptive(s, d):
    return cleaning.clean_adaptive(raw(s, d))


@query(f", {STEPS} select repertoire_id, count(*) n_input, {', '.join(f'''count(*) filter (where removed_by = '{n}') n_{n}''' for n in STEP_NAMES)}, count(*) filter (where removed_by is null) n_kept from steps group by rollup (repertoire_id)")
def clean_funnel(s, d):
    return cleaning.funnel(cleaning.adaptive_steps(raw(s, d)), STEP_NAMES)


@query(f", c as (select distinct repertoire_id, row_idx, unnest(string_split(amino_acid, '')) residue from raw where amino_acid is not null) select residue, count(*) n_rows from c where residue not in ({', '.join(repr(c) for c in sequences.RESIDUES)}) group by 1")
def invalid_residues(s, d):
    return cleaning.invalid_residues(raw(s, d), "amino_acid")


@query(f", {STEPS} select removed_by = 'gene_level' family_only, v1 v_call, count(*) n_rows from steps where removed_by is null or removed_by = 'gene_level' group by 1, 2".replace("removed_by = 'gene_level' family_only", "coalesce(removed_by = 'gene_level', false) family_only"))
def gene_level_filter(s, d):
    t = cleaning.adaptive_steps(raw(s, d)).where("removed_by is null or removed_by = 'gene_level'")
    return t.groupBy(F.coalesce(F.col("removed_by") == "gene_level", F.lit(False)).alias("family_only"), "v_call").agg(F.count("*").alias("n_rows"))


@query("select v_call old, case when starts_with(v_call, 'TRBV12-4*') then 'TRBV12-3*01' when starts_with(v_call, 'TRBV6-3*') then 'TRBV6-2*01' else v_call end as new, count(*) n_rows from repertoire where starts_with(v_call, 'TRBV12-4*') or starts_with(v_call, 'TRBV6-3*') group by 1, 2")
def renamed_alleles(s, d):
    return cleaning.renamed_alleles(repertoire(s, d), "v_call")


@query(", ref as (select v_call, min(cdr3_aa) ref_cdr1 from repertoire where row_idx % 2 = 0 and v_call < 'TRBV3' group by 1) select r.repertoire_id, r.row_idx, r.v_call, coalesce(ref_cdr1, cdr3_aa) cdr1 from repertoire r left join ref using (v_call)")
def reference_overwrite(s, d):
    rep = repertoire(s, d)
    ref = rep.where("row_idx % 2 = 0 and v_call < 'TRBV3'").groupBy("v_call").agg(F.min("cdr3_aa").alias("ref_cdr1"))
    return cleaning.overwrite_from_reference(rep.select("repertoire_id", "row_idx", "v_call", F.col("cdr3_aa").alias("cdr1")), ref, {"cdr1": "ref_cdr1"})


@query("select v_call, count(*) n_rows from repertoire where v_call not in (select v_call from repertoire where v_call < 'TRBV3') group by 1")
def reference_misses(s, d):
    rep = repertoire(s, d)
    return cleaning.reference_misses(rep, rep.where("v_call < 'TRBV3'").select("v_call"))


@query("select count(*) n_rows, count(*) filter (where coalesce(cdr3_aa, '') = '') no_cdr3_aa, count(*) filter (where coalesce(v_call, '') = '') no_v_call, count(*) filter (where coalesce(j_call, '') = '') no_j_call, count(*) filter (where not regexp_full_match(v_call, 'TRBV[0-9A-Z/-]+\\*\\d\\d')) bad_v_allele, count(*) filter (where not regexp_full_match(j_call, 'TRBJ[0-9-]+\\*\\d\\d')) bad_j_allele from repertoire")
def processed_audit(s, d):
    return cleaning.audit(repertoire(s, d))


@query("select repertoire_id, row_idx, cdr3_aa, cast(duplicate_count as double) duplicate_count from repertoire where duplicate_count >= 1 and length(cdr3_aa) between 11 and 14")
def length_and_count_filter(s, d):
    rep = cleaning.length_filter(cleaning.count_filter(repertoire(s, d)), least=11, most=14)
    return rep.select("repertoire_id", "row_idx", "cdr3_aa", "duplicate_count")


@query("select specimen_label, participant_label, coalesce(h.x, false) has_tcr from metadata left join (select distinct repertoire_id specimen_label, true x from repertoire where duplicate_count = 50 and length(cdr3_aa) = 16) h using (specimen_label)")
def availability_flag(s, d):
    return cohorts.availability(metadata(s, d), repertoire(s, d).where("duplicate_count = 50 and length(cdr3_aa) = 16")).select("specimen_label", "participant_label", "has_tcr")


@query(", k as (select specimen_label from metadata where fold_id < 2) select repertoire_id, count(*) n_rows from repertoire where repertoire_id not in (select specimen_label from k) group by 1")
def split_by_metadata(s, d):
    return cohorts.split_by_metadata(repertoire(s, d), metadata(s, d).where("fold_id < 2"))[1]


@query(""", n as (select repertoire_id, count(distinct cdr3_aa) n from repertoire where length(cdr3_aa) = 16 and duplicate_count > 49 group by 1)
select specimen_label repertoire_id, cast(coalesce(n, 0) as bigint) n_unique from metadata left join n on repertoire_id = specimen_label where disease = 'CMV'""")
def zero_fill_counts(s, d):
    n = repertoire(s, d).where("length(cdr3_aa) = 16 and duplicate_count > 49").groupBy("repertoire_id").agg(F.countDistinct("cdr3_aa").alias("n_unique"))
    return cohorts.zero_filled(metadata(s, d).where("disease = 'CMV'").select(F.col("specimen_label").alias("repertoire_id")), n, "repertoire_id", "n_unique")


@query("select repertoire_id, count(*) n_rows, count(*) >= 600 eligible from repertoire group by 1")
def depth_eligibility(s, d):
    return cohorts.eligibility(repertoire(s, d), 600)


@query("select repertoire_id, n_rows, participant_label, disease, fold_id, age, sex, ancestry from (select repertoire_id, count(*) n_rows from repertoire group by 1) left join metadata on specimen_label = repertoire_id")
def specimen_overview(s, d):
    return cohorts.overview(repertoire(s, d), metadata(s, d))


# ---- features --------------------------------------------------------------------------------------------------------


@query(""", l as (select repertoire_id, 'V' locus, v_call gene from repertoire union all select repertoire_id, 'J', j_call from repertoire),
 n as (select repertoire_id, locus, gene, count(*) n from l group by 1, 2, 3)
select repertoire_id, locus || ':' || gene feature, n, round(n / sum(n) over (partition by repertoire_id, locus), 6) as value from n""")
def vj_usage(s, d):
    return features.gene_usage(repertoire(s, d)).select("repertoire_id", "feature", "n", r6("value", "value"))


@query(""", w as (select repertoire_id, substr(cdr3_aa, i, 4) w from (select repertoire_id, cdr3_aa, unnest(range(1, length(cdr3_aa) - 2)) i from repertoire)),
 f as (select repertoire_id, w feature from w union all select repertoire_id, '_' || substr(w, 2) from w union all select repertoire_id, left(w, 1) || '_' || substr(w, 3) from w union all select repertoire_id, left(w, 2) || '_' || substr(w, 4) from w union all select repertoire_id, left(w, 3) || '_' from w),
 n as (select repertoire_id, feature, count(*) n from f group by 1, 2)
select repertoire_id, feature, n, round(n / sum(n) over (partition by repertoire_id), 6) as value from n""")
def kmer_freq(s, d):
    return features.kmer_frequencies(repertoire(s, d)).select("repertoire_id", "feature", *big("n"), r6("value", "value"))


@query("select repertoire_id, cdr3_aa, v_call, cast(sum(duplicate_count) as bigint) n_reads from repertoire group by 1, 2, 3")
def collapse_cdr3(s, d):
    return features.collapse(repertoire(s, d), ["cdr3_aa", "v_call"])


@query("select repertoire_id, cdr3_aa, cast(sum(duplicate_count) as bigint) n_reads, arg_min(v_call, row_idx) v_call, arg_min(j_call, row_idx) j_call from repertoire group by 1, 2")
def collapse_first_gene(s, d):
    return features.collapse_first_gene(repertoire(s, d))


COLLAPSED = """, c as (select repertoire_id, cdr3_aa, cast(sum(duplicate_count) as bigint) n_reads from repertoire group by 1, 2),
 r as (select *, row_number() over w rank, sum(n_reads) over (partition by repertoire_id order by n_reads desc, cdr3_aa rows unbounded preceding) run, sum(n_reads) over (partition by repertoire_id) total from c window w as (partition by repertoire_id order by n_reads desc, cdr3_aa))"""


@query(COLLAPSED + " select repertoire_id, cdr3_aa, n_reads, round(n_reads / total, 6) frequency from r")
def relative_frequency(s, d):
    return features.relative_frequency(features.collapse(repertoire(s, d), ["cdr3_aa"])).select("repertoire_id", "cdr3_aa", "n_reads", r6("frequency", "frequency"))


@query(COLLAPSED + " select repertoire_id, cdr3_aa, n_reads, rank from r where rank <= 50")
def top_n_by_count(s, d):
    return features.top_by_count(features.collapse(repertoire(s, d), ["cdr3_aa"]), 50).select("repertoire_id", "cdr3_aa", "n_reads", *big("rank"))


def _cut(mode: str, value: float, condition: str):
    def f(s, d):
        return features.cut(features.collapse(repertoire(s, d), ["cdr3_aa"]), mode, value).select("repertoire_id", "cdr3_aa", "n_reads", *big("rank"))

    f.__name__ = f"cut_{mode}"
    query(COLLAPSED + f" select repertoire_id, cdr3_aa, n_reads, rank from r where {condition} or rank = 1")(f)


_cut("fraction", 0.3, "run / total <= 0.3")
_cut("frequency", 0.004, "n_reads / total >= 0.004")
_cut("number", 20, "rank <= 20")
_cut("reads", 60, "n_reads >= 60")
_cut("read_sum", 2000, "run <= 2000")


@query(""", k as (select repertoire_id, cdr3_aa, substr(cdr3_aa, 4, length(cdr3_aa) - 6) core, count(*) size from repertoire where length(cdr3_aa) >= 10 group by 1, 2, 3),
 t as (select repertoire_id, sum(size) n from k group by 1),
 p as (select repertoire_id, size, substr(core, i, 4) fourmer from (select *, unnest(range(1, length(core) - 2)) i from k)),
 a as (select repertoire_id, fourmer, sum(size) c, max(size) m from p group by 1, 2)
select repertoire_id, fourmer, round(ln(c / sum(c) over (partition by repertoire_id)), 6) log_sum, round(ln(m / n), 6) log_max from a join t using (repertoire_id)""")
def fourmer_abundance(s, d):
    return features.fourmer_abundance(repertoire(s, d)).select("repertoire_id", "fourmer", r6("log_sum", "log_sum"), r6("log_max", "log_max"))


@query(""", a as (select distinct v_call gene from repertoire where row_idx % 3 = 0 and v_call < 'TRBV25'),
 b as (select distinct v_call gene from repertoire where v_call > 'TRBV2')
select coalesce(a.gene, b.gene) gene, case when b.gene is null then 'first_only' when a.gene is null then 'second_only' else 'shared' end status from a full join b on a.gene = b.gene""")
def gene_vocab_compare(s, d):
    rep = repertoire(s, d)
    return features.gene_vocabulary_compare(rep.where("row_idx % 3 = 0 and v_call < 'TRBV25'"), rep.where("v_call > 'TRBV2'"), "v_call")


@query(", v as (select distinct j_call as value from repertoire) select value, row_number() over (order by value) id from v")
def gene_vocabulary(s, d):
    return features.vocabulary(repertoire(s, d), "j_call").select("value", *big("id"))


@query(""", c as (select repertoire_id, v_call, sum(duplicate_count) w from repertoire group by 1, 2),
 p as (select repertoire_id, w / sum(w) over (partition by repertoire_id) p from c where w > 0)
select repertoire_id, count(*) n_clusters, round(-sum(p * ln(p)), 6) entropy from p group by 1""")
def diversity_entropy(s, d):
    c = features.cluster_frequencies(repertoire(s, d).withColumn("cluster", F.col("v_call")), "duplicate_count")
    return features.diversity(c).select("repertoire_id", "n_clusters", r6("entropy", "entropy"))


@query("select label, pos - 1 pos, round(avg(cast(embedding[pos] as double)), 5) as value from (select label, embedding, unnest(range(1, 65)) pos from embeddings) group by 1, 2", plain=True)
def sample_features(s, d):
    return features.pooled_vectors(table(s, d, "embeddings"), "label", "embedding").select("label", F.col("pos").cast("bigint").alias("pos"), F.round("value", 5).alias("value"))


@query(""", l as (select disease feature, i - 1 pos, substr(cdr3_aa, i, 1) residue from (select disease, cdr3_aa, unnest(range(1, length(cdr3_aa) + 1)) i from repertoire join metadata on repertoire_id = specimen_label)),
 n as (select feature, pos, residue, count(*) n from l group by 1, 2, 3)
select feature, pos, residue, n, round(n / sum(n) over (partition by feature, pos), 6) share from n""")
def position_weights(s, d):
    rep = repertoire(s, d).join(metadata(s, d).select(F.col("specimen_label").alias("repertoire_id"), F.col("disease").alias("feature")), "repertoire_id")
    return features.weight_matrix(rep, "feature", "cdr3_aa").select("feature", F.col("pos").cast("bigint").alias("pos"), "residue", "n", r6("share", "share"))


@query(""", e as (select repertoire_id, row_idx, exp(duplicate_count / 10.0 - max(duplicate_count / 10.0) over (partition by repertoire_id)) e, length(cdr3_aa) x, row_idx % 7 y from repertoire),
 w as (select *, e / sum(e) over (partition by repertoire_id) w from e)
select repertoire_id, unnest([0, 1]) pos, round(unnest([sum(w * x), sum(w * y)]), 6) as value from w group by 1""")
def attention_pool(s, d):
    rep = repertoire(s, d).select("repertoire_id", (F.col("duplicate_count") / 10.0).alias("score"), F.array(F.length("cdr3_aa").cast("double"), (F.col("row_idx") % 7).cast("double")).alias("v"))
    return features.attention_pool(rep, "score", "v").select("repertoire_id", F.col("pos").cast("int").alias("pos"), r6("value", "value"))


@query("select repertoire_id, unnest(list_distinct([v_call, j_call])) as value from (select distinct repertoire_id, v_call, j_call from repertoire)".replace("select repertoire_id, unnest", "select distinct repertoire_id, unnest"))
def multi_hot_genes(s, d):
    rep = repertoire(s, d).select("repertoire_id", F.array("v_call", "j_call").alias("genes"))
    return features.multi_hot(rep, "repertoire_id", "genes")


# ---- clones and association ------------------------------------------------------------------------------------------

CLONES = f", {LABELS}, held as (select distinct repertoire_id, cdr3_aa, v_call, j_call from repertoire), inc as (select cdr3_aa, v_call, j_call, sum(y) n_pos, sum(1 - y) n_neg from held join labels using (repertoire_id) group by 1, 2, 3 having count(*) >= 2)"
FISHER = CLONES + """, tot as (select sum(y) P, sum(1 - y) N from labels), pairs as (select distinct n_pos, n_neg, P, N from inc, tot),
 terms as (select n_pos, n_neg, P, N, n_pos + n_neg K, unnest(range(cast(n_pos as bigint), cast(least(n_pos + n_neg, P) as bigint) + 1)) a from pairs),
 pv as (select n_pos, n_neg, least(1.0, sum(exp(lgamma(P + 1) - lgamma(a + 1) - lgamma(P - a + 1) + lgamma(N + 1) - lgamma(K - a + 1) - lgamma(N - K + a + 1) - lgamma(P + N + 1) + lgamma(K + 1) + lgamma(P + N - K + 1)))) p from terms group by 1, 2),
 clones as (select inc.*, p from inc join pv using (n_pos, n_neg))"""


def clones(s, d) -> DataFrame:
    y = labels(s, d)
    return association.fisher_greater(Scratch(s).write(association.incidence(repertoire(s, d), y)), y)


@query(CLONES + " select cdr3_aa, v_call, j_call, cast(n_pos as bigint) n_pos, cast(n_neg as bigint) n_neg from inc")
def clone_incidence(s, d):
    return association.incidence(repertoire(s, d), labels(s, d)).select("cdr3_aa", "v_call", "j_call", *big("n_pos", "n_neg"))


@query(FISHER + " select cdr3_aa, v_call, j_call, cast(n_pos as bigint) n_pos, cast(n_neg as bigint) n_neg, round(p, 6) p_value from clones")
def fisher_clones(s, d):
    return clones(s, d).select("cdr3_aa", "v_call", "j_call", *big("n_pos", "n_neg"), r6("p_value", "p_value"))


@query(FISHER + " select cdr3_aa, v_call, j_call, threshold from (select *, unnest([0.01, 0.001, 0.0001, 0.00001, 0.000001]::double[]) threshold from clones) where p < threshold")
def diagnostic_set(s, d):
    return association.diagnostic_sets(clones(s, d)).select("cdr3_aa", "v_call", "j_call", "threshold")


NK = FISHER + """, dia as (select *, unnest([0.01, 0.001, 0.0001, 0.00001, 0.000001]::double[]) threshold from clones), dset as (select * from dia where p < threshold),
 nk as (select l.repertoire_id, t.threshold, y, (select count(*) from held h where h.repertoire_id = l.repertoire_id) n,
  (select count(*) from held h join dset using (cdr3_aa, v_call, j_call) where h.repertoire_id = l.repertoire_id and dset.threshold = t.threshold) k from labels l, (select distinct threshold from dset) t)"""


def subjects(s, d) -> DataFrame:
    y = labels(s, d)
    return association.subject_counts(repertoire(s, d), association.diagnostic_sets(clones(s, d)), y).join(y, "repertoire_id")


@query(NK + " select repertoire_id, threshold, n, k from nk")
def subject_n_k(s, d):
    return subjects(s, d).select("repertoire_id", "threshold", *big("n", "k"))


@query(NK + " select threshold, y as label, round(sum(lgamma(k + 2) + lgamma(n - k + 1000) - lgamma(n + 1002)) - count(*) * (lgamma(2.0) + lgamma(1000.0) - lgamma(1002.0)), 4) log_likelihood from nk group by 1, 2")
def betabinom_nll(s, d):
    return association.beta_binomial_nll(subjects(s, d), 2.0, 1000.0, ["threshold", "label"]).select("threshold", "label", F.round("log_likelihood", 4).alias("log_likelihood"))


#: Parameters of each class from its counts by moments: the share is that of all clones, the spread follows the variance.
_MOMENTS = """, mo as (select threshold, y, count(*) m, sum(k) / sum(n) p, avg(n) n, var_pop(k / n) v from nk where n > 0 group by 1, 2),
 ab as (select threshold, y, m, p, greatest(least(coalesce(p * (1 - p) / nullif(greatest(v - p * (1 - p) / n, 0), 0) - 1, 1e6), 1e6), 10.0) s from mo),
 pa as (select threshold, y, m, greatest(p, 1e-6) * s a, (1 - greatest(p, 1e-6)) * s b from ab)"""


@query(NK + _MOMENTS + """ select k.repertoire_id, k.threshold, round(1 / (1 + exp(-(ln(x.m + 1) - ln(z.m + 1) + (lgamma(k + x.a) + lgamma(n - k + x.b) - lgamma(n + x.a + x.b)) - (lgamma(x.a) + lgamma(x.b) - lgamma(x.a + x.b))
 - (lgamma(k + z.a) + lgamma(n - k + z.b) - lgamma(n + z.a + z.b)) + (lgamma(z.a) + lgamma(z.b) - lgamma(z.a + z.b))))), 4) + 0.0 score from nk k join pa x on x.threshold = k.threshold and x.y = 1 join pa z on z.threshold = k.threshold and z.y = 0""")
def betabinom_posterior(s, d):
    """Posterior of every subject and threshold with parameters fitted to the counts by moments (``tuned_beta_binomial`` fits by
    likelihood)."""
    nk = Scratch(s).write(subjects(s, d))
    params = association.beta_binomial_moments(nk, ["threshold", "label"])
    return association.posterior(nk.select("repertoire_id", "threshold", "n", "k"), params, ["threshold"]).select("repertoire_id", "threshold", (F.round("score", 4) + 0.0).alias("score"))


@query(FISHER + " select repertoire_id, cdr3_aa, round(min(coalesce(p, 1.0)), 6) p_value from held left join clones using (cdr3_aa, v_call, j_call) group by 1, 2")
def driver_p_scores(s, d):
    return association.driver_p_scores(repertoire(s, d), clones(s, d)).select("repertoire_id", "cdr3_aa", r6("p_value", "p_value"))


@query(FISHER + " select repertoire_id, cdr3_aa, v_call, j_call from held join clones using (cdr3_aa, v_call, j_call) where p < 0.001")
def presence_matrix(s, d):
    dia = association.diagnostic_sets(clones(s, d), [0.001])
    return association.presence(repertoire(s, d), dia).select("repertoire_id", "cdr3_aa", "v_call", "j_call")


USAGE = f", {LABELS}, u as (select v_call feature, repertoire_id, y, count(*) v from repertoire join labels using (repertoire_id) group by 1, 2, 3)"


@query(USAGE + """, c as (select feature, v, count(*) c, sum(y) p from u group by 1, 2),
 r as (select *, coalesce(sum(c) over (partition by feature order by v rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2 k from c),
 t as (select feature, sum(p * k) R, sum(p) n1, sum(c - p) n0, sum(c) n, sum(c * c * c - c) ties, sum(v * p) / sum(p) m1, sum(v * (c - p)) / sum(c - p) m0 from r group by 1),
 z as (select *, R - n1 * (n1 + 1) / 2 u, n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1))) v from t)
select feature, cast(u as double) u, round(case when v > 0 then (u - n1 * n0 / 2) / sqrt(v) else 0 end, 6) z, round(m1, 6) mean1, round(m0, 6) mean0 from z""")
def mann_whitney(s, d):
    u = repertoire(s, d).join(labels(s, d), "repertoire_id").groupBy(F.col("v_call").alias("feature"), "repertoire_id", "label").agg(F.count("*").alias("v"))
    return association.mann_whitney(u, "feature", "v", "label").select("feature", F.col("u").cast("double").alias("u"), r6("z", "z"), r6("mean1", "mean1"), r6("mean0", "mean0"))


# ---- metrics ---------------------------------------------------------------------------------------------------------

PRED = ", pred as (select specimen_label, participant_label, fold_id fold, cast(disease = 'CMV' as int) y, (cast(substr(specimen_label, 2) as int) * 7919 % 1000) / 1000.0 s, (cast(substr(specimen_label, 2) as int) * 7919 % 10) / 10.0 t from metadata)"


def predictions(s, d, ties: bool = False) -> DataFrame:
    n = F.expr("substring(specimen_label, 2)").cast("int") * 7919
    return metadata(s, d).select("participant_label", "specimen_label", F.col("fold_id").alias("fold"), (F.col("disease") == "CMV").cast("int").alias("disease_label"), (n % (10 if ties else 1000) / (10.0 if ties else 1000.0)).alias("model_score"))


def _auc(col: str, by: str) -> str:
    g = f"{by}, " if by else ""
    return f"(select {g}case when sum(y) > 0 and sum(1 - y) > 0 then (sum(y * k) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) end auroc from (select *, avg(rn) over (partition by {g}{col}) k from (select *, row_number() over ({f'partition by {by} ' if by else ''}order by {col}) rn from pred)) {f'group by {by}' if by else ''})"


def _ap(col: str, by: str) -> str:
    g = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    return f"(select {g}case when sum(p) > 0 then sum(p * cp / cc) / sum(p) end average_precision from (select *, sum(p) over ({part}order by {col} desc) cp, sum(c) over ({part}order by {col} desc) cc from (select {g}{col}, count(*) c, sum(y) p from pred group by {g}{col})) {f'group by {by}' if by else ''})"


@query(PRED + f" select 'fine' as which, fold, round(auroc, 6) auroc from {_auc('s', 'fold')} union all select 'ties', fold, round(auroc, 6) from {_auc('t', 'fold')}")
def auroc(s, d):
    one = lambda t, n: metrics.auroc(predictions(s, d, t), ["fold"]).select(F.lit(n).alias("which"), "fold", r6("auroc", "auroc"))
    return one(False, "fine").unionByName(one(True, "ties"))


@query(PRED + f" select 'fine' as which, fold, round(average_precision, 6) average_precision from {_ap('s', 'fold')} union all select 'ties', fold, round(average_precision, 6) from {_ap('t', 'fold')}")
def average_precision(s, d):
    one = lambda t, n: metrics.average_precision(predictions(s, d, t), ["fold"]).select(F.lit(n).alias("which"), "fold", r6("average_precision", "average_precision"))
    return one(False, "fine").unionByName(one(True, "ties"))


_CONF = "count(*) filter (where s >= 0.5 and y = 1) tp, count(*) filter (where s >= 0.5 and y = 0) fp, count(*) filter (where s < 0.5 and y = 1) fn, count(*) filter (where s < 0.5 and y = 0) tn"
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_BA = "coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0))"


@query(PRED + f" select fold, round({_F1}, 6) f1, round({_BA}, 6) balanced_accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision from (select fold, {_CONF} from pred group by 1)")
def f1_balacc(s, d):
    return metrics.confusion(predictions(s, d), ["fold"]).select("fold", *(r6(c, c) for c in ("f1", "balanced_accuracy", "recall", "precision")))


@query(PRED + f", m as (select fold, auroc, average_precision, {_F1} f1, {_BA} balanced_accuracy from {_auc('s', 'fold')} join {_ap('s', 'fold')} using (fold) join (select fold, {_CONF} from pred group by 1) using (fold)), o as (select auroc, average_precision, {_F1} f1, {_BA} balanced_accuracy from {_auc('s', '')}, {_ap('s', '')}, (select {_CONF} from pred)) select 'x' as method, " + ", ".join(f"round(avg(m.{n}), 6) {n}_mean, round(stddev_pop(m.{n}), 6) {n}_std, round(any_value(o.{n}), 6) {n}_overall" for n in ("auroc", "average_precision", "f1", "balanced_accuracy")) + " from m, o")
def fold_mean_std(s, d):
    out = metrics.fold_summary(predictions(s, d).withColumn("method", F.lit("x")), ["method"])
    return out.select("method", *(r6(f"{n}_{k}", f"{n}_{k}") for n in ("auroc", "average_precision", "f1", "balanced_accuracy") for k in ("mean", "std", "overall")))


HITS = FISHER + """, sc as (select repertoire_id, cdr3_aa, min(coalesce(p, 1.0)) p from held left join clones using (cdr3_aa, v_call, j_call) group by 1, 2),
 rk as (select *, row_number() over (partition by repertoire_id order by p, cdr3_aa) rank from sc), dr as (select distinct repertoire_id, cdr3_aa from held where v_call in ('TRBV1-1*01', 'TRBV2-2*01', 'TRBV3-3*01') and length(cdr3_aa) < 13),
 hits as (select d.repertoire_id, k, d.n n_drivers, z.n, (select count(*) from rk join dr using (repertoire_id, cdr3_aa) where rk.repertoire_id = d.repertoire_id and rank <= k) hits from (select repertoire_id, count(*) n from dr group by 1) d join (select repertoire_id, count(*) n from sc group by 1) z using (repertoire_id), (select unnest([10, 100, 1000]) k))"""


def hits(s, d) -> DataFrame:
    rep = repertoire(s, d)
    drivers = rep.where("v_call in ('TRBV1-1*01', 'TRBV2-2*01', 'TRBV3-3*01') and length(cdr3_aa) < 13").select("repertoire_id", "cdr3_aa").distinct()
    return metrics.ranked_hits(association.driver_p_scores(rep, clones(s, d)).withColumn("p_value", F.round("p_value", 12)), drivers, [10, 100, 1000], "p_value", descending=False)


@query(HITS.replace("min(coalesce(p, 1.0)) p from held", "round(min(coalesce(p, 1.0)), 12) p from held") + " select k, round(avg(hits / n_drivers), 6) macro_recall, round(avg(hits / k), 6) macro_precision, round(sum(hits) / sum(n_drivers), 6) micro_recall, round(sum(hits) / (count(*) * k), 6) micro_precision from hits group by k")
def recall_at_k(s, d):
    return metrics.hit_summary(hits(s, d)).select("k", *(r6(c, c) for c in ("macro_recall", "macro_precision", "micro_recall", "micro_precision")))


@query(HITS + " select k, round(avg(least(k / n, 1.0)), 6) chance_recall from hits group by k")
def chance_recall(s, d):
    return metrics.chance_recall(hits(s, d)).select("k", r6("chance_recall", "chance_recall"))


@query(PRED + " select fold, count(*) n, round(avg(s), 6) mean, round(coalesce(stddev_samp(s) / sqrt(count(*)), 0), 6) standard_error from pred group by 1")
def depth_summary(s, d):
    return metrics.depth_summary(predictions(s, d), ["fold"], "model_score").select("fold", "n", r6("mean", "mean"), r6("standard_error", "standard_error"))


@query(""", u as (select specimen_label, disease own, unnest(['CMV', 'HIV', 'Healthy/Background']) class, unnest([(n * 7919 % 1000) / 1000.0, (n * 104729 % 1000) / 1000.0, (n * 1299709 % 1000) / 1000.0]) s from (select *, cast(substr(specimen_label, 2) as bigint) n from metadata)),
 pred as (select class, cast(own = class as int) y, s from u)""" + f" select class, round(auroc, 6) auroc, round(average_precision, 6) average_precision, round({_F1}, 6) f1 from {_auc('s', 'class')} join {_ap('s', 'class')} using (class) join (select class, {_CONF} from pred group by 1) using (class)")
def one_vs_rest(s, d):
    n = F.expr("substring(specimen_label, 2)").cast("bigint")
    scores = F.create_map(*(x for c, k in (("CMV", 7919), ("HIV", 104729), ("Healthy/Background", 1299709)) for x in (F.lit(c), n * k % 1000 / 1000.0)))
    return metrics.one_vs_rest(metadata(s, d).withColumn("scores", scores), "disease", "scores").select("class", r6("auroc", "auroc"), r6("average_precision", "average_precision"), r6("f1", "f1"))


@query(PRED + ", r as (select s, t, avg(a) over (partition by s) a, avg(b) over (partition by t) b from (select *, row_number() over (order by s) a, row_number() over (order by t) b from pred)) select round(corr(a, b), 6) spearman from r")
def spearman(s, d):
    both = predictions(s, d).join(predictions(s, d, True).select("specimen_label", F.col("model_score").alias("other")), "specimen_label")
    return association.spearman(both, "model_score", "other").select(r6("spearman", "spearman"))


# ---- sampling and cohorts --------------------------------------------------------------------------------------------


@query(""", t as (select *, unnest(range(0, 3)) replicate from repertoire),
 r as (select repertoire_id, row_idx, replicate, row_number() over (partition by repertoire_id, replicate order by md5(concat_ws('-', '7', cast(replicate as varchar), repertoire_id, cast(row_idx as varchar))), row_idx) - 1 pos from t)
select repertoire_id, replicate, depth, count(*) n, cast(sum(row_idx) as bigint) row_sum, cast(max(pos) as bigint) last_pos from (select *, unnest([50, 100, 200, 400]) depth from r) where pos < depth group by 1, 2, 3""")
def depth_nested(s, d):
    out = sampling.nested_depths(repertoire(s, d).select("repertoire_id", "row_idx"), [50, 100, 200, 400], 3)
    return out.groupBy("repertoire_id", F.col("replicate").cast("bigint").alias("replicate"), "depth").agg(F.count("*").alias("n"), F.sum("row_idx").alias("row_sum"), F.max("pos").cast("bigint").alias("last_pos"))


@query("select repertoire_id, row_idx from (select *, row_number() over (partition by repertoire_id order by md5(concat_ws('-', '7', repertoire_id, cast(row_idx as varchar))), row_idx) rn, count(*) over (partition by repertoire_id) n from repertoire) where rn <= round_even(n * 0.1, 0)")
def sample_fraction(s, d):
    return sampling.sample(repertoire(s, d), fraction=0.1).select("repertoire_id", "row_idx")


@query("select repertoire_id, row_idx from (select *, row_number() over (partition by repertoire_id order by -ln((cast('0x' || substr(md5(concat_ws('-', '7', repertoire_id, cast(row_idx as varchar))), 1, 8) as bigint) + 1) / 4294967296.0) / duplicate_count, row_idx) rn from repertoire where duplicate_count > 0) where rn <= 30")
def weighted_sample(s, d):
    return sampling.weighted_sample(repertoire(s, d), 30, "duplicate_count").select("repertoire_id", "row_idx")


@query(""", z as (select repertoire_id, count(*) n from repertoire group by 1),
 p as (select distinct repertoire_id, cast(least(floor((cast('0x' || substr(md5(concat_ws('-', '7', repertoire_id, cast(k as varchar))), 1, 8) as bigint) + 1) / 4294967296.0 * n), n - 1) as int) i from (select *, unnest(range(0, 40)) k from z))
select repertoire_id, row_idx from repertoire join p using (repertoire_id) where row_idx = i""")
def sample_with_replacement(s, d):
    return sampling.sample_with_replacement(repertoire(s, d), 40).select("repertoire_id", "row_idx")


@query(""" select repertoire_id, row_idx, cdr3_aa from
 (select repertoire_id, row_idx, cdr3_aa, row_number() over (partition by repertoire_id order by md5(concat_ws('-', '9', repertoire_id, cast(row_idx as varchar)))) pos from repertoire) where pos <= 60""")
def depth_subset(s, d):
    rep = repertoire(s, d)
    w = Window.partitionBy("repertoire_id").orderBy(sequences.md5_order(9, F.col("repertoire_id"), F.col("row_idx")))
    idx = rep.select("repertoire_id", F.lit(0).alias("replicate"), (F.row_number().over(w) - 1).alias("pos"), "row_idx")
    return sampling.depth_subset(rep.select("repertoire_id", "row_idx", "cdr3_aa"), idx, 60, 0)


@query(""", r as (select specimen_label, disease, row_number() over (partition by case when disease = 'HIV' then null else disease end order by md5('7-' || specimen_label), specimen_label) - 1 r from metadata),
 l as (select cast(sum(n % 2) as bigint) as lead from (select count(*) n from metadata where disease <> 'HIV' group by disease))
select specimen_label, cast(case when disease <> 'HIV' then r % 2 when r < lead then 1 else (r - lead) % 2 end as int) fold from r, l""")
def fold_assign(s, d):
    m = metadata(s, d).select("specimen_label", F.when(F.col("disease") != "HIV", F.col("disease")).alias("disease"))
    return sampling.alternating_folds(m, "disease", "specimen_label").select("specimen_label", F.col("fold").cast("int").alias("fold"))


@query(""", r as (select specimen_label, disease, row_number() over (partition by disease order by md5('7-' || specimen_label), specimen_label) r, count(*) over (partition by disease) n from metadata)
select specimen_label, case when r <= round_even(n * 0.9, 0) then 'train' else 'validation' end as role, cast((r - 1) % 5 as int) cv_fold, case when r <= n - floor(n * 0.25) then 'train' when r <= n - floor(n * 0.25) + ceil(floor(n * 0.25) / 2) then 'validation' else 'test' end three from r""")
def stratified_split(s, d):
    m = metadata(s, d).select("specimen_label", "disease")
    one = sampling.stratified_folds(sampling.stratified_split(m, "disease", "specimen_label"), "disease", "specimen_label")
    three = sampling.three_way_split(m, "disease", "specimen_label").select("specimen_label", F.col("role").alias("three"))
    return one.join(three, "specimen_label").select("specimen_label", "role", "cv_fold", "three")


@query("select specimen_label, outer_fold, case when fold_id = outer_fold then 'test' else 'development' end as role from (select *, unnest([0, 1, 2]) outer_fold from metadata)")
def outer_folds(s, d):
    return sampling.outer_folds(metadata(s, d), "fold_id", [0, 1, 2]).select("specimen_label", "outer_fold", "role")


@query("select specimen_label, fold_id, disease from (select *, row_number() over (partition by fold_id, disease order by specimen_label) r from metadata) where r <= 3")
def head_per_class(s, d):
    return sampling.head_per_class(metadata(s, d), 3, ["fold_id", "disease"], "specimen_label").select("specimen_label", "fold_id", "disease")


TASK = """, task as (select *, cast(disease = 'CMV' as int) y from metadata where disease in ('CMV', 'Healthy/Background')),
 bins as (select floor(age / 10) * 10 bin, sum(y) n1, sum(1 - y) n0 from task where age is not null group by 1 having sum(y) > 0 and sum(1 - y) > 0),
 sh as (select *, n1 / sum(n1) over () share from bins),
 tg as (select *, floor(min(n0 / share) over ()) max_n from sh),
 target as (select bin, max_n, cast(least(round_even(max_n * share, 0), n0) as bigint) target from tg)"""


@query(TASK + """, h as (select *, row_number() over (partition by floor(age / 10) order by md5('7-' || participant_label), participant_label) rank from task where y = 0 and age is not null)
select participant_label, y as label from task where y = 1 or (select coalesce(max(max_n), 0) from target) <= 0 or participant_label in (select participant_label from h join target on floor(age / 10) * 10 = bin where rank <= target)""")
def age_match(s, d):
    return cohorts.age_match(cohorts.binary_task(metadata(s, d), "CMV")).select("participant_label", "label")


@query(TASK + " select participant_label, y as label, random_baseline_seed from (select *, row_number() over (partition by random_baseline_seed, y order by md5(concat_ws('-', cast(random_baseline_seed as varchar), participant_label)), participant_label) rank from (select *, unnest([7, 14, 21, 28, 35]) random_baseline_seed from task)), (select coalesce(max(max_n), 0) max_n from target) where y = 1 or rank <= max_n or max_n <= 0")
def random_controls(s, d):
    return cohorts.random_controls(cohorts.binary_task(metadata(s, d), "CMV")).select("participant_label", "label", "random_baseline_seed")


@query(""", a as (select disease, 'sex' what, unnest(['F', 'M', 'Unknown']) as value, unnest([count(*) filter (where sex = 'F'), count(*) filter (where sex = 'M'), count(*) filter (where sex is null)]) n from metadata group by 1),
 b as (select disease, 'ancestry' what, coalesce(ancestry, 'Unknown') as value, count(*) n from metadata group by 1, 3),
 c as (select disease, 'age_bin' what, cast(cast(floor((age - least) / 5) as bigint) as varchar) as value, count(*) n from (select *, min(age) over (partition by disease) least from metadata where age is not null) group by 1, 3)
select * from a union all select * from b union all select * from c""")
def demographic_counts(s, d):
    return cohorts.demographic_counts(metadata(s, d))


@query(" select disease, ancestry, count(*) n from metadata where age between 25 and 70 and sex = 'F' group by 1, 2")
def demographic_filter(s, d):
    m = cohorts.demographic_filter(metadata(s, d), sex="F", age_min=25, age_max=70)
    return m.groupBy("disease", "ancestry").agg(F.count("*").alias("n"))


@query(" select specimen_label from metadata where age is not null and sex is not null and ancestry is not null and trim(ancestry) <> ''")
def complete_cases(s, d):
    return cohorts.complete_cases(metadata(s, d), ["age", "sex", "ancestry"]).select("specimen_label")


@query(""", p as (select 'a' cohort, participant_label, cast(disease = 'CMV' as int) y from metadata where fold_id < 2 union all select 'b', participant_label, cast(disease = 'CMV' as int) from metadata where fold_id > 0)
select participant_label, count(distinct cohort) n_cohorts from p group by 1 having count(distinct cohort) > 1""")
def cohort_id_clashes(s, d):
    m = metadata(s, d)
    return cohorts.id_clashes(cohorts.pool({"a": m.where("fold_id < 2"), "b": m.where("fold_id > 0").drop("age")}))


@query(" select cohort, n1, n0, case when n1 = 0 and n0 = 0 then 'empty' when n1 = 0 or n0 = 0 then 'one class' else 'ok' end status from (select cohort, count(*) filter (where y = 1) n1, count(*) filter (where y = 0) n0 from (select 'a' cohort, cast(disease = 'CMV' as int) y from metadata where fold_id < 2 union all select 'b', cast(disease = 'CMV' as int) from metadata where disease = 'HIV') group by 1)")
def pool_cohorts(s, d):
    m = metadata(s, d).withColumn("label", (F.col("disease") == "CMV").cast("int"))
    return cohorts.class_checks(cohorts.pool({"a": m.where("fold_id < 2"), "b": m.where("disease = 'HIV'").drop("age")}))


@query(""", a as (select specimen_label, disease d1, fold_id f1 from metadata where fold_id < 2),
 b as (select specimen_label, case when age > 70 then 'HIV' else disease end d2, fold_id f2 from metadata where sex is not null),
 j as (select a.specimen_label l, b.specimen_label r, d1, d2, f1, f2 from a full join b on a.specimen_label = b.specimen_label)
select count(*) filter (where l is not null and r is not null and d1 is distinct from d2) n_disease, count(*) filter (where l is not null and r is not null and f1 is distinct from f2) n_fold, count(*) filter (where r is null) n_left_only, count(*) filter (where l is null) n_right_only from j""")
def metadata_agreement(s, d):
    m = metadata(s, d)
    return cohorts.agreement(m.where("fold_id < 2"), m.where("sex is not null").withColumn("disease", F.when(F.col("age") > 70, "HIV").otherwise(F.col("disease"))))


@query(""", p as (select concat('P', cast(cast(substr(participant_label, 2) as int) // 3 as varchar)) participant_label, specimen_label, disease, fold_id from metadata),
 q as (select participant_label k, count(distinct disease) d, count(distinct fold_id) f from p group by 1)
select k as key, 'diseases' what, d n from q where d > 1 union all select k, 'folds', f from q where f > 1""")
def uniqueness_checks(s, d):
    m = metadata(s, d).withColumn("participant_label", F.concat(F.lit("P"), F.expr("cast(substring(participant_label, 2) as int) div 3").cast("string")))
    return cohorts.uniqueness_violations(m).select("key", "what", *big("n"))


@query(", p as (select cast(substr(participant_label, 2) as int) // 3 g from metadata) select n_specimens, count(*) n_participants from (select g, count(*) n_specimens from p group by 1) group by 1")
def specimens_histogram(s, d):
    m = metadata(s, d).withColumn("participant_label", F.expr("cast(substring(participant_label, 2) as int) div 3"))
    return cohorts.specimens_per_participant(m)


# ---- similarity ------------------------------------------------------------------------------------------------------

TRUTH = """, truth as (select row_number() over (order by cdr3_aa) - 1 gt_idx, cdr3_aa, v_call, j_call, score from (select cdr3_aa, min(v_call) v_call, min(j_call) j_call, cast(count(*) as int) score from (select case when length(cdr3_aa) > 11 then left(cdr3_aa, 4) || 'W' || substr(cdr3_aa, 6) else cdr3_aa end cdr3_aa, v_call, j_call from repertoire where duplicate_count = 50) group by 1))"""


def truth(s, d) -> DataFrame:
    rep = repertoire(s, d).where("duplicate_count = 50")
    edited = F.when(F.length("cdr3_aa") > 11, F.concat(F.substring("cdr3_aa", 1, 4), F.lit("W"), F.expr("substring(cdr3_aa, 6)"))).otherwise(F.col("cdr3_aa"))
    t = rep.withColumn("cdr3_aa", edited).groupBy("cdr3_aa").agg(F.min("v_call").alias("v_call"), F.min("j_call").alias("j_call"), F.count("*").cast("int").alias("score"))
    return numbered(t, ["cdr3_aa"], "gt_idx")


@query(TRUTH + """, f as (select repertoire_id, cdr3_aa, arg_min(v_call, row_idx) v, arg_min(j_call, row_idx) j from repertoire group by 1, 2),
 u as (select distinct cdr3_aa from repertoire),
 m as (select u.cdr3_aa a, t.*, 1 - levenshtein(u.cdr3_aa, t.cdr3_aa) / greatest(length(u.cdr3_aa), length(t.cdr3_aa)) sim from u, truth t),
 b as (select *, row_number() over (partition by a order by sim desc, gt_idx) rn from m where sim >= 0.9)
select repertoire_id, a sample_cdr3, v sample_vgene, j sample_jgene, b.cdr3_aa public_clone_cdr3, v_call public_clone_vgene, j_call public_clone_jgene, round(sim, 6) similarity, score from f join b on f.cdr3_aa = b.a where rn = 1""")
def driver_match(s, d):
    out = similarity.driver_matches(repertoire(s, d), truth(s, d))
    return out.withColumn("similarity", F.round("similarity", 6))


@query(TRUTH + """, u as (select distinct cdr3_aa from repertoire),
 m as (select distinct u.cdr3_aa from u, truth t where 1 - levenshtein(u.cdr3_aa, t.cdr3_aa) / greatest(length(u.cdr3_aa), length(t.cdr3_aa)) >= 0.9),
 n as (select repertoire_id, count(distinct r.cdr3_aa) n from repertoire r join m using (cdr3_aa) group by 1)
select disease, count(*) specimens, round(avg(coalesce(n, 0)), 6) mean, max(coalesce(n, 0)) most from metadata left join n on repertoire_id = specimen_label group by 1""")
def driver_counts(s, d):
    n = similarity.driver_matches(repertoire(s, d), truth(s, d)).groupBy(F.col("repertoire_id").alias("specimen_label")).agg(F.countDistinct("sample_cdr3").alias("n"))
    z = cohorts.zero_filled(metadata(s, d), n, "specimen_label", "n")
    return z.groupBy("disease").agg(F.count("*").alias("specimens"), r6(F.avg("n"), "mean"), F.max("n").alias("most"))


def _phase_sql(s: str) -> str:
    """Six phase sums of the Atchley factors in SQL."""
    table = "map {" + ", ".join(f"'{k}': {v}" for k, v in sequences.ATCHLEY.items()) + "}"
    core = f"substr({s}, 4, length({s}) - 5)"
    parts = []
    for p in range(6):
        for f in range(1, 6):
            parts.append(f"list_sum(list_prepend(0.0::double, list_transform(list_filter(range(1, length({core}) + 1), lambda i: (length({core}) - i + 1) % 6 = {p}), lambda i: ({table})[substr({core}, i, 1)][{f}]::double)))")
    return f"[{', '.join(parts)}]"


CODES = f", own as (select distinct cdr3_aa from repertoire), code as materialized (select cdr3_aa, length(cdr3_aa) len, {_phase_sql('cdr3_aa')} code from own)"


def coded(s, d) -> DataFrame:
    return similarity.encoded(repertoire(s, d), sequences.ATCHLEY)


@query(CODES + " select cdr3_aa, len, round(list_sum(list_transform(code, lambda x: x * x)), 6) norm from code")
def isometric_codes(s, d):
    return coded(s, d).select("cdr3_aa", "len", F.round(sequences.squared_distance(F.col("code"), F.array_repeat(F.lit(0.0), 30)), 6).alias("norm"))


@query(CODES + """, p as (select a.cdr3_aa a, b.cdr3_aa b, a.len, list_sum(list_transform(range(1, 31), lambda i: (a.code[i] - b.code[i]) * (a.code[i] - b.code[i]))) dist from code a join code b on a.len = b.len and a.cdr3_aa <> b.cdr3_aa)
select a, b, len, round(dist, 6) distance from p where dist <= 40 - 0.5 * (15 - len)""")
def isometric_pairs(s, d):
    own = coded(s, d)
    return similarity.isometric_pairs(own, own, 30, 40.0).select("a", "b", "len", F.round("distance", 6).alias("distance"))


@query(CODES + """, p as (select a.cdr3_aa a, b.cdr3_aa b, round(list_sum(list_transform(range(1, 31), lambda i: (a.code[i] - b.code[i]) * (a.code[i] - b.code[i]))), 9) dist, a.len from code a join code b on a.len = b.len and a.cdr3_aa <> b.cdr3_aa)
select a, min(struct_pack(d := dist, b := b)).b b, round(min(dist), 6) distance from p where dist <= 40 - 0.5 * (15 - len) group by 1""")
def isometric_nearest(s, d):
    own = coded(s, d)
    pairs = similarity.isometric_pairs(own, own, 30, 40.0, nearest_only=True).withColumn("distance", F.round("distance", 9))
    return similarity.nearest(pairs).select("a", "b", F.round("distance", 6).alias("distance"))


@query(", e as (select distinct v_call a, j_call b from repertoire where duplicate_count = 50), n as (select a x, b y from e union select b, a from e), r(node, root) as (select x, x from n union select n.y, r.root from r join n on n.x = r.node where r.root < n.y) select node, min(root) component from r group by 1".replace("select node, min(root) component from r group by 1", "select node, least(node, min(root)) component from r group by 1"))
def gene_components(s, d):
    e = repertoire(s, d).where("duplicate_count = 50").select("v_call", "j_call").distinct()
    return components(e, "v_call", "j_call")


@query(f", {LABELS}, c as (select cdr3_aa as cluster, count(*) n, avg(y) f from repertoire join labels using (repertoire_id) group by 1) select cluster, n, round(f, 6) fraction from c where n <= 100")
def cluster_disease_fraction(s, d):
    c = repertoire(s, d).select("repertoire_id", F.col("cdr3_aa").alias("cluster"))
    return similarity.cluster_disease_fraction(c, labels(s, d)).where("not excluded").select("cluster", "n", r6("fraction", "fraction"))


SPECIMEN_SCORE = f"""
, {LABELS},
 own as (select repertoire_id, left(cdr3_aa, 3) as cluster, fold_id from repertoire join metadata on repertoire_id = specimen_label),
 c as (select cluster, count(*) n, avg(y) f from own join labels using (repertoire_id) where fold_id < 2 group by 1),
 sc as (select repertoire_id, avg(coalesce(f, 0)) s from own left join c using (cluster) where fold_id = 2 and coalesce(n, 0) <= 100 group by 1)
select specimen_label repertoire_id, round(coalesce(s, 0), 6) score from metadata left join sc on repertoire_id = specimen_label where fold_id = 2
"""


@query(SPECIMEN_SCORE)
def specimen_score(s, d):
    """Fold 2 scored by the clusters of the other folds; rows of clusters of over 100 reference rows do not count."""
    meta = metadata(s, d).select(F.col("specimen_label").alias("repertoire_id"), "fold_id")
    own = repertoire(s, d).select("repertoire_id", F.expr("left(cdr3_aa, 3)").alias("cluster")).join(meta, "repertoire_id")
    fractions = similarity.cluster_disease_fraction(own.where("fold_id < 2"), labels(s, d))
    return similarity.specimen_scores(own.where("fold_id = 2"), fractions, meta.where("fold_id = 2")).select("repertoire_id", r6("score", "score"))


SHARES = ", sh as (select repertoire_id, v_call as cluster, count(*) / sum(count(*)) over (partition by repertoire_id) share from repertoire group by 1, 2)"


def shares(s, d) -> DataFrame:
    n = repertoire(s, d).groupBy("repertoire_id", F.col("v_call").alias("cluster")).agg(F.count("*").alias("n"))
    return n.select("repertoire_id", "cluster", (F.col("n") / F.sum("n").over(Window.partitionBy("repertoire_id"))).alias("share"))


DISTANCES = SHARES + """
, ids as (select distinct repertoire_id i from sh), cl as (select distinct cluster from sh),
 full_ as materialized (select i, cl.cluster, coalesce(share, 0) p, row_number() over (partition by i order by coalesce(share, 0) desc, cl.cluster) r from ids cross join cl left join sh on repertoire_id = i and sh.cluster = cl.cluster),
 g as (select x.i a, y.i b, x.p + 1e-9 p, y.p + 1e-9 q from full_ x join full_ y on x.cluster = y.cluster and x.i < y.i),
 w as (select x.i a, y.i b, avg(abs(x.p - y.p)) wasserstein from full_ x join full_ y on x.r = y.r and x.i < y.i group by 1, 2),
 d as (select a, b, sqrt(sum((p - q) * (p - q))) euclidean, sum((p - q) * ln(p / q)) symmetric_kl, sqrt(greatest(0, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2)) jensen_shannon, 1 - corr(p, q) correlation from g group by 1, 2)
"""


@query(DISTANCES + "select a, b, round(euclidean, 6) euclidean, round(symmetric_kl, 6) symmetric_kl, round(jensen_shannon, 6) jensen_shannon, round(correlation, 6) correlation, round(wasserstein, 9) wasserstein from d join w using (a, b)")
def repertoire_distance(s, d):
    return similarity.repertoire_distances(shares(s, d)).select("a", "b", *(r6(c, c) for c in ("euclidean", "symmetric_kl", "jensen_shannon", "correlation")), F.round("wasserstein", 9).alias("wasserstein"))


@query("select length(cdr3_aa) len, cdr3_aa, v_call, count(*) n_rows, count(distinct repertoire_id) n_repertoires, count(*) > 1 duplicate from repertoire where length(cdr3_aa) between 10 and 24 group by 1, 2, 3")
def unique_by_length(s, d):
    return similarity.unique_by_length(repertoire(s, d))


@query(""", own as (select distinct cdr3_aa s from repertoire),
 m as (select s, length(s) len, i, substr(substr(s, 4, length(s) - 5), i, 5) mer from (select s, unnest(range(1, length(s) - 8)) i from own)),
 k as (select s, len, i, left(mer, j) || '?' || substr(mer, j + 2) w from (select *, unnest(range(0, 5)) j from m)),
 p as (select distinct a.s a, b.s b, a.i from k a join k b on a.len = b.len and a.w = b.w and a.s < b.s)
select a, b, count(*) shared from p group by 1, 2 having count(*) >= 1""")
def kmer_share_edges(s, d):
    return similarity.kmer_share_edges(repertoire(s, d), 1)


@query(f", c as (select repertoire_id, cdr3_aa, substr(cdr3_aa, 4, length(cdr3_aa) - 6) core from repertoire), x as (select repertoire_id, substr(core, i, 4) w from (select *, unnest(range(1, length(core) - 2)) i from c)), v as (select repertoire_id, w, list_transform(range(1, 5), lambda i: (map {{{', '.join(f"'{k}': {v}" for k, v in sequences.ATCHLEY.items())}}})[substr(w, i, 1)]) r from x) select repertoire_id, round(max(1 / (1 + exp(-(0.1 + list_sum(list_transform(range(1, 5), lambda i: 0.3 * r[i][1]::double - 0.2 * r[i][5]::double)))))), 6) score from v group by 1")
def mil_score(s, d):
    from ..operators import learners

    rep = repertoire(s, d)
    bags = rep.select("repertoire_id", F.explode(sequences.windows(sequences.core(F.col("cdr3_aa")), 4)).alias("w")).select("repertoire_id", sequences.atchley(F.col("w")).alias("x")).where("x is not null")
    subjects_ = rep.select("repertoire_id").distinct()
    return learners.mil_scores(bags, [0.3, 0.0, 0.0, 0.0, -0.2] * 4, 0.1, subjects_).select("repertoire_id", r6("score", "score"))


@query(""" select repertoire_id, row_idx, round(1 - levenshtein(cdr3_aa, o) / greatest(length(cdr3_aa), length(o)), 6) sim from
 (select repertoire_id, row_idx, cdr3_aa, lead(cdr3_aa) over (partition by repertoire_id order by row_idx) o from repertoire) where o is not null""")
def sequence_similarity(s, d):
    rep = repertoire(s, d).select("repertoire_id", "row_idx", "cdr3_aa")
    other = rep.select("repertoire_id", (F.col("row_idx") - 1).alias("row_idx"), F.col("cdr3_aa").alias("o"))
    return rep.join(other, ["repertoire_id", "row_idx"]).select("repertoire_id", "row_idx", r6(sequences.similarity(F.col("cdr3_aa"), F.col("o")), "sim"))
