"""Registered queries of fitted models, cohort construction and streams; SQL where the result has an SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genes, sequences
from ..operators import association, boosting, cleaning, cohorts, features, learners, metrics, sampling, similarity
from ..scratch import Scratch, folder, numbered
from ..streaming.ingest import ingest
from .fixtures import metadata, raw, repertoire, table
from .queries import LABELS, STEPS, big, labels, predictions, query, r6, shares


def _long_and_rows(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V/J usage, and the task's specimens split 80 : 20 by class."""
    rows = sampling.stratified_split(labels(s, d), "label", "repertoire_id", 0.8)
    return features.gene_usage(repertoire(s, d)), rows.where("role = 'train'").drop("role"), rows.where("role <> 'train'").drop("role")


def _kmers(s, d) -> DataFrame:
    rep = repertoire(s, d).join(labels(s, d).select("repertoire_id"), "repertoire_id", "left_semi")
    return features.kmer_frequencies(rep, 3)


@query()
def gene_usage_classifier(s, d):
    """L1 logistic regression on V/J usage with C by cross-validation; test probabilities from the coefficient table."""
    long, train, test = _long_and_rows(s, d)
    long = Scratch(s).write(long)
    _, table_, _ = _l1_model(s, long, train, learners.GENE_C)
    return learners.predict_long(long, table_, test)


def _l1_model(s, long, train, grid, label="label"):
    """(C, coefficient table, deviations) of the L1 model whose C cross-validation chose; the tables are written once."""
    scratch = Scratch(s)
    scaled = scratch.write(learners.scales(long, learners.feature_index(long, train), train))
    v = scratch.write(learners.vectors(long, scaled, train))
    c = learners.choose_c(v, grid, label=label)
    weights = scratch.write(learners.coefficient_table(s, learners.l1_logistic(v, c, v.count(), label), scaled))
    return c, weights, scaled


def _ensemble(s, d):
    """Both models of the ensemble and their validation scores: (alpha, blended scores, k-mer weights, V/J weights)."""
    long, train, test = _long_and_rows(s, d)
    out, tables = [], []
    for features_, grid in ((Scratch(s).write(_kmers(s, d)), learners.KMER_C), (Scratch(s).write(long), learners.GENE_C)):
        _, weights, _ = _l1_model(s, features_, train, grid)
        out.append(learners.predict_long(features_, weights, test))
        tables.append(weights)
    return *learners.blend(*out), *tables


@query()
def ensemble_weights(s, d):
    """The k-mer and V/J models, C of each by cross-validation, blended with the alpha of best validation AUROC."""
    return _ensemble(s, d)[1]


@query()
def selected_features(s, d):
    long, train, _ = _long_and_rows(s, d)
    scratch = Scratch(s)
    long, train = scratch.write(long), scratch.write(train)
    scaled = scratch.write(learners.scales(long, learners.feature_index(long, train), train))
    model = learners.l1_logistic(learners.vectors(long, scaled, train), 1.0, train.count())
    return long.join(learners.coefficient_table(s, model, scaled).where("feature <> ''"), "feature").select("repertoire_id", "feature", "value", "weight")


@query()
def sequence_scores(s, d):
    """Largest ensemble decision of each repertoire's CDR3s: k-mer and V/J models with the alpha of the sweep."""
    alpha, _, kmer, gene = _ensemble(s, d)
    return learners.sequence_decisions(repertoire(s, d), kmer, gene, alpha, 3)


#: Weights by rule, in place of a fitted model's, so that another engine can follow the scoring.
_WEIGHT = "case when substr(md5(feature), 1, 1) < '5' then round((instr('0123456789abcdef', substr(md5(feature), 2, 1)) - 8) * 0.01, 4) else 0.0 end"


@query(f""", u as (select distinct repertoire_id, cdr3_aa, v_call, j_call from repertoire),
 x as (select distinct cdr3_aa from u),
 w as (select cdr3_aa, substr(cdr3_aa, i, 4) m from (select cdr3_aa, unnest(range(1, length(cdr3_aa) - 2)) i from x)),
 k as (select cdr3_aa, unnest([m, '_' || substr(m, 2), substr(m, 1, 1) || '_' || substr(m, 3), substr(m, 1, 2) || '_' || substr(m, 4), substr(m, 1, 3) || '_']) feature from w),
 z as (select cdr3_aa, sum({_WEIGHT}) z from k group by 1),
 g as (select v_call, j_call, (select {_WEIGHT} from (select 'V:' || v_call feature)) + (select {_WEIGHT} from (select 'J:' || j_call feature)) y from (select distinct v_call, j_call from u))
select repertoire_id, cdr3_aa, round(max(0.3 * (z - 0.25) + 0.7 * (y + 0.125)), 6) + 0.0 score from u join z using (cdr3_aa) join g using (v_call, j_call) group by 1, 2""")
def sequence_decisions(s, d):
    """Decisions of all sequences by two tables of weights, k-mers with blanks and genes."""
    rep = repertoire(s, d)

    def weighted(names, intercept):
        table_ = names.distinct().select("feature", F.expr(_WEIGHT).cast("double").alias("weight"))
        return table_.unionByName(s.createDataFrame([("", intercept)], "feature string, weight double"))

    kmer = weighted(rep.select("cdr3_aa").distinct().select(F.explode(sequences.gapped_kmers(F.col("cdr3_aa"))).alias("feature")), -0.25)
    gene = weighted(rep.select("v_call", "j_call").distinct().select(F.explode(F.array(F.concat(F.lit("V:"), "v_call"), F.concat(F.lit("J:"), "j_call"))).alias("feature")), 0.125)
    out = learners.sequence_decisions(rep, kmer, gene, 0.3)
    return out.select("repertoire_id", "cdr3_aa", (F.round("score", 6) + 0.0).alias("score"))


@query(f", {LABELS}, u as (select 'V:' || v_call f from repertoire join labels using (repertoire_id) union select 'J:' || j_call from repertoire join labels using (repertoire_id) union select '') select f feature, true optimal from u")
def logistic_optimality(s, d):
    """Of every feature, whether the fitted L1 model on V/J usage (C = 1, all labelled repertoires) meets the conditions of its
    optimum, told from the table of its coefficients."""
    long, rows = Scratch(s).write(features.gene_usage(repertoire(s, d))), Scratch(s).write(labels(s, d))
    scaled = Scratch(s).write(learners.scales(long, learners.feature_index(long, rows), rows))
    n = rows.count()
    model = learners.l1_logistic(learners.vectors(long, scaled, rows), 1.0, n, tol=1e-10, steps=2000)
    off = learners.optimality(long, rows, learners.coefficient_table(s, model, scaled), scaled, 1.0)
    return off.select("feature", (F.col("excess") < 2e-3).alias("optimal"))


@query()
def boosted_tree_classifier(s, d):
    """Boosted trees on V/J usage at one setting; every fifth training repertoire of a class decides when to stop."""
    long, train, test = map(Scratch(s).write, _long_and_rows(s, d))
    held = sampling.stratified_split(train, "label", "repertoire_id", 0.8, seed=11)
    part = lambda role: held.where(role).drop("role")
    model = boosting.fitted(long, part("role = 'train'"), part("role <> 'train'"), depth=3, step=0.1)
    return boosting.predict(long, boosting.tree_table(s, model), test)


@query()
def tuned_boosted_trees(s, d):
    """Boosted trees on V/J usage, both grids (16 and 27 settings in three folds, 129 fits) and early stopping."""
    long, train, test = map(Scratch(s).write, _long_and_rows(s, d))
    held = sampling.stratified_split(train, "label", "repertoire_id", 0.8, seed=11)
    part = lambda role: held.where(role).drop("role")
    model, _ = boosting.tuned(long, part("role = 'train'"), part("role <> 'train'"))
    return boosting.predict(long, boosting.tree_table(s, model), test)


@query()
def mil_classifier(s, d):
    """Multiple-instance model on Atchley-encoded 4-mers with log abundance, 200 restarts in one job a step, 40 steps at most."""
    f = features.fourmer_abundance(repertoire(s, d))
    bags = f.select("repertoire_id", F.concat(sequences.atchley(F.col("fourmer")), F.array("log_sum")).alias("x")).where("x is not null")
    y = labels(s, d)
    w, b, _ = learners.mil_fit(bags, y, steps=40)
    return learners.mil_scores(bags, w.tolist(), b, y)


@query()
def tuned_beta_binomial(s, d):
    """Clones, diagnostic sets and beta-binomial fits for all thresholds in one job each; scores at the best threshold."""
    rows = Scratch(s).write(sampling.three_way_split(labels(s, d), "label", "repertoire_id"))
    train, held = rows.where("role = 'train'").drop("role"), association.clones_held(repertoire(s, d))
    tested = association.fisher_greater(Scratch(s).write(association.incidence(held, train, distinct=True)), train)
    dia = Scratch(s).write(association.diagnostic_sets(tested))
    nk = Scratch(s).write(association.subject_counts(held, dia, rows.select("repertoire_id"), distinct=True))
    return association.tuned_posterior(nk, rows)[1].where("role = 'test'").select("repertoire_id", "label", "score")


@query(f", {LABELS}, c as (select specimen_label repertoire_id, coalesce(age, 40.0) x from metadata), u as (select repertoire_id, v_call f, count(*) n, sum(count(*)) over (partition by repertoire_id) t from repertoire group by 1, 2), g as (select repertoire_id, x, f, coalesce(n / t, 0) y from c cross join (select distinct f from u) left join u using (repertoire_id, f)), r as (select f, regr_slope(y, x) b, regr_intercept(y, x) a from g group by 1) select repertoire_id, 'V:' || f feature, round(y - a - b * x, 6) + 0.0 as value from g join r using (f)")
def residualized_usage(s, d):
    """V usage minus its least-squares fit on age."""
    cov = metadata(s, d).select(F.col("specimen_label").alias("repertoire_id"), F.coalesce("age", F.lit(40.0)).alias("c_age"))
    usage = features.gene_usage(repertoire(s, d)).where("feature like 'V:%'")
    return learners.residualized(usage, cov, cov, ["c_age"]).select("repertoire_id", "feature", (F.round("value", 6) + 0.0).alias("value"))


@query()
def covariate_adjusted_classifier(s, d):
    """Usage residualized on age, sex, ancestry and missingness, then an L1 model, C by cross-validation."""
    long, train, test = _long_and_rows(s, d)
    meta = metadata(s, d)
    ancestry = learners.ancestry_columns(meta, ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
    names = ["c_age", "c_age_missing", "c_sex_m", "c_sex_unknown", *ancestry]
    mean = meta.agg(F.avg("age")).first()[0]
    cov = learners.demographic_features(meta, mean).withColumns(ancestry).select(F.col("specimen_label").alias("repertoire_id"), *names)
    scratch = Scratch(s)
    long = scratch.write(long)
    fitted = scratch.write(numbered(learners.residual_fit(long, cov, train, names), ["feature"], "id").withColumn("id", F.col("id").cast("int")))
    v = scratch.write(learners.residual_vectors(long, fitted, train, cov, names)).persist()
    c = learners.choose_c(v, learners.GENE_C)
    weights = learners.coefficient_table(s, learners.l1_logistic(v, c, v.count()), fitted)
    v.unpersist()
    return learners.predict_residuals(long, weights, fitted, test, cov, names)


@query(f", {LABELS}, c as (select specimen_label repertoire_id, coalesce(age, 40.0) x from metadata), u as (select repertoire_id, v_call f, count(*) n, sum(count(*)) over (partition by repertoire_id) t from repertoire group by 1, 2), g as (select repertoire_id, x, f, coalesce(n / t, 0) y from c cross join (select distinct f from u) left join u using (repertoire_id, f)), r as (select f, regr_slope(y, x) b, regr_intercept(y, x) a, {_WEIGHT.replace('feature', "('V:' || f)")} w from g group by 1) select repertoire_id, round(1 / (1 + exp(-(0.25 + sum(40 * w * (y - a - b * x))))), 6) + 0.0 score from g join r using (f) group by 1")
def residual_decisions(s, d):
    """Scores of all specimens by a table of weights on V usage less its fit on age, without making residuals."""
    cov = metadata(s, d).select(F.col("specimen_label").alias("repertoire_id"), F.coalesce("age", F.lit(40.0)).alias("c_age"))
    scratch = Scratch(s)
    usage = scratch.write(features.gene_usage(repertoire(s, d)).where("feature like 'V:%'"))
    fitted = scratch.write(learners.residual_fit(usage, cov, cov, ["c_age"]))
    weights = fitted.select("feature", (40 * F.expr(_WEIGHT)).cast("double").alias("weight")).unionByName(s.createDataFrame([("", 0.25)], "feature string, weight double"))
    out = learners.predict_residuals(usage, weights, fitted, cov.select("repertoire_id"), cov, ["c_age"])
    return out.select("repertoire_id", (F.round("score", 6) + 0.0).alias("score"))


@query()
def demographic_classifier(s, d):
    """Age, sex, ancestry and missingness alone: L2 logistic regression, C by validation AUROC, scores of the test rows."""
    meta = metadata(s, d)
    ancestry = learners.ancestry_columns(meta, ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
    cols = ["c_age", "c_age_missing", "c_sex_m", "c_sex_unknown", *ancestry]
    task = learners.demographic_features(cohorts.complete_cases(cohorts.binary_task(meta, "CMV"), any_of=["age", "sex"]), meta.agg(F.avg("age")).first()[0]).withColumns(ancestry)
    split = sampling.three_way_split(task, "label", "specimen_label").persist()
    part = lambda role: split.where(F.col("role") == role).drop("role")
    _, scored = learners.demographic_model(part("train"), part("validation"), cols)
    return scored(part("test")).select("specimen_label", "label", "score")


@query()
def vector_clusters(s, d):
    """k-means on a sample of the vectors, all rows assigned."""
    return learners.kmeans_clusters(table(s, d, "embeddings"), "embedding", 10, sample=0.5).select("vec_id", "cluster")


@query("select vec_id % 20 as shard, count(*) n from embeddings group by 1", plain=True)
def vector_shards(s, d):
    return table(s, d, "embeddings").groupBy((F.col("vec_id") % 20).alias("shard")).agg(F.count("*").alias("n"))


@query(", " + LABELS + """, sh as (select repertoire_id, v_call as cluster, count(*) / sum(count(*)) over (partition by repertoire_id) share from repertoire group by 1, 2),
 ids as (select distinct repertoire_id i from sh),
 cl as (select distinct cluster from sh),
 g as (select a.i a, b.i b, coalesce(x.share, 0) p, coalesce(y.share, 0) q from ids a join ids b on a.i <> b.i cross join cl left join sh x on x.repertoire_id = a.i and x.cluster = cl.cluster left join sh y on y.repertoire_id = b.i and y.cluster = cl.cluster),
 e as (select a, b, round(sqrt(sum((p - q) * (p - q))), 9) dist from g group by 1, 2),
 t as (select *, row_number() over (partition by a order by dist, b) k from e)
select a, round(sum(y / (dist + 1e-9)) / sum(1 / (dist + 1e-9)), 6) score from t join labels on b = repertoire_id where k <= 5 group by 1""")
def knn_repertoires(s, d):
    """5-nearest-repertoire vote on usage distance."""
    near = similarity.nearest_repertoires(shares(s, d), 5)
    return similarity.weighted_vote(near, labels(s, d), 5, "euclidean").select("a", r6("score", "score"))


@query("select vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * embedding[i]::double))), 4) norm from embeddings", plain=True)
def vector_norms(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(sequences.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


@query(", " + LABELS + " select round(count(*) filter (where y = 0) / greatest(count(*) filter (where y = 1), 1), 6) positive_weight from labels")
def class_weight(s, d):
    return learners.class_weight(labels(s, d)).select(r6("positive_weight", "positive_weight"))


@query(" select specimen_label, role from (select specimen_label, 'train' as role from metadata where fold_id = 0 union all select specimen_label, 'test' from metadata where fold_id = 1)")
def transfer_set(s, d):
    m = metadata(s, d)
    return cohorts.transfer_set(m.where("fold_id = 0"), m.where("fold_id = 1")).select("specimen_label", "role")


@query(""", m as (select * from metadata where disease in ('CMV', 'Healthy/Background')),
 p as (select specimen_label, (cast(substr(specimen_label, 2) as int) * 7919 % 1000) / 1000.0 s from metadata where fold_id > 0)
select disease, count(s) scored, count(*) - count(s) unscored, round(avg(s), 6) mean_score from m left join p using (specimen_label) group by 1""")
def score_attach(s, d):
    meta = cohorts.binary_task(metadata(s, d), "CMV")
    scores = predictions(s, d).where("fold > 0").select("specimen_label", "model_score")
    have, lack = cohorts.attach_scores(meta, scores, "specimen_label")
    both = have.select("disease", "model_score").unionByName(lack.select("disease").withColumn("model_score", F.lit(None).cast("double")))
    return both.groupBy("disease").agg(F.count("model_score").alias("scored"), F.count_if(F.col("model_score").isNull()).alias("unscored"), r6(F.avg("model_score"), "mean_score"))


#: One codon for each residue: the first of the standard code.
_CODON = {r: next(c for c, x in sequences.CODONS.items() if x == r) for r in sequences.RESIDUES}


@query(f""", n as (select repertoire_id, row_idx, 'AAA' || array_to_string(list_transform(string_split(cdr3_aa, ''), lambda c: map {{{", ".join(f"'{r}': '{c}'" for r, c in _CODON.items())}}}[c]), '') || case when row_idx % 5 = 0 then 'N' else '' end || 'CCC' nt,
  substr(cdr3_aa, 1, length(cdr3_aa) - case when row_idx % 7 = 0 then 1 else 0 end) aa from repertoire),
 t as (select *, substr(nt, 4, length(nt) - 6) x from n)
select repertoire_id, row_idx, x cdr3, case when not regexp_full_match(x, '[ACGT]+') then 'letters' when length(x) <> 3 * length(aa) then 'length' end nt_reason from t""")
def nucleotide_reasons(s, d):
    """Why a rearrangement's nucleotides don't fit, of all rows: every fifth has an unknown letter, every seventh a residue less."""
    codon = F.create_map(*(F.lit(x) for kv in _CODON.items() for x in kv))
    nt = F.concat(F.lit("AAA"), F.array_join(F.transform(sequences.letters(F.col("cdr3_aa")), lambda c: codon[c]), ""), F.when(F.col("row_idx") % 5 == 0, "N").otherwise(""), F.lit("CCC"))
    aa = F.expr("substring(cdr3_aa, 1, length(cdr3_aa) - case when row_idx % 7 = 0 then 1 else 0 end)")
    out = cleaning.nucleotide_reasons(repertoire(s, d).withColumns({"cdr3_rearrangement": nt, "cdr3_aa": aa}))
    return out.select("repertoire_id", "row_idx", "cdr3", "nt_reason")


@query("select participant_label, regexp_extract(participant_label, '^(.*?)(\\d+)$', 1) || lpad(regexp_extract(participant_label, '^(.*?)(\\d+)$', 2), 5, '0') padded from metadata".replace("select participant_label, regexp_extract(participant_label, '^(.*?)(\\d+)$', 1) || lpad(regexp_extract(participant_label, '^(.*?)(\\d+)$', 2), 5, '0') padded", "select participant_label, 'P-' || lpad(substr(participant_label, 2), 5, '0') padded"))
def padded_keys(s, d):
    p = F.concat(F.lit("P-"), F.expr("substring(participant_label, 2)"))
    return metadata(s, d).select("participant_label", genes.padded_participant(p, 5).alias("padded"))


@query(""", v as (select specimen_label, case when race = 'Unknown' then null else race end r from (select specimen_label, case ancestry when 'ASIA' then 'Asian' when 'EUROPE' then 'White' when 'AFRICA' then 'Black or African American, Not Hispanic' when 'AMERICA' then 'White, Hispanic or Latino' else 'Unknown' end race from metadata))
select specimen_label, case when split_part(r, ', ', 2) = 'Hispanic or Latino' then 'Hispanic/Latino' else case split_part(r, ', ', 1) when 'White' then 'Caucasian' when 'Black or African American' then 'African' when 'Asian' then 'Asian' end end ancestry from v""")
def ancestry_map(s, d):
    source = F.when(F.col("ancestry") == "ASIA", "Asian").when(F.col("ancestry") == "EUROPE", "White").when(F.col("ancestry") == "AFRICA", "Black or African American, Not Hispanic").when(F.col("ancestry") == "AMERICA", "White, Hispanic or Latino").otherwise("Unknown")
    race, ethnicity = cohorts.race_ethnicity(source)
    return metadata(s, d).select("specimen_label", cohorts.ancestry(race, ethnicity).alias("ancestry"))


@query(""", a as (select specimen_label, disease status, sex, age from metadata where fold_id = 0),
 s1 as (select *, row_number() over (order by specimen_label) i from a),
 f1 as (select specimen_label, status, case when age > 60 then 'F' else sex end sex, case when age < 30 then age + 3 else age + 1 end age, row_number() over (order by specimen_label) i from a)
select s1.i, s1.sex s_sex, f1.sex f_sex, s1.age s_age, f1.age f_age from s1 full join f1 using (i) where s1.sex is distinct from f1.sex or s1.status is distinct from f1.status or coalesce(abs(s1.age - f1.age) > 2, (s1.age is null) <> (f1.age is null))""")
def source_mapping_check(s, d):
    a = metadata(s, d).where("fold_id = 0").select("specimen_label", F.col("disease").alias("status"), "sex", "age")
    b = a.withColumns({"sex": F.when(F.col("age") > 60, "F").otherwise(F.col("sex")), "age": F.when(F.col("age") < 30, F.col("age") + 3).otherwise(F.col("age") + 1)})
    return cohorts.source_mismatches(a, b, "specimen_label").select(*big("i"), "s_sex", "f_sex", "s_age", "f_age")


@query("select repertoire_id, row_idx from repertoire where length(cdr3_aa) = 13")
def length_bucket(s, d):
    return cleaning.length_filter(repertoire(s, d), least=13, most=13).select("repertoire_id", "row_idx")


@query(""", s0 as (select v_call, max(cdr3_aa) || 'ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRST' seq from repertoire group by 1),
 p as (select v_call, substr(seq, 27, 11) || substr(seq, 56, 9) part from s0),
 g as (select a.v_call v1, b.v_call v2, a.part p, b.part q from p a, p b)
select v1, v2, floor(list_sum(list_transform(range(1, length(p) + 1), lambda i: case when substr(p, i, 1) = substr(q, i, 1) then 4.0 else -6.0 end))) / 20 score from g where length(p) = length(q)""")
def v_pair_scores(s, d):
    ref = repertoire(s, d).groupBy("v_call").agg(F.concat(F.max("cdr3_aa"), F.lit("ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRST")).alias("seq"))
    own = {a + a: 5.0 for a in sequences.RESIDUES}
    return similarity.v_pair_scores(ref, own).where("score is not null")


@query(", own as (select distinct cdr3_aa a, v_call v from repertoire) select a cdr3_aa, pos - 1 pos, count(*) n from (select a, unnest(range(1, length(a) + 1)) pos from (select distinct a from own)) cross join (select unnest(range(0, 20))) group by 1, 2")
def substitution_scan(s, d):
    own = repertoire(s, d).select("cdr3_aa").distinct()
    return own.select("cdr3_aa", F.explode(sequences.substitutions(F.col("cdr3_aa"))).alias("x")).groupBy("cdr3_aa", F.col("x.pos").cast("bigint").alias("pos")).agg(F.count("*").alias("n"))


@query("select participant_label, json_object('a_cmv', count(*) filter (where disease = 'CMV'), 'b_rows', count(*)) report from metadata group by 1")
def json_report(s, d):
    from ..sources.tables import report

    m = metadata(s, d)
    long = m.select("participant_label", F.explode(F.create_map(F.lit("a_cmv"), (F.col("disease") == "CMV").cast("int"), F.lit("b_rows"), F.lit(1))).alias("c", "n")).groupBy("participant_label", "c").agg(F.sum("n").alias("n"))
    return report(long, "participant_label", "c", "n")


@query(", " + LABELS + " select y as label, specimen_label from (select y, repertoire_id specimen_label, row_number() over (partition by y order by md5('3-' || repertoire_id), repertoire_id) r from labels) where r <= 4")
def representative_rows(s, d):
    ranked = labels(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(sequences.md5_order(3, F.col("repertoire_id")), "repertoire_id")))
    return ranked.where("rank <= 4").select("label", F.col("repertoire_id").alias("specimen_label"))


@query(f", {STEPS} select repertoire_id, count(*) n_input, count(*) filter (where removed_by is null) n_kept from steps group by 1")
def streamed_ingest(s, d):
    """Raw rows written as files, ingested by a stream; totals equal the batch's."""
    import uuid

    base = f"{folder(s)}/stream-{uuid.uuid4().hex}"
    rows = raw(s, d)
    rows.write.parquet(f"{base}/in")
    ingest(s, f"{base}/in", rows.schema.simpleString()[7:-1].replace(":", " "), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    kept = s.read.parquet(f"{base}/out").groupBy("repertoire_id").agg(F.count("*").alias("n_kept"))
    return rows.groupBy("repertoire_id").agg(F.count("*").alias("n_input")).join(kept, "repertoire_id", "left").select("repertoire_id", "n_input", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query("select json_extract_string(props, '$.k') as k, event_type, count(*) n from events group by 1, 2", plain=True)
def event_properties(s, d):
    return table(s, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("n"))
