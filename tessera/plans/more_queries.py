"""Further registered queries: encodings, merges, cohort lists and grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import genes, sequences
from ..operators import association, cleaning, cohorts, features, learners, metrics, sampling, similarity
from ..scratch import Scratch
from .fixtures import metadata, raw, repertoire, table
from .queries import LABELS, PRED, TASK, TRUTH, big, clones, labels, predictions, query, r6, truth


@query(" select repertoire_id, cdr3_aa, v_call, j_call, cast(null as varchar) sequence, cast(duplicate_count as bigint) num_reads, 'P0' participant_label from repertoire")
def standard_columns(s, d):
    rep = repertoire(s, d).withColumnRenamed("duplicate_count", "templates")
    return cleaning.standard_columns(rep, participant="P0").withColumn("num_reads", F.col("num_reads").cast("bigint"))


@query(f" select repertoire_id, row_idx, regexp_full_match(trim(upper(amino_acid)), '[{sequences.RESIDUES}]+') and amino_acid is not null ok from raw".replace("and amino_acid is not null ok", "is true ok"))
def alphabet_check(s, d):
    return raw(s, d).select("repertoire_id", "row_idx", cleaning.in_alphabet(F.col("amino_acid")).alias("ok"))


@query(" select distinct v_call, case when trim(split_part(x, ',', 1)) = '' then null when contains(trim(split_part(x, ',', 1)), '*') then trim(split_part(x, ',', 1)) else trim(split_part(x, ',', 1)) || '*01' end first_allele from (select v_call, case when row_idx % 3 = 0 then split_part(v_call, '*', 1) || ', TRBV9' when row_idx % 3 = 1 then v_call else '' end x from repertoire)")
def first_alleles(s, d):
    x = F.when(F.col("row_idx") % 3 == 0, F.concat(F.substring_index("v_call", "*", 1), F.lit(", TRBV9"))).when(F.col("row_idx") % 3 == 1, F.col("v_call")).otherwise("")
    return repertoire(s, d).select("v_call", genes.first_allele(x).alias("first_allele")).distinct()


@query(" select distinct cdr3_aa, case when length(cdr3_aa) > 2 then substr(cdr3_aa, 2, length(cdr3_aa) - 2) else cdr3_aa end trimmed, regexp_replace(regexp_replace(cdr3_aa, '^C', ''), 'F$', '') truth_trimmed, substr(cdr3_aa, 4, greatest(length(cdr3_aa) - 6, 0)) core from repertoire")
def cdr3_forms(s, d):
    c = F.col("cdr3_aa")
    return repertoire(s, d).select(c, sequences.trim_cdr3(c).alias("trimmed"), sequences.trim_ground_truth(c).alias("truth_trimmed"), sequences.core(c).alias("core")).distinct()


@query(f", o as (select distinct cdr3_aa from repertoire) select cdr3_aa, array_to_string(list_transform(range(1, 13), lambda i: cast(coalesce(nullif(instr('{sequences.RESIDUES}', nullif(substr(cdr3_aa, i, 1), '')), 0), 0) as varchar)), ',') code from o")
def integer_codes(s, d):
    own = repertoire(s, d).select("cdr3_aa").distinct()
    return own.select("cdr3_aa", F.array_join(sequences.integer_code(F.col("cdr3_aa"), 12).cast("array<string>"), ",").alias("code"))


@query(" select repertoire_id, row_idx, round(ln(greatest(duplicate_count, 1)), 6) log_count, greatest(duplicate_count, 0) own from repertoire")
def count_scaling(s, d):
    c = F.col("duplicate_count")
    return repertoire(s, d).select("repertoire_id", "row_idx", r6(sequences.count_scaling(c), "log_count"), sequences.count_scaling(c, "own").alias("own"))


@query(""", o as (select distinct repertoire_id, cdr3_aa from repertoire),
 p as (select a.cdr3_aa a, b.cdr3_aa b from o a join o b on a.repertoire_id = b.repertoire_id and length(a.cdr3_aa) = length(b.cdr3_aa) and a.cdr3_aa < b.cdr3_aa group by 1, 2)
select a, b, list_sum(list_transform(range(1, length(a) + 1), lambda i: case when substr(a, i, 1) = substr(b, i, 1) then 4.0 else -6.0 end)) score from p""")
def alignment_scores(s, d):
    return similarity.scores_within(repertoire(s, d), "repertoire_id", "cdr3_aa", {r + r: 5.0 for r in sequences.RESIDUES})


@query(TRUTH + ", u as (select cdr3_aa, 1 as src from truth where gt_idx % 2 = 0 union all select cdr3_aa, 2 from truth where gt_idx % 3 = 0 and cdr3_aa not in (select cdr3_aa from truth where gt_idx % 2 = 0)) select src as source, count(*) n from u group by 1")
def truth_union(s, d):
    t = truth(s, d)
    a = t.where("gt_idx % 2 = 0").select("cdr3_aa", F.lit(1).alias("source"))
    b = t.where("gt_idx % 3 = 0").select("cdr3_aa", F.lit(2).alias("source"))
    return similarity.union_truth(a, b).groupBy("source").agg(F.count("*").alias("n"))


MERGE = """
, o as (select cdr3_aa, j_call, left(cdr3_aa, 4) as cluster, fold_id from repertoire join metadata on repertoire_id = specimen_label),
 c as (select distinct cdr3_aa, j_call, cluster from o where fold_id = 2),
 r as (select distinct cdr3_aa, j_call, 'r' || left(cluster, 2) as known from o where fold_id < 2 and length(cdr3_aa) = 12),
 h as (select cluster, min(known) k from c join r using (cdr3_aa, j_call) group by 1)
select c.cdr3_aa, c.j_call, coalesce(k, 'new:' || c.cluster) as cluster from c left join h using (cluster)
"""


@query(MERGE)
def cluster_merge(s, d):
    """Clusters of fold 2 merged into those of the other folds' CDR3s of 12 residues."""
    fold = metadata(s, d).select(F.col("specimen_label").alias("repertoire_id"), "fold_id")
    o = repertoire(s, d).join(fold, "repertoire_id").select("cdr3_aa", "j_call", F.expr("left(cdr3_aa, 4)").alias("cluster"), "fold_id")
    c = o.where("fold_id = 2").select("cdr3_aa", "j_call", "cluster").distinct()
    r = o.where("fold_id < 2 and length(cdr3_aa) = 12").select("cdr3_aa", "j_call", F.concat(F.lit("r"), F.expr("left(cluster, 2)")).alias("cluster")).distinct()
    return similarity.merged_into_reference(c, r, ["cdr3_aa", "j_call"])


@query(""", e as (select distinct left(cdr3_aa, 4) as cluster, substr(cdr3_aa, 5, 3) as member from repertoire),
 n as (select distinct a.cluster x, b.cluster y from e a join e b using (member)), r(node, root) as (select x, x from n union select n.y, r.root from r join n on n.x = r.node where r.root < n.y)
select node as cluster, least(node, min(root)) merged from r group by 1""")
def overlapping_clusters(s, d):
    e = repertoire(s, d).select(F.expr("left(cdr3_aa, 4)").alias("cluster"), F.expr("substring(cdr3_aa, 5, 3)").alias("member")).distinct()
    return similarity.merged_clusters(e)


@query(""", e as (select distinct v_call a, j_call b from repertoire where duplicate_count = 50),
 n as (select a x, b y from e union select b, a from e),
 h0 as (select distinct v_call s from repertoire where v_call < 'TRBV2'),
 h1 as (select distinct s, y from h0 join n on s = x),
 h2 as (select distinct s, n.y from h1 join n on h1.y = n.x)
select seed, node, min(hops) hops from (select s seed, s node, 0 hops from h0 union all select s, y, 1 from h1 union all select s, y, 2 from h2) group by 1, 2""")
def range_hops(s, d):
    rep = repertoire(s, d)
    e = rep.where("duplicate_count = 50").select(F.col("v_call").alias("a"), F.col("j_call").alias("b")).distinct()
    return similarity.hop_limited(e, rep.where("v_call < 'TRBV2'").select(F.col("v_call").alias("node")).distinct(), 2)


@query(""", g as (select distinct split_part(v_call, '*', 1) gene from repertoire where v_call < 'TRBV2'),
 x as (select r.*, coalesce('K' || right(gene, 3), '--------') cdr2 from repertoire r left join g on split_part(v_call, '*', 1) = gene)
select repertoire_id, row_idx, cdr2, left(cdr2 || '-' || cdr3_aa, 15) model_text from x""")
def cdr2_lookup(s, d):
    rep = repertoire(s, d)
    g = rep.where("v_call < 'TRBV2'").select(F.substring_index("v_call", "*", 1).alias("gene")).distinct().withColumn("cdr2", F.concat(F.lit("K"), F.expr("right(gene, 3)")))
    return similarity.cdr2_cdr3(rep, g, 15).select("repertoire_id", "row_idx", "cdr2", "model_text")


@query(""", t as (select vec_id, vec_id % 3 f, embedding e from embeddings),
 p as (select a.vec_id, b.vec_id o, list_sum(list_transform(range(1, 65), lambda i: (a.e[i]::double - b.e[i]::double) * (a.e[i]::double - b.e[i]::double))) q from t a join t b on a.f <> b.f),
 r as (select *, row_number() over (partition by vec_id order by q, o) rank from p)
select vec_id, rank, o as other, round(sqrt(q), 5) distance from r where rank <= 5""", plain=False)
def knn_vectors(s, d):
    """Each vector against the other folds: distances in blocks."""
    v = table(s, d, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("fold"), F.col("embedding").alias("v"))
    return similarity.nearest_vectors(v, "vec_id", "v", "fold", 5).select("vec_id", *big("rank"), "other", F.round("distance", 5).alias("distance"))


@query(TASK + """, h as (select *, row_number() over (partition by floor(age / 10) order by md5('7-' || participant_label), participant_label) rank from task where y = 0 and age is not null),
 m as (select specimen_label from task where y = 1 or participant_label in (select participant_label from h join target on floor(age / 10) * 10 = bin where rank <= target)),
 r as (select specimen_label, random_baseline_seed z from (select *, row_number() over (partition by random_baseline_seed, y order by md5(concat_ws('-', cast(random_baseline_seed as varchar), participant_label)), participant_label) rank from (select *, unnest([7, 14, 21, 28, 35]) random_baseline_seed from task)), (select coalesce(max(max_n), 0) max_n from target) where y = 1 or rank <= max_n)
select 'CMV' disease, 'age_matched' cohort, specimen_label from m union all select 'CMV', 'random_' || z, specimen_label from r""")
def cohort_lists(s, d):
    return cohorts.cohort_lists(metadata(s, d), ["CMV"])


@query(""", a as (select specimen_label, case when fold_id = 0 then '25 Years, Male, Cytomegalovirus +' when fold_id = 1 then 'female, 61 Years, Cytomegalovirus -' else 'Unknown' end tags from metadata)
select specimen_label, case fold_id when 0 then 'M' when 1 then 'F' end sex, case fold_id when 0 then '+' when 1 then '-' end status, case fold_id when 0 then 25.0 when 1 then 61.0 end::double age from metadata""")
def sample_tags(s, d):
    tags = F.when(F.col("fold_id") == 0, "25 Years, Male, Cytomegalovirus +").when(F.col("fold_id") == 1, "female, 61 Years, Cytomegalovirus -").otherwise("Unknown")
    fields = cohorts.tag_fields(tags)
    return metadata(s, d).select("specimen_label", *(c.alias(n) for n, c in fields.items()))


@query(""", m as (select specimen_label, unnest(['A' || (cast(substr(specimen_label, 2) as int) % 4), 'B' || (cast(substr(specimen_label, 2) as int) % 3)]) a from metadata),
 t as (select specimen_label, case a when 'A0' then 'A-one' when 'A1' then 'A-one' when 'B2' then 'B-two' end s from m)
select specimen_label, coalesce(string_agg(distinct s, ',' order by s), '') supertypes from t group by 1""")
def supertype_map(s, d):
    n = F.expr("cast(substring(specimen_label, 2) as int)")
    m = metadata(s, d).select("specimen_label", F.array(F.concat(F.lit("A"), (n % 4).cast("string")), F.concat(F.lit("B"), (n % 3).cast("string"))).alias("alleles"))
    t = s.createDataFrame([("A0", "A-one"), ("A1", "A-one"), ("B2", "B-two")], "allele string, supertype string")
    return cohorts.supertypes(m, "specimen_label", "alleles", t).select("specimen_label", F.array_join("supertypes", ",").alias("supertypes"))


@query(""", l as (select repertoire_id, 'J:' || j_call feature, count(*) / sum(count(*)) over (partition by repertoire_id) as value from repertoire group by repertoire_id, j_call),
 x as (select * from l union all select specimen_label, 'D:age', age from metadata where age is not null union all select specimen_label, 'D:sex_M', 1.0 from metadata where sex = 'M' union all select specimen_label, 'D:' || ancestry, 1.0 from metadata where ancestry is not null)
select repertoire_id, feature, round(value, 6) as value from x""")
def joined_features(s, d):
    j = features.gene_usage(repertoire(s, d)).where("feature like 'J:%'")
    return features.joined_features(j, metadata(s, d)).select("repertoire_id", "feature", r6("value", "value"))


@query(""", p as (select substr(substr(cdr3_aa, 4, length(cdr3_aa) - 6), i, 4) fourmer, count(*) n from (select cdr3_aa, unnest(range(1, length(cdr3_aa) - 8)) i from repertoire where length(cdr3_aa) >= 10) group by 1)
select fourmer, n as score from p where n >= 5 order by n desc, fourmer limit 25""")
def top_motifs(s, d):
    p = repertoire(s, d).where("length(cdr3_aa) >= 10").select(F.explode(sequences.windows(sequences.core(F.col("cdr3_aa")), 4)).alias("fourmer")).groupBy("fourmer").agg(F.count("*").alias("score"))
    return features.top_motifs(p, "score", 25, 5)


@query(PRED + """, g as (select specimen_label, unnest(range(0, 4)) k from pred)
select specimen_label, round(coalesce(avg(case when (cast(substr(specimen_label, 2) as int) + k) % 4 = 0 and cast(substr(specimen_label, 2) as int) % 3 > 0 then s + k / 10 end), 0), 6) score from g join pred using (specimen_label) group by 1""")
def average_over_splits(s, d):
    p = predictions(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("n", F.expr("cast(substring(specimen_label, 2) as int)"))
    tested = p.where("(n + k) % 4 = 0 and n % 3 > 0").select("specimen_label", (F.col("model_score") + F.col("k") / 10).alias("score"))
    return learners.average_over_splits(predictions(s, d).select("specimen_label"), tested, "specimen_label").select("specimen_label", r6("score", "score"))


@query(f", {LABELS}, t as (select *, unnest(range(0, 2)) replicate from repertoire), r as (select repertoire_id, row_idx, v_call, replicate, row_number() over (partition by repertoire_id, replicate order by md5(concat_ws('-', '7', cast(replicate as varchar), repertoire_id, cast(row_idx as varchar))), row_idx) - 1 pos from t), g as (select repertoire_id, replicate, depth, avg(cast(v_call < 'TRBV2' as int)) s from (select *, unnest([50, 200]) depth from r) where pos < depth group by 1, 2, 3) select depth, count(*) n, round(avg(s), 6) mean from g join labels using (repertoire_id) group by 1")
def depth_grid(s, d):
    """One feature over every depth and replicate in one job."""
    g = sampling.nested_depths(repertoire(s, d).select("repertoire_id", "row_idx", "v_call"), [50, 200], 2)
    f = g.groupBy("repertoire_id", "replicate", "depth").agg(F.avg((F.col("v_call") < "TRBV2").cast("int")).alias("s")).join(labels(s, d), "repertoire_id")
    return metrics.depth_summary(f, ["depth"], "s").select("depth", "n", r6("mean", "mean"))


@query(""", k as (select participant_label, repertoire_id, row_idx, row_number() over (partition by repertoire_id order by md5(concat_ws('-', '7', '0', repertoire_id, cast(row_idx as varchar))), row_idx) - 1 pos from repertoire join metadata on specimen_label = repertoire_id)
select participant_label, count(*) n, count(distinct repertoire_id) specimens, cast(sum(row_idx) as bigint) row_sum from k where pos < 25 group by 1""")
def depth_slices_by_participant(s, d):
    g = sampling.nested_depths(repertoire(s, d).select("repertoire_id", "row_idx"), [25], 1)
    who = metadata(s, d).select("participant_label", F.col("specimen_label").alias("repertoire_id"))
    return g.join(who, "repertoire_id").groupBy("participant_label").agg(F.count("*").alias("n"), F.countDistinct("repertoire_id").alias("specimens"), F.sum("row_idx").alias("row_sum"))


@query(PRED + ", x as (select y, s, seed from (select *, unnest([7, 14, 21]) seed from pred) where (cast(substr(specimen_label, 2) as int) * seed) % 5 > 0) select seed, count(*) n, round(avg(s), 6) mean from x group by 1")
def seed_summary(s, d):
    p = predictions(s, d).withColumn("seed", F.explode(F.array(*map(F.lit, (7, 14, 21))))).where(F.expr("(cast(substring(specimen_label, 2) as int) * seed) % 5 > 0"))
    return metrics.depth_summary(p, ["seed"], "model_score").select("seed", "n", r6("mean", "mean"))


@query(f", {LABELS}, f as (select cdr3_aa, v_call, j_call, min(repertoire_id) first_held from repertoire group by 1, 2, 3) select first_held, count(*) n_clones from f group by 1")
def clone_first_holder(s, d):
    held = repertoire(s, d).groupBy(*association.CLONE).agg(F.min("repertoire_id").alias("first_held"))
    return held.groupBy("first_held").agg(F.count("*").alias("n_clones"))


#: Each class's 4-mers by the mean of a score over the sequences that hold them.
_MOTIFS = f""", {LABELS}, sq as (select distinct y class, cdr3_aa, length(cdr3_aa) * 10 + instr('ACDEFGHIKLMNPQRS', substr(cdr3_aa, 1, 1)) score from repertoire join labels using (repertoire_id)),
 ks as (select class, cdr3_aa, score, unnest(range(1, length(cdr3_aa) - 2)) i from sq),
 fe as (select class, substr(cdr3_aa, i, 4) feature, cdr3_aa, score, min(i) i0 from ks group by all),
 att as (select class, feature, row_number() over (partition by class order by avg(score) desc, feature) r from fe group by 1, 2 having count(*) >= 3),
 win as (select class, feature, cdr3_aa, rpad(substr(cdr3_aa, i0, 5), 5, 'X') motif, row_number() over (partition by class, feature order by score desc, cdr3_aa) rank from fe join (select class, feature from att where r <= 20) using (class, feature))
"""


def _attributed(s, d):
    rep = repertoire(s, d).join(labels(s, d), "repertoire_id")
    first = F.expr("instr('ACDEFGHIKLMNPQRS', substring(cdr3_aa, 1, 1))")
    rows = rep.select(F.col("label").alias("class"), "cdr3_aa", (F.length("cdr3_aa") * 10 + first).alias("score")).distinct()
    rows = Scratch(s).write(rows)  # read for the features and for their windows
    mers = rows.select("class", "cdr3_aa", "score", F.explode(F.array_distinct(sequences.windows(F.col("cdr3_aa"), 4))).alias("feature"))
    order = Window.partitionBy("class").orderBy(F.desc("m"), "feature")
    by = mers.groupBy("class", "feature").agg(F.avg("score").alias("m"), F.count("*").alias("n")).where("n >= 3")
    return features.attributed_windows(rows, by.withColumn("rank", F.row_number().over(order)), per_feature=8, width=5, top=20)


@query(_MOTIFS + "select class, feature, rank, cdr3_aa, motif from win where rank <= 8")
def attributed_windows(s, d):
    """Windows of each class's best sequences where they have the class's first 20 features."""
    return _attributed(s, d).select("class", "feature", *big("rank"), "cdr3_aa", "motif")


@query(_MOTIFS + """, l as (select class || ':' || feature f, unnest(range(1, 6)) i, motif from win where rank <= 8),
 c as (select f, i - 1 pos, substr(motif, i, 1) residue, count(*) n from l where substr(motif, i, 1) <> 'X' group by all)
select f feature, pos, residue, n, round(n / sum(n) over (partition by f, pos), 6) share from c""")
def attributed_motifs(s, d):
    """Residue shares by position of those windows."""
    own = _attributed(s, d).select(F.concat_ws(":", F.col("class").cast("string"), "feature").alias("feature"), "motif")
    return features.weight_matrix(own, "feature", "motif").select("feature", F.col("pos").cast("bigint").alias("pos"), "residue", "n", r6("share", "share"))


@query()
def score_attribution(s, d):
    """Linear weights of the Fisher evidence on V/J usage."""
    from ..operators.learners import feature_index, scales, vectors

    # Each is read several times by the fit.
    scratch = Scratch(s)
    rows = scratch.write(association.driver_p_scores(repertoire(s, d), clones(s, d)).groupBy("repertoire_id").agg(F.avg(-F.log10("p_value")).alias("evidence")))
    long = scratch.write(features.gene_usage(repertoire(s, d)))
    scaled = scratch.write(scales(long, feature_index(long, rows), rows))
    weights = learners.attribution(vectors(long, scaled, rows), "evidence")
    w = s.createDataFrame(list(enumerate(map(float, weights))), "id int, weight double")
    return scaled.join(w, "id").select("feature", "weight")
