"""Per-repertoire features and collapses, as long tables (repertoire_id, feature, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences
from ..scratch import Scratch, numbered

REP = "repertoire_id"


def collapse(df: DataFrame, keys: list[str], count: str = "duplicate_count") -> DataFrame:
    """Counts summed over rows with equal keys, by repertoire."""
    return df.groupBy(REP, *keys).agg(F.sum(count).alias("n_reads"))


def collapse_first_gene(df: DataFrame, count: str = "duplicate_count") -> DataFrame:
    """One row for each CDR3: summed counts and the genes of its first row in file order."""
    first = F.min_by(F.struct("v_call", "j_call"), F.col("row_idx"))
    return df.groupBy(REP, "cdr3_aa").agg(F.sum(count).alias("n_reads"), first.alias("g")).select(REP, "cdr3_aa", "n_reads", F.col("g.v_call").alias("v_call"), F.col("g.j_call").alias("j_call"))


def relative_frequency(df: DataFrame, count: str = "n_reads") -> DataFrame:
    return df.withColumn("frequency", F.col(count) / F.sum(count).over(Window.partitionBy(REP)))


def top_by_count(df: DataFrame, n: int, count: str = "n_reads", ties: tuple[str, ...] = ("cdr3_aa",)) -> DataFrame:
    """The n most frequent rows of each repertoire (ties: by name)."""
    w = Window.partitionBy(REP).orderBy(F.desc(count), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cut(df: DataFrame, mode: str, value: float, count: str = "n_reads", tie: str = "cdr3_aa") -> DataFrame:
    """A repertoire's head by one of five rules; where nothing is left, its top row.

    fraction: running frequency up to ``value`` (1 keeps all); frequency: own frequency at least ``value``; number: first
    ``value`` rows; reads: own count at least ``value``; read_sum: running count up to ``value``.
    """
    order = Window.partitionBy(REP).orderBy(F.desc(count), tie)
    running = F.sum(count).over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(count).over(Window.partitionBy(REP))
    rank = F.row_number().over(order)
    keep = {
        "fraction": F.lit(True) if value >= 1 else running / total <= value,
        "frequency": F.col(count) / total >= value,
        "number": rank <= int(value),
        "reads": F.col(count) >= value,
        "read_sum": running <= value,
    }[mode]
    marked = df.withColumns({"rank": rank, "keep": keep})
    return marked.where(F.col("keep") | (F.col("rank") == 1)).drop("keep")


#: Rows of repertoires that are counted in their own partition, for each partition; larger repertoires go by their k-mers.
KMER_ROWS = 100_000


def kmer_frequencies(df: DataFrame, k: int = 4, column: str = "cdr3_aa") -> DataFrame:
    """Share of every k-mer and one-gap k-mer among all of a repertoire's, over rows (not distinct CDR3s).

    Rows are summed by distinct CDR3 before they are exploded, so public CDR3s are cut up once.  A repertoire's total is
    known from the lengths, k + 1 features for each place, so no window runs over its k-mers.  Rows are dealt by repertoire and
    its k-mers, fifty times the rows, are counted where they are made; those of a repertoire of over KMER_ROWS rows are shuffled.
    """
    return _by_repertoire(df.select(REP, column), lambda own: _kmer_shares(own, k, column))


def _by_repertoire(df: DataFrame, counted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``counted`` of rows dealt by repertoire, KMER_ROWS a partition; repertoires of more rows than that apart, not dealt."""
    sizes = Scratch(df.sparkSession).write(df.groupBy(REP).agg(F.count("*").alias("size")))
    n = sizes.agg(F.sum("size")).first()[0] or 0
    large = sizes.where(F.col("size") > KMER_ROWS).select(REP)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // KMER_ROWS))
    if large.isEmpty():
        return counted(df.repartition(parts, REP))
    few = df.join(large, REP, "left_anti").repartition(parts, REP)
    return counted(few).unionByName(counted(df.join(large, REP, "left_semi")))


def _kmer_shares(df: DataFrame, k: int, column: str) -> DataFrame:
    rows = df.groupBy(REP, column).agg(F.count("*").alias("m"))
    w = F.col("w")
    blank = [F.concat(w.substr(1, j), F.lit("_"), w.substr(j + 2, k - j - 1)) for j in range(k)]
    whole = rows.select(REP, F.explode(sequences.windows(F.col(column), k)).alias("w"), "m")
    counts = whole.select(REP, F.explode(F.array(w, *blank)).alias("feature"), "m").groupBy(REP, "feature").agg(F.sum("m").alias("n"))
    total = rows.groupBy(REP).agg(F.sum(F.greatest(F.length(column) - k + 1, F.lit(0)) * (k + 1) * F.col("m")).alias("total"))
    return counts.join(total, REP).select(REP, "feature", "n", (F.col("n") / F.col("total")).alias("value"))


def gene_usage(df: DataFrame) -> DataFrame:
    """Share of each V and each J gene among a repertoire's rows; features V:gene and J:gene."""
    long = df.select(REP, F.explode(F.array(F.struct(F.lit("V").alias("locus"), F.col("v_call").alias("gene")), F.struct(F.lit("J").alias("locus"), F.col("j_call").alias("gene")))).alias("x")).select(REP, "x.*").where("gene is not null")
    counts = long.groupBy(REP, "locus", "gene").agg(F.count("*").alias("n"))
    return counts.select(REP, F.concat_ws(":", "locus", "gene").alias("feature"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy(REP, "locus"))).alias("value"))


def fourmer_abundance(df: DataFrame, column: str = "cdr3_aa") -> DataFrame:
    """4-mers of the CDR3 cores: log relative abundance by summed and by largest clone size.

    The summed form counts a 4-mer once for each place; both leave 4-mers with unknown residues out.  Rows are dealt by
    repertoire as in ``kmer_frequencies``, and 4-mers are counted where they are made.
    """
    return _by_repertoire(df.select(REP, column).where(F.length(column) >= 10), lambda own: _fourmers(own, column))


def _fourmers(df: DataFrame, column: str) -> DataFrame:
    core = sequences.core(F.col(column))
    clones = df.groupBy(REP, column).agg(F.count("*").alias("size"))
    total = clones.groupBy(REP).agg(F.sum("size").alias("rows"))
    places = clones.select(REP, "size", F.explode(sequences.windows(core, 4)).alias("fourmer")).where(F.col("fourmer").rlike(sequences.STANDARD))
    sums = places.groupBy(REP, "fourmer").agg(F.sum("size").alias("c"), F.max("size").alias("m"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(REP))
    return sums.withColumn("share", share).join(total, REP).select(REP, "fourmer", F.ln("share").alias("log_sum"), F.ln(F.col("m") / F.col("rows")).alias("log_max"))


def gene_vocabulary_compare(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Genes of two tables and whether they are shared or in one alone."""
    left = a.select(F.col(column).alias("gene")).where("gene is not null").distinct().withColumn("in_a", F.lit(True))
    right = b.select(F.col(column).alias("gene")).where("gene is not null").distinct().withColumn("in_b", F.lit(True))
    return left.join(right, "gene", "full").select("gene", F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_a"), "first_only").otherwise("second_only").alias("status"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values numbered from 1; a value outside and null get 0 on lookup."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return numbered(values, ["value"], "n").select("value", (F.col("n") + 1).alias("id"))


def cluster_frequencies(df: DataFrame, weight: str) -> DataFrame:
    """(repertoire, cluster): summed weight; absent pairs are zero by definition and not stored."""
    return df.groupBy(REP, "cluster").agg(F.sum(weight).alias("weight"))


def cluster_matrix(df: DataFrame, weight: str, column: str = "cdr3_aa") -> tuple[DataFrame, DataFrame]:
    """((repertoire, cluster): summed weight; cluster: its members' length spread and whether lengths vary)."""
    n = F.length(column)
    return cluster_frequencies(df, weight), df.groupBy("cluster").agg(F.count("*").alias("n_rows"), (F.max(n) - F.min(n)).alias("length_spread"), F.countDistinct(n).alias("n_lengths"))


def representatives(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``: a class's most probable sequences, its highest or lowest."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def attention_driver_scores(df: DataFrame, score: str, column: str = "cdr3_aa") -> DataFrame:
    """Each CDR3's largest attention weight in its repertoire."""
    e = df.withColumn("e", F.exp(F.col(score) - F.max(score).over(Window.partitionBy(REP))))
    return e.withColumn("weight", F.col("e") / F.sum("e").over(Window.partitionBy(REP))).groupBy(REP, column).agg(F.max("weight").alias("score"))


def diversity(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Clusters of positive weight and Shannon entropy (natural logarithm) of each repertoire."""
    shares = df.where(F.col(weight) > 0).withColumn("p", F.col(weight) / F.sum(weight).over(Window.partitionBy(REP)))
    return shares.groupBy(REP).agg(F.count("*").alias("n_clusters"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))


def pooled_vectors(df: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """Weighted sum (or plain mean) of vectors by key, in long form (key, pos, value)."""
    parts = df.select(key, F.posexplode(vector).alias("pos", "x"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    value = F.sum(F.col("x").cast("double") * F.col("w")) if weight else F.avg(F.col("x").cast("double"))
    return parts.groupBy(key, "pos").agg(value.alias("value"))


def weight_matrix(df: DataFrame, key: str, motif: str) -> DataFrame:
    """Residue shares by position of each key's motifs; padding 'X' is left out."""
    long = df.select(key, F.posexplode(sequences.letters(F.col(motif))).alias("pos", "residue")).where("residue <> 'X'")
    counts = long.groupBy(key, "pos", "residue").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key, "pos")))


def attributed_windows(rows: DataFrame, attribution: DataFrame, per_feature: int = 10, width: int = 5, top: int | None = None) -> DataFrame:
    """(class, feature, rank, cdr3_aa, motif): for each class's features the windows of its sequences of highest score.

    ``rows``: (class, cdr3_aa, score), a class's own sequences with its predicted score; ``attribution``: (class, feature,
    rank), features being k-mers with or without one blank, the first ``top`` of each class.  A window of ``width`` residues
    begins where the sequence first has the feature and is padded with X; sequences without it are passed over.
    """
    wanted = attribution if top is None else attribution.where(F.col("rank") <= top)
    wanted = wanted.select("class", "feature", F.length("feature").alias("k"))
    best = rows.where("cdr3_aa is not null and score is not null").groupBy("class", "cdr3_aa").agg(F.max("score").alias("score"))
    texts, lengths = best.select("cdr3_aa").distinct(), [r["k"] for r in wanted.select("k").distinct().collect()]
    found = None
    for k in sorted(lengths):  # as many as there are lengths of k-mers
        cells = texts.select("cdr3_aa", F.posexplode(sequences.gapped_kmers(F.col("cdr3_aa"), k)).alias("i", "feature"))
        cells = cells.join(wanted.select("feature").distinct(), "feature", "left_semi").groupBy("cdr3_aa", "feature").agg(F.floor(F.min("i") / (k + 1)).alias("at"))
        found = cells if found is None else found.unionByName(cells)
    if found is None:
        return rows.select("class", F.col("cdr3_aa").alias("feature"), F.lit(0).alias("rank"), "cdr3_aa", F.col("cdr3_aa").alias("motif")).limit(0)
    held = wanted.select("class", "feature").join(found, "feature").join(best, ["class", "cdr3_aa"])
    order = Window.partitionBy("class", "feature").orderBy(F.desc("score"), "cdr3_aa")
    ranked = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_feature)
    return ranked.select("class", "feature", "rank", "cdr3_aa", F.rpad(F.substring(F.col("cdr3_aa"), (F.col("at") + 1).cast("int"), F.lit(width)), width, "X").alias("motif"))


def multi_hot(df: DataFrame, key: str, values: str) -> DataFrame:
    """Long 0/1 form of a list column: the (key, value) pairs that are 1."""
    return df.select(key, F.explode(F.array_distinct(values)).alias("value")).where("value is not null").distinct()


def attention_pool(df: DataFrame, score: str, vector: str) -> DataFrame:
    """Softmax weights of a score within each repertoire, and the weighted mean vector in long form."""
    top = F.max(score).over(Window.partitionBy(REP))
    e = df.withColumn("e", F.exp(F.col(score) - top))
    w = e.withColumn("weight", F.col("e") / F.sum("e").over(Window.partitionBy(REP))).drop("e")
    return w.select(REP, F.posexplode(vector).alias("pos", "x"), "weight").groupBy(REP, "pos").agg(F.sum(F.col("x") * F.col("weight")).alias("value"))


def top_motifs(df: DataFrame, score: str, k: int, least: float, motif: str = "fourmer") -> DataFrame:
    """The k motifs of largest score among those that reach ``least`` (ties by motif)."""
    return df.groupBy(motif).agg(F.max(score).alias(score)).where(F.col(score) >= least).orderBy(F.desc(score), motif).limit(k)


def joined_features(long: DataFrame, meta: DataFrame, key: str = "specimen_label") -> DataFrame:
    """Repertoire features and, with prefix D:, age, sex (M = 1) and one-hot ancestry as further long rows."""
    cells = F.array(F.struct(F.lit("D:age").alias("feature"), F.col("age").alias("value")), F.struct(F.lit("D:sex_M").alias("feature"), (F.col("sex") == "M").cast("double").alias("value")), F.struct(F.concat(F.lit("D:"), F.col("ancestry")).alias("feature"), F.lit(1.0).alias("value")))
    own = meta.select(F.col(key).alias(REP), F.explode(cells).alias("x")).select(REP, "x.*").where("feature is not null and value is not null and value <> 0")
    return long.select(REP, "feature", "value").unionByName(own)
