"""Classifiers on long feature tables.  Training data stays distributed; what reaches the driver has model size."""

from __future__ import annotations

import functools
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors, VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences
from ..scratch import Scratch, numbered
from . import boosting, metrics, sampling

KMER_C = [0.001, 0.003, 0.01, 0.03, 0.1]
GENE_C = [1.0, 0.3, 0.1, 0.03]


def feature_index(long: DataFrame, train: DataFrame, key: str = "repertoire_id") -> DataFrame:
    """(feature, id): the features of training rows in sorted order; others are dropped later."""
    return numbered(long.join(train.select(key), key, "left_semi").select("feature").distinct(), ["feature"], "id").withColumn("id", F.col("id").cast("int"))


def scales(long: DataFrame, index: DataFrame, train: DataFrame, key: str = "repertoire_id") -> DataFrame:
    """Population standard deviation of every feature over training rows, absent values being 0; constants get 1."""
    n = train.count()
    s = long.join(train.select(key), key, "left_semi").groupBy("feature").agg((F.sum("value") / n).alias("m"), (F.sum(F.col("value") * F.col("value")) / n).alias("q"))
    std = F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))
    return index.join(s, "feature").select("feature", "id", F.when(std > 0, std).otherwise(1.0).alias("std"))


def vectors(long: DataFrame, scaled: DataFrame, rows: DataFrame, key: str = "repertoire_id") -> DataFrame:
    """``rows`` with a sparse feature vector, each value divided by its feature's deviation."""
    size = scaled.count()

    @F.udf(returnType=VectorUDT())
    def sparse(ids, xs):  # one call for each repertoire
        return Vectors.sparse(size, ids or [], xs or [])

    cells = long.join(scaled, "feature").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", (F.col("value") / F.col("std")).alias("x")))).alias("cells"))
    return rows.join(cells, key, "left").withColumn("features", sparse("cells.id", "cells.x")).drop("cells")


#: Numbers of a partition of training vectors: while cores are free, and at most.  A step of a fit is one job over all partitions.
LEAST_NUMBERS, MOST_NUMBERS = 100_000, 4_000_000
#: Fits of a cross-validation that run side by side.
SIDE_BY_SIDE = 5


def spread(train: DataFrame, vector: str = "features") -> DataFrame:
    """``train`` written once, in as many partitions as its vectors' numbers fill: a fit takes a hundred steps, and what a join or a
    window left behind (hundreds of tiny partitions, or one for each class) would be paid in each of them.  Narrow vectors are
    cached; wide ones are read from the shared folder in each step, so memory does not follow the rows."""
    scratch = Scratch(train.sparkSession)
    own = scratch.write(train)
    numbers = 0 if own.isEmpty() else int(own.select(Summarizer.numNonZeros(F.col(vector))).first()[0].toArray().sum())
    cores = own.sparkSession.sparkContext.defaultParallelism
    free, many = min(cores, -(-numbers // LEAST_NUMBERS)), -(-numbers // MOST_NUMBERS)
    wide = _size(own, vector) > NARROW
    out = scratch.write(own.repartition(max(1, free, min(many, 2 * cores) if wide else many)))  # a partition sends a sum of each fit
    return out if wide else out.persist()


def _size(df: DataFrame, vector: str = "features") -> int:
    first = df.select(vector).first()
    return first[0].size if first else 0


def l1_logistic(train: DataFrame, c: float, n: int, label: str = "label", tol: float = 1e-6, steps: int = 100):
    held = spread(train)
    model = _l1(held, c, n, label, tol, steps)
    held.unpersist()
    return model


def _l1(train: DataFrame, c: float, n: int, label: str, tol: float = 1e-6, steps: int = 100):
    """Up to NARROW features by Newton steps, whose number does not grow with the rows; wider ones by quasi-Newton steps."""
    size, penalty = _size(train), 1.0 / (c * max(n, 1))
    if size <= NARROW:
        return _newton(train, size, penalty, label, tol, steps)
    return _quasi_newton(train.withColumn("cv_fold", F.lit(-1)), size, [(penalty, -2)], label, tol, steps)[0]


#: Numbers of a part of a batch of rows as a dense matrix, and of the points that fits of a step may have.
DENSE, POINTS = 2_000_000, 1_000_000


def _dense(vector: pa.StructArray, size: int):
    """(first row, dense rows) of a column of vectors, DENSE numbers at a time."""
    kind = vector.field("type").to_numpy(zero_copy_only=False)
    ids, xs = (vector.field(c) for c in ("indices", "values"))
    step = max(1, DENSE // max(size, 1))
    for low in range(0, len(vector), step):
        n = min(step, len(vector) - low)
        x = np.zeros((n, size))
        for i in range(n):
            values = xs[low + i].values.to_numpy()
            x[i, ids[low + i].values.to_numpy() if kind[low + i] == 0 else slice(None)] = values
        yield low, x


def _losses(state, size: int):
    """Loss, gradient and its sum of every point (the intercept is last), over a partition's rows that are not of the point's fold."""

    def run(batches):
        points, folds = state.value
        total = np.zeros((len(points), size + 2))
        for batch in batches:
            label, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for low, x in _dense(batch.column(2), size):
                y, inside = label[low : low + len(x), None], fold[low : low + len(x), None] != folds
                z = x @ points[:, :-1].T + points[:, -1]
                off = (0.5 * (1 + np.tanh(z / 2)) - y) * inside
                total[:, 0] += ((np.logaddexp(0, z) - y * z) * inside).sum(axis=0)
                total[:, 1:-1] += off.T @ x
                total[:, -1] += off.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return run


def _quasi_newton(train: DataFrame, size: int, settings: list[tuple[float, int]], label: str, tol: float, steps: int, memory: int = 10) -> list[Linear]:
    """The L1 models of (penalty, fold that is left out; ``train`` has cv_fold), all of a group in step: orthant-wise limited-memory
    quasi-Newton steps (Andrew and Gao).

    A step is one job that streams over the rows for all fits; those whose loss does not fall enough by a full step try shorter
    ones in two more jobs at most.  Features are centred in the algebra alone, so vectors stay sparse.  A fit ends when ``memory`` steps
    gain less than ``tol`` of its first loss.
    """
    spark = train.sparkSession
    if (group := max(1, POINTS // size)) < len(settings):
        parts = [settings[i : i + group] for i in range(0, len(settings), group)]
        return [m for part in parts for m in _quasi_newton(train, size, part, label, tol, steps, memory)]
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, str(4 << 20))  # a batch of vectors is bounded by its bytes
    own = train.select(F.col(label).cast("double").alias("y"), F.col("cv_fold").cast("int"), "features")
    count = {r[0]: (r[1], r[2]) for r in own.groupBy("cv_fold").agg(F.count("*"), F.sum("y")).collect()}
    mean = own.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
    penalty, folds = np.array([p for p, _ in settings]), np.array([f for _, f in settings])
    rows, positive = (np.array([sum(v[i] for f, v in count.items() if f != out) for out in folds], float) for i in range(2))

    def at(points: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = points.copy()
        plain[:, -1] -= points[:, :-1] @ mean
        state = spark.sparkContext.broadcast((plain, folds[which]))
        parts = own.mapInArrow(_losses(state, size), "total binary").collect()
        state.destroy()
        total = np.sum([np.frombuffer(r["total"]) for r in parts], axis=0).reshape(len(points), -1) / rows[which, None]
        slope = total[:, 1:]
        slope[:, :-1] -= mean * slope[:, -1:]
        return total[:, 0] + penalty[which] * np.abs(points[:, :-1]).sum(axis=1), slope

    def downhill(w: np.ndarray, slope: np.ndarray, k: int) -> np.ndarray:
        """The gradient with the penalty's: of least size where a weight is 0."""
        out = np.where(w != 0, slope + penalty[k] * np.sign(w), np.sign(slope) * np.maximum(np.abs(slope) - penalty[k], 0))
        out[-1] = slope[-1]
        return out

    mixed = (positive > 0) & (positive < rows)
    point = np.zeros((len(settings), size + 1))
    point[mixed, -1] = np.log(positive[mixed] / (rows[mixed] - positive[mixed]))
    point[~mixed, -1] = np.where(positive[~mixed] > 0, np.inf, -np.inf)  # one class, as Spark's
    going, past, lengths = mixed.copy(), [[] for _ in settings], 2.0 ** -np.array([0, 1, 2, 4, 6, 8, 10])
    loss, slope = np.zeros(len(settings)), np.zeros_like(point)
    if going.any():
        loss[going], slope[going] = at(point[going], np.flatnonzero(going))
    history = [[v] for v in loss]
    for _ in range(steps):
        runs = np.flatnonzero(going)
        if not len(runs):
            break
        pseudo = np.stack([downhill(point[k], slope[k], k) for k in runs])
        ways = np.stack([_direction(pseudo[i], past[k]) for i, k in enumerate(runs)])
        ways[ways * pseudo >= 0] = 0
        orthant = np.where(point[runs] != 0, np.sign(point[runs]), -np.sign(pseudo))
        todo = np.arange(len(runs))
        for some in (lengths[:1], lengths[1:4], lengths[4:]):
            tried = point[runs[todo], None] + some[None, :, None] * ways[todo, None]
            tried[..., :-1][np.sign(tried[..., :-1]) != orthant[todo, None, :-1]] = 0
            which = np.repeat(runs[todo], len(some))
            new_loss, new_slope = at(tried.reshape(-1, size + 1), which)
            slant = (pseudo[todo, None] * (tried - point[runs[todo], None])).sum(axis=2)
            enough = new_loss.reshape(slant.shape) <= loss[runs[todo], None] + 1e-4 * slant
            for i in np.flatnonzero(enough.any(axis=1)):
                k, j = runs[todo[i]], int(enough[i].argmax())
                step, change = tried[i, j] - point[k], new_slope[i * len(some) + j] - slope[k]
                if step @ change > 1e-14:
                    past[k] = [*past[k], (step, change)][-memory:]
                point[k], loss[k], slope[k] = tried[i, j], new_loss[i * len(some) + j], new_slope[i * len(some) + j]
                history[k].append(loss[k])
                before = history[k][-1 - memory] if len(history[k]) > memory else np.inf
                going[k] = before - loss[k] > tol * abs(history[k][0])
            todo = todo[~enough.any(axis=1)]
            if not len(todo):
                break
        for i in todo:
            going[runs[i]] = bool(past[runs[i]])  # once more along the gradient, then the fit ends
            past[runs[i]] = []
    return [Linear(DenseVector(p[:-1]), float(p[-1] - (p[:-1] @ mean if m else 0))) for p, m in zip(point, mixed, strict=True)]


#: Features up to which a fit takes Newton steps: a partition sends the driver a square of them.
NARROW = 128


class Linear(NamedTuple):
    """A fitted model, as ``coefficient_table`` and ``probability`` read it."""

    coefficients: DenseVector
    intercept: float


def _curvature(point: np.ndarray):
    """Rows, positive rows, loss, gradient and second derivatives at ``point`` (the intercept is last), summed over a partition."""

    def run(batches):
        size = len(point)
        total = np.zeros(3 + size + size * size)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(1).flatten().to_numpy().reshape(len(y), size - 1), np.ones(len(y))])
            z = x @ point
            p = 0.5 * (1 + np.tanh(z / 2))
            total[:3] += len(y), y.sum(), (np.logaddexp(0, z) - y * z).sum()
            total[3 : 3 + size] += x.T @ (p - y)
            total[3 + size :] += (x.T @ (x * (p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return run


def _newton(train: DataFrame, size: int, penalty: float, label: str, tol: float, steps: int) -> Linear:
    """The L1 model by proximal Newton steps: each solves the penalized second-order model of the mean loss on the driver and
    halves the step until the loss falls enough.  A step is one job over all rows; ends as Spark's fits do, when a step gains
    less than ``tol`` of the loss."""
    own = train.select(F.col(label).cast("double").alias("y"), vector_to_array("features").alias("x"))

    def at(point: np.ndarray):
        parts = own.mapInArrow(_curvature(point), "total binary").collect()
        rows, positive, *rest = np.sum([np.frombuffer(r["total"]) for r in parts], axis=0)
        rest = np.array(rest) / rows
        return rows, positive, rest[0] + penalty * np.abs(point[:-1]).sum(), rest[1 : size + 2], rest[size + 2 :].reshape(size + 1, -1)

    point = np.zeros(size + 1)
    rows, positive, loss, slope, curve = at(point)
    if positive in (0, rows):  # one class, as Spark's
        return Linear(DenseVector(np.zeros(size)), float("inf") if positive else float("-inf"))
    for _ in range(steps):
        w, own_curve = point[:-1], max(curve[-1, -1], 1e-12)
        inner = curve[:-1, :-1] - np.outer(curve[:-1, -1], curve[-1, :-1]) / own_curve  # the intercept follows the weights
        inner[np.diag_indices(size)] += 1e-12
        outer = slope[:-1] - curve[:-1, -1] * slope[-1] / own_curve
        step = np.zeros(size + 1)
        step[:-1] = _penalized(inner, inner @ w - outer, penalty, w) - w
        step[-1] = -(slope[-1] + curve[-1, :-1] @ step[:-1]) / own_curve
        slant = slope @ step + penalty * (np.abs(w + step[:-1]).sum() - np.abs(w).sum())
        for length in 2.0 ** -np.arange(30):
            tried = point + length * step
            _, _, new, *more = at(tried)
            if new <= loss + 1e-4 * length * slant:
                break
        else:
            break
        gain, point, loss, (slope, curve) = loss - new, tried, new, more
        if gain <= tol * abs(loss):
            break
    return Linear(DenseVector(point[:-1]), float(point[-1]))


def _penalized(curve: np.ndarray, linear: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """The w of least w.curve.w / 2 - linear.w + penalty |w|, by feature-sign search: the signs of the weights are guessed, the
    equations of those signs are solved, and on the way there the best point where a weight becomes 0 is looked for."""
    w, close = start.copy(), 1e-9 * penalty + 1e-15
    value = lambda v: ((v @ curve) * v).sum(axis=-1) / 2 - v @ linear + penalty * np.abs(v).sum(axis=-1)
    best = value(w)
    for _ in range(100 * len(w)):
        slope, on, sign = curve @ w - linear, w != 0, np.sign(w)
        settled = not (np.abs(slope + penalty * sign)[on] > close).any()
        if settled:
            beyond = np.where(on, 0.0, np.abs(slope) - penalty)
            k = int(np.argmax(beyond))
            if beyond[k] <= close:
                break
            on[k], sign[k] = True, -np.sign(slope[k])
        live = np.flatnonzero(on)
        way = np.zeros(len(w))
        way[live] = np.linalg.solve(curve[np.ix_(live, live)], -(slope + penalty * sign)[live])
        cross = np.divide(-w, way, out=np.full(len(w), -1.0), where=way != 0)
        zero = np.flatnonzero((cross > 0) & (cross < 1))
        points = w + np.append(cross[zero], 1.0)[:, None] * way
        points[np.arange(len(zero)), zero] = 0.0
        values = value(points)
        j = int(np.argmin(values))
        if not values[j] < best:
            break
        w, best = points[j], values[j]
    return w


def probability(model, df: DataFrame, name: str = "score") -> DataFrame:
    if isinstance(model, Linear) and model.coefficients.size > NARROW:
        w, b = model.coefficients.toArray(), model.intercept
        z = F.udf(lambda v: float(v.dot(w)) + b, "double")("features")
        return df.withColumn(name, 1 / (1 + F.exp(-z)))
    if isinstance(model, Linear):
        z = sequences.dot(vector_to_array("features"), F.lit(model.coefficients.toArray().tolist())) + F.lit(model.intercept)
        return df.withColumn(name, 1 / (1 + F.exp(-z)))
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def choose_c(train: DataFrame, grid: list[float], folds: int = 5, key: str = "repertoire_id", label: str = "label") -> float:
    """The C of best mean AUROC over stratified folds (the first of equals).  Fits on narrow vectors run side by side, as each step
    of one is a small job; those on wide ones take a step of all in one job.  All of them are scored in one job."""
    tagged = spread(sampling.stratified_folds(train, label, key, folds))
    n = tagged.count()
    settings = [(c, f) for c in grid for f in range(folds)]
    if (size := _size(tagged)) > NARROW:
        models = _quasi_newton(tagged, size, [(1.0 / (c * max(n - n // folds, 1)), f) for c, f in settings], label, 1e-6, 100)
        return _best_c(_held_out(tagged, models, settings, key, label), grid, label)

    def scored(setting: tuple[float, int]) -> DataFrame:
        c, f = setting
        model = _l1(tagged.where(F.col("cv_fold") != f), c, n - n // folds, label)
        return probability(model, tagged.where(F.col("cv_fold") == f)).select(key, label, "score", "cv_fold", F.lit(c).alias("c"))

    with ThreadPool(SIDE_BY_SIDE) as pool:
        parts = pool.map(inheritable_thread_target(tagged.sparkSession)(scored), settings, chunksize=1)
    best = _best_c(functools.reduce(DataFrame.unionByName, parts), grid, label)
    tagged.unpersist()
    return best


def _best_c(scores: DataFrame, grid: list[float], label: str) -> float:
    by = metrics.auroc(scores, ["c", "cv_fold"], "score", label).groupBy("c").agg(F.avg("auroc").alias("mean")).where("mean is not null")
    means = {r["c"]: r["mean"] for r in by.collect()}
    return max(grid, key=lambda c: means.get(c, -1.0))


def _held_out(tagged: DataFrame, models: list[Linear], settings: list[tuple[float, int]], key: str, label: str) -> DataFrame:
    """(key, label, cv_fold, c, score): each row by the models that its fold was left out of, of every C."""
    size = models[0].coefficients.size
    state = tagged.sparkSession.sparkContext.broadcast((np.stack([m.coefficients.toArray() for m in models]), np.array([m.intercept for m in models])))
    cs, folds = (np.array(v) for v in zip(*settings, strict=True))

    def run(batches):
        weights, intercepts = state.value
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for low, x in _dense(batch.column(3), size):
                z = x @ weights.T + intercepts
                i, k = np.nonzero(fold[low : low + len(x), None] == folds)
                rows = [batch.column(c).take(pa.array(i + low)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(cs[k], pa.float64()), pa.array(0.5 * (1 + np.tanh(z[i, k] / 2)))], names=[*batch.schema.names[:3], "c", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in tagged.schema.fields}
    schema = f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, cv_fold {kinds['cv_fold']}, c double, score double"
    return tagged.select(key, label, "cv_fold", "features").mapInArrow(run, schema)


def coefficient_table(spark, model, scaled: DataFrame) -> DataFrame:
    """(feature, weight) of non-zero weights on the unscaled features, with the intercept as feature ''."""
    w = model.coefficients.toArray()
    hit = [(int(i), float(w[i])) for i in np.flatnonzero(w)]
    t = spark.createDataFrame([*hit, (-1, float(model.intercept))], "id int, w double")
    return t.join(scaled, "id", "left").select(F.coalesce("feature", F.lit("")).alias("feature"), F.when(F.col("id") < 0, F.col("w")).otherwise(F.col("w") / F.col("std")).alias("weight"))


def predict_long(long: DataFrame, coefficients: DataFrame, rows: DataFrame, key: str = "repertoire_id") -> DataFrame:
    """Probability of every row from the long features and the coefficient table alone: this is how saved models score."""
    z = long.join(coefficients, "feature").groupBy(key).agg(F.sum(F.col("value") * F.col("weight")).alias("z"))
    b = coefficients.where("feature = ''").select(F.col("weight").alias("b"))
    j = rows.join(z, key, "left").join(F.broadcast(b))  # one row
    return j.withColumn("score", 1 / (1 + F.exp(-(F.coalesce("z", F.lit(0.0)) + F.col("b"))))).drop("z", "b")


def blend(kmer: DataFrame, gene: DataFrame, key: str = "repertoire_id", label: str = "label") -> tuple[float, DataFrame]:
    """(alpha, scores): the weight 0.0 .. 1.0 of best AUROC (first of equals) for alpha * kmer + (1 - alpha) * gene."""
    j = kmer.select(key, label, F.col("score").alias("s1")).join(gene.select(key, F.col("score").alias("s2")), key)
    grid = j.withColumn("alpha", F.explode(F.array(*(F.lit(i / 10) for i in range(11))))).withColumn("score", F.col("alpha") * F.col("s1") + (1 - F.col("alpha")) * F.col("s2"))
    best = metrics.auroc(grid, ["alpha"], "score", label).orderBy(F.desc("auroc"), "alpha").first()
    alpha = float(best["alpha"])
    return alpha, grid.where(F.col("alpha") == alpha).select(key, label, "score")


def tree_sequence_scores(rows: DataFrame, trees: DataFrame, keys: list[str], key: str = "repertoire_id") -> DataFrame:
    """(key, cdr3_aa, score): the probability that a table of trees gives each distinct row (``keys``: cdr3_aa and what makes
    features), largest for each CDR3.

    ``rows``: (*keys, feature, value) in long form, the features of one sequence.  Distinct sequences are scored once.
    """
    named = rows.withColumn("__s", F.concat_ws("|", *keys))
    seen = named.select("__s").distinct()
    scored = boosting.predict(named.select("__s", "feature", "value").distinct(), trees, seen, "__s")
    held = named.select(key, "cdr3_aa", "__s")  # a sequence that comes twice changes no largest score
    return held.join(scored, "__s").groupBy(key, "cdr3_aa").agg(F.max("score").alias("score"))


def sequence_decisions(rep: DataFrame, kmer: DataFrame, gene: DataFrame, alpha: float, k: int = 4) -> DataFrame:
    """(repertoire_id, cdr3_aa, score): alpha times the k-mer model's decision plus 1 - alpha times the V/J model's, largest of
    each CDR3's (V, CDR3, J) triples.

    ``kmer``, ``gene``: (feature, weight) on unscaled features with the intercept as feature ''.  A sequence counts each of
    its k-mers, those with one residue blanked among them, as often as it has them, and each gene once.  Only features of
    non-zero weight are joined, and k-mers are cut up once for each distinct CDR3.
    """
    own = rep.select("repertoire_id", "cdr3_aa", "v_call", "j_call").where("cdr3_aa is not null and v_call is not null and j_call is not null").distinct()
    used = lambda w: w.where("feature <> '' and weight <> 0")
    intercept = lambda w: F.broadcast(w.where("feature = ''").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("b")))
    texts = own.select("cdr3_aa").distinct()
    cells = texts.select("cdr3_aa", F.explode(sequences.gapped_kmers(F.col("cdr3_aa"), k)).alias("feature")).join(used(kmer), "feature")
    by_text = cells.groupBy("cdr3_aa").agg(F.sum("weight").alias("z"))
    first = texts.join(by_text, "cdr3_aa", "left").join(intercept(kmer)).select("cdr3_aa", (F.coalesce("z", F.lit(0.0)) + F.col("b")).alias("__kmer"))
    out = own.join(first, "cdr3_aa").join(intercept(gene))
    for locus, column in (("V", "v_call"), ("J", "j_call")):
        own_weights = used(gene).where(F.col("feature").startswith(f"{locus}:")).select(F.expr("substring(feature, 3)").alias(column), F.col("weight").alias(f"__{locus}"))
        out = out.join(own_weights, column, "left")
    second = F.coalesce("__V", F.lit(0.0)) + F.coalesce("__J", F.lit(0.0)) + F.col("b")
    return out.groupBy("repertoire_id", "cdr3_aa").agg(F.max(alpha * F.col("__kmer") + (1 - alpha) * second).alias("score"))


def optimality(long: DataFrame, rows: DataFrame, coefficients: DataFrame, scaled: DataFrame, c: float, key: str = "repertoire_id", label: str = "label") -> DataFrame:
    """(feature, weight, slope, excess): how far an L1 model is from its optimum, by the table of its coefficients alone.

    slope is the derivative of the mean loss by the scaled feature (feature '' is the intercept); at the optimum it is
    -sign(weight) / (c n) where there is a weight, at most 1 / (c n) where there is none, 0 for the intercept.
    """
    n = rows.count()
    off = Scratch(long.sparkSession).write(predict_long(long, coefficients, rows, key).select(key, (F.col("score") - F.col(label)).alias("off")))
    by = long.join(off, key).join(scaled, "feature").groupBy("feature").agg((F.sum(F.col("off") * F.col("value") / F.col("std")) / n).alias("slope"))
    every = scaled.select("feature", "std").join(by, "feature", "left").join(coefficients, "feature", "left").select("feature", (F.coalesce("weight", F.lit(0.0)) * F.col("std")).alias("weight"), F.coalesce("slope", F.lit(0.0)).alias("slope"))
    bound = F.lit(1.0 / (c * max(n, 1)))
    excess = F.when(F.col("weight") == 0, F.greatest(F.abs("slope") - bound, F.lit(0.0))).otherwise(F.abs(F.col("slope") + F.signum("weight") * bound))
    middle = off.agg(F.lit("").alias("feature"), F.lit(0.0).alias("weight"), F.avg("off").alias("slope")).withColumn("excess", F.abs("slope"))
    return every.withColumn("excess", excess).unionByName(middle)


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negative rows for each positive one."""
    return df.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("positive_weight"))


def mil_scores(bags: DataFrame, weights: list[float], intercept: float, subjects: DataFrame) -> DataFrame:
    """Largest sigmoid(w.x + b) over a bag's instances; a bag without instances gets 0.5.

    ``bags``: (repertoire_id, x array<double>).
    """
    w = F.array(*(F.lit(float(v)) for v in weights))
    dot = F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(float(intercept)), lambda s, v: s + v)
    top = bags.groupBy("repertoire_id").agg(F.max(1 / (1 + F.exp(-dot))).alias("score"))
    return subjects.join(top, "repertoire_id", "left").withColumn("score", F.coalesce("score", F.lit(0.5)))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Instances that a task holds against all points at a time.
INSTANCES = 4_000


def _bag_sums(state, size: int):
    """Loss and gradient of every point, summed over the bags of a partition.

    A bag's largest instance is found in parts of INSTANCES, so memory does not follow the bag.
    """

    def run(batches):
        points = state.value
        total = np.zeros((len(points), size + 2))
        which = np.arange(len(points))
        for batch in batches:
            for y, flat in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = flat.values.to_numpy().reshape(-1, size)
                top, at = np.full(len(points), -np.inf), np.zeros(len(points), int)
                for low in range(0, len(x), INSTANCES):
                    z = x[low : low + INSTANCES] @ points[:, :size].T + points[:, size]
                    first = z.argmax(axis=0)
                    better = z[first, which] > top
                    top, at = np.where(better, z[first, which], top), np.where(better, first + low, at)
                p = 1 / (1 + np.exp(-np.clip(top, -500, 500)))
                q = np.clip(p, 1e-10, 1 - 1e-10)
                total[:, 0] -= y * np.log(q) + (1 - y) * np.log(1 - q)
                total[:, 1:-1] += (p - y)[:, None] * x[at]
                total[:, -1] += p - y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return run


def mil_fit(bags: DataFrame, labels: DataFrame, restarts: int = 200, steps: int = 1000, seed: int = 7, memory: int = 10) -> tuple[np.ndarray, float, float]:
    """(weights, intercept, training loss) of the best of ``restarts`` runs of limited-memory BFGS, all in step.

    A step is one Spark job for all runs: it takes the loss and the gradient of each run a full step along its direction
    (two-loop recursion over its last ``memory`` steps).  Runs whose loss that doesn't decrease enough try seven shorter
    steps in one more job and go on from the longest that does.  A run ends when a step gains less than 2.2e-9 of its loss or no length gains, or its gradient is below 1e-5.
    Weights and intercept start at N(0, (1/20)^2), the last weight at 0.

    A bag is one row of its instances: 4-mers are at most 160,000.  Bags are read from the shared folder in each step, so none is
    held by an executor between steps.  What reaches the driver is one sum for each partition.
    """
    size, spark = len(bags.first()["x"]), bags.sparkSession
    own = bags.groupBy("repertoire_id").agg(F.flatten(F.collect_list("x")).alias("flat"))
    held = Scratch(spark).write(own.join(labels.select("repertoire_id", F.col("label").cast("double").alias("y")), "repertoire_id").select("y", "flat"))
    n = held.count()
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, str(4 << 20))  # a batch of bags is bounded by its bytes, not by its 10,000 rows

    def losses(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = spark.sparkContext.broadcast(points)
        parts = [np.frombuffer(r["total"]).reshape(len(points), -1) for r in held.mapInArrow(_bag_sums(state, size), "total binary").collect()]
        state.destroy()
        total = np.sum(parts, axis=0) / max(n, 1)
        return total[:, 0], total[:, 1:]

    rng = np.random.default_rng(seed)
    point = np.hstack([rng.normal(0, 1 / 20, (restarts, size)), rng.normal(0, 1 / 20, (restarts, 1))])
    point[:, size - 1] = 0
    loss, slope = losses(point)
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(restarts)]
    going = np.abs(slope).max(axis=1) > 1e-5
    lengths = 2.0 ** -np.arange(8)
    for _ in range(steps):
        runs = np.flatnonzero(going)
        if not len(runs):
            break
        directions = np.stack([_direction(slope[r], past[r]) for r in runs])
        slant = (slope[runs] * directions).sum(axis=1)
        found = np.zeros(len(runs), int) - 1
        new_loss, new_slope, length = loss[runs].copy(), slope[runs].copy(), np.zeros(len(runs))
        for some in (lengths[:1], lengths[1:]):
            todo = np.flatnonzero(found < 0)
            if not len(todo):
                break
            tried = (point[runs[todo], None] + some[None, :, None] * directions[todo, None]).reshape(-1, size + 1)
            own_loss, own_slope = (x.reshape(len(todo), len(some), -1) for x in losses(tried))
            enough = own_loss[:, :, 0] <= loss[runs[todo], None] + 1e-4 * some * slant[todo, None]
            hit, at = todo[enough.any(axis=1)], enough.argmax(axis=1)[enough.any(axis=1)]
            row = np.flatnonzero(enough.any(axis=1))
            found[hit], new_loss[hit], new_slope[hit], length[hit] = at, own_loss[row, at, 0], own_slope[row, at], some[at]
        for i, r in enumerate(runs):
            if found[i] < 0:
                going[r] = bool(past[r])  # once more along the gradient, then the run ends
                past[r] = []
                continue
            step, change = length[i] * directions[i], new_slope[i] - slope[r]
            if step @ change > 1e-12:
                past[r] = [*past[r], (step, change)][-memory:]
            gain = loss[r] - new_loss[i]
            going[r] = gain > 2.2e-9 * max(abs(loss[r]), abs(new_loss[i]), 1.0) and np.abs(new_slope[i]).max() > 1e-5
            point[r], loss[r], slope[r] = point[r] + step, new_loss[i], new_slope[i]
    k = int(np.argmin(loss))
    return point[k, :-1], float(point[k, -1]), float(loss[k])


def _direction(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two-loop recursion; without a past the gradient, of length one at most."""
    q, weights = slope.copy(), []
    for step, change in reversed(past):
        a = (step @ q) / (step @ change)
        weights.append(a)
        q -= a * change
    if past:
        step, change = past[-1]
        q *= (step @ change) / (change @ change)
    else:
        q /= max(1.0, np.linalg.norm(q))
    for (step, change), a in zip(past, reversed(weights), strict=True):
        q += step * (a - (change @ q) / (step @ change))
    return -q if slope @ q > 0 else -slope


def residual_fit(long: DataFrame, covariates: DataFrame, train: DataFrame, names: list[str], key: str = "repertoire_id") -> DataFrame:
    """(feature, beta, std): each feature's least-squares fit on [1, covariates] over training rows, and the deviation of what is
    left there (1 where nothing is).

    ``covariates``: one row for each key, columns ``names`` complete.  X'X is small and inverted on the driver; X'y and y'y are
    one aggregation over the long table (absent values are 0 and add nothing), and r'r = y'y - beta X'y.
    """
    cols = ["__1", *names]
    known = covariates.withColumn("__1", F.lit(1.0)).join(train.select(key), key, "left_semi")
    sums = known.agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a in cols for b in cols)).first()
    n, inverse = sums[0], np.linalg.pinv(np.array([float(x or 0) for x in sums[1:]]).reshape(len(cols), len(cols)))
    y = F.col("value")
    by = long.select(key, "feature", "value").join(known.select(key, *cols), key).groupBy("feature").agg(F.array(*(F.sum(y * F.col(c)) for c in cols)).alias("xy"), F.sum(y * y).alias("yy"))
    rows = F.array(*(F.array(*map(F.lit, map(float, r))) for r in inverse))
    beta = by.withColumn("beta", F.transform(rows, lambda r: _dot(r, F.col("xy"))))
    left = F.col("yy") - _dot(F.col("beta"), F.col("xy"))
    return beta.select("feature", "beta", F.when(left > 1e-12 * F.col("yy"), F.sqrt(left / max(n, 1))).otherwise(1.0).alias("std"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def residualized(long: DataFrame, covariates: DataFrame, train: DataFrame, names: list[str], key: str = "repertoire_id") -> DataFrame:
    """(key, feature, value): features minus their least-squares fit on [1, covariates], fitted on training rows.

    The result is dense: every key of ``covariates`` has every feature.  ``residual_vectors`` and ``predict_residuals`` train and
    score without it.
    """
    grid = covariates.select(key, F.array(F.lit(1.0), *names).alias("c")).crossJoin(residual_fit(long, covariates, train, names, key))
    return grid.join(long.select(key, "feature", "value"), [key, "feature"], "left").select(key, "feature", (F.coalesce("value", F.lit(0.0)) - _dot("c", "beta")).alias("value"))


def residual_vectors(long: DataFrame, fitted: DataFrame, rows: DataFrame, covariates: DataFrame, names: list[str], key: str = "repertoire_id") -> DataFrame:
    """``rows`` with a dense vector of residuals, each divided by its feature's deviation.

    ``fitted``: ``residual_fit`` with an ``id`` for each feature.  Only the sparse features are shuffled; the fit (one row for
    each feature, of model size) goes to the executors, and a row becomes dense in its task.  A key without covariates is dropped.
    """
    spark = rows.sparkSession
    of_model = fitted.orderBy("id").select("beta", "std").toPandas()
    size = len(of_model)
    betas = np.array(of_model["beta"].tolist(), float).reshape(size, len(names) + 1)
    state = spark.sparkContext.broadcast((betas, of_model["std"].to_numpy(float)))

    def dense(batches):
        beta, std = state.value
        for batch in batches:
            for at in range(0, len(batch), 16):  # 16 rows of 160,000 features are 20 MB
                part = batch.iloc[at : at + 16].copy()
                x = -np.array(part["__c"].tolist(), float) @ beta.T
                for i, (ids, values) in enumerate(zip(part["__ids"], part["__xs"], strict=True)):
                    if ids is not None:
                        x[i, ids] += values
                part["__x"] = list(x / std)
                yield part.drop(columns=["__c", "__ids", "__xs"])

    cells = long.join(fitted.select("feature", "id"), "feature").groupBy(key).agg(F.collect_list(F.struct("id", "value")).alias("__v")).select(key, F.col("__v.id").alias("__ids"), F.col("__v.value").alias("__xs"))
    own = rows.join(covariates.select(key, F.array(F.lit(1.0), *(F.col(c).cast("double") for c in names)).alias("__c")), key).join(cells, key, "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return own.select(*rows.columns, "__c", "__ids", "__xs").mapInPandas(dense, f"{schema}, __x array<double>").withColumn("features", array_to_vector("__x")).drop("__x")


def predict_residuals(long: DataFrame, coefficients: DataFrame, fitted: DataFrame, rows: DataFrame, covariates: DataFrame, names: list[str], key: str = "repertoire_id") -> DataFrame:
    """Probability of every row from sparse features: sum of w (y - c beta) is the sum of w y less c times the sum of w beta.

    ``coefficients``: (feature, weight) on residuals, the intercept as feature ''; rows without covariates are dropped.
    """
    used = coefficients.join(fitted.select("feature", "beta"), "feature")
    z = long.join(used.select("feature", "weight"), "feature").groupBy(key).agg(F.sum(F.col("value") * F.col("weight")).alias("__z"))
    fit = used.agg(F.array(*(F.coalesce(F.sum(F.col("weight") * F.col("beta")[i]), F.lit(0.0)) for i in range(len(names) + 1))).alias("__fit"))
    b = coefficients.where("feature = ''").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("__b"))
    c = covariates.select(key, F.array(F.lit(1.0), *(F.col(c).cast("double") for c in names)).alias("__c"))
    j = rows.join(c, key).join(z, key, "left").join(F.broadcast(fit)).join(F.broadcast(b))  # one row each
    return j.withColumn("score", 1 / (1 + F.exp(-(F.coalesce("__z", F.lit(0.0)) + F.col("__b") - _dot("__c", "__fit"))))).drop("__z", "__b", "__c", "__fit")


def kmeans_clusters(df: DataFrame, vector: str, k: int, seed: int = 7, sample: float = 1.0) -> DataFrame:
    """Clusters fitted on a share of the rows, all rows assigned to their nearest centre."""
    v = df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed).fit(v if sample >= 1 else v.sample(sample, seed))
    return model.transform(v).drop("features").withColumnRenamed("prediction", "cluster")


def demographic_features(meta: DataFrame, mean_age: float) -> DataFrame:
    """age (mean where missing), age_missing, sex_M and sex_unknown as numbers; ancestry: ``ancestry_columns``."""
    return meta.withColumns({
        "c_age": F.coalesce("age", F.lit(mean_age)), "c_age_missing": F.col("age").isNull().cast("double"), "c_sex_m": F.coalesce((F.col("sex") == "M").cast("double"), F.lit(0.0)), "c_sex_unknown": F.col("sex").isNull().cast("double"),
    })


def ancestry_columns(meta: DataFrame, known: list[str]) -> dict:
    """One-hot columns c_<ancestry> of the shared vocabulary ``known``; others and nulls are all 0."""
    return {f"c_{a.lower().replace('/', '_').replace(' ', '_')}": F.coalesce((F.col("ancestry") == a).cast("double"), F.lit(0.0)) for a in known}


#: Inverse penalties of the demographic model.
DEMOGRAPHIC_C = [1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0]


def l2_logistic(train: DataFrame, c: float, n: int, label: str = "label"):
    return LogisticRegression(labelCol=label, elasticNetParam=0.0, regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=200).fit(train)


def demographic_model(train: DataFrame, validation: DataFrame, columns: list[str], grid: list[float] = DEMOGRAPHIC_C, key: str = "specimen_label", label: str = "label"):  # noqa: B006
    """(C, scale) -> the L2 model of best validation AUROC (the first of equals), refitted on training and validation rows.

    Returns (C, function that scores a table of the same columns).
    """
    t, v = standardized(train, validation, columns)
    n, scored = train.count(), None
    for c in grid:
        one = probability(l2_logistic(t, c, n, label), v).select(label, "score", F.lit(c).alias("c"))
        scored = one if scored is None else scored.unionByName(one)
    best = metrics.auroc(scored, ["c"], "score", label).where("auroc is not null").orderBy(F.desc("auroc"), "c").first()
    c = best["c"] if best else 1.0
    both = train.unionByName(validation)
    model = l2_logistic(standardized(both, both, columns)[0], c, both.count(), label)
    return c, lambda df: probability(model, standardized(both, df, columns)[1]).drop("features")


def usage_and_demographics(long: DataFrame, meta: DataFrame, train: DataFrame, test: DataFrame, grid: list[float] = GENE_C, folds: int = 5, least: int = 10, key: str = "repertoire_id"):  # noqa: B006
    """(C, scores): L1 model on repertoire features and demographics together, C by cross-validation (1.0 where a class has
    fewer than ``least`` rows)."""
    from .features import joined_features

    every = joined_features(long, meta)
    scaled = scales(every, feature_index(every, train, key), train, key).persist()
    v = vectors(every, scaled, train, key).persist()
    sizes = [r["count"] for r in train.groupBy("label").count().collect()]
    c = choose_c(v, grid, folds, key) if len(sizes) > 1 and min(sizes) >= least else 1.0
    return c, predict_long(every, coefficient_table(long.sparkSession, l1_logistic(v, c, v.count()), scaled), test, key)


def embedding_and_demographics(df: DataFrame, train: DataFrame, vector: str, columns: list[str], grid: list[float] = GENE_C, folds: int = 5, key: str = "specimen_label"):  # noqa: B006
    """(C, scores of ``df``): two blocks, standardized each on ``train``, concatenated for an L1 model with C by
    cross-validation."""
    from pyspark.ml.functions import array_to_vector as to_vector

    place = lambda x: x.withColumn("__e", to_vector(F.transform(vector, lambda c: c.cast("double"))))
    scaler = StandardScaler(inputCol="__e", outputCol="__es", withMean=True).fit(place(train))
    joined = VectorAssembler(inputCols=["__es", "__ds"], outputCol="features")
    out = []
    for x in standardized(train, df, columns):
        both = scaler.transform(place(x.withColumnRenamed("features", "__ds")))
        out.append(joined.transform(both).drop("__e", "__es", "__ds"))
    t = out[0].persist()
    c = choose_c(t, grid, folds, key)
    return c, probability(l1_logistic(t, c, t.count()), out[1]).drop("features")


def abundance_method(bags: dict[str, DataFrame], train: DataFrame, validation: DataFrame, **fit) -> tuple[str, tuple]:
    """(name, model): of several encodings of the bags the one whose model has the best validation AUROC (first of equals)."""
    best = (-1.0, "", ())
    for name, b in bags.items():
        model = mil_fit(b, train, **fit)
        auc = metrics.auroc(mil_scores(b, model[0].tolist(), model[1], validation).withColumn("m", F.lit(name)), ["m"], "score", "label").first()
        if auc and auc["auroc"] is not None and auc["auroc"] > best[0]:
            best = (auc["auroc"], name, model)
    return best[1], best[2]


def standardized(train: DataFrame, df: DataFrame, columns: list[str], center: bool = True) -> tuple[DataFrame, DataFrame]:
    assembler = VectorAssembler(inputCols=columns, outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=center).fit(assembler.transform(train))
    return tuple(scaler.transform(assembler.transform(x)).drop("raw_features") for x in (train, df))


def attribution(df: DataFrame, score: str, vector: str = "features") -> list[float]:
    """Linear weights of a predicted score on the feature vector."""
    return LinearRegression(featuresCol=vector, labelCol=score, regParam=1e-6).fit(df).coefficients.toArray().tolist()


def class_attribution(df: DataFrame, scores: dict[str, str], names: list[str], vector: str = "features") -> DataFrame:
    """(class, feature, weight, rank): each class's linear weights, largest first; ``scores``: class -> score column."""
    rows = [(k, n, w) for k, c in scores.items() for n, w in zip(names, attribution(df, c, vector), strict=True)]
    out = df.sparkSession.createDataFrame(rows, "class string, feature string, weight double")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("weight"), "feature")))


def average_over_splits(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Mean of a row's test predictions over repeated splits; 0 for rows that were never tested."""
    return rows.join(predictions.groupBy(key).agg(F.avg("score").alias("score")), key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
