"""Toxicity by a classifier chain: linear models in sequence, each of which sees the earlier categories' probabilities.

1. Vocabulary: over the labelled documents (at most ``most_rows``, by hash of their id, a documented bound of the fit) Spark
   counts, for every word, the documents of each category that hold it; the ``terms`` words with the largest chi-squared
   statistic of each category are the features, log2(1 + occurrences) their values.
2. Chain: category k is fitted on the features and the logits of categories 1..k-1.  For fitting these are out-of-fold: each
   fold's rows are predicted by models that did not see them, so the later model meets probabilities as uncertain as they
   will be.  For prediction the models fitted on all rows are used.
3. Prediction is one map over the documents: word fingerprints are looked up in the vocabulary, scores are summed by text.

Only the bounded fit (rows x features that occur) comes to the driver; documents never do.

Defined results: a null or empty text has no features and gets the model's base rate; labels of unknown documents and null
labels are left out; of repeated labels the largest counts; without labelled rows, or with one class alone, a category's
probability is its constant share (0 without rows); rows that repeat are predicted each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .texts import cache, raw, row_groups, small_batches, word_hashes


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept of an L2-penalised logistic regression, by Newton steps."""
    n, k = x.shape
    w = np.zeros(k + 1)
    share = min(max(y.mean() if n else 0.0, 1e-6), 1 - 1e-6)
    w[-1] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return w
    penalty = np.full(k + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        slope, curve = penalty * w, np.diag(penalty)
        for at in range(0, n, 1000):  # blocks, so that no second matrix of all rows is made
            a = np.hstack([x[at : at + 1000].astype(float), np.ones((min(1000, n - at), 1))])
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope += a.T @ (p - y[at : at + 1000])
            curve += (a * (p * (1 - p))[:, None]).T @ a
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: int = 3) -> list[np.ndarray]:
    """One weight vector for each column of ``labels`` (rows x categories), in order; fold of a row: its number mod folds."""
    fold = np.arange(len(x)) % folds
    seen, models = x, []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(_fit(seen, y))
        out = np.zeros(len(x))
        for f in range(folds):
            w = _fit(seen[fold != f], y[fold != f])
            out[fold == f] = np.clip(seen[fold == f] @ w[:-1] + w[-1], -8, 8)
        seen = np.hstack([seen, out[:, None].astype(x.dtype)])
    return models


def predict_chain(scores: np.ndarray, models: list[np.ndarray], terms: int) -> np.ndarray:
    """Probabilities (rows x categories) from each category's linear score of the features."""
    logits: list[np.ndarray] = []
    for k, w in enumerate(models):
        z = scores[:, k] + w[-1]
        for j, earlier in enumerate(logits):
            z = z + w[terms + j] * earlier
        logits.append(np.clip(z, -8, 8))
    return 1 / (1 + np.exp(-np.stack(logits, axis=1))) if logits else np.zeros((len(scores), 0))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, word, n): the distinct words of each text."""
    cache("toxicity")
    for batch in batches:
        data, offsets = raw(batch.column(1))
        for a, b in row_groups(offsets):
            hashes, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True, True)
            text = np.repeat(np.arange(b - a), counts)
            signed = hashes.view(np.int64)
            order = np.lexsort((signed, text))
            text, signed = text[order], signed[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (signed[1:] != signed[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(text)))
            rows = batch.column(0).slice(a, b - a).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rows[text[at]]), pa.array(signed[at]), pa.array(n.astype(np.int32))], names=["row", "word", "n"])


class Chain:
    """A fitted chain: vocabulary (sorted word fingerprints), models, names of the categories."""

    def __init__(self, words: np.ndarray, models: list[np.ndarray], names: list[str]):
        self.words, self.models, self.names = words, models, names

    def predict(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns (all) of ``docs`` and p_<category> for each category."""
        keep = list(docs.columns) if keep is None else keep
        words, models, names = self.words, self.models, self.names
        if clash := {f"p_{n}" for n in names} & set(keep):
            raise ValueError(f"columns of that name exist: {sorted(clash)}; name those to keep")
        small_batches(docs.sparkSession)
        maybe = np.zeros(1 << 16, bool)
        maybe[(words.view(np.uint64) >> np.uint64(48)).astype(np.int64)] = True
        weights = np.stack([w[: len(words)] for w in models], axis=1)
        # A text that is kept is sent to the workers once.
        kept_text = text in keep and docs.schema[text].dataType.typeName() == "string"
        picked = docs.select(*keep) if kept_text else docs.select(*keep, F.col(text).cast("string").alias("__text"))
        text_at = keep.index(text) if kept_text else len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache("toxicity")
            for batch in batches:
                data, offsets = raw(batch.column(text_at))
                parts = [np.zeros((0, len(models)))]
                for a, b in row_groups(offsets):
                    hashes, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True, True)
                    at = np.flatnonzero(maybe[(hashes >> np.uint64(48)).astype(np.int64)])
                    signed = hashes[at].view(np.int64)
                    place = np.minimum(np.searchsorted(words, signed), max(len(words) - 1, 0))
                    hit = words[place] == signed if len(words) else np.zeros(len(at), bool)
                    text_of = np.searchsorted(np.cumsum(counts), at[hit], "right")
                    pair, n = np.unique(text_of * max(len(words), 1) + place[hit], return_counts=True)
                    row, term = np.divmod(pair, max(len(words), 1))
                    value = np.log2(1 + n)[:, None] * weights[term] if len(pair) else np.zeros((0, len(models)))
                    scores = np.stack([np.bincount(row, value[:, k], b - a) for k in range(len(models))], axis=1)
                    parts.append(predict_chain(scores, models, len(words)))
                p = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(p[:, k]) for k in range(len(models)))], names=[*keep, *(f"p_{n}" for n in names)])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)]), *(f"p_{n} double" for n in names)])
        return picked.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most_rows: int = 20_000, terms: int = 128, least: int = 5, doc_id: str = "doc_id", text: str = "text") -> Chain:
    """``categories``: name -> condition on ``labels``' columns, in the chain's order.

    Bounds of the fit: ``most_rows`` labelled ids, ``terms`` words for each category, each held by ``least`` labelled documents
    or more.  Rows that share an id count as one: a word's largest number in any of them.
    """
    small_batches(docs.sparkSession)
    scratch, names = Scratch(docs.sparkSession), list(categories)
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("row")).agg(*(F.max(c.cast("int")).alias(f"y{k}") for k, c in enumerate(categories.values())))
    known = known.where(" and ".join(f"y{k} is not null" for k in range(len(names))))
    total = known.count()
    if total > most_rows:
        known = known.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < int(1_000_000 * most_rows / total))
    rows = docs.select(F.col(doc_id).alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    held = rows.join(F.broadcast(known.select("row")), "row", "left_semi")  # at most most_rows ids
    words = scratch.write(held.mapInArrow(_words, f"row {kind}, word bigint, n int"))
    sizes = words.select("row").distinct().join(known, "row").agg(F.count("*").alias("n"), *(F.sum(f"y{k}").alias(f"s{k}") for k in range(len(names)))).first()
    n = sizes[0] or 0
    counts = words.select("row", "word").distinct().join(F.broadcast(known), "row").groupBy("word").agg(F.count("*").alias("df"), *(F.sum(f"y{k}").alias(f"a{k}") for k in range(len(names)))).where(F.col("df") >= least)
    chosen: set[int] = set()
    for k in range(len(names)):
        s = sizes[k + 1] or 0
        gap = F.col(f"a{k}") * n - F.col("df") * s
        chi = gap * gap / (F.col("df") * (n - F.col("df") + 1).cast("double") * max(s, 1) * max(n - s, 1))
        chosen |= {r[0] for r in counts.orderBy(F.desc(chi), "word").limit(terms).select("word").collect()}
    vocabulary = np.array(sorted(chosen), np.int64)
    found = words.where(F.col("word").isin(vocabulary.tolist())).groupBy("row", "word").agg(F.max("n").alias("n"))
    marked = known.join(words.select("row").distinct(), "row", "left_semi").orderBy(F.xxhash64("row"), "row").toPandas()
    place = {r: i for i, r in enumerate(marked["row"])}
    x = np.zeros((len(marked), len(vocabulary)), np.float32)
    cells = found.groupBy("row").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns")).toArrow()
    for batch in cells.to_batches():
        for row, held, n in zip(*(batch.column(i) for i in range(3)), strict=True):
            x[place[row.as_py()], np.searchsorted(vocabulary, held.values.to_numpy())] = np.log2(1 + n.values.to_numpy())
    y = marked[[f"y{k}" for k in range(len(names))]].to_numpy() if len(marked) else np.zeros((0, len(names)))
    return Chain(vocabulary, fit_chain(x, y), names)
