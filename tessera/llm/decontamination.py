"""Benchmark decontamination: documents that hold a benchmark item up to a few changed, lost or added words.

A string's CGK embedding walks through it with random stops: output j is the current symbol, and whether the walk then
moves on is a random bit of (j, symbol).  Two strings of edit distance k walk in step again soon after an edit, so their
outputs differ in few places.  Symbols are words (lower case, without ASCII punctuation).

1. Windows of an item's size are taken where a document shares enough word trigrams with an item of that size, at the
   places these imply and up to k words to either side.  An edit destroys three trigrams at most, so a match of an item of n
   words with at most k = n // 5 edits keeps n - 2 - 3 k >= 1 of them, on diagonals that differ by at most k: no match lies
   elsewhere.
2. Each window is embedded several times with different walks; some outputs of each form a bucket key.  A window meets the
   items of step 1 with an equal key in any repetition.  Both numbers are calibrated for each size of items: strings with k
   random edits are embedded by the walks used, and repetitions are added until the share found is ``recall``.  The longer
   the items, the rarer equal outputs are, so fewer are sampled where ``SOME_REPEATS`` repetitions are not enough; with one
   output there is no bound on the repetitions.
3. Every meeting is verified: edit distance (words) between the item and the best substring around the window, at most k.
   ``first_word`` is where the best one begins: of least edits the first to end, and of these the shortest.

Items are handed to the executors in slices of at most ``slice_words`` words, so what is sent is bounded; a larger benchmark
takes more passes over the documents.  Documents are only mapped; the shuffle afterwards has matches alone.

Defined results: null or empty texts match nothing; items of fewer than three words take no part, those of three to five
must stand unchanged; a null document id or item id is carried through; rows that repeat are matched each on its own and
give one match.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import cache, mixed, raw, row_groups, seeded, small_batches, windows, word_hashes

SAMPLED, SOME_REPEATS, TRIALS = 4, 24, 400


def allowed(n):
    """Edits that a match of an item of n words may have."""
    return np.where(n >= 6, n // 5, 0)


def embed(words: np.ndarray, starts: np.ndarray, n: int, sampled: int, repeats: int) -> np.ndarray:
    """Bucket keys (window, repetition) of the windows of ``n`` words at ``starts``; a repetition is the same in any number."""
    steps = 2 * n  # about as many as a walk takes
    walk = seeded(steps * repeats, 11 + n).reshape(repeats, steps).T
    rng = np.random.default_rng(n)
    picked = np.zeros((steps, repeats), bool)
    for r in range(repeats):
        picked[rng.choice(steps, SAMPLED, replace=False)[:sampled], r] = True
    padded = np.append(words, np.uint64(0))
    at = np.zeros((len(starts), repeats), np.int64)
    key = np.zeros((len(starts), repeats), np.uint64)
    base = starts[:, None]
    for j in range(steps):
        symbol = padded[np.where(at < n, base + at, len(words))]
        if picked[j].any():
            key = np.where(picked[j], mixed(key * np.uint64(0x9E3779B97F4A7C15) + symbol + np.uint64(1)), key)
        at += (mixed(symbol ^ walk[j]) & np.uint64(1)).astype(np.int64)
    return key


def calibrated(n: int, recall: float) -> tuple[int, int]:
    """(outputs sampled, repetitions) that find ``recall`` of the items of ``n`` words with as many random edits as allowed.

    Half of the share that may be lost is kept for the error of the measurement.
    """
    if not (k := int(allowed(np.int64(n)))):
        return SAMPLED, 1  # equal strings have equal keys
    rng = np.random.default_rng(5)
    both = []
    for _ in range(TRIALS):
        item = rng.integers(1 << 62, size=n).tolist()
        changed = list(item)
        for _ in range(k):
            p = int(rng.integers(len(changed)))
            kind = rng.integers(3)
            changed[p : p + int(kind != 1)] = [int(rng.integers(1 << 62))] * int(kind != 2)
        both += [*item, *[*changed, *rng.integers(1 << 62, size=n).tolist()][:n]]
    both, starts = np.array(both, np.uint64), np.arange(2 * TRIALS) * n
    sampled, repeats = SAMPLED, SOME_REPEATS
    while True:
        keys = embed(both, starts, n, sampled, repeats)
        share = np.maximum.accumulate(keys[::2] == keys[1::2], axis=1).mean(axis=0)
        if len(enough := np.flatnonzero(share >= 1 - (1 - recall) / 2)):
            return sampled, int(enough[0]) + 1
        sampled, repeats = (sampled - 1, repeats) if sampled > 1 else (1, 2 * repeats)


def _distances(item: np.ndarray, words: np.ndarray, free: bool) -> np.ndarray:
    """Edit distance of ``item`` to the prefixes of ``words``; with ``free``, to the best substring with the same end.

    Row by row; what a cell takes from the cell to its left is a running minimum of the row less its column numbers.
    """
    column = np.arange(len(words) + 1)
    row = np.zeros_like(column) if free else column
    for i, x in enumerate(item, 1):
        new = np.append(i, np.minimum(row[:-1] + (words != x), row[1:] + 1))
        row = np.minimum.accumulate(new - column) + column
    return row


def edits(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, end) of the substring of ``words`` nearest to ``item``: the first to end, then the shortest."""
    row = _distances(item, words, True)
    end = int(row.argmin())
    back = _distances(item[::-1], words[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


def item_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as hashes, and their number in each."""
    data, offsets = raw(pa.array(texts, pa.large_string()))
    return word_hashes(data, offsets, True, True)


class Items:
    """One slice of a benchmark as arrays: trigrams, and the bucket keys of each item.

    ``effort``: size -> (outputs sampled, repetitions).
    """

    def __init__(self, ids: list, texts: list, effort: dict[int, tuple[int, int]]):
        self.words, counts = item_words(texts)
        self.ids, self.n = ids, counts
        self.begin = np.cumsum(counts) - counts
        grams, n = windows(self.words, counts, 3)
        owner = np.repeat(np.arange(len(counts)), n)
        place = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(grams, kind="stable")
        self.grams, self.gram_item, self.gram_place = grams[order], owner[order], place[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(grams >> np.uint64(44)).astype(np.int64)] = True
        self.effort = effort
        self.keys: dict[int, np.ndarray] = {}
        self.row = np.zeros(len(counts), np.int64)
        for size in np.unique(counts[counts >= 3]).tolist():
            own = np.flatnonzero(counts == size)
            self.keys[size] = embed(self.words, self.begin[own], size, *effort[size])
            self.row[own] = np.arange(len(own))

    def matches(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, edits) of every item found in the texts, once for each text and item."""
        grams, n = windows(words, counts, 3)
        if not len(grams) or not len(self.grams):
            return []
        hit = np.flatnonzero(self.maybe[(grams >> np.uint64(44)).astype(np.int64)])
        low, high = np.searchsorted(self.grams, grams[hit], "left"), np.searchsorted(self.grams, grams[hit], "right")
        many = high - low
        if not many.sum():
            return []
        which = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        gram = np.repeat(hit, many)
        first, begin = np.cumsum(n) - n, np.cumsum(counts) - counts
        text = np.searchsorted(first, gram, "right") - 1
        item = self.gram_item[which]
        place = gram - first[text] - self.gram_place[which]
        k = allowed(self.n[item])
        run = (text * len(self.ids) + item) << 32
        order = np.argsort(run + place, kind="stable")
        run, spot, near = run[order], (run + place)[order], k[order]
        enough = np.searchsorted(spot, spot + near, "right") - np.searchsorted(spot, spot - near, "left") >= self.n[item[order]] - 2 - 3 * near
        order = order[enough]
        text, item, place, k = text[order], item[order], place[order], k[order]
        if not len(order):
            return []
        size = self.n[item]
        spread = 2 * k + 1
        rows = np.repeat(np.arange(len(item)), spread)
        start = place[rows] - k[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(spread) - spread, spread)
        text, item, size = text[rows], item[rows], size[rows]
        start = np.clip(start, 0, np.maximum(counts[text] - size, 0))
        todo = np.unique(np.stack([size, text, start, item]), axis=1)
        todo = todo[:, todo[0] <= counts[todo[1]] + allowed(todo[0])]
        met: dict[tuple[int, int], set[int]] = {}
        padded = np.append(words, np.zeros(int(self.n.max()), np.uint64))
        for s in np.unique(todo[0]).tolist():
            some = todo[1:, todo[0] == s]
            for a in range(0, some.shape[1], 20_000):
                texts, starts, items = some[:, a : a + 20_000]
                places, which = np.unique(begin[texts] + starts, return_inverse=True)
                keys = embed(padded, places, s, *self.effort[s])
                equal = (keys[which] == self.keys[s][self.row[items]]).any(axis=1)
                for t, w, i in zip(texts[equal].tolist(), starts[equal].tolist(), items[equal].tolist(), strict=True):
                    met.setdefault((t, i), set()).add(w)
        out = []
        for (t, i), starts in sorted(met.items()):
            n_i, k_i = int(self.n[i]), int(allowed(self.n[i]))
            own = self.words[self.begin[i] : self.begin[i] + n_i]
            best, done = (k_i + 1, 0, 0), -1
            for s in sorted(starts):
                if s <= done or best[0] == 0:
                    continue
                a, b = max(0, s - 2 * k_i), min(int(counts[t]), s + n_i + 4 * k_i)
                k, first, end = edits(own, words[begin[t] + a : begin[t] + b])
                best, done = min(best, (k, a + end, a + first)), s + k_i
            if best[0] <= k_i:
                out.append((t, i, best[2], best[0]))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, recall: float = 0.99, slice_words: int = 500_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Matches (doc_id, item_id, first_word, edits), one row for each document and item."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("length(text) > 0")
    spark, kinds = docs.sparkSession, f"doc_id {docs.schema[0].dataType.simpleString()}, item_id {items.schema[0].dataType.simpleString()}"
    found = spark.createDataFrame([], f"{kinds}, first_word bigint, edits int")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = 1 + int(words) // (4 * slice_words)
    effort: dict[int, tuple[int, int]] = {}
    for part in range(slices):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == part).distinct().collect()  # at most a slice
        if not rows:
            continue
        counts = item_words([r[1] for r in rows])[1]
        sizes = [n for n in np.unique(counts[counts >= 3]).tolist() if n not in effort]
        if sizes:  # long items take longest: each is a task of its own
            effort |= dict(spark.sparkContext.parallelize(sizes[::-1], len(sizes)).map(lambda n: (n, calibrated(n, recall))).collect())
        known = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], {n: effort[n] for n in np.unique(counts[counts >= 3]).tolist()}))
        found = found.unionByName(docs.mapInArrow(_matcher(known, docs.schema[0].dataType, items.schema[0].dataType), f"{kinds}, first_word bigint, edits int"))
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_word")).alias("best")).select("doc_id", "item_id", F.col("best.first_word").alias("first_word"), F.col("best.edits").alias("edits"))


def _matcher(known, doc_type, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    kinds, name = (to_arrow_type(doc_type), to_arrow_type(item_type)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = cache("items")
        if name not in made:
            made.clear()
            made[name] = Items(*known.value)
        items = made[name]
        for batch in batches:
            data, offsets = raw(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in row_groups(offsets):
                words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True, True)
                if rows := items.matches(words, counts):
                    text, item, first, k = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[a + t] for t in text], kinds[0]), pa.array([items.ids[i] for i in item], kinds[1]), pa.array(first, pa.int64()), pa.array(k, pa.int32())],
                        names=["doc_id", "item_id", "first_word", "edits"],
                    )

    return run
