"""Removal of long passages that repeat across documents, found by recompression.

Words are the symbols of level 0.  A round names what it merges into the symbols of the next level, first runs (a word
repeated any number of times), then ROUNDS times pairs: two neighbours are merged where the left one falls in the one and the
right one in the other half of all symbols of that level.  Decisions rest on neighbouring symbols alone, and a name is a
64-bit fingerprint of the names merged, so all executors deal out the same names for the whole corpus without a dictionary
to shuffle, and equal substrings get equal interior symbols wherever they stand.

Which symbols are interior is tracked: with each symbol goes its context, the words that its making looked at.  A symbol
whose context lies within a window of 50 words is *safe*: every equal window has it at the same place, however long the runs
and symbols around are.  From safe symbols come

* a window's anchor: the longest safe symbol (ties by name) of the highest level that has one; equal windows share it;
* a window's parse: its safe symbols of the highest level, then to both sides what safe symbols of each lower level add,
  down to words.  Equal windows have equal parses, and a parse spells its window.

The job:

1. map: anchors of each document; documents with the same words become one representative.
2. shuffle (anchor, document): the symbols that stand in two documents or more reveal where passages may repeat.
3. map over the documents that hold one: the windows with such an anchor, keyed by their parse and by their words (64 bits
   each, so that unequal windows do not meet at any corpus size).
4. shuffle (window, document): each window's smallest document; windows of larger documents are removed.

Defined results: null or empty texts and texts under 50 words lose nothing; a null id takes no part and loses nothing;
rows that repeat an id are separate rows, neither removes the other's words; only ids and texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, only
from .texts import cache, mixed, powers, raw, row_groups, seeded, small_batches, windows, word_hashes

#: Rounds of pairs; after six a symbol has between five and six words on average.
ROUNDS = 6
_A = seeded(8, 3)


class Level:
    """Symbols in order: their names, the words [start, end) they spell and the words [left, right) of their context.

    Words are numbered through all texts; a symbol whose making looked past its text's ends has a context beyond them.
    """

    def __init__(self, names, start, end, left, right, text):
        self.names, self.start, self.end, self.left, self.right, self.text = names, start, end, left, right, text
        up, self.down = powers(len(names) + 1)
        self.sums = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(names * up[: len(names)], out=self.sums[1:])

    def safe(self, window: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First safe symbol of each window and the one after its last; contexts are in order."""
        low = np.searchsorted(self.left, window, "left")
        return low, np.maximum(np.searchsorted(self.right, window + size, "right"), low)

    def print(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A fingerprint of the symbols [low, high)."""
        return (self.sums[high] - self.sums[low]) * self.down[low]


def _runs(words: np.ndarray, text: np.ndarray) -> Level:
    """Level 1: maximal runs of one word."""
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    size = (end - start).astype(np.uint64)
    names = np.where(size > 1, mixed(words[start] * _A[0] + size * _A[1]), words[start])
    return Level(names, start, end, start - 1, end + 1, text[start])


def _pairs(level: Level, k: int) -> Level:
    """The next level: pairs of a left and a right symbol merged."""
    names, text = level.names, level.text
    right_half = mixed(names ^ _A[6] + np.uint64(k)) >> np.uint64(63) == 1
    next_to = text[:-1] == text[1:]
    pick = np.flatnonzero(~right_half[:-1] & right_half[1:] & next_to)
    made, end, left, right = names.copy(), level.end.copy(), level.left.copy(), level.right.copy()
    # A left symbol that stays alone looked at its right neighbour, a right one at its left neighbour.
    alone = np.flatnonzero(~right_half[:-1])
    right[alone] = np.where(next_to[alone], level.right[alone + 1], level.end[alone] + 1)
    right[-1:] = level.end[-1:] + 1
    alone = np.flatnonzero(right_half[1:]) + 1
    left[alone] = np.where(next_to[alone - 1], level.left[alone - 1], level.start[alone] - 1)
    left[:1] = level.start[:1] - 1
    made[pick] = mixed(names[pick] * _A[2] + names[pick + 1] * _A[3] + np.uint64(k))
    end[pick], right[pick], left[pick] = level.end[pick + 1], level.right[pick + 1], level.left[pick]
    keep = np.ones(len(names), bool)
    keep[pick + 1] = False
    return Level(made[keep], level.start[keep], end[keep], left[keep], right[keep], text[keep])


def recompressed(hashes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """All levels, from words up."""
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(hashes))
    out = [Level(hashes, at, at + 1, at, at + 1, text), _runs(hashes, text)]
    for k in range(ROUNDS):
        out.append(_pairs(out[-1], k))
    return out


def window_starts(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of every window of ``size`` words, text by text; windows of each text)."""
    n = np.maximum(counts - size + 1, 0)
    return np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def anchors(levels: list[Level], window: np.ndarray, size: int = 50) -> np.ndarray:
    """The anchor of each window."""
    out, todo = np.zeros(len(window), np.uint64), np.arange(len(window))
    for level in reversed(levels):
        if not len(todo):
            break
        low, high = level.safe(window[todo], size)
        hit = high > low
        where, low, high = todo[hit], low[hit], high[hit]
        length = np.minimum(level.end - level.start, 63).astype(np.uint64)
        table = [(np.uint64(63) - length) << np.uint64(58) | level.names >> np.uint64(6)]  # the longest is the least
        reach = np.maximum(np.frexp((high - low).astype(float))[1] - 1, 0)
        for r in range(int(reach.max(initial=0))):
            table.append(np.minimum(table[-1][: -(1 << r)], table[-1][1 << r :]))
        for r in np.unique(reach):
            own = np.flatnonzero(reach == r)
            out[where[own]] = np.minimum(table[r][low[own]], table[r][high[own] - (1 << int(r))])
        todo = todo[~hit]
    return out.view(np.int64)


def parses(levels: list[Level], window: np.ndarray, size: int = 50) -> np.ndarray:
    """A fingerprint of each window's parse."""
    first, last = window + size, window.copy()  # words spelled so far: none
    total = np.zeros(len(window), np.uint64)
    for k, level in reversed(list(enumerate(levels))):
        low, high = level.safe(window, size)
        begun, some = first < last, high > low
        inner_low = np.where(begun, np.searchsorted(level.start, first, "left"), high)
        inner_high = np.where(begun, np.searchsorted(level.start, last, "left"), high)
        for a, b in ((low, np.maximum(inner_low, low)), (np.minimum(inner_high, high), high)):
            total = mixed(total * _A[4] + level.print(a, b) + (b - a).astype(np.uint64) * _A[5] + np.uint64(k))
        ends = level.end[np.maximum(high - 1, 0)]
        first = np.where(some, np.minimum(first, level.start[np.minimum(low, len(level.start) - 1)]), first)
        last = np.where(some, np.maximum(last, ends), last)
    return total.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _surveyed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("repeats")
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for a, b in row_groups(offsets):
                part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, counts = word_hashes(part, ends, False)
                window, n = window_starts(counts, size)
                found = anchors(recompressed(hashes, counts), window, size) if len(window) else np.zeros(0, np.int64)
                text = np.repeat(np.arange(b - a), n)
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
                found, text = found[new], text[new]
                whole = part.tobytes()
                digests = [hashlib.sha256(b" ".join(whole[x:y].split())).hexdigest() for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(counts), pa.array(digests), _lists(found, np.bincount(text, minlength=b - a))],
                    names=["doc_id", "key", "n_words", "sha256", "anchors"],
                )

    return run


def _windowed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(2))
            ids, keys, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for a, b in row_groups(offsets):
                hashes, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], False)
                (window, n), levels = window_starts(counts, size), recompressed(hashes, counts)
                if not len(window):
                    continue
                found = anchors(levels, window, size)
                prints, _ = windows(hashes, counts, size)
                named = np.sort(wanted.slice(a, b - a).flatten().to_numpy())
                text = np.repeat(np.arange(b - a), n)
                hit = np.flatnonzero(np.searchsorted(named, found, "right") > np.searchsorted(named, found, "left"))
                parsed = parses(levels, window[hit], size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][text[hit]]), pa.array(keys[a:b][text[hit]]), pa.array((hit - (np.cumsum(n) - n)[text[hit]]).astype(np.int32)), pa.array(prints[hit].view(np.int64)), pa.array(parsed)],
                    names=["doc_id", "key", "at", "window", "parse"],
                )

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(2))
            whole = data.tobytes()
            removed, digests = [], []
            for i, starts in enumerate(batch.column(3)):
                words = whole[offsets[i] : offsets[i + 1]].split()
                step = np.zeros(len(words) + 1, np.int64)
                at = starts.values.to_numpy()
                np.add.at(step, at, 1)
                np.add.at(step, at + size, -1)
                kept = [w for w, k in zip(words, np.cumsum(step[:-1]).tolist(), strict=True) if not k]
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "key", "n_cut", "cut_sha256"])

    return run


def remove_repeats(docs: DataFrame, size: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): each document without the words of windows that a smaller id has too."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    row = ["doc_id", "key"]
    seen = scratch.write(docs.select("doc_id", "text", "key").mapInArrow(_surveyed(size), "doc_id bigint, key bigint, n_words bigint, sha256 string, anchors array<bigint>"))
    scratch.sized(seen.count())
    whole = seen.where((F.col("n_words") >= size) & F.col("doc_id").isNotNull())
    first = whole.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    copies = scratch.write(whole.select(*row, "sha256").join(first, "sha256").where("doc_id > first_id").select(*row).distinct())

    placed = scratch.write(whole.join(copies, row, "left_anti").select(*row, F.explode("anchors").alias("anchor")))
    # Written before they are joined: both sides of the join are then plain exchanges, whose hot keys Spark can split.
    common = scratch.write(placed.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"))
    hits = scratch.write(placed.join(common, "anchor").groupBy(*row).agg(F.collect_set("anchor").alias("anchors")))
    read = only(docs, hits.select("doc_id").distinct(), "doc_id").join(hits, row).select(*row, "text", "anchors")
    found = scratch.write(read.mapInArrow(_windowed(size), "doc_id bigint, key bigint, at int, window bigint, parse bigint"))
    low = scratch.write(found.groupBy("window", "parse").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("window", "parse", "low"))
    cuts = scratch.write(found.join(low, ["window", "parse"]).where("doc_id > low").groupBy(*row).agg(F.collect_set("at").alias("starts")))
    scratch.drop(placed, common, hits, found, low)

    read = only(docs, cuts.select("doc_id").distinct(), "doc_id").join(cuts, row).select(*row, "text", "starts")
    kept = read.mapInArrow(_cut(size), "doc_id bigint, key bigint, n_cut bigint, cut_sha256 string").dropDuplicates(row)
    changed = kept.unionByName(copies.select(*row, F.lit(None).cast("bigint").alias("n_cut"), F.sha2(F.lit(""), 256).alias("cut_sha256")))
    return (
        seen.select(*row, "n_words", "sha256")
        .join(changed, row, "left")
        .select(
            "doc_id",
            "n_words",
            F.when(F.col("cut_sha256").isNull(), F.lit(0)).otherwise(F.coalesce("n_cut", "n_words")).cast("bigint").alias("n_removed"),
            F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
        )
    )
