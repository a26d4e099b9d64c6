"""Phrases whose words stand together more often than their parts explain, mined as an ERA-style index is built.

The suffixes of all pieces, cut after ``longest`` words, form one suffix tree; the frequency of a phrase is the number of
leaves below its node.  The tree is never built whole (vertical partitioning):

1. frequencies of one-word prefixes; a word below ``least`` ends every suffix that reaches it, as no candidate holds it;
2. frequencies of two-word prefixes of what is left; pairs below ``least`` end suffixes too;
3. prefixes are dealt into groups whose frequencies sum to at most BUDGET leaves (the sum is taken exactly and the number of
   groups doubled until it fits).  A prefix of over an eighth of the budget is extended by its next word, so that its suffixes
   spread over groups;
4. the suffixes, cut at rare words and pairs, equal ones summed before they are shuffled, go to their groups; each group
   sorts its own, which gives its subtrees, and reads every node's count as the total of the leaves below it.

"Is it frequent" is asked by bit tables of BITS bits: their size is fixed, and what they let through by chance is dropped when
counts are known, so the result is exact at any size.  Words are 64-bit fingerprints of (language, word), so every key keeps
to its language.

Defined results: a null text is empty; a null language is ``und``; a null id is a document like others (ids are not read);
repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .texts import cache, cuts, gathered, mixed, raw, seeded, small_batches, span_hashes

#: Bits of a table of frequent prefixes (16 MB), leaves in a group of prefixes, bytes of text at a time.
BITS, BUDGET, PIECE = 27, 1 << 20, 1 << 20
_A = seeded(8, 11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _words(column: pa.Array, langs: pa.Array):
    """For each cut of a batch: (bytes in lower case, starts, ends, fingerprints, whether the next word follows in the same
    piece, text of each word, names of the languages, language of each text)."""
    data, offsets = raw(column)
    codes = langs.fill_null("und").dictionary_encode()
    names = codes.dictionary.to_pylist()
    salts = np.array([int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "little") for n in names] or [0], np.uint64)
    kinds = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for low, high in cuts(data, offsets, PIECE, _KIND == 2):
        own = _LOWER[data[low:high]]
        a, b = int(np.searchsorted(offsets, low, "right")) - 1, int(np.searchsorted(offsets, high, "left"))
        ends_ = np.clip(offsets[a : b + 1], low, high) - low
        kind = _KIND[own]
        edge = np.zeros(len(own) + 1, bool)
        edge[ends_] = True
        word = kind == 0
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        over = word.copy()
        over[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(over) + 1
        if not len(starts):
            continue
        text = a + np.searchsorted(ends_[1:], starts, "right")
        broken = np.cumsum(kind == 2)[starts]
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (broken[1:] == broken[:-1]) & (text[1:] == text[:-1])
        prints = mixed(span_hashes(own, starts, ends) ^ salts[kinds[text]])
        yield own, starts, ends, prints | np.uint64(1), follows, kinds[text], names


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _A[0] + b * _A[1])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each cut with their counts; a row without a word holds the number of all words of a language."""
    cache("collocations")
    for batch in batches:
        for own, starts, ends, prints, _, lang, names in _words(batch.column(0), batch.column(1)):
            found, first, n = np.unique(prints, return_index=True, return_counts=True)
            total = np.bincount(lang, minlength=len(names))
            spoken = np.flatnonzero(total)
            words = pa.concat_arrays([gathered(own, starts[first], ends[first]), pa.nulls(len(spoken), pa.string())])
            which = np.concatenate([lang[first], spoken])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([found.view(np.int64), np.zeros(len(spoken), np.int64)])), pa.array(names, pa.string()).take(pa.array(which)), words, pa.array(np.concatenate([n, total[spoken]]))],
                names=["word_id", "lang", "word", "n"],
            )


class _Bits:
    """A table of one bit for each fingerprint, of fixed size."""

    def __init__(self, keys: DataFrame, name: str):
        place = F.shiftrightunsigned(name, 64 - BITS)
        cells = keys.groupBy(F.shiftrightunsigned(place, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()
        table = np.zeros(1 << (BITS - 6), np.uint64)
        table[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
        self.held = keys.sparkSession.sparkContext.broadcast(table)

    def has(self, prints: np.ndarray) -> np.ndarray:
        place = prints >> np.uint64(64 - BITS)
        return (self.held.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _pairs(frequent: _Bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("collocations")
        for batch in batches:
            for *_, prints, follows, _, _ in _words(batch.column(0), batch.column(1)):
                known = frequent.has(prints)
                at = np.flatnonzero(follows & known & np.append(known[1:], False))
                found, n = np.unique(_pair(prints[at], prints[at + 1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["prefix", "n"])

    return run


def _suffixes(frequent: _Bits, pairs: _Bits, wide: _Bits, groups: int, longest: int):
    """Suffixes of two words and more, cut at rare words and pairs, with their group and how often the cut has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("collocations")
        for batch in batches:
            for *_, prints, follows, _, _ in _words(batch.column(0), batch.column(1)):
                known = frequent.has(prints)
                at = np.flatnonzero(follows & known & np.append(known[1:], False))
                key = _pair(prints[at], prints[at + 1])
                kept = pairs.has(key)
                at, key = at[kept], key[kept]
                linked = np.zeros(len(prints) + longest, bool)  # the pair that starts here is frequent
                linked[at] = True
                padded = np.concatenate([prints, np.zeros(longest, np.uint64)])
                columns, open_, whole = [prints[at], prints[at + 1]], np.ones(len(at), bool), key
                for d in range(2, longest):
                    open_ = open_ & linked[at + d - 1]
                    columns.append(np.where(open_, padded[at + d], np.uint64(0)))
                    whole = _pair(whole, columns[-1])
                _, first, n = np.unique(whole, return_index=True, return_counts=True)
                prefix = key[first]
                extended = wide.has(prefix)
                if longest > 2:
                    prefix = np.where(extended, _pair(prefix, columns[2][first]), prefix)
                group = (prefix & np.uint64(groups - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(group), *(pa.array(c[first].view(np.int64)) for c in columns), pa.array(n)], names=["group", *(f"w{d}" for d in range(longest)), "n"])

    return run


def _subtrees(least: int, longest: int):
    """The subtrees of a group: its suffixes sorted, every run of equal first d words a node, its count the leaves below."""

    def run(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        words = np.stack([table[f"w{d}"].to_numpy() for d in range(longest)])
        order = np.lexsort(words[::-1])
        words, n = words[:, order], n[order]
        total = np.concatenate([[0], np.cumsum(n)])
        differs = np.zeros(len(n), bool)  # from the leaf before, in the first d words
        differs[:1] = True
        out_words, out_counts = [], []
        for d in range(longest):
            differs[1:] |= words[d, 1:] != words[d, :-1]
            first = np.flatnonzero(differs)
            count = total[np.append(first[1:], len(n))] - total[first]
            if d:
                keep = (words[d, first] != 0) & ((count >= least) | (d == 1))  # a pair's suffixes may lie in several groups
                node = words[:, first[keep]].copy()
                node[d + 1 :] = 0
                out_words.append(node)
                out_counts.append(count[keep])
        nodes = np.concatenate(out_words, axis=1)
        return pa.table({**{f"w{d}": nodes[d] for d in range(longest)}, "n": np.concatenate(out_counts)})

    return run


def frequencies(docs: DataFrame, least: int = 30, longest: int = 4, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): phrases (words array<bigint>, f) of 1 to ``longest`` words that stand ``least`` times or more,
    words (word_id, lang, word) by their ids, totals (lang, n) of all words."""
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and are counted at least once")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text <> ''")
    counted = docs.mapInArrow(_count_words, "word_id bigint, lang string, word string, n bigint")
    counted = scratch.write(counted.groupBy("word_id", "lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull()))
    words, totals = counted.where("word is not null"), counted.where("word is null").select("lang", "n")
    frequent = _Bits(words, "word_id")

    prefixes = docs.mapInArrow(_pairs(frequent), "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    prefixes = scratch.write(prefixes.where(F.col("n") >= least))
    pairs, wide = _Bits(prefixes, "prefix"), _Bits(prefixes.where(F.col("n") > BUDGET // 8), "prefix")
    narrow, groups = prefixes.where(F.col("n") <= BUDGET // 8), 1
    groups = 1 << max(4, int(2 * (prefixes.agg(F.sum("n")).first()[0] or 0) // BUDGET).bit_length())
    while (narrow.groupBy(F.col("prefix").bitwiseAND(groups - 1)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > BUDGET:
        groups *= 2

    keys = [f"w{d}" for d in range(longest)]
    kinds = ", ".join(f"{k} bigint" for k in keys)
    leaves = docs.mapInArrow(_suffixes(frequent, pairs, wide, groups, longest), f"group bigint, {kinds}, n bigint")
    leaves = leaves.groupBy("group", *keys).agg(F.sum("n").alias("n"))
    nodes = leaves.groupBy("group").applyInArrow(_subtrees(least, longest), f"{kinds}, n bigint")
    nodes = nodes.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    phrases = nodes.select(F.filter(F.array(*keys), lambda w: w != 0).alias("words"), "f")
    return scratch.write(phrases.unionByName(words.select(F.array("word_id").alias("words"), F.col("n").alias("f")))), words.drop("n"), totals


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, inside: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score.

    a is the phrase's frequency, l and r those of its two parts at the cut of least floor(2000000 a / (l + r)), the score.
    Phrases within a longer one that stands at least ``inside`` percent as often are left out.
    """
    scratch = Scratch(docs.sparkSession)
    phrases, words, totals = frequencies(docs, least, longest, text, lang)
    candidates = phrases.where("size(words) > 1").withColumnRenamed("f", "a")
    size = F.size("words")

    part = lambda c, length: F.explode(F.flatten(F.transform(F.sequence(F.lit(2), c - 1), lambda m: F.transform(F.sequence(F.lit(1), c - m + 1), lambda i: F.slice(length, i, m)))))
    longer = candidates.where(size > 2).select(part(size, F.col("words")).alias("words"), "a").groupBy("words").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    free = candidates.join(longer, "words", "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * inside)).select("words", "a")

    cut = free.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cut = cut.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    counts = lambda key, n: phrases.select(F.col("words").alias(key), F.col("f").alias(n))
    cut = cut.join(counts("first", "l"), "first").join(counts("rest", "r"), "rest")
    cut = cut.withColumn("score", F.expr("(cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + r)"))
    best = cut.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("words", "a", "m.score", "m.l", "m.r")

    best = scratch.write(best)
    spelled = best.select("words", F.posexplode("words").alias("at", "word_id")).join(words, "word_id")
    spelled = spelled.groupBy("words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.min("lang").alias("lang"))
    named = best.join(spelled, "words")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
