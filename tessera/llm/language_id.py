"""Language of a text by words first: a known word counts by its frequency in each language, an unseen one by its characters.

* Words are runs of letters in lower case (A-Z and all that Unicode lowers; non-ASCII bytes count as letters but for the
  general and CJK punctuation blocks).
* A word that the training documents hold ``least`` times or more adds log((n + SMOOTH) / (N + SMOOTH V)) to every language, n
  its count and N all words there.
* An unseen word backs off to n-grams of its characters with its bounds marked: at every place the longest known n-gram that
  starts there counts, five characters long, else four, down to one; a place adds log((n + SMOOTH) / (N + SMOOTH V)) among the
  n-grams of that length, and the word adds the mean of its places.
* The sum starts at the logarithm of the language's share of training documents; the score is the language's probability.

Counting is one map and a few aggregations over all training documents.  The fitted table holds at most ``most_words`` words
and ``most_grams`` n-grams (the most frequent, whole bands of frequency): what is beyond backs off.  It goes to the executors
whole; the number of languages is small by nature.  N-grams are counted over distinct words, as unseen words are rare ones.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text where nothing was learned; a
null language or text teaches nothing; ties go to the smaller language; rows that repeat are predicted each on its own; of
further columns only those to keep are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .texts import cache, cuts, gathered, raw, small_batches, span_hashes

LONGEST, SMOOTH, PIECE, UNKNOWN = 5, 0.5, 1 << 20, "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case, punctuation of U+0080-00BF, 2000-206F and 3000-303F as spaces."""
    data, offsets = raw(pc.utf8_lower(column))
    if len(data) > 1:
        data = data.copy()
        one, two, three = data[:-1], data[1:], np.append(data[2:], np.uint8(0))
        short = np.flatnonzero((one == 0xC2) & (two != 0xAA) & (two != 0xB5) & (two != 0xBA))
        long = np.flatnonzero((one == 0xE2) & ((two == 0x80) | (two == 0x81) & (three < 0xB0)) | (one == 0xE3) & (two == 0x80))
        for at, size in ((short, 2), (long, 3)):
            for k in range(size):
                data[at[at + k < len(data)] + k] = 0x20
    return data, offsets


def _words(column: pa.Array):
    """For each cut of a batch: (bytes, starts, ends, prints, text of each word)."""
    data, offsets = _plain(column)
    for low, high in cuts(data, offsets, PIECE, ~_LETTER):
        own = data[low:high]
        a, b = int(np.searchsorted(offsets, low, "right")) - 1, int(np.searchsorted(offsets, high, "left"))
        bounds = np.clip(offsets[a : b + 1], low, high) - low
        edge = np.zeros(len(own) + 1, bool)
        edge[bounds] = True
        letter = _LETTER[own]
        begin, over = letter.copy(), letter.copy()
        begin[1:] &= ~letter[:-1] | edge[1:-1]
        over[:-1] &= ~letter[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(over) + 1
        if len(starts):
            yield own, starts, ends, span_hashes(own, starts, ends), a + np.searchsorted(bounds[1:], starts, "right")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each cut."""
    cache("languages")
    for batch in batches:
        codes = batch.column(0).dictionary_encode()
        kinds = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for own, starts, ends, prints, text in _words(batch.column(1)):
            lang = kinds[text]
            order = np.lexsort((prints, lang))
            new = np.ones(len(order), bool)
            new[1:] = (prints[order[1:]] != prints[order[:-1]]) | (lang[order[1:]] != lang[order[:-1]])
            at = np.flatnonzero(new)
            first = order[at]
            yield pa.RecordBatch.from_arrays(
                [codes.dictionary.take(pa.array(lang[first])), gathered(own, starts[first], ends[first]), pa.array(np.diff(np.append(at, len(order))))], names=["lang", "word", "n"]
            )


class _Table:
    """Prints in order and, beside each, the logarithms of its smoothed share in every language."""

    def __init__(self, prints: np.ndarray, counts: np.ndarray, totals: np.ndarray):
        order = np.argsort(prints)
        self.prints = prints[order]
        self.shares = np.log((counts[order] + SMOOTH) / (totals + SMOOTH * max(len(prints), 1))).astype(np.float32)

    def find(self, prints: np.ndarray) -> np.ndarray:
        """The row of each print, -1 where it is unknown."""
        if not len(self.prints):
            return np.full(len(prints), -1)
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        return np.where(self.prints[at] == prints, at, -1)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The words' bytes between two bound marks, with the start of each character and the word it belongs to."""
    size = ends - starts + 2
    to = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    at = np.repeat(starts - to - 1, size) + np.arange(len(out))
    out[:] = data[np.clip(at, 0, len(data) - 1)]
    out[to], out[to + size - 1] = 0x3C, 0x3E
    characters = np.flatnonzero((out & 0xC0) != 0x80)
    return out, characters, np.searchsorted(to, characters, "right") - 1


def _grams(out: np.ndarray, characters: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first character, print) of every n-gram within a word."""
    at = np.arange(len(characters) - n + 1)
    at = at[word[at] == word[at + n - 1]]
    return at, span_hashes(out, characters[at], np.append(characters, len(out))[at + n])


class LanguageModel:
    """Languages in order, the logarithms of their shares, the table of words and those of n-grams by length."""

    def __init__(self, langs: list[str], prior: np.ndarray, words: _Table, grams: dict[int, _Table]):
        self.langs, self.prior, self.words, self.grams = langs, prior, words, grams

    def unseen(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each word adds to every language by its n-grams (words x languages)."""
        out, characters, word = _spelled(data, starts, ends)
        total, places = np.zeros((len(starts), len(self.langs))), np.zeros(len(starts))
        done = np.zeros(len(characters), bool)
        for n in range(LONGEST, 0, -1):
            if len(characters) < n:
                continue
            at, prints = _grams(out, characters, word, n)
            open_ = ~done[at]
            at, row = at[open_], self.grams[n].find(prints[open_])
            at, row = at[row >= 0], row[row >= 0]
            done[at] = True
            places += np.bincount(word[at], minlength=len(starts))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(word[at], self.grams[n].shares[row, k], len(starts))
        return total / np.maximum(places, 1)[:, None]

    def scores(self, column: pa.Array) -> np.ndarray:
        """Log-likelihood plus log-share of each text in every language."""
        n, k = len(column), len(self.langs)
        out = np.tile(self.prior, (n, 1))
        for own, starts, ends, prints, text in _words(column):
            row = self.words.find(prints)
            known = row >= 0
            left = np.flatnonzero(~known)
            _, first, which = np.unique(prints[left], return_index=True, return_inverse=True)
            added = self.unseen(own, starts[left][first], ends[left][first]) if len(left) else np.zeros((0, k))
            for i in range(k):
                out[:, i] += np.bincount(text[known], self.words.shares[row[known], i], n)
                out[:, i] += np.bincount(text[left], added[which, i], n)
        return out

    def predict(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns (all) of ``docs``, lang_pred and score."""
        keep = list(docs.columns) if keep is None else keep
        if clash := {"lang_pred", "score"} & set(keep):
            raise ValueError(f"columns of that name exist: {sorted(clash)}; name those to keep")
        spark = docs.sparkSession
        small_batches(spark)
        held, own = spark.sparkContext.broadcast(self), F.col(text).cast("string")
        picked = docs.select(*keep, F.coalesce(own.rlike("\\p{L}"), F.lit(False)).alias("__letters"), own.alias("__text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache("languages")
            model = held.value
            for batch in batches:
                letters = batch.column(len(keep)).to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
                if model.langs:
                    z = model.scores(batch.column(len(keep) + 1))
                    best = z.argmax(axis=1)
                    score = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
                known = letters & bool(model.langs)
                names = pa.array([*model.langs, UNKNOWN]).take(pa.array(np.where(known, best, len(model.langs))))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), names, pa.array(np.where(known, score, 0.0))], names=[*keep, "lang_pred", "score"])

        kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)]]
        return picked.mapInArrow(run, ", ".join([*kept, "lang_pred string", "score double"]))


def _most_frequent(counts: DataFrame, key: str, langs: list[str], most: int, least: int = 1) -> pa.Table:
    """(key, n of each language) of keys counted ``least`` times or more, the most frequent bands up to ``most`` keys."""
    wide = Scratch(counts.sparkSession).write(counts.groupBy(key).agg(F.sum("n").alias("total"), *(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs))).where(F.col("total") >= least))
    band = F.floor(16 * F.log2("total")).cast("int")
    sizes = sorted(((r[0], r[1]) for r in wide.groupBy(band).count().collect()), reverse=True)  # a band has a number below 1,024
    low, held = None, 0
    for b, n in sizes:
        if held + n > most:
            break
        low, held = b, held + n
    return wide.where(band >= low if low is not None else F.lit(False)).select(key, *(f"n{i}" for i in range(len(langs)))).toArrow()


def _table(found: pa.Table, key: str, n_langs: int, totals: np.ndarray | None = None) -> _Table:
    data, offsets = raw(found[key])
    counts = np.stack([found[f"n{i}"].to_numpy() for i in range(n_langs)], axis=1).astype(float) if n_langs else np.zeros((0, 0))
    prints = span_hashes(data, offsets[:-1], offsets[1:]) if len(found) else np.zeros(0, np.uint64)
    return _Table(prints, counts, counts.sum(axis=0) if totals is None else totals)


def fit(docs: DataFrame, most_words: int = 500_000, most_grams: int = 300_000, least: int = 2, text: str = "text", lang: str = "lang") -> LanguageModel:
    """The model of the documents that have a text and a language."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    share = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    langs = [x for x, _ in share]
    if not langs:
        none = _Table(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0))
        return LanguageModel([], np.zeros(0), none, dict.fromkeys(range(1, LONGEST + 1), none))
    counts = scratch.write(known.mapInArrow(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    spoken = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals = np.array([float(spoken.get(x, 0)) for x in langs])
    marked, size, none = F.concat(F.lit("<"), F.col("word"), F.lit(">")), F.length("word") + 2, F.array().cast("array<string>")

    def of_length(n: int) -> Column:
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(marked, i, F.lit(n)))).otherwise(none)

    every = F.flatten(F.array(*map(of_length, range(1, LONGEST + 1))))
    grams = _most_frequent(counts.select("lang", F.explode(every).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")), "gram", langs, most_grams)
    length = pc.utf8_length(grams["gram"])
    by_length = {n: _table(grams.filter(pc.equal(length, n)), "gram", len(langs)) for n in range(1, LONGEST + 1)}
    words = _table(_most_frequent(counts, "word", langs, most_words, least), "word", len(langs), totals)
    return LanguageModel(langs, np.log(np.array([float(n) for _, n in share]) / sum(n for _, n in share)), words, by_length)
