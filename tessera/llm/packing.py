"""Order-preserving packing of documents into training sequences by dynamic programming.

Within each Spark partition the token ids of its documents, in row order, form one stream.  Windows of the stream become
sequences: a cut is free at a document's end, costs ``sentence_cost`` at a sentence's end and ``forced_cost`` elsewhere
(offered only inside sentences longer than ``spare``, every ``spare`` ids).  A window of w ids is padded by pad(w) = 0 where w
is a power of two, else capacity - w.  With S(j) the stream position of cut j,

    cost(j) = penalty(j) + each + min over i with 0 < S(j) - S(i) <= capacity of cost(i) + pad(S(j) - S(i))

``each``, a sixteenth of the capacity, is what a sequence costs, so that a power of two is taken where it saves padding and
the stream isn't cut into small ones.

For the padded windows the best i minimises cost(i) + S(i) over a sliding window: a monotone queue gives it in amortised
constant time.  The windows of a power of two add one transition for each power, where a cut is offered there.  The chosen
cuts of a block are optimal for it (``sequences`` below).  The stream is solved in blocks of BLOCK ids; the open window at
the end of a block goes on into the next one, so memory is bounded however long a document or a partition is.  What is
greedy: a block is solved without sight of the next one, and the ids left at a partition's end, fewer than two sequences,
are padded or cut at powers of two, whichever is cheaper.

Nothing is shuffled: documents stay in their partition and sequence ids are (partition number * 2^40 + running number).

Defined results: a null or empty text is the closing id alone; every id lies in exactly one piece; repeated rows are
packed as separate documents; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import CodePoints, give_back, raw, row_groups, small_batches
from .token_counts import compiled, segments, some_at_a_time

#: Ids of a block that is solved at once.
BLOCK = 1 << 18
#: Bytes of text that are turned into ids at a time: the arrays for them are some hundred times as large.
PIECE = 1 << 17
#: First characters of the pre-tokens that end a sentence.
STOPS = [ord(c) for c in "!.?\u2026\u3002"]


def word_ids(data: np.ndarray, offsets: np.ndarray, path: str, close: int):
    """(ids of all texts, each text followed by ``close``; ids of each text; cut class after each id: 2 text, 1 sentence)."""
    transducer, classes, pattern = compiled(path)
    texts, rows, special = segments(data, offsets, pattern)
    if special.any():
        return _with_specials(data, offsets, path, close)
    parts = [_ids_of([_normal(t, path) for t in some], transducer, classes) for some, _ in some_at_a_time(texts, rows)]
    ids, inner = (np.concatenate(x) for x in zip(*((i, c) for i, c, _ in parts), strict=True))
    per_text = np.bincount(rows, np.concatenate([n for *_, n in parts]), len(special)).astype(np.int64) + 1
    out, cut = np.empty(len(ids) + len(per_text), np.uint32), np.zeros(len(ids) + len(per_text), np.int8)
    close_at = np.cumsum(per_text) - 1
    mask = np.ones(len(out), bool)
    mask[close_at] = False
    out[mask], cut[mask] = ids, inner
    out[close_at], cut[close_at] = close, 2
    return out, per_text, cut


def _ids_of(texts: list[str], transducer, classes: CodePoints):
    """(ids, 1 where a sentence ends, ids of each text)."""
    whole = "".join(texts)
    points = classes.of(whole)
    lengths = np.array([len(t) for t in texts], np.int64)
    bounds = np.cumsum(lengths) - lengths
    first = np.zeros(len(points), bool)
    first[bounds[lengths > 0]] = True
    starts, ends = classes.bare(points, first)
    at = classes.byte_offsets(points)
    symbols = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    symbols[at[ends] - 1] += 256
    ids, n = transducer.ids(symbols, at[starts], at[ends])
    inner = np.zeros(len(ids), np.int8)
    stops = np.isin(points[starts], STOPS)
    inner[np.cumsum(n)[stops] - 1] = 1
    return ids, inner, np.bincount(np.searchsorted(bounds + lengths, starts, "right"), n, len(texts)).astype(np.int64)


def _with_specials(data, offsets, path, close):
    """Texts that spell special tokens: by the library, text by text."""
    from tokenizers import Tokenizer

    library, whole, out, cuts = Tokenizer.from_file(path), data.tobytes(), [], []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        e = library.encode(whole[a:b].decode("utf-8", "replace"), add_special_tokens=False)
        out.append(np.array([*e.ids, close], np.uint32))
        cuts.append(np.array([*(t[:1] in ".!?" for t in e.tokens), 2], np.int8))
    return np.concatenate(out), np.array([len(x) for x in out], np.int64), np.concatenate(cuts)


_normalizers: dict[str, object] = {}


def _normal(text: str, path: str) -> str:
    """As the file's normalizer; below U+0130 its composition changes nothing and lower case is one to one."""
    if text.isascii() or max(text) < "İ":
        return text.lower()
    if path not in _normalizers:
        from tokenizers import Tokenizer

        _normalizers[path] = Tokenizer.from_file(path).normalizer
    return _normalizers[path].normalize_str(text)


def sequences(positions: np.ndarray, penalty: np.ndarray, capacity: int, total: int, each: float = 0.0) -> list[int]:
    """Indices of the chosen cuts among ``positions`` (increasing, at most ``capacity`` apart, the last one is ``total``).

    The final window stays open: the cheapest cut from which ``total`` is within ``capacity`` is the last one.
    """
    n = len(positions)
    at = np.concatenate([[0], positions])
    # (cut, earlier cut a power of two before it), by cut.
    pairs = []
    for b in range(capacity.bit_length()):
        if 1 << b <= capacity:
            place = np.minimum(np.searchsorted(at, at - (1 << b)), n)
            own = np.flatnonzero(at[place] == at - (1 << b))
            pairs.append(np.stack([own, place[own]]))
    to, earlier = np.concatenate(pairs, axis=1)
    order = np.argsort(to, kind="stable")
    earlier, bounds = earlier[order].tolist(), np.searchsorted(to[order], np.arange(n + 2)).tolist()
    S, pen = at.tolist(), [0.0, *penalty.tolist()]
    cost, came = [0.0] * (n + 1), [0] * (n + 1)
    key = [0.0] * (n + 1)
    queue, head = [0], 0
    for j in range(1, n + 1):
        s = S[j]
        while S[queue[head]] < s - capacity:
            head += 1
        where = queue[head]
        best = key[where] + capacity - s
        for i in earlier[bounds[j] : bounds[j + 1]]:
            if cost[i] < best:
                best, where = cost[i], i
        cost[j], came[j] = best + pen[j] + each, where
        k = key[j] = cost[j] + s
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    j = min((i for i in range(n + 1) if S[i] >= total - capacity), key=lambda i: (cost[i], -S[i]))
    chosen = []
    while j:
        chosen.append(j - 1)
        j = came[j]
    return chosen[::-1]


class Packer:
    """Packs one partition's stream; ``add`` and ``finish`` return finished pieces as arrays."""

    def __init__(self, capacity: int, sentence_cost: float, forced_cost: float, spare: int):
        self.capacity, self.sentence_cost, self.forced_cost, self.spare = capacity, sentence_cost, forced_cost, spare
        self.each = capacity / 16
        self.ids, self.cut, self.doc, self.start = (np.zeros(0, k) for k in (np.uint32, np.int8, np.int64, np.int64))
        self.pieces: list[tuple] = []
        self.number = 0

    def add(self, ids, cut, doc, start) -> None:
        self.ids, self.cut = np.concatenate([self.ids, ids]), np.concatenate([self.cut, cut])
        self.doc, self.start = np.concatenate([self.doc, doc]), np.concatenate([self.start, start])
        while len(self.ids) >= BLOCK:
            self._solve(BLOCK)

    def _solve(self, size: int) -> None:
        cut = self.cut[:size]
        offered = np.flatnonzero(cut > 0)
        at = np.unique(np.concatenate([offered + 1, [size]]))
        steps = np.diff(np.concatenate([[0], at]))
        if (steps > self.spare).any():  # long sentences: forced cuts every ``spare`` ids
            more = [np.arange(a + self.spare, b, self.spare) for a, b in zip(np.concatenate([[0], at[:-1]])[steps > self.spare], at[steps > self.spare], strict=True)]
            at = np.unique(np.concatenate([at, *more]))
        kind = cut[at - 1]
        penalty = np.where(kind == 2, 0.0, np.where(kind == 1, self.sentence_cost, self.forced_cost))
        chosen = at[sequences(at, penalty, self.capacity, size, self.each)]
        self._emit(np.diff(np.concatenate([[0], chosen])))

    def _emit(self, lengths: np.ndarray) -> None:
        """Close windows of these lengths at the stream's head."""
        total = int(lengths.sum())
        ends = np.cumsum(lengths)
        doc, start = self.doc[:total], self.start[:total]
        new = np.zeros(total, bool)
        new[:1] = True
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
        new[ends[:-1]] = True
        first = np.flatnonzero(new)
        stop = np.append(first[1:], total)
        which = np.searchsorted(ends, first, "right")
        whole = np.ascontiguousarray(self.ids[:total], "<u4").view(np.uint8)
        crc = np.array([zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)], np.int64)
        self.pieces.append((doc[first], start[first], stop - first, crc, self.number + which, first - (ends - lengths)[which]))
        self.number += len(lengths)
        self.ids, self.cut, self.doc, self.start = self.ids[total:], self.cut[total:], self.doc[total:], self.start[total:]

    def finish(self) -> None:
        if len(self.ids) > self.capacity:
            self._solve(len(self.ids))
        rest = len(self.ids)
        bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        if rest and (len(bits) - 1) * (self.forced_cost + self.each) >= self.capacity - rest:
            bits = [rest]
        if bits:
            self._emit(np.array(bits))

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*self.pieces, strict=True)] if self.pieces else []
        self.pieces = []
        return out


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, close: int = 2, sentence_cost: float = 8.0, forced_cost: float = 64.0, spare: int = 64) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of ``docs`` packed to ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        packer, rows, keys, sizes = Packer(capacity, sentence_cost, forced_cost, spare), 0, {}, {}

        def ready():
            if found := packer.take():
                row, start, length, crc, sequence, offset = found
                kept = pa.array([keys[r] for r in row.tolist()], pa.int64())
                total = pa.array([sizes[r] for r in row.tolist()], pa.int64())
                least = int(packer.doc[0]) if len(packer.doc) else rows
                for r in [r for r in keys if r < least]:
                    del keys[r], sizes[r]
                yield pa.RecordBatch.from_arrays(
                    [kept, *map(pa.array, (start, length, crc)), total, pa.array(sequence + (partition << 40)), pa.array(offset)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

        for batch in batches:
            data, offsets = raw(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in row_groups(offsets, PIECE):
                ids, n, cut = word_ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], path, close)
                keys |= dict(zip(range(rows, rows + b - a), names[a:b], strict=True))
                sizes |= dict(zip(range(rows, rows + b - a), n.tolist(), strict=True))
                begin = np.cumsum(n) - n
                packer.add(ids, cut, np.repeat(np.arange(rows, rows + b - a), n), np.arange(len(ids)) - np.repeat(begin, n))
                rows += b - a
                yield from ready()
            give_back()
        packer.finish()
        yield from ready()

    small_batches(docs.sparkSession)
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, schema)
