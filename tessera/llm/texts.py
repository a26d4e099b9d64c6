"""Texts of Arrow batches as flat NumPy arrays: bytes, words and their hashes, code points and pre-tokens."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at a time (one longer text is cut at word boundaries or taken alone).
PIECE = 1 << 18

#: Bytes of an Arrow batch for a Python worker, where the session keeps Spark's default (64 MB).
BATCH = 4 << 20


def small_batches(spark) -> None:
    """Arrow batches bounded by bytes: a batch and what a map makes of it stay small beside a worker's share of memory."""
    if spark.conf.get(_LIMIT, "67108864b") == "67108864b":
        spark.conf.set(_LIMIT, str(BATCH))


_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and letters.
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 7919)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(x) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers, so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = seeded(256, 1)
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, 4096), _powers(_P_INV, 4096)


_caches: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """What one operator keeps in a Python worker between tasks.

    Workers live on from stage to stage, so the first task of another operator drops what earlier ones kept, and freed
    memory goes back to the system.
    """
    global _UP, _DOWN
    if owner not in _caches:
        _caches.clear()
        _UP, _DOWN = _UP[:4096].copy(), _DOWN[:4096].copy()
        gc.collect()
        give_back()
    return _caches.setdefault(owner, {})


def give_back() -> None:
    """Memory that is free but still held by this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has this call
        ctypes.CDLL(None).malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        n = 1 << (n - 1).bit_length()
        up, down = _powers(_P, n), _powers(_P_INV, n)
        if n > 1 << 22:
            return up, down
        _UP, _DOWN = up, down
    return _UP, _DOWN


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if n == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[at : at + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, piece: int = PIECE):
    """(low, high) row ranges of about ``piece`` bytes each."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + piece, "right")) - 1)
        yield low, min(high, n)
        low = high


def cuts(data: np.ndarray, offsets: np.ndarray, piece: int, stops: np.ndarray):
    """(low, high) byte ranges of about ``piece`` bytes that end with a text or after a byte of ``stops``."""
    low = 0
    while low < len(data):
        high = min(low + piece, len(data))
        if high < len(data):
            ends = offsets[np.searchsorted(offsets, high) :][:1]
            stop = int(ends[0]) if len(ends) else len(data)
            found, at = stop, high
            while at < stop:
                marks = np.flatnonzero(stops[data[at : min(at + piece, stop)]])
                if len(marks):
                    found = at + int(marks[0]) + 1
                    break
                at += piece
            high = found
        yield low, high
        low = high


def _word_spans(data: np.ndarray, offsets: np.ndarray, marks: bool):
    gap = (_MARKS if marks else _SPACE)[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | first[1:-1]
    starts = np.flatnonzero(begin)
    over = ~gap
    over[:-1] &= gap[1:] | first[1:-1]
    return starts, np.flatnonzero(over) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, marks: bool = False):
    """(hash of each word, words of each text): words are ``[^\\x20\\x09-\\x0D]+``, with A-Z in lower case if ``lower``;
    with ``marks``, ASCII punctuation separates words too.

    Long inputs are hashed in cuts at spaces, so the arrays stay small beside a very long text.
    """
    if len(data) > 4 * PIECE:
        cuts, at = [0], 0
        while len(data) - at > 2 * PIECE:
            gaps = np.flatnonzero(_SPACE[data[at + PIECE : at + 2 * PIECE]])
            nexts = offsets[np.searchsorted(offsets, at + PIECE, "right") :][:1]
            step = at + PIECE + int(gaps[0]) if len(gaps) else at + 2 * PIECE
            if len(nexts) and nexts[0] < step:
                step = int(nexts[0])
            elif not len(gaps):  # one word of over a megabyte
                more = np.flatnonzero(_SPACE[data[step:]])
                step = min([len(data), *(offsets[offsets >= step][:1]), *(step + more[:1])])
            at = int(step)
            cuts.append(at)
        cuts.append(len(data))
        found = []
        counts = np.zeros(len(offsets) - 1, np.int64)
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                a = int(np.searchsorted(offsets, low, "right")) - 1
                b = int(np.searchsorted(offsets, high, "left"))
                part, n = _hash_spans(data[low:high], np.clip(offsets[a : b + 1], low, high) - low, lower, marks)
                found.append(part)
                counts[a:b] += n
        return np.concatenate(found), counts
    return _hash_spans(data, offsets, lower, marks)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a string column (of less than 2 GB)."""
    sizes = ends - starts
    to = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=to[1:])
    at = np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _hash_spans(data, offsets, lower, marks):
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts, ends = _word_spans(data, offsets, marks)
    hashes = span_hashes(_LOWER[data] if lower else data, starts, ends)
    counts = np.searchsorted(starts, offsets[1:], "left") - np.searchsorted(starts, offsets[:-1], "left")
    return hashes, counts


def windows(hashes: np.ndarray, counts: np.ndarray, size: int):
    """Hash of every ``size`` consecutive words of one text, and the windows of each text."""
    n = np.maximum(counts - size + 1, 0)
    if not len(hashes) or not n.sum():
        return np.zeros(0, np.uint64), n
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    begin = np.cumsum(counts) - counts
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return mixed((total[at + size] - total[at]) * down[at]), n


class CodePoints:
    """Classes of code points as one tokenizers regular expression engine has them."""

    LETTER, NUMBER, SPACE, WHITE = 1, 2, 3, 4

    def __init__(self):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.kind = np.zeros(0x110000, np.uint8)
        every = [*range(0xD800), *range(0xE000, 0x110000)]
        for low in range(0, len(every), 0x8000):
            part = every[low : low + 0x8000]
            text = "".join(map(chr, part))
            for kind, pattern in ((self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+"), (self.WHITE, r"\s+")):
                for found, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                    self.kind[[ord(c) for c in found]] = kind
        self.kind[0x20] = self.SPACE

    @staticmethod
    def of(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    @staticmethod
    def byte_offsets(points: np.ndarray) -> np.ndarray:
        wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        out = np.zeros(len(points) + 1, np.int64)
        np.cumsum(wide, out=out[1:])
        return out

    def _contractions(self, points: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll at the start of a pre-token stand alone."""
        n = len(points)
        at = np.flatnonzero(start & (points == 39))
        if not len(at):
            return
        padded, edge = np.concatenate([points, [0, 0, 0]]), np.concatenate([first, [True, True, True]])
        one, two = padded[at + 1], padded[at + 2]
        inner = ~edge[at + 1]
        short = inner & np.isin(one, [115, 116, 109, 100])
        long = inner & ~edge[at + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for who, size in ((at[short], 2), (at[long], 3)):
            for k in range(1, size):
                start[who + k] = False
            after = who + size
            start[after[after < n]] = True

    def spaced(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens that keep a space before them (every code point lies in one)."""
        kind = self.kind[points]
        before = np.roll(kind, 1)
        before[first] = 255
        after = np.roll(kind, -1)
        after[np.roll(first, -1)] = 255
        after[-1:] = 255
        white = kind >= 3
        start = ~white & (before != kind) & (before != self.SPACE)
        start |= white & ((before < 3) | (before == 255) | (after < 3))
        start[first] = True
        self._contractions(points, start, first)
        return np.flatnonzero(start)

    def bare(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of pre-tokens without white space, digits one by one."""
        kind = self.kind[points]
        before = np.roll(kind, 1)
        before[first] = 255
        white = kind >= 3
        start = ~white & ((before != kind) | (kind == self.NUMBER))
        self._contractions(points, start, first)
        start &= ~white
        edge = np.append(start | white | first, True)
        starts = np.flatnonzero(start)
        edges = np.flatnonzero(edge)
        return starts, edges[np.searchsorted(edges, starts, "right")]
