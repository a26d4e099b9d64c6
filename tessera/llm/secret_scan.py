"""Secret scans: known shapes, and strings that a battery of randomness tests cannot tell from random ones.

Base spans come from three regular expressions.  The method adds spans.  Every run of 20 or more characters of an encoding
alphabet is a candidate; the smallest of ENCODINGS that holds it is its inferred encoding (decimal numbers are none).  Three
tests measure how far the string is from a random one of that encoding, as z-scores:

* uniformity: chi-squared statistic of the character counts against the alphabet's uniform distribution (an excess counts);
* runs: runs of one character class (lower, upper, digit, mark; halves of the alphabet where it has one class), against
  their mean and variance in random order;
* serial correlation: lag-1 correlation of the places in the alphabet.

The distance of a string is the sum of the three squares.  Random strings have small distances whatever they encode; a
p-value is the probability that *text* comes as close:

    p = (number of encodings) * P(a piece of text has this encoding and at most this distance)

The probability is measured, not assumed: all texts, without their candidates, are cut for each length class into pieces of letters,
digits and marks (spaces and punctuation left out) of the class's least length, side by side, so that every character is part of
the measurement (what is left at an end is taken with what stands before it), and the pieces go through the same battery.  Small p-values hence are as rare on text as they say, for every encoding; a corpus too small to measure a
probability gives no small p-values.

Candidates of one length class (20-31, 32-63, 64 and more) form one family, and Benjamini-Hochberg control at ``fdr`` runs
within each family over the whole corpus with the number of candidates tested: short strings, which text often resembles,
must be closer to random.  Families and pieces are summed as histograms of (class, encoding, distance), so neither the driver
nor a task sees more than a fixed number of rows.

Defined results: null or empty texts have no spans (base_sha256 is that of the empty string); offsets are code points, end
exclusive; ids may be null and repeat, every row gives its own result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .texts import cache, small_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
BLANK = re.compile(r"[^A-Za-z0-9+/_-]+")

_LOWER, _UPPER, _DIGITS, _MARKS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/-_"
#: Alphabets, the smallest first.  The last one takes either pair of marks.
ENCODINGS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "lower": _LOWER, "upper": _UPPER, "base32": _UPPER + "234567", "lower36": _LOWER + _DIGITS,
    "upper36": _UPPER + _DIGITS, "letters": _UPPER + _LOWER, "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + _MARKS,
}
SIZES = np.array([min(len(v), 64) for v in ENCODINGS.values()], float)
#: Length classes' lower bounds, bins of a distance (half a unit each; the last one is open).
LENGTHS, BINS = (20, 32, 64), 400


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each encoding and byte: whether it belongs, its place, its class for the runs."""
    holds, place, kind = (np.zeros((len(ENCODINGS), 128), k) for k in (bool, np.int64, np.int64))
    for e, letters in enumerate(ENCODINGS.values()):
        kinds = [next(k for k, own in enumerate((_LOWER, _UPPER, _DIGITS, _MARKS)) if c in own) for c in letters]
        for i, c in enumerate(letters):
            holds[e, ord(c)], place[e, ord(c)] = True, 62 + (i - 62) // 2 if i >= 62 else i
            kind[e, ord(c)] = kinds[i] if len(set(kinds)) > 1 else 2 * i // len(letters)
    return holds, place, kind


_HOLDS, _PLACE, _KIND = _tables()


def battery(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(encoding, distance from random) of the strings that end at ``ends`` in ``data`` (bytes of the base64 alphabets).

    Decimal numbers and strings of fewer than eight different characters have an infinite distance.
    """
    m, n = len(ends), np.diff(np.append(0, ends))
    row = np.repeat(np.arange(m), n)
    counts = np.bincount(row * 128 + data, minlength=m * 128).reshape(m, 128)
    present = counts > 0
    fits = ~(present.astype(np.int16) @ (~_HOLDS).T.astype(np.int16)).astype(bool)
    code = fits.argmax(axis=1)
    size = SIZES[code]
    chi = (counts.astype(float) ** 2).sum(axis=1) * size / n - n
    uniform = np.maximum(chi - (size - 1), 0) / np.sqrt(2 * (size - 1) * np.maximum(n - 1, 1) / n)
    kind, x = _KIND[code[row], data], _PLACE[code[row], data].astype(float)
    inner = row[1:] == row[:-1]
    runs = 1 + np.bincount(row[1:][inner & (kind[1:] != kind[:-1])], minlength=m)
    shares = np.bincount(row * 4 + kind, minlength=m * 4).reshape(m, 4).astype(float)
    two, three = (shares**2).sum(axis=1), (shares**3).sum(axis=1)
    mean = n + 1 - two / n
    variance = (two * (two + n * (n + 1.0)) - 2 * n * three - n**3.0) / (n**2.0 * np.maximum(n - 1, 1))
    spread = variance > 1e-9
    run = np.where(spread, (runs - mean) / np.sqrt(np.where(spread, variance, 1.0)), np.inf)
    middle = np.bincount(row, x, m) / n
    x -= middle[row]
    square = np.bincount(row, x * x, m)
    beside = np.bincount(row[1:][inner], (x[1:] * x[:-1])[inner], m)
    serial = np.where(square > 0, (beside / np.where(square > 0, square, 1.0) + 1 / n) * np.sqrt(n), np.inf)
    distance = uniform**2 + run**2 + serial**2
    decimal = ~present[:, [c for c in range(128) if not chr(c).isdigit()]].any(axis=1)
    return code, np.where(decimal | (present.sum(axis=1) < 8), np.inf, distance)


def length_class(n):
    return sum((n >= x) * 1 for x in LENGTHS) - 1


def keys(sizes, code, distance) -> np.ndarray:
    """(class, encoding, bin of the distance) as one number."""
    bins = np.minimum(np.where(np.isfinite(distance), distance, BINS) * 2, BINS - 1).astype(np.int64)
    return (sizes * len(ENCODINGS) + code) * BINS + bins


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind:start:end) of the base spans, sorted."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in HEX.finditer(text)]
    return sorted(out)


def candidates(texts: list[str]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """((text, start, end) of all candidates, key of each)."""
    found = [(i, m.start(), m.end()) for i, t in enumerate(texts) for m in CANDIDATE.finditer(t)]
    if not found:
        return [], np.zeros(0, np.int64)
    strings = [texts[i][a:b].rstrip("=") for i, a, b in found]
    n = np.array([len(x) for x in strings])
    return found, keys(length_class(n), *battery(np.frombuffer("".join(strings).encode(), np.uint8), np.cumsum(n)))


def pieces(texts: list[str]) -> np.ndarray:
    """Keys of the pieces of text that small distances are measured on: all of it, cut anew for each length class."""
    out = [np.zeros(0, np.int64)]
    squeezed = np.frombuffer("".join(BLANK.sub("", CANDIDATE.sub(" ", t)) for t in texts).encode(), np.uint8)
    for k, n in enumerate(LENGTHS):
        at = np.arange(0, len(squeezed) - n + 1, n)
        if len(at) and len(squeezed) % n:
            at = np.append(at, len(squeezed) - n)
        for low in range(0, len(at), 4096):
            some = at[low : low + 4096]
            code, distance = battery(squeezed[(some[:, None] + np.arange(n)).ravel()], n * np.arange(1, len(some) + 1))
            out.append(keys(k, code, distance))
    return np.concatenate(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each row; the first row of each part also gets the counts of the part's candidates and pieces."""
    cache("secrets")
    for whole in batches:
        for low in range(0, whole.num_rows, 500):
            batch = whole.slice(low, 500)
            texts = [v or "" for v in batch.column(1).to_pylist()]
            found, key = candidates(texts)
            more: list[list] = [[] for _ in texts]
            for (i, a, b), k in zip(found, key.tolist(), strict=True):
                if k % BINS < BINS - 1:
                    more[i].append({"start": a, "end": b, "key": k})
            counts = [{"key": k, "tested": t, "n": n} for t, x in ((True, key), (False, pieces(texts))) for k, n in zip(*(v.tolist() for v in np.unique(x, return_counts=True)), strict=True)]
            base = [[x[2] for x in base_spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(pa.string())), pa.array(more, _MORE), pa.array([counts, *[[]] * (len(texts) - 1)], _COUNTS)], names=["doc_id", "base", "more", "counts"])


_MORE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("key", pa.int64())]))
_COUNTS = pa.list_(pa.struct([("key", pa.int64()), ("tested", pa.bool_()), ("n", pa.int64())]))
_SCANNED = "base array<string>, more array<struct<start:bigint,end:bigint,key:bigint>>, counts array<struct<key:bigint,tested:boolean,n:bigint>>"


def p_values(measured: np.ndarray) -> np.ndarray:
    """p of each key from the number of pieces of each key; one more piece of every class, as random as any, is assumed."""
    by = measured.reshape(len(LENGTHS), len(ENCODINGS), BINS)
    share = (1 + np.cumsum(by, axis=2)) / (1 + by.sum(axis=(1, 2)))[:, None, None]
    return np.minimum(1.0, len(ENCODINGS) * share).ravel()


def accepted(tested: np.ndarray, p: np.ndarray, fdr: float) -> list[int]:
    """Keys that Benjamini-Hochberg control accepts within each length class; ``tested``: candidates of each key."""
    out: list[int] = []
    for k in range(len(LENGTHS)):
        own = np.arange(k * len(tested) // len(LENGTHS), (k + 1) * len(tested) // len(LENGTHS))
        order = own[np.argsort(p[own], kind="stable")]
        below = np.cumsum(tested[order])
        # Equal p-values rank together: the last of them decides.
        last = np.searchsorted(p[order], p[order], "right") - 1
        good = np.flatnonzero((below[last] > 0) & (p[order] * tested[own].sum() <= fdr * below[last]) & (p[order] < 1))
        if len(good):
            out += order[p[order] <= p[order[good[-1]]]].tolist()
    return sorted(k for k in out if tested[k])


def _accepted(read: DataFrame, fdr: float) -> list[int]:
    """``read``: counts of all parts.  At most two numbers for each key come to the driver."""
    rows = read.where(F.size("counts") > 0).select(F.explode("counts").alias("c")).groupBy("c.key", "c.tested").agg(F.sum("c.n").alias("n")).collect()
    sums = np.zeros((2, len(LENGTHS) * len(ENCODINGS) * BINS), np.int64)
    for key, tested, n in rows:
        sums[int(tested), key] += n
    return accepted(sums[1], p_values(sums[0]), fdr)


def scanned(docs: DataFrame, fdr: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, random): base spans, and the accepted spans of the randomness battery, of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    read = Scratch(docs.sparkSession).write(rows.mapInArrow(_scan, f"doc_id {kind}, {_SCANNED}"))
    good = F.array(*map(F.lit, _accepted(read, fdr))).cast("array<bigint>")
    kept = F.filter("more", lambda m: F.array_contains(good, m["key"]))
    return read.select("doc_id", "base", F.transform(kept, lambda m: F.concat_ws(":", F.lit("random"), m["start"].cast("string"), m["end"].cast("string"))).alias("random"))


def secrets(docs: DataFrame, fdr: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = scanned(docs, fdr, doc_id, text)
    count = lambda kind: F.size(F.filter("base", lambda s: s.startswith(kind))).cast("bigint").alias(f"n_{kind}")
    key = lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("bigint").alias("at"), F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(s, F.lit(":"), F.lit(1))).alias("k"), s.alias("s"))
    every = F.array_sort(F.transform(F.concat("base", "random"), key))
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(F.transform(every, lambda x: x["s"]), ",").alias("spans"))


def masked(docs: DataFrame, fdr: float = 0.01, doc_id: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found replaced by ``mask``; all other columns and rows stay.

    The thresholds are found first, over the whole corpus; the second map finds the same spans again, so rows need no join.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    read = Scratch(docs.sparkSession).write(rows.mapInArrow(_scan, f"doc_id bigint, {_SCANNED}").where("size(counts) > 0").select("counts"))
    good = set(_accepted(read, fdr))

    def clean(texts: list) -> list:
        known = [v or "" for v in texts]
        spans = [[tuple(map(int, s.split(":")[1:])) for _, _, s in base_spans(t)] for t in known]
        for (i, a, b), key in zip(*(list(x) for x in candidates(known)), strict=True):
            if key in good:
                spans[i].append((a, b))
        return [None if v is None else _without(v, own, mask) for v, own in zip(texts, spans, strict=True)]

    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("secrets")
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                column = pa.array(clean(batch.column(place).to_pylist()), batch.schema.field(place).type)
                yield pa.RecordBatch.from_arrays([column if i == place else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _without(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            if start >= at:
                out += [text[at:start], mask]
            at = end
    return "".join([*out, text[at:]])


def digest(spans: list[str]) -> str:
    """base_sha256 of base spans."""
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
