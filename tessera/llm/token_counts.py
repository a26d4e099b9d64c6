"""Token counts by a compiled finite-state tokenizer.

Texts stay where Spark reads them: one map over Arrow batches, no shuffle.  A batch becomes one stream of bytes; the
pre-tokenizer marks where the transducer starts anew, so the map of a word (entry state -> exit state, tokens) is the same
for every entry and composing words adds their tokens; long words are several chunks whose state maps are composed by a
parallel prefix scan (transducer.py).  Sums of the counts between document bounds are the documents' counts.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows, null ids and further columns are kept as
they are; an added special token written out in a text counts as that one token, as in the library's default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import CodePoints, cache, raw, row_groups, small_batches
from .transducer import Transducer


def compiled(path: str):
    """(transducer, code point classes, pattern of the added special tokens), once for each Python worker."""
    made = cache("tokens")
    if path not in made:
        import json

        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        pattern = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        made[path] = (Transducer(path), CodePoints(), pattern)
    return made[path]


def segments(data: np.ndarray, offsets: np.ndarray, pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts between special tokens, the row of each, special tokens of each row)."""
    whole = data.tobytes()
    texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    rows, special = list(range(len(texts))), np.zeros(len(texts), np.int64)
    if pattern and b"<|" in whole:
        parts = [pattern.split(t) for t in texts]
        special = np.array([len(p) - 1 for p in parts], np.int64)
        rows = [i for i, p in enumerate(parts) for _ in p]
        texts = [t for p in parts for t in p]
    if max(map(len, texts), default=0) > LONG:
        parts = [cut(t) for t in texts]
        rows = [r for r, p in zip(rows, parts, strict=True) for _ in p]
        texts = [t for p in parts for t in p]
    return texts, np.array(rows, np.int64), special


#: Characters from which a text is read in several parts.
LONG = 1 << 20
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;])(?=[ \n][A-Za-z])")


def cut(text: str) -> list[str]:
    """Parts of a long text; between a word and the space after it no pre-token continues."""
    out, at = [], 0
    while len(text) - at > LONG and (found := _SAFE.search(text, at + LONG // 2)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def some_at_a_time(texts: list[str], rows: np.ndarray):
    """Runs of (texts, rows) of about LONG characters."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > 2 * LONG:
            yield texts[low:i], rows[low:i]
            low, size = i, 0
        size += len(t)
    yield texts[low:], rows[low:]


def counts(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text, for a byte-level model whose pre-tokens keep the space before them."""
    transducer, classes, pattern = compiled(path)
    every, owners, total = segments(data, offsets, pattern)
    for texts, rows in some_at_a_time(every, owners):
        whole = "".join(texts)
        points = classes.of(whole)
        if not len(points):
            continue
        lengths = np.array([len(t) for t in texts], np.int64)
        bounds = np.cumsum(lengths) - lengths
        first = np.zeros(len(points), bool)
        first[bounds[lengths > 0]] = True
        starts = classes.spaced(points, first)
        at = classes.byte_offsets(points)
        symbols = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        n, _ = transducer.read(symbols, at[starts], at[np.append(starts[1:], len(points))])
        owner = rows[lengths > 0][np.searchsorted(bounds[lengths > 0], starts, "right") - 1]
        total = total + np.bincount(owner, n, len(total)).astype(np.int64)
    return total


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    ``path``: a tokenizers JSON file at a place that every executor has.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    clash = {"n_bytes", "n_tokens", "over_limit"} & set(keep)
    if clash:
        raise ValueError(f"columns of that name exist: {sorted(clash)}; name those to keep")
    small_batches(docs.sparkSession)
    picked = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(len(keep)))
            parts = [counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], path) for a, b in row_groups(offsets)]
            n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kept}{', ' if kept else ''}n_bytes bigint, n_tokens bigint, over_limit boolean")
