"""The prefix tree of conversations, built shard by shard as double-array tries.

A turn is a symbol of 24 bytes: the first 128 bits of the SHA-256 of its role and text, and the number of its words.  A
conversation is a path of symbols (``paths``), held in one row; texts stay where they are.

1. Equal paths become one row with the number and the smallest id of their conversations, and the digest of their ids
   (``_ends``: ids sorted in ranges, joined in blocks, the blocks hashed one after the other, so no list of ids is ever whole).
2. Paths are sorted in ranges.  A task cuts its range into shards of about SHARD turns: neighbours in the order share prefixes,
   so each shard is a set of whole subtrees but for the nodes on its first and its last path, which other shards may share.
3. A shard deals dense ids to its turns and packs its tree into two arrays: node s has its child of turn c in cell
   BASE[s] + c, and CHECK there says s.  Walking every path through them adds up what each node has, then each level adds up
   its children.  Nodes that no other shard can have are finished; the first and the last path go on with what their nodes
   have so far (members, children, leaves and tokens of finished subtrees).
4. These paths, two a shard, are sorted and folded in the same way until one shard holds them all.  Children that were
   finished before their parent learn its smallest member by a join.

Defined results: turns are ordered by number (null first), equal numbers by their symbols; a null role or text is empty; a
null conversation id takes no part; repeated rows are turns of their own; an empty table has no nodes; only the four columns
named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import BROADCAST_ROWS, Scratch, having
from .texts import cache, small_batches

#: Turns in a shard, paths that a shard has at least (8, of which two go on, so that every level is smaller), ids in a block that is hashed at a time.
SHARD, FEWEST, BLOCK = 1 << 14, 8, 10_000
WIDTH = 24

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, turn binary, node binary, parent binary"
_OPEN = "path binary, members array<bigint>, low array<bigint>, children array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<string>"


def _print(role: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def paths(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, symbols array<binary>): each conversation's turns in order."""
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    n_words = F.regexp_count(text_, F.lit("[^\\x20\\x09-\\x0D]+"))
    symbol = F.unhex(F.concat(_print(role_, text_), F.lpad(F.hex(n_words), 16, "0")))
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv_id"), F.struct(F.col(turn).cast("bigint").alias("t"), symbol.alias("s")).alias("x"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]).alias("symbols"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) -> (key, first id, ids joined by commas) for at most BLOCK rows each."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            keys, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            spans = list(zip(edges, edges[1:], strict=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[a] for a, _ in spans], pa.binary()), pa.array([ids[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in spans])], names=["key", "first", "ids"]
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of a key -> the SHA-256 of its ids."""
    key = digest = None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k == key:
                digest.update(b",")
            else:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends"])


def _ends(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """(key, ends): the digest of the ids of every repeated path."""
    members = having(rows.select("key", "conv_id"), repeated.select("key"), ["key"])
    blocks = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_blocks, "key binary, first bigint, ids string")
    return blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")


class DoubleArray:
    """The trie of sorted paths of symbols ``code`` (1, 2, ...): ``base`` and ``check`` over cells, cell 0 the root."""

    def __init__(self, code: np.ndarray, length: np.ndarray):
        offset = np.cumsum(length) - length
        shared = np.zeros(len(length), np.int64)  # first symbols in common with the path before
        size = np.minimum(length[1:], length[:-1])
        if size.sum():
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            differs = np.flatnonzero(code[np.repeat(offset[1:], size) + at] != code[np.repeat(offset[:-1], size) + at])
            begin = np.cumsum(size) - size
            first = np.searchsorted(differs, begin)
            hit = np.append(differs, np.iinfo(np.int64).max)[first]
            shared[1:] = np.minimum(hit - begin, size)
        new = length - shared
        n = int(new.sum())
        depth = np.arange(n) - np.repeat(np.cumsum(new) - new, new) + np.repeat(shared, new) + 1
        own = code[np.repeat(offset + shared, new) + np.arange(n) - np.repeat(np.cumsum(new) - new, new)]
        parent = np.arange(n)  # nodes from 1, 0 the root: the node before, but for the first new node of a path
        first = (np.cumsum(new) - new)[new > 0]
        order = np.lexsort((np.arange(n), depth))
        ranked = depth[order] * (n + 1) + order
        above = depth[first] - 1
        found = order[np.maximum(np.searchsorted(ranked, above * (n + 1) + first) - 1, 0)] + 1 if n else first
        parent[first] = np.where(above == 0, 0, found)
        self._pack(own, parent, n)

    def _pack(self, code: np.ndarray, parent: np.ndarray, n: int) -> None:
        """First fit for the nodes of several children, most children first; single children take what is free then."""
        order = np.lexsort((code, parent))
        begin = np.flatnonzero(np.diff(parent[order], prepend=-1))
        kids = np.diff(np.append(begin, n))
        used = np.zeros(2 * n + int(code.max(initial=0)) + 66, bool)
        used[0] = True
        place, base_of, low = np.zeros(n, np.int64), np.zeros(n + 1, np.int64), 1
        for g in np.argsort(-kids, kind="stable")[: int((kids > 1).sum())]:
            own = order[begin[g] : begin[g] + kids[g]]
            spread, step, at = code[own] - code[own[0]], max(1, 4096 // int(kids[g])), low
            while True:
                if at + step + spread[-1] >= len(used):
                    used = np.append(used, np.zeros(len(used) + step + int(spread[-1]), bool))
                tried = at + np.flatnonzero(~used[at : at + step])
                fits = ~used[tried[:, None] + spread].any(axis=1)
                if fits.any():
                    cell = int(tried[np.argmax(fits)])
                    break
                at += step
            low = max(low, at - 4 * step)  # cells that were tried this often are left to single children
            used[cell + spread] = True
            place[own], base_of[parent[own[0]]] = cell + spread, cell - code[own[0]]
        single = order[begin[kids == 1]]
        free = np.flatnonzero(~used)
        if len(free) < len(single):
            free = np.append(free, len(used) + np.arange(len(single)))
        place[single] = free[: len(single)]
        base_of[parent[single]] = place[single] - code[single]
        cell = np.append(0, place)
        size = int(cell.max()) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -2)
        self.base[cell] = base_of
        self.check[place], self.check[0] = cell[parent], -1
        self.nodes = cell  # parents before their children

    def steps(self, code: np.ndarray, length: np.ndarray):
        """Walks all paths at once: for each depth (the paths that reach it, their cells)."""
        offset, cell, alive = np.cumsum(length) - length, np.zeros(len(length), np.int64), np.arange(len(length))
        yield 0, alive, cell
        for d in range(int(length.max(initial=0))):
            alive = alive[length[alive] > d]
            to = self.base[cell[alive]] + code[offset[alive] + d]
            if not (self.check[to] == cell[alive]).all():
                raise AssertionError("a path left its trie")
            cell[alive] = to
            yield d + 1, alive, to


def _dense(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of each symbol from 1, words of each id, bytes of each id)."""
    if not len(symbols):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((1, 3), ">u8")
    order = np.lexsort((symbols[:, 1], symbols[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (symbols[order[1:], :2] != symbols[order[:-1], :2]).any(axis=1)
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new)
    kept = np.concatenate([np.zeros((1, 3), ">u8"), symbols[order[new]]]).astype(">u8")
    return code, kept[:, 2].astype(np.int64), kept


def _prints(path: bytes) -> list[bytes]:
    """A name for each prefix of a path, from the empty one on."""
    digest, out = hashlib.sha256(), [hashlib.sha256().digest()[:16]]
    for at in range(0, len(path), WIDTH):
        digest.update(path[at : at + WIDTH])
        out.append(digest.digest()[:16])
    return out


class _Rows:
    """Sorted paths with what they add to the node at each of their depths, all in flat arrays."""

    def __init__(self):
        self.paths, self.flat, self.ends, self.turns = [], {k: [] for k in _SUMS}, [], 0

    def add(self, path: bytes, sums: dict, ends: list) -> None:
        self.paths.append(path)
        self.ends += ends
        self.turns += len(ends)
        for k, v in sums.items():
            self.flat[k].append(v)


_SUMS = ("members", "low", "children", "leaves", "saved")
_NONE = np.iinfo(np.int64).max


def _fold(rows: _Rows, upper: bool, last: bool) -> list[pa.RecordBatch]:
    """The finished nodes and the open paths of one shard; ``upper``: of open paths; ``last``: it is the only shard."""
    length = np.array([len(p) // WIDTH for p in rows.paths], np.int64)
    code, words, known = _dense(np.frombuffer(b"".join(rows.paths), ">u8").reshape(-1, 3))
    trie, has = DoubleArray(code, length), {k: np.concatenate(v) for k, v in rows.flat.items()}
    size, edges = len(trie.base), sorted({0, len(length) - 1})
    sums = {k: np.full(size, _NONE if k == "low" else 0) for k in _SUMS}
    depth, turn, ends, names = np.zeros(size, np.int64), np.zeros(size, np.int64), {}, {}
    at, offset = np.cumsum(length + 1) - (length + 1), np.cumsum(length) - length
    ending = np.array([e is not None for e in rows.ends], bool)
    named = {p: _prints(rows.paths[p]) for p in (range(len(length)) if upper else edges)}
    walks: dict[int, list[int]] = {p: [] for p in named}
    levels = []
    for d, alive, cell in trie.steps(code, length):
        here = at[alive] + d
        for k in _SUMS:
            (np.minimum if k == "low" else np.add).at(sums[k], cell, has[k][here])
        depth[cell] = d
        if d:
            turn[cell] = code[offset[alive] + d - 1]
        levels.append(np.unique(cell))
        ends.update((int(cell[i]), rows.ends[here[i]]) for i in np.flatnonzero(ending[here]))
        for p in walks:
            if length[p] >= d:
                c = int(cell[np.searchsorted(alive, p)])
                walks[p].append(c)
                names[c] = named[p][d]
    is_open = np.zeros(size, bool)
    if not last:
        for p in edges:
            is_open[walks[p]] = True
    for level in reversed(levels):
        done = level[~is_open[level]]
        sums["leaves"][done] += sums["children"][done] == 0
        sums["saved"][done] += (sums["members"][done] - 1) * words[turn[done]]
        done = done[done > 0]
        for k, v in (("children", 1), ("leaves", sums["leaves"][done]), ("saved", sums["saved"][done])):
            np.add.at(sums[k], trie.check[done], v)
    cell = trie.nodes[~is_open[trie.nodes]]
    up = trie.check[cell]
    waits = (up >= 0) & is_open[np.maximum(up, 0)]
    turns = [known[t, :2].tobytes() if c else None for t, c in zip(turn[cell].tolist(), cell.tolist(), strict=True)]
    columns = {
        "conv_id": sums["low"][cell],
        "depth": depth[cell],
        "parent_conv_id": pa.array(sums["low"][np.maximum(up, 0)], mask=waits | (up < 0)),
        **{n: sums[k][cell] for n, k in (("n_convs", "members"), ("n_children", "children"), ("n_leaves", "leaves"), ("saved_tokens", "saved"))},
        "ends_sha256": [ends.get(c) for c in cell.tolist()],
        "turn": turns,
        "node": [names.get(c) if upper else None for c in cell.tolist()],
        "parent": [names[u] if w else None for u, w in zip(up.tolist(), waits.tolist(), strict=True)],
    }
    out = [columns | {k: pa.nulls(len(cell), _SCHEMA.field(k).type) for k in ("path", *_SUMS, "ends")}]
    seen: set[int] = set()
    for p in edges if not last else ():
        fresh = np.array([c not in seen for c in walks[p]])  # what both paths share goes on once
        seen |= set(walks[p])
        goes = {k: [np.where(fresh, sums[k][walks[p]], _NONE if k == "low" else 0)] for k in _SUMS}
        goes |= {"path": [rows.paths[p]], "ends": [[ends.get(c) if f else None for c, f in zip(walks[p], fresh, strict=True)]]}
        out.append({k: pa.nulls(1, _SCHEMA.field(k).type) for k in columns} | goes)
    return [pa.RecordBatch.from_arrays([pa.array(o[f.name], f.type) if not isinstance(o[f.name], pa.Array) else o[f.name] for f in _SCHEMA], schema=_SCHEMA) for o in out]


_SCHEMA = pa.schema(
    [(k, pa.int64()) for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("turn", pa.binary()), ("node", pa.binary()), ("parent", pa.binary()), ("path", pa.binary())]
    + [(k, pa.list_(pa.int64())) for k in _SUMS]
    + [("ends", pa.list_(pa.string()))]
)


def _shards(upper: bool, last: bool):
    """Map of sorted paths, (path, n, low, ends) or, if ``upper``, open ones, to what their shards make of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("trie")
        rows = _Rows()
        for batch in batches:
            get = {k: batch.column(k) for k in batch.schema.names}
            for i, path in enumerate(get["path"].to_pylist()):
                if upper:
                    rows.add(path, {k: get[k][i].values.to_numpy() for k in _SUMS}, get["ends"][i].as_py())
                else:
                    size, none = len(path) // WIDTH + 1, np.zeros(len(path) // WIDTH + 1, np.int64)
                    rows.add(path, {"members": np.full(size, get["n"][i].as_py()), "low": np.full(size, get["low"][i].as_py())} | dict.fromkeys(("children", "leaves", "saved"), none), [None] * (size - 1) + [get["ends"][i].as_py()])
                if not last and rows.turns >= SHARD and len(rows.paths) >= FEWEST:
                    yield from _fold(rows, upper, last)
                    rows = _Rows()
        if rows.paths:
            yield from _fold(rows, upper, last)

    return run


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row for each distinct prefix of (conv_id, symbols array<binary>), see ``paths``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and turn (the
    print of the last turn, null at the root).
    """
    spark = sequences.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    schema = f"{_NODE}, {_OPEN}"
    path = F.unhex(F.array_join(F.transform("symbols", lambda s: F.hex(s)), ""))
    rows = scratch.write(sequences.where("conv_id is not null").select("conv_id", path.alias("path")).withColumn("key", F.substring(F.sha2("path", 256), 1, 32)).withColumn("key", F.unhex("key")))
    equal = scratch.write(rows.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("low")))
    repeated = equal.where("n > 1")
    digests = scratch.write(_ends(rows, repeated))
    single = equal.where("n = 1").withColumn("ends", F.sha2(F.col("low").cast("string"), 256))
    level = single.unionByName(repeated.join(digests, "key")).select("path", "n", "low", "ends")

    level = level.repartitionByRange("path").sortWithinPartitions("path")
    out = [scratch.write(level.mapInArrow(_shards(False, False), schema))]
    while True:
        rest = out[-1].where("path is not null").select("path", *_SUMS, "ends")
        count, turns = rest.agg(F.count("*"), F.sum(F.octet_length("path") / WIDTH + 1)).first()
        if not count:
            break
        last = turns <= SHARD or count <= FEWEST
        parts = 1 if last else min(-(-count // (2 * FEWEST)), int(-(-turns // SHARD)))
        out.append(scratch.write(rest.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(_shards(True, last), schema)))
    nodes = None
    for o in out:
        own = o.where("path is null").select(*(c.split()[0] for c in _NODE.split(", ")))
        nodes = own if nodes is None else nodes.unionByName(own)
    waiting = nodes.where("parent is not null").drop("parent_conv_id")
    upper = nodes.where("node is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    upper = F.broadcast(upper) if upper.count() <= BROADCAST_ROWS else upper
    found = nodes.where("parent is null").unionByName(waiting.join(upper, "parent"))
    empty = F.sha2(F.lit(""), 256)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), "turn")


def turn_texts(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """(turn, role, text): what the prints in ``turn`` of ``prefix_trie`` stand for."""
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return turns.select(F.unhex(_print(role_, text_)).alias("turn"), role_.alias("role"), text_.alias("text")).dropDuplicates(["turn"])
